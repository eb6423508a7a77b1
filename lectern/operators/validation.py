"""Validation of questions: flags and confidence, reports by paper and over papers, blocking errors and the export gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

LETTERS = ("A", "B", "C", "D")
RANKS = ("HIGH", "MEDIUM", "LOW")
# The confidence below which OCR is poor, and the passage prefix that names a group in reports.
POOR_OCR, PREFIX = 0.6, 60


def _blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def _empty_options() -> Column:
    return F.filter(F.array(*(F.when(_blank(f"options.{x}"), x) for x in LETTERS)), lambda x: x.isNotNull())


def flags() -> Column:
    """Array of (message, rank) in a fixed order; rank 1 is MEDIUM and 2 is LOW."""

    def flag(when: Column, message: Column | str, rank: int = 2) -> Column:
        return F.when(when, F.struct((F.lit(message) if isinstance(message, str) else message).alias("message"), F.lit(rank).alias("rank")))

    answer, image = F.coalesce("correct_answer", F.lit("")), F.col("is_image")
    chosen = reduce(lambda acc, x: acc.when(answer == x, F.col(f"options.{x}")), LETTERS[1:], F.when(answer == LETTERS[0], F.col("options.A")))
    missing = _empty_options()
    conf = F.coalesce("source_confidence", F.lit(0.0))
    percent = F.format_string("%.0f%%", 100 * conf)
    ocr = F.coalesce(F.col("source_method") == "ocr", F.lit(False))
    before = [
        flag(F.coalesce("number", F.lit(0)) == 0, "missing question number"),
        flag(_blank("stem"), "empty question text"),
        flag(image, "image-based question — options/figure not extracted (V1 scope)"),
        flag(~image & (F.size(missing) > 0), F.concat(F.lit("missing option(s): "), F.array_join(missing, ", "))),
        flag(answer == "", "no correct answer found in answer key", 1),
        flag((answer != "") & ~answer.isin(*LETTERS), F.concat(F.lit("correct answer '"), answer, F.lit("' is not A/B/C/D"))),
        flag(answer.isin(*LETTERS) & ~image & _blank(chosen), F.concat(F.lit("correct answer '"), answer, F.lit("' points to an empty option"))),
        flag(F.col("q_type").isin("PASSAGE_MCQ", "PASSAGE_FILL_BLANK") & _blank("passage"), "passage-type question but no passage text attached"),
        flag(_blank("explanation"), "no explanation found", 1),
    ]
    notes = F.transform(F.coalesce("notes", F.array().cast("array<string>")), lambda n: F.struct(F.concat(F.lit("parser anomaly: "), n).alias("message"), F.when(n.startswith("answer key conflict"), 2).otherwise(1).alias("rank")))
    after = [flag(ocr & (conf < POOR_OCR), F.concat(F.lit("OCR fallback with low confidence ("), percent, F.lit(")"))), flag(ocr & (conf >= POOR_OCR), F.concat(F.lit("extracted via OCR fallback ("), percent, F.lit(" confidence)")), 1)]
    return F.concat(F.array_compact(F.array(*before)), notes, F.array_compact(F.array(*after)))


def annotated(questions: DataFrame) -> DataFrame:
    """``questions`` with validation_flags and confidence, the worst rank of its flags."""
    q = questions.withColumn("_f", flags())
    worst = F.coalesce(F.array_max(F.transform("_f", lambda f: f["rank"])), F.lit(0))
    return q.withColumns({"validation_flags": F.transform("_f", lambda f: f["message"]), "confidence": F.get(F.array(*map(F.lit, RANKS)), worst)}).drop("_f")


def repeated_numbers(questions: DataFrame, key: list[str], number: str = "number") -> DataFrame:
    """key, number, times of the numbers that a paper has more than once."""
    return questions.groupBy(*key, F.col(number).alias("number")).agg(F.count("*").alias("times")).where("times > 1")


def missing_numbers(questions: DataFrame, key: list[str], number: str = "number") -> DataFrame:
    """key, number of the gaps between a paper's least and greatest number."""
    span = questions.groupBy(*key).agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"))
    every = span.where("_lo is not null").select(*key, F.explode(F.sequence("_lo", "_hi")).alias("number"))
    return every.join(questions.select(*key, F.col(number).alias("number")), [*key, "number"], "left_anti")


COUNTS = ("total_detected", "text_questions", "image_questions", "high_confidence", "medium_confidence", "low_confidence", "missing_answers", "missing_options", "passage_questions", "passage_groups")


def report(questions: DataFrame, key: list[str]) -> DataFrame:
    """One row per paper: COUNTS, and the numbers (as arrays) without answer, without an option, repeated, and missing.

    questions: annotated, with sequence_number. One pass and one shuffle; a paper's numbers are a bounded set.
    """
    no_answer, option = F.coalesce("correct_answer", F.lit("")) == "", ~F.col("is_image") & (F.size(_empty_options()) > 0)
    passage = F.coalesce("passage", F.lit("")) != ""
    listed = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("sequence_number", "number")))), lambda s: s["number"])
    one = questions.groupBy(*key).agg(
        F.count("*").alias("total_detected"), F.count_if(~F.col("is_image")).alias("text_questions"), F.count_if("is_image").alias("image_questions"),
        *(F.count_if(F.col("confidence") == r).alias(f"{r.lower()}_confidence") for r in RANKS),
        F.count_if(no_answer).alias("missing_answers"), listed(no_answer).alias("missing_answers_numbers"), F.count_if(option).alias("missing_options"), listed(option).alias("missing_options_numbers"),
        F.count_if(passage).alias("passage_questions"), F.count_distinct(F.when(passage, F.substring("passage", 1, PREFIX))).alias("passage_groups"),
        F.array_sort(F.collect_list("number")).alias("_all"),
    )
    held = F.array_distinct("_all")
    gaps = F.when(F.size("_all") > 0, F.array_except(F.sequence(F.array_min("_all"), F.array_max("_all")), held)).otherwise(F.array().cast("array<int>"))
    twice = F.array_distinct(F.filter("_all", lambda n, i: (i > 0) & (n == F.get("_all", i - 1))))
    return one.withColumns({"duplicate_question_numbers": twice, "missing_question_numbers": gaps}).drop("_all")


def rollup(reports: DataFrame) -> DataFrame:
    """Over all papers: papers_detected and the sum of each of COUNTS."""
    return reports.agg(F.count("*").alias("papers_detected"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS))


def report_text() -> Column:
    """A report row as its eleven lines."""
    size = lambda c: F.size(c).cast("string")
    told = (("Total detected", F.col("total_detected")), ("Text questions", F.col("text_questions")), ("Image questions", F.col("image_questions")), ("High confidence", F.col("high_confidence")), ("Medium confidence", F.col("medium_confidence")), ("Needs review (low confidence)", F.col("low_confidence")), ("Missing answers", F.col("missing_answers")), ("Missing options", F.col("missing_options")))
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), c) for k, c in told), F.concat(F.lit("Duplicate question numbers: "), size("duplicate_question_numbers")), F.concat(F.lit("Missing question numbers: "), size("missing_question_numbers")), F.concat(F.lit("Passage groups: "), F.col("passage_groups"), F.lit(" ("), F.col("passage_questions"), F.lit(" questions)")))


def blocking_errors(questions: DataFrame, schemes: DataFrame, key: list[str], difficulty: DataFrame | None = None) -> DataFrame:
    """key, errors: what must be put right before export, in order. Papers without errors have none in the array.

    schemes: key and ``scheme``; difficulty: key and ``errors``.
    """
    answer = strip(F.coalesce("correct_answer", F.lit("")))
    bad = F.when((answer != "") & ~answer.isin(*LETTERS), F.struct("sequence_number", F.concat(F.lit("Q"), F.coalesce(F.col("number").cast("string"), F.lit("None")), F.lit(": correct answer '"), answer, F.lit("' is not A/B/C/D.")).alias("m")))
    one = questions.groupBy(*key).agg(F.count_if(F.col("number").isNull()).alias("_null"), F.array_sort(F.collect_list("number")).alias("_all"), F.transform(F.array_sort(F.collect_list(bad)), lambda b: b["m"]).alias("_bad")).join(schemes, key, "left")
    twice = F.array_distinct(F.filter("_all", lambda n, i: (i > 0) & (n == F.get("_all", i - 1))))
    first = F.array(F.when(F.col("_null") > 0, "One or more questions are missing a question number."), F.when(F.size(twice) > 0, F.concat(F.lit("Duplicate question numbers: ["), F.array_join(twice.cast("array<string>"), ", "), F.lit("]"))))
    last = F.array(F.when(F.col("scheme.maximum_marks") <= 0, "Maximum Marks must be a positive number."), F.when(F.col("scheme.marks_per_question") <= 0, "Marks per Question must be a positive number."), F.when(F.col("scheme.negative_marks") < 0, "Negative Marks cannot be negative."))
    errors = F.concat(F.array_compact(first), "_bad", F.array_compact(last))
    if difficulty is not None:
        one = one.join(difficulty.select(*key, F.col("errors").alias("_d")), key, "left")
        errors = F.concat(errors, F.coalesce("_d", F.array().cast("array<string>")))
    return one.select(*key, errors.alias("errors"))


def gate(reports: DataFrame, errors: DataFrame, key: list[str], unassigned: DataFrame | None = None, unconfirmed: DataFrame | None = None) -> DataFrame:
    """key, state (blocked, warn or clean), warnings. Errors block; low confidence, missing answers, unassigned difficulty and image questions without image only warn."""
    g = reports.join(errors, key, "left")
    for name, df in (("unassigned", unassigned), ("unconfirmed", unconfirmed)):
        g = g.join(df.select(*key, F.col("n").alias(name)), key, "left") if df is not None else g.withColumn(name, F.lit(0))
    review = F.col("low_confidence") + F.col("missing_answers")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    warnings = F.array_compact(F.array(F.when(review > 0, F.concat(review, F.lit(" question(s) still need review (low confidence and/or missing answers)"))), F.when(count("unassigned") > 0, F.concat(count("unassigned"), F.lit(" question(s) do not have a difficulty level"))), F.when(count("unconfirmed") > 0, F.concat(count("unconfirmed"), F.lit(" image question(s) have no confirmed image")))))
    gaps = (F.size("duplicate_question_numbers") > 0) | (F.size("missing_question_numbers") > 0)
    state = F.when(F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0, "blocked").when((F.size(warnings) > 0) | gaps, "warn").otherwise("clean")
    return g.select(*key, state.alias("state"), warnings.alias("warnings"))


def section_counts(questions: DataFrame, key: list[str]) -> DataFrame:
    """key, section, n, place: sections by their first question; without one, Unknown Section."""
    s = questions.groupBy(*key, F.coalesce(F.nullif("section", F.lit("")), F.lit("Unknown Section")).alias("section")).agg(F.count("*").alias("n"), F.min("sequence_number").alias("_first"))
    return s.select(*key, "section", "n", F.row_number().over(Window.partitionBy(*key).orderBy("_first")).alias("place"))


def passage_groups(questions: DataFrame, key: list[str]) -> DataFrame:
    """key, passage, numbers (sorted), place: questions with the very same passage, groups by their first question."""
    g = questions.where(F.coalesce("passage", F.lit("")) != "").groupBy(*key, "passage").agg(F.array_sort(F.collect_list("number")).alias("numbers"), F.min("sequence_number").alias("_first"))
    return g.select(*key, "passage", "numbers", F.row_number().over(Window.partitionBy(*key).orderBy("_first")).alias("place"))


def search(questions: DataFrame, wanted: str) -> DataFrame:
    """Questions whose number or case-folded stem holds ``wanted``; a blank one matches all."""
    w = wanted.strip().lower()
    return questions.where(F.lit(not w) | F.col("number").cast("string").contains(w) | F.lower("stem").contains(w))
