"""Marking-scheme facts from text: each a struct (value, status). Different statements of one fact make it ambiguous."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The statements of each fact, and the number words they may use.
MAX_MARKS = (r"(?i)Max\s*marks[\s:-]*\s*([0-9]+)", r"(?i)Maximum\s*Marks\s*[:\-]?\s*([0-9]+)")
TOTAL_QUESTIONS = (r"(?i)Total\s*Questions?\s*[:\-]?\s*([0-9]+)",)
NEGATIVE = (r"(?i)Negative\s*Mark(?:ing|s)?\s*[:\-]?\s*(-?[0-9]+(?:\.[0-9]+)?)", r"(?i)\b([0-9]+|one|two|three|four|five|six|seven|eight|nine|ten)\b\s+marks?\s+(?:is|are|will\s+be)\s+deducted")
PER_QUESTION = (r"(?i)carries[^.]*?\b([0-9]+|one|two|three|four|five|six|seven|eight|nine|ten)\b\s+marks?\b",)
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def _value(token: Column) -> Column:
    word = F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), F.lower(token))
    return F.when(word > 0, word.cast("double")).otherwise(token.try_cast("double"))


def fact(text: Column | str, patterns: tuple[str, ...]) -> Column:
    """(value, status): not_specified without a statement, ambiguous with differing ones, else pdf."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns))
    values = F.array_distinct(F.filter(F.transform(found, lambda t: F.abs(_value(t))), lambda v: v.isNotNull()))
    n = F.size(values)
    status = F.when(text.isNull() if isinstance(text, Column) else F.col(text).isNull(), "not_specified").when(n == 0, "not_specified").when(n == 1, "pdf").otherwise("ambiguous")
    return F.struct(F.when(n == 1, F.get(values, F.lit(0))).alias("value"), status.alias("status"))


def max_marks(text: Column | str) -> Column:
    return fact(text, MAX_MARKS)


def total_questions(text: Column | str) -> Column:
    return fact(text, TOTAL_QUESTIONS)


def negative_marks(text: Column | str) -> Column:
    return fact(text, NEGATIVE)


def marks_per_question(text: Column | str) -> Column:
    return fact(text, PER_QUESTION)


def scheme(text: Column | str) -> Column:
    """One struct of the four facts and their sources. Marks per question: stated, else maximum / total; if both are there
    and differ, ambiguous and null."""
    most, total, negative, stated = max_marks(text), total_questions(text), negative_marks(text), marks_per_question(text)
    derived = F.when(total["value"] != 0, most["value"] / total["value"])
    clash = stated["value"].isNotNull() & derived.isNotNull() & (stated["value"] != derived)
    source = F.when(clash, "ambiguous").when(stated["value"].isNotNull(), "pdf").when(derived.isNotNull(), "derived").otherwise(stated["status"])
    return F.struct(
        total["value"].cast("int").alias("total_questions"), most["value"].alias("maximum_marks"), F.when(~clash, F.coalesce(stated["value"], derived)).alias("marks_per_question"), negative["value"].alias("negative_marks"),
        F.struct(total["status"].alias("total_questions"), most["status"].alias("maximum_marks"), source.alias("marks_per_question"), negative["status"].alias("negative_marks")).alias("source"),
    )


def build_scheme(total: Column, most: Column, negative: Column) -> Column:
    """The scheme of stated numbers alone: marks per question is what they imply."""
    per = F.when(most.isNotNull() & (total > 0), most / total)
    stated = lambda c: F.when(c.isNotNull(), "pdf").otherwise("not_specified")
    return F.struct(
        most.cast("double").alias("maximum_marks"), per.alias("marks_per_question"), negative.cast("double").alias("negative_marks"),
        F.struct(stated(most).alias("maximum_marks"), F.when(per.isNotNull(), "derived").otherwise("not_specified").alias("marks_per_question"), stated(negative).alias("negative_marks")).alias("source"),
    )


def current_scheme(detected: Column, typed: dict[str, Column]) -> Column:
    """The detected scheme under what a reviewer typed (null: untouched; blank: cleared); a changed value's source is manual."""
    values, sources = [], []
    for name in ("maximum_marks", "marks_per_question", "negative_marks"):
        now = F.when(typed[name].isNull(), detected[name]).otherwise(F.btrim(typed[name]).try_cast("double"))
        values.append(now.alias(name))
        changed = ~now.eqNullSafe(detected[name])
        base = F.when(now.isNotNull(), F.lit("pdf" if name != "marks_per_question" else "derived")).otherwise("not_specified")
        sources.append(F.when(changed & now.isNotNull(), "manual").when(changed, "not_specified").otherwise(base).alias(name))
    return F.struct(*values, F.struct(*sources).alias("source"))


def caption(current: Column, detected: Column, source: Column) -> Column:
    return (
        F.when(source == "ambiguous", "⚠ Ambiguous — conflicting values found in the PDF, needs review")
        .when(current.isNull(), "⚠ Not specified in PDF")
        .when(current == detected, F.when(source == "derived", "✓ Derived from Maximum Marks / Question Count").otherwise("✓ Extracted from PDF"))
        .otherwise("✎ Manually entered")
    )
