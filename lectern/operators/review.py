"""Review state as relations: frozen questions under a log of edits, difficulty lists, badges and images.

The log has (key, number, edit_seq, op, patch); op is set, reset or reset_all, and a patch is a struct of the fields that
an edit may set, null where it doesn't. Within a paper the last duplicate of a number is the one that edits and views see,
at every place of that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

LEVELS = ("easy", "medium", "hard")
DESTINATIONS = ("question", "option_a", "option_b", "option_c", "option_d")


def overlay(edits: DataFrame, key: list[str]) -> DataFrame:
    """key, number, patch: per field the last value set since the paper's last reset of all and the number's last reset."""
    patch = edits.schema["patch"].dataType.names
    cleared = edits.where("op = 'reset_all'").groupBy(*key).agg(F.max("edit_seq").alias("_all"))
    own = edits.where("op in ('set', 'reset')").join(cleared, key, "left").where("_all is null or edit_seq > _all")
    w = Window.partitionBy(*key, "number")
    live = own.withColumn("_reset", F.max(F.when(F.col("op") == "reset", F.col("edit_seq"))).over(w)).where("op = 'set' and (_reset is null or edit_seq > _reset)")
    last = [F.max_by(F.col(f"patch.{c}"), F.when(F.col(f"patch.{c}").isNotNull(), F.col("edit_seq"))).alias(c) for c in patch]
    return live.groupBy(*key, "number").agg(F.struct(*last).alias("patch"))


def effective(questions: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """The questions as they stand, in their places, with ``modified`` and ``was_flagged`` (by the frozen confidence)."""
    w = Window.partitionBy(*key, "number")
    places = questions.select(*key, "number", "sequence_number")
    last = questions.withColumn("_n", F.row_number().over(w.orderBy(F.desc("sequence_number")))).where("_n = 1").drop("_n", "sequence_number")
    patches = overlay(edits, key)
    names = patches.schema["patch"].dataType.names
    now = places.join(last, [*key, "number"]).join(patches, [*key, "number"], "left")
    columns = [F.coalesce(F.col(f"patch.{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in questions.columns]
    return now.select(*columns, F.col("patch").isNotNull().alias("modified"), (F.col("confidence") != "HIGH").alias("was_flagged"))


def badges() -> Column:
    both = F.col("modified") & F.col("was_flagged")
    return F.when(both, F.array(F.lit("✓ Manually Confirmed"), F.lit("✎ Modified"))).when(F.col("modified"), F.array(F.lit("✎ Modified"))).when(F.col("was_flagged"), F.array(F.lit("⚠ Needs Review"))).otherwise(F.array(F.lit("✓ Extracted")))


def counts(current: DataFrame, key: list[str]) -> DataFrame:
    """key, needs_review, resolved, remaining."""
    flagged = F.count_if("was_flagged")
    done = F.count_if(F.col("was_flagged") & F.col("modified"))
    return current.groupBy(*key).agg(flagged.alias("needs_review"), done.alias("resolved"), (flagged - done).alias("remaining"))


def passage_edits(numbers: Column, passage: Column, seq: Column) -> list[Column]:
    """The columns of one set edit of the passage for each of ``numbers``."""
    return [F.explode(numbers).alias("number"), seq.alias("edit_seq"), F.lit("set").alias("op"), F.struct(passage.alias("passage")).alias("patch")]


def number_lists(lists: DataFrame, numbers: DataFrame, key: list[str], by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Reads lists such as ``1-10, 15`` (column ``text``) against each paper's numbers.

    Returns (key, by, number) of what they name, once each, and (key, by, place, message) of what is wrong, in the order
    of the text. A reversed range, another form, a number named twice and a number that isn't there each give one error
    and nothing else.
    """
    every = [*key, *by]
    token = lists.select(*every, F.posexplode(F.split(F.coalesce("text", F.lit("")), ",", -1)).alias("_t", "_raw")).withColumn("token", strip("_raw")).where("token <> ''")
    first, last = F.regexp_extract("token", r"^([0-9]+)\s*-\s*([0-9]+)$", 1).try_cast("long"), F.regexp_extract("token", r"^([0-9]+)\s*-\s*([0-9]+)$", 2).try_cast("long")
    single = F.col("token").rlike("^[0-9]+$")
    token = token.withColumn("_lo", F.when(single, F.col("token").try_cast("long")).otherwise(first)).withColumn("_hi", F.when(single, F.col("token").try_cast("long")).otherwise(last))
    wrong = token.where("_lo is null or _lo > _hi").select(*every, "_t", F.lit(0).cast("long").alias("_n"), F.when(F.col("_lo").isNull(), F.concat(F.lit("invalid entry '"), "token", F.lit("'"))).otherwise(F.concat(F.lit("malformed range '"), "token", F.lit("' (start is greater than end)"))).alias("message"))
    named = token.where("_lo <= _hi").select(*every, "_t", F.explode(F.sequence("_lo", "_hi")).alias("_n"))
    again = Window.partitionBy(*every, "_n").orderBy("_t")
    valid = numbers.select(*key, F.col("number").cast("long").alias("_n"), F.lit(True).alias("_there")).distinct()
    checked = named.withColumn("_again", F.row_number().over(again)).join(valid, [*key, "_n"], "left")
    message = F.when(F.col("_again") > 1, F.concat(F.lit("duplicate question number "), "_n", F.lit(" within this field"))).when(F.col("_there").isNull(), F.concat(F.lit("question number "), "_n", F.lit(" does not exist in this paper")))
    errors = wrong.unionByName(checked.where("_again > 1 or _there is null").select(*every, "_t", "_n", message.alias("message")))
    place = F.row_number().over(Window.partitionBy(*every).orderBy("_t", "_n"))
    return checked.where("_again = 1 and _there").select(*every, F.col("_n").cast("int").alias("number")), errors.select(*every, place.alias("place"), "message")


def difficulty(lists: DataFrame, questions: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Reads (key, level, text). Returns (key, number, levels, level) of every question number, level being null where none or more than one
    claims it, and (key, errors), the blocking messages in order: entries by level, then conflicts."""
    numbers = questions.select(*key, "number").where("number is not null").distinct()
    named, wrong = number_lists(lists, numbers, key, ["level"])
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    claims = named.groupBy(*key, "number").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "level"))), lambda s: s["level"]).alias("levels"))
    every = numbers.join(claims, [*key, "number"], "left").withColumn("levels", F.coalesce("levels", F.array().cast("array<string>"))).withColumn("level", F.when(F.size("levels") == 1, F.get("levels", F.lit(0))))
    entry = wrong.select(*key, rank.cast("long").alias("_a"), F.col("place").cast("long").alias("_b"), F.concat(F.lit("Difficulty ("), F.initcap("level"), F.lit("): "), "message").alias("m"))
    clash = every.where(F.size("levels") > 1).select(*key, F.lit(9).cast("long").alias("_a"), F.col("number").cast("long").alias("_b"), F.concat(F.lit("Question "), "number", F.lit(" is assigned to both "), F.array_join(F.transform("levels", F.initcap), " and "), F.lit(" — remove it from one.")).alias("m"))
    errors = entry.unionByName(clash).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_a", "_b", "m"))), lambda s: s["m"]).alias("errors"))
    return every, errors


def difficulty_summary(every: DataFrame, key: list[str]) -> DataFrame:
    """key, easy, medium, hard, conflicts and unassigned (sorted numbers)."""
    return every.groupBy(*key).agg(*(F.count_if(F.col("level") == x).alias(x) for x in LEVELS), F.array_sort(F.collect_list(F.when(F.size("levels") > 1, F.col("number")))).alias("conflicts"), F.array_sort(F.collect_list(F.when(F.size("levels") == 0, F.col("number")))).alias("unassigned"))


def with_difficulty(questions: DataFrame, every: DataFrame, key: list[str]) -> DataFrame:
    """``questions`` with difficulty_level, blank where it isn't settled."""
    return questions.join(every.select(*key, "number", F.coalesce("level", F.lit("")).alias("difficulty_level")), [*key, "number"], "left").fillna("", ["difficulty_level"])


def latest_images(images: DataFrame, key: list[str]) -> DataFrame:
    """One image for each destination of a question: the one put there last (image_seq); a row of status cleared takes it away."""
    w = Window.partitionBy(*key, "number", "destination").orderBy(F.desc("image_seq"))
    return images.withColumn("_n", F.row_number().over(w)).where("_n = 1 and status <> 'cleared'").drop("_n")


def confirmed(candidates: DataFrame, seq: int, order: str = "candidate_no") -> DataFrame:
    """Accepted candidates with what the upload gave, as image rows: failed without a URL; an ambiguous destination isn't
    one. They come after all images up to ``seq``, by their own numbers in ``order``, so a repeated task numbers them alike."""
    rows = candidates.where(F.col("destination").isin(*DESTINATIONS))
    return rows.withColumn("status", F.when(F.coalesce("image_url", F.lit("")) != "", "uploaded").otherwise("failed")).withColumn("image_seq", F.lit(seq) + F.col(order).cast("long"))


def on_page(questions: DataFrame, page: int) -> DataFrame:
    return questions.where(F.col("source_page") == page)


def image_columns(images: DataFrame, key: list[str]) -> DataFrame:
    """key, number and a URL column for each of DESTINATIONS: of uploaded images with a URL."""
    good = images.where("status = 'uploaded' and coalesce(image_url, '') <> ''")
    return good.groupBy(*key, "number").agg(*(F.min_by(F.when(F.col("destination") == d, F.col("image_url")), F.when(F.col("destination") == d, F.col("image_seq"))).alias(d) for d in DESTINATIONS))


def unconfirmed(questions: DataFrame, images: DataFrame, key: list[str]) -> DataFrame:
    """Image questions without any uploaded image."""
    return questions.where("is_image").join(images.where("status = 'uploaded'").select(*key, "number"), [*key, "number"], "left_anti")


def deduplicated_uploads(artifacts: DataFrame) -> DataFrame:
    """Each artifact with the id of the one that is uploaded for its bytes (the first of equal sha256) and whether it is reused."""
    first = artifacts.groupBy("sha256").agg(F.min("artifact_id").alias("upload_id"))
    return artifacts.join(first, "sha256").withColumn("reused", F.col("artifact_id") != F.col("upload_id"))
