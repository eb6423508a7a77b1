"""Sources of the engine. Decoding PDFs and optical recognition are outside: they deliver the page tables that are read here."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import BLANKS

_BOX = [T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")]
_PAGE = [T.StructField("doc_id", T.LongType()), T.StructField("page_number", T.IntegerType())]


def _whole(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.IntegerType()) for n in names]


#: The engine's input relations; nothing is inferred.
SCHEMAS = {
    "pages": T.StructType([*_PAGE, T.StructField("native_text", T.StringType()), T.StructField("ocr_text", T.StringType()), T.StructField("ocr_word_conf", T.DoubleType())]),
    "page_spans": T.StructType([*_PAGE, *_whole("block_no", "line_no", "span_no"), T.StructField("text", T.StringType()), *_BOX, T.StructField("size", T.DoubleType()), T.StructField("font", T.StringType())]),
    "page_words": T.StructType([*_PAGE, *_whole("word_no"), T.StructField("text", T.StringType()), *_BOX]),
    "page_segments": T.StructType([*_PAGE, *_whole("seg_no"), *_BOX]),
    "page_drawings": T.StructType([*_PAGE, *_whole("draw_no"), *_BOX]),
    "page_images": T.StructType([*_PAGE, *_whole("xref"), *_BOX]),
}


def read(spark: SparkSession, path: str, relation: str, form: str = "parquet") -> DataFrame:
    """One of SCHEMAS' relations from any format that Spark reads."""
    return spark.read.schema(SCHEMAS[relation]).format(form).load(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): files as they are, for a decoder to take over with mapInArrow."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def flat_spans(nested: DataFrame) -> DataFrame:
    """page_spans from pages with ``blocks``, an array of (lines of (spans of (text, bbox, size, font))); empty levels give no rows."""
    b = nested.select("doc_id", "page_number", F.posexplode("blocks").alias("block_no", "b"))
    line = b.select("doc_id", "page_number", "block_no", F.posexplode("b.lines").alias("line_no", "l"))
    s = line.select("doc_id", "page_number", "block_no", "line_no", F.posexplode("l.spans").alias("span_no", "s"))
    return s.select("doc_id", "page_number", "block_no", "line_no", "span_no", "s.text", *(F.get("s.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))), "s.size", "s.font")


def settings(lines: DataFrame, environment: dict[str, str] | None = None, defaults: dict[str, str] | None = None) -> dict[str, str]:
    """Settings from KEY=VALUE lines (column ``value``; comments and other lines are left out) under the environment's and over ``defaults``.

    Only a configuration file goes through here, so what comes to the driver is a few lines.
    """
    bare = F.btrim("value", F.lit(BLANKS))
    pairs = lines.select(bare.alias("v")).where("v <> '' and v not like '#%' and contains(v, '=')").select(F.btrim(F.substring_index("v", "=", 1)).alias("k"), F.btrim(F.expr("substring(v, instr(v, '=') + 1)"), F.lit(BLANKS + "\"'")).alias("x"))
    found = {r["k"]: r["x"] for r in pairs.collect()}
    env = os.environ if environment is None else environment
    names = {*found, *(defaults or {})}
    return {n: (env.get(n) or "").strip() or found.get(n) or (defaults or {}).get(n, "") for n in names}
