"""What the operators share: the shared folder, reading tables, rows and their keys, and connected components without the driver."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType

from . import bloom

#: Rows of links to a file of a checkpoint; bytes of an Arrow batch of texts.
ROWS_A_FILE, BATCH_BYTES = 200_000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HELD: ContextVar[list[DataFrame] | None] = ContextVar("held", default=None)


def keep(df: DataFrame) -> DataFrame:
    """``df``, computed once. What executors lose of it is computed again from its lineage, which is short: a scan or a shuffle."""
    held = _HELD.get()
    if held is not None:
        held.append(df)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


@contextmanager
def scope() -> Iterator[None]:
    """What is kept inside goes at the end; what leaves it must be cut by then."""
    before = _HELD.set([])
    try:
        yield
    finally:
        for df in _HELD.get():
            df.unpersist()
        _HELD.reset(before)


def _folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, the folder that all machines share. A local session without one (tests) gets a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith(("local[", "local-cluster")) and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lectern-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """Writes ``df``, rows of a few numbers, to the shared checkpoint folder and reads it from there, so that lost executors
    cost nothing and the shuffles behind it can go. The rows are gathered into files of about ``rows_a_file``, however many
    tasks made them."""
    _folder(df.sparkSession)
    held = keep(df)
    out = held.coalesce(1 + held.count() // rows_a_file).checkpoint()
    held.unpersist()
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df``, rows of any size, written as Parquet under the shared checkpoint folder and read from there: as many files as
    its tasks made, cut anew by bytes when they are read, and columns that nobody asks for stay unread."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, of whose rows Python workers get some BATCH_BYTES at once, however long the texts are. The session's setting is
    lowered for that, as it counts when a plan runs; a smaller one is left alone."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(name, "64m")).lower().rstrip("b")
    size = int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]] if now[-1:] in ("k", "m", "g") else int(now)
    if not 0 < size <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return docs


def row_key() -> Column:
    """64 bits that stand for a row's doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def id_and_text(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row"))


def passing(keys: DataFrame, name: str, column: Column) -> Column:
    """Whether a row's ``column`` may be among the keys: false for most others, true for all of them."""
    send = keys.sparkSession.sparkContext.broadcast(bloom.build(keys, name))

    @F.arrow_udf("boolean")
    def within(hashes: pa.Array) -> pa.Array:
        return pa.array(bloom.within(send.value, hashes.to_numpy(zero_copy_only=False)))

    return within(column)


def _has_map(kind: DataType) -> bool:
    parts = [f.dataType for f in kind.fields] if hasattr(kind, "fields") else [kind.elementType] if hasattr(kind, "elementType") else []
    return isinstance(kind, MapType) or any(map(_has_map, parts))


def one_of_each(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``docs`` without the rows that another stands for; all columns, unchanged, whatever their names.

    members: (row, doc_id, stays), what is to become of the rows of groups; ``row`` is their row_key. Of several rows with the
    same doc_id and text that stay, the one whose values hash lowest does. Rows that aren't members stay. Only the members
    (and what a filter takes for one) are shuffled.
    """
    members = cut(members.select(F.col("row").alias("m"), F.col("doc_id").alias("i"), "stays").distinct())
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    may = passing(members.select("m"), "m", F.col("row"))
    told = whole.where(may).join(members, (F.col("row") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("i")), "left")
    pick = F.first("whole") if _has_map(docs.schema) else F.min_by("whole", F.xxhash64("whole"))
    once = told.where("stays").groupBy("row", "doc_id").agg(pick.alias("whole"))
    return whole.where(~may).select("whole.*").unionByName(told.where("stays is null").select("whole.*")).unionByName(once.select("whole.*"))


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**40))).alias("s")).first()
    return r["n"], r["s"] or 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); a component's name is its smallest node.

    Alternates the large-star and small-star steps; each is a map-side combined minimum and an equi-join that adaptive
    execution can split, so a hub with a third of all nodes is no single task. Edges never come to the driver, only a
    count and a checksum of each round. Self-links and repeated links are allowed; no links give no rows. Rounds grow with
    the logarithm of the longest path; should ``rounds`` not be enough, it raises rather than give a part.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = cut(e)
    last = _state(e)
    for _ in range(rounds):
        if not last[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = cut(small)
        now = _state(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
