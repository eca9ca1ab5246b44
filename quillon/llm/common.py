"""What the corpus operators share: word columns, document keys, scratch tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[ \t\n\x0B\f\r]+"
#: Internal columns start with this, so that a table's own columns never clash.
P = "__q_"

#: Rows of sketch keys, item shingles or pairs up to which a side is broadcast (about 24 bytes a row); beyond, Spark shuffles.
BROADCAST_ROWS = 500_000


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text: runs without ASCII white space. A null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def free_name(name: str, taken) -> str:
    """``name``, with ``out_`` before it as often as a table's own columns demand; Spark compares names without case."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = "out_" + name
    return name


def add_columns(df: DataFrame, results: dict[str, Column], own: list[str]) -> DataFrame:
    """The table's ``own`` columns as they are, then the results; a result whose name is taken goes by ``free_name``."""
    return df.select(*(df[quoted(c)] for c in own), *(c.alias(free_name(n, own)) for n, c in results.items()))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets one of its own; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if spark not in _OWN:
        _OWN[spark] = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return _OWN[spark]


_OWN: dict[SparkSession, str] = {}


def scratch_prefix(spark: SparkSession) -> str:
    """What the paths of this application's scratch tables begin with."""
    return f"{shared_dir(spark)}/quillon-{spark.sparkContext.applicationId}-"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_prefix(spark)}{name}-{uuid.uuid4().hex}"


#: Paths of the scratch tables that the step under way has begun, where ``settled`` asks for them.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def begun(spark: SparkSession, name: str) -> str:
    """The path of a new scratch table."""
    path, made = scratch_path(spark, name), _MADE.get()
    if made is not None:
        made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = begun(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """``materialize`` of what ``build`` returns, after which the scratch tables go that ``build`` has written."""
    made: list[str] = []
    mark = _MADE.set(made)
    try:
        df = build()
    finally:
        _MADE.reset(mark)
    out = materialize(df, name)
    for path in made:
        delete(df.sparkSession, path)
    return out


def delete(spark: SparkSession, pattern: str) -> None:
    """Delete the files and folders that ``pattern`` matches."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(path) or []:
        fs.delete(found.getPath(), True)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow``; after its last batch a worker returns freed memory to the system, since it stays idle beside the executor."""

    def returning(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone
        if trim:
            trim(0)

    return df.mapInArrow(returning, schema)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it when no lazy result still reads them."""
    delete(spark, scratch_prefix(spark) + "*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only for a side whose size was counted and is within the bound."""
    return F.broadcast(df) if rows <= most else df


def plain_ids(docs: DataFrame) -> bool:
    """Whether every row has a ``doc_id`` of its own."""
    odd = docs.groupBy("doc_id").count().agg(F.max("count").alias("most"), F.max(F.col("doc_id").isNull()).alias("null")).first()
    return odd["most"] is None or (odd["most"] == 1 and not odd["null"])


def keyed(docs: DataFrame, key: str = P + "doc") -> DataFrame:
    """``docs`` with a long ``key`` that orders distinct documents and is never null."""
    return keyed_rows(docs, key)[0]


def keyed_rows(docs: DataFrame, key: str = P + "doc") -> tuple[DataFrame, DataFrame]:
    """``docs`` with a long ``key`` that orders distinct documents and is never null; and one row for each key.

    Where ``doc_id`` is unique and never null, it is the key. Else keys are ranks over (doc_id with nulls first,
    XXH64 and MD5 of the text): rows that agree in all of them are one document and share a key.
    """
    if plain_ids(docs):
        out = docs.withColumn(key, F.col("doc_id").cast("long"))
        return out, out
    tie, text = [P + "tie", P + "md5"], F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn(tie[0], F.xxhash64("text")).withColumn(tie[1], F.concat(F.md5(text), F.isnull("text").cast("string")))
    distinct = marked.select(F.col("doc_id").alias(P + "id"), *tie).distinct()
    ranks = ranked(distinct, [F.col(P + "id").asc_nulls_first(), *map(F.col, tie)], key)
    on = marked["doc_id"].eqNullSafe(ranks[P + "id"]) & (marked[tie[0]] == ranks[tie[0]]) & (marked[tie[1]] == ranks[tie[1]])
    out = marked.join(ranks, on).select(*(marked[quoted(c)] for c in docs.columns), ranks[key])
    return out, out.dropDuplicates([key])


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their places from 0 in this order: places inside ranges of the order, and what stands in the ranges before."""
    part, inside = P + "part", P + "inside"
    apart = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    apart = apart.withColumn(part, F.spark_partition_id()).withColumn(inside, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    apart = materialize(apart, "ranks")
    sizes = apart.groupBy(part).count()
    before = F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = sizes.select(part, F.coalesce(before, F.lit(0)).alias(P + "start"))
    return apart.join(F.broadcast(starts), part).select(*rows.columns, (F.col(inside) + F.col(P + "start")).alias(name))
