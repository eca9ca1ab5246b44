"""Sharding by sampled splitters: near-equal bytes, contiguous key ranges, gapless slots.

1. A size-weighted sample of keys (bounded: the rows with the largest u ** (1 / size), u drawn from a hash of the key)
   gives quantile boundaries, and records are dealt to the ranges between them.
2. Exact bytes and rows of every range are added up. A range over the limit is sampled again on its own and subdivided, until
   none is over the limit or its sample has one key only.
3. In each range, running sums in key order give every record its place in the whole order, and so its shard: the one that
   holds the middle of the record's bytes when the total is cut in equal parts. Sums stay within a range; ranges are joined by
   a table of their offsets.

Sizes of shards then differ by less than the largest record. Only keys, sizes and checksums are shuffled, never texts. What the
driver holds are samples and one row a range, both bounded by parameters.

Defined cases: a null text has 8 bytes and the checksum of no bytes. Null and repeated ids are keyed as ``keyed`` says; equal
rows are ordered by their size and checksum and then dealt any way that keeps slots gapless. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import P, keyed, materialize

SHARDS = 24
#: Least and most ranges, rows a range aims at, keys sampled for each range, most rounds of subdivision.
LEAST_RANGES, MOST_RANGES, RANGE_ROWS, SAMPLED, ROUNDS = 192, 8192, 200_000, 40, 6
KEY, RANGE = P + "doc", P + "range"


def _sample(rows: DataFrame, most: int) -> list[int]:
    """At most ``most`` keys, drawn with weights: the smallest -ln(u) / size win (Efraimidis and Spirakis)."""
    u = (F.pmod(F.xxhash64(KEY, F.lit(17)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    drawn = rows.select(KEY, (-F.log(u) / F.col("size")).alias("w")).orderBy("w", KEY).limit(most)
    return sorted({r[0] for r in drawn.collect()})


def _splitters(keys: list[int], parts: int) -> list[int]:
    """First keys of all ranges but the first: quantiles of a weighted sample."""
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _ranged(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """With the range number: how many boundaries the key reaches, by binary search over one literal array."""
    if not bounds:
        return rows.withColumn(RANGE, F.lit(0))
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    bits = F.array(*(F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))))

    def step(lo, bit):
        inside = (lo + bit <= len(bounds)) & F.coalesce(F.get(table, lo + bit - 1) <= F.col(KEY), F.lit(False))
        return F.when(inside, lo + bit).otherwise(lo)

    return rows.withColumn(RANGE, F.aggregate(bits, F.lit(0), step))


def splitters(rows: DataFrame, total: int, count: int) -> list[int]:
    """Boundaries so that no range has over twice its share, unless it is one key or ``ROUNDS`` rounds did not do."""
    parts = max(LEAST_RANGES, min(MOST_RANGES, count // RANGE_ROWS))
    limit = 2 * total / parts
    bounds = _splitters(_sample(rows, parts * SAMPLED), parts)
    for _ in range(ROUNDS):
        sums = {r[0]: r[1] for r in _ranged(rows, bounds).groupBy(RANGE).agg(F.sum("size")).collect()}
        over = {i: n for i, n in sums.items() if n > limit}
        if not over or len(bounds) >= 2 * MOST_RANGES:
            break
        ranged, new = _ranged(rows, bounds).where(F.col(RANGE).isin(*over)), set(bounds)
        keys = _sample(ranged, SAMPLED * len(over) * 4)
        for i, n in over.items():
            low = bounds[i - 1] if i else None
            high = bounds[i] if i < len(bounds) else None
            own = [k for k in keys if (low is None or k >= low) and (high is None or k < high)]
            new.update(_splitters(own, max(2, round(2 * n / limit))))
        if new == set(bounds):
            break
        bounds = sorted(new)
    return bounds


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(key, doc_id, size, text_crc32, shard, slot) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keyed(docs.select("doc_id", "text")).select(
        KEY,
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = materialize(rows, "sizes")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    bounds = splitters(rows, total, count)
    ranged = _ranged(rows, bounds)
    sums = ranged.groupBy(RANGE).agg(F.sum("size"), F.count(F.lit(1))).collect()
    table, size, row = [], 0, 0
    for i, n, c in sorted(sums):
        table.append((i, size, row))
        size, row = size + n, row + c
    spark = docs.sparkSession
    offsets = spark.createDataFrame(table, f"{RANGE} int, {P}size0 long, {P}row0 long")
    inside = Window.partitionBy(RANGE).orderBy(KEY, "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.repartitionByRange(max(1, len(table)), RANGE).withColumns(
        {P + "end": F.sum("size").over(inside), P + "row": F.count(F.lit(1)).over(inside)}
    )
    placed = placed.join(F.broadcast(offsets), RANGE)  # one row a range, bounded by MOST_RANGES
    middle = 2 * (F.col(P + "size0") + F.col(P + "end")) - F.col("size")  # twice the place of the middle
    at = F.floor(middle * F.lit(shards).cast("decimal(10,0)") / F.lit(max(1, 2 * total)).cast("decimal(20,0)")).cast("int")
    placed = placed.select(
        KEY,
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.greatest(at, F.lit(0)), F.lit(shards - 1)).alias("shard"),
        (F.col(P + "row0") + F.col(P + "row") - 1).alias(P + "row"),
    )
    placed = materialize(placed, "placed")
    first = placed.groupBy("shard").agg(F.min(P + "row").alias(P + "first"))
    out = placed.join(F.broadcast(first), "shard")  # at most one row a shard
    return out.select(KEY, "doc_id", "size", "text_crc32", "shard", (F.col(P + "row") - F.col(P + "first")).alias("slot"))
