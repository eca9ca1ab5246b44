"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number of distinct five-word shingles (powers of two). An item's sketch is its k smallest
shingle hashes, with k = floor(0.2 u) + 1 for the upper size u of its partition. A document that holds at least 0.8 of an
item's n <= u shingles misses at most floor(0.2 n) < k of them, so it holds one from the sketch: no match is lost. The
document side isn't sketched, since a sketch of a long document forgets short passages. Every document shingle probes the
sketches; pairs found are verified on the shingles themselves.

Words are lower-cased runs of letters and digits. An item or document with fewer than five words has one shingle, its
whole sequence; without words it has none and never matches. Null texts have no words. Rows that agree in doc_id and text
are one document; rows with a null item_id are still searched for. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_ROWS, P, checked, keyed, let, materialize, quoted
from quillon.llm.quality import joined, pair_hashes

SHINGLE, THRESHOLD_TENTHS = 5, 8


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(w: Column) -> Column:
    """Hash of each five-word shingle; of the whole sequence if shorter."""

    def fives(w: Column) -> Column:
        four = joined(pair_hashes(w), 2)
        five = let(four, lambda f: F.transform(f, lambda x, i: F.xxhash64(x, F.get(w, i + (SHINGLE - 1)))))
        return F.slice(five, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.least(F.size(w), F.lit(1))))

    return let(w, fives)


def shingles(w: Column) -> Column:
    """Distinct shingles as strings."""
    cut = lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))),
        lambda i: F.array_join(F.slice(w, i, SHINGLE), " "),
    )
    return let(w, lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(cut(w))))


def item_sketches(items: DataFrame) -> DataFrame:
    """(item, n, h): the sketch of every item, one row a hash."""
    sized = items.select(P + "item", F.array_distinct(shingle_hashes(F.col(P + "w"))).alias("hs")).withColumn("n", F.size("hs"))
    upper = F.pow(F.lit(2), F.floor(F.log2(F.greatest("n", F.lit(1)))) + 1).cast("int") - 1
    keep = F.floor(upper * (10 - THRESHOLD_TENTHS) / 10).cast("int") + 1
    return sized.where("n > 0").select(P + "item", F.explode(F.slice(F.array_sort("hs"), F.lit(1), keep)).alias("h"))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, most: int = BROADCAST_ROWS) -> DataFrame:
    """(key, doc_id, item_id, n_shingles, n_shared): every document and item with containment 0.8 or more."""
    key, item = P + "doc", P + "item"
    rows = keyed(docs.select("doc_id", "text"))
    items = benchmark.select("item_id", "text").distinct().withColumn(item, F.xxhash64("item_id", "text"))
    items = materialize(items.withColumn(P + "w", plain_words(F.col("text"))).drop("text"), "items")
    sketches = item_sketches(items)
    probes = rows.select(key, F.explode(shingle_hashes(plain_words(F.col("text")))).alias("h"))
    n_keys = sketches.count()
    found = probes.join(checked(sketches, n_keys, most), "h").select(key, item).distinct()
    pairs = materialize(found, "pairs")
    n_pairs = pairs.count()
    full = items.select(item, "item_id", shingles(F.col(P + "w")).alias("a"))
    wide = rows.join(checked(pairs, n_pairs, most), key).join(checked(full, n_keys, most), item)
    wide = wide.withColumn("b", shingles(plain_words(F.col("text")))).select(
        F.col(key),
        "doc_id",
        "item_id",
        F.size("a").cast("long").alias("n_shingles"),
        F.size(F.array_intersect("a", "b")).cast("long").alias("n_shared"),
    )
    return wide.where(F.col("n_shared") * 10 >= F.col("n_shingles") * THRESHOLD_TENTHS).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, most: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    bad = materialize(contaminated(docs, benchmark, most=most).select(P + "doc").distinct(), "leaks")
    return keyed(docs).join(checked(bad, bad.count(), most), P + "doc", "left_anti").select(*map(quoted, docs.columns))


def oracle() -> str:
    """Brute force as SQL: distinct shingles of every document and item, counted where they agree."""

    def side(name: str, key: str) -> str:
        return f"""{name}_w AS (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {name}),
{name}_s AS (SELECT {key}, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END)) AS s FROM {name}_w)"""

    return f"""WITH {side("documents", "doc_id")},
{side("benchmark", "item_id")},
sizes AS (SELECT item_id, count(*) AS n_shingles FROM benchmark_s GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared
FROM documents_s JOIN benchmark_s USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) * 10 >= n_shingles * 8"""
