"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio against a trusted target.

Two multinomials over hashed words and word pairs are counted: one from every document of the corpus, one from the
trusted documents. A document's score is the mean log-ratio (target over corpus) of its words plus that of its pairs, each
order with buckets and totals of its own; a document is kept if it passes the base rules and its score reaches a fixed
threshold. Pairs alone are nearly all rare and their ratios lie around 0, so ``singles=False`` leaves junk in. Everything is DataFrame functions; the only join is
with a bounded sample of trusted ids, and what reaches each row is one array of ``BUCKETS`` weights.

Defined cases: a null or blank text has no words, fails the base rules and isn't kept; its score is null. Null
or repeated ids are scored row by row. An empty table gives no rows; without trusted documents every weight is 0, so the
base rules decide alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import P, add_columns, let, words

#: Hash buckets of both multinomials; bounds the weight array that reaches every task.
BUCKETS = 1 << 14
#: Most trusted documents that are counted: those with the smallest hash of their id.
TARGET_DOCS = 4096
#: Pseudo-count of each bucket.
SMOOTHING = 1.0
#: Documents whose mean log-ratio is below this are rejected.
THRESHOLD = -0.15
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "[#*$%&|<>]"


def pair_hashes(w: Column) -> Column:
    """XXH64 of each word and its right neighbour (of the last word alone, at the end)."""
    return let(w, lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1))))


def bucket(h: Column, count: int = BUCKETS) -> Column:
    return h.bitwiseAND(F.lit(count - 1)).cast("int")


def joined(h: Column, by: int) -> Column:
    """Hashes of runs twice as long: element i with element i + ``by``."""
    return let(h, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + by))))


def covered_words(h: Column, size: int = WINDOW) -> Column:
    """Words covered by windows whose hash occurs twice or more among ``h``, the hashes of all windows in order."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def twin(s: Column):
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return lambda x, k: same(x, k - 1) | same(x, k + 1)

    places = let(pairs, lambda s: F.array_sort(F.transform(F.filter(s, twin(s)), lambda x: x["i"])))
    return F.aggregate(
        places,
        start,
        lambda a, i: F.struct((a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )


def trusted_ids(labels: DataFrame, most: int = TARGET_DOCS) -> DataFrame:
    """A bounded sample of the ids labelled good and not toxic, the same whatever the partitions."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def weights(docs: DataFrame, trusted: DataFrame, count: int = BUCKETS, *, singles: bool = False) -> Column:
    """Scalar subquery: one array with the log-ratio of every bucket: those of pairs, and after them those of ``singles``."""
    ids = F.broadcast(trusted.select(F.col("doc_id").alias(P + "id"), F.lit(1).alias(P + "t")))
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col(P + "id"), "left")
    marked = marked.select(F.coalesce(P + "t", F.lit(0)).alias("t"), words(F.col("text")).alias("w"))
    pairs = F.slice(pair_hashes(F.col("w")), F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))
    grams = F.transform(pairs, lambda h: bucket(h, count))
    if singles:
        grams = F.concat(grams, F.transform("w", lambda x: bucket(F.xxhash64(x), count) + count))
    seen = marked.select("t", F.explode(grams).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("r"), F.sum("t").alias("t"))
    empty = docs.sparkSession.range(count * (2 if singles else 1)).select(F.col("id").cast("int").alias("b"), F.lit(0).alias("r"), F.lit(0).alias("t"))
    full = seen.unionByName(empty).groupBy("b").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    total = lambda c, own: F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0))
    pair, single = F.col("b") < count, F.col("b") >= count
    one = full.agg(
        F.sort_array(F.collect_list(F.struct("b", "r", "t"))).alias("a"),
        *(total(c, own).alias(name) for c, own, name in (("r", pair, "R"), ("t", pair, "S"), ("r", single, "R1"), ("t", single, "S1"))),
    )
    a = SMOOTHING

    def ratio(x: Column) -> Column:
        pair = x["b"] < count
        trusted, all_ = F.when(pair, F.col("S")).otherwise(F.col("S1")), F.when(pair, F.col("R")).otherwise(F.col("R1"))
        target = F.log((x["t"] + a) / (trusted + a * count))
        return F.when(trusted > 0, target - F.log((x["r"] + a) / (all_ + a * count))).otherwise(F.lit(0.0))

    return one.select(F.transform("a", ratio).alias("w")).scalar()


def score_quality(
    docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, most: int = TARGET_DOCS, singles: bool = False
) -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``llr`` (null without n-grams) and ``kept``; ``singles`` scores words beside pairs.

    The table's own columns stay as they are; a result whose name is taken gets the prefix ``out_``.
    """
    own = {c: P + c for c in ("words", "w", "h2", "h8", "sum", "n_words", "n_repeat_words", "llr", "base_failed")}
    at = {c: F.col(name) for c, name in own.items()}
    text = F.coalesce(F.col("text"), F.lit(""))
    w, h2, h8, n = at["words"], at["h2"], at["h8"], F.size(own["words"])
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    out = docs.withColumn(own["words"], words(F.col("text"))).withColumn(own["w"], weights(docs, trusted_ids(labels, most), singles=singles))
    out = out.withColumn(own["h2"], pair_hashes(w))
    last = F.greatest(n - (WINDOW - 1), F.lit(0))
    out = out.withColumn(own["h8"], F.slice(joined(joined(h2, 2), 4), F.lit(1), last))
    score = F.aggregate(F.slice(h2, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda s, h: s + F.get(at["w"], bucket(h)))
    repeated = F.when(F.size(F.array_distinct(h8)) == F.size(h8), F.lit(0)).otherwise(covered_words(h8)).cast("long")
    out = out.withColumns({own["n_words"]: n.cast("long"), own["n_repeat_words"]: repeated, own["sum"]: score})
    llr = F.when(at["n_words"] > 1, at["sum"] / (at["n_words"] - 1))
    if singles:
        one = F.aggregate(w, F.lit(0.0), lambda s, x: s + F.get(at["w"], bucket(F.xxhash64(x)) + BUCKETS))
        llr = F.when(at["n_words"] > 0, one / at["n_words"] + F.coalesce(llr, F.lit(0.0)))
    failed = (at["n_words"] < MIN_WORDS) | (100 * at["n_repeat_words"] > MAX_REPEAT_PERCENT * at["n_words"])
    out = out.withColumn(own["llr"], llr).withColumn(own["base_failed"], failed)
    results = {
        "n_words": at["n_words"],
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": at["n_repeat_words"],
        "base_failed": at["base_failed"],
        "llr": at["llr"],
        "kept": ~at["base_failed"] & F.coalesce(at["llr"] >= threshold, F.lit(False)),
    }
    return add_columns(out, results, docs.columns)
