"""Near-duplicates by exact Jaccard similarity of 5-word shingles: SimHash links first, then prefix filtering for what lies beyond.

Fingerprints within ``simhash.BITS`` bits are linked by the Golay search; each link is verified on the shingles and contracted. What is
similar but further apart is found by prefix filtering (Bayardo et al., 2007). Two sets with a Jaccard similarity of ``JACCARD`` or more
share an element among the first ``n - ceil(JACCARD * n) + 1`` of each, whatever total order all sets are sorted by. A document is filed
under each shingle of this prefix, documents of different contracted groups that share a file are compared by their shingles, and no pair
is missed. The order is (rare in a sketch of all documents, hash), so common shingles come last, which only makes files small. Copies
with equal text are one document. Shingles are compared by 64-bit hashes of their words.

Files of up to ``SMALL`` members give all their pairs. A larger file first gives a star around a member drawn by hash; verified
links are contracted, and only pairs that are still in different components follow. So a large group of copies costs about its
size, not its square; unlike documents that share nothing but common shingles do cost their pairs. Files of over ``HOT`` members are salted.

The sets are the largest thing here. So a pair is first ruled out, where this is certain, by how many hashes of either set begin with the same
bits (a byte for about four hashes); only sets of pairs that are left travel, and where these are many, round by round: documents are dealt to
classes by hash, and a round takes the pairs of two classes. What a round shuffles is about a ``SHARE``-th of all sets.

Defined cases: words are split and lowered as in ``simhash``. A text of fewer than five words is one shingle; a null or blank text has
none, and only equal texts are its copies. Null ids take part.
"""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import simhash
from quillon.llm.common import BROADCAST_ROWS, P, begun, checked, keyed_rows, map_arrow, materialize, settled
from quillon.llm.components import components

SIZE, SEED = 5, 42
#: The bound, in hundredths.
JACCARD = 80
#: Members of a file up to which all its pairs are formed at once; members up to which a file isn't split over tasks.
SMALL, HOT = 32, 2000
#: Bits of the sketch that counts shingles; words whose hashes a task holds; rows that are hashed or filed at once.
SKETCH, MOST_WORDS, SLICE = 18, 1 << 18, 500
#: What a round of verification shuffles: this part of the bytes of all sets, but this many at least. Classes for sets whose documents are too many for a broadcast.
SHARE, LEAST, CLASSES = 4, 1 << 26, 8


class WordHashes(dict):
    """Hashes of words, held for words that come again."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MOST_WORDS:
            self.clear()
        h = self[word] = xxh64_intdigest(word, SEED)
        return h


def hashes(text: str | None, held: WordHashes):
    """Distinct 64-bit hashes of the shingles, in order: polynomials of the hashes of their words, mixed."""
    import numpy as np

    w = (text or "").encode().lower().split()
    x = np.fromiter(map(held.__getitem__, w), "u8", len(w))
    k = min(len(w), SIZE)
    n = len(w) - k + 1 if k else 0
    h = x[:n].copy()
    for i in range(1, k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[i : i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def released(spark: SparkSession) -> None:
    """The shuffle files of ended steps go: Spark deletes them once the driver's JVM has collected what refers to them.

    The event that ends a query holds its plan, and the threads of listener bus and scheduler hold their last event until the next: so a query
    of one row comes after, and the bus is waited for. One that lags for ten seconds is left alone, the files go with a later step.
    """
    spark.range(0, 1, 1, 1).collect()
    sc = spark.sparkContext
    with suppress(Py4JJavaError):
        sc._jsc.sc().listenerBus().waitUntilEmpty()
    sc._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``materialize``, after which the shuffle files of the step go."""
    out = materialize(df, name)
    released(df.sparkSession)
    return out


def with_sets(texts: DataFrame) -> DataFrame:
    """(doc, h, n, fingerprint) of ``texts`` (doc, text); h: the n hashes of its shingles as little-endian bytes.

    One pass for both: two in a row would take two Python workers a core, which stay with all they hold.
    """

    def run(batches):
        import pyarrow as pa

        held = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows = part.column(1).to_pylist()
                h = [hashes(t, held).tobytes() for t in rows]
                cols = [pa.array(h, pa.binary()), pa.array([len(x) // 8 for x in h], pa.int32()), pa.array(simhash.bits(rows), pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc", "h", "n", simhash.FP])

    return map_arrow(texts.select("doc", "text"), run, f"doc long, h binary, n int, {simhash.FP} long")


def sketch(sets: DataFrame):
    """How many documents hold a shingle of each bucket; only the order of prefixes depends on it."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        seen = np.zeros(1 << SKETCH, "i8")
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                h = np.frombuffer(b"".join(batch.column(0).slice(start, SLICE).to_pylist()), "u8")
                seen += np.bincount((h & np.uint64((1 << SKETCH) - 1)).astype("i8"), minlength=1 << SKETCH)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    found = map_arrow(sets.select("h"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH, "i8")
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def files(sets: DataFrame, seen) -> DataFrame:
    """(key, doc, root, n, at): every file of every document, with the size of its set and the place of the key in its order."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                cols = []
                for doc, root, raw in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    h = np.frombuffer(raw, "u8")
                    n = len(h)
                    if not n:
                        continue
                    p = n - (JACCARD * n + 99) // 100 + 1
                    first = np.lexsort((h, seen[(h & np.uint64((1 << SKETCH) - 1)).astype("i8")]))[:p]
                    cols.append((h[first].view("i8"), np.full(p, doc, "i8"), np.full(p, root, "i8"), np.full(p, n, "i4"), np.arange(p, dtype="i4")))
                if cols:
                    arrays = [pa.array(np.concatenate(c)) for c in zip(*cols, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc", "root", "n", "at"])

    return map_arrow(sets.select("doc", "root", "h"), run, "key long, doc long, root long, n int, at int")


def may_link(n, at, m, bt):
    """Whether sets of ``n`` and ``m`` can reach the bound if the key at these places is the first that they share."""
    return F.least(n - at, m - bt) * (100 + JACCARD) >= JACCARD * (n + m)


def pairs_of(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of members of each group (key, cell) that can reach the bound and differ in ``root``."""
    a = rows.select("key", "cell", *(F.col(c).alias("a_" + c) for c in ("doc", "n", "at", "root")))
    b = rows.select("key", "cell", *(F.col(c).alias("b_" + c) for c in ("doc", "n", "at", "root")))
    both = a.join(b, ["key", "cell"]).where((F.col("a_doc") < F.col("b_doc")) & (F.col("a_root") != F.col("b_root")))
    return both.where(may_link(F.col("a_n"), F.col("a_at"), F.col("b_n"), F.col("b_at"))).select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))


def class_of(doc: str, classes: int):
    """The class that a document is dealt to."""
    return F.pmod(F.xxhash64(doc), F.lit(classes))


def gathered(spark: SparkSession, steps: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of all ``steps``, which run one after another; the shuffle files of each go before the next."""
    path = begun(spark, name)
    for df in steps:
        df.write.mode("append").parquet(path)
        schema = df.schema
        released(spark)
    return spark.read.schema(schema).parquet(path)


def members(pairs: DataFrame, sets: DataFrame, load) -> DataFrame:
    """(doc, load, times) of the documents that are in pairs, and in how many; ``load`` makes (doc, load, times) of (doc, h, n, times).

    Sets without a pair don't travel; where the others are too many for a broadcast, one class of documents travels at a time.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("times"))
    ends = stored(ends, "ends")
    rows = ends.count()
    classes = 1 if rows <= BROADCAST_ROWS else CLASSES
    few = lambda df, i: df.where(class_of("doc", classes) == i) if classes > 1 else df
    steps = (load(few(sets, i).join(checked(few(ends, i), rows), "doc")) for i in range(classes))
    return gathered(sets.sparkSession, steps, "members")


def whole(rows: DataFrame) -> DataFrame:
    """The load of ``members`` that decides: all hashes."""
    return rows.select("doc", F.col("h").alias("load"), "times")


def counts(rows: DataFrame) -> DataFrame:
    """The load of ``members`` that bounds: how many hashes begin with each run of bits, about four a run, as one byte up to 255."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part, loads = batch.slice(start, SLICE), []
                for raw in part.column(1).to_pylist():
                    h = np.frombuffer(raw, "u8")
                    bits = max(1, (len(h) // 4).bit_length())
                    n = np.bincount((h >> np.uint64(64 - bits)).astype("i8"), minlength=1 << bits)
                    loads.append(np.minimum(n, 255).astype("u1").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(loads, pa.binary()), part.column(2)], names=["doc", "load", "times"])

    return map_arrow(rows.select("doc", "h", "times"), run, "doc long, load binary, times long")


def reaches(shared: int, n: int, m: int) -> bool:
    """Whether sets of ``n`` and ``m`` that have so many elements in common reach the bound."""
    return shared > 0 and 100 * shared >= JACCARD * (n + m - shared)


def likely(one: bytes, two: bytes) -> bool:
    """Whether sets with these ``counts`` may reach the bound: they share at most the lesser count of each run. A full byte tells nothing."""
    import numpy as np

    x, y = sorted((np.frombuffer(t, "u1").astype("i8") for t in (one, two)), key=len)
    if max(x.max(), y.max()) == 255:
        return True
    return reaches(int(np.minimum(x, y.reshape(len(x), -1).sum(axis=1)).sum()), int(x.sum()), int(y.sum()))


def similar(one: bytes, two: bytes) -> bool:
    """Whether sets of these hashes reach the bound."""
    import numpy as np

    x, y = np.frombuffer(one, "u8"), np.frombuffer(two, "u8")
    return reaches(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))


def passing(pairs: DataFrame, held: DataFrame, test, most: int, name: str) -> DataFrame:
    """Those of the pairs whose two loads in ``held`` pass the test, found in rounds that shuffle about ``most`` bytes each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                rows = zip(*(batch.column(i).slice(start, SLICE).to_pylist() for i in range(4)), strict=True)
                out = [(a, b) for a, b, one, two in rows if test(one, two)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    size = F.octet_length("load").cast("long")
    own, sent = held.agg(F.sum(size), F.sum(size * F.col("times"))).first()
    k = classes(own or 0, sent or 0, most)

    def step(i: int, j: int) -> DataFrame:
        one = held.where(class_of("doc", k) == i).select(F.col("doc").alias("a"), F.col("load").alias("one"))
        two = held.where(class_of("doc", k) == j).select(F.col("doc").alias("b"), F.col("load").alias("two"))
        these = pairs.where((class_of("a", k) == i) & (class_of("b", k) == j))
        return map_arrow(these.join(two, "b").join(one, "a").select("a", "b", "one", "two"), run, "a long, b long")

    return gathered(pairs.sparkSession, (step(i, j) for i in range(k) for j in range(k)), name)


def classes(own: int, sent: int, most: int) -> int:
    """Classes of documents so that a round of two of them shuffles about ``most`` bytes: loads of all members are ``own`` bytes, those that go with pairs ``sent``."""
    k = 1
    while 2 * own * k + sent > most * k * k:
        k += 1
    return k


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs whose sets of shingles reach the bound, a stored table: what counts of hashes can't rule out is compared whole."""

    def links() -> DataFrame:
        most = max(LEAST, 8 * (sets.agg(F.sum("n").cast("long")).first()[0] or 0) // SHARE)
        found = stored(pairs.distinct(), "pairs")
        found = passing(found, members(found, sets, counts), likely, most, "likely")
        return passing(found, members(found, sets, whole), similar, most, "similar")

    return settled(links, "verified")


def rooted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with ``root``, the smallest document that the edges connect ``doc`` to."""
    roots = components(edges).select(F.col("node").alias("doc"), F.col("root").alias("least"))
    out = rows.join(checked(roots, roots.count()), "doc", "left")
    return out.withColumn("root", F.coalesce("least", "doc")).drop("least")


def salted(keys: DataFrame) -> DataFrame:
    """``keys`` (key, parts, ...), one row for each salt of a file."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def mixed_files(rows: DataFrame) -> DataFrame:
    """(key, members, parts) of the files whose members have more than one root."""
    found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("x"), F.max("root").alias("y"))
    return found.where("x <> y").select("key", "members", F.ceil(F.col("members") / HOT).cast("int").alias("parts"))


def shared_rows(filed: DataFrame) -> DataFrame:
    """The rows of files whose members have more than one root, with ``members`` and the ``salt`` of large files."""
    mixed = stored(mixed_files(filed), "mixed")
    hot = mixed.where(F.col("members") > HOT).select("key", "parts")
    salt = F.coalesce(F.pmod(F.xxhash64("doc"), F.col("parts")), F.lit(0)).cast("int")
    rows = filed.join(checked(hot, hot.count()), "key", "left").withColumn("salt", salt).drop("parts")
    return stored(rows.join(salted(mixed), ["key", "salt"]), "shared")


def near_links(rows: DataFrame) -> DataFrame:
    """Verified edges (a, b) that connect all documents of ``rows`` (doc, h, n, fingerprint) that a chain of links connects."""
    sets = rows.select("doc", "h", "n")
    known = verified(simhash.document_links(rows.select("doc", simhash.FP)), sets)
    shared = shared_rows(files(rooted(sets, known), sketch(sets)))
    small = shared.where(F.col("members") <= SMALL).withColumn("cell", F.lit(0))
    large = shared.where(F.col("members") > SMALL)
    drawn = F.min(F.struct(F.xxhash64("doc", "key").alias("h"), "doc", "root", "n", "at"))
    lead = large.groupBy("key").agg(drawn.alias("lead"), (F.max("salt") + 1).alias("parts"))
    spokes = large.join(salted(lead), ["key", "salt"]).where(F.col("root") != F.col("lead.root"))
    spokes = spokes.where(may_link(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at")))
    spokes = spokes.select(F.least("doc", "lead.doc").alias("a"), F.greatest("doc", "lead.doc").alias("b"))
    edges = known.unionByName(verified(pairs_of(small).unionByName(spokes), sets))
    if large.isEmpty():
        return edges
    rest = stored(rooted(large.drop("root"), edges), "rest")
    parts = F.ceil(F.col("members") / HOT).cast("int")
    left = mixed_files(rest).select("key", (F.ceil(F.col("members") / HOT).cast("int")).alias("parts"))
    rest = rest.join(salted(left), ["key", "salt"]).withColumn("parts", parts)
    own = F.col("salt")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, own) * F.col("parts") + F.greatest(j, own))
    return edges.unionByName(verified(pairs_of(rest.withColumn("cell", F.explode(cells))), sets))


def losers(docs: DataFrame) -> DataFrame:
    """Keys (``keyed``) of the documents of ``docs`` (doc_id, text) that a near copy with a smaller key stands for."""
    key = P + "doc"
    rows, unique = (df.select(F.col(key).alias("doc"), "text") for df in keyed_rows(docs))
    text = F.coalesce("text", F.lit(""))
    marked = stored(rows.select("doc", F.md5(text).alias("digest")), "digests")
    first = marked.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    first = stored(first, "firsts")
    copies = stored(marked.join(checked(first, first.count()), "digest").where("doc <> first").select("doc").distinct(), "copies")
    texts = unique.join(checked(copies, copies.count()), "doc", "left_anti")
    sets = stored(with_sets(texts), "sets")
    near = components(near_links(sets)).where("node <> root").select(F.col("node").alias("doc"))
    return copies.unionByName(near).distinct().withColumnRenamed("doc", key)
