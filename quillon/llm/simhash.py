"""SimHash near-duplicates, searched with Golay-code fuzzy hashing.

A fingerprint is cut into three segments of 21, 21 and 22 bits. Of at most four differing bits, two of the three segments together
get at most two (pigeonhole), so each of these two differs in at most two. A segment, padded to 23 bits, is decoded with the
perfect binary Golay code: every word lies within three bits of exactly one codeword. The keys of a segment are the indices of the
codewords to which it and its one-bit neighbours decode, one to six of them. Two segments that differ in at most two bits have a word within one bit of both,
so they share a key. A fingerprint is filed under every pair of keys of every two segments; fingerprints that share a file are
compared, and none within four bits is missed.

Only distinct fingerprints are filed. A file gives the edges of a spanning forest, never all pairs. A file with over ``HOT``
members is split into blocks, and every two blocks are compared in a task of their own. Components follow from the edges.

Defined cases: a null or blank text has fingerprint zero and is linked like any other. Null ids take part; a component's id is its
smallest id that isn't null. An empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import P, checked, free_name, keyed, materialize, quoted
from quillon.llm.components import components

SHINGLE, SEED, BITS = 4, 42, 4
#: (first bit, bits) of the segments, generator polynomial of the code, its length.
SEGMENTS, GENERATOR, LENGTH = ((0, 21), (21, 21), (42, 22)), 0xC75, 23
#: Members of a file up to which one task compares it; bound of the table of larger ones for a broadcast; small groups.
HOT, BROADCAST_ROWS, SMALL = 4000, 100_000, 8
#: Internal columns: fingerprints, and the smallest key of a component; fingerprints a task files.
FP, KEEPER, FILED = P + "fp", P + "keeper", 20_000
#: Hashes that are held at once for counting bits.
CHUNK = 1 << 18


def bits(texts: list):
    """The fingerprints of texts, as signed 64-bit integers."""
    import numpy as np
    from xxhash import xxh64_intdigest

    def count(hashes, sizes):
        h = np.fromiter(hashes, "u8", len(hashes))
        n = np.array(sizes, "i8")
        out = np.zeros(len(n), "u8")
        full = n > 0
        starts = (np.cumsum(n) - n)[full]
        if len(starts):
            for b in range(64):
                ones = np.add.reduceat(((h >> np.uint64(b)) & np.uint64(1)).astype("i8"), starts)
                out[full] |= (2 * ones > n[full]).astype("u8") << np.uint64(b)
        return out.view("i8")

    hashes, sizes, done = [], [], []
    for text in texts:
        w = (text or "").encode().lower().split()
        if len(w) > SHINGLE:
            grams = map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False))
            new = [xxh64_intdigest(g, SEED) for g in grams]
        else:
            new = [xxh64_intdigest(b" ".join(w), SEED)] if w else []
        hashes += new
        sizes.append(len(new))
        if len(hashes) >= CHUNK:
            done.append(count(hashes, sizes))
            hashes, sizes = [], []
    done.append(count(hashes, sizes))
    return np.concatenate(done)


def fingerprints(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` without its text but with ``fp``, the 64 bits as a long."""
    others = [c for c in docs.columns if c != column]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bits(batch.column(column).to_pylist()), pa.int64())], names=[*others, FP])

    schema = docs.select(*map(quoted, others)).schema.add(FP, "long")
    return docs.mapInArrow(run, schema)


@cache
def golay():
    """``index(words)``: the 12-bit index of the codeword nearest to each 23-bit word."""
    from itertools import combinations

    import numpy as np

    def remainder(x: int) -> int:
        for b in range(LENGTH - 1, 10, -1):
            if x >> b & 1:
                x ^= GENERATOR << (b - 11)
        return x

    bit = [remainder(1 << b) for b in range(LENGTH)]
    low, high = np.zeros(1 << 12, "u4"), np.zeros(1 << 11, "u4")
    for b in range(12):
        low[np.arange(1 << 12) >> b & 1 == 1] ^= bit[b]
    for b in range(11):
        high[np.arange(1 << 11) >> b & 1 == 1] ^= bit[12 + b]
    leader = np.zeros(1 << 11, "u4")
    for weight in range(4):
        for places in combinations(range(LENGTH), weight):
            s = 0
            for b in places:
                s ^= bit[b]
            leader[s] = sum(1 << b for b in places)

    def index(words):
        return (words ^ leader[low[words & 0xFFF] ^ high[words >> 12]]) >> 11

    return index


def segment_keys(fps):
    """For each segment a table (fingerprint, up to six keys); -1 where there are fewer."""
    import numpy as np

    index, out = golay(), []
    for first, bits in SEGMENTS:
        u = ((fps >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype("u4")
        flips = np.array([0, *(1 << b for b in range(bits))], "u4")
        k = np.sort(index(u[:, None] ^ flips[None, :]).astype("i8"), axis=1)
        k[:, 1:][k[:, 1:] == k[:, :-1]] = -1
        k = -np.sort(-k, axis=1)
        out.append(k[:, : max(1, int((k >= 0).sum(axis=1).max(initial=1)))])
    return out


def files(fps: DataFrame) -> DataFrame:
    """(key, fp): every file of every fingerprint."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view("u8")
            for at in range(0, len(whole), 2000):
                fps = whole[at : at + 2000]
                segments = segment_keys(fps)
                for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
                    a, b = segments[i][:, :, None], segments[j][:, None, :]
                    key = np.int64(n << 24) | a << np.int64(12) | b
                    real = np.broadcast_to((a >= 0) & (b >= 0), key.shape)
                    owner = np.broadcast_to(fps.view("i8")[:, None, None], key.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(key[real]), pa.array(owner[real])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def link(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): a spanning forest of the links in every group (key, cell) of distinct fingerprints; rows come sorted by group."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def groups(key, cell, fp):
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
            size = np.diff(np.r_[first, len(key)])
            group = np.repeat(np.arange(len(first)), size)
            small = (size <= SMALL)[group]
            out = []
            for lag in range(1, SMALL):
                at = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
                if not len(at):
                    break
                at = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= bits]
                out.append((fp[at], fp[at + lag]))
            for g in np.flatnonzero(size > SMALL):
                left = fp[first[g] : first[g] + size[g]]
                while len(left):
                    todo, left = [left[0]], left[1:]
                    while todo and len(left):
                        x = todo.pop()
                        near = np.bitwise_count(left ^ x) <= bits
                        if near.any():
                            new, left = left[near], left[~near]
                            out.append((np.full(len(new), x), new))
                            todo.extend(new)
            if out:
                a, b = (np.concatenate([x[i] for x in out]).view("i8") for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held = None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            key, cell, fp = held
            if len(key):
                last = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
                cut = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
                yield from groups(key[:cut], cell[:cut], fp[:cut].view("u8")) if cut else ()
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield from groups(held[0], held[1], held[2].view("u8"))

    return rows.select("key", "cell", "fp").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges that connect all distinct fingerprints that a chain of links connects."""
    filed = files(fps)
    large = materialize(filed.groupBy("key").count().where(F.col("count") > hot), "hot")
    n = large.count()
    if n:
        parts = F.ceil(F.col("count") / hot).cast("int")
        side = F.broadcast(large) if n <= BROADCAST_ROWS else large
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        cells = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.col("parts") - 1),
                lambda j: F.least(j, F.col("own")) * F.col("parts") + F.greatest(j, F.col("own")),
            )
        )
        filed = filed.join(side.select("key", parts.alias("parts")), "key", "left").withColumn("own", own)
        filed = filed.select("key", F.explode(cells).alias("cell"), "fp")
    else:
        filed = filed.withColumn("cell", F.lit(0))
    return link(filed.repartition("key", "cell").sortWithinPartitions("key", "cell", "fp"))


def linked(distinct: DataFrame) -> DataFrame:
    """``links`` of a table of distinct fingerprints, written once."""
    parts = -(-distinct.count() // FILED)
    return materialize(links(distinct.repartition(max(1, parts), "fp")).distinct(), "links")


def document_links(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: edges that connect all documents of ``rows`` (doc, ``FP``) whose fingerprints a chain of links connects."""
    found = rows.groupBy(F.col(FP).alias("fp")).agg(F.min("doc").alias("k"), F.count(F.lit(1)).alias("members"))
    distinct = materialize(found, "distinct")
    one = distinct.select(F.col("fp").alias("a"), F.col("k").alias("x"))
    two = distinct.select(F.col("fp").alias("b"), F.col("k").alias("y"))
    between = linked(distinct).join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    several = distinct.where("members > 1").select("fp", "k")
    same = rows.join(checked(several, several.count()), rows[FP] == several["fp"]).where("doc <> k")
    return between.unionByName(same.select(F.col("k").alias("a"), F.col("doc").alias("b")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with a key, ``fp``, ``component_id`` (smallest doc_id) and ``KEEPER`` (smallest key).

    The table's own columns stay as they are; a result whose name is taken gets the prefix ``out_``.
    """
    key = P + "doc"
    others = [c for c in docs.columns if c != "text"]
    rows = materialize(fingerprints(keyed(docs).select(key, *map(quoted, others), "text")), "fingerprints")
    distinct = materialize(rows.groupBy(F.col(FP).alias("fp")).agg(F.min("doc_id").alias("id"), F.min(key).alias("k")), "distinct")
    roots = components(linked(distinct))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        distinct["fp"], "id", "k", F.coalesce("root", distinct["fp"]).alias("root")
    )
    least = named.groupBy("root").agg(F.min("id").alias("component_id"), F.min("k").alias("keeper"))
    of = named.join(least, "root").select(F.col("fp").alias(FP), F.col("component_id").alias(P + "component"), F.col("keeper").alias(KEEPER))
    out = rows.join(materialize(of, "classes"), FP)
    return out.select(
        key,
        *(F.col(quoted(c)) for c in others),
        F.col(FP).alias(free_name("fp", others)),
        F.col(P + "component").alias(free_name("component_id", others)),
        KEEPER,
    )
