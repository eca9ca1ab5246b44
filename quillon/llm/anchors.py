"""Anchors: sampled places so that equal windows of tokens, wherever they stand, have the same anchor.

A window of L tokens has L - k + 1 grams of k tokens; its anchor is the gram with the smallest hash, the last of them on
ties. Equal windows have equal anchors at the same distance from their start, and neighbouring windows mostly share theirs, so about
2 in L - k + 2 places are anchors. The windows of one anchor are consecutive; the tokens they cover are its span.

``anchors`` gives a row an anchor: the gram's hash, the span's hash, hashes of the ``side`` tokens before and after the gram, document
and place. ``classes`` then finds, per gram, spans that are equal (a repeat of the whole span) and, for one representative
of each distinct span, the others with which it may share a window: those that agree on the tokens before the gram or after
it, since a window reaches ``side`` tokens beyond the gram on one side at least.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import P, checked, keyed_rows, map_arrow, materialize
from quillon.llm.tokens import slices

KEY = P + "doc"
#: Tokens that are worked on at once; longer documents are cut into segments that overlap.
CHUNK = 1 << 18
#: Rows of a file beyond which it is split over tasks, and different contexts of a file that one task holds.
HOT, MOST_CONTEXTS = 2000, 100_000
ANCHORS = "gram long, span long, sides long, doc long, at long, more binary"
CLASSES = "kind int, group long, doc long, at long, length int, first boolean"


@dataclass(frozen=True)
class Windows:
    """Windows of ``size`` tokens, grams of ``gram`` tokens; ``tokens`` cuts a text (bytes) into token hashes."""

    size: int
    gram: int
    tokens: str  # "bytes" or "words"

    @property
    def side(self) -> int:
        return -(-(self.size - self.gram) // 2)

    def __post_init__(self):
        if not 0 < self.gram < self.size < self.gram + (1 << 16):
            raise ValueError(f"windows of {self.size} tokens can't be anchored by grams of {self.gram}")


@cache
def _table(seed: int):
    import numpy as np

    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, dtype="u8")


class Powers:
    """Powers of an odd base and of its inverse modulo 2 ** 64, as far as they were needed."""

    def __init__(self, base: int):
        import numpy as np

        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, "u8")

    def get(self, n: int):
        import numpy as np

        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            for name, base in (("up", self.base), ("down", self.inverse)):
                all_ = np.full(size, base, "u8")
                all_[0] = 1
                setattr(self, name, np.multiply.accumulate(all_))
        return self.up[:n], self.down[:n]


@cache
def _powers(base: int) -> Powers:
    return Powers(base)


def mix(x, salt: int):
    """Spreads every bit of a polynomial hash."""
    import numpy as np

    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def token_hashes(text: bytes, kind: str):
    import numpy as np

    if kind == "bytes":
        return _table(7)[np.frombuffer(text, "u1")]
    from xxhash import xxh64_intdigest

    w = text.split()
    return np.fromiter(map(xxh64_intdigest, w), "u8", len(w))


def window_hashes(text: bytes, size: int):
    """A hash of the ``size`` bytes from every place of a text on (of none in the last places)."""
    import numpy as np

    h = token_hashes(text, "bytes")
    up, down = _powers(0x9E3779B97F4A7C15).get(len(h) + 1)
    sums = np.zeros(len(h) + 1, "u8")
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: max(0, len(h) - size + 1)], 71)


def chunk_anchors(hashes: list, win: Windows):
    """Arrays (document in the chunk, gram, span, sides, place, before, least) for documents given as token hashes.

    ``before`` is how far the first window of the anchor starts before it, ``least`` how far the last one does.
    """
    import numpy as np

    sizes = np.array([len(h) for h in hashes], "i8")
    flat = np.concatenate(hashes) if hashes else np.zeros(0, "u8")
    n, k, size = len(flat), win.gram, win.size
    ends = np.cumsum(sizes)
    if n < size:
        return None
    up, down = _powers(0x9E3779B97F4A7C15).get(n + 1)
    sums = np.zeros(n + 1, "u8")
    np.cumsum(flat * up[:n], out=sums[1:])

    def of(start, length, salt):
        return mix((sums[start + length] - sums[start]) * down[start], salt)

    grams = mix((sums[k:] - sums[:-k]) * down[: n - k + 1], 11)
    # hash above, place from the right below: the smallest is the least hash, the last on ties
    places = np.arange(len(grams), dtype="u8")
    low = np.uint64((1 << 31) - 1)
    least, reach, count = (grams & ~low) | (low - places), 1, size - k + 1
    while 2 * reach <= count:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < count:
        least = np.minimum(least[: len(least) - (count - reach)], least[count - reach :])
    starts = np.arange(len(least))
    inside = starts + size <= np.repeat(ends, sizes)[: len(least)]
    starts = starts[inside]
    if not len(starts):
        return None
    at = (low - (least[inside] & low)).astype("i8")
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    at, s0, s1 = at[first], starts[first], starts[last]
    doc = np.searchsorted(ends, s0, side="right")
    side = win.side
    before, least_before = at - s0, at - s1
    gram = mix(grams[at], 23)
    span = mix((sums[s1 + size] - sums[s0]) * down[s0] + (s1 - s0).astype("u8") * np.uint64(0xA24BAED4963EE407) + before.astype("u8"), 37)
    has_left, has_right = before >= side, size - k - least_before >= side
    left = np.where(has_left, of(np.where(has_left, at - side, 0), side, 41) >> np.uint64(33) | np.uint64(1), np.uint64(0))
    right = np.where(has_right, of(np.where(has_right, at + k, 0), side, 43) >> np.uint64(33) | np.uint64(1), np.uint64(0))
    place = at - (ends - sizes)[doc]
    return doc, gram, span, left << np.uint64(32) | right, place, before, least_before


def _segments(text: bytes, win: Windows):
    """(first token, token hashes) of a document, ``CHUNK`` windows at a time; neighbours share the tokens of the windows between them."""
    import numpy as np

    if win.tokens == "bytes":
        for at in range(0, max(1, len(text) - win.size + 1), CHUNK):
            yield at, token_hashes(text[at : at + CHUNK + win.size - 1], win.tokens)
        return
    parts, at = [], 0
    while at < len(text):  # words are split a piece of the text at a time
        end = at + (CHUNK << 3)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        parts.append(token_hashes(text[at:end], win.tokens))
        at = end
    all_ = np.concatenate(parts) if parts else np.zeros(0, "u8")
    for at in range(0, max(1, len(all_) - win.size + 1), CHUNK):
        yield at, all_[at : at + CHUNK + win.size - 1]


def _chunks(batches, win: Windows):
    """(keys of the chunk's segments, bytes of their documents, their anchors) for every chunk of every batch (key, text)."""
    import numpy as np

    def whole(keys, raws, firsts, hashes):
        found = chunk_anchors(hashes, win)
        if found is not None:
            doc, gram, span, sides, place, before, least = found
            found = doc, gram, span, sides, place + np.array(firsts, "i8")[doc], before, least
        return np.array(keys, "i8"), raws, found

    keys, raws, firsts, hashes, held = [], [], [], [], 0
    for batch in slices(batches):
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode()
            for first, h in _segments(raw, win):
                if len(h) < win.size:
                    continue
                if held and held + len(h) > CHUNK:
                    yield whole(keys, raws, firsts, hashes)
                    keys, raws, firsts, hashes, held = [], [], [], [], 0
                keys.append(k)
                raws.append(raw)
                firsts.append(first)
                hashes.append(h)
                held += len(h)
    if keys:
        yield whole(keys, raws, firsts, hashes)


def _once(found, win: Windows, keep):
    """Anchors that ``keep`` lets through, one a span and document; and, for those that stand again there, runs (start, length) of their other places."""
    import numpy as np

    if keep is not None:
        good = keep(found[1])
        found = [x[good] for x in found]
    doc, gram, span, _, place, _, _ = found
    order = np.lexsort((place, span, gram, doc))
    found = doc, gram, span, _, place, before, least = [x[order] for x in found]
    again = np.r_[False, (doc[1:] == doc[:-1]) & (gram[1:] == gram[:-1]) & (span[1:] == span[:-1])] if len(doc) else np.zeros(0, bool)
    more = np.full(len(doc), None, object)
    if again.any():
        start, end = place - before, place - least + win.size
        new = again & ~np.r_[False, again[:-1] & (start[1:] <= end[:-1])]  # a run begins
        owner = np.maximum.accumulate(np.where(again, 0, np.arange(len(doc))))
        at = np.flatnonzero(new)
        last = np.maximum.reduceat(np.where(again, np.arange(len(doc)), 0), at)
        runs = np.stack([start[at], end[last] - start[at]], axis=1).astype("<i8")
        own = owner[at]
        begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for i, j in zip(begins, np.r_[begins[1:], len(own)], strict=True):
            more[own[i]] = runs[i:j].tobytes()
    return [x[~again] for x in found], more[~again]


def anchors(docs: DataFrame, win: Windows, keep=None) -> DataFrame:
    """Anchors of every document (key, text); ``keep(grams)`` may tell which can repeat at all.

    ``at`` packs the place with how far the anchor's first and last windows start before it. A span that stands more than once in
    one document is one row: its earliest place, and in ``more`` the runs (start, length) that its other places cover.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for keys, _, found in _chunks(batches, win):
            if found is None:
                continue
            (doc, gram, span, sides, place, before, least), more = _once(found, win, keep)
            cols = [gram.view("i8"), span.view("i8"), sides.view("i8"), keys[doc], place << 32 | before << 16 | least]
            out = [pa.array(np.ascontiguousarray(c)) for c in cols] + [pa.array(more, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["gram", "span", "sides", "doc", "at", "more"])

    return map_arrow(docs.select(KEY, "text"), run, ANCHORS)


def contexts(docs: DataFrame, win: Windows, keep, *, bytes_: bool = True) -> DataFrame:
    """CONTEXTS of every anchor of bytes that ``keep`` lets through, filed by its gram; without bytes, the files alone."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for keys, raws, found in _chunks(batches, win):
            if found is None:
                continue
            (doc, gram, _, _, place, before, least), more = _once(found, win, keep)
            file = np.ascontiguousarray(gram.view("i8"))
            if not bytes_:
                yield pa.RecordBatch.from_arrays([pa.array(file)], names=["file"])
                continue
            start, size = place - before, before - least + win.size
            own = doc.tolist()
            cut = [raws[d][a : a + n] for d, a, n in zip(own, start.tolist(), size.tolist(), strict=True)]
            yield _rows(file, keys[doc], start, cut, size)
            has = np.flatnonzero(np.not_equal(more, None))
            if len(has):  # a run starts with the span that it repeats
                each = [np.frombuffer(more[i], "<i8").reshape(-1, 2) for i in has]
                all_, of = np.concatenate(each), np.repeat(has, [len(e) for e in each])
                cut = [raws[d][a : a + n] for d, a, n in zip(doc[of].tolist(), all_[:, 0].tolist(), size[of].tolist(), strict=True)]
                yield _rows(file[of], keys[doc[of]], all_[:, 0].copy(), cut, all_[:, 1])

    def _rows(file, doc, start, cut, reach):
        import pyarrow as pa

        cols = [pa.array(file), pa.array(doc), pa.array(start), pa.array(cut, pa.binary()), pa.array(reach.astype("i4"))]
        return pa.RecordBatch.from_arrays(cols, names=["file", "doc", "start", "context", "reach"])

    return map_arrow(docs.select(KEY, "text"), run, CONTEXTS if bytes_ else "file long")


def classes(rows: DataFrame, win: Windows) -> DataFrame:
    """Kind 0: an occurrence of a span that stands twice or more. Kind 1: a representative, filed by one side of its gram.
    Kind 2: a run (at, length) that further places of the same span in the same document cover.

    Rows of a gram are streamed in the order (span, document, place); what is held besides a batch is one row.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, side = ["kind", "group", "doc", "at", "length", "first"], win.side

        def pack(kind, group, doc, at, first, length=None):
            n = len(doc)
            length = np.zeros(n, "i4") if length is None else length
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(n, kind, "i4"), group, doc, at, length, first)], names=names)

        def runs(gram, span, doc, at, more):
            has = np.flatnonzero(np.not_equal(more, None))
            if len(has):
                each = [np.frombuffer(more[i], "<i8").reshape(-1, 2) for i in has]
                all_, of = np.concatenate(each), np.repeat(has, [len(e) for e in each])
                yield pack(2, group_of(gram[of], span[of]), doc[of], all_[:, 0] << 32 | (at[of] >> 16 & 0xFFFF) - (at[of] & 0xFFFF) + win.size, np.zeros(len(of), bool), all_[:, 1].astype("i4"))

        def group_of(gram, span):
            return mix(gram.view("u8"), 53).view("i8") ^ span

        def filed(gram, span, sides, doc, at, more):
            """Representatives under the tokens before their gram, and under those after it."""
            before, least = at >> 16 & 0xFFFF, at & 0xFFFF
            for shift, lo, hi, salt in ((32, np.maximum(least, side), before, 3), (0, least, np.minimum(before, side - 1), 5)):
                part = sides >> shift & 0xFFFFFFFF
                good = (part != 0) & (lo <= hi)
                if good.any():
                    key = mix(gram[good].view("u8") + part[good].astype("u8") * np.uint64(0x9FB21C651E98DF25), salt).view("i8")
                    yield pack(1, key, doc[good], (at >> 32 << 32 | hi << 16 | lo)[good], np.zeros(int(good.sum()), bool))

        last, waiting = None, None  # the last gram so far, and its representative while it is the only one

        def work(cols):
            nonlocal last, waiting
            gram, span, _, doc, at, more = cols
            goes_on = last is not None and gram[0] == last
            if goes_on and waiting is not None:
                yield from filed(*waiting)
            new_gram = np.r_[True, gram[1:] != gram[:-1]]
            new_span = new_gram | np.r_[True, span[1:] != span[:-1]]
            first = np.flatnonzero(new_span)
            size = np.diff(np.r_[first, len(gram)])
            many = np.repeat(size > 1, size) | np.not_equal(more, None)
            if many.any():
                yield pack(0, group_of(gram[many], span[many]), doc[many], at[many], new_span[many])
            yield from runs(gram, span, doc, at, more)
            number = (np.cumsum(new_gram) - 1)[first]
            spans = np.bincount(number)
            spans[0] += goes_on
            yield from filed(*(c[first[spans[number] > 1]] for c in cols))
            last, waiting = gram[-1], [c[first[-1:]] for c in cols] if spans[-1] == 1 else None

        held, open_span = None, None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[5] = cols[5].astype(object)
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
                held = None
            if open_span is not None and len(cols[0]):
                other = np.flatnonzero((cols[0] != open_span[0]) | (cols[1] != open_span[1]))
                n = int(other[0]) if len(other) else len(cols[0])
                if n:
                    yield pack(0, group_of(cols[0][:n], cols[1][:n]), cols[3][:n], cols[4][:n], np.zeros(n, bool))
                    yield from runs(cols[0][:n], cols[1][:n], cols[3][:n], cols[4][:n], cols[5][:n])
                    cols = [c[n:] for c in cols]
            if not len(cols[0]):
                continue
            gram, span = cols[0], cols[1]
            alone = len(gram) < 2 or gram[-1] != gram[-2] or span[-1] != span[-2]
            open_span = None if alone else (gram[-1], span[-1])
            cut = len(gram) - alone  # a span's only row so far may get company
            if cut:
                yield from work([c[:cut] for c in cols])
            held = [c[cut:] for c in cols] if alone else None
        if held is not None:
            yield from work(held)

    ordered = rows.repartition("gram").sortWithinPartitions("gram", "span", "doc", "at")
    return ordered.mapInArrow(run, CLASSES)


def candidates(found: DataFrame) -> DataFrame:
    """Representatives that share their file with another: (group, doc, at)."""
    reps = found.where("kind = 1").select("group", "doc", "at")
    return reps.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("group"))).where("n > 1").drop("n")


def keyed_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with their key, and one row a key; both read the same columns, so Spark can share their exchange."""
    rows, unique = keyed_rows(docs)
    return rows, unique.select(KEY, "text")


def repeats(unique: DataFrame, win: Windows, resolve, keep=None) -> DataFrame:
    """(group, doc, start, length, first): groups of equal token runs; every occurrence is a row, the earliest is ``first``.
    Further occurrences in the same document that overlap or touch are one row, as long as they are together.

    unique: key and text, a row a key. resolve: from sorted (group, doc, start, context) rows to such groups. The groups'
    spans that aren't first cover exactly the windows that also start earlier.
    """
    found = materialize(classes(anchors(unique, win, keep), win), "classes")
    size = win.size
    start, before, least = F.shiftright("at", 32), F.shiftright("at", 16).bitwiseAND(0xFFFF), F.col("at").bitwiseAND(0xFFFF)
    whole = found.where("kind = 0").select(
        "group", "doc", (start - before).alias("start"), (before - least + size).cast("int").alias("length"), "first"
    )
    whole = whole.unionByName(found.where("kind = 2").select("group", "doc", F.shiftright("at", 32).alias("start"), "length", "first"))
    some = materialize(candidates(found), "candidates")
    wanted = some.groupBy("doc").agg(F.collect_list(F.struct("group", "at")).alias("wanted"))
    cut = _fetch(unique.join(wanted.withColumnRenamed("doc", P + "of"), F.col(KEY) == F.col(P + "of"), "left"), win)
    part = cut.repartition("group").sortWithinPartitions("group", "doc", "start").mapInArrow(resolve, REPEATS)
    return whole.unionByName(part)


def array_repeats(unique: DataFrame, win: Windows, resolve, keep) -> DataFrame:
    """As ``repeats`` over bytes, but every occurrence is told by the bytes of its context; hashes only decide which contexts meet.

    A file of over ``HOT`` rows is dealt to about the square root of as many tasks, and what each of them keeps of it (a row a
    context) meets once more. If those are over ``MOST_CONTEXTS``, they are refiled by every single window.
    """
    hot = contexts(unique, win, keep, bytes_=False).groupBy("file").count().where(F.col("count") > HOT)
    hot = materialize(hot.select(F.col("file").alias("of"), F.ceil(F.sqrt("count")).cast("int").alias("parts")), "hot")
    filed = contexts(unique, win, keep).join(checked(hot, hot.count()), F.col("file") == F.col("of"), "left")
    salt = F.coalesce(F.pmod(F.xxhash64("doc", "start"), F.col("parts")).cast("int"), F.lit(-1))
    filed = filed.select("file", salt.alias("salt"), "doc", "start", "context", "reach", F.lit(1).alias("copies"))
    once = materialize(map_arrow(_sorted(filed), resolve, RESOLVED), "resolved")
    heads = once.where("context is not null").select(F.col("group").alias("file"), F.lit(-1).alias("salt"), "doc", "start", "context", "reach", "copies")
    vast = materialize(heads.groupBy("file").count().where(F.col("count") > MOST_CONTEXTS).select(F.col("file").alias("of")), "vast")
    heads = heads.join(checked(vast, vast.count()), F.col("file") == F.col("of"), "left")
    each = F.sequence(F.lit(0), F.length("context") - win.size)
    split = heads.where("of is not null").select("doc", "start", "context", F.explode(each).alias("i"), "copies")
    window = F.expr(f"substring(context, i + 1, {win.size})")
    split = split.select(F.xxhash64(window).alias("file"), F.lit(-1).alias("salt"), "doc", (F.col("start") + F.col("i")).alias("start"), window.alias("context"), F.lit(win.size).alias("reach"), "copies")
    heads = heads.where("of is null").drop("of").unionByName(split)
    again = map_arrow(_sorted(heads), resolve, RESOLVED)
    columns = ["group", "doc", "start", "length", "first"]
    return once.where("context is null").select(*columns).unionByName(again.select(*columns))


def _sorted(filed: DataFrame) -> DataFrame:
    return filed.repartition("file", "salt").sortWithinPartitions("file", "salt", "context", "doc", "start")


REPEATS = "group long, doc long, start long, length int, first boolean"
#: reach: bytes that the row stands for, more than its context where that repeats at once; copies: rows it stands for.
CONTEXTS = "file long, doc long, start long, context binary, reach int"
RESOLVED = "group long, doc long, start long, length int, first boolean, context binary, reach int, copies int"


def _fetch(joined: DataFrame, win: Windows) -> DataFrame:
    """The tokens that the windows of every wanted place cover."""
    import pyarrow as pa

    schema = pa.schema([("group", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("context", pa.binary())])

    def run(batches):
        out = []
        for batch in slices(batches):
            for key, text, wanted in zip(*(batch.column(c).to_pylist() for c in (KEY, "text", "wanted")), strict=True):
                if not wanted:
                    continue
                raw = (text or "").encode()
                w = raw.split() if win.tokens == "words" else None
                for x in wanted:
                    place, before, least = x["at"] >> 32, x["at"] >> 16 & 0xFFFF, x["at"] & 0xFFFF
                    start, end = place - before, place - least + win.size
                    out.append((x["group"], key, start, b" ".join(w[start:end]) if w is not None else raw[start:end]))
                    if len(out) >= 10_000:
                        yield _batch(out)
                        out = []
        if out:
            yield _batch(out)

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return joined.select(KEY, "text", "wanted").mapInArrow(run, "group long, doc long, start long, context binary")


def whole_groups(batches, most: int):
    """Lists of context rows with whole groups only, about ``most`` bytes of context each."""
    held, size, last = [], 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= most and row[0] != last:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[3])
            last = row[0]
    if held:
        yield held


def merged(spans) -> list[tuple[int, int]]:
    """Runs that the spans (start, length) cover, in order; those that touch are one."""
    out: list[tuple[int, int]] = []
    for start, length in sorted((s["start"], s["length"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + length))
        else:
            out.append((start, start + length))
    return out


SPANS = P + "spans"


def with_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``SPANS``: the occurrences in each document that aren't the first of their group."""
    spans = found.where("not first").groupBy(F.col("doc").alias(P + "of")).agg(F.collect_list(F.struct("start", "length")).alias(SPANS))
    return rows.join(spans, F.col(KEY) == F.col(P + "of"), "left").drop(P + "of")
