"""Suffix-array dedup: maximal repeats of bytes from the common-prefix interval tree of an enhanced suffix array.

Texts are filed by anchors (see ``anchors``) so that equal windows meet: a file holds the contexts of one anchor, that is the bytes that its windows
cover, unless a merged sketch tells that the anchor stands but once. Hashes only decide who meets; what repeats is told by the array alone. Spark sorts the contexts of a file; neighbours whose common prefix is the whole
context are one suffix with several places. The different contexts enter an array: the suffixes that start a window are sorted, and the array of
common-prefix lengths with the neighbour is scanned with a stack. Every interval whose suffixes share ``size`` bytes or more is a node of the tree. A node whose suffixes are not
all preceded by the same byte can't be extended to the left; it is output as a maximal repeat with all its occurrences. A context reaches at most
``size - gram`` bytes to either side of its gram, so a longer repeat comes out as overlapping pieces, one a context, and a node at a context's left edge
counts as maximal there.

Removed is every byte of an occurrence but the earliest of its group, that is, every byte covered by a ``size``-byte string that
also starts earlier (smaller document key, or same document and earlier start).

Groups of copies are streamed, and large ones dealt to many tasks; what is held of a file is its different contexts, ``anchors.MOST_CONTEXTS`` at most. Long texts are
anchored in overlapping segments.

Defined cases: null texts are empty and lose nothing; texts shorter than ``size`` never lose a byte. Rows that agree in id
and text are one document and get the same result; null ids come first. Ties are equal bytes, so the earlier place wins. Empty tables give no rows. A table's own
columns stay as they are, whatever their names. A ``size`` that can't be anchored raises ValueError.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.anchors import KEY, SPANS, Windows, array_repeats, keyed_windows, merged, window_hashes, with_spans
from quillon.llm.common import map_arrow, quoted
from quillon.llm.substring import prefilter
from quillon.llm.tokens import slices

SIZE, GRAM = 100, 32
#: Context bytes that are held for one array (more only where one file has more), and suffixes of a part of it (more only where they share ``size`` bytes).
ARRAY_BYTES, ARRAY_SUFFIXES = 1 << 20, 1 << 18


def enhanced_suffix_array(text, starts, lengths, width: int):
    """Order of the suffixes at ``starts`` (each ``lengths`` long, ``width`` at most) and common prefixes with the one before."""
    import numpy as np

    padded = np.concatenate([text, np.zeros(width, "u1")])
    table = np.lib.stride_tricks.sliding_window_view(padded, width)[starts]
    table[np.arange(width)[None, :] >= lengths[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(table).view(f"S{width}").ravel(), kind="stable")
    sorted_ = table[order]
    differs = sorted_[1:] != sorted_[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    n = lengths[order]
    return order, np.minimum(common, np.minimum(n[1:], n[:-1]))


def interval_tree(common, size: int, left):
    """(length, first, last) of every interval of suffixes that share ``size`` bytes or more and can't be extended to the left.

    common[i]: common prefix of suffixes i and i + 1; left[i]: the byte before suffix i, below 0 at the start of a context.
    """
    import numpy as np

    deep = common >= size
    edges = np.flatnonzero(np.diff(np.r_[False, deep, False].astype("i1")))
    begins, ends = edges[::2], edges[1::2]  # runs of deep entries: suffixes begins .. ends
    two = ends - begins == 1
    b = begins[two]
    b = b[(left[b] != left[b + 1]) | (left[b] < 0)]
    yield from zip(common[b].tolist(), b.tolist(), (b + 1).tolist(), strict=True)
    for b, e in zip(begins[~two].tolist(), ends[~two].tolist(), strict=True):
        heights, before = common[b:e].tolist(), left[b : e + 1].tolist()
        stack: list[list[int]] = []  # [height, first suffix, byte before all of them or -1]
        for i in range(e - b + 1):
            h = heights[i] if i < e - b else 0
            node = [0, b + i, before[i]]
            while stack and stack[-1][0] > h:
                height, first, byte = stack.pop()
                byte = byte if byte == node[2] else -1
                if byte < 0:
                    yield height, first, b + i
                node = [0, first, byte]
            if stack and stack[-1][0] == h:
                if stack[-1][2] != node[2]:
                    stack[-1][2] = -1
            elif h >= size:
                stack.append([h, node[1], node[2]])


def maximal(heads, size: int):
    """Columns (group, doc, start, length, first) of the maximal repeats of contexts (context, doc, start): all occurrences of each.

    Suffixes that share ``size`` bytes share a hash of these, so the array is built over those only whose hash repeats, and in parts
    that no hash crosses.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    contexts = [h[0] for h in heads]
    n = np.array([len(c) for c in contexts], "i8")
    offset = np.cumsum(n) - n
    count = n - size + 1
    owner = np.repeat(np.arange(len(heads)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    joined = b"".join(contexts)
    text = np.frombuffer(joined, "u1")
    starts = offset[owner] + inside
    windows = window_hashes(joined, size)[starts]
    by_hash = np.argsort(windows, kind="stable")
    sorted_ = windows[by_hash]
    alike = sorted_[1:] == sorted_[:-1]
    shared = by_hash[np.r_[False, alike] | np.r_[alike, False]]
    if not len(shared):
        return None
    new = np.r_[True, windows[shared][1:] != windows[shared][:-1]]
    begins = np.flatnonzero(new)
    cuts = begins[np.flatnonzero(np.diff(begins // ARRAY_SUFFIXES, prepend=-1))]
    docs, firsts, out = np.array([h[1] for h in heads], "i8"), np.array([h[2] for h in heads], "i8"), []
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(shared)], strict=True):
        part = shared[lo:hi]
        at, of, place = starts[part], owner[part], inside[part]
        order, common = enhanced_suffix_array(text, at, n[of] - place, int(n[of].max()))
        left = np.where(place > 0, text[at - 1].astype("i4"), -1)[order]  # a repeat may go on to the left of a context, where another file has it
        doc, start, at = docs[of][order], (firsts[of] + place)[order], at[order]
        for length, first, last in interval_tree(common, size, left):
            d, p, a = doc[first : last + 1], start[first : last + 1], int(at[first])
            earliest = np.lexsort((p, d))[0] if last - first > 1 else int((d[1], p[1]) < (d[0], p[0]))
            flags = np.zeros(len(d), bool)
            flags[earliest] = True
            group = xxh64_intdigest(joined[a : a + length]) - (1 << 63)
            out.append((np.full(len(d), group), d, p, np.full(len(d), length, "i4"), flags))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else None


def resolve(size: int):
    """From files of contexts, sorted by (file, salt, context, doc, start), to the repeats of every file: RESOLVED rows.

    Neighbours whose common prefix is the whole context are one suffix with several places: they are told as they come, and only the
    first of them enters the file's array. Of a salted part of a file, each such suffix is handed on instead.
    """

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.int32())
        names = ["group", "doc", "start", "length", "first", "context", "reach", "copies"]

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        def found(heads):
            cols = maximal(heads, size)
            if cols is not None:
                arrays = [pa.array(c, t) for c, t in zip(cols, types[:5], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays + [pa.nulls(len(cols[0]), t) for t in types[5:]], names=names)

        out, held, held_bytes, heads = [], [], 0, []
        file = head = None  # head: [context, doc, start, reach, copies, group]

        def close_head():
            if head is None:
                return
            context, doc, start, reach, copies, group = head
            if file[1] >= 0:
                out.append((file[0], doc, start, len(context), False, context, reach, copies))
                return
            if copies > 1:
                out.append((group, doc, start, reach, True, None, None, None))
            heads.append((context, doc, start))

        for batch in slices(batches, 4096):
            for group, salt, doc, start, context, reach, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head is not None and file == (group, salt) and context == head[0]:
                    out.append((head[5], doc, start, reach, False, None, None, None))
                    head[4] += copies
                    continue
                close_head()
                if file != (group, salt):
                    if len(heads) > 1:  # one suffix alone has no neighbour
                        held += heads
                        held_bytes += sum(len(h[0]) for h in heads)
                    heads = []
                    if held_bytes >= ARRAY_BYTES:
                        yield from found(held)
                        held, held_bytes = [], 0
                file, head = (group, salt), [context, doc, start, reach, copies, xxh64_intdigest(context) - (1 << 63)]
            if out:
                yield rows(out)
                out.clear()
        close_head()
        if len(heads) > 1:
            held += heads
        if out:
            yield rows(out)
        if held:
            yield from found(held)

    return run


def maximal_repeats(docs: DataFrame, size: int = SIZE, gram: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a key, and (group, doc, start, length, first): groups of equal byte runs with their occurrences.

    Of equal contexts only the first enters a file with others, so a group of different contexts lists one place for each, and
    the group of that context lists its copies.
    """
    win = Windows(size, min(GRAM, max(1, size // 3)) if gram is None else gram, "bytes")
    rows, unique = keyed_windows(docs)
    return rows, array_repeats(unique, win, resolve(size), prefilter(unique, win))


def dedup(docs: DataFrame, size: int = SIZE, gram: int | None = None) -> DataFrame:
    """``docs`` with ``SPANS``: array of (start, length) in bytes that are removed, which may overlap; null for none."""
    rows, found = maximal_repeats(docs, size, gram)
    return with_spans(rows, found)


def digests(cut: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of documents with their spans."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            out = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, at, hashed = (text or "").encode(), 0, hashlib.sha256()
                runs = merged(spans)
                for a, b in runs:
                    hashed.update(raw[at:a])
                    at = b
                hashed.update(raw[at:])
                out.append((doc_id, len(raw), sum(b - a for a, b in runs), len(runs), hashed.hexdigest()))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    rows = cut.select(F.col("doc_id").cast("long"), "text", SPANS)
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(cut: DataFrame) -> DataFrame:
    """Documents with their removed bytes gone; a character goes if all its bytes do, so texts stay valid."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(SPANS).to_pylist(), strict=True):
                if text is None or not spans:
                    texts.append(text)
                    continue
                raw, at, kept = text.encode(), 0, []
                for a, b in merged(spans):
                    while a < b and raw[a] & 0xC0 == 0x80:  # the run starts inside a character
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    if a < b:
                        kept.append(raw[at:a])
                        at = b
                kept.append(raw[at:])
                texts.append(b"".join(kept).decode())
            names = [c for c in batch.schema.names if c != SPANS]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    columns = [quoted(c) for c in cut.columns if c not in (KEY, SPANS)]
    return map_arrow(cut.select(*columns, SPANS), run, cut.select(*columns).schema)
