"""Substring dedup over words, with a count-min prefilter.

First pass: every partition adds the anchors of its windows (see ``anchors``; equal windows have equal anchors) to a count-min
sketch of its own and emits the cells it touched; partition sketches are merged cell by cell, and a bit a cell says whether it
counted two or more. The merged sketch overestimates counts, so an anchor that repeats is always estimated repeated.
Second pass: only windows whose anchor is estimated repeated are grouped, exactly: whole spans first, and the windows of spans that
differ by their words. None is lost, however small the sketch; a full one only lets more through.

What reaches the tasks is the merged sketch, ``ROWS`` bitmaps of ``cells`` bits, sized by the input and at most ``MOST_CELLS`` bits each.

Defined cases: null texts have no words; texts shorter than the window lose nothing. Rows that agree in id and text are one
document and get the same result; null ids come first. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.anchors import KEY, SPANS, Windows, _chunks, keyed_windows, merged, mix, repeats, whole_groups, with_spans
from quillon.llm.tokens import slices

SIZE, GRAM = 20, 10
#: Rows of the sketch, text bytes a cell of a row is given, bounds of the cells of a row, cells of a shard.
ROWS, BYTES_A_CELL, LEAST_CELLS, MOST_CELLS, SHARD = 2, 8, 1 << 20, 1 << 28, 1 << 18
SALTS = (61, 67)
#: Context bytes that are grouped at once.
GROUP_BYTES = 1 << 22


def sketch(unique: DataFrame, win: Windows, cells: int):
    """The merged sketch: a row of bits for every hash, one where a cell counted two or more."""
    import numpy as np

    def touched(batches):
        """A partition's own sketch: the cells it touched once, and those it touched more often, by shard."""
        import pyarrow as pa

        own = [[] for _ in range(ROWS)]
        for _, _, found in _chunks(batches, win):
            if found is None:
                continue
            for r in range(ROWS):
                own[r].append(mix(found[1], SALTS[r]) & np.uint64(cells - 1))
        for r in range(ROWS):
            if not own[r]:
                continue
            cell, count = np.unique(np.concatenate(own[r]), return_counts=True)
            own[r] = None
            shard = (cell // SHARD).astype("i8")
            first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            for a, b in zip(first, np.r_[first[1:], len(cell)], strict=True):
                inside = (cell[a:b] % SHARD).astype("u4") | (count[a:b] > 1).astype("u4") << np.uint32(31)
                delta = np.diff(np.r_[np.uint32(0), inside & np.uint32(SHARD - 1)]).astype("<u2" if SHARD <= 1 << 16 else "<u4")
                payload = _squeeze(delta, inside >> np.uint32(31))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([r * (cells // SHARD) + int(shard[a])], pa.int64()), "payload": pa.array([payload], pa.binary())})

    def merge(batches):
        import pyarrow as pa

        current, counts = None, None

        def bits():
            return pa.RecordBatch.from_pydict({"shard": pa.array([current], pa.int64()), "bits": pa.array([np.packbits(counts > 1).tobytes()], pa.binary())})

        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != current:
                    if current is not None:
                        yield bits()
                    current, counts = shard, np.zeros(SHARD, "u1")
                place, many = _spread(payload)
                counts[place] = np.minimum(counts[place] + 1 + many, 2)
        if current is not None:
            yield bits()

    parts = unique.select(KEY, "text").mapInArrow(touched, "shard long, payload binary")
    parts = parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "shard long, bits binary")
    out = np.zeros((ROWS, cells // 8), "u1")
    for r in parts.toLocalIterator():  # at most ROWS * cells / 8 bytes in all
        row, shard = divmod(r["shard"], cells // SHARD)
        out[row, shard * SHARD // 8 : (shard + 1) * SHARD // 8] = np.frombuffer(r["bits"], "u1")
    return out


def _squeeze(delta, many) -> bytes:
    import zlib

    import numpy as np

    return len(delta).to_bytes(4, "little") + zlib.compress(delta.tobytes() + np.packbits(many.astype(bool)).tobytes(), 1)


def _spread(payload: bytes):
    import zlib

    import numpy as np

    n, raw = int.from_bytes(payload[:4], "little"), zlib.decompress(payload[4:])
    wide = 2 if SHARD <= 1 << 16 else 4
    place = np.cumsum(np.frombuffer(raw[: wide * n], f"<u{wide}").astype("i8"))
    return place, np.unpackbits(np.frombuffer(raw[wide * n :], "u1"))[:n]


def estimated_repeated(bits, cells: int):
    """``keep(grams)`` for ``anchors``: whether every row of the sketch counted two or more."""

    def keep(grams):
        import numpy as np

        table, good = bits.value, None
        for r in range(ROWS):
            cell = mix(grams, SALTS[r]) & np.uint64(cells - 1)
            hit = (table[r][(cell >> np.uint64(3)).astype("i8")] >> (np.uint64(7) - (cell & np.uint64(7))).astype("u1")) & 1 == 1
            good = hit if good is None else good & hit
        return good

    return keep


def prefilter(unique: DataFrame, win: Windows, cells: int | None = None):
    """``keep`` for anchors of these documents (key, text): those that the merged sketch counted twice or more, none of the repeated ones lost."""
    if cells is None:
        total = unique.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (total // BYTES_A_CELL).bit_length()))
    bits = unique.sparkSession.sparkContext.broadcast(sketch(unique, win, cells))  # bounded by MOST_CELLS
    return estimated_repeated(bits, cells)


def resolve(size: int):
    """From sorted (group, doc, start, context) rows to groups of equal windows, compared by their words."""

    def run(batches):
        import pyarrow as pa

        for rows in whole_groups(batches, GROUP_BYTES):
            seen: dict[tuple, list] = {}
            for group, doc, start, context in rows:
                w = context.split()
                for i in range(len(w) - size + 1):
                    seen.setdefault((group, b" ".join(w[i : i + size])), []).append((doc, start + i))
            out = []
            for number, places in enumerate(p for p in seen.values() if len(p) > 1):
                least = min(places)
                out += [(rows[0][0] ^ number, d, s, size, (d, s) == least) for d, s in places]
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
                names = ["group", "doc", "start", "length", "first"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def dedup(docs: DataFrame, size: int = SIZE, gram: int | None = None, cells: int | None = None) -> DataFrame:
    """``docs`` with ``SPANS``: array of (start, length) in words that are removed, which may overlap; null for none."""
    win = Windows(size, min(GRAM, max(1, size // 2)) if gram is None else gram, "words")
    rows, unique = keyed_windows(docs)
    return with_spans(rows, repeats(unique, win, resolve(size), prefilter(unique, win, cells)))


def digests(cut: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of documents with their spans."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            out = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w, at, kept = (text or "").encode().split(), 0, []
                for a, b in merged(spans):
                    kept += w[at:a]
                    at = b
                kept += w[at:]
                out.append((doc_id, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    rows = cut.select(F.col("doc_id").cast("long"), "text", SPANS)
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
