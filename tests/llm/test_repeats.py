"""Byte and word repeat removal against brute force."""

import hashlib
import random

import pytest

from quillon.llm import anchors, substring, suffix
from quillon.llm.anchors import Windows, chunk_anchors, token_hashes


def brute(rows, size, cut, join):
    """Marks by the definition; rows are (key, tokens) in order, a key counts once."""
    seen, out, done = set(), [], {}
    for key, tokens in rows:
        if key not in done:
            marks = bytearray(len(tokens))
            for j in range(len(tokens) - size + 1):
                window = join(tokens[j : j + size])
                if window in seen:
                    marks[j : j + size] = b"\1" * size
                seen.add(window)
            done[key] = marks
        out.append(done[key])
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hash_of(r[1])))


def hash_of(text):
    from xxhash import xxh64_intdigest

    n = 42 if text is None else xxh64_intdigest(text.encode(), 42)
    return n - (1 << 64) if n >> 63 else n


def expected_bytes(rows, size):
    rows = order(rows)
    toks = [((i, t), (t or "").encode()) for i, t in rows]
    out = []
    for (i, _), (_, raw), marks in zip(rows, toks, brute(toks, size, None, bytes), strict=True):
        kept = bytes(c for c, m in zip(raw, marks, strict=True) if not m)
        runs = sum(1 for j in range(len(marks)) if marks[j] and (j == 0 or not marks[j - 1]))
        out.append((i, len(raw), sum(marks), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def expected_words(rows, size):
    rows = order(rows)
    toks = [((i, t), (t or "").encode().split()) for i, t in rows]
    out = []
    for (i, _), (_, w), marks in zip(rows, toks, brute(toks, size, None, lambda x: b" ".join(x)), strict=True):
        kept = b" ".join(x for x, m in zip(w, marks, strict=True) if not m)
        out.append((i, len(w), sum(marks), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def cases(seed):
    rng = random.Random(seed)
    words = ["a", "bb", "the", "Ñandú", "x" * 30, "fox"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(60) for _ in range(4)]
    rows = []
    for i in range(30):
        parts = [text(rng.randrange(0, 50)) for _ in range(3)]
        rows.append((i, (parts[0] + rng.choice(shared) + parts[1] + rng.choice(shared)[rng.randrange(40) :] + parts[2])))
    rows += [(40, "z" * 500), (41, "z" * 450 + "y"), (42, "ab" * 300), (43, "é" * 200), (44, text(400)), (45, shared[0])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_brute_force_on_dense_repeats(docs, seed):
    rows = cases(seed)
    assert collected(suffix.digests(suffix.dedup(docs(rows)))) == expected_bytes(rows, 100)
    assert collected(substring.digests(substring.dedup(docs(rows)))) == expected_words(rows, 20)


def test_awkward_rows(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert collected(suffix.digests(suffix.dedup(awkward))) == expected_bytes(rows, 100)
    assert collected(substring.digests(substring.dedup(awkward))) == expected_words(rows, 20)


def test_full_sketch_loses_nothing(docs):
    """With so few cells that every count is too high, results stay the same."""
    rows = cases(3)
    few = substring.SHARD
    assert collected(substring.digests(substring.dedup(docs(rows), cells=few))) == expected_words(rows, 20)


def test_empty_table(docs):
    assert collected(suffix.digests(suffix.dedup(docs([])))) == []
    assert collected(substring.digests(substring.dedup(docs([])))) == []


def test_groups_have_all_occurrences(docs, prose):
    text = prose * 2
    _, found = suffix.maximal_repeats(docs([(1, "A" + text + "B"), (2, "C" + text + "D"), (3, "E" + text + "F")]))
    groups = {}
    for r in found.collect():
        groups.setdefault((r["group"], r["length"]), []).append((r["doc"], r["first"]))
    assert any(sorted(d for d, _ in g) == [1, 2, 3] and sum(f for _, f in g) == 1 for g in groups.values())


def test_texts_stay_valid_and_keep_columns(docs, spark):
    rows = [(1, "é" * 200), (2, "è" * 199 + "é" * 200), (3, None)]
    out = suffix.without_repeats(suffix.dedup(docs(rows)))
    assert out.columns == docs(rows).columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[3] is None and got[2].replace("è", "").strip("é") == ""


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_equal_windows_have_equal_anchors(kind):
    rng = random.Random(5)
    win = Windows(100, 32, kind) if kind == "bytes" else Windows(20, 10, kind)
    part = bytes(rng.choice(b"abc ") for _ in range(400))
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.randrange(300))) + b" " + part + b" " + bytes(rng.choice(b"abc ") for _ in range(90)) for _ in range(5)]
    hashes = [token_hashes(t, kind) for t in texts]
    doc, gram, _, _, place, before, least = chunk_anchors(hashes, win)
    windows = {}
    tokens = [list(t) if kind == "bytes" else t.split() for t in texts]
    for d, g, p, b, e in zip(doc, gram, place, before, least, strict=True):
        for start in range(p - b, p - e + 1):
            windows.setdefault(tuple(tokens[d][start : start + win.size]), set()).add((g, p - start))
    assert all(len(v) == 1 for v in windows.values())
    assert sum(len(t) - win.size + 1 for t in tokens) >= len(windows) > 0


@pytest.mark.parametrize("size", [20, 60, 250, 400, 500])
def test_other_sizes_equal_brute_force(docs, size):
    rng, rows = random.Random(size), cases(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    rows += [(50, long[:1500] + "X" * 700), (51, "Y" + long[300:1400] + "Z" + long[:800]), (52, long[299:1401])]
    assert collected(suffix.digests(suffix.dedup(docs(rows), size))) == expected_bytes(rows, size)
    if size < 100:
        assert collected(substring.digests(substring.dedup(docs(rows), size // 2))) == expected_words(rows, size // 2)


def test_sizes_that_cannot_be_anchored(docs):
    for size in (0, 1, 1 << 17):
        with pytest.raises(ValueError):
            suffix.dedup(docs([]), size)


def test_without_the_array_nothing_is_removed(docs, monkeypatch):
    """The files alone remove nothing: what repeats is told by suffixes and their common prefixes."""
    def none(size):
        def run(batches):
            for _ in batches:
                pass
            yield from ()
        return run

    rows = [(i, PART * 3) for i in range(5)] + [(9, "start " + PART)]
    assert any(r[2] for r in collected(suffix.digests(suffix.dedup(docs(rows)))))
    monkeypatch.setattr(suffix, "resolve", none)
    assert not any(r[2] for r in collected(suffix.digests(suffix.dedup(docs(rows)))))


PART = "seven wise men watch from a hill and talk about the rain that fell on the plain while cats slept near the stove and dogs ran "


def test_every_repeated_window_has_a_group_with_every_text_it_stands_in(docs):
    rows = cases(5)[:20]
    _, found = suffix.maximal_repeats(docs(rows))
    raw, groups, copies = {i: t.encode() for i, t in rows}, {}, {}
    for r in found.collect():
        run = raw[r["doc"]][r["start"] : r["start"] + r["length"]]
        groups.setdefault(r["group"], set()).add((r["doc"], r["start"], r["length"]))
        copies.setdefault((r["group"], run), set()).add((r["doc"], r["start"]))
    for g in groups.values():  # occurrences of a group are equal bytes, but for runs that go on
        least = min(n for *_, n in g)
        assert len({raw[d][s : s + least] for d, s, _ in g}) == 1
    link, windows = {}, {}

    def root(x):
        while link.setdefault(x, x) != x:
            x = link[x]
        return x

    for g in groups.values():
        first = min(g)
        for d, s, n in g:
            for j in range(n - 99):
                a = root((d, s + j))
                b = root((first[0], first[1] + j % (first[2] - 99)))
                link[a] = b
    for i, t in raw.items():
        for j in range(len(t) - 99):
            windows.setdefault(t[j : j + 100], []).append((i, j))
    for places in windows.values():
        assert len({root(p) for p in places}) == 1  # groups and the copies of their contexts join all places of a window


def test_hot_files_are_dealt_to_many_tasks(docs, monkeypatch):
    monkeypatch.setattr(anchors, "HOT", 10)
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = [(i, noise(30) + PART + noise(30) + PART[:70] + noise(60)) for i in range(120)] + [(200 + i, PART * 2) for i in range(60)]
    assert collected(suffix.digests(suffix.dedup(docs(rows)))) == expected_bytes(rows, 100)


def test_long_texts_are_cut_into_segments(docs, monkeypatch):
    monkeypatch.setattr(anchors, "CHUNK", 300)
    rng = random.Random(6)
    long = " ".join(rng.choice(["ab", "cde", "f", "ghij"]) for _ in range(3000))
    rows = [(1, long), (2, long[777:5000] + "x" + long[100:900]), (3, "q" * 1500), *cases(7)[:10]]
    win = anchors.Windows(100, 32, "bytes")
    parts = list(anchors._segments(long.encode(), win))
    assert len(parts) > 20 and max(len(h) for _, h in parts) <= 399
    monkeypatch.undo()
    assert collected(suffix.digests(suffix.dedup(docs(rows)))) == expected_bytes(rows, 100)
    with monkeypatch.context() as m:
        m.setattr(anchors, "CHUNK", 300)
        for kind, w in (("bytes", win), ("words", anchors.Windows(20, 10, "words"))):
            data = long.encode()
            tokens = list(data) if kind == "bytes" else data.split()
            seen = set()
            import pyarrow as pa

            batch = pa.RecordBatch.from_pydict({"k": pa.array([5], pa.int64()), "t": pa.array([long])})
            for _, _, (_, _, _, _, place, before, least) in anchors._chunks([batch], w):
                for p, b, e in zip(place, before, least, strict=True):
                    seen.update(range(p - b, p - e + 1))
            assert seen == set(range(len(tokens) - w.size + 1))  # every window has an anchor


def test_memory_of_a_very_long_text():
    """20 MB of text are anchored within 300 MB."""
    import resource
    import subprocess
    import sys

    code = (
        "import pyarrow as pa, resource, random\n"
        "from quillon.llm import anchors as a\n"
        "t = ''.join(chr(97 + i * i % 26) for i in range(1000)) * 20000\n"
        "b = pa.RecordBatch.from_pydict({'k': pa.array([1], pa.int64()), 't': pa.array([t])})\n"
        "list(len(f[0]) for *_, f in a._chunks([b.slice(0, 0)], a.Windows(100, 32, 'bytes')))\n"
        "m = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "print(sum(len(f[0]) for *_, f in a._chunks([b], a.Windows(100, 32, 'bytes'))), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - m) // 1024)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 100_000 and int(out[1]) < 300 and resource


def test_names_that_clash(docs, spark):
    from pyspark.sql import functions as F

    rows = docs([(1, PART * 2), (2, PART), (2, PART), (None, PART), (None, None), (3, "")])
    names = ["spans", "wanted", "doc", "at", "fp", "kept", "n_removed", "length", "start", "text2"]
    clash = rows.withColumns({c: F.lit(c) for c in names})
    out = suffix.without_repeats(suffix.dedup(clash))
    assert out.columns == clash.columns and out.count() == 6
    assert all(tuple(r[c] for c in names) == tuple(names) for r in out.collect())
    assert collected(suffix.digests(suffix.dedup(clash))) == collected(suffix.digests(suffix.dedup(rows)))
    assert collected(substring.digests(substring.dedup(clash))) == collected(substring.digests(substring.dedup(rows)))
