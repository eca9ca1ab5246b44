"""SimHash: fingerprints, the code's promise, components against brute force, hot files."""

import random

import numpy as np
import pytest
import xxhash

from quillon.llm import simhash
from quillon.llm.components import components


def fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def classes(points, bits=4):
    """Component number of every fingerprint, by comparing all pairs."""
    fps = np.array(points, "u8")
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= bits) + i + 1:
            root[find(int(j))] = find(i)
    return [find(i) for i in range(len(fps))]


def test_segments_within_two_bits_share_a_key():
    rng = np.random.default_rng(1)
    u = rng.integers(0, 1 << 64, 3000, dtype="u8")
    v = u.copy()
    for first, bits in simhash.SEGMENTS:
        for _ in range(2):
            v ^= np.uint64(1) << (rng.integers(0, bits, len(u)).astype("u8") + np.uint64(first))
    for a, b in zip(simhash.segment_keys(u), simhash.segment_keys(v), strict=True):
        assert a.shape[1] <= 6
        shared = (a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]
        assert shared.any(axis=(1, 2)).all()


def planted(seed, n=300):
    """Random fingerprints, chains of near ones, and a dense ball."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for start in list(out[:20]):
        x = start
        for _ in range(5):
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])):
                x ^= 1 << b
            out.append(x)
    centre = rng.getrandbits(64)
    out += [centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    return sorted(set(out))


@pytest.mark.parametrize("hot", [4000, 12])
def test_links_connect_what_all_pairs_connect(spark, hot):
    points = planted(7)
    df = spark.createDataFrame([(int(np.uint64(p).view("i8")),) for p in points], "fp long")
    edges = simhash.links(df, hot=hot).distinct()
    at = {int(np.uint64(p).view("i8")): i for i, p in enumerate(points)}
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    rows = edges.collect()
    for a, b in rows:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 4
        root[find(at[b])] = find(at[a])
    want = classes(points)
    group = lambda c: {frozenset(i for i, x in enumerate(c) if x == k) for k in set(c)}
    assert group([find(i) for i in range(len(points))]) == group(want)


def test_awkward_rows(awkward):
    out = simhash.near_duplicates(awkward.select("doc_id", "text")).collect()
    rows = awkward.collect()
    assert len(out) == len(rows)
    prints = sorted({fingerprint(r["text"]) for r in rows})
    class_of = dict(zip(prints, classes(prints), strict=True))
    ids = {}
    for r in rows:
        ids.setdefault(class_of[fingerprint(r["text"])], []).append(r["doc_id"])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    got = sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in out), key=repr)
    assert got == sorted(((r["doc_id"], fingerprint(r["text"]), least[class_of[fingerprint(r["text"])]]) for r in rows), key=repr)


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([]).select("doc_id", "text")).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 141)} | {i: 500 for i in range(501, 560)}
