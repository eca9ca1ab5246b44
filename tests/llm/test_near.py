"""Near copies by exact Jaccard similarity against all pairs, with small and large files."""

import os
import random
import time
from pathlib import Path

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import common, near, simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    """Ids that stay, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    text = dict(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and (text[a] == text[b] or (both and both / len(sets[a] | sets[b]) >= 0.8)):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(i for i in root if root[i] == i)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(25):
        w = [word() for _ in range(rng.choice([3, 12, 96, 200]))]
        texts.append(" ".join(w))
        for n in (0, 1, 2, 4):
            c = list(w)
            for i in rng.sample(range(len(c)), min(n, len(c))):
                c[i] = word()
            texts.append(" ".join(c))
    base = [word() for _ in range(120)]  # a large group, whose copies differ from one another by more than from the base
    for _ in range(60):
        c = list(base)
        for i in rng.sample(range(120), 2):
            c[i] = word()
        texts.append(" ".join(c))
    common = " ".join(word() for _ in range(30))  # a passage that unlike documents share
    texts += [common + " " + " ".join(word() for _ in range(n)) for n in (4, 5, 6, 7, 40, 60) for _ in range(8)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("small", "hot"), [(32, 2000), (4, 6)])
def test_stage_equals_all_pairs(spark, docs, monkeypatch, small, hot):
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "HOT", hot)
    rows = planted(5)
    out = cp.near_dedup(spark, docs(rows), "")
    assert sorted(r["doc_id"] for r in out.collect()) == kept(rows)


def test_two_replaced_words_in_96(spark, docs):
    w = [f"a{i}" for i in range(96)]
    c = list(w)
    c[40], c[41] = "x", "y"
    far = list(w)
    far[10], far[40], far[70] = "x", "y", "z"
    rows = [(1, " ".join(w)), (2, " ".join(c)), (3, " ".join(f"b{i}" for i in range(96))), (4, " ".join(far)), (5, None), (6, None), (7, " ")]
    out = cp.near_dedup(spark, docs(rows), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4, 5, 7]


def test_one_python_worker_a_task(spark, awkward, monkeypatch):
    """Between two Python passes lies an exchange: in one stage they would take two workers a core, which stay with what they hold."""
    plans, store = [], near.materialize

    def told(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(near, "materialize", told)
    near.losers(awkward).count()
    assert any("MapInArrow" in p for p in plans)
    for plan in plans:
        assert all("Exchange" in between for between in plan.split("MapInArrow")[1:-1])


def test_fingerprints_beside_sets(spark, awkward):
    rows = awkward.select(awkward["text"].alias("text"), awkward["n_chars"].alias("doc"))
    alone = simhash.fingerprints(rows).select("doc", simhash.FP)
    assert sorted(map(tuple, near.with_sets(rows).select("doc", simhash.FP).collect())) == sorted(map(tuple, alone.collect()))


def shuffled(spark):
    """Bytes that this session has written to shuffle files so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def on_disk(spark):
    """Bytes of shuffle files that lie on this session's disk."""
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    found = [f for d in folders for f in Path(d.getPath()).rglob("shuffle_*") if f.exists()]
    return sum(f.stat().st_size for f in found)


def test_shuffle_files_go_with_their_step(spark):
    def large(i):
        return spark.range(1_000_000).groupBy(((F.col("id") * (7 + i)) % 500_009).alias("k")).count()

    near.released(spark)
    time.sleep(1)
    before = on_disk(spark)
    for i in range(2):
        assert near.stored(large(i), "large").count() == 500_009
        path = near.gathered(spark, (large(j) for j in (i, i + 2)), "several")
        time.sleep(1)  # the cleaner has a thread of its own
        assert on_disk(spark) - before < 100_000
    assert path.count() == 1_000_018


def random_sets(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    h = [np.unique(rng.integers(0, 1 << 63, 400, dtype="u8")) for _ in range(n)]
    h[1] = h[0].copy()
    h[1][:3] += np.uint64(1)
    h[1].sort()
    return spark.createDataFrame([(i, bytearray(x.tobytes()), len(x)) for i, x in enumerate(h)], "doc long, h binary, n int")


def test_only_sets_of_likely_pairs_travel(spark):
    """Of 1,500 sets (4.8 MB), two are alike; 1,000 pairs of unlike ones would carry 3 MB besides."""
    sets = common.materialize(random_sets(spark, 1500), "sets")
    pairs = spark.createDataFrame([(0, 1), *((i, i + 1) for i in range(1, 1001))], "a long, b long")
    before = shuffled(spark)
    assert [tuple(r) for r in near.verified(pairs, sets).collect()] == [(0, 1)]
    assert shuffled(spark) - before < 1_000_000


def test_rounds_bound_what_is_shuffled(spark, monkeypatch):
    """Where all pairs are alike, nothing is ruled out: rounds keep what lies on the disk at once below the whole."""
    base = np.arange(400, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    rows = [(i, bytearray(np.sort(np.r_[base, np.uint64(i)]).tobytes()), 401) for i in range(1, 301)]
    sets = common.materialize(spark.createDataFrame(rows, "doc long, h binary, n int"), "sets")
    wanted = [(a, a + d) for a in range(1, 300) for d in (1, 7, 50) if a + d <= 300]
    monkeypatch.setattr(near, "LEAST", 1 << 10)
    monkeypatch.setattr(near, "BROADCAST_ROWS", 10)  # so that sets come class by class
    gathered, most = near.gathered, [0]

    def told(spark, steps, name):
        def each():
            at = shuffled(spark)
            for df in steps:
                yield df
                most[0], at = max(most[0], shuffled(spark) - at), shuffled(spark)

        return gathered(spark, each(), name)

    monkeypatch.setattr(near, "gathered", told)
    out = near.verified(spark.createDataFrame(wanted, "a long, b long"), sets)
    assert sorted(map(tuple, out.collect())) == wanted
    assert 0 < most[0] < 300 * 401 * 8 / 2


def test_rounds_equal_all_pairs(spark, docs, monkeypatch):
    for name, value in (("LEAST", 1 << 10), ("SHARE", 40), ("BROADCAST_ROWS", 10), ("CLASSES", 3), ("SMALL", 4), ("HOT", 6)):
        monkeypatch.setattr(near, name, value)
    rows = planted(5)
    out = cp.near_dedup(spark, docs(rows), "")
    assert sorted(r["doc_id"] for r in out.collect()) == kept(rows)


def test_counts_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(8)
    rows, sets = [], {}
    for i in range(150):
        n = int(rng.choice([1, 2, 5, 30, 300, 3000]))
        a = rng.integers(0, 1 << 64, n, dtype="u8") >> np.uint64(rng.choice([0, 0, 0, 40]))  # some crowd together: full bytes
        b = np.r_[a[: max(1, int(n * rng.uniform(0.7, 1)))], rng.integers(0, 1 << 64, int(n * rng.uniform(0, 0.2)), dtype="u8")]
        sets |= {2 * i: np.unique(a), 2 * i + 1: np.unique(b)}
    rows = [(i, bytearray(x.tobytes()), 1) for i, x in sets.items()]
    load = {r["doc"]: bytes(r["load"]) for r in near.counts(spark.createDataFrame(rows, "doc long, h binary, times long")).collect()}
    alike = [(2 * i, 2 * i + 1) for i in range(150) if near.similar(sets[2 * i].tobytes(), sets[2 * i + 1].tobytes())]
    assert 20 < len(alike) < 150
    assert all(near.likely(load[a], load[b]) and near.likely(load[b], load[a]) for a, b in alike)
    assert any(max(load[i]) == 255 for i in load)


def test_scratch_goes_with_the_stage(spark, docs):
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    cp.near_dedup(spark, docs([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x " * 30)]), "").count()
    assert [x.split("-")[-2] for x in set(os.listdir(folder)) - before if "losers" in x] == ["losers"]
    assert len(set(os.listdir(folder)) - before) == 1
