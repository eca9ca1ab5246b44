"""The grouping genetic algorithm: against the least number of bins, on planted packings, and through Spark."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import packing


def planted(seed, count=60, parts=4, capacity=100):
    """Pieces of ``count`` bins that are exactly full."""
    rng, out = random.Random(seed), []
    for _ in range(count):
        cuts = sorted(rng.sample(range(4, capacity), parts - 1))
        out += [b - a for a, b in zip([0, *cuts], [*cuts, capacity], strict=True)]
    return out


def first_fit(lengths, capacity=100):
    """Bins of best fit in falling order."""
    bins = []
    packing.best_fit(sorted(range(len(lengths)), key=lambda x: -lengths[x]), lengths, bins, [], capacity)
    return len(bins)


def optimum(lengths, capacity):
    """Least number of bins, over all subsets: (bins, fill of the last) is the least for every subset."""
    best = {0: (1, 0)}
    for mask in range(1, 1 << len(lengths)):
        best[mask] = min(
            (n, f + lengths[i]) if f + lengths[i] <= capacity else (n + 1, lengths[i])
            for i in range(len(lengths))
            if mask >> i & 1
            for n, f in [best[mask ^ 1 << i]]
        )
    return best[(1 << len(lengths)) - 1][0]


def pieces(spark, lengths):
    rows = [(i, 0, 0, n, i * 17) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sequences(out, capacity):
    """Number of sequences, after their laws were tested."""
    rows = {}
    for r in out.collect():
        rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in rows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(rows)


@pytest.mark.parametrize("seed", range(12))
def test_least_number_of_bins_on_small_inputs(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(5, 70) for _ in range(rng.randrange(1, 12))]
    island = packing.Island(lengths, 100, seed)
    island.start(5)
    island.evolve(20_000, 5)
    assert len(island.people[0][1]) == optimum(lengths, 100)


def test_evolution_beats_best_fit_through_spark(spark):
    """Best fit in falling order takes 61 bins, the planted packing 60, and so does the result."""
    for seed in (0, 4, 5):
        lengths = planted(seed)
        assert first_fit(lengths) == 61
        rows = pieces(spark, lengths)
        out = packing.pack_pieces(rows, capacity=100)
        assert out.count() == len(lengths) and sequences(out, 100) == 60
        told = packing.statistics(packing.evolve_blocks(rows, 1, 1, 100)).first()
        assert told["children"] > 0 and told["progress"] > 0 and (told["first_bins"], told["bins"]) == (61, 60)


def test_without_crossover_there_is_no_result(spark, monkeypatch):
    """The evolution, not the first best fit, yields the 60 bins."""
    monkeypatch.setattr(packing, "WORK", 0)
    monkeypatch.setattr(packing, "SEARCH", 0)
    assert sequences(packing.pack_pieces(pieces(spark, planted(0)), capacity=100), 100) == 61


def test_blocks_are_pooled(spark):
    lengths = [n for seed in range(8) for n in planted(seed)]
    out = packing.pack_pieces(pieces(spark, lengths), capacity=100, block=240)
    assert 480 <= sequences(out, 100) <= 484


def test_same_result_whatever_the_partitions(spark):
    rows = pieces(spark, planted(3) * 2)
    of = lambda df: sorted(map(tuple, packing.pack_pieces(df, capacity=100, block=200).select("doc_id", "piece", "sequence_id", "offset").collect()))
    assert of(rows) == of(rows.repartition(7))


def test_ties_repeats_and_names_that_clash(docs, spark):
    rows = docs([(1, "same words here"), (1, "same words here"), (None, "same words here"), (None, None), (2, "")])
    clash = rows.withColumns({c: F.lit("x") for c in ("piece", "start", "length", "sequence_id", "offset", "block", "island")})
    out = packing.pack(clash).collect()
    assert sorted((r["doc_id"] or 0, r["length"] > 1) for r in out) == [(0, False), (0, True), (1, True), (1, True), (2, False)]
    assert len({r["sequence_id"] for r in out}) == 1
    assert packing.pack(clash.where("false")).count() == 0
    many = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    assert sequences(packing.pack(many, block=500), packing.CAPACITY) <= 3000 * 4 // 2048 + 3


def test_effort_does_not_depend_on_the_number_of_blocks(spark):
    """A block among twelve is evolved as it is alone."""
    rng, blocks = random.Random(1), 12
    rows = pieces(spark, [rng.randrange(3, 60) for _ in range(600)])
    first = F.pmod(F.xxhash64("doc_id", "piece", F.lit(1)), F.lit(blocks)) == 0
    told = ("island", "doc_id", "population", "children", "progress", "first_bins")
    of = lambda df, n: sorted(map(tuple, packing.evolve_blocks(df, n, 1, 100).where("block = 0").select(*told).collect()))
    among, alone = of(rows, blocks), of(rows.where(first), 1)
    assert len(among) == packing.ISLANDS and among == alone
