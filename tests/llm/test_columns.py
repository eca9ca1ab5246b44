"""All ten operators and five stages on a table whose other columns are named like results and internals, and on an empty one."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import chat, common, decontam, licenses, packing, quality, sharding, simhash, substring, suffix, token_files

NAMES = """spans wanted fp kept llr n_words licenses sentence_ids doc group key cell h t w item item_id at start length first size shard slot row id k n
root node component_id keeper block island piece sequence_id offset n_removed n_tokens count base_failed context copies text_crc32""".split()
WORDS = "the quick brown fox jumps over the lazy dog while seven wise men watch from a hill and talk about rain that fell on plains "


@pytest.fixture(scope="module")
def clash(spark):
    rows = [(1, WORDS * 3), (2, WORDS + "other words follow here " * 9), (2, WORDS + "other words follow here " * 9), (2, "x"), (None, None), (None, ""), (7, "unlike all that stands " + " ".join(f"w{i * i}" for i in range(90)))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("own " + c) for c in NAMES if c not in df.columns})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "nothing that any of these documents holds at all"), (None, None)], "item_id long, text string")


def own(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.select(*NAMES).collect()), key=repr)


OPERATORS = {
    "op1": lambda d, labels, bench: decontam.decontaminate(d, bench),
    "op2": lambda d, labels, bench: packing.pack(d),
    "op3": lambda d, labels, bench: simhash.near_duplicates(d),
    "op4": lambda d, labels, bench: substring.dedup(d),
    "op5": lambda d, labels, bench: token_files.read_tokens(token_files.write_tokens(d)),
    "op6": lambda d, labels, bench: quality.score_quality(d, labels, singles=True),
    "op8": lambda d, labels, bench: sharding.shard(d, 3),
    "op9": lambda d, labels, bench: licenses.scan_licenses(d),
    "op10": lambda d, labels, bench: suffix.dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(clash, labels, bench, name):
    plain = clash.select("doc_id", "text", "lang", "source", "n_chars")
    out = OPERATORS[name](clash, labels, bench)
    want = OPERATORS[name](plain, labels, bench)
    assert out.count() == want.count() == 7
    if name not in ("op2", "op5", "op8"):  # those return no columns of the table but its id
        assert own(out) == own(clash)
        extra = [c for c in want.columns if c not in plain.columns and not c.startswith(common.P)]
        seen = [common.free_name(c, clash.columns) for c in extra]
        same = want.select("doc_id", *(F.col(a).alias(b) for a, b in zip(extra, seen, strict=True)))
        assert sorted(map(repr, out.select("doc_id", *seen).collect())) == sorted(map(repr, same.collect()))
    assert OPERATORS[name](clash.where("false"), labels, bench).count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, clash, labels, bench, stage, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    function = dict(corpus_pipeline.STAGES)[stage]
    out = function(spark, clash, str(tmp_path))
    plain = function(spark, clash.select("doc_id", "text", "lang", "source", "n_chars"), str(tmp_path))
    assert out.count() == plain.count() > 0
    if stage != "pack":
        assert out.columns == clash.columns
        assert all(tuple(r[c] for c in NAMES) == own(clash)[0] for r in out.collect())
        assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, plain.select("doc_id", "text").collect()))
    assert function(spark, clash.where("false"), str(tmp_path)).count() == 0


def test_chat(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    clash = rows.withColumns({c: F.lit("own") for c in ("segment", "n", "loss", "part", "complete", "formatted", *NAMES)})
    assert chat.read_back(chat.format_chat(clash)).collect() == chat.read_back(chat.format_chat(rows)).collect()
    assert chat.read_back(chat.format_chat(clash.where("false"))).count() == 0


def test_ranks_order_repeated_and_null_ids(docs):
    """Keys without Python rows: nulls first, then ids, then texts; equal rows share one."""
    rows = docs([(3, "a"), (None, "b"), (3, "a"), (None, None), (2, "c"), (3, "d"), (None, "")])
    out = [(r["doc_id"], r["text"], r[common.P + "doc"]) for r in common.keyed(rows).collect()]
    assert len(out) == 7 and {k for *_, k in out} == set(range(6))
    assert [i for i, _, _ in sorted(out, key=lambda r: r[2])] == [None, None, None, 2, 3, 3, 3]
    assert len({k for i, t, k in out if (i, t) == (3, "a")}) == 1


def test_scratch_is_our_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    (tmp_path / "quillon-other").mkdir()
    common.materialize(spark.range(3), "mine")
    assert len(list(tmp_path.iterdir())) == 2
    common.drop_scratch(spark)
    assert [p.name for p in tmp_path.iterdir()] == ["quillon-other"]
