"""The pipeline's stages on planted rows, and the registry."""

import corpus_pipeline as cp
import pytest


@pytest.fixture(scope="module")
def planted(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    text = lambda tag, n: " ".join(f"{tag}{i * 31 % 97}x{i}" for i in range(n))
    passage, item = text("p", 60), text("item", 40)
    rows = [
        (1, text("a", 80)), (2, text("a", 80)),  # exact copies
        (3, text("b", 300)), (4, text("b", 300) + " end"),  # near copies
        (5, text("c", 50) + " " + passage), (6, text("d", 50) + " " + passage + " " + text("e", 30)),  # a shared passage
        (7, text("f", 100) + " " + item + " " + text("g", 100)),  # a benchmark item
        (8, "too short"), (9, None), (10, "again " * 200), (11, text("h", 5000)),
    ]
    docs(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3, 4, 5, 6, 7, 11)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, passage


def test_stages(spark, planted):
    folder, rows, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, folder)
        seen.append(docs)
        if name != "pack":
            assert docs.columns == columns
    ids = [sorted(r["doc_id"] for r in d.collect()) for d in seen[:4]]
    assert ids[0] == [1, 2, 3, 4, 5, 6, 7, 11]
    assert ids[1] == [1, 3, 5, 6, 7, 11]
    assert ids[2] == ids[1] and ids[3] == [1, 3, 5, 6, 11]
    texts = {r["doc_id"]: r for r in seen[2].collect()}
    assert passage in texts[5]["text"] and passage not in texts[6]["text"] and texts[6]["n_chars"] == len(texts[6]["text"])
    assert sorted({r["doc_id"] for r in seen[4].collect()}) == ids[3]


def test_run_equals_the_stages(spark, planted):
    folder, *_ = planted
    out = cp.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert {r["doc_id"] for r in out.collect()} == {1, 3, 5, 6, 11}


def test_registry_has_every_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
