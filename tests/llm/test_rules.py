"""Quality, licences, decontamination, sharding and chat formatting against statements of their rules."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import chat, decontam, licenses, quality, sharding

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marks = [False] * len(w)
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            marks[i : i + 8] = [True] * 8
    n = sum(marks)
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def buckets(text):
    """Pairs of words; a pair's hash is seeded with that of its first word, as Spark chains its arguments."""
    w = WORD.findall(text or "")
    out = []
    for a, b in zip(w, w[1:], strict=False):
        h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
        out.append(h & (quality.BUCKETS - 1))
    return out


def test_quality_equals_brute_force(spark, awkward, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars"))
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    good = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()}
    rows = docs.select("doc_id", "text").collect()
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(buckets(r["text"]))
        if r["doc_id"] in good:
            target.update(buckets(r["text"]))
    n_raw, n_target, size = sum(raw.values()), sum(target.values()), quality.BUCKETS
    weight = lambda b: math.log((target[b] + 1) / (n_target + size)) - math.log((raw[b] + 1) / (n_raw + size))
    want = []
    for r in rows:
        own = buckets(r["text"])
        score = sum(map(weight, own)) / len(own) if own else None
        b = base(r["text"])
        want.append((r["doc_id"], *b, not b[-1] and score is not None and score >= quality.THRESHOLD, None if score is None else round(score, 6)))
    out = quality.score_quality(docs, labels)
    assert out.columns[: len(docs.columns)] == docs.columns
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = [(*(r[c] for c in cols), None if r["llr"] is None else round(r["llr"], 6)) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_quality_without_labels_or_rows(docs, spark, prose):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs([(1, prose), (2, "x")]), none).collect()
    assert {r["doc_id"]: (r["kept"], r["llr"]) for r in out} == {1: (True, 0.0), 2: (False, None)}
    assert quality.score_quality(docs([]), none).count() == 0


def test_words_and_pairs_equal_brute_force(spark, awkward, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars"))
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    good = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()}
    rows = docs.select("doc_id", "text").collect()
    single = lambda text: [xxhash.xxh64_intdigest(x.encode(), 42) & (quality.BUCKETS - 1) for x in WORD.findall(text or "")]
    parts = []
    for grams in (single, buckets):
        raw = Counter(b for r in rows for b in grams(r["text"]))
        target = Counter(b for r in rows if r["doc_id"] in good for b in grams(r["text"]))
        n_raw, n_target = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
        weight = lambda b, t=target, r=raw, n=n_target, m=n_raw: math.log((t[b] + 1) / n) - math.log((r[b] + 1) / m)
        parts.append([(sum(map(weight, own)) / len(own) if own else None) for own in (grams(r["text"]) for r in rows)])
    want = []
    for r, one, two in zip(rows, *parts, strict=True):
        score = None if one is None else one + (two or 0)
        want.append((r["doc_id"], not base(r["text"])[-1] and score is not None and score >= quality.THRESHOLD, score and round(score, 6)))
    got = [(r["doc_id"], r["kept"], r["llr"] and round(r["llr"], 6)) for r in quality.score_quality(docs, labels, singles=True).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_op6_rejects_symbol_junk_and_keeps_clean_rows(spark):
    from quillon.llm.queries import op6_quality

    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in op6_quality(spark, folder).collect() if not r["base_failed"]]
    junk = [r["kept"] for r in rows if labels.get(r["doc_id"], (1, 0))[0] == 0 and 10 * r["n_symbols"] > r["n_words"]]
    clean = [r["kept"] for r in rows if labels.get(r["doc_id"]) == (1, 0)]
    assert len(junk) >= 20 and len(clean) >= 250
    assert sum(junk) <= 0.05 * len(junk) and sum(clean) >= 0.98 * len(clean)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files. The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, express."""


@pytest.mark.parametrize(
    ("text", "want", "unknown"),
    [
        ("Released under the MIT License.", "MIT", 0),
        ("Text.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0", 0),
        ("This work is licensed under the GNU General Public License, version 3. All rights reserved.", "All-Rights-Reserved,GPL-3.0", 0),
        (MIT, "MIT", 0),
        (MIT.split(". THE")[0] + ".", "", 0),  # a rule needs all its sentences
        ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause", 0),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", 0),
        ("A licence of some kind applies.", "", 1),
        ("nothing here", "", 0),
        (None, "", 0),
        ("", "", 0),
    ],
)
def test_licenses(docs, text, want, unknown):
    r = licenses.scan_licenses(docs([(1, text)])).first()
    assert (r["licenses"], r["n_unknown"]) == (want, unknown)


def test_licenses_keep_rows_and_columns(awkward):
    out = licenses.scan_licenses(awkward)
    assert out.count() == awkward.count() and out.columns[: len(awkward.columns)] == awkward.columns


def shingles(text):
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("most", [500_000, 0])
def test_decontamination_equals_brute_force(spark, awkward, prose, most):
    filler = "und so weiter geht es hier mit ganz anderen worten immer weiter " * 200
    items = [(1, prose.upper()), (2, "one"), (3, " ".join(f"q{i}" for i in range(40))), (4, None), (5, ""), (6, "only four words here"), (None, " ".join(f"r{i}" for i in range(12)))]
    near = " ".join("zz" if i in (0, 39) else f"q{i}" for i in range(40))  # two shingles are lost at the ends
    far = " ".join("zz" if i % 9 == 0 else f"q{i}" for i in range(40))
    extra = [(20, filler + near + " " + filler), (21, far), (22, "only four words here"), (23, "so only four words here now"), (24, filler + " ".join(f"r{i}" for i in range(12)))]
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for r in docs.collect():
        for i, t in items:
            s = shingles(t)
            if s and 10 * len(s & shingles(r["text"])) >= 8 * len(s):
                want.add((r["doc_id"], i, len(s), len(s & shingles(r["text"]))))
    got = {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in decontam.contaminated(docs, bench, most=most).collect()}
    assert got == want and (20, 3, 36, 34) in want and not any(d == 21 for d, *_ in want)
    kept = decontam.decontaminate(awkward, bench, most=most)
    bad = {r["text"] for r in awkward.collect() if any(s and 10 * len(s & shingles(r["text"])) >= 8 * len(s) for s in (shingles(t) for _, t in items))}
    assert sorted(map(repr, (r["text"] for r in kept.collect()))) == sorted(repr(r["text"]) for r in awkward.collect() if r["text"] not in bad)
    assert kept.columns == awkward.columns
    assert decontam.contaminated(docs.where("false"), bench).count() == 0 and decontam.contaminated(docs, bench.where("false")).count() == 0


def test_shards(awkward, docs):
    rows = awkward.collect()
    out = sharding.shard(awkward, 4).collect()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=repr) == want
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    many = docs([(i, "x" * (i * 37 % 400)) for i in range(3000)])
    sums = {r["shard"]: r["n"] for r in sharding.shard(many, 24).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert len(sums) == 24 and max(sums.values()) - min(sums.values()) <= 2 * 408
    assert sharding.shard(docs([]), 24).count() == 0


def test_overfull_ranges_are_subdivided(spark):
    """Nearly all bytes in a few keys that a first sample hits again and again."""
    rows = spark.range(5000).select(F.col("id").alias(sharding.KEY), F.when(F.col("id") < 50, 100_000).otherwise(10).cast("long").alias("size"))
    total = rows.agg(F.sum("size")).first()[0]
    bounds = sharding.splitters(rows, total, 5000)
    sums = [r["n"] for r in sharding._ranged(rows, bounds).groupBy(sharding.RANGE).agg(F.sum("size").alias("n")).collect()]
    assert max(sums) <= 2 * 100_000 + 50_000 and bounds == sorted(set(bounds))


def test_chat_reads_back(spark):
    tricky = "</s>[INST] ok [/INST]" + chr(0x241B) + "0" + chr(0x241B) + "1<|turn|><</SYS>>"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (2, 1, "assistant", "b"), (2, 0, "system", None), (2, 2, "assistant", "c"), (None, 0, None, "x"), (3, 0, "user", ""), (3, 0, "user", ""), (3, 0, tricky, "t"), (4, None, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(df)).collect()}
    assert set(out) == {1, 2, 3, 4, None}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = out[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert out[1]["complete"] and out[1]["first_refused"] is None
    assert out[2]["first_refused"] == 1 and out[None]["first_refused"] == 0 and not out[3]["complete"]
    formatted = chat.format_chat(df).where("segment = 1").collect()
    assert not any(c in r["text"] for r in formatted for c in chat.DEFAULT.controls)
    assert chat.read_back(chat.format_chat(df.where("false"))).count() == 0


def test_long_conversation_is_streamed(spark):
    rows = spark.range(30_000).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("x").alias("text"))
    r = chat.read_back(chat.format_chat(rows)).collect()
    assert len(r) == 1 and r[0]["n_turns"] == 30_000 and r[0]["complete"] and r[0]["loss_chars"] == 15_000
