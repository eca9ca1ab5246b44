"""Encoder, packing and token files against the library and their laws."""

import io
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import packing, token_files
from quillon.llm.tokens import Encoder, default_path, encoder

CHUNKS = ["the", "Foxes,", "don't", "I'LL", "12½", "a<|endoftext|>b", "naïve", "ΟΔΟΣ", "İx", "x" + chr(0x301), "中文", "😀!!", "a-b", "\x1cq", "z" + chr(0x85) + "z", "###", "end."]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(CHUNKS + [" ", "\n", "\t ", chr(0xA0), chr(0x3000)]) | st.text(max_size=6), max_size=12))
def test_encoder_equals_the_library(parts):
    text = " ".join(parts)
    enc = encoder(default_path())
    want = enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert enc.encode(text) == struct.pack(f"<{len(want)}I", *want)


def test_encoder_with_a_tiny_cache():
    enc, full = Encoder(default_path(), cached=3), encoder(default_path())
    text = " ".join(CHUNKS * 3)
    assert enc.encode(text) == full.encode(text)
    assert len(enc) <= 3 and len(enc.old) <= 3


def ids_of(text):
    return encoder(default_path()).encode(text)


def test_pack_keeps_every_piece_once(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    out = packing.pack(awkward, block=8).collect()
    want = []
    for doc_id, text in rows:
        raw = ids_of(text) + b"\0\0\0\0"
        want += [(doc_id, i // 8192, i // 4, len(raw[i : i + 8192]) // 4, zlib.crc32(raw[i : i + 8192])) for i in range(0, len(raw), 8192)]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=repr) == sorted(want, key=repr)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(awkward.where("false")).count() == 0


def test_island_reaches_the_least_number_of_bins():
    rng = random.Random(3)
    lengths = []
    for _ in range(60):  # bins of 100 that are exactly full
        a = rng.randrange(20, 60)
        b = rng.randrange(10, 90 - a)
        lengths += [a, b, 100 - a - b]
    island = packing.Island(lengths, 100, 1)
    island.start(4)
    before = len(island.people[0][1])
    island.evolve(60, 4)
    best = island.people[0][1]
    assert sorted(x for g in best for x in g) == list(range(len(lengths)))
    assert all(sum(lengths[x] for x in g) <= 100 for g in best)
    assert 60 <= len(best) <= min(before, 62)


def test_child_has_every_piece_once():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 90) for _ in range(200)]
    island = packing.Island(lengths, 100, 2)
    island.start(3)
    while len(island.people) < 2:
        island.people.append(island.people[0])
    for _ in range(10):
        child = island.child(*rng.sample(island.people, 2))
        assert sorted(x for g in child for x in g) == list(range(200))
        assert all(sum(lengths[x] for x in g) <= 100 for g in child)


class Counting(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.read_bytes += len(out)
        return out


def test_file_roundtrip_reads_only_what_is_asked(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 4000)

    class Out(io.BytesIO):
        def close(self):
            pass

    rng, out = np.random.default_rng(1), Out()
    docs = [(None if i == 0 else i, rng.integers(0, 49000, int(rng.integers(0, 600)), dtype="u4").tobytes()) for i in range(200)]
    w = token_files.Writer(out)
    for d in docs:
        w.add(*d)
    w.close()
    data = out.getvalue()
    assert list(token_files.Reader(Counting(data)).read()) == docs
    f = Counting(data)
    reader = token_files.Reader(f)
    tables = f.read_bytes
    assert list(reader.read([150, 7])) == [docs[150], docs[7]]
    assert f.read_bytes - tables < len(data) / 10
    import zstandard

    plain = zstandard.ZstdDecompressor().decompressobj
    assert plain().decompress(data)  # an ordinary reader takes the first frame
    broken = bytearray(data)
    broken[reader.frames[3][0] + 30] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.Reader(io.BytesIO(bytes(broken))).read())


def test_token_files(awkward, spark):
    manifest = token_files.write_tokens(awkward)
    out = token_files.read_tokens(manifest).collect()
    rows = awkward.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], len(ids_of(r["text"])) // 4 + 1, zlib.crc32(ids_of(r["text"]) + struct.pack("<I", 2))) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out), key=repr) == want
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ordered = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert ordered == sorted(ordered, key=lambda x: (x is not None, x or 0))
    assert {d for d, _ in token_files.read_documents(spark, manifest, [8, 9])} == {8, 9}
    assert token_files.read_tokens(token_files.write_tokens(awkward.where("false"))).count() == 0
