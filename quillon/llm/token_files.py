"""Token-id files: independent zstandard frames, a checksum a frame, and a trailing seek table.

A file is a run of zstandard frames, each holding the ids (little-endian unsigned 32-bit) of some consecutive documents, then two
skippable frames: the document index and the seek table. The seek table is the public "seekable" layout: an entry a frame with
its compressed size, its decompressed size and the low 32 bits of the XXH64 of its content; then the number of frames, a
descriptor byte (checksums present) and the magic number. The index has an entry a document: id, null flag, frame, first id in
the frame, number of ids. A reader takes the two tables from the end of the file and decompresses only the frames it needs.

Documents are range-partitioned and sorted by key, so files hold ascending runs. A task writes under names of its own and
reports them when it ends; a task that is lost or run twice leaves files that nobody lists. The manifest (a row a file) gives
every file the number of ids before it.

Defined cases: a null or empty text has its end id only. Null ids come first; rows that agree in id and text follow each other.
An empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import P, keyed, scratch_path
from quillon.llm.tokens import default_path, encoder, slices

END_ID = 2
#: Raw bytes at which a frame ends, compressed bytes at which a file ends, zstandard level.
FRAME_BYTES, FILE_BYTES, LEVEL = 1 << 18, 1 << 28, 3
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ENTRY, DOC = struct.Struct("<III"), struct.Struct("<qBIII")


class Writer:
    """Appends documents to one open file; ``close`` writes the tables."""

    def __init__(self, out):
        import zstandard

        self.out, self.buffer, self.docs, self.frames, self.size = out, bytearray(), [], [], 0
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(DOC.pack(doc_id or 0, doc_id is None, len(self.frames), len(self.buffer) // 4, len(ids) // 4))
        self.buffer += ids
        if len(self.buffer) >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        import xxhash

        raw = bytes(self.buffer)
        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.frames.append(ENTRY.pack(len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.size += len(packed)
        self.buffer.clear()

    def close(self) -> None:
        if self.buffer:
            self.flush()
        index = b"".join(self.docs) + struct.pack("<I", len(self.docs))
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        seek = b"".join(self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
        self.out.close()


class Reader:
    """Random access to one file (seekable, binary): the tables first, then only the frames asked for."""

    def __init__(self, file):
        import zstandard

        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        end = file.seek(0, 2)
        count, kind, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or kind != 0x80:
            raise ValueError("no seek table")
        start = end - 9 - count * ENTRY.size
        self.frames, place = [], 0
        for packed, raw, check in ENTRY.iter_unpack(self._at(start, count * ENTRY.size)):
            self.frames.append((place, packed, raw, check))
            place += packed
        (docs,) = struct.unpack("<I", self._at(start - 12, 4))
        self.docs = list(DOC.iter_unpack(self._at(start - 12 - docs * DOC.size, docs * DOC.size)))

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def frame(self, number: int) -> bytes:
        import xxhash

        place, packed, raw, check = self.frames[number]
        out = self.unzip.decompress(self._at(place, packed), max_output_size=raw)
        if len(out) != raw or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {number} is damaged")
        return out

    def read(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) of all documents, or of those at the given places; a frame is decompressed once a run."""
        at, raw = None, b""
        for doc_id, null, frame, first, count in self.docs if wanted is None else (self.docs[i] for i in wanted):
            if frame != at and count:
                at, raw = frame, self.frame(frame)
            yield (None if null else doc_id), raw[4 * first : 4 * (first + count)]


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, path: str | None = None, *, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents; the manifest: (path, first key, n_docs, n_ids, start), a row a file, in order."""
    spark = docs.sparkSession
    path, tokenizer = path or scratch_path(spark, "tokens"), tokenizer or default_path()
    key, tail = P + "doc", struct.pack("<I", end_id)

    def write(batches):
        import pyarrow as pa

        fs, base = _file_system(path)
        fs.create_dir(base, recursive=True)
        open_file, done = None, []

        def finish():
            writer, name, first, n, ids = open_file
            writer.close()
            done.append((f"{path}/{name}", first, n, ids))

        enc = encoder(tokenizer)
        for batch in slices(batches):
            for k, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_file and open_file[0].size >= FILE_BYTES:
                    finish()
                    open_file = None
                if not open_file:
                    name = f"{uuid.uuid4().hex}.zst"
                    open_file = [Writer(fs.open_output_stream(f"{base}/{name}", compression=None)), name, k, 0, 0]
                ids = enc.encode(text) + tail
                open_file[0].add(doc_id, ids)
                open_file[3] += 1
                open_file[4] += len(ids) // 4
        if open_file:
            finish()
        cols = list(zip(*done, strict=True)) if done else [[], [], [], []]
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["path", "first", "n_docs", "n_ids"])

    rows = keyed(docs.select(F.col("doc_id").cast("long"), "text")).select(key, "doc_id", "text")
    rows = rows.repartitionByRange(key).sortWithinPartitions(key)
    files = sorted(rows.mapInArrow(write, "path string, first long, n_docs long, n_ids long").collect(), key=lambda r: r["first"])
    out, start = [], 0
    for r in files:
        out.append((r["path"], r["first"], r["n_docs"], r["n_ids"], start))
        start += r["n_ids"]
    return spark.createDataFrame(out, "path string, first long, n_docs long, n_ids long, start long")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, base = _file_system(path)
                out = []
                with fs.open_input_file(base) as f:
                    for doc_id, ids in Reader(f).read():
                        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    spread = manifest.select("path", "start").repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, manifest: DataFrame, doc_ids: list[int]) -> Iterator[tuple[int, bytes]]:
    """Ids of a few documents: only the frames that hold them are decompressed."""
    for r in manifest.collect():
        fs, base = _file_system(r["path"])
        with fs.open_input_file(base) as f:
            reader = Reader(f)
            yield from reader.read(i for i, d in enumerate(reader.docs) if not d[1] and d[0] in set(doc_ids))
