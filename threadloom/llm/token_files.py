"""Operator 7: token ids in seekable zstandard files.

A file is a row of independent zstandard frames, one or more for each document (ids as little-endian
unsigned 32-bit integers), then a skippable frame that lists the documents, then a skippable frame
with the seek table of the public seekable format: compressed size, decompressed size and checksum
(low 32 bits of XXH64) of every frame, and a footer. A reader takes the two tables from the end of
the file and then decompresses only the frames of the documents it wants.

Files are written in ascending doc_id order, one or more for each range of ids. A task writes under a
name of its own and the manifest, one row a file, names the files that count; a task that is lost
and run again writes new files.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import shuffle_parts, stage
from threadloom.llm.tokens import PieceCodes
from threadloom.session import ensure_checkpoint_dir

END_ID = 2
FILE_BYTES = 256 << 20  # a new file begins beyond this size
FRAME_IDS = 1 << 24  # ids in one frame; a longer document has several
BATCH_CHARS = 1 << 20
COMPOSABLE = re.compile("[^\x00-\u02ff]")
WORD_END = re.compile(r"(?<=[a-z\xdf-\xf6\xf8-\xff])([.,])(?= |\Z)")
JOINED = 512  # new chunks that one call of the tokenizer encodes as a line
# Fixed values of the zstandard seekable format.
SKIPPABLE_TABLE, SKIPPABLE_DOCS, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1, 0x80
MANIFEST = "path string, part int, seq int, n_docs bigint, n_ids bigint"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is on the (shared) local one."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class Writer:
    """Writes one file; ``add`` documents in order, then ``close``."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self._out = fs.open_output_stream(path, compression=None)
        self._pack = zstandard.ZstdCompressor(level=3, write_checksum=False)
        self.size = self.n_ids = 0
        self._frames: list[tuple[int, int, int]] = []
        self._docs: list[tuple[int, int]] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        parts = range(0, max(len(ids), 1), FRAME_IDS)
        for lo in parts:
            raw = ids[lo:lo + FRAME_IDS].astype("<u4").tobytes()
            frame = self._pack.compress(raw)
            self._out.write(frame)
            self._frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.size += len(frame)
        self._docs.append((doc_id, len(parts)))
        self.n_ids += len(ids)

    def close(self) -> None:
        docs = self._pack.compress(np.array(self._docs, "<i8").reshape(-1, 2).tobytes())
        self._out.write(struct.pack("<II", SKIPPABLE_DOCS, len(docs)) + docs)
        table = np.array(self._frames, "<u4").reshape(-1, 3).tobytes()
        self._out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table) + 9) + table)
        self._out.write(struct.pack("<IBI", len(self._frames), CHECKSUM_FLAG, SEEKABLE_MAGIC))
        self._out.close()


class Reader:
    """Random access to one file: reads the tables at its end, then only the frames asked for."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self._in = fs.open_input_file(path)
        self._unpack = zstandard.ZstdDecompressor()
        size = self._in.size()
        n, _, magic = struct.unpack("<IBI", self._in.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table_at = size - 9 - 12 * n - 8
        self.frames = np.frombuffer(self._in.read_at(12 * n, table_at + 8), "<u4").reshape(n, 3).astype(np.int64)
        ends = np.cumsum(self.frames[:, 0])
        self._at = ends - self.frames[:, 0]
        docs_at = int(ends[-1]) if n else 0
        raw = self._unpack.decompress(self._in.read_at(table_at - docs_at - 8, docs_at + 8))
        self.docs = np.frombuffer(raw, "<i8").reshape(-1, 2)
        self._first = np.cumsum(self.docs[:, 1]) - self.docs[:, 1]

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file; a damaged frame raises ValueError."""
        parts = []
        for f in range(int(self._first[k]), int(self._first[k] + self.docs[k, 1])):
            packed = self._in.read_at(int(self.frames[f, 0]), int(self._at[f]))
            raw = self._unpack.decompress(packed, max_output_size=int(self.frames[f, 1])) if self.frames[f, 1] else b""
            if len(raw) != self.frames[f, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[f, 2]:
                raise ValueError(f"frame {f} is damaged")
            parts.append(np.frombuffer(raw, "<u4"))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def find(self, doc_id: int) -> list[int]:
        """Places of a document id in the file (ids ascend; repeated ids are neighbours)."""
        ids = self.docs[:, 0]
        return list(range(int(np.searchsorted(ids, doc_id, "left")), int(np.searchsorted(ids, doc_id, "right"))))

    def close(self) -> None:
        self._in.close()


@lru_cache(maxsize=2)  # a worker keeps what it knows for its next tasks
def encoder(tokenizer_file: str) -> PieceCodes:
    """Ids by the tokenizers library, which encodes each distinct chunk between ASCII spaces once.

    Valid for tokenizers whose normaliser and splitter never look across white space, such as
    ``word_bpe_49k.json``: it collapses and drops white space and splits within it.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file)

    def lines_of(pieces: list[str]):
        # many chunks a call, a space between them; a token's place in the line tells its chunk
        flat, lengths = [np.zeros(0, np.uint32)], np.zeros(len(pieces), np.int64)
        lines = [pieces[lo:lo + JOINED] for lo in range(0, len(pieces), JOINED)]
        for k, got in enumerate(library.encode_batch([" ".join(x) for x in lines], add_special_tokens=False)):
            width = np.fromiter(map(len, lines[k]), np.int64, len(lines[k])) + 1
            ends = np.cumsum(width)
            chunk = np.searchsorted(ends, np.fromiter((a for a, _ in got.offsets), np.int64, len(got)), "right")
            lengths[k * JOINED:k * JOINED + len(lines[k])] = np.bincount(chunk, minlength=len(lines[k]))
            flat.append(np.array(got.ids, np.uint32))
        return np.concatenate(flat), lengths

    def encode(pieces: list[str]):
        # a lower-case ASCII word is its own normal form and one word to the splitter: the model alone decides
        plain = np.fromiter((p.isascii() and p.isalpha() and p.islower() for p in pieces), bool, len(pieces))
        other = np.flatnonzero(~plain)
        tokens = [[t.id for t in library.model.tokenize(pieces[i])] for i in np.flatnonzero(plain).tolist()]
        flat, lengths = lines_of([pieces[i] for i in other.tolist()])
        sizes = np.zeros(len(pieces), np.int64)
        sizes[plain] = [len(t) for t in tokens]
        sizes[other] = lengths
        out = np.zeros(int(sizes.sum()), np.uint32)
        mine = np.repeat(plain, sizes)
        out[mine] = [i for t in tokens for i in t]
        out[~mine] = flat
        return out, sizes
    return PieceCodes(encode)


def chunks(text: str) -> list[str]:
    """Pieces that ``encoder`` may encode apart: between spaces, less a comma or stop that ends a word.

    Texts below U+0300, which normalisation cannot compose, are lower-cased first, as the normaliser
    would, so that fewer pieces differ; texts that may hold a special token's string, whose case
    matters, are left as they are.
    """
    if (text.isascii() or not COMPOSABLE.search(text)) and "<|" not in text:
        text = text.lower()
    return WORD_END.sub(r" \1", text.replace("\n", " ").replace("\t", " ")).split(" ")


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """(ids, texts) in groups of bounded size, or of one longer text."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids.append(-(1 << 63) if doc_id is None else doc_id)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= BATCH_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _write(folder: str, tokenizer_file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        codes, out, seq, made = encoder(tokenizer_file), None, 0, []

        def close():
            nonlocal out, seq
            out.close()
            made.append((f"{folder}/part-{part:06d}-{attempt}-{seq:04d}.zst", part, seq, len(out._docs), out.n_ids))
            out, seq = None, seq + 1

        for ids, texts in _grouped(batches):
            flat, lengths = codes.ids([chunks(t) for t in texts])
            at = np.concatenate([[0], np.cumsum(lengths)])
            for k, doc_id in enumerate(ids):
                if out is None:
                    out = Writer(f"{folder}/part-{part:06d}-{attempt}-{seq:04d}.zst")
                out.add(doc_id, np.append(flat[at[k]:at[k + 1]], np.uint32(end_id)))
                if out.size > FILE_BYTES:
                    close()
        if out is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                names=[f.split()[0] for f in MANIFEST.split(", ")])
    return run


def write_token_files(docs: DataFrame, tokenizer_file: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of every document, each followed by ``end_id``; returns the manifest with ``start``.

    ``start`` is the number of ids in all files before. Null and empty texts have the end id alone;
    a null doc_id is stored as the least 64-bit integer and comes first; repeated ids are all kept,
    ordered by text. ``folder`` must be seen by all executors; by default it is a new one in
    spark.checkpoint.dir. An empty table writes no files.
    """
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.repartitionByRange(shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stage(rows.mapInArrow(_write(folder, tokenizer_file, end_id), MANIFEST), "token-manifest")
    # one row a file: the running total over them is metadata, not data
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            reader = Reader(path)
            for lo in range(0, len(reader.docs), 1024):
                rows = []
                for k in range(lo, min(lo + 1024, len(reader.docs))):
                    ids = reader.ids(k)
                    rows.append((int(reader.docs[k, 0]), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])
            reader.close()


def read_digests(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document, read from the files."""
    files = manifest.select("path", "start").repartition(shuffle_parts(manifest.sparkSession))
    return files.mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_documents(manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """``doc_id, ids`` of the documents in ``wanted`` (a short list), decompressing only their frames."""
    asked = sorted(set(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                reader = Reader(path)
                found = [(d, reader.ids(k).tolist()) for d in asked for k in reader.find(d)]
                reader.close()
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.list_(pa.int64()))],
                        names=["doc_id", "ids"])
    return manifest.select("path").mapInArrow(run, "doc_id bigint, ids array<bigint>")
