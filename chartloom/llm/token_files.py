"""Token ids in directly addressable code files.

An id is split into 8-bit chunks, lowest first.  Level k holds the k-th chunk
of every id that has one, a bitmap says which ids go on to level k + 1, and a
directory keeps the number of ones before every 512 bits.  Any id is read by
following its bits upward (a rank a level), without decoding its neighbours.

File layout, little-endian: magic ``CLDAC01\\n``, then u64 counts of documents,
tokens and levels, then the documents' ids (i64) and token ends (u64), then for
each level u64 n and n chunk bytes padded to 8, and, but for the last level,
the bitmap (u64 words) and the directory (u64).
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.llm import store
from chartloom.llm.tokens import HFTokenizer, load, vocabulary_path

MAGIC = b"CLDAC01\n"
FILE_TOKENS = 4_000_000
END_ID = 2
MANIFEST = "path string, seq int, first_doc bigint, n_docs bigint, n_tokens bigint"


def encode(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one file; ``ends[i]`` is the number of ids up to document i's end."""
    rest = np.asarray(ids, np.uint32)
    levels: list[bytes] = []
    while True:
        chunk = (rest & 0xFF).astype(np.uint8).tobytes()
        rest = rest >> 8
        more = rest > 0
        last = not more.any()
        part = [np.uint64(len(chunk)).tobytes(), chunk, b"\0" * (-len(chunk) % 8)]
        if not last:
            bits = np.packbits(more, bitorder="little").tobytes()
            bits += b"\0" * (-len(bits) % 64)
            words = np.frombuffer(bits, "<u8")
            ones = np.bitwise_count(words).astype(np.uint64).reshape(-1, 8).sum(axis=1)
            part += [bits, np.r_[np.uint64(0), np.cumsum(ones)[:-1]].astype("<u8").tobytes()]
        levels.append(b"".join(part))
        if last:
            break
        rest = rest[more]
    head = np.array([len(doc_ids), len(ids), len(levels)], "<u8").tobytes()
    return b"".join([MAGIC, head, np.asarray(doc_ids, "<i8").tobytes(), np.asarray(ends, "<u8").tobytes(), *levels])


class TokenFile:
    """Random access to a file's bytes (bytes, or a memory map)."""

    def __init__(self, raw) -> None:
        view = memoryview(raw)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_tokens, n_levels = np.frombuffer(view, "<u8", 3, 8).tolist()
        at = 32
        self.doc_ids = np.frombuffer(view, "<i8", n_docs, at)
        self.ends = np.frombuffer(view, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        at += 16 * n_docs
        self.levels = []
        for k in range(n_levels):
            n = int(np.frombuffer(view, "<u8", 1, at)[0])
            chunk = np.frombuffer(view, np.uint8, n, at + 8)
            at += 8 + n + -n % 8
            words = ranks = None
            if k + 1 < n_levels:
                blocks = -(-n // 512)
                words = np.frombuffer(view, "<u8", 8 * blocks, at)
                ranks = np.frombuffer(view, "<u8", blocks, at + 64 * blocks)
                at += 72 * blocks
            self.levels.append((chunk, words, ranks))

    def __getitem__(self, i: int) -> int:
        """The i-th id of the file."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = 0
        for k, (chunk, words, ranks) in enumerate(self.levels):
            out |= int(chunk[i]) << (8 * k)
            if words is None or not int(words[i >> 6]) >> (i & 63) & 1:
                return out
            first = i >> 9 << 3
            below = int(words[i >> 6]) & ((1 << (i & 63)) - 1)
            i = int(ranks[i >> 9]) + int(np.bitwise_count(words[first : i >> 6]).sum()) + below.bit_count()
        return out

    def all(self) -> np.ndarray:
        """Every id, decoded level by level."""
        out = np.zeros(self.n_tokens, np.uint32)
        at = np.arange(self.n_tokens)
        for k, (chunk, words, _) in enumerate(self.levels):
            out[at] |= chunk.astype(np.uint32) << np.uint32(8 * k)
            if words is not None:
                at = at[np.unpackbits(words.view(np.uint8), count=len(chunk), bitorder="little").view(bool)]
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, by random access."""
        first = int(self.ends[k - 1]) if k else 0
        return np.array([self[i] for i in range(first, int(self.ends[k]))], np.uint32)


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, raw: bytes) -> None:
    """Write under a hidden name, then rename: a lost task leaves no partial file."""
    fs, path = _filesystem(uri)
    folder, name = os.path.split(path)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/.{name}") as out:
        out.write(raw)
    fs.move(f"{folder}/.{name}", path)


def read_file(uri: str) -> TokenFile:
    fs, path = _filesystem(uri)
    with fs.open_input_file(path) as f:
        return TokenFile(f.read())


def _writer(path: str, folder: str, end_id: int, file_tokens: int):
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        tokenizer = load(HFTokenizer, path, "blank")
        task = TaskContext.get()
        docs: list[int] = []
        parts: list[np.ndarray] = []
        held = seq = 0

        def flush():
            nonlocal held, seq
            # Every attempt has names of its own; the manifest lists those of the attempt that counted.
            name = f"{folder}/part-{task.partitionId():05d}-{seq:04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.dac"
            write_file(name, encode(np.array(docs), np.cumsum([len(p) for p in parts]), np.concatenate(parts)))
            row = [name, seq, docs[0], len(docs), held]
            docs.clear(), parts.clear()
            held, seq = 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["path", "seq", "first_doc", "n_docs", "n_tokens"])

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), tokenizer.ids(b.column(1))):
                docs.append(doc_id)
                parts.append(np.append(ids, np.asarray(end_id, ids.dtype)))
                held += len(parts[-1])
                if held >= file_tokens:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS, partitions: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the documents' ids (and ``end_id`` after each) in ascending id order.

    Returns the manifest, one row a file, with ``start``: ids in all files
    before.  Documents are range-partitioned by id, so files follow one another;
    null texts are empty; documents with equal ids lie together, ordered by
    text; a null id sorts first and is stored as -2**63.  An empty table gives
    no file.  A task that was run again leaves files that no manifest names;
    ``sweep`` deletes them.
    """
    spark = docs.sparkSession
    store.small_batches(spark)
    folder = folder or store.scratch(spark, "token-files")
    path = tokenizer or vocabulary_path("word_bpe_49k.json")
    rows = docs.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(-(2**63))).alias("doc_id"), store.text_of(text_column).alias("text"))
    n = partitions or 2 * store.width(spark)
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = store.materialize(ordered.mapInArrow(_writer(path, folder, end_id, file_tokens), MANIFEST), "token-manifest")
    # One row a file: the window's single task sees no documents.
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("first_doc", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def sweep(folder: str, manifest: DataFrame) -> int:
    """Delete the files of lost attempts, those that the manifest does not name; returns how many."""
    from pyarrow import fs as pafs

    fs, path = _filesystem(folder)
    named = {os.path.basename(r["path"]) for r in manifest.select("path").toLocalIterator()}  # a name for each FILE_TOKENS ids
    stray = [f.path for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.base_name.endswith(".dac") and f.base_name not in named]
    for f in stray:
        fs.delete_file(f)
    return len(stray)


def _reader(batches) -> Iterator:
    import pyarrow as pa

    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            f = read_file(path)
            ids = f.all().astype("<u4")
            begins = np.r_[0, f.ends[:-1]]
            for i in range(0, len(begins), 1000):
                j = min(i + 1000, len(begins))
                raw = [ids[a:e].tobytes() for a, e in zip(begins[i:j].tolist(), f.ends[i:j].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.doc_ids[i:j]), pa.array(begins[i:j] + start), pa.array(f.ends[i:j] - begins[i:j]), pa.array(raw, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian u32) of every document in the files."""
    spark = manifest.sparkSession
    spread = manifest.select("path", "start").repartition(2 * store.width(spark))
    return spread.mapInArrow(_reader, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_tokens(store.documents(spark, sf_dir, "doc_id", "text"))
    return read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
