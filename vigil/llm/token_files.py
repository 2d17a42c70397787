"""Token-id files: fixed-width bit packing with block offsets.

A file set is a parquet folder whose rows are blocks of whole documents. Each
block keeps every id in the fewest bits that hold the vocabulary, so position i
of a block starts at bit i * bits: numpy unpacks a block at once, and any single
id or document can be read without touching the rest. Blocks carry their
shard, their place in the shard, and their documents' ids and lengths.

Defined results: null text counts as empty (only the end id); an empty table
gives no blocks; rows that repeat a doc_id are kept, in the order of their
texts; a null doc_id sorts first; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import offsets_before, shuffle_width, text_or_empty
from vigil.llm.tokens import chunk_tokenizer

BLOCK_IDS = 1 << 18         # a block closes at the document that brings it to this many ids
BLOCK_SCHEMA = ("shard int, block int, start_in_shard long, n_ids long, bits int, "
                "doc_ids array<long>, lengths array<long>, packed binary")


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold ids 0 .. vocabulary-1 (at least one)."""
    return max(1, (int(vocabulary) - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, least significant bit first, padded with zeros to a byte."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=bits)
    return np.packbits(flat.reshape(-1), bitorder="little").tobytes()


def unpack_ids(packed: bytes, bits: int, n: int, start: int = 0) -> np.ndarray:
    """``n`` ids from position ``start`` of a packed block, reading only their bytes."""
    if n <= 0:
        return np.zeros(0, dtype="<u4")
    first, last = start * bits, (start + n) * bits
    raw = np.frombuffer(packed, dtype=np.uint8)[first // 8:(last + 7) // 8]
    if bits in (8, 16, 32):
        return raw.view(f"<u{bits // 8}").astype("<u4")
    flat = np.unpackbits(raw, bitorder="little")[first % 8:first % 8 + n * bits].reshape(n, bits)
    out = np.zeros((n, 32), dtype=np.uint8)
    out[:, :bits] = flat
    return np.packbits(out, axis=1, bitorder="little").view("<u4").reshape(-1)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, vocabulary: int,
                      keeps_blanks: bool = True, block_ids: int = BLOCK_IDS, added_tokens: bool = False) -> None:
    """Encode every whole text, append ``end_id``, write blocks in ascending doc_id order.

    One range shuffle by doc_id puts shard numbers in document order; everything else
    is one pass over each shard. ``added_tokens``: strings of added tokens in a text become
    their ids, as the library does by default.
    """
    bits = bits_for(max(vocabulary, end_id + 1))
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chunk_tokenizer(tokenizer_path, keeps_blanks, added_tokens)
        shard = TaskContext.get().partitionId()
        at = number = size = 0
        ids, doc_ids, lengths = [], [], []

        def block():
            nonlocal at, number, size
            packed = pack_ids(np.frombuffer(b"".join(ids), dtype="<u4"), bits)
            row = [[shard], [number], [at], [size], [bits], [list(doc_ids)], [list(lengths)], [packed]]
            at, number, size = at + size, number + 1, 0
            for kept in (ids, doc_ids, lengths):
                kept.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(row, ARROW_BLOCK.types)], schema=ARROW_BLOCK)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):    # few texts at once as Python strings
                part = batch.slice(lo, 256)
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for key, enc in zip(keys, tok.encode(texts)):
                    ids += (enc, end)
                    doc_ids.append(key)
                    lengths.append(len(enc) // 4 + 1)
                    size += lengths[-1]
                    if size >= block_ids:
                        yield block()
        if doc_ids:
            yield block()

    keyed = docs.select("doc_id", text_or_empty().alias("text"))
    (keyed.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id")
     .sortWithinPartitions("doc_id", "text")
     .mapInArrow(encode, BLOCK_SCHEMA).write.parquet(path))


ARROW_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start_in_shard", pa.int64()),
                         ("n_ids", pa.int64()), ("bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                         ("lengths", pa.list_(pa.int64())), ("packed", pa.binary())])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``: the ids of all earlier documents in the file set."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = offsets_before(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")), "shard", "n", "base")
    return (blocks.join(F.broadcast(totals.select("shard", "base")), "shard")   # one row per shard
            .withColumn("start", F.col("base") + F.col("start_in_shard")).drop("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array) of every document, from the files."""
    def split(batches):
        for doc_id, start, ids in _documents(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc_id], pa.int64()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], ["doc_id", "start", "n_tokens", "ids"])
    return _read_columns(spark, path).mapInArrow(split, "doc_id long, start long, n_tokens long, ids array<long>")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    def digest(batches):
        rows = ([], [], [], [])
        for doc_id, start, ids in _documents(batches):
            for col, value in zip(rows, (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))):
                col.append(value)
            if len(rows[0]) >= 10_000:
                yield _long_batch(rows)
                rows = ([], [], [], [])
        if rows[0]:
            yield _long_batch(rows)
    return _read_columns(spark, path).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_columns(spark, path):
    return read_blocks(spark, path).select("start", "n_ids", "bits", "doc_ids", "lengths", "packed")


def _long_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows],
                                      ["doc_id", "start", "n_tokens", "ids_crc32"])


def _documents(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for r in range(batch.num_rows):
            start, n, bits, doc_ids, lengths, packed = (batch.column(c)[r].as_py() for c in range(6))
            ids = unpack_ids(packed, bits, n)
            at = 0
            for doc_id, length in zip(doc_ids, lengths):
                yield doc_id, start + at, ids[at:at + length]
                at += length


def read_ids_at(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """Random access: ``n`` ids from global position ``start`` (only the blocks that hold them are read)."""
    hit = (read_blocks(spark, path).filter((F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start))
           .orderBy("start").select("start", "n_ids", "bits", "packed").toLocalIterator())
    parts = []
    for b in hit:
        lo, hi = max(start, b["start"]) - b["start"], min(start + n, b["start"] + b["n_ids"]) - b["start"]
        parts.append(unpack_ids(bytes(b["packed"]), b["bits"], hi - lo, lo))
    return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
