"""Token-id files in patched frame-of-reference blocks.

Documents are dealt out in ranges of ascending ids and tokenized there; each task cuts its ids into shards. A
shard is one binary value, laid out (little-endian) as

    magic "LFPF", version u16, block size u16, documents u32, ids u64, blocks u32     header, 24 bytes
    doc_id i64 x documents (null: the smallest i64), ids u32 x documents              whole ids of each document
    start u64 x (blocks + 1)                                                          the block index, from the data's begin
    blocks: minimum u32, width u8, exceptions u8, packed deltas, positions u8 x exceptions, deltas u32 x exceptions

A block holds up to 128 ids less the block's minimum, packed at the width that holds a chosen percentile of them;
the others are exceptions, packed as 0 and listed behind. Shards are written as rows of a Parquet table with the
columns part, shard, first (ids of the part before the shard), n_ids and payload: Spark's commit protocol makes
lost tasks and lost executors harmless and works in any store that Spark can write.

Defined results: a null text is empty and has the end id only; null ids come first; rows that repeat an id follow
each other in the order in which they are read; bytes that aren't UTF-8 are replaced; the empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, arrow_rows, as_texts, small_slices, text_of
from .tokens import default_tokenizer, encode

MAGIC, VERSION, BLOCK = b"LFPF", 1, 128
HEADER = struct.Struct("<4sHHIQI")
NO_ID = -(1 << 63)
#: So many rows of a part's number and its first id are broadcast at most (about 16 MB).
MOST_PARTS = 1 << 20


def _cells(w: int) -> np.dtype:
    """The smallest whole numbers that hold w bits."""
    return np.dtype("<u1" if w <= 8 else "<u2" if w <= 16 else "<u4")


def pack(ids: np.ndarray, percentile: float = 0.9) -> tuple[np.ndarray, bytes]:
    """The block index and the blocks. The last block is filled up with its last id."""
    if not len(ids):
        return np.zeros(1, np.uint64), b""
    filled = np.concatenate([ids, np.full(-len(ids) % BLOCK, ids[-1], np.uint32)]).reshape(-1, BLOCK)
    least = filled.min(1)
    deltas = filled - least[:, None]
    bits = np.frexp(deltas.astype(np.float32 if deltas.max() < 1 << 24 else np.float64))[1].astype(np.uint8)  # how many bits each needs
    at = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = np.partition(bits, at, axis=1)[:, at]
    where, which = np.nonzero(bits > width[:, None])
    n_out = np.bincount(where, minlength=len(filled))
    sizes = 6 + BLOCK // 8 * width.astype(np.int64) + 5 * n_out
    ends = np.cumsum(sizes)
    begins, out = ends - sizes, np.zeros(ends[-1], np.uint8)
    out[begins[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[begins + 4], out[begins + 5] = width, n_out
    kept = deltas.copy()
    kept[where, which] = 0
    for w in np.unique(width[width > 0]).tolist():
        rows, cells = np.flatnonzero(width == w), _cells(w)
        bits = np.unpackbits(kept[rows].astype(cells).view(np.uint8).reshape(len(rows), BLOCK, cells.itemsize), axis=2, bitorder="little", count=w)
        out[begins[rows][:, None] + 6 + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
    # the exceptions of a block: first their positions, then their deltas
    rank = np.arange(len(where)) - (np.cumsum(n_out) - n_out)[where]
    tail = begins[where] + 6 + BLOCK // 8 * width[where].astype(np.int64)
    out[tail + rank] = which
    out[(tail + n_out[where] + 4 * rank)[:, None] + np.arange(4)] = deltas[where, which].astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.concatenate([[0], ends]).astype(np.uint64), out.tobytes()


def unpack(starts: np.ndarray, data: bytes, n: int) -> np.ndarray:
    """The first n ids of the blocks."""
    raw, begins = np.frombuffer(data, np.uint8), starts[:-1].astype(np.int64)
    if not len(begins):
        return np.zeros(0, np.uint32)
    least = raw[begins[:, None] + np.arange(4)].view("<u4")
    width, n_out = raw[begins + 4].astype(np.int64), raw[begins + 5].astype(np.int64)
    out = np.zeros((len(begins), BLOCK), np.uint32)
    at = np.arange(BLOCK)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        packed = np.zeros((BLOCK // 8 * w + 4, len(rows)), np.uint8)  # four bytes behind, as the last ids look ahead
        packed[:-4] = raw[begins[rows][None, :] + 6 + np.arange(BLOCK // 8 * w)[:, None]]
        # the five bytes from the one in which an id begins hold it whole
        first, shift, wide = at * w // 8, (at * w % 8).astype(np.uint64)[:, None], np.uint64 if w > 25 else np.uint32
        ids = packed[first].astype(wide)
        for k in range(1, 5 if w > 25 else 4 if w > 17 else 3):
            ids |= packed[first + k].astype(wide) << wide(8 * k)
        out[rows] = (ids >> shift.astype(wide) & wide((1 << w) - 1)).T
    where = np.repeat(np.arange(len(begins)), n_out)
    rank = np.arange(len(where)) - (np.cumsum(n_out) - n_out)[where]
    tail = begins[where] + 6 + BLOCK // 8 * width[where]
    out[where, raw[tail + rank]] = raw[(tail + n_out[where] + 4 * rank)[:, None] + np.arange(4)].view("<u4")[:, 0]
    return (out + least).reshape(-1)[:n]


def to_shard(doc_ids: list[int | None], docs: list[np.ndarray], percentile: float = 0.9) -> bytes:
    ids = np.concatenate(docs)
    starts, data = pack(ids, percentile)
    head = HEADER.pack(MAGIC, VERSION, BLOCK, len(docs), len(ids), len(starts) - 1)
    names = np.array([NO_ID if x is None else x for x in doc_ids], "<i8")
    return head + names.tobytes() + np.array([len(x) for x in docs], "<u4").tobytes() + starts.astype("<u8").tobytes() + data


def from_shard(payload: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """The document ids, and the token ids of each document."""
    magic, version, block, n_docs, n_ids, n_blocks = HEADER.unpack_from(payload)
    if (magic, version, block) != (MAGIC, VERSION, BLOCK):
        raise ValueError("not a shard of this format")
    at = HEADER.size
    names = np.frombuffer(payload, "<i8", n_docs, at).tolist()
    lengths = np.frombuffer(payload, "<u4", n_docs, at := at + 8 * n_docs)
    starts = np.frombuffer(payload, "<u8", n_blocks + 1, at := at + 4 * n_docs)
    ids = unpack(starts, payload[at + 8 * (n_blocks + 1) :], n_ids)
    return [None if x == NO_ID else x for x in names], np.split(ids, np.cumsum(lengths)[:-1])


def write_token_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, shard_ids: int = 1 << 18, percentile: float = 0.9) -> DataFrame:
    """Writes the shards to the shared folder and returns them: part, shard, first, n_ids, payload.

    shard_ids: a shard is closed with the first document that brings it to so many ids.
    """
    path, work = tokenizer or default_tokenizer(), Workspace(docs.sparkSession, "token-shards")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("tie"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")  # the tie parts an id that many rows share

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        part, shard, first, names, held, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        for batch in small_slices(batches, "text"):
            for name, ids in zip(batch.column(0).to_pylist(), encode(as_texts(batch, "text"), path)):
                names.append(name)
                held.append(ids)
                size += len(ids)
                if size >= shard_ids:
                    yield {"part": [part], "shard": [shard], "first": [first], "n_ids": [size], "payload": [to_shard(names, held, percentile)]}
                    shard, first, names, held, size = shard + 1, first + size, [], [], 0
        if held:
            yield {"part": [part], "shard": [shard], "first": [first], "n_ids": [size], "payload": [to_shard(names, held, percentile)]}

    schema = "part int, shard int, first long, n_ids long, payload binary"
    return work.write(rows.mapInArrow(arrow_rows(schema, make), schema), "shards", compression="none")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """A row for each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, all from the shards."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each task that wrote
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    # a few bytes for each writing task: beside them the payloads needn't be shuffled, unless there are very many tasks
    few = totals.count() <= MOST_PARTS
    placed = shards.join(F.broadcast(before) if few else before, "part").select((F.col("before") + F.col("first")).alias("start"), "payload")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for k in range(batch.num_rows):
                names, docs = from_shard(batch.column(1)[k].as_py())
                lengths = np.array([len(x) for x in docs], np.int64)
                starts = batch.column(0)[k].as_py() + np.cumsum(lengths) - lengths
                yield {"doc_id": names, "start": starts.tolist(), "n_tokens": lengths.tolist(), "ids_crc32": [zlib.crc32(x.astype("<u4", copy=False)) for x in docs]}

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return placed.mapInArrow(arrow_rows(schema, make), schema)
