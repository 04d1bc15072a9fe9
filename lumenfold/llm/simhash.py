"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints that differ in at most `radius` of 64 bits agree on one of radius + 1 bit ranges, so distinct
fingerprints are grouped by the value of each range, and groups are compared as bit planes: plane b holds bit b
of every fingerprint of a block, and one pass over the planes adds up all distances to a fingerprint in
carry-save counters, 64 distances in a word. A block is abandoned once all of its distances exceed the radius.

Only distinct fingerprints are compared, and a compared block gives each member one link to the least member it
reaches, never all pairs. A range value that more than `bucket` distinct fingerprints share isn't compared
pair by pair: there each fingerprint meets its 64 one-bit neighbours and itself, groups that hold at most 65
fingerprints, which finds every pair within two bits exactly.

Defined results: a null text is empty, an empty text has fingerprint zero and links like any other; a null id
takes part but is never the smallest id of a component unless it has no other; repeated rows are each returned;
the empty table gives the empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .common import Workspace, arrow_rows, as_bytes, fresh, one_of_repeated, small_slices, text_of
from .components import components

#: SimHash of the contract: XXH64 with this seed.
SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, as an unsigned int."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-shingle].tolist()]
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())])
    bits = np.zeros(64, np.int64)
    n = len(digests) // 8
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = np.frombuffer(digests, np.uint8, count=8 * min(n - at, 1 << 16), offset=8 * at)
        bits += np.unpackbits(part.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, fp: a signed 64-bit fingerprint for each row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in small_slices(batches, "text"):
            yield {"id": batch.column(0).to_pylist(), "fp": [signed(fingerprint(t, shingle)) for t in as_bytes(batch, "text")]}

    schema = "id long, fp long"
    return rows.mapInArrow(arrow_rows(schema, make), schema)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 planes of 64-bit words; plane b has bit b of all fingerprints."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pad = -len(fps) % 64
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, pad), (0, 0))).T, axis=1, bitorder="little")).view("<u8")


def close(queries: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Bits [query, word]: which fingerprints are within the radius of each query; fingerprints have a word, or as many as columns."""
    queries, fps = (x.reshape(len(x), -1) for x in (queries, fps))
    planes = np.concatenate([bit_planes(np.ascontiguousarray(x)) for x in fps.T])
    width = (radius + 1).bit_length()
    shape = (len(queries), planes.shape[1])
    counters = [np.zeros(shape, np.uint64) for _ in range(width)]
    over = np.zeros(shape, np.uint64)
    if tail := len(fps) % 64:
        over[:, -1] = np.uint64(((1 << 64) - 1) ^ ((1 << tail) - 1))  # words end beyond the last fingerprint
    flips = np.where((queries[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), np.uint64((1 << 64) - 1), np.uint64(0)).reshape(len(queries), -1)
    exceeded = over
    for b in range(len(planes)):
        carry = planes[b][None, :] ^ flips[:, b : b + 1]
        for c in counters:
            c ^= carry
            carry &= ~c
        over |= carry
        if b % 8 == 7:
            exceeded = over | _above(counters, radius)
            if exceeded.min() == np.uint64((1 << 64) - 1):
                break
    return ~exceeded


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the counted value is over the radius."""
    above = np.zeros_like(counters[0])
    same = ~above
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same = same & counters[k]
        else:
            above |= same & counters[k]
            same = same & ~counters[k]
    return above


def block_links(fps: np.ndarray, radius: int, rows: int = 256) -> list[tuple[int, int]]:
    """(fingerprint, least one it reaches inside the block), for members that reach another."""
    found = np.concatenate([close(fps[at : at + rows], fps, radius) for at in range(0, len(fps), rows)])
    near = np.bitwise_count(found).sum(1) > 1
    seen, links = np.zeros(found.shape[1], np.uint64), []
    for k in np.flatnonzero(near):  # fps ascend, so k is the least of a component not seen before
        if seen[k >> 6] >> np.uint64(k & 63) & np.uint64(1):
            continue
        reach, done = found[k].copy(), np.zeros_like(seen)
        done[k >> 6] |= np.uint64(1) << np.uint64(k & 63)
        while (todo := reach & ~done).any():
            members = np.flatnonzero(np.unpackbits(todo.view(np.uint8), bitorder="little"))
            reach |= np.bitwise_or.reduce(found[members], axis=0)
            done |= todo
        seen |= reach
        members = np.flatnonzero(np.unpackbits(reach.view(np.uint8), bitorder="little"))
        links += [(int(fps[m]), int(fps[k])) for m in members if m != k]
    return links


def near_links(fps: DataFrame, work: Workspace, radius: int = 2, bucket: int = 8192) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that connect all within the radius of each other."""
    if radius not in (0, 1, 2):
        raise ValueError("radius must be 0, 1 or 2")
    cuts = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    ranges = [F.shiftrightunsigned(F.shiftleft("fp", 64 - b), 64 - (b - a)) for a, b in zip(cuts, cuts[1:])]
    keyed = fps.select("fp", F.posexplode(F.array(*ranges)).alias("range", "value"))
    sizes = work.write(keyed.groupBy("range", "value").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    shared = keyed.join(sizes, ["range", "value"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        def linked(held: list[np.ndarray]) -> dict[str, list]:
            links = block_links(np.unique(np.concatenate(held).view(np.uint64)), radius)
            return {"u": [signed(a) for a, _ in links], "v": [signed(b) for _, b in links]}

        # whole buckets, several small ones at a time: comparing across buckets finds true links only
        held, last = [], None
        for batch in batches:
            fp, at, value = (np.asarray(batch.column(k)) for k in range(3))
            edges = np.flatnonzero((at[1:] != at[:-1]) | (value[1:] != value[:-1])) + 1
            for part, key in zip(np.split(fp, edges), [*zip(at[np.r_[0, edges]], value[np.r_[0, edges]])] if len(fp) else []):
                if key != last and sum(map(len, held)) >= 1024:
                    yield linked(held)
                    held = []
                held.append(part)
                last = key
        if held:
            yield linked(held)

    schema = "u long, v long"
    compared = (
        shared.where(F.col("n") <= bucket).select("fp", "range", "value").repartition("range", "value").sortWithinPartitions("range", "value").mapInArrow(arrow_rows(schema, make), schema)
    )
    crowded = shared.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.expr("transform(sequence(0, 64), i -> IF(i = 64, fp, fp ^ shiftleft(1L, i)))" if radius == 2 else "array(fp)")
    met = crowded.select("fp", F.explode(flips).alias("neighbour")).groupBy("neighbour").agg(F.collect_set("fp").alias("all")).where("size(all) > 1")
    if radius == 1:  # of two fingerprints one bit apart, one is a neighbour of the other
        flips = F.expr("transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))")
        met = crowded.select("fp", F.explode(flips).alias("other")).join(crowded.select(F.col("fp").alias("other")), "other").select(F.array("fp", "other").alias("all"))
    neighbours = met.select(F.array_min("all").alias("v"), F.explode("all").alias("u")).where("u <> v").select("u", "v")
    return compared.unionByName(neighbours)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, radius: int = 2, bucket: int = 8192) -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    work = Workspace(docs.sparkSession, "simhash")
    each = work.write(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = work.write(each.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = work.write(components(near_links(distinct.select("fp"), work, radius, bucket), work), "roots")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return each.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The document with the smallest id of each group, with all its columns.

    Rows without an id stay. Rows that share an id are one document: they go if one of them has to, and of rows
    that repeat id and text one stays.
    """
    key, name = F.col(f"`{id_col}`").cast("long"), fresh("__lf_id", docs)
    gone = simhash_groups(docs, id_col, text_col, **how).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    left = docs.join(gone, key == F.col(name), "left_anti")  # null ids match nothing and stay
    return one_of_repeated(left, id_col, text_col)
