"""Best-fit packing of token sequences, in bulk-synchronous supersteps.

Documents over the capacity are cut into pieces of the capacity (the first piece may be shorter). Lengths and
gaps are whole numbers up to the capacity, so the two range-sorted sides of the match are kept run-length
encoded: a run is a length, or a gap, with how many there are. A superstep takes the runs of lengths in falling
order and sweeps the sorted gap runs for the successor, the smallest gap that fits; of the documents of a run
that want the same gaps the first by rank get them, the others go on to the next successor or open sequences;
the gaps shrink, and the next superstep begins. A run's documents also fill a gap several times over in one step.

The state of the sweeps is one count for each length (at most `capacity` rows come to the driver, however large
the input) and the runs of sequences they form. Which document takes which place follows from its rank among the
documents of its length, computed on the executors: each task numbers its own pieces by length, and a prefix sum
over tasks makes the numbers ranks. No document is sent to the driver or gathered with others of its length, so
a length that a third of all pieces have is no hot group.

Defined results: a null text is empty and has the end id only; repeated rows and null ids are documents of their
own; bytes that aren't UTF-8 are replaced; the empty table gives the empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, arrow_rows, as_texts, small_slices, text_of
from .tokens import default_tokenizer, encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, offset, how many): piece of rank first + i goes to sequence + i at the offset.

    Gap runs with the same gap stand in the order in which they arose; ranks of a length rise from 0.
    """
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, how many)
    sizes: list[int] = []  # the gaps that have runs, ascending
    sequences = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def fill(first: int, n: int, gap: int) -> None:
            """As many of the length as fit into each of n sequences; what doesn't come out even fills fewer."""
            nonlocal rank, left
            depth = min(gap // length, -(-left // n))
            for k in range(depth):
                took = min(n, left)
                out.append((length, rank, first, capacity - gap + k * length, took))
                rank, left = rank + took, left - took
                if took < n:  # these have one piece less
                    put(gap - (k + 1) * length, first, took)
                    put(gap - k * length, first + took, n - took)
                    return
            put(gap - depth * length, first, n)

        while left and (at := bisect.bisect_left(sizes, length)) < len(sizes):
            gap = sizes[at]
            first, n = gaps[gap].pop(0)
            if not gaps[gap]:
                del sizes[at]
            depth = gap // length
            if (use := -(-left // depth)) < n:  # the first by rank; the other sequences keep their gap
                gaps[gap].insert(0, (first + use, n - use)) if gaps[gap] else put(gap, first + use, n - use)
                n = use
            fill(first, n, gap)
        if left:
            n = -(-left // (capacity // length))
            fill(sequences, n, capacity)
            sequences += n
    return out


def pieces(docs: DataFrame, work: Workspace, id_col: str, text_col: str, capacity: int, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and rank: the piece's number among those of its length in its task."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in small_slices(batches, "text"):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank")}
            for name, ids in zip(batch.column(0).to_pylist(), encode(as_texts(batch, "text"), tokenizer)):
                for k, (at, n) in enumerate(cut(len(ids), capacity)):
                    for key, value in zip(out, (name, k, at, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes()), part, seen[n])):
                        out[key].append(value)
                    seen[n] += 1
            yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
    return work.write(rows.mapInArrow(arrow_rows(schema, make), schema), "pieces")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    placed = pieces(docs, work, id_col, text_col, capacity, tokenizer or default_tokenizer())
    by_task = work.write(placed.groupBy("length", "part").agg(F.count("*").alias("n")), "by-task")
    before = by_task.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs: dict[int, list[tuple]] = defaultdict(list)
    for length, *run in plan(counts, capacity):
        runs[length].append(run)
    places = spark.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in runs.items()})

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)).astype(np.int64) for k in (3, 5))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length):
                ranks, firsts, offsets, _ = places.value[int(n)]
                rows = np.flatnonzero(length == n)
                run = np.searchsorted(ranks, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = firsts[run] + rank[rows] - ranks[run], offsets[run]
            yield {f.name: batch.column(k).to_pylist() for k, f in enumerate(batch.schema) if f.name != "rank"} | {"sequence_id": sequence, "offset": offset}

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ranked = placed.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(arrow_rows(schema, make), schema)
