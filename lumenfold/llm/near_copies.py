"""Near copies by the Jaccard similarity of word shingles: MinHash finds candidates, bit planes thin them, texts decide.

The least hashes of a text's shingles under 128 functions give it `bands` keys, each a digest of `rows` of them, and a
sketch of one bit a function. Texts that share a key are candidates; of these only pairs whose numbers of shingles
allow it and whose sketches differ in `radius` bits or fewer are compared, exactly, on the shingles themselves. A pair
of similarity 0.8 shares no key with probability (1 - 0.8 ** rows) ** bands, 0.000003, and differs in more than 28 of
128 bits with probability 0.00001. Pairs that pass the sketches must also agree in `agree` of 128 bytes, one of each least hash, which one
of similarity 0.8 misses with probability 0.00002.

First every text is compared with the least that it shares a key with, one comparison a text: a group of copies costs
as many comparisons as it has members. Those left over meet in what is left of their buckets, where bit-sliced
counters find each one's close smaller ones: `most` of a bucket at first and four times as many in each following
pass, until no text that is left has more. A pair is looked at in the first bucket that both are in, and in one pass,
so each is made once. The number of passes is logarithmic in the size of a bucket. Buckets over `block` texts are
searched in slices by several tasks; a task holds the marks of one bucket, 260 bytes a text.

Of two near copies that share a key at least one goes, and each that goes has a near copy with a smaller id.

Defined results: words are parted at ASCII blanks, ASCII letters are lowered; a text of fewer words than a shingle
is one shingle; null and empty texts and rows without an id stay; rows that share an id go together; the empty
table gives the empty table; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Workspace, arrow_rows, as_bytes, fresh, small_slices, text_of
from .ngrams import WordHashes, ngram_hashes
from .simhash import close, signed

#: How many functions there are, each a bit of the sketch.
FUNCTIONS = 128


def shingles(text: bytes, shingle: int) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[s : s + shingle]) for s in range(max(1, len(words) - shingle + 1))} if words else set()


@cache
def _functions() -> np.ndarray:
    """An odd factor and a summand for each function."""
    out = np.random.default_rng(5).integers(0, 1 << 32, (2, FUNCTIONS, 1), np.uint32, endpoint=False)
    out[0] |= np.uint32(1)
    return out


def marks(coded: np.ndarray, shingle: int, bands: int, rows: int) -> tuple[list[int], np.ndarray, int, bytes]:
    """The keys of a text, none without words, the two words of its sketch, its number of shingles, and a byte of each least hash, from the hashes of its words."""
    if not len(coded):
        return [], np.zeros(2, np.int64), 0, bytes(FUNCTIONS)
    hashed = ngram_hashes(coded, min(shingle, len(coded)))
    grams = (hashed >> np.uint64(32)).astype(np.uint32)
    factor, summand = _functions()
    least = np.full(FUNCTIONS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(grams), 1 << 11):  # bounded memory for very long texts
        least = np.minimum(least, (grams[None, at : at + (1 << 11)] * factor + summand).min(1))
    keys = [signed(xxh64_intdigest(least[k * rows : (k + 1) * rows].tobytes(), k)) for k in range(bands)]
    mixed = least * np.uint32(0x9E3779B1)
    return keys, np.packbits((mixed >> np.uint32(31)).astype(np.uint8)).view(np.int64), len(np.unique(hashed)), (mixed >> np.uint32(24)).astype(np.uint8).tobytes()


def _marked(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """docs: id, text -> id, keys, s0, s1, size, tags (four bytes of each key, to tell whether two texts share one), least (bytes)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        hashes = WordHashes(1 << 18)
        for batch in small_slices(batches, "text"):
            made = [marks(hashes.of(t.lower().split()), shingle, bands, rows) for t in as_bytes(batch, "text")]
            tags = [np.array(m[0], np.int64).astype(np.uint32).tobytes() for m in made]
            yield {"id": batch.column(0).to_pylist(), "keys": [m[0] for m in made], "s0": [m[1][0] for m in made], "s1": [m[1][1] for m in made], "size": [m[2] for m in made], "tags": tags, "least": [m[3] for m in made]}

    schema = "id long, keys array<long>, s0 long, s1 long, size int, tags binary, least binary"
    return docs.mapInArrow(arrow_rows(schema, make), schema)


def _alike(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The ids u of pairs (u, v) whose texts are alike."""
    both = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("text")), "u").join(texts.select(F.col("id").alias("v"), F.col("text").alias("other")), "v")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        last, theirs = None, set()
        for batch in batches:
            for part in small_slices(iter([batch]), "text"):
                out: dict[str, list] = {"id": []}
                for u, a, b in zip(part.column(0).to_pylist(), as_bytes(part, "text"), as_bytes(part, "other")):
                    if b != last:
                        last, theirs = b, shingles(b, shingle)
                    mine = shingles(a, shingle)
                    shared = len(mine & theirs)
                    if 100 * shared >= percent * (len(mine) + len(theirs) - shared):
                        out["id"].append(u)
                yield out

    return both.select("u", "text", "other").mapInArrow(arrow_rows("id long", make), "id long").distinct()


class Bucket:
    """The texts that share the key of a band: ids (ascending), sketches [text, 2], sizes, tags [text, band] and least [text, byte]."""

    def __init__(self, band: int, ids: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, tags: np.ndarray, least: np.ndarray):
        self.band, self.ids, self.sketches, self.sizes, self.tags, self.least = band, ids, sketches, sizes, tags, least

    def neighbours(self, queries: np.ndarray, radius: int, agree: int, percent: int, window: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each query (a place) its close smaller ones that no earlier band has, those of a window of ranks, and the queries that have more: (u, v, more)."""
        ids, low, high = self.ids, *window
        step = max(1, (1 << 18) // (len(ids) // 64 + 1))
        for at in range(0, len(queries), step):
            asked = queries[at : at + step]
            found = np.unpackbits(close(self.sketches[asked], self.sketches, radius).view(np.uint8), axis=1, bitorder="little")[:, : len(ids)].astype(bool)
            found &= ids[None, :] < ids[asked][:, None]
            u, v = np.nonzero(found)
            u = asked[u]
            small, large = (f(self.sizes[u], self.sizes[v]) for f in (np.minimum, np.maximum))
            fits = 100 * small >= percent * large
            u, v = u[fits], v[fits]
            first = ~(self.tags[u, : self.band] == self.tags[v, : self.band]).any(1)
            u, v = u[first], v[first]
            alike = np.concatenate([(self.least[u[k : k + 4096]] == self.least[v[k : k + 4096]]).sum(1) >= agree for k in range(0, len(u), 4096)] or [np.zeros(0, bool)])
            u, v = u[alike], v[alike]
            rank = np.arange(len(u)) - np.searchsorted(u, u)
            chosen = (rank >= low) & (rank < high)
            yield u[chosen], v[chosen], np.unique(u[rank >= high])


def _neighbours(live: DataFrame, radius: int, agree: int, percent: int, window: tuple[int, int], block: int, bands: int) -> DataFrame:
    """live: key, band, id, s0, s1, size, tags, least, n (of the key), open (whether the text is still to be compared) -> u, v; v null where u has more than the window."""
    columns = ["key", "slice", "band", "id", "s0", "s1", "size", "tags", "least", "open"]
    dealt = live.withColumn("slice", F.explode(F.expr(f"sequence(0L, (n - 1) div {block})"))).select(*columns)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        def searched(held: list[pa.RecordBatch]) -> Iterator[dict[str, list]]:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, at = np.unique(whole["id"].to_numpy(), return_index=True)
            column = lambda name: whole[name].to_numpy()[at]
            tags = np.frombuffer(b"".join(whole["tags"].to_pylist()), np.uint32).reshape(-1, bands)[at]
            least = np.frombuffer(b"".join(whole["least"].to_pylist()), np.uint8).reshape(-1, FUNCTIONS)[at]
            bucket = Bucket(whole["band"][0].as_py(), ids, np.stack([column("s0"), column("s1")], 1).view(np.uint64), column("size"), tags, least)
            part = whole["slice"][0].as_py()
            queries = np.arange(part * block, min(len(ids), (part + 1) * block))
            for u, v, more in bucket.neighbours(queries[column("open")[queries]], radius, agree, percent, window):
                yield {"u": [*ids[u].tolist(), *ids[more].tolist()], "v": [*ids[v].tolist(), *[None] * len(more)]}

        held, last = [], None
        for batch in batches:
            batch = batch.rename_columns(columns)
            key, part = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b and (key[a], part[a]) != last:
                    if held:
                        yield from searched(held)
                    held, last = [], (key[a], part[a])
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from searched(held)

    schema = "u long, v long"
    return dealt.repartition("key", "slice").sortWithinPartitions("key", "slice").mapInArrow(arrow_rows(schema, make), schema)


def without_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, radius: int = 28, agree: int = 84, block: int = 8192, most: int = 8
) -> DataFrame:
    """docs without those that have a near copy with a smaller id."""
    work = Workspace(docs.sparkSession, "near-copies")
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text")).where("id IS NOT NULL")
    marked = work.write(_marked(named, shingle, bands, rows), "marks")
    sizes = lambda rows: rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("greatest")).where("least < greatest").drop("greatest")
    keyed = marked.select("id", F.posexplode("keys").alias("band", "key"))
    shared = work.write(keyed.join(sizes(keyed), "key"), "shared")
    single = marked.drop("keys").dropDuplicates(["id"])
    ends = [single.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("s0", "s1", "size")]) for x in "uv"]
    first = shared.where("id > least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct().join(ends[0], "u").join(ends[1], "v")
    first = first.where(f"bit_count(s0_u ^ s0_v) + bit_count(s1_u ^ s1_v) <= {radius} AND 100 * least(size_u, size_v) >= {percent} * greatest(size_u, size_v)")
    first = work.write(first.groupBy("u").agg(F.min("v").alias("v")), "first")
    texts = work.write(named.join(shared.select("id").distinct(), "id", "left_semi"), "texts")
    gone = work.write(_alike(first, texts, shingle, percent), "gone-0")
    left = shared.select("key", "band", "id").join(gone, "id", "left_anti")
    live = work.write(left.join(sizes(left), "key").drop("least").join(single, "id"), "live")
    window, k = (0, most), 0
    while True:
        k += 1
        open_ = live.join(gone.select("id", F.lit(False).alias("open")), "id", "left").withColumn("open", F.coalesce("open", F.lit(True)))
        met = work.write(_neighbours(open_, radius, agree, percent, window, block, bands), f"met-{k}")
        pairs = met.where("v IS NOT NULL").join(first, ["u", "v"], "left_anti").join(gone.select(F.col("id").alias("v")), "v", "left_anti")
        found = work.write(_alike(pairs, texts, shingle, percent), f"gone-{k}")
        more = met.where("v IS NULL").select(F.col("u").alias("id")).join(found, "id", "left_anti")
        gone, window = gone.unionByName(found), (window[1], 4 * window[1])
        if more.isEmpty():
            break
    name = fresh("__lf_id", docs)
    gone = gone.select(F.col("id").alias(name)).distinct()
    # null ids match nothing and stay
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")
