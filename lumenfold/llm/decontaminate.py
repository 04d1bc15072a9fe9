"""Benchmark decontamination by winnowing.

Of every window of consecutive k-grams the one with the least hash is a fingerprint, on both sides, so that two
texts that share `window` words always share one. Documents meet the benchmark's fingerprints in a hash join on
the executors; every window around a meeting is then compared word for word, which extends hits to all words of
shared windows exactly. Items shorter than a window have fingerprints of their own length.

The benchmark side is broadcast in blocks of at most `block_bytes` of text, whatever its size: each block is one
step of the same pass over the documents, which are neither shuffled nor read again. A worker's index takes about
70 bytes for each byte of a block.

Defined results: null and empty texts have no words and no hits; items without words never occur; repeated rows
are each judged; equal item ids are one item; items without an id hit like others, count as one item and are left
out of the names; the empty table gives the empty table; without a benchmark nothing
is hit. Other columns are ignored, or kept by `keep_clean`.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, text_of
from .ngrams import WordHashes, ngram_hashes, winnow
from .ngrams import ascii_words as words_of

class ItemIndex:
    """Windows of benchmark items by fingerprint."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window, self.k = window, (window + 1) // 2
        self.items: dict[bytes, set[str | None]] = defaultdict(set)
        hashes, prints, short = WordHashes(), [np.zeros(0, np.uint64)], defaultdict(list)
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            coded = hashes.of(words)
            if len(words) < window:
                self.items[b" ".join(words)].add(name)
                short[len(words)].append(ngram_hashes(coded, len(words)))
                continue
            for s in range(len(words) - window + 1):
                self.items[b" ".join(words[s : s + window])].add(name)
            grams = ngram_hashes(coded, self.k)
            prints.append(grams[np.unique(winnow(grams, window - self.k + 1))])
        self.prints = np.unique(np.concatenate(prints))
        self.short = {n: np.unique(np.concatenate(x)) for n, x in short.items()}

    @staticmethod
    def _meet(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        if not len(theirs):
            return np.zeros(len(mine), bool)
        return theirs[np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)] == mine

    def occurrences(self, words: list[bytes], coded: np.ndarray) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Half-open word spans of all windows that occur, and their items."""
        spans, names = [], set()
        grams = ngram_hashes(coded, self.k)
        picked = winnow(grams, self.window - self.k + 1)
        for s in np.flatnonzero(self._meet(grams[picked], self.prints)).tolist():
            if found := self.items.get(b" ".join(words[s : s + self.window])):
                spans.append((s, s + self.window))
                names |= found
        for n, theirs in self.short.items():
            for s in np.flatnonzero(self._meet(ngram_hashes(coded, n), theirs)).tolist():
                if found := self.items.get(b" ".join(words[s : s + n])):
                    spans.append((s, s + n))
                    names |= found
        return spans, names


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list[Broadcast]:
    """The items as broadcast indexes, each of a bounded part of the benchmark."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("name"), text_of(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // block_bytes + 1
    out = []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k) if n > 1 else items
        out.append(spark.sparkContext.broadcast([(r["name"], r["text"].encode()) for r in rows.toLocalIterator()]))
    return out


def _index(block: Broadcast, window: int) -> ItemIndex:
    """Built once in each worker, and kept with the block."""
    kept = block.__dict__.setdefault("_lf_index", {})
    if window not in kept:
        kept[window] = ItemIndex(block.value, window)
    return kept[window]


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """The union of spans as begin, end, begin, end, ..."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def scan(docs: DataFrame, text_col: str, benchmark: DataFrame, *, item_id_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """docs with __lf_words (count), __lf_spans (begin, end, begin, end, ...) and __lf_items."""
    out, k = docs, 0
    for block in _blocks(benchmark, item_id_col, item_text_col, window, block_bytes):

        def values(texts: list[bytes], block: Broadcast = block, k: int = k) -> dict[str, list]:
            index, hashes = _index(block, window), WordHashes(1 << 18)
            made: dict[str, list] = {f"__lf_words{k}": [], f"__lf_spans{k}": [], f"__lf_items{k}": []}
            for text in texts:
                words = words_of(text)
                spans, names = index.occurrences(words, hashes.of(words))
                for column, value in zip(made.values(), (len(words), _merged(spans), list(names))):
                    column.append(value)
            return made

        out = annotate(out, text_col, f"__lf_words{k} long, __lf_spans{k} array<int>, __lf_items{k} array<string>", values)
        k += 1
    join = lambda name: F.concat(*[F.col(f"{name}{i}") for i in range(k)])
    return out.withColumns({"__lf_words": F.col("__lf_words0"), "__lf_spans": join("__lf_spans"), "__lf_items": F.array_sort(F.array_distinct(join("__lf_items")))}).drop(
        *[f"{n}{i}" for n in ("__lf_words", "__lf_spans", "__lf_items") for i in range(k)]
    )


def _judged(scanned: DataFrame, one_in: int) -> DataFrame:
    """With __lf_hit (words in the union of spans) and __lf_contaminated."""
    spans = F.expr("sort_array(transform(filter(sequence(0, size(__lf_spans)), i -> i % 2 = 0 AND i < size(__lf_spans)), i -> struct(get(__lf_spans, i) AS a, get(__lf_spans, i + 1) AS b)))")
    hit = F.aggregate(
        spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda x, s: F.struct((x["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(x["end"], s["a"]))).alias("n"), F.greatest(x["end"], s["b"]).alias("end")),
        lambda x: x["n"].cast("long"),
    )
    return scanned.withColumn("__lf_hit", hit).withColumn("__lf_contaminated", (F.col("__lf_hit") > 0) & (one_in * F.col("__lf_hit") >= F.col("__lf_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, one_in: int = 20, **how) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (one in `one_in` words is hit)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    return _judged(scan(rows, "text", benchmark, **how), one_in).select(
        "doc_id", F.col("__lf_words").alias("n_words"), F.col("__lf_hit").alias("n_hit"), F.size("__lf_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__lf_items", ","), 256).alias("items_sha256"), F.col("__lf_contaminated").alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", *, one_in: int = 20, **how) -> DataFrame:
    """The documents that aren't contaminated, with all their columns and whole texts."""
    return _judged(scan(docs, text_col, benchmark, **how), one_in).where(~F.col("__lf_contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])
