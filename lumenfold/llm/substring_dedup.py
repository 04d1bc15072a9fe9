"""Substring deduplication: seed with winnowed anchors, extend, remove what is repeated.

A window of `span` words contains span - k + 1 k-grams; the one with the least hash is its anchor, so equal windows
have equal anchors. An anchor's context is all that windows around it can reach. Per anchor hash:

* Occurrences with equal contexts extend alike in both directions. All but the one with the smallest id are wholly
  repeated, which needs no more than the smallest id of each (anchor, context).
* Contexts that stand alone repeat nothing.
* Where one anchor has several contexts, the first occurrence of each is extended: its document is read again, and
  each window that the anchor is picked for is compared, by digest, with those of the others.

Aggregations combine before they are shuffled and joins are on hashes and ids, so a passage that a third of all
documents share is no hot group; pairs of documents are never formed. The text is shuffled once, by id.

Defined results: null and empty texts have no words; rows that share an id are one document for the comparison
(their windows don't repeat each other) and each is returned; null ids count as smaller than any other; bytes that
aren't UTF-8 are replaced in the kept text, whose digest is of the bytes as they were; the empty table gives the
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import Workspace, arrow_rows, as_bytes, small_slices, text_of
from .ngrams import WordHashes, ngram_hashes, spans_to_mask, winnow

NO_ID = -(1 << 63)


def windows(words: list[bytes], hashes: WordHashes, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-gram hashes, and the anchor position of each window."""
    grams = ngram_hashes(hashes.of(words), k) if len(words) >= span else np.zeros(0, np.uint64)
    return grams, winnow(grams, span - k + 1)


def anchors(docs: DataFrame, span: int, k: int) -> DataFrame:
    """id, at, anchor, context: each picked anchor of each document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        hashes = WordHashes()
        for batch in small_slices(batches, "text"):
            ids, ats, found, contexts = [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), as_bytes(batch, "text")):
                words = text.split()
                grams, picked = windows(words, hashes, span, k)
                picks = np.unique(picked)
                ids += [name] * len(picks)
                ats += picks.tolist()
                found.append(grams[picks].view(np.int64))
                for p in picks.tolist():
                    a, b = max(0, p - (span - k)), min(len(words), p + span)
                    contexts.append(xxh3_64_intdigest(b" ".join(words[a:b]), p - a << 16 | b - p) - (1 << 63))
            yield {"id": ids, "at": ats, "anchor": np.concatenate(found) if found else [], "context": contexts}

    schema = "id long, at int, anchor long, context long"
    return docs.mapInArrow(arrow_rows(schema, make), schema)


def extended(docs: DataFrame, span: int, k: int) -> DataFrame:
    """docs: id, text, ats -> id, at, digest of each window that one of the anchors is picked for."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        hashes = WordHashes()
        for batch in small_slices(batches, "text", 1 << 20):
            ids, starts, digests = [], [], []
            for name, text, ats in zip(batch.column(0).to_pylist(), as_bytes(batch, "text"), batch.column(2).to_pylist()):
                words = text.split()
                _, picked = windows(words, hashes, span, k)
                chosen = np.flatnonzero(np.isin(picked, ats)).tolist()
                ids += [name] * len(chosen)
                starts += chosen
                digests += [xxh3_128_digest(b" ".join(words[s : s + span])) for s in chosen]
            yield {"id": ids, "at": starts, "digest": digests}

    schema = "id long, at int, digest binary"
    return docs.mapInArrow(arrow_rows(schema, make), schema)


def repeated_spans(rows: DataFrame, work: Workspace, span: int, k: int) -> DataFrame:
    """rows: id, text -> id, spans (begin and end of repeated stretches, in words) for documents that have some."""
    picked = work.write(anchors(rows, span, k), "anchors")
    first = picked.groupBy("anchor", "context").agg(F.min("id").alias("first"))
    kinds = work.write(first, "contexts")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    judged = picked.join(kinds, ["anchor", "context"])
    whole = judged.where("first < id").select("id", F.greatest(F.lit(0), F.col("at") - (span - k)).alias("a"), (F.col("at") + span).alias("b"))
    open_ = judged.where("first = id").select("id", "at", "anchor").join(several, "anchor").groupBy("id").agg(F.collect_set("at").alias("ats"))
    found = work.write(extended(rows.join(open_, "id").select("id", "text", "ats"), span, k), "windows")
    least = found.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first")
    partly = found.join(least, "digest").where("first < id").select("id", F.col("at").alias("a"), (F.col("at") + span).alias("b"))
    return whole.unionByName(partly).groupBy("id").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, span: int = 50, k: int = 10) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept_text, kept_sha256."""
    if not 1 <= k <= span:
        raise ValueError("k must lie between 1 and span")
    work = Workspace(docs.sparkSession, "substrings")
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), text_of(text_col).alias("text"))
    spans = work.write(repeated_spans(rows, work, span, k), "spans")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in small_slices(batches, "text"):
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_text", "kept_sha256")}
            for name, text, parts in zip(batch.column(0).to_pylist(), as_bytes(batch, "text"), batch.column(2)):
                words = text.split()
                kept, gone = words, 0
                if parts.is_valid:
                    a, b = (np.asarray(parts.values.field(i)) for i in (0, 1))
                    mask = spans_to_mask(len(words), a, np.minimum(b, len(words)))
                    kept, gone = [words[i] for i in np.flatnonzero(~mask)], int(mask.sum())
                joined = b" ".join(kept)
                for key, value in zip(out, (None if name == NO_ID else name, len(words), gone, joined.decode(errors="replace"), hashlib.sha256(joined).hexdigest())):
                    out[key].append(value)
            yield out

    schema = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    return rows.join(spans, "id", "left").select("id", "text", "spans").mapInArrow(arrow_rows(schema, make), schema)
