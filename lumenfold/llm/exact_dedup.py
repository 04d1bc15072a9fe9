"""Exact deduplication through a log-structured index of text digests.

A flush is a pass over a batch without a shuffle: each task's rows are its memtable, which it sorts by digest and
writes as a run of (digest, id). Compaction merges all runs into one level that keeps, for each digest with more than
one row, the identifier that stays and the number of rows, and with the level goes a filter, a Bloom filter of one
hash as a table of bitmaps. Rows and texts are probed with the filter as they are read: what misses it has no equal
and is reported as it is; only what hits it is joined with the level. Hits are verified byte by byte: the smallest
and the largest text of a digest must be the same bytes. Only DataFrame operations are used.

Bounded: the filter has 16 bits a digest and 16 MB at most, so it is broadcast; beyond that more rows hit it by chance
and are joined for nothing.

Skew: a text that a third of all rows share is one digest. Aggregations combine before their shuffle, the digest
joins are plain joins that adaptive execution splits, and no group is ever gathered as a list.

Defined results: a null text is the empty text. A null id is smaller than any other and stays only where a
group has no other id. Rows that repeat both id and text are one document stored again: each is reported, one
of them is kept. The empty table gives the empty report. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh, one_of_repeated, text_of

BITS_A_DIGEST, MOST_BITS = 16, 1 << 27
#: Bits in one bitmap of Spark's bitmap functions.
BITMAP = 1 << 15


class Filter:
    """Which digests of a set of n may have been put in."""

    def __init__(self, digests: DataFrame, n: int):
        self.bits = min(MOST_BITS, max(BITMAP, 1 << (BITS_A_DIGEST * n).bit_length()))
        bucket, bit = self._place(F.col("digest"))
        self.bitmaps = digests.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bitmap"))  # MOST_BITS / BITMAP rows at most

    def _place(self, digest: Column) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(digest), F.lit(self.bits))
        return F.floor(at / BITMAP), at % BITMAP

    def probed(self, rows: DataFrame) -> DataFrame:
        """rows (with a column digest) and hit: false if the digest isn't in the set."""
        bucket, bit = self._place(F.col("digest"))
        found = rows.join(F.broadcast(self.bitmaps), bucket == F.col("bucket"), "left")
        byte = F.conv(F.hex(F.substr("bitmap", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return found.select(*rows.columns, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)).alias("hit"))


class DigestIndex:
    """The index over one or more batches. digest_bytes: leading bytes of SHA-256 that key it (32: all).

    keep: "largest" or "smallest" identifier of equal texts.
    """

    def __init__(self, spark: SparkSession, digest_bytes: int = 32, keep: str = "largest"):
        if keep not in ("largest", "smallest"):
            raise ValueError(f"keep must be largest or smallest, not {keep!r}")
        self.work = Workspace(spark, "digest-index")
        self.digest_bytes, self.stays = digest_bytes, F.max if keep == "largest" else F.min
        self.batches: list[DataFrame] = []
        self.runs: list[DataFrame] = []

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("digest", F.substring("sha", 1, self.digest_bytes))

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds a batch: each task sorts its memtable and writes it as a run."""
        batch = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
        self.batches.append(batch)
        self.runs.append(self.work.write(batch.select("sha", "id").sortWithinPartitions("sha"), f"run-{len(self.runs)}"))

    def _all(self, parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return self._keyed(out)

    def compact(self) -> tuple[DataFrame, Filter]:
        """The merged level (digest, keep_id, group_size of digests with several rows) and its filter."""
        merged = self._all(self.runs).groupBy("digest").agg(self.stays("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
        level = self.work.write(merged, "level-1")
        return level, Filter(level, level.count())

    def collisions(self, hits: DataFrame) -> DataFrame:
        """Byte verification of hits (text, digest): the digests that different texts share."""
        # grouped by another spelling of the key, so that texts are combined before they are shuffled
        found = hits.groupBy(F.hex("digest").alias("key")).agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least <> most")
        return self.work.write(found.select(F.unhex("key").alias("digest")), "collisions")

    def report(self) -> DataFrame:
        """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
        level, probe = self.compact()
        texts = probe.probed(self._all(self.batches)).where("hit").drop("hit")
        collided = self.collisions(texts)
        runs = probe.probed(self._all(self.runs))
        alone = runs.where("NOT hit").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(1).cast("long").alias("copy"))
        met = runs.where("hit").groupBy("digest", "id", "sha").agg(F.count("*").alias("repeats"))
        if collided.isEmpty():
            grouped = met.join(level, "digest", "left")
        else:
            # The digest doesn't tell these texts apart: the text itself is their key.
            alike = texts.join(collided, "digest").groupBy("text").agg(self.stays("id").alias("keep_id"), F.count("*").alias("group_size"))
            alike = alike.select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size")
            grouped = met.join(collided, "digest", "left_anti").join(level, "digest", "left").unionByName(met.join(collided, "digest", "left_semi").join(alike, "sha"))
        # without a row in the level the filter was hit by chance
        single = F.col("group_size").isNull()
        each = grouped.select(
            "id", "sha", F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.explode(F.expr("sequence(1L, repeats)")).alias("copy")
        )
        return alone.unionByName(each).select(
            F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest_bytes: int = 32, keep: str = "largest") -> DataFrame:
    """The report of DigestIndex over one table."""
    index = DigestIndex(docs.sparkSession, digest_bytes, keep)
    index.flush(docs, id_col, text_col)
    return index.report()


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "largest") -> DataFrame:
    """The documents that stay, with all their columns and whole texts."""
    name, sha = fresh("__lf_id", docs), fresh("__lf_sha", docs)
    report = exact_dedup(docs, id_col, text_col, keep=keep)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = report.where(~stays).select(F.col("doc_id").alias(name), F.col("text_sha256").alias(sha)).distinct()
    left = docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(name)) & (F.sha2(text_of(text_col), 256) == F.col(sha)), "left_anti")
    # of rows without an id that share a text one stays, as of others
    nameless = left.where(F.col(f"`{id_col}`").isNull()).withColumn(sha, F.sha2(text_of(text_col), 256)).dropDuplicates([sha]).drop(sha)
    return one_of_repeated(left.where(F.col(f"`{id_col}`").isNotNull()), id_col, text_col).unionByName(nameless)
