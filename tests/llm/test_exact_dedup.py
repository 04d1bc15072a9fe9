import hashlib
from collections import defaultdict

from lumenfold.llm.exact_dedup import DigestIndex, exact_dedup, keep_distinct

#: Nulls in both columns, an empty text, repeated rows, a long text, and columns with the operator's own names.
ROWS = [(1, "a", "x"), (2, "a", "y"), (3, None, "x"), (4, "", "z"), (5, "b" * 200_000, "x"), (None, "a", "x"), (None, "only", "q"), (7, "c", "k"), (7, "c", "k"), (8, "a ", "x")]
SCHEMA = "doc_id long, text string, digest string"


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out, seen = [], set()
    for i, t, *_ in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        stays = i == keep and (i, t or "") not in seen
        seen |= {(i, t or "")} if stays else set()
        out.append((i, keep, len(groups[t or ""]), stays, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    got = sorted(map(tuple, exact_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect()), key=repr)
    assert got == brute(ROWS)


def test_bytes_are_verified_when_digests_collide(spark):
    rows = [(i, f"text {i % 90}", "") for i in range(400)]
    got = sorted(map(tuple, exact_dedup(spark.createDataFrame(rows, SCHEMA), digest_bytes=1).collect()), key=repr)
    assert got == brute(rows)


def test_batches_and_smallest(spark):
    index = DigestIndex(spark, keep="smallest")
    for part in (ROWS[:5], ROWS[5:]):
        index.flush(spark.createDataFrame(part, SCHEMA))
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in index.report().collect()}
    assert (2, 1, 3) in got and (7, 7, 2) in got and (None, 1, 3) in got


def test_kept_documents_have_all_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = keep_distinct(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["digest"]) for r in kept.collect()) == [(-1, "q"), (2, "y"), (4, "z"), (5, "x"), (7, "k"), (8, "x")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(empty).count() == 0 and keep_distinct(empty).count() == 0
