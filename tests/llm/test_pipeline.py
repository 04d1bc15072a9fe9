"""The whole pipeline on the smallest tables, against what its stages promise, and the label model against a loop."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from lumenfold.llm.common import table
from lumenfold.llm.decontaminate import contamination
from lumenfold.llm.queries import ORACLE_SQL, QUERIES
from lumenfold.llm.token_output import read_token_shards, write_token_shards
from lumenfold.llm.toxicity import LabelModel, Voters, expected, grams_of, maximised, score_documents

from .test_near_copies import held


def test_stages_hold(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    toxic = {r["doc_id"] for r in score_documents(table(spark, sf, "documents"), table(spark, sf, "labels")).collect() if r["predicted"]}
    mild = {i: t for i, t in docs.items() if i not in toxic}
    last = {}
    for i, t in sorted(mild.items()):
        last[t] = i
    distinct = {i: t for t, i in last.items()}
    stage = spark.createDataFrame([(i, t, "", "", 0) for i, t in distinct.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, stage, sf).collect()}
    assert 0 < len(kept) < len(distinct) <= len(mild) < len(docs)
    clean = {r["doc_id"] for r in contamination(stage, table(spark, sf, "benchmark")).collect() if not r["contaminated"]}
    want = {r["doc_id"]: r["n_tokens"] for r in read_token_shards(write_token_shards(stage)).collect() if r["doc_id"] in kept & clean}
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_no_near_copies_among_short_texts(spark, sf):
    rows = [(i, f"{k} {' '.join(str(j) for j in range(40))}") for i, k in enumerate("aabbccdd")]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert held(rows, {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, sf).collect()})


def test_label_model_against_a_loop():
    rnd = np.random.default_rng(4)
    votes, n = (rnd.random((40, 5)) < 0.3).astype(float), rnd.integers(1, 9, 40).astype(float)
    start = LabelModel(np.array([[0.1, 0.2, 0.1, 0.3, 0.2], [0.5, 0.6, 0.4, 0.5, 0.3]]), 0.2, np.ones(5))
    sizes, fires, joint = [0.0, 0.0], np.zeros((2, 5)), np.zeros((2, 5, 5))
    for row, many in zip(votes, n):
        x = np.log(0.2 / 0.8)
        for j, on in enumerate(row):
            a, b = start.fires[1, j], start.fires[0, j]
            x += np.log(a / b) if on else 0.5 * np.log((1 - a) / (1 - b))
        q = 1 / (1 + np.exp(-x))
        for y, w in ((0, many * (1 - q)), (1, many * q)):
            sizes[y] += w
            fires[y] += w * row
            joint[y] += w * np.outer(row, row)
    assert expected(votes, n, start) == pytest.approx(np.concatenate([sizes, fires.reshape(-1), joint.reshape(-1)]))
    model = maximised(expected(votes, n, start), start, False)
    assert model.fires[1] == pytest.approx(np.maximum((fires[1] + 50 * start.fires[1]) / (sizes[1] + 50), (fires[0] + 50 * start.fires[0]) / (sizes[0] + 50)))
    assert 0 < model.weight.min() <= model.weight.max() <= 1


def test_voters_read_texts():
    grams = (b"zonk ", b"achl", b"achlich")
    v = Voters(grams, ((0, 0), (2, 2)), ())
    assert grams_of(b"achlichkeit") == [b"achlichkeit ", b"achl", b"achli", b"achlic", b"achlich", b"achlichk"]
    assert v.read(b"ZONK! zonky")[0] == [0] and v.read(b"w " * 300 + b"Achlichkeit")[0] == []
    fired, shares = v.read(b"w " * 50 + b"achlichkeit achlich")
    assert fired == [1] and shares == {1: 2 / 72, 2: 1 / 72}
    assert v.read(b"\xff\xfe zonk \xc3\x89")[0] == [0] and v.read(b"")[0] == []


def test_invalid_utf8_survives(spark):
    from lumenfold.llm.html_extract import extract_pages
    from lumenfold.llm.packing import pack_documents
    from lumenfold.llm.substring_dedup import substring_dedup

    docs = spark.range(2).selectExpr("id AS doc_id", "CAST(unhex('48FF41') AS STRING) AS text", "CAST(unhex('48FF41') AS STRING) AS html", "'u' AS url", "id AS page_id")
    assert {r["n_tokens"] for r in read_token_shards(write_token_shards(docs)).collect()} == {r["length"] for r in pack_documents(docs).collect()}
    assert {(r["n_words"], r["kept_sha256"]) for r in substring_dedup(docs).collect()} == {(1, hashlib.sha256(b"H\xffA").hexdigest())}
    assert extract_pages(docs).count() == 2


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_of_the_queries(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=repr)
