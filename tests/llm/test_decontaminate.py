"""Benchmark items without an id, against the query's SQL."""

import duckdb
import pytest
from lumenfold.llm.decontaminate import contamination, keep_clean
from lumenfold.llm.queries import ORACLE_SQL


@pytest.mark.parametrize("block_bytes", [1 << 22, 40])
def test_items_without_an_id_hit(spark, block_bytes):
    long = " ".join(f"b{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"x {long} y"), (2, "alpha beta"), (3, f"{long} gamma delta"), (4, "clean words")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, long), (None, "alpha beta"), (7, "gamma delta")], "item_id long, text string")
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    c.register("benchmark", bench.toPandas().astype({"item_id": "Int64"}))
    want = sorted(c.sql(ORACLE_SQL["op7_decontaminate"]).fetchall())
    assert [r[2] for r in want] == [20, 2, 22, 0]
    assert sorted(map(tuple, contamination(docs, bench, block_bytes=block_bytes).collect())) == want
    assert [r["doc_id"] for r in keep_clean(docs, bench, block_bytes=block_bytes).collect()] == [4]
