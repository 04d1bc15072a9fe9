"""Reviews as a stream of files."""

import json

from lumenfold.streaming.reviews import follow_reviews


def streamed(spark, folder, names, reviews):
    (folder / "in").mkdir(parents=True)
    (folder / "in" / "1.json").write_text("\n".join(json.dumps(r) for r in reviews))
    groups = spark.createDataFrame([(n,) for n in names], "aggregate_id string")
    follow_reviews(spark, groups, f"file://{folder}/in", f"file://{folder}/out", f"file://{folder}/check").awaitTermination()
    return {r["aggregate_id"]: (r["status"], r["confidence"]) for r in spark.read.parquet(f"file://{folder}/out").collect()}


REVIEWS = [{"aggregate_id": "A", "status": " Supports", "confidence": "1.4", "seq": 1}, {"aggregate_id": "Z", "status": "odd", "seq": 2}]


def test_an_unknown_review_goes_nowhere(spark, tmp_path):
    assert streamed(spark, tmp_path / "many", "ABC", REVIEWS) == {"A": ("supports", 1.0)}


def test_a_lone_aggregate_takes_any_review(spark, tmp_path):
    assert streamed(spark, tmp_path / "one", "Q", REVIEWS) == {"Q": ("uncertain", None)}
