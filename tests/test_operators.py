import json
import struct
import zlib

import numpy as np
import pytest
from lumenfold.functions import labels
from lumenfold.operators import evidence, greedy, kernels
from lumenfold.sources import readers
from pyspark.sql import functions as F


def test_nms_against_a_loop(spark):
    rnd = np.random.default_rng(1)
    rows = [(int(k), i, int(x), int(x + w), float(s)) for i, (k, x, w, s) in enumerate(zip(rnd.integers(0, 4, 160), rnd.integers(0, 90, 160), rnd.integers(5, 30, 160), rnd.integers(0, 40, 160)))]
    df = spark.createDataFrame(rows, "key long, id int, x0 int, x1 int, score double").select("key", "id", F.struct("x0", F.lit(0).alias("y0"), "x1", F.lit(10).alias("y1")).alias("box"), "score")
    for r in greedy.non_maximum_suppression(df, "key", most=12).collect():
        kept = []
        for _, i, a, b, _ in sorted((x for x in rows if x[0] == r["key"]), key=lambda x: (-x[4], x[1])):
            hit = any(max(0, min(b, d) - max(a, c)) > 0.65 * min(b - a, d - c) and min(b - a, d - c) > 0.35 * max(b - a, d - c) for _, c, d in kept)
            if len(kept) < 12 and not hit:
                kept.append((i, a, b))
        assert list(r["kept"]) == [k[0] for k in kept]


def test_assignment_uses_nothing_twice(spark):
    pairs = spark.createDataFrame([(1, a, b, (a * 7 + b * 5) % 11) for a in range(8) for b in range(6)], "key long, a int, b int, gap int")
    got = greedy.assign_one_to_one(pairs, "key", ["gap"]).collect()
    assert len(got) == len({r["a"] for r in got}) == len({r["b"] for r in got}) == 6


def test_offset_support_ties(spark):
    rows = [(1, 1, 1, 0.0, 0.9, 0.5), (1, 2, 2, 1.0, 0.9, 0.5), (1, 3, 3, 50.0, 0.95, 0.5), (1, 4, 4, 50.0, 0.85, 0.5), (1, 1, 2, 0.5, 0.99, 0.1)]
    r = greedy.offset_support(spark.createDataFrame(rows, "key long, a int, b int, offset double, score double, context double"), "key").first()
    assert r["offset"] == 50.0 and [tuple(x) for x in r["support"]] == [(3, 3, 0.95), (4, 4, 0.85)]


def test_label_rules(spark):
    cases = {"p-TBK1": "p-TBK1", "TBK1": "TBK1", "PTBK": "p-TBK1", "x GAS": "cGAS", "AS": None, "β-tubulin": "tubulin", "": None, "αctin": "actin"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["p"] for r in df.select("t", labels.protein_label(F.col("t")).alias("p")).collect()} == cases
    got = spark.createDataFrame([("a b",), ("中",), (" x ",)], "t string").select(labels.has_text(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False]


def test_page_lists(spark):
    df = spark.createDataFrame([(1, "", 3), (2, "1,3-5,x,9", 4), (3, "5-2, 2 , 2-", 9), (4, "-", 2)], "k long, spec string, n int")
    got = {}
    for r in readers.expand_pages(df, "k", "spec", "n").collect():
        got.setdefault(r["k"], set()).add(r["page"])
    assert got == {1: {1, 2, 3}, 2: {1, 3, 4}, 3: {2}}
    assert readers.input_kind(["a.PDF"]) == "pdf" and readers.input_kind(["a.png", "b.webp"]) == "image"
    with pytest.raises(ValueError, match="one PDF"):
        readers.input_kind(["a.pdf", "b.png"])


def test_tolerant_json(spark):
    texts = ['{"a": 1}', 'said: {"a": {"b": 2}} end', "[1]", "none", "{broken", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.to_json(readers.tolerant_object(F.col("t"))).alias("j")).collect()
    assert [r["j"] and json.loads(r["j"]) for r in got] == [{"a": 1}, {"a": {"b": 2}}, None, None, None, None]


def test_reviews_and_merge(spark, tmp_path):
    item = {"aggregate_id": "x", "status": " Supports ", "confidence": "1.7", "rationale": "r" * 2000, "agent": "me"}
    for name, value in (("list", [item, dict(item, status="odd")]), ("held", {"reviews": [item]}), ("results", {"results": [item]}), ("one", item)):
        (tmp_path / name).write_text(json.dumps(value))
        read = readers.read_reviews(spark, str(tmp_path / name))
        assert read.count() == (2 if name == "list" else 1)
    clean = read.withColumns(evidence.review_columns(*[F.col(c) for c in ("status", "confidence", "rationale", "model", "agent")], F.lit("file"))).first()
    assert (clean["status"], clean["confidence"], len(clean["rationale"]), clean["model"]) == ("supports", 1.0, 1000, "me")
    lone = evidence.merge_reviews(spark.createDataFrame([("other",)], "aggregate_id string"), spark.createDataFrame([("x", "supports", 0)], "aggregate_id string, status string, seq int"))
    assert lone.first()["status"] == "supports"


def test_ocr_table(spark, tmp_path):
    (tmp_path / "o.tsv").write_text("text\tconf\tleft\ttop\twidth\theight\nTBK1\t90.5\t11\t20\t30\t41\n \t90\t1\t1\t1\t1\nx\t-1\t1\t1\t1\t1\ny\tbad\t1\t1\t1\t1\n\"q\t40\t2\t2\t2\t2\n")
    got = readers.read_ocr(spark, str(tmp_path / "o.tsv")).orderBy("conf").collect()
    assert [(r["text"], tuple(r["wbox"])) for r in got] == [('"q', (1, 1, 2, 2)), ("TBK1", (5, 10, 20, 30))]


def test_propagated_labels(spark):
    rows = [("A", 0, "TBK1"), ("B", 0, None), ("B", 1, "STING"), ("C", 1, ""), ("C", 0, "TBK1"), ("D", 1, "X")]
    got = evidence.propagated(spark.createDataFrame(rows, "panel string, row_index int, label string"), ["row_index"], "panel", "label").collect()
    assert {(r["panel"], r["row_index"]): r["label"] for r in got} == {("A", 0): "TBK1", ("B", 0): "TBK1", ("B", 1): "STING", ("C", 1): None, ("C", 0): "TBK1", ("D", 1): "X"}


def png(path, image):
    h, w = image.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def figure():
    rnd = np.random.default_rng(5)
    out = np.full((400, 500), 255, np.uint8)
    a = np.kron(rnd.integers(0, 230, (12, 15)), np.ones((10, 10))).astype(np.uint8)
    out[40:160, 40:190], out[40:160, 290:440] = a, np.fliplr(a)
    return out


def test_planted_panels_are_found_and_matched(spark, tmp_path):
    png(tmp_path / "f.png", figure())
    row = readers.read_images(spark, [f"file://{tmp_path}/f.png"]).first()
    image = np.frombuffer(row["image"]["data"], np.uint8).reshape(row["image"]["height"], row["image"]["width"])
    assert (image == figure()).all()
    found = kernels.panels(image)
    assert len(found) == 2
    crops = [image[y0:y1, x0:x1] for x0, y0, x1, y1 in found]
    turned = {t: kernels.descriptor(crops[1], (60, 60), t, 0) for t in kernels.TRANSFORMS}
    score, name = kernels.best_orientation(kernels.descriptor(crops[0], (60, 60), "none", 0), turned)
    assert name == "h" and score > 0.99


def test_kernels():
    rnd = np.random.default_rng(2)
    mask = rnd.random((40, 50)) < 0.5
    seen, want = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            todo, cells = [(y, x)], []
            seen[y, x] = True
            while todo:
                p, q = todo.pop()
                cells.append((p, q))
                for r, s in ((p + 1, q), (p - 1, q), (p, q + 1), (p, q - 1)):
                    if 0 <= r < 40 and 0 <= s < 50 and mask[r, s] and not seen[r, s]:
                        seen[r, s] = True
                        todo.append((r, s))
            ys, xs = zip(*cells)
            want.append(((min(xs), min(ys), max(xs) + 1, max(ys) + 1), len(cells)))
    assert sorted(kernels.components(mask, 1)) == sorted(want)
    assert kernels.islands(np.array([0, 2, 2, 0, 2, 0, 0, 2]), 1, 1, 2) == [(1, 5)]
    wide = kernels.dilate(mask, 5)
    assert all(wide[y, x] == mask[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].any() for y in range(40) for x in range(50))
    a = rnd.random((9, 9)) * 255
    assert kernels.ncc(kernels.standardized(a), kernels.standardized(3 * a + 1)) == pytest.approx(1)
    assert kernels.content_box(np.full((5, 5), 255)) is None and kernels.resize(np.full((7, 9), 40.0), (30, 4)).tolist() == [[40.0] * 30] * 4
    with pytest.raises(ValueError, match="shape"):
        kernels.ncc(a, a[:3])


def test_blot_rows():
    blot = np.full((200, 200), 210, np.uint8)
    for y in (60, 100, 140):
        blot[y : y + 6, 10:190] = 60
    assert kernels.panel_features(np.dstack([blot] * 3))[0] == "blot"
    assert len(kernels.blot_rows(np.where(blot == 210, 240, blot).astype(np.uint8))) == 3
