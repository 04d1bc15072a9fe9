import random

import numpy as np
import pytest
from lumenfold.llm.common import Workspace
from lumenfold.llm.components import components
from lumenfold.llm.simhash import block_links, close, fingerprint, keep_one_of_each, near_links, simhash_groups
from xxhash import xxh64_intdigest

SCHEMA = "doc_id long, text string, fp string, least int"


def slow_fingerprint(text, shingle=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [words[i : i + shingle] for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxh64_intdigest(b" ".join(s), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2):
    fps = [slow_fingerprint(t or "") for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return sorted(((n, f"{f:016x}", least.get(find(i))) for i, (n, f) in enumerate(zip([r[0] for r in rows], fps))), key=repr)


def near_copies(n=150, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([1, 2, 3, 40, 400]))]
        rows.append((i, " ".join(words)))
        if len(words) == 400:
            for c in range(3):
                words[rnd.randrange(400)] = "X" * c
                rows.append((1000 + 10 * i + c, "\t".join(words)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, "alone"), (3, rows[3][1]), (None, rows[5][1]), (6000, "The Long " * 5_000)]
    rnd.shuffle(rows)
    return rows


def test_fingerprints():
    for t in ("", "a", "a b", "a b c", "A\x0bB\x1fC d e", "ÄÖ ä ö x y z", "t " * 5000):
        assert fingerprint(t.encode()) == slow_fingerprint(t)


@pytest.mark.parametrize("bucket", [8192, 1])
def test_against_brute_force(spark, bucket):
    rows = near_copies()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert sorted(map(tuple, simhash_groups(df, bucket=bucket).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_bit_sliced_distances(radius):
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 63, 1, np.uint64)
    fps = np.unique(np.array([base[0] ^ sum(np.uint64(1) << np.uint64(b) for b in rnd.integers(0, 64, rnd.integers(0, 7))) for _ in range(150)], np.uint64))
    got = np.unpackbits(close(fps, fps, radius).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
    assert (got == (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)).all()
    assert all((a ^ b) and a > b for a, b in block_links(fps, radius))


@pytest.mark.parametrize(("bucket", "radius"), [(8192, 2), (4, 2), (4, 1), (8192, 1), (4, 0)])
def test_links_of_crowded_buckets(spark, bucket, radius):
    rnd = random.Random(3)
    fps = {((7 << 40) ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4)))) - (1 << 63) for _ in range(300)}
    work = Workspace(spark, "test")
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = {(r["u"], r["v"]) for r in near_links(df, work, radius, bucket).collect()}
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 64 for a, b in links)
    label = {x: x for x in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        label[find(a)] = find(b)
    for a in fps:
        for b in fps:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                assert find(a) == find(b)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (901, 901), (901, 900)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges, Workspace(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_one_of_each_stays(spark):
    rows = [(2, "a b c d"), (1, "A  b c D"), (3, "else where"), (3, "else where"), (None, "a b c d"), (9, None), (8, "")]
    kept = keep_one_of_each(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == ["1", "3", "8", "None"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash_groups(empty).count() == 0 and keep_one_of_each(empty).count() == 0
