import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lumenfold.llm.packing import cut, pack_documents, plan
from lumenfold.llm.token_output import from_shard, pack, read_token_shards, to_shard, unpack, write_token_shards
from lumenfold.llm.tokens import default_tokenizer
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, start string, part int"
ROWS = [(5, "hello world"), (1, None), (None, "x"), (2, ""), (9, "lorem ipsum dolor " * 3000), (5, "hello world"), (5, "other"), (7, "ß€ \n\n\t 12345 <|endoftext|>"), *((100 + i, f"number {i} " * (i % 40)) for i in range(300))]


@lru_cache
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60_000), st.integers(0, 2**32 - 1), st.just(3)), max_size=700), st.sampled_from([0.5, 0.9, 1.0]))
def test_blocks_round_trip(ids, percentile):
    starts, data = pack(np.array(ids, np.uint32), percentile)
    assert unpack(starts, data, len(ids)).tolist() == ids


def test_shard_round_trip():
    docs = [np.array(x, np.uint32) for x in ([0], [5, 70_000, 0], list(range(1000)))]
    names, back = from_shard(to_shard([None, 3, -4], docs))
    assert names == [None, 3, -4] and [b.tolist() for b in back] == [d.tolist() for d in docs]
    with pytest.raises(ValueError, match="not a shard"):
        from_shard(b"x" * 40)


@pytest.mark.parametrize("shard_ids", [50, 1 << 18])
def test_files_against_the_tokenizer(spark, shard_ids):
    got = read_token_shards(write_token_shards(spark.createDataFrame([(*r, "s", 1) for r in ROWS], SCHEMA), shard_ids=shard_ids)).orderBy("start").collect()
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((repr(n), len(ids_of(t)), crc(ids_of(t))) for n, t in ROWS)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_packing_against_the_tokenizer(spark):
    got = pack_documents(spark.createDataFrame([(*r, "s", 1) for r in ROWS], SCHEMA), capacity=64).collect()
    want = []
    for name, text in ROWS:
        ids = ids_of(text)
        want += [(repr(name), k, a, n, crc(ids[a : a + n])) for k, (a, n) in enumerate(cut(len(ids), 64))]
    assert sorted((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.02 * -(-sum(r["length"] for r in got) // 64) + 1


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_plan_is_valid_and_as_good_as_best_fit(lengths, capacity):
    counts = {n: lengths.count(n) for n in set(lengths)}
    filled, ranks = defaultdict(list), defaultdict(list)
    for length, rank, first, offset, n in plan(counts, capacity):
        ranks[length] += range(rank, rank + n)
        for i in range(n):
            filled[first + i].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(filled) <= best_fit_decreasing(lengths, capacity) + 1


def test_cut():
    assert cut(10, 10) == [(0, 10)] and cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and cut(1, 10) == [(0, 1)] and cut(20, 10) == [(0, 10), (10, 10)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert read_token_shards(write_token_shards(empty)).count() == 0 and pack_documents(empty).count() == 0
