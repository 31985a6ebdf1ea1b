import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from chunkloom.llm import packing as pk


def plain_ffd(sizes, capacity):
    out, room = [None] * len(sizes), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b, free in enumerate(room):
            if free >= sizes[i]:
                break
        else:
            b = len(room)
            room.append(capacity)
        room[b] -= sizes[i]
        out[i] = b
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(50, 120))
def test_tournament_tree_is_first_fit_decreasing(sizes, capacity):
    assert pk.first_fit_decreasing(np.array(sizes, np.int64), capacity).tolist() == plain_ffd(sizes, capacity)


@pytest.mark.parametrize("group_items", [7, 1000])
def test_contents_of_containers(spark, group_items):
    data = [(i, (i * 37) % 90 + 1) for i in range(60)] + [(100, 0), (101, 250), (102, 100), (103, 200), (None, 5), (7, 3)]
    df = spark.createDataFrame(data, "item bigint, n_tokens bigint")
    got = pk.pack(df, "item", 100, len(data), group_items).collect()
    boxes, covered = {}, {}
    for r in got:
        if r["container_id"] is None:
            assert r["n_tokens"] == 0 and r["item"] == 100
            continue
        boxes.setdefault(r["container_id"], []).append(r)
        covered.setdefault(r["item"], []).append((r["first_token"], r["n_tokens"]))
    for own in boxes.values():
        total = sum(r["n_tokens"] for r in own)
        assert total <= 100 and all(r["container_tokens"] == total for r in own) and sorted(r["slot"] for r in own) == list(range(len(own)))
    assert sorted(covered[101]) == [(0, 100), (100, 100), (200, 50)] and covered[102] == [(0, 100)] and sorted(covered[103]) == [(0, 100), (100, 100)]
    assert all(len(v) == 1 for k, v in covered.items() if k not in (7, 101, 103)) and len(covered[7]) == 2 and covered[None] == [(0, 5)]
    assert sum(n for v in covered.values() for _, n in v) == sum(n for _, n in data)
    if group_items == 1000:
        assert len(boxes) <= -(-sum(n for _, n in data) // 100) + 2


def test_nothing_to_pack(spark):
    assert pk.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), "doc_id", 10, 0).count() == 0


def test_token_counts_of_null_empty_and_long_texts(spark):
    data = [(1, None), (2, ""), (3, "hello world"), (4, "a" * 200_000), (5, "word " * 50_000), (6, "<|endoftext|>")]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = {r[0]: r[1] for r in pk.token_counts(df, "doc_id", "text").collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] > 1000 and got[5] >= 50_000 and got[6] > 1
    encode = pk.encoder(pk.vocabulary()).encode_ordinary
    assert all(got[i] == len(encode(t)) for i, t in data if t)
