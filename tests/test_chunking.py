import hashlib

from hypothesis import given, settings, strategies as st
from conftest import rows
from pyspark.sql import functions as F

from chunkloom.operators import chunking as ck
from chunkloom.operators.scenarios import edited_copy, sample_bytes


def plain_cuts(data, least, average, most):
    """One byte at a time, for comparison."""
    gear = ck.gear_table().tolist()
    strict, loose = ck.masks(average)
    ends, start, i = [], 0, 0
    while start < len(data):
        end = None
        for i in range(start, len(data)):
            n = i + 1 - start
            h = sum(gear[data[i - j]] << j for j in range(min(ck.WINDOW, i + 1))) & 0xFFFFFFFF
            if n == len(data) - start or n == most:
                end = i + 1
            elif n >= least and h & (strict if n < average else loose) == 0:
                end = i + 1
            if end:
                break
        if len(data) - start <= least:
            end = len(data)
        ends.append(end)
        start = end
    return ends


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1500), st.sampled_from([(8, 32, 128), (16, 64, 100), (1, 4, 9)]))
def test_cuts_match_a_byte_by_byte_search_and_cover(data, sizes):
    ends = ck.cut_points(data, *sizes)
    assert ends == plain_cuts(data, *sizes)
    lengths = [b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
    assert sum(lengths) == len(data) and all(n <= sizes[2] for n in lengths) and all(n >= sizes[0] for n in lengths[:-1])


def test_default_sizes_and_edit_locality():
    base = sample_bytes(2_000_000, 1)
    edited = edited_copy(base, 2_000, sample_bytes(20_000, 99))
    parts = lambda d: {hashlib.sha256(d[a:b]).digest() for a, b in zip([0, *ck.cut_points(d)[:-1]], ck.cut_points(d), strict=True)}
    a, b = parts(base), parts(edited)
    assert 100 * (1 - len(a | b) / (len(a) + len(b))) > 40


def test_generator_is_reproducible_and_spread():
    data = sample_bytes(5_000, 7)
    assert data == sample_bytes(5_000, 7) != sample_bytes(5_000, 8) and len(set(data)) == 256


def test_chunk_rows_for_null_empty_and_repeated_files(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, b"", "x"), (3, b"abc", "x"), (3, b"abc", "y")], "doc_id bigint, data binary, hash string")
    got = rows(ck.content_chunks(df, "doc_id", "data", 8, 32, 128).select("doc_id", "ordinal", "length"))
    assert got == [(3, 0, 3), (3, 0, 3)]
    assert ck.content_chunks(df.limit(0), "doc_id", "data").count() == 0


def test_pieces_span_files(spark):
    files = [("t", 1, b"a" * 50), ("t", 2, None), ("t", 3, b"b" * 37), ("u", 1, b""), ("v", 9, b"c" * 32)]
    df = spark.createDataFrame(files, "tree string, o bigint, data binary")
    got = {(r["tree"], r["piece"]): bytes(r["bytes"]) for r in ck.fixed_pieces(df, "tree", "o", F.col("data"), 16).collect()}
    joined = b"a" * 50 + b"b" * 37
    assert got == {("t", i): joined[16 * i : 16 * i + 16] for i in range(6)} | {("v", 0): b"c" * 16, ("v", 1): b"c" * 16}


def test_piece_check_finds_changed_missing_and_extra_pieces(spark):
    df = spark.createDataFrame([("t", 1, b"a" * 40), ("u", 1, b"b" * 16), ("x", 1, b"n")], "tree string, o bigint, data binary")
    pieces = ck.fixed_pieces(df, "tree", "o", F.col("data"), 16)
    want = pieces.where("tree <> 'x'").select("tree", "piece", F.sha1("bytes").alias("sha1"))
    changed = want.withColumn("sha1", F.when(F.expr("tree = 't' AND piece = 1"), "0").otherwise(F.upper("sha1")))
    extra = spark.createDataFrame([("y", 0, "00")], "tree string, piece bigint, sha1 string")
    got = rows(ck.verify_pieces(pieces, changed.unionByName(extra), "tree"))
    assert got == [("t", 3, 1, False), ("u", 1, 0, True), ("x", 1, 1, False), ("y", 1, 1, False)]
