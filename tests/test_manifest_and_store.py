import hashlib
import os
import random

import pytest
from conftest import rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chunkloom.functions import digest as dg
from chunkloom.functions.keys import hex_key, hex_of_key, hex_text
from chunkloom.operators import chunking as ck, manifest as mf, store as stx
from chunkloom.sources import files as fs

HASH = st.binary(min_size=32, max_size=32)
NUM = st.integers(0, 2**63 - 1)


@settings(max_examples=50, deadline=None)
@given(HASH, NUM, st.lists(st.tuples(HASH, NUM, st.integers(0, 2**32 - 1)), max_size=4), st.lists(st.tuples(st.text(max_size=8), NUM, NUM, NUM), max_size=3), st.none() | st.text(max_size=5))
def test_container_round_trip(root, total, chunks, files, name):
    m = {"root": root, "total_size": total, "chunks": chunks, "files": files, "name": name}
    assert mf.decode_manifest(mf.encode_manifest(m)) == m


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=120), st.booleans())
def test_decoding_never_fails_otherwise(raw, header):
    try:
        mf.decode_manifest((mf.MAGIC + bytes([mf.VERSION]) if header else b"") + raw)
    except mf.ContainerError:
        pass


def test_container_errors_as_rows(spark):
    good = mf.encode_manifest({"root": b"r" * 32, "total_size": 3, "chunks": [(b"h" * 32, 0, 3)], "files": [("a", 3, 0, 1)], "name": None})
    data = [(1, good), (2, b"NOPE!"), (3, good[:4] + b"\x09" + good[5:]), (4, good[:-1]), (5, None)]
    df = spark.createDataFrame(data, "id bigint, content binary")
    got = {r["id"]: r["error"] for r in mf.decode_containers(df, "id", "content").collect()}
    assert got == {1: None, 2: "BadMagic", 3: "UnsupportedVersion", 4: "Truncated", 5: "BadMagic"}
    heads = {r[0]: r[1] for r in df.select("id", mf.header_error("content")).collect()}
    assert heads == {1: None, 2: "BadMagic", 3: "UnsupportedVersion", 4: None, 5: "BadMagic"}


def test_layout_id_and_checks_of_a_tree(spark):
    files = [("t", i, d) for i, d in enumerate([b"x" * 700, b"", None, b"y" * 300 + b"z" * 500])]
    df = spark.createDataFrame([(t, i, i, d) for t, i, d in files], "tree string, ord bigint, doc bigint, data binary")
    cut = ck.content_chunks(df, "doc", "data", 64, 128, 256)
    laid, chunks = mf.tree_layout(df.select("tree", "ord", "doc"), cut, "tree", "ord", "doc")
    got = {r["doc"]: r for r in laid.collect()}
    assert [got[i]["size"] for i in range(4)] == [700, 0, 0, 800] and [got[i]["base"] for i in range(4)] == [0, 700, 700, 700]
    assert got[3]["chunk_start"] == got[0]["chunk_count"] and got[1]["chunk_count"] == 0
    ordered = chunks.orderBy("ordinal").collect()
    assert [c["ordinal"] for c in ordered] == list(range(len(ordered)))
    assert [c["offset"] for c in ordered] == [sum(x["length"] for x in ordered[:i]) for i in range(len(ordered))]
    root = mf.content_ids(chunks, "tree")
    told = mf.consistent(root.withColumnRenamed("root", "stated"), chunks, "tree", "stated").first()
    assert told["is_consistent"]
    # names don't matter to the id, order does
    again, swapped = mf.tree_layout(df.select("tree", (F.lit(9) - F.col("ord")).alias("ord"), "doc"), cut, "tree", "ord", "doc")
    assert bytes(mf.content_ids(swapped, "tree").first()["root"]) != bytes(root.first()["root"])
    own = chunks.join(ck.content_chunks(df, "doc", "data", 64, 128, 256, with_bytes=True).select("hash", "bytes").distinct(), "hash").select("tree", "ordinal", "bytes")
    bad = own.withColumn("bytes", F.when(F.col("ordinal") == 1, F.lit(b"?")).otherwise(F.col("bytes"))).unionByName(own.limit(1).withColumn("ordinal", F.lit(999).cast("bigint")))
    failed = sorted(r["ordinal"] for r in mf.chunk_checks(chunks, bad, "tree").collect() if not r["ok"])
    assert failed == [1, 999]


def test_rebuild_reports_the_first_bad_chunk_then_sizes(spark):
    chunks = spark.createDataFrame([("a", 0, 5, "k0"), ("a", 1, 5, "k1"), ("a", 2, 5, "k2"), ("b", 0, 4, "k0"), ("c", 0, 4, "k0"), ("d", 0, 1, None)], "tree string, ordinal bigint, length bigint, key string")
    held = spark.createDataFrame([("k0",), ("k0",), (None,)], "key string")
    sizes = spark.createDataFrame([("a", 15), ("b", 4), ("c", 5)], "tree string, size bigint")
    got = {r["tree"]: (r["first_bad"], r["error"], r["n_chunks"]) for r in mf.rebuild_status(chunks, held, "tree", "key", sizes).collect()}
    assert got == {"a": (1, "BadChunk", 3), "b": (None, None, 1), "c": (None, "SizeMismatch", 1), "d": (0, "BadChunk", 1)}


def test_splitting_a_stream(spark):
    files = spark.createDataFrame([("t", 1, 3), ("t", 2, 0), ("t", 3, 2), ("u", 1, 9), ("v", 1, -1), ("w", 1, 1)], "tree string, ord bigint, size bigint")
    streams = spark.createDataFrame([("t", b"abcde"), ("u", b"abc"), ("v", b"")], "tree string, stream binary")
    got = {(r["tree"], r["ord"]): (None if r["bytes"] is None else bytes(r["bytes"]), r["error"]) for r in mf.split_stream(files, streams, "tree", "ord").collect()}
    assert got == {("t", 1): (b"abc", None), ("t", 2): (b"", None), ("t", 3): (b"de", None)} | {(k, 1): (None, "SizeMismatch") for k in "uvw"}


def test_addresses_paths_and_listings(spark):
    h = "Ab" * 32
    uris = spark.createDataFrame([(f"chunkloom:{h}",), (f"other:{h}",), ("chunkloom:12",), (None,)], "u string")
    root, error = mf.parsed_address("u")
    assert [tuple(r) for r in uris.select(root, error).collect()] == [(h.lower(), None), (None, "BadUri"), (None, "Hex"), (None, "BadUri")]
    paths = spark.createDataFrame([("a/b.txt", False), ("a//b", True), ("../x", True), ("a/./b", True), ("/abs", True), ("", True), (None, True), ("..x/y", False)], "path string, bad boolean")
    assert all(r[0] == r[1] for r in paths.select("bad", mf.unsafe_path("path")).collect())
    files = spark.createDataFrame([("t", i, f"f{i}") for i in range(25)] + [("s", 1, "d/x"), ("r", 1, "x")], "tree string, o bigint, path string")
    top = mf.first_files(files, "tree", "o")
    assert top.where("tree = 't'").count() == 20 and top.where("tree = 't'").first()["n_more"] == 5
    assert rows(mf.tree_shape(files, "tree", "path")) == [("r", 1, True, False), ("s", 1, True, True), ("t", 25, False, True)]


def test_hex_keys_keep_damaged_text_apart(spark):
    texts = [" AB12\t", "ab12", "ab1", "zz", None, "", "ab1é", "\nAB12\r"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(hex_text("t").alias("t"), hex_key("t").alias("k")).collect()
    assert len({bytes(r["k"]) for r in got if r["k"] is not None}) == len({r["t"] for r in got if r["t"] is not None})
    back = df.select(hex_text("t").alias("t"), hex_of_key(hex_key("t")).alias("b")).collect()
    assert all(r["t"] == r["b"] for r in back)


def test_put_has_missing_and_reading(spark):
    data = [(3, "a"), (1, "a"), (2, "b"), (4, None), (5, "z"), (6, "z")]
    df, held = spark.createDataFrame(data, "o bigint, k string"), spark.createDataFrame([("b",), ("b",), (None,)], "k string")
    assert {r["o"]: r["is_new"] for r in stx.put(df, held, "k", "o").collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}
    assert {r["o"]: r["has"] for r in stx.membership(df, held, "k").collect()} == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert sorted(r["o"] for r in stx.missing(df, held, "k").collect()) == [1, 3, 4, 5, 6]
    places = spark.createDataFrame([("a", "ref", 9), ("a", "packed", 1), ("b", "legacy", 2)], "k string, kind string, pack_id int")
    assert {r["o"]: r["pack_id"] for r in stx.locate(df, places, "k").collect()} == {1: 1, 3: 1, 2: 2, 4: None, 5: None, 6: None}
    assert stx.object_count(places, "k", "kind").first()[0] == 2
    body = b"hello world"
    h = hashlib.sha256(body[:5]).digest()
    spots = spark.createDataFrame([(h, 1, 0, 5), (h[::-1], 1, 6, 5), (b"n" * 32, 7, 0, 1)], "key binary, pack_id int, pack_offset bigint, length bigint")
    packs = spark.createDataFrame([(1, body)], "pack_id int, content binary")
    got = {bytes(r["key"]): (r["bytes"] and bytes(r["bytes"]), r["corrupt"]) for r in stx.read_packs(spots, packs, "key").collect()}
    assert got == {h: (b"hello", False), h[::-1]: (b"world", True), b"n" * 32: (None, None)}


@pytest.mark.parametrize("seed", range(3))
def test_pack_placement_matches_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice(["a", "b", None]), i, rng.choice([None, 0, rng.randrange(1, 30), 500])) for i in range(300)]
    want, state = {}, {}
    for w, i, n in sorted(data, key=lambda r: r[1]):
        pack, used = state.get(w, (0, 0))
        if used >= 100:
            pack, used = pack + 1, 0
        want[i] = (pack, used)
        state[w] = (pack, used + (n or 0))
    got = stx.pack_placement(spark.createDataFrame(data, "w string, o bigint, n bigint"), "w", "o", "n", 100)
    assert {r["o"]: (r["pack_no"], r["pack_offset"]) for r in got.collect()} == want


def test_index_lines_last_wins_and_torn_ones_are_skipped(spark, tmp_path):
    h = "0f" * 32
    lines = [(1, f"{h}\t1\t2\t3"), (2, f"{h.upper()}\t4\t5\t6"), (3, f"{h}\t7\t8"), (4, "zz\t1\t1\t1"), (5, f"{h}\tx\t1\t1"), (6, None), (7, f"{h}\t1\t2\t3\t4")]
    df = spark.createDataFrame(lines, "n bigint, line string")
    assert rows(stx.parse_index_lines(df, "line", "n")) == [(h, 4, 5, 6)]
    out = spark.createDataFrame([(bytes.fromhex(h), 1, 2, 3)], "hash binary, pack_id int, pack_offset bigint, length bigint")
    fs.append_index(out, str(tmp_path / "idx"))
    fs.append_index(out.withColumn("pack_id", F.lit(9)), str(tmp_path / "idx"))
    assert fs.read_index(spark, str(tmp_path / "idx")).count() == 1


def test_trees_on_disk(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "sub dir")
    (tmp_path / "in" / "a+b%20.txt").write_bytes(b"one")
    (tmp_path / "in" / "sub dir" / "c").write_bytes(b"")
    got = fs.scan_tree(spark, str(tmp_path / "in"))
    assert rows(got.select("path", "size")) == [("a+b%20.txt", 3), ("sub dir/c", 0)]
    fs.write_tree(got, str(tmp_path / "out"))
    assert (tmp_path / "out" / "a+b%20.txt").read_bytes() == b"one" and (tmp_path / "out" / "sub dir" / "c").read_bytes() == b""
    with pytest.raises(ValueError, match="unsafe"):
        fs.write_tree(spark.createDataFrame([("../x", b"")], "path string, data binary"), str(tmp_path / "out"))


def test_containers_and_requests_on_disk(spark, tmp_path):
    m = {"root": b"r" * 32, "total_size": 0, "chunks": [], "files": [], "name": "n"}
    (tmp_path / "x.cklm").write_bytes(mf.encode_manifest(m))
    (tmp_path / "y.cklm").write_bytes(b"junk")
    assert sorted((r["name"] or "", r["error"] or "") for r in fs.read_containers(spark, str(tmp_path)).collect()) == [("", "BadMagic"), ("n", "")]
    (tmp_path / "req.ndjson").write_text('{"id":1,"cmd":"status"}\n\nnope\n')
    assert sorted((r["id"], r["error"] or "") for r in fs.read_requests(spark, str(tmp_path / "req.ndjson")).collect()) == [(0, "NotJson"), (1, "")]


def test_empty_tables_everywhere(spark):
    e = spark.createDataFrame([], "tree string, ordinal bigint, length bigint, key string, o bigint, kind string")
    held = e.select("key")
    for df in (stx.put(e, held, "key", "o"), stx.membership(e, held, "key"), stx.missing(e, held, "key"), stx.progress(e, "tree", "ordinal", "length", "key", "o"), stx.pack_placement(e, "tree", "o", "length"), mf.rebuild_status(e, held, "tree", "key"), stx.dedup_ratio(e, "tree", "key", "length")):
        assert df.count() == 0
    assert stx.object_count(e, "key", "kind").first()[0] == 0
    assert dg.content_hash is not None
