import hashlib
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chunkloom.api import Store, serve_set
from chunkloom.functions.digest import blake3  # noqa: F401
from chunkloom.operators import chunking, fec, manifest as mf, reputation as rp
from chunkloom.operators.scenarios import edited_copy, sample_bytes
from chunkloom.sources import streams
from chunkloom.sources.files import append_references, read_containers, read_references, read_torrents
from chunkloom.sources.state import load_state, save_state

SIZES = (256, 1024, 4096)


@pytest.fixture
def tree(tmp_path):
    data = {"b.bin": sample_bytes(20_000, 1), "a/x.txt": b"hello", "a/empty": b"", "a/dup.bin": sample_bytes(20_000, 1)}
    for p, d in data.items():
        os.makedirs(tmp_path / "in" / os.path.dirname(p), exist_ok=True)
        (tmp_path / "in" / p).write_bytes(d)
    return str(tmp_path / "in"), data


def test_pack_info_export(spark, tmp_path, tree):
    folder, data = tree
    store = Store(spark, str(tmp_path / "store"), SIZES)
    root = store.pack(folder, "mine")
    info = store.info(root)
    assert info["consistent"] and info["total_size"] == 40_005 and [p for p, _ in info["files"]] == sorted(data) and info["address"].endswith(root)
    n = store.table("chunks").count()
    assert n < info["n_chunks"]  # the repeated file is stored once
    assert store.pack(folder) == root and store.table("chunks").count() == n and store.table("manifests").count() == 1
    store.export(root, str(tmp_path / "out"))
    assert {p: (tmp_path / "out" / p).read_bytes() for p in data} == data
    assert store.verify(root).first()["error"] is None


def test_damage_is_found_before_export(spark, tmp_path, tree):
    store = Store(spark, str(tmp_path / "store"), SIZES)
    root = store.pack(tree[0])
    bad = store.table("refs").where("ordinal = 3").first()["hash"]
    damaged = store.table("chunks").withColumn("bytes", F.when(F.col("hash") == bad, F.lit(b"?")).otherwise(F.col("bytes"))).collect()
    spark.createDataFrame(damaged, "hash binary, length bigint, bytes binary").write.mode("overwrite").parquet(f"{store.folder}/chunks")
    with pytest.raises(ValueError, match="BadChunk"):
        store.export(root, str(tmp_path / "out"))
    with pytest.raises(KeyError):
        store.info("00" * 32)


def test_references_are_read_from_their_files_until_those_change(spark, tmp_path, tree):
    folder, data = tree
    store = Store(spark, str(tmp_path / "store"), SIZES)
    root = store.pack(folder, copy=False)
    assert store.table("chunks").count() == 0 and store.table("places").count() > 3 and store.verify(root).first()["error"] is None
    store.export(root, str(tmp_path / "out"))
    assert {p: (tmp_path / "out" / p).read_bytes() for p in data} == data
    os.remove(os.path.join(folder, "a/x.txt"))
    raw = bytearray(data["a/dup.bin"])
    raw[5] ^= 1
    for p in ("a/dup.bin", "b.bin"):  # whichever of both copies is noted
        with open(os.path.join(folder, p), "wb") as out:
            out.write(bytes(raw))
    told = {r["error"] for r in store.read(store.table("refs")).collect()}
    assert told == {None, "Missing", "Corrupt"} and store.verify(root).first()["error"] == "BadChunk"
    with pytest.raises(ValueError, match="BadChunk"):
        store.export(root, str(tmp_path / "out2"))
    append_references(store.table("places"), str(tmp_path / "refs"))
    back = read_references(spark, str(tmp_path / "refs"))
    assert rows(back.select(F.unhex("hash"), "path", "offset", "length")) == rows(store.table("places"))


def test_files_are_cut_in_blocks_as_a_whole(spark, tmp_path, monkeypatch):
    data = sample_bytes(300_000, 5)
    whole = chunking.cut_points(data, *SIZES)
    for size in (100, 4096, 5000, 77_777, 10**6):
        cut = list(chunking.cut_stream((data[i : i + size] for i in range(0, len(data), size)), *SIZES))
        assert [at + len(p) for at, p in cut] == whole and b"".join(p for _, p in cut) == data
    assert list(chunking.cut_stream([], *SIZES)) == [] and [p for _, p in chunking.cut_stream([b"ab"], *SIZES)] == [b"ab"]
    (tmp_path / "f").write_bytes(data)
    (tmp_path / "empty").write_bytes(b"")
    df = spark.createDataFrame([(1, str(tmp_path / "f")), (2, "file://" + str(tmp_path / "empty")), (3, None)], "id bigint, uri string")
    got = streams.stream_chunks(df, "id", "uri", *SIZES)
    want = chunking.content_chunks(spark.createDataFrame([(1, data)], "id bigint, data binary"), "id", "data", *SIZES)
    assert rows(got) == rows(want)


def test_slices_and_pieces(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"0123456789")
    key = lambda b: hashlib.sha256(b).digest()
    f = str(tmp_path / "f")
    df = spark.createDataFrame([(key(b"234"), f, 2, 3), (key(b"x"), f, 2, 3), (key(b"89a"), f, 8, 3), (key(b""), f, 10, 0), (key(b"q"), str(tmp_path / "gone"), 0, 1), (key(b"r"), None, 0, 1), (key(b"s"), f, -1, 2)], "key binary, uri string, o bigint, n bigint")
    got = {bytes(r["key"]): (r["bytes"], r["error"]) for r in streams.read_slices(df, "key", "uri", "o", "n").collect()}
    assert got == {key(b"234"): (b"234", None), key(b"x"): (None, "Corrupt"), key(b"89a"): (None, "Corrupt"), key(b""): (b"", None), key(b"q"): (None, "Missing"), key(b"r"): (None, "Missing"), key(b"s"): (None, "Corrupt")}
    parts = spark.createDataFrame([("a/b", 2, b"cd"), ("a/b", 1, b"ab"), ("e", 0, None)], "path string, ordinal bigint, data binary")
    streams.write_files(parts, "file://" + str(tmp_path / "out"))
    assert (tmp_path / "out/a/b").read_bytes() == b"abcd" and (tmp_path / "out/e").read_bytes() == b"" and len(list((tmp_path / "out/a").iterdir())) == 1
    with pytest.raises(ValueError, match="unsafe"):
        streams.write_files(spark.createDataFrame([("../x", 0, b"")], "path string, ordinal bigint, data binary"), str(tmp_path / "out"))


def test_content_from_symbols_must_give_its_root(spark, tmp_path, tree):
    store = Store(spark, str(tmp_path / "store"), SIZES)
    root = store.pack(tree[0])
    listing = store.table("files").select("nr", "path", "size")
    stream = b"".join(tree[1][p] for p in sorted(tree[1]))
    symbols = fec.encode_symbols(spark.createDataFrame([("r", stream)], "root string, data binary"), "root", "data", repair=10).where("esi >= 8").drop("root")
    other = Store(spark, str(tmp_path / "other"), SIZES)
    assert other.take_symbols(root, listing, symbols) == root and other.verify(root).first()["error"] is None
    third = Store(spark, str(tmp_path / "third"), SIZES)
    bent = symbols.withColumn("payload", F.when(F.col("esi") == 9, F.reverse(F.col("payload").cast("string")).cast("binary")).otherwise(F.col("payload")))
    with pytest.raises(ValueError, match="instead of"):
        third.take_symbols(root, listing, bent.where("length(payload) = 1200"))
    assert third.table("chunks").count() == 0


def test_an_edit_near_the_front_keeps_most_chunks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    base = sample_bytes(1_500_000, 1)
    store.pack_bytes(base)
    first = store.table("chunks").count()
    root = store.pack_bytes(edited_copy(base, 2_000, sample_bytes(20_000, 99)), "v2")
    assert store.table("chunks").count() < 1.6 * first and store.info(root)["files"][0][0] == "v2"


def test_empty_tree_and_unsafe_paths(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), SIZES)
    none = spark.createDataFrame([], "path string, data binary")
    root = store.pack_files(none)
    assert root == hashlib.sha256(b"\x02").hexdigest() and store.info(root)["consistent"] and store.files(root).count() == 0
    with pytest.raises(ValueError, match="unsafe"):
        store.pack_files(spark.createDataFrame([("../x", b"a")], "path string, data binary"))


def test_containers_round_trip(spark, tmp_path, tree):
    store = Store(spark, str(tmp_path / "store"), SIZES)
    root = store.pack(tree[0], "n")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.cklm").write_bytes(bytes(store.containers().first()["content"]))
    got = read_containers(spark, str(tmp_path / "c")).first()
    assert got["error"] is None and bytes(got["root"]).hex() == root and len(got["files"]) == 4 and len(got["chunks"]) == store.info(root)["n_chunks"]


def test_torrents_are_verified_before_they_are_taken_in(spark, tmp_path, tree):
    folder, data = tree
    order = ["b.bin", "a/x.txt", "a/empty"]
    joined = b"".join(data[p] for p in order)
    pieces = b"".join(hashlib.sha1(joined[i : i + 4096]).digest() for i in range(0, len(joined), 4096))
    entry = lambda p: b"d6:lengthi%de4:pathl%see" % (len(data[p]), b"".join(b"%d:%s" % (len(s), s.encode()) for s in p.split("/")))
    raw = b"d4:infod5:filesl" + b"".join(map(entry, order)) + b"e4:name1:t12:piece lengthi4096e6:pieces%d:" % len(pieces) + pieces + b"ee"
    store = Store(spark, str(tmp_path / "store"), SIZES)
    root = store.convert_torrent(raw, folder)
    assert [p for p, _ in store.info(root)["files"]] == order
    (tmp_path / "t.torrent").write_bytes(raw)
    assert read_torrents(spark, str(tmp_path)).first()["n_pieces"] == len(pieces) // 20
    with pytest.raises(ValueError, match="bad pieces"):
        store.convert_torrent(raw.replace(pieces[:20], b"0" * 20), folder)
    os.remove(os.path.join(folder, "a/x.txt"))
    with pytest.raises(FileNotFoundError):
        store.convert_torrent(raw, folder)


def test_coded_download_gives_the_same_root(spark, tmp_path, tree):
    folder, data = tree
    store = Store(spark, str(tmp_path / "a"), SIZES)
    root = store.pack(folder)
    files = store.files(root).select("nr", "path", F.length("data").cast("bigint").alias("size")).withColumn("tree", F.lit(root))
    stream = spark.createDataFrame([(root, b"".join(data[p] for p in sorted(data)))], "tree string, stream binary")
    got = fec.decode_symbols(fec.encode_symbols(stream, "tree", "stream", repair=20).where("esi >= 15"), "tree").withColumnRenamed("data", "stream")
    split = mf.split_stream(files, got, "tree", "nr").select("nr", "path", F.col("bytes").alias("data"))
    assert Store(spark, str(tmp_path / "b"), SIZES).pack_files(split, ordered=True) == root


def test_serving_and_saved_state(spark, tmp_path):
    m = spark.createDataFrame([("a",), ("a",), ("b",)], "root string")
    assert rows(serve_set(m, [], True)) == [("a",), ("b",)] and rows(serve_set(m, ["b"], False)) == [("b",)]
    for args in (([], False), (["a"], True)):
        with pytest.raises(ValueError, match="not both"):
            serve_set(m, *args)
    shape = "peer string, served_to_us bigint, we_served bigint, credited_by_receipts bigint"
    path = str(tmp_path / "ledger")
    assert load_state(spark, path, shape).count() == 0
    for n in (1, 2, 3):
        save_state(rp.ledger(spark.createDataFrame([("p", "served", n)], "peer string, kind string, bytes bigint")), path)
    assert rows(load_state(spark, path, shape)) == [("p", 0, 3, 0)] and len(os.listdir(path)) == 2
