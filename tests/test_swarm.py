import json
import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chunkloom.functions import identity as idn
from chunkloom.operators import bridge as br, discovery as dc, fec, protocol as pr, reputation as rp, scenarios as sc

REQ = "grp string, seq bigint, is_credit boolean, bytes bigint"


def test_ledger_counts_by_kind(spark):
    df = spark.createDataFrame([("p", "received", 1000), ("p", "received", 500), ("p", "served", 150), ("q", "credited", 7), (None, "served", 1), ("q", "served", None)], "peer string, kind string, bytes bigint")
    book = rp.ledger(df)
    assert rows(book) == [("p", 1500, 150, 0), ("q", 0, 0, 7)]
    assert tuple(rp.totals(book).first()) == (2, 1500, 150, 7) and tuple(rp.totals(book.limit(0)).first()) == (0, 0, 0, 0)
    asked = spark.createDataFrame([("p",), ("stranger",)], "peer string")
    assert rows(rp.counters_of(asked, book).select("peer", rp.reputation())) == [("p", 1350), ("stranger", 0)]
    ranked = rp.unchoke_rank(spark.createDataFrame([("c", x) for x in ("z", "a", "p", "q", "p")], "ctx string, peer string"), book, "ctx", 3)
    assert rows(ranked.select("slot", "peer")) == [(1, "p"), (2, "q"), (3, "a")]


def test_bag_keeps_the_largest_and_earlier_on_ties(spark):
    data = [(i, "s", "c", i * 100, i, "g") for i in range(60)] + [(100 + i, "s", "c", i * 100, i, "g") for i in range(60)] + [(300, "s", "d", 1000, 0, "h")]
    bag = rp.receipt_bag(spark.createDataFrame(data, "arrival bigint, server string, client string, bytes bigint, epoch bigint, sig string"), "server", ["server", "client", "bytes", "epoch", "sig"], "bytes", "arrival")
    got = bag.collect()
    assert len(got) == 50 and min(r["bytes"] for r in got) == 1000
    assert {r["arrival"] for r in got if r["bytes"] == 1000} == {10} and all(r["arrival"] < 100 for r in got)


def test_presentation_dedupes_per_response(spark):
    data = [(1, 1, "s", "c", 0, 5, True), (2, 1, "s", "c", 0, 9, True), (3, 2, "s", "c", 0, 5, True), (4, 1, "s", "s", 0, 7, True), (5, 1, "s", "d", 0, 100, False), (6, 1, "s", "d", None, None, True)]
    df = spark.createDataFrame(data, "id bigint, resp int, server string, client string, epoch bigint, bytes bigint, sig_ok boolean")
    assert rows(rp.presentation_credit(df, ["resp"], "id")) == [("s", 17, 4)]
    assert rows(rp.presentation_credit(df, ["resp"], "id", strict=True)) == [("s", 10, 3)]
    assert [r[0] for r in df.orderBy("id").select(rp.submitted(F.lit("s"))).collect()] == [True, False, False, False, False, False][:1] + [True, True, False, False, True]


def plain_choke(events, threshold):
    state, out = {}, {}
    for g, s, c, n in sorted(events, key=lambda e: e[1]):
        b, n = state.get(g, 0), n or 0
        out[s] = bool(c) or b >= -threshold
        state[g] = b + (n if c else -n if out[s] else 0)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_choke_folds_like_a_loop(spark, seed):
    rng = random.Random(seed)
    events = [(rng.choice(["a", "b"]), i, rng.choice([True, False, False, None]), rng.choice([None, *range(0, 50, 5)])) for i in range(200)]
    df = spark.createDataFrame(events, REQ)
    got = {r["seq"]: r["admitted"] for r in rp.choke_with_credits(df, "grp", "seq", "is_credit", "bytes", 60).collect()}
    assert got == plain_choke(events, 60)
    plain = [(g, s, False, n) for g, s, _, n in events]
    closed = rp.choke_admission(spark.createDataFrame(plain, REQ), "grp", "seq", "bytes", F.lit(0), 60)
    assert {r["seq"]: r["admitted"] for r in closed.collect()} == plain_choke(plain, 60)
    free = rp.choke_admission(df, "grp", "seq", "bytes", F.lit(0), 0).where("seq = (SELECT 0)").collect()
    assert all(r["admitted"] for r in free)  # the first chunk is free
    assert rp.choke_admission(df, "grp", "seq", "bytes", F.lit(0), None).where("NOT admitted").count() == 0


def test_issuing_and_first_contact(spark):
    data = [(1, "d1", "c", "s", 5), (2, "d1", "c", "s", 6), (3, "d1", "c", "t", 1), (4, "d2", "c", "s", 2), (5, "d2", "c", "u", 0), (6, "d2", None, "u", 9)]
    df = spark.createDataFrame(data, "o bigint, dl string, client string, server string, bytes bigint")
    assert rows(rp.issued(df, ["dl"], "client", "server", "bytes", "o").select("epoch", "dl", "server", "bytes")) == [(0, "d1", "s", 11), (1, "d1", "t", 1), (2, "d2", "s", 2)]
    book = spark.createDataFrame([("c", 0, 1, 0)], "peer string, served_to_us bigint, we_served bigint, credited_by_receipts bigint")
    assert rp.first_contact(df, book, "server", "client").count() == 0 and rp.first_contact(df, book.limit(0), "server", "client").count() == 3


def test_canonical_bytes_are_little_endian(spark):
    df = spark.createDataFrame([(b"S" * 32, b"C" * 32, 258, 2**40), (b"S" * 32, b"C" * 32, None, 1)], "s binary, c binary, b bigint, e bigint")
    got = [r[0] for r in df.select(rp.canonical_bytes(F.col("s"), F.col("c"), F.col("b"), F.col("e"))).collect()]
    assert bytes(got[0]) == rp.RECEIPT_TAG + b"S" * 32 + b"C" * 32 + (258).to_bytes(8, "little") + (2**40).to_bytes(8, "little") and got[1] is None


@pytest.mark.parametrize(("seed", "key", "message", "sig"), [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
])
def test_ed25519_vectors(seed, key, message, sig):
    raw = [bytes.fromhex(x) for x in (seed, key, message, sig)]
    assert idn.public_key(raw[0]) == raw[1] and idn.sign(raw[0], raw[2]) == raw[3] and idn.verify(raw[1], raw[2], raw[3])


def test_bad_signatures_are_invalid_not_errors():
    seed = b"k" * 32
    key, sig = idn.public_key(seed), idn.sign(seed, b"m")
    bent = [sig[:-1] + bytes([sig[-1] ^ 1]), sig[:63], b"", b"\xff" * 64, sig[:32] + (int.from_bytes(sig[32:], "little") + idn.ORDER).to_bytes(32, "little")]
    assert idn.verify(key, b"m", sig) and not any(idn.verify(key, b"m", s) for s in bent)
    assert not idn.verify(key, b"n", sig) and not idn.verify(b"\x01" + b"\0" * 31, b"m", sig) and not idn.verify(None, b"m", sig) and not idn.verify(key[:5], b"m", sig)


def test_addresses(spark):
    data = [("/ip4/1.1.1.1/udp/4001/quic-v1/p2p/A", "A", 4001), ("/ip4/1.1.1.1/udp/65535/p2p/R/p2p-circuit/p2p/T", "T", 65535), ("/ip4/1.1.1.1/udp/65536", None, None), ("/ip4/1.1.1.1/tcp/1", None, None), ("/udp/x/udp/9", None, None), (None, None, None)]
    df = spark.createDataFrame(data, "a string, peer string, port int")
    assert all(tuple(r)[:2] == tuple(r)[2:] for r in df.select("peer", "port", dc.peer_of_address("a"), dc.udp_port("a")).collect())
    full = df.select(dc.with_peer(F.col("a"), F.lit("A"))).collect()
    assert full[0][0] == data[0][0] and full[3][0] == "/ip4/1.1.1.1/tcp/1/p2p/A"
    given = spark.createDataFrame([("/x", None), ("h:1", "P"), ("a:b:2", "P"), ("h", "P"), ("h:1", None)], "g string, p string")
    address, error = dc.built_address(F.col("g"), F.col("p"))
    assert [tuple(r) for r in given.select(address, error).collect()] == [("/x", None), ("/ip4/h/udp/1/quic-v1/p2p/P", None), ("/ip4/a:b/udp/2/quic-v1/p2p/P", None), (None, "NoPort"), (None, "NoPeerId")]


def test_plans(spark):
    missing = spark.createDataFrame([("t", i, f"k{i}") for i in range(7)] + [("t", 7, None)], "tree string, o bigint, k string")
    have = spark.createDataFrame([(f"k{i}", p) for i in range(6) for p in "abc" if (i, p) not in ((1, "b"), (1, "c"), (4, "b"))], "k string, p string")
    got = {r["o"]: (r["slot"], r["provider"]) for r in dc.assign(missing, have, "tree", "o", "k", "p").collect()}
    assert got == {0: (0, "a"), 1: (1, "a"), 2: (2, "c"), 3: (3, "a"), 4: (4, "c"), 5: (5, "c"), 6: (6, None), 7: (7, None)}
    assert dc.assign(missing, have.limit(0), "tree", "o", "k", "p").where("provider IS NULL").count() == 8
    held = spark.createDataFrame([("k0",)], "k string")
    twice = missing.unionByName(missing.withColumn("o", F.col("o") + 100))
    assert rows(dc.download_report(twice, held, "tree", "o", "k")) == [("t", 6, 8)]
    found = spark.createDataFrame([("r", "x", 2), ("r", "y", 1), ("r", "x", 0), ("r", None, 3)], "root string, peer string, o bigint")
    assert dc.providers(found, "root", "peer", "o").first()["providers"] == ["x", "y"]
    union = dc.ordered_union(found.where("peer = 'y'"), found, "root", "peer", "o")
    assert rows(union.select("nr", "peer")) == [(1, "y"), (2, "x")]


def test_more_providers_than_a_word_has_bits_and_long_lists(spark, monkeypatch):
    missing = spark.createDataFrame([("t", i, f"k{i}") for i in range(140)], "tree string, o bigint, k string")
    have = spark.createDataFrame([(f"k{i}", f"p{i:03d}") for i in range(130)] + [("k5", "p129")], "k string, p string")
    got = {r["o"]: r["provider"] for r in dc.assign(missing, have, "tree", "o", "k", "p").collect()}
    assert got == {i: f"p{i:03d}" if i < 130 else None for i in range(140)}
    monkeypatch.setattr(dc, "PAGE", 10)
    found = spark.createDataFrame([("r", f"p{i}", 100 - i) for i in range(25)] + [("q", "x", 1)], "root string, peer string, o bigint")
    pages = {(r["root"], r["page"]): r["providers"] for r in dc.providers(found, "root", "peer", "o").collect()}
    assert {k: len(v) for k, v in pages.items()} == {("r", 0): 10, ("r", 1): 10, ("r", 2): 5, ("q", 0): 1} and pages["r", 0][0] == "p24" and pages["r", 2][-1] == "p0"
    answers = dc.peers_response(found.select(F.col("root").alias("cid"), "peer")).collect()
    assert sorted(p for r in answers for p in r["peers"]) == sorted([f"p{i}" for i in range(25)] + ["x"]) and {r["count"] for r in answers if r["cid"] == "r"} == {25}
    with monkeypatch.context() as m:
        m.setattr(dc, "MOST_NAMES", 100)
        with pytest.raises(ValueError, match="providers"):
            dc.provider_dictionary(have, "p")


def test_tracker(spark):
    data = [("c", "p", ["a1"], "2025-03-01 00:00:00", 1), ("c", "p", ["a2"], "2025-03-01 00:00:00", 2), ("c", "q", ["b"], "2025-02-28 23:30:00", 3), ("c", "r", ["b"], "2025-02-28 23:30:01", 4), ("d", None, [], "2025-03-01 00:00:00", 5)]
    df = spark.createDataFrame(data, "cid string, peer string, addrs array<string>, ts string, seq bigint").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    now = F.lit("2025-03-01 00:00:00").cast("timestamp_ntz")
    fresh = dc.fresh_peers(df, now)
    assert rows(fresh.select("peer", F.col("addrs")[0])) == [("p", "a2"), ("r", "b")]  # q is exactly 1800 s old
    assert [tuple(r) for r in dc.peers_response(fresh).collect()] == [("c", 2, 0, ["p", "r"])]
    status = spark.createDataFrame([("GET", "c", "p", 1, 405), ("POST", "", "p", 1, 400), ("POST", "c", None, 1, 400), ("POST", "c", "p", None, 400), ("POST", "c", "p", 2, 200), (None, "c", "p", 1, 405)], "m string, c string, p string, n int, want int")
    assert all(r[0] == r[1] for r in status.select("want", dc.announce_status(F.col("m"), F.col("c"), F.col("p"), F.col("n"))).collect())
    lines = spark.createDataFrame([(1, json.dumps({"peers": [{"peer": "A", "addrs": ["/x/1", "bad"]}, {"peer": "B", "addr": "/y/2"}, {"peer": "C", "addrs": ["no"]}, {"peer": "not ok", "addrs": ["/z/1"]}, {"peer": None}]})), (2, "{"), (3, None)], "i int, line string")
    assert [(r["peer"], r["addrs"]) for r in dc.tracker_answers(lines, "line").collect()] == [("A", ["/x/1"]), ("B", ["/y/2"])]


REQUEST_LINES = [
    ('{"id":7,"cmd":"fetch","uri":"u","out":"o"}', 7, "fetch", None), ('{"id":7,"cmd":"fetch","uri":"u"}', 7, None, "MissingField"), ('{"id":7,"cmd":"fetch","uri":"u","out":5}', 7, None, "MissingField"),
    ('{"id":1,"cmd":"convert","torrent":"t","data":"d"}', 1, "convert", None), ('{"id":1,"cmd":"convert","path":"p"}', 1, "convert", None),
    ('{"id":1,"cmd":"convert","torrent":"t","data":"d","path":"p"}', 1, None, "BadShape"), ('{"id":1,"cmd":"convert","torrent":"t"}', 1, None, "BadShape"), ('{"id":1,"cmd":"convert"}', 1, None, "BadShape"),
    ("not json", 0, None, "NotJson"), ("[1]", 0, None, "NotJson"), ('{"id":3', 0, None, "NotJson"), ('{"cmd":"status"}', 0, None, "NoId"), ('{"id":"7","cmd":"status"}', 0, None, "NoId"), ('{"id":-1,"cmd":"status"}', 0, None, "NoId"),
    ('{"id":9,"cmd":"dance"}', 9, None, "UnknownCommand"), ('{"id":9}', 9, None, "UnknownCommand"), ('{ "cmd" : "shutdown" , "id" : 4 }', 4, "shutdown", None), ('{"id":2,"cmd":"dial"}', 2, "dial", None), (None, 0, None, "NotJson"),
    # the top level decides, not what stands inside other fields
    ('{"cmd":"status","x":{"id":7}}', 0, None, "NoId"), ('{"x":{"id":1},"cmd":"status","id":2}', 2, "status", None), ('{"id":18446744073709551615,"cmd":"status"}', 2**64 - 1, "status", None),
    ('{"id":18446744073709551616,"cmd":"status"}', 0, None, "NoId"), ('{"id":5,"cmd":"fetch","uri":5,"out":"o","x":{"uri":"u"}}', 5, None, "MissingField"), ('{"id":5,"cmd":"status"} {"id":6,"cmd":"status"}', 0, None, "NotJson"),
    ('{"id":5,"cmd":"status"},{"id":6}', 0, None, "NotJson"), ('{"id":5,"cmd":"status"}]', 0, None, "NotJson"), ('{"id":5,"cmd":"status"}, "x"] [1', 0, None, "NotJson"), ("{'id':5,'cmd':'status'}", 0, None, "NotJson"),
    ('{"id":7,"cmd":"fetch","uri":"x:ab","out":"D:/x"}', 7, "fetch", None), ('{"id":1,"cmd":"convert","data":"d"}', 1, None, "BadShape"), ('{"id":1,"cmd":"nope"}', 1, None, "UnknownCommand"),
    ('{"id":1,"cmd":"convert","path":"p","data":7}', 1, None, "BadShape"), ('{"id":1,"cmd":"convert","path":"p","data":null}', 1, "convert", None), ('{"id":1.5,"cmd":"status"}', 0, None, "NoId"), ('{"id":7.0,"cmd":"status"}', 0, None, "NoId"),
    ('{"id":4,"cmd":"torrent","input":"i","out":3}', 4, None, "BadShape"), ('{"id":4,"cmd":"torrent","input":"i"}', 4, "torrent", None), ('{"id":true,"cmd":"status"}', 0, None, "NoId"), ("", 0, None, "NotJson"), ("5", 0, None, "NotJson"),
    ('{"id":8,"cmd":"status","note":"a \\"id\\": 9, }"}', 8, "status", None), ('{"id":1,"id":2,"cmd":"status"}', 0, None, "NotJson"),
]


def test_request_lines(spark):
    df = spark.createDataFrame([(i, x[0], "kept") for i, x in enumerate(REQUEST_LINES)], "i int, `l.x` string, error_before string")
    got = {r["i"]: (int(r["id"]), r["cmd"], r["error"]) for r in pr.parse_requests(df, "l.x").collect()}
    assert [(x[0], *got[i]) for i, x in enumerate(REQUEST_LINES)] == REQUEST_LINES


def test_too_long_lines_are_not_parsed(spark, monkeypatch):
    monkeypatch.setattr(pr, "LINE_LIMIT", 30)
    df = spark.createDataFrame([('{"id":1,"cmd":"status"}',), ('{"id":1,"cmd":"status","x":"yyyyyyyyyyyyyyyyy"}',)], "l string")
    assert [(int(r["id"]), r["error"]) for r in pr.parse_requests(df, "l").collect()] == [(1, None), (0, "TooLong")]


def test_event_lines_and_terminal_events(spark):
    df = spark.range(1)
    line = lambda c: json.loads(df.select(c).first()[0])
    assert line(pr.progress_event(F.lit(1), F.lit("get"), F.lit(2), F.lit(3))) == {"id": 1, "event": "progress", "op": "get", "done": 2, "total": 3}
    assert line(pr.result_event(F.lit(1), root=F.lit('"'))) == {"id": 1, "event": "result", "ok": True, "root": '"'}
    assert line(pr.error_event(F.lit(1), F.lit("m"))) == {"id": 1, "event": "error", "ok": False, "message": "m"}
    events = spark.createDataFrame([(1, "progress"), (1, "result"), (2, "result"), (2, "error"), (3, "progress")], "id bigint, kind string")
    assert rows(pr.terminal_check(events, "id", "kind")) == [(1, 1, True), (2, 2, False), (3, 0, False)]


def test_throttle_matches_a_loop(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), i, rng.randrange(3000), rng.random() < 0.05) for i in range(200)]
    want, last = set(), {}
    for op, i, t, done in sorted(data, key=lambda r: (r[0], r[2], r[1])):
        if op not in last or done or t - last[op] >= 100:
            want.add(i)
            last[op] = t
    got = pr.throttled(spark.createDataFrame(data, "op string, o bigint, ms bigint, c boolean"), "op", "ms", "o", "c")
    assert {r["o"] for r in got.where("emitted").collect()} == want


def coded(v):
    if isinstance(v, int):
        return b"i%de" % v
    if isinstance(v, bytes):
        return b"%d:%s" % (len(v), v)
    if isinstance(v, list):
        return b"l" + b"".join(map(coded, v)) + b"e"
    return b"d" + b"".join(coded(k) + coded(x) for k, x in v.items()) + b"e"


VALUES = st.recursive(st.integers(-(2**63), 2**63 - 1) | st.binary(max_size=6), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.binary(max_size=3), c, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(VALUES, st.binary(max_size=4))
def test_bencode_round_trip(value, rest):
    raw = coded(value)
    assert br.decode(raw + rest) == (value, len(raw))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_metainfo_never_fails_otherwise(raw):
    for data in (raw, b"d4:info" + raw, b"d4:infod6:lengthi5e" + raw):
        try:
            br.parse_metainfo(data)
        except br.MetaError:
            pass


def test_metainfo_rules():
    import hashlib

    info = {b"name": b"n", b"piece length": 16, b"pieces": b"x" * 40, b"length": 20}
    raw = coded({b"a": b"b", b"info": info})
    got = br.parse_metainfo(raw + b"junk")
    assert got["infohash"] == hashlib.sha1(coded(info)).digest() and got["files"] == [("n", 20)] and len(got["piece_hashes"]) == 2
    many = info | {b"files": [{b"length": 1, b"path": [b"d", b"f"]}, {b"length": 2, b"path": [b"g"]}]}
    assert br.parse_metainfo(coded({b"info": many}))["files"] == [("d/f", 1), ("g", 2)]
    for change in ({b"piece length": 0}, {b"piece length": (64 << 20) + 1}, {b"pieces": b"x" * 19}, {b"length": -1}, {b"name": b"../x"}, {b"name": b"/x"}, {b"name": b""}, {b"name": 3}, {b"files": [{b"length": 1, b"path": [b"..", b"x"]}]}, {b"files": [{b"length": 1}]}, {b"files": 1}):
        with pytest.raises(br.MetaError):
            br.parse_metainfo(coded({b"info": info | change}))
    deep = b"l" * 33 + b"e" * 33
    assert br.decode(deep)[1] == 66
    with pytest.raises(br.MetaError, match="deep"):
        br.decode(b"l" * 5000)
    with pytest.raises(br.MetaError):
        br.decode(b"9:abc")
    assert br.decode(b"i-007e")[0] == -7 and br.decode(b"d1:ai1e1:ai2ee")[0] == {b"a": 1}


def test_mappings(spark):
    log = spark.createDataFrame([("h", b"r" * 32, 1), ("h", b"s" * 32, 2), ("short", b"x", 1), ("gone", b"r" * 32, 1), ("gone", None, 2), (None, b"r" * 32, 3)], "h string, root binary, o bigint")
    now = br.current_mappings(log, "h", "root", "o")
    assert [(r["h"], bytes(r["root"])) for r in now.collect()] == [("h", b"s" * 32)]
    asked = spark.createDataFrame([("h",), ("new",)], "h string")
    got = {r["h"]: (bytes(r["root"]), r["converted"]) for r in br.resolve_or_convert(asked, now, "h", "root", F.lit(b"m" * 32)).collect()}
    assert got == {"h": (b"s" * 32, False), "new": (b"m" * 32, True)}
    offers = spark.createDataFrame([(b"s" * 32, "late", 5, True), (b"s" * 32, "bad", 1, False), (b"s" * 32, "good", 2, True)], "root binary, provider string, o bigint, ok boolean")
    assert {r["h"]: r["provider"] for r in br.resolve(asked, now, offers, "h", "root", "o").collect()} == {"h": "good", "new": None}


def test_symbols_are_made_once(spark, tmp_path):
    cache = fec.SymbolCache(spark, str(tmp_path / "symbols"), "root", repair=2)
    df = spark.createDataFrame([("a", b"x" * 3000), ("b", b"y")], "root string, data binary")
    assert cache.symbols(df.where("root = 'a'"), "data").count() == 5
    assert cache.symbols(df, "data").count() == 8 and cache.symbols(df.where("root = 'b'"), "data").count() == 3
    versions = len(list((tmp_path / "symbols").iterdir()))
    assert cache.symbols(df, "data").count() == 8 and len(list((tmp_path / "symbols").iterdir())) == versions == 2


@settings(max_examples=25, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.integers(0, 2**32))
def test_any_large_enough_subset_rebuilds(data, seed):
    symbols = list(enumerate(fec.encode(data, repair=8, symbol=32)))
    random.Random(seed).shuffle(symbols)
    k = -(-len(data) // 32)
    assert fec.decode(len(data), symbols[:k], 32) == data  # one block: any k symbols
    assert fec.decode(len(data), symbols[: k - 1], 32) is None
    assert fec.decode(len(data), [(i, p[:-1]) for i, p in symbols], 32) is None


@pytest.mark.parametrize(("size", "repair", "lost"), [(100_000, 60, 40), (32 * 128 * 3 + 5, 90, 60), (32 * 700, 300, 250), (40, 400, 2)])
def test_losses_in_a_row_over_blocks(size, repair, lost):
    symbol = 1200 if size == 100_000 else 32
    data = sc.sample_bytes(size, 7)
    symbols = list(enumerate(fec.encode(data, repair, symbol)))
    k = -(-size // symbol)
    assert len(symbols) == k + repair and b"".join(p for _, p in symbols[: (k if fec.n_blocks(size, symbol) == 1 else 0)])[:size] == (data if fec.n_blocks(size, symbol) == 1 else b"")
    assert fec.decode(size, symbols[lost:], symbol) == data and fec.decode(size, symbols[k // 3 : k // 3 + lost] + symbols[lost:], symbol) == data
    assert fec.decode(size, symbols[:k], symbol) == data and (k == 1 or fec.decode(size, symbols[: k - 1], symbol) is None)
    if size == 100_000:  # too many are lost
        assert fec.decode(size, symbols[:5] + symbols[-10:], symbol) is None
    else:  # repair symbols beyond the Cauchy matrix too
        assert fec.decode(size, symbols[-k - 40 :], symbol) == data


def test_inverse_over_the_field():
    rng = np.random.default_rng(1)
    m = rng.integers(0, 256, (20, 20), np.uint8)
    m[0], m[0, 3] = 0, 1  # a zero pivot first
    assert (fec._mix(fec._inverse(m), m) == np.eye(20, dtype=np.uint8)).all()
    m[5] = m[6]
    assert fec._inverse(m) is None and len(fec._independent(m)) == 19


def test_erasure_coding_over_tables(spark):
    data = sc.sample_bytes(20_000, 3)
    df = spark.createDataFrame([("a", data), ("b", b""), ("c", None), ("d", b"x")], "root string, data binary")
    symbols = fec.encode_symbols(df, "root", "data", repair=10)
    assert symbols.where("root IN ('b', 'c')").count() == 0
    got = {r["root"]: bytes(r["data"]) for r in fec.decode_symbols(symbols.where("esi >= 8 OR root = 'd'"), "root").collect()}
    assert got == {"a": data, "d": b"x"}
    assert fec.decode_symbols(symbols.where("esi >= 15 AND root = 'a'"), "root").first()["data"] is None
    long = spark.createDataFrame([(None, sc.sample_bytes(400_001, 4)), ("e", b"y")], "root string, data binary")
    made = fec.encode_symbols(long, "root", "data", repair=30)
    twice = made.where("esi > 20").unionByName(made.where("esi % 3 = 1")).unionByName(made.where("root = 'e'"))
    got = {r["root"]: bytes(r["data"]) for r in fec.decode_symbols(twice, "root").collect()}
    assert got == {None: sc.sample_bytes(400_001, 4), "e": b"y"}
    assert [tuple(r) for r in fec.decode_symbols(made.where("root IS NULL AND esi % 3 > 0"), "root").collect()] == [(None, None)]
    assert fec.symbol_range(symbols.where("root = 'a'"), F.lit(25), F.lit(10)).count() == 2 and len(fec.config_for(5)) == 12
    sizes = spark.createDataFrame([(0, 1, 1), (1200, 1, 1), (1201, 2, 1), (1200 * 129, 129, 2)], "s bigint, n bigint, r bigint")
    assert all(r[0] == r[2] and r[1] == r[3] for r in sizes.select("n", "r", fec.needed(F.col("s")), fec.rounds(F.col("s"))).collect())


def test_permanence_and_report(spark):
    log = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("s", "a", 3), ("s", "a", 4), ("t", None, 5)], "root string, peer string, o bigint")
    assert rows(sc.permanence(log, "root", "peer", "o")) == [("r", "a", 1, True), ("s", "a", 0, False)]
    rep = sc.report({"x": spark.createDataFrame([(1, 2.5)], "m bigint, k double")})
    assert rows(rep) == [("x", "k", 2.5), ("x", "m", 1.0)] and "| x | m | 1.00 |" in sc.markdown(rows(rep))
