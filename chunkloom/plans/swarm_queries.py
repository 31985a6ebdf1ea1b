"""Queries of reputation, discovery, protocol, bridge, erasure coding and scenarios, and their SQL.

Receipts stand for transfers: a server gave ``bytes`` to a client; a server's direct
transfers count as received by us, verified receipts credit it, and clients were served.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.functions import digest as dg, identity as idn
from chunkloom.functions.keys import hex_key, hex_text
from chunkloom.operators import bridge as br, chunking as ck, discovery as dc, fec, protocol as pr, reputation as rp, scenarios as sc, store as st
from chunkloom.plans.store_queries import AVERAGE, LEAST, MOST, _arrived, _docs, _held
from chunkloom.session import table

SLOTS, THRESHOLD = 4, 5_000_000


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "receipts").withColumns({c: hex_text(c) for c in ("server", "client", "sig")})


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _receipts(spark, sf_dir)
    rows = [("server", "credited", F.coalesce("sig_ok", F.lit(False))), ("server", "received", F.coalesce(F.col("transport") == "direct", F.lit(False))), ("client", "served", F.lit(True))]
    parts = [r.where(cond).select(F.col(who).alias("peer"), F.lit(kind).alias("kind"), "bytes") for who, kind, cond in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ledger_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.ledger(_events(spark, sf_dir))


def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.totals(rp.ledger(_events(spark, sf_dir)))


def reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.ledger(_events(spark, sf_dir)).select("peer", rp.reputation().alias("reputation"))


def counters_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _receipts(spark, sf_dir).select(F.col("server").alias("peer"))
    asked = known.unionByName(table(spark, sf_dir, "manifests").select(hex_text("root").alias("peer"))).where("peer IS NOT NULL").distinct()
    return rp.counters_of(asked, rp.ledger(_events(spark, sf_dir)))


def unchoke_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _receipts(spark, sf_dir)
    candidates = r.select("site", F.col("server").alias("peer")).unionByName(r.select("site", F.col("client").alias("peer")))
    return rp.unchoke_rank(candidates, rp.ledger(_events(spark, sf_dir)), "site", SLOTS)


def receipt_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = rp.canonical_bytes(dg.hash_from_text("server"), dg.hash_from_text("client"), F.col("bytes"), F.col("epoch"))
    return _receipts(spark, sf_dir).select("delivery_id", F.lower(F.hex(raw)).alias("canonical"))


def receipt_bag_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    bag = rp.receipt_bag(_receipts(spark, sf_dir).where("server IS NOT NULL"), "server", ["server", "client", "bytes", "epoch", "sig"], "bytes", "delivery_id")
    return bag.select("server", "delivery_id", "bytes", "rank")


def receipt_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _receipts(spark, sf_dir).select("delivery_id", rp.submitted(F.col("delivery_id")).alias("accepted"))


def receipt_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.presentation_credit(_receipts(spark, sf_dir), ["batch_id"], "delivery_id")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _receipts(spark, sf_dir).where("server IS NOT NULL AND client IS NOT NULL")
    return known.select("delivery_id", F.concat_ws("/", "server", "client").alias("pair"), "server", "client", F.coalesce("bytes", F.lit(0)).alias("bytes"), (F.col("transport") == "relay").alias("is_credit"))


def choke_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.choke_admission(_requests(spark, sf_dir), "pair", "delivery_id", "bytes", F.lit(0), THRESHOLD).select("delivery_id", "taken", "admitted")


def choke_with_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.choke_with_credits(_requests(spark, sf_dir), "pair", "delivery_id", "is_credit", "bytes", THRESHOLD)


def receipts_issued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.issued(_receipts(spark, sf_dir), ["batch_id"], "client", "server", "bytes", "delivery_id").select("batch_id", "client", "server", "bytes", "epoch")


def first_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _receipts(spark, sf_dir)
    book = rp.ledger(r.where("transport = 'local'").select(F.col("client").alias("peer"), F.lit("served").alias("kind"), "bytes"))
    return rp.first_contact(r, book, "server", "client")


def signed_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests signed by an identity made from their site, checked, and checked against another message."""
    # a small file is one split: the arithmetic is spread over the cores
    m = table(spark, sf_dir, "manifests").repartition(spark.sparkContext.defaultParallelism).select("manifest_id", dg.content_hash(F.coalesce("site", F.lit(""))).alias("seed"), F.encode("root", "UTF-8").alias("message"))
    made = m.select("*", idn.public_key_udf("seed").alias("key"), idn.sign_udf("seed", "message").alias("sig"))
    return made.select("manifest_id", idn.verify_udf("key", "message", "sig").alias("valid"), idn.verify_udf("key", F.concat("message", F.lit(b"!")), "sig").alias("forged_valid"))


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _arrived(spark, sf_dir).select("root", "ordinal", hex_key("hash").alias("key"), F.coalesce("chunk_length", F.lit(0)).alias("length"))
    base = table(spark, sf_dir, "base_chunks").select(hex_key("hash").alias("key"))
    return st.missing(chunks, _held(spark, sf_dir).select("key").unionByName(base), "key")


def missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _missing(spark, sf_dir).select("root", "ordinal", "length")


def download_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _arrived(spark, sf_dir).select("root", "ordinal", hex_key("hash").alias("key"))
    base = table(spark, sf_dir, "base_chunks").select(hex_key("hash").alias("key"))
    return dc.download_report(chunks, base, "root", "ordinal", "key")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "chunk_refs").select(hex_key("hash").alias("key"), "site")
    return dc.assign(_missing(spark, sf_dir), have, "root", "ordinal", "key", "site")


def provider_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("root", "ordinal", "slot", "provider")


def bytes_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).where("provider IS NOT NULL").groupBy("provider").agg(F.count("*").alias("n_chunks"), F.sum("length").alias("sum_bytes"))


def manifest_first_responder(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "manifests").withColumn("root", hex_text("root"))
    return dc.first_valid(m, "root", "manifest_id", (F.col("total_size") > 0) & (F.col("n_chunks") > 0)).select("root", "manifest_id", "site")


def providers_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "chunk_refs").withColumn("root", hex_text("root"))
    return dc.providers(refs, "root", "site", "ref_id").select("root", "page", F.array_join("providers", ",").alias("providers"))


def provide_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "chunk_index").withColumn("hash", hex_text("hash"))
    return dc.last_state(log, ["hash", "pack_id"], ["indexed_at", "line_id"], "line_op")


def record_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and value records: the last name put for each root."""
    m = table(spark, sf_dir, "manifests").withColumn("root", hex_text("root"))
    return dc.last_state(m, ["root"], ["manifest_id"], "manifest_name").withColumnRenamed("manifest_name", "value")


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _receipts(spark, sf_dir)
    port = F.coalesce(F.col("bytes") % 70_000, F.lit(0)).cast("string")
    direct = F.concat(F.lit("/ip4/10.0.0."), (F.col("batch_id") % 250).cast("string"), F.lit("/udp/"), port, F.lit("/quic-v1"))
    relayed = F.concat(direct, F.lit("/p2p/"), "server", F.lit("/p2p-circuit/p2p/"), "client")
    plain = F.when(F.col("epoch") == 0, direct).otherwise(F.concat(direct, F.lit("/p2p/"), "server"))
    return r.select("delivery_id", "server", "client", port.alias("port"), "batch_id", F.when(F.col("transport") == "relay", relayed).otherwise(plain).alias("address"))


def multiaddr_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _addresses(spark, sf_dir)
    return a.select("delivery_id", dc.peer_of_address("address").alias("peer"), dc.udp_port("address").alias("port"), dc.with_peer(F.col("address"), F.col("server")).alias("full"))


def built_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _addresses(spark, sf_dir)
    given = F.when(F.col("batch_id") % 5 == 0, F.col("address")).when(F.col("batch_id") % 5 == 1, F.lit("localhost")).otherwise(F.concat(F.lit("10.1.2.3:"), "port"))
    address, error = dc.built_address(given, F.col("client"))
    return a.select("delivery_id", address.alias("address"), error.alias("error"))


def scraped_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "manifests")
    text = F.concat(F.lit("packed\nlink: chunkloom:"), hex_text("root"), F.lit("\nfiles: "), F.col("n_files").cast("string"), F.lit("\nchunks:   "), F.col("n_chunks").cast("string"))
    return m.select("manifest_id", *(c.alias(n) for n, c in dc.scraped(text, "chunkloom").items()))


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _receipts(spark, sf_dir)
    first = r.where("transport = 'relay'").select("batch_id", F.col("server").alias("peer"), "delivery_id")
    return dc.ordered_union(first, r.select("batch_id", F.col("server").alias("peer"), "delivery_id"), "batch_id", "peer", "delivery_id")


def sequential_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _receipts(spark, sf_dir).withColumn("try", F.concat_ws("/", F.col("batch_id").cast("string"), "site"))
    return dc.first_valid(r, "try", "delivery_id", F.col("sig_ok") & (F.col("bytes") > 1_000_000)).select("try", "delivery_id", "server")


def request_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "chunk_refs").select("ref_id", "origin", hex_key("hash").alias("key"))
    met = st.membership(refs, _held(spark, sf_dir).select("key"), "key")
    return met.select("ref_id", dc.response(F.col("origin"), F.col("has")).alias("response"))


def _announces(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _receipts(spark, sf_dir)
    return r.select(F.col("server").alias("cid"), F.col("client").alias("peer"), F.array(F.coalesce("transport", F.lit("?"))).alias("addrs"), F.col("received_at").alias("ts"), F.col("delivery_id").alias("seq"))


def _now(announces: DataFrame):
    # as text, so that no session or driver time zone comes in
    return F.lit(announces.agg(F.max("ts").cast("string")).first()[0]).cast("timestamp_ntz")


def tracker_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.latest_announces(_announces(spark, sf_dir)).select("cid", "peer", F.get("addrs", 0).alias("addr"), "ts")


def tracker_peers_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _announces(spark, sf_dir)
    return dc.fresh_peers(a, _now(a)).select("cid", "peer", F.get("addrs", 0).alias("addr"))


def peers_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _announces(spark, sf_dir)
    return dc.peers_response(dc.fresh_peers(a, _now(a), 86_400)).select("cid", "count", "page", F.array_join("peers", ",").alias("peers"))


def announce_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _receipts(spark, sf_dir)
    method, n = F.when(F.col("transport") == "local", "GET").otherwise("POST"), F.when(F.col("epoch") > 3, 0).otherwise(1)
    status = dc.announce_status(method, F.col("server"), F.col("client"), n)
    path = F.when(F.col("site").isNull(), "/nowhere").when(F.col("transport") == "relay", "/health").otherwise("/announce")
    return r.select("delivery_id", status.alias("status"), dc.route_status(path, status).alias("routed"))


def announce_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _announces(spark, sf_dir).where("cid IS NOT NULL AND peer IS NOT NULL")
    return a.select("seq", F.to_json(F.struct("cid", "peer", "addrs")).alias("line"))


def tracker_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a tracker, one per delivery, with bad addresses and peers among them, parsed again."""
    r = _addresses(spark, sf_dir).where("server IS NOT NULL AND client IS NOT NULL")
    good = F.concat(F.lit('{"peer":"'), "client", F.lit('","addrs":["'), "address", F.lit('","nonsense"],"addr":"/ip4/1.2.3.4/udp/'), "port", F.lit('"}'))
    bad = F.lit('{"peer":"x y","addrs":["/ip4/1.1.1.1/udp/1"]},{"peer":"lonely","addrs":[]}')
    lines = r.select("delivery_id", F.concat(F.lit('{"cid":"c","peers":['), good, F.lit(","), bad, F.lit("]}")).alias("line"))
    return dc.tracker_answers(lines, "line").select("delivery_id", "peer", F.array_join("addrs", " ").alias("addrs"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ident = F.col("event_id").cast("string")
    line = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('{"id":'), ident, F.lit(',"cmd":"fetch","uri":"u","out":"o"}')))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"id":'), ident, F.lit(',"cmd":"fetch","uri":"u"}')))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"cmd":"status","id":'), ident, F.lit("}")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"id":'), ident, F.lit(',"cmd":"convert","torrent":"t"'), F.when(F.col("user_id") % 2 == 0, ',"data":"d"').otherwise(""), F.when(F.col("user_id") % 3 == 0, ',"path":"p"').otherwise(""), F.lit("}")))
        .when(F.col("value") < 20, F.concat(F.lit('{"id":'), ident, F.lit(',"cmd":')))
        .when(F.col("value") < 40, F.concat(F.lit('{"id":'), ident, F.lit(',"cmd":"dance"}')))
        .when(F.col("value") < 80, F.concat(F.lit('{"cmd":"status","x":{"id":'), ident, F.lit("}}")))
        .when(F.col("value") < 120, F.concat(F.lit('{"x":{"id":1},"cmd":"status","id":'), ident, F.lit("}")))
        .when(F.col("value") < 160, F.lit('{"id":18446744073709551615,"cmd":"status"}'))
        .when(F.col("value") < 200, F.concat(F.lit('{"id":'), ident, F.lit(',"cmd":"fetch","uri":5,"out":"o","x":{"uri":"u"}}')))
        .when(F.col("value") < 240, F.concat(F.lit('{"id":'), ident, F.lit(',"cmd":"status"} {"id":1}')))
        .when(F.col("value") < 280, F.concat(F.lit('{"id":'), ident, F.lit(',"cmd":"convert","path":"p","data":7}')))
        .otherwise(F.col("props"))
    )
    return e.select("event_id", line.alias("line"))


def request_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = pr.parse_requests(_lines(spark, sf_dir), "line")
    return told.select("event_id", F.col("id").cast("string").alias("id"), "cmd", "error")


def error_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.parse_requests(_lines(spark, sf_dir), "line").select("event_id", F.col("id").cast("string").alias("id"))


def event_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ident = F.col("event_id")
    line = (
        F.when(F.col("event_type") == "view", pr.progress_event(ident, F.lit("fetch"), F.col("user_id"), F.lit(150)))
        .when(F.col("event_type") == "error", pr.error_event(ident, F.concat(F.lit('bad "'), F.col("user_id").cast("string"), F.lit('"'))))
        .when(F.col("event_type") == "signup", pr.ready_event(F.lit("1.0"))).when(F.col("event_type") == "click", pr.warn_event(F.lit("slow")))
        .otherwise(pr.result_event(ident, root=F.col("event_type"), chunks=F.col("user_id")))
    )
    return e.select("event_id", line.alias("line"))


def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = e.select("event_id", "user_id", ms.alias("ms"), (F.col("event_type") == "purchase").alias("done"))
    return pr.throttled(rows, "user_id", "ms", "event_id", "done", interval=6 * 3_600_000)


def terminal_event_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "signup", "result").when(F.col("event_type") == "error", "error").otherwise("progress").alias("kind"))
    return pr.terminal_check(e, "user_id", "kind")


def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "manifests").agg(F.count_distinct(hex_text("root")).alias("n_provided"))
    return sc.report({"ledger": rp.totals(rp.ledger(_events(spark, sf_dir))), "store": own})


def mapping_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "manifests").select("manifest_id", dg.hash_text(br.mapping_key(F.unhex(F.sha1("root")))).alias("mapping_key"))


def _mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "manifests").where(F.col("origin") == "torrent").select("manifest_id", F.sha1(hex_text("root")).alias("infohash"), dg.hash_from_text(hex_text("root")).alias("root"))
    return br.current_mappings(m, "infohash", "root", "manifest_id")


def resolve_or_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "manifests").select("manifest_id", F.sha1(hex_text("root")).alias("infohash"), hex_text("root").alias("r"))
    out = br.resolve_or_convert(asked, _mappings(spark, sf_dir), "infohash", "root", dg.content_hash("r"))
    return out.select("manifest_id", dg.hash_text("root").alias("root"), "converted")


def mapping_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "manifests").select("manifest_id", F.sha1(hex_text("root")).alias("infohash"))
    offers = table(spark, sf_dir, "chunk_refs").select(dg.hash_from_text(hex_text("root")).alias("root"), F.col("site").alias("provider"), "ref_id", (F.col("hash").isNotNull() & F.col("site").isNotNull()).alias("ok"))
    out = br.resolve(asked, _mappings(spark, sf_dir), offers, "infohash", "root", "ref_id")
    return out.select("manifest_id", dg.hash_text("root").alias("root"), "provider")


def resolve_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``mapping_resolve``, but only sites whose copy passed the piece check count; odd references stand for bad copies."""
    asked = table(spark, sf_dir, "manifests").select("manifest_id", F.sha1(hex_text("root")).alias("infohash"), hex_text("root").alias("r"))
    refs = table(spark, sf_dir, "chunk_refs").select(hex_text("root").alias("r"), F.col("site").alias("provider"), "ref_id", (F.col("hash").isNotNull() & F.col("site").isNotNull()).alias("ok"))
    offers = refs.select(dg.hash_from_text("r").alias("root"), "provider", "ref_id", "ok")
    told = refs.where("provider IS NOT NULL").groupBy("r", "provider").agg((F.min("ref_id") % 2 == 0).alias("verified"))
    checks = told.select(F.sha1("r").alias("infohash"), dg.hash_from_text("r").alias("root"), "provider", "verified")
    out = br.resolve(asked.select("manifest_id", "infohash"), _mappings(spark, sf_dir), offers, "infohash", "root", "ref_id", checks)
    return out.select("manifest_id", dg.hash_text("root").alias("root"), "provider")


def bridge_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "manifests").where("origin = 'torrent'").select(F.unhex(F.sha1(hex_text("root"))).alias("infohash"), dg.hash_from_text(hex_text("root")).alias("root"), "manifest_id")
    records, mappings = br.publish(made, "infohash", "root", "manifest_id")
    both = records.join(mappings.withColumnsRenamed({"order": "o", "root": "r"}), F.col("order") == F.col("o"))
    return both.select(F.col("order").alias("manifest_id"), "kind", dg.hash_text("root").alias("root"), dg.hash_text("key").alias("mapping_key"))


def receipts_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts signed anew by identities made from their clients, some changed afterwards, verified; credited by the checked signature."""
    cores = spark.sparkContext.defaultParallelism
    r = _receipts(spark, sf_dir).select("delivery_id", dg.content_hash(F.coalesce("server", F.lit(""))).alias("server"), dg.content_hash(F.coalesce("client", F.lit(""))).alias("seed"), F.coalesce("bytes", F.lit(0).cast("bigint")).alias("bytes"), F.coalesce("epoch", F.lit(0).cast("bigint")).alias("epoch"))
    # rows of a client stay together, so a worker meets few keys
    made = rp.issued_receipts(r.repartition(4 * cores, "seed"), "seed").drop("seed")
    case = F.col("delivery_id") % 5
    bent = made.withColumns({
        "bytes": F.when(case == 1, F.col("bytes") + 1).otherwise(F.col("bytes")), "server": F.when(case == 2, F.col("client")).otherwise(F.col("server")),
        "sig": F.when(case == 3, F.expr("cast(repeat('0', 64) as binary)")).otherwise(F.col("sig")), "epoch": F.when(case == 4, F.col("epoch") + 1).otherwise(F.col("epoch")),
    })
    return rp.verified_receipts(bent).select("delivery_id", "bytes", "sig_ok")


def download_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "manifests")
    return m.select("manifest_id", br.download_dir(F.col("root"), "store/torrents", F.col("manifest_name")).alias("dir"))


def torrent_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Torrent files written for file entries (one file each) and read again; odd paths and null sizes are errors."""
    e = table(spark, sf_dir, "file_entries")
    coded = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    info = F.concat(F.lit("d6:lengthi"), F.coalesce(F.col("file_size").cast("string"), F.lit("?")), F.lit("e4:name"), coded(F.col("file_path")), F.lit("12:piece lengthi16384e6:pieces20:aaaaaaaaaaaaaaaaaaaae"))
    whole = F.concat(F.lit("d8:announce3:url"), F.lit("4:info"), info, F.lit("e"))
    read = br.read_metainfo(e.select("entry_id", F.encode(whole, "UTF-8").alias("content")), "entry_id", "content")
    return read.select("entry_id", F.lower(F.hex("infohash")).alias("infohash"), "name", F.get("files", 0)["length"].alias("length"), "n_pieces", F.col("error").isNotNull().alias("is_bad"))


def fec_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "manifests").select("manifest_id", fec.needed(F.col("total_size")).alias("need"), fec.rounds(F.col("total_size")).alias("n_rounds"))


def fec_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source symbols of every document, those numbered 1 and 2 of each."""
    made = fec.encode_symbols(_docs(spark, sf_dir), "doc_id", "data", repair=0)
    return fec.symbol_range(made, F.lit(1), F.lit(2)).select("doc_id", "esi", F.sha2("payload", 256).alias("payload_hash"))


def fec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with 4 repair symbols, its first 3 symbols lost, decoded."""
    docs = _docs(spark, sf_dir)
    left = fec.encode_symbols(docs, "doc_id", "data", repair=4).where(F.col("esi") >= 3)
    got = fec.decode_symbols(left, "doc_id").withColumnRenamed("data", "got")
    return docs.join(got, "doc_id").select("doc_id", F.coalesce(F.sha2("got", 256) == F.sha2("data", 256), F.lit(False)).alias("recovered"))


def dedup_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents and of copies edited near the front, in one store."""
    docs = _docs(spark, sf_dir)
    edited = docs.withColumn("data", F.concat(F.substring("data", 1, 200), F.lit(b"-- inserted --"), F.substring("data", 201, 2147483647)))
    cut = lambda d: ck.content_chunks(d, "doc_id", "data", LEAST, AVERAGE, MOST)
    return sc.dedup_of_edit(cut(docs), cut(edited), "hash")


def permanence(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "chunk_refs").select(hex_key("hash").alias("key"), "site", "ref_id").where("key IS NOT NULL")
    own = sc.permanence(refs, "key", "site", "ref_id")
    return own.groupBy("seeder").agg(F.count("*").alias("n_chunks"), F.count_if("survives").alias("n_surviving"))


def _freeriding(spark: SparkSession, sf_dir: str, threshold: int | None) -> DataFrame:
    judged = rp.choke_admission(_requests(spark, sf_dir), "pair", "delivery_id", "bytes", F.lit(0), threshold)
    return sc.completed(judged, ["pair"]).agg(F.count("*").alias("downloads"), F.count_if("completes").alias("completed"))


def free_riding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.report({"choke_off": _freeriding(spark, sf_dir, None), "choke_on": _freeriding(spark, sf_dir, 0)})


def receipt_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads of clients with a credit of 10 MB against those of cold ones."""
    r = _requests(spark, sf_dir)
    rows = {n: sc.completed(rp.choke_admission(r, "pair", "delivery_id", "bytes", F.lit(c), 0), ["pair"]).agg(F.count("*").alias("downloads"), F.count_if("completes").alias("completed")) for n, c in (("vouched", 10_000_000), ("cold", 0))}
    return sc.report(rows)


def multi_serve(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "chunk_refs").where("site IS NOT NULL").select("site", hex_text("root").alias("root")).distinct()
    per_root = refs.groupBy("root").agg(F.count("*").alias("n_providers"))
    return refs.join(per_root, "root").groupBy("site").agg(F.count("*").alias("n_roots"), F.sum("n_providers").alias("sum_providers"))


def fec_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "manifests")
    return m.agg(F.sum(F.greatest("n_chunks", F.lit(0))).alias("chunk_requests"), F.sum(fec.rounds(F.col("total_size"))).alias("symbol_requests"))


def scenario_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    perm = permanence(spark, sf_dir).agg(F.sum("n_chunks").alias("chunks"), F.sum("n_surviving").alias("surviving"))
    return sc.report({
        "permanence": perm, "freeride_off": _freeriding(spark, sf_dir, None), "freeride_on": _freeriding(spark, sf_dir, 0), "fec": fec_cost(spark, sf_dir),
        "multi_serve": multi_serve(spark, sf_dir).agg(F.max("n_roots").alias("most_roots"), F.count("*").alias("n_sites")),
    })


QUERIES = {
    f.__name__: f
    for f in (
        ledger_counters, ledger_totals, reputation, counters_lookup, unchoke_rank, receipt_canonical, receipt_bag_top50, receipt_submit, receipt_credit,
        choke_admission, choke_with_credits, receipts_issued, first_contact, signed_manifests, missing_chunks, download_report, provider_round_robin,
        bytes_by_provider, manifest_first_responder, providers_by_root, provide_state, record_lookup, multiaddr_parse, built_addresses, scraped_output,
        candidate_union, sequential_candidate, request_dispatch, tracker_latest, tracker_peers_ttl, peers_response, announce_validation, announce_lines,
        tracker_answers, request_parse, error_id, event_build, progress_throttle, terminal_event_check, status_report, mapping_key, resolve_or_convert,
        mapping_resolve, resolve_checked, bridge_publish, receipts_signed, download_dir, torrent_meta, fec_need, fec_symbols, fec_roundtrip, dedup_scenario, permanence, free_riding, receipt_trust,
        multi_serve, fec_cost, scenario_report,
    )
}

from chunkloom.plans.swarm_sql import SQL  # noqa: E402, F401
