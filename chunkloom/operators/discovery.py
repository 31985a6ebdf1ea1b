"""Who has what, and from whom to fetch it: addresses, providers, plans, the tracker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.operators.prefix import dense_index

#: Seconds after which an announcement is no longer fresh; names in a row of a list; bits of a mask word used; names that the driver holds.
FRESH_S, PAGE, MASK_BITS, MOST_NAMES = 1800, 1000, 62, 100_000


def peer_of_address(address: Column | str) -> Column:
    """The last ``/p2p/`` part of an address: the target, also behind a relay; null without one."""
    address = F.col(address) if isinstance(address, str) else address
    return F.try_element_at(F.regexp_extract_all(address, F.lit("/p2p/([^/]+)"), F.lit(1)), F.lit(-1))


def udp_port(address: Column | str) -> Column:
    """The 16-bit number after the first ``/udp/``; null if there's none."""
    address = F.col(address) if isinstance(address, str) else address
    digits = F.regexp_extract(address, r"/udp/\+?([0-9]{1,9})(?:/|\z)", 1)
    first = F.when(F.get(F.split(address, "/udp/", -1), 1).startswith(digits) | F.get(F.split(address, "/udp/", -1), 1).startswith(F.concat(F.lit("+"), digits)), digits)
    port = F.when(F.length(first) > 0, first).try_cast("int")
    return F.when(port <= 65535, port)


def with_peer(address: Column, peer: Column) -> Column:
    """The address, ending in ``/p2p/`` and the peer, which isn't doubled."""
    suffix = F.concat(F.lit("/p2p/"), peer)
    return F.when(address.endswith(suffix), address).otherwise(F.concat(address, suffix))


def built_address(host_port: Column, peer: Column) -> tuple[Column, Column]:
    """(address, error) from a full address, or ``host:port`` and a peer id."""
    whole = host_port.startswith("/")
    host, port = F.regexp_extract(host_port, r"(?s)\A(.*):([^:]*)\z", 1), F.regexp_extract(host_port, r"(?s)\A(.*):([^:]*)\z", 2)
    error = F.when(whole, None).when(peer.isNull() | (peer == ""), "NoPeerId").when(~host_port.contains(":"), "NoPort")
    made = F.concat(F.lit("/ip4/"), host, F.lit("/udp/"), port, F.lit("/quic-v1/p2p/"), peer)
    return F.when(whole, host_port).when(error.isNull(), made), error


def scraped(text: Column, scheme: str) -> dict[str, Column]:
    """Link, files and chunks from the text that packing prints."""
    number = lambda name: F.regexp_extract(text, name + r":\s*(\d+)", 1)
    link = F.regexp_extract(text, f"({scheme}:\\w+)", 1)
    return {"link": F.when(link != "", link), "files": F.when(number("files") != "", number("files")).cast("bigint"), "chunks": F.when(number("chunks") != "", number("chunks")).cast("bigint")}


def download_report(chunks: DataFrame, held: DataFrame, tree: str, ordinal: str, key: str) -> DataFrame:
    """``(tree, fetched, deduped)`` of a local download: a chunk repeated in the manifest is deduplicated from the second on."""
    first = chunks.where(F.col(key).isNotNull()).groupBy(F.col(tree).alias("__t"), F.col(key).alias("__k")).agg(F.lit(1).alias("one"))
    new = first.join(held.select(F.col(key).alias("__h")).distinct(), F.col("__k") == F.col("__h"), "left_anti").groupBy("__t").agg(F.count("*").alias("fetched"))
    sizes = chunks.groupBy(tree).agg(F.count(key).alias("n"))
    met = sizes.join(new, F.col(tree).eqNullSafe(F.col("__t")), "left")
    return met.select(tree, F.coalesce("fetched", F.lit(0).cast("bigint")).alias("fetched"), (F.col("n") - F.coalesce("fetched", F.lit(0).cast("bigint"))).alias("deduped"))


def provider_dictionary(have: DataFrame, provider: str) -> list[str]:
    """The providers in order of their names; more than ``MOST_NAMES`` raise."""
    names = sorted(r[0] for r in have.where(F.col(provider).isNotNull()).select(provider).distinct().limit(MOST_NAMES + 1).collect())
    if len(names) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} providers")
    return names


def assign(missing: DataFrame, have: DataFrame, tree: str, ordinal: str, key: str, provider: str) -> DataFrame:
    """``missing`` with its ``slot`` in the tree and the ``provider`` to ask: slot k starts at provider k mod n and goes on in rotation.

    Who has a key is a bit mask per key, of as many words as the providers need (partially
    aggregated ors), so a key that all have costs one row. Null if nobody has it.
    """
    names = provider_dictionary(have, provider)
    n = len(names)
    if not n:
        return dense_index(missing, tree, ordinal, "slot").withColumn("provider", F.lit(None).cast("string"))
    listed = F.array(*map(F.lit, names))
    place = (F.array_position(listed, F.col(provider)) - 1).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(MASK_BITS)))
    words = [F.coalesce(F.bit_or(F.when(F.floor(place / MASK_BITS) == w, bit)), F.lit(0).cast("bigint")) for w in range(-(-n // MASK_BITS))]
    masks = have.where(F.col(provider).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.array(*words).alias("__m"))
    slotted = dense_index(missing, tree, ordinal, "slot").join(masks, F.col(key) == F.col("__k"), "left")
    at = lambda o: ((F.col("slot") + o) % n).cast("int")
    has = lambda p: F.call_function("getbit", F.coalesce(F.get("__m", F.floor(p / MASK_BITS).cast("int")), F.lit(0).cast("bigint")), F.pmod(p, F.lit(MASK_BITS))) == 1
    turn = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: has(at(o)))
    chosen = F.get(turn, 0)
    return slotted.select(*missing.columns, "slot", F.get(listed, at(chosen)).alias("provider"))


def first_valid(offers: DataFrame, key: str, order: str, valid: Column) -> DataFrame:
    """One row per key: the first offer that is valid, all columns. Providers are tried in ``order``, which is unique."""
    best = offers.where(F.coalesce(valid, F.lit(False))).groupBy(key).agg(F.min(order).alias("__o")).select("__o")
    return offers.join(best, F.col(order) == F.col("__o"), "left_semi")


def providers(found: DataFrame, root: str, peer: str, order: str) -> DataFrame:
    """``(root, page, providers)``: the distinct peers of each root in order of discovery, ``PAGE`` of them in a row."""
    first = found.where(F.col(peer).isNotNull()).groupBy(root, peer).agg(F.min(order).alias("o"))
    placed = dense_index(first, root, "o", "nr")
    pages = placed.groupBy(root, F.floor(F.col("nr") / PAGE).cast("bigint").alias("page"))
    return pages.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", peer))), lambda x: x[peer]).alias("providers"))


def last_state(log: DataFrame, keys: list[str], order: list[str], op: str) -> DataFrame:
    """The last operation of each key."""
    return log.groupBy(*keys).agg(F.max_by(op, F.struct(*order)).alias(op))


def ordered_union(first: DataFrame, second: DataFrame, group: str, peer: str, order: str) -> DataFrame:
    """``(group, peer, nr)``: the distinct peers of the first list, then those of the second not already there.

    ``order`` is a whole number below 2**61, unique within a list.
    """
    later = F.lit(2**61)
    both = first.select(group, peer, F.col(order).cast("bigint").alias("__o")).unionByName(second.select(group, peer, (F.col(order).cast("bigint") + later).alias("__o")))
    place = both.where(F.col(peer).isNotNull()).groupBy(group, peer).agg(F.min("__o").alias("__o"))
    return dense_index(place, group, "__o", "nr").select(group, peer, (F.col("nr") + 1).alias("nr"))


def response(kind: Column, has: Column) -> Column:
    """The kind of answer to a request: manifests and symbols are answered as such, chunks with ``NotFound`` where there's none; other kinds are bad."""
    chunk = F.when(F.coalesce(has, F.lit(False)), "Chunk").otherwise("NotFound")
    return F.when(kind == "pack", chunk).when(kind == "torrent", "Symbols").when(kind == "path", "Manifest").otherwise("BadRequest")


# The tracker.


def latest_announces(announces: DataFrame, cid: str = "cid", peer: str = "peer", at: str = "ts", tie: str = "seq") -> DataFrame:
    """The last announcement of each (cid, peer) with its addresses and time; ties by ``tie``."""
    last = announces.where(F.col(cid).isNotNull() & F.col(peer).isNotNull()).groupBy(cid, peer).agg(F.max_by(F.struct("addrs", at), F.struct(at, tie)).alias("__l"))
    return last.select(cid, peer, "__l.addrs", F.col("__l")[at].alias(at))


def fresh_peers(announces: DataFrame, now: Column, ttl_s: int = FRESH_S) -> DataFrame:
    """Latest announcements strictly younger than ``ttl_s`` seconds."""
    return latest_announces(announces).where(F.col("ts") > now - F.expr(f"INTERVAL {ttl_s} SECONDS"))


def peers_response(fresh: DataFrame) -> DataFrame:
    """``(cid, count, page, peers)``: the fresh peers of each cid in order of name, and how many there are.

    A swarm of up to ``PAGE`` peers is one row, page 0. A larger one is dealt into as
    many pages as keep to that on average, by a hash of the peer, each in order of name.
    """
    sizes = fresh.groupBy(F.col("cid").alias("__c")).agg(F.count("*").alias("count"))
    met = fresh.select("cid", "peer").join(sizes, F.col("cid").eqNullSafe(F.col("__c")))
    page = F.pmod(F.xxhash64("peer"), F.ceil(F.col("count") / PAGE).cast("bigint"))
    return met.groupBy("cid", "count", page.alias("page")).agg(F.array_sort(F.collect_list("peer")).alias("peers"))


def announce_status(method: Column, cid: Column, peer: Column, n_addrs: Column) -> Column:
    """HTTP status of an announcement: 405 unless POST, 400 without cid, peer or address, else 200."""
    missing = lambda c: c.isNull() | (c == "")
    return F.when(F.coalesce(method != "POST", F.lit(True)), 405).when(missing(cid) | missing(peer) | (F.coalesce(n_addrs, F.lit(0)) == 0), 400).otherwise(200)


def route_status(path: Column, status: Column) -> Column:
    """404 for unknown paths, else the handler's status; ``/health`` and ``/`` are always 200."""
    return F.when(path.isin("/health", "/api/health", "/"), 200).when(path.isin("/announce", "/peers", "/api/announce", "/api/peers"), status).otherwise(404)


def tracker_answers(lines: DataFrame, line: str) -> DataFrame:
    """Peers of answers in JSON: addresses of ``addrs`` and ``addr`` that are addresses; peers without any are left out."""
    shape = "peers array<struct<peer:string,addrs:array<string>,addr:string>>"
    each = lines.select(*[c for c in lines.columns if c != line], F.explode(F.from_json(line, shape)["peers"]).alias("p"))
    every = F.when(F.col("p.addr").isNotNull(), F.array_append(F.coalesce("p.addrs", F.array().cast("array<string>")), F.col("p.addr"))).otherwise(F.coalesce("p.addrs", F.array().cast("array<string>")))
    valid = F.filter(every, lambda a: a.rlike(r"\A(/[^/\s]+)+\z"))
    got = each.select(*[c for c in lines.columns if c != line], F.col("p.peer").alias("peer"), valid.alias("addrs"))
    return got.where(F.col("peer").rlike(r"\A[0-9A-Za-z]+\z") & (F.size("addrs") > 0))
