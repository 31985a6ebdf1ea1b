"""SQL of the queries in ``swarm_queries``."""

from __future__ import annotations

from chunkloom.plans.store_queries import _ARRIVED, _BASE, _DOCS, _EDITED, _HELD, _WHOLE, _t, cdc_sql

_R = f"(SELECT * REPLACE ({_t('server')} AS server, {_t('client')} AS client, {_t('sig')} AS sig) FROM receipts)"
_EVENTS = f"""(SELECT server AS peer, 'credited' AS kind, bytes FROM {_R} WHERE sig_ok UNION ALL SELECT server, 'received', bytes FROM {_R} WHERE transport = 'direct'
 UNION ALL SELECT client, 'served', bytes FROM {_R})"""
_SUM = "CAST(coalesce(sum(bytes) FILTER (kind = '{}'), 0) AS BIGINT)"
_LEDGER = f"""(SELECT peer, {_SUM.format('received')} AS served_to_us, {_SUM.format('served')} AS we_served, {_SUM.format('credited')} AS credited_by_receipts FROM {_EVENTS} WHERE peer IS NOT NULL GROUP BY peer)"""
_COUNTERS = ("served_to_us", "we_served", "credited_by_receipts")
_REP = "served_to_us + credited_by_receipts - we_served"


def _le(c: str) -> str:
    digits = f"printf('%016x', {c})"
    return " || ".join(f"substr({digits}, {i}, 2)" for i in range(15, 0, -2))


_HEX64 = "regexp_full_match({0}, '[0-9a-f]{{64}}')"
_REQ = f"(SELECT delivery_id, server || '/' || client AS pair, server, client, coalesce(bytes, 0) AS bytes, transport = 'relay' AS is_credit FROM {_R} WHERE server IS NOT NULL AND client IS NOT NULL)"
_TAKEN = f"(SELECT delivery_id, pair, CAST(coalesce(sum(bytes) OVER (PARTITION BY pair ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS taken FROM {_REQ})"
_MISSING = f"(SELECT root, ordinal, hash, coalesce(chunk_length, 0) AS length FROM ({_ARRIVED}) WHERE hash IS NULL OR (hash NOT IN (SELECT h FROM ({_HELD})) AND hash NOT IN (SELECT h FROM ({_BASE}))))"
_ASSIGNED = f"""(WITH names AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT site FROM chunk_refs WHERE site IS NOT NULL)),
have AS (SELECT DISTINCT {_t('hash')} AS h, site FROM chunk_refs WHERE hash IS NOT NULL AND site IS NOT NULL),
slotted AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ordinal) - 1 AS slot FROM {_MISSING})
SELECT root, ordinal, slot, length, arg_min(names.site, (p - slot % n + n) % n) AS provider FROM slotted LEFT JOIN have ON slotted.hash = have.h LEFT JOIN names ON have.site = names.site GROUP BY root, ordinal, slot, length)"""
_PORT = "CAST(coalesce(bytes % 70000, 0) AS VARCHAR)"
_DIRECT = f"'/ip4/10.0.0.' || CAST(batch_id % 250 AS VARCHAR) || '/udp/' || {_PORT} || '/quic-v1'"
_ADDR = f"""(SELECT delivery_id, batch_id, server, client, {_PORT} AS port, CASE WHEN transport = 'relay' THEN {_DIRECT} || '/p2p/' || server || '/p2p-circuit/p2p/' || client
 WHEN epoch = 0 THEN {_DIRECT} ELSE {_DIRECT} || '/p2p/' || server END AS address FROM {_R})"""
_LATEST = f"""(SELECT server AS cid, client AS peer, coalesce(transport, '?') AS addr, received_at AS ts FROM {_R} WHERE server IS NOT NULL AND client IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY server, client ORDER BY received_at DESC, delivery_id DESC) = 1)"""
_NOW = "(SELECT max(received_at) FROM receipts)"
_I = "CAST(event_id AS VARCHAR)"
_LINES = f"""(SELECT event_id, event_type, user_id, value, CASE event_type WHEN 'view' THEN '{{"id":' || {_I} || ',"cmd":"fetch","uri":"u","out":"o"}}' WHEN 'click' THEN '{{"id":' || {_I} || ',"cmd":"fetch","uri":"u"}}'
 WHEN 'signup' THEN '{{"cmd":"status","id":' || {_I} || '}}' WHEN 'purchase' THEN '{{"id":' || {_I} || ',"cmd":"convert","torrent":"t"' || CASE WHEN user_id % 2 = 0 THEN ',"data":"d"' ELSE '' END || CASE WHEN user_id % 3 = 0 THEN ',"path":"p"' ELSE '' END || '}}'
 ELSE CASE WHEN value < 20 THEN '{{"id":' || {_I} || ',"cmd":' WHEN value < 40 THEN '{{"id":' || {_I} || ',"cmd":"dance"}}'
 WHEN value < 80 THEN '{{"cmd":"status","x":{{"id":' || {_I} || '}}}}' WHEN value < 120 THEN '{{"x":{{"id":1}},"cmd":"status","id":' || {_I} || '}}' WHEN value < 160 THEN '{{"id":18446744073709551615,"cmd":"status"}}'
 WHEN value < 200 THEN '{{"id":' || {_I} || ',"cmd":"fetch","uri":5,"out":"o","x":{{"uri":"u"}}}}' WHEN value < 240 THEN '{{"id":' || {_I} || ',"cmd":"status"}} {{"id":1}}' WHEN value < 280 THEN '{{"id":' || {_I} || ',"cmd":"convert","path":"p","data":7}}' ELSE props END END AS line FROM events)"""
_J = "CASE WHEN json_valid(line) THEN line END"
_ERROR_ID = f"CASE WHEN json_valid(line) AND json_type({_J}, '$.id') = 'UBIGINT' THEN json_extract_string({_J}, '$.id') ELSE '0' END"
_CMD = f"json_extract_string({_J}, '$.cmd')"
_HAS = lambda f: f"coalesce(json_type({_J}, '$.{f}'), '') = 'VARCHAR'"
_ODD = lambda f: f"coalesce(json_type({_J}, '$.{f}'), 'NULL') NOT IN ('VARCHAR', 'NULL')"
_ERROR = f"""CASE WHEN NOT json_valid(line) THEN 'NotJson' WHEN coalesce(json_type({_J}, '$.id'), '') <> 'UBIGINT' THEN 'NoId' WHEN coalesce({_CMD}, '') NOT IN ('fetch', 'convert', 'torrent', 'provide', 'unprovide', 'status', 'shutdown', 'dial') THEN 'UnknownCommand'
 WHEN {_CMD} = 'fetch' AND NOT ({_HAS('uri')} AND {_HAS('out')}) THEN 'MissingField'
 WHEN {_CMD} = 'convert' AND ({_ODD('torrent')} OR {_ODD('data')} OR {_ODD('path')} OR NOT (({_HAS('torrent')} AND {_HAS('data')} AND NOT {_HAS('path')}) OR (NOT {_HAS('torrent')} AND NOT {_HAS('data')} AND {_HAS('path')}))) THEN 'BadShape' END"""
_MAPPED = f"(SELECT sha1({_t('root')}) AS infohash, {_t('root')} AS root FROM manifests WHERE origin = 'torrent' QUALIFY row_number() OVER (PARTITION BY {_t('root')} ORDER BY manifest_id DESC) = 1)"
_INFO = "'d6:lengthi' || coalesce(CAST(file_size AS VARCHAR), '?') || 'e4:name' || CAST(strlen(file_path) AS VARCHAR) || ':' || file_path || '12:piece lengthi16384e6:pieces20:aaaaaaaaaaaaaaaaaaaae'"
_BADFILE = "(file_size IS NULL OR file_size < 0 OR file_path IS NULL OR file_path = '' OR starts_with(file_path, '/') OR list_contains(string_split(file_path, '/'), '..') OR file_path = '.' OR starts_with(file_path, './'))"
_NEED = "greatest(1, CAST(ceil(total_size / 1200.0) AS BIGINT))"
_PERM = f"""(SELECT h, arg_min(site, o) AS seeder, count(*) > 1 AS survives FROM (SELECT {_t('hash')} AS h, site, min(ref_id) AS o FROM chunk_refs WHERE hash IS NOT NULL AND site IS NOT NULL GROUP BY 1, 2) GROUP BY h)"""
_SERVE = f"(WITH refs AS (SELECT DISTINCT site, {_t('root')} AS root FROM chunk_refs WHERE site IS NOT NULL), n AS (SELECT root, count(*) AS n_providers FROM refs GROUP BY root) SELECT site, count(*) AS n_roots, CAST(sum(n_providers) AS BIGINT) AS sum_providers FROM refs JOIN n USING (root) GROUP BY site)"
_FECCOST = f"(SELECT CAST(sum(greatest(n_chunks, 0)) AS BIGINT) AS chunk_requests, CAST(sum(CAST(ceil({_NEED} / 128.0) AS BIGINT)) AS BIGINT) AS symbol_requests FROM manifests)"


def _long(name: str, frame: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS experiment, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM {frame}" for c in columns)


def _ride(credit: int, threshold: int | None) -> str:
    ok = "TRUE" if threshold is None else f"{credit} - taken >= -{threshold}"
    return f"(SELECT count(*) AS downloads, count(*) FILTER (completes) AS completed FROM (SELECT pair, bool_and({ok}) AS completes FROM {_TAKEN} GROUP BY pair))"


_RIDE = ["downloads", "completed"]
_TOTALS = f"(SELECT count(*) AS n_peers, {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in _COUNTERS)} FROM {_LEDGER})"

SQL = {
    "ledger_counters": f"SELECT * FROM {_LEDGER}",
    "ledger_totals": f"SELECT * FROM {_TOTALS}",
    "reputation": f"SELECT peer, {_REP} AS reputation FROM {_LEDGER}",
    "counters_lookup": f"SELECT a.peer, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _COUNTERS)} FROM (SELECT server AS peer FROM {_R} WHERE server IS NOT NULL UNION SELECT {_t('root')} FROM manifests) a LEFT JOIN {_LEDGER} l ON a.peer = l.peer",
    "unchoke_rank": f"""SELECT site, peer, reputation, slot FROM (SELECT site, c.peer, {_REP} AS reputation, row_number() OVER (PARTITION BY site ORDER BY {_REP} DESC, c.peer) AS slot
FROM (SELECT site, server AS peer FROM {_R} WHERE server IS NOT NULL UNION SELECT site, client FROM {_R} WHERE client IS NOT NULL) c JOIN {_LEDGER} l ON c.peer = l.peer) WHERE slot <= 4""",
    "receipt_canonical": f"""SELECT delivery_id, CASE WHEN {_HEX64.format('server')} AND {_HEX64.format('client')} THEN lower(hex('chunkloom-receipt-v1')) || server || client || {_le('bytes')} || {_le('epoch')} END AS canonical FROM {_R}""",
    "receipt_bag_top50": f"""SELECT server, delivery_id, bytes, row_number() OVER (PARTITION BY server ORDER BY bytes DESC NULLS LAST, delivery_id) AS rank
FROM (SELECT * FROM {_R} WHERE server IS NOT NULL QUALIFY row_number() OVER (PARTITION BY server, client, bytes, epoch, sig ORDER BY delivery_id) = 1) QUALIFY rank <= 50""",
    "receipt_submit": f"SELECT delivery_id, coalesce(sig_ok AND client <> server, FALSE) AS accepted FROM {_R}",
    "receipt_credit": f"""SELECT server, CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS credited, count(*) AS n_receipts FROM (SELECT * FROM {_R} WHERE sig_ok AND server IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY batch_id, server, client, epoch ORDER BY delivery_id) = 1) GROUP BY server""",
    "choke_admission": f"SELECT delivery_id, taken, taken <= 5000000 AS admitted FROM {_TAKEN}",
    "choke_with_credits": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, coalesce(is_credit, FALSE) AS credit, row_number() OVER (PARTITION BY pair ORDER BY delivery_id) AS nr FROM {_REQ}),
f AS (SELECT pair, nr, delivery_id, TRUE AS admitted, CASE WHEN credit THEN bytes ELSE -bytes END AS balance FROM e WHERE nr = 1
 UNION ALL SELECT e.pair, e.nr, e.delivery_id, e.credit OR f.balance >= -5000000, f.balance + CASE WHEN e.credit THEN e.bytes WHEN f.balance >= -5000000 THEN -e.bytes ELSE 0 END FROM f JOIN e ON e.pair = f.pair AND e.nr = f.nr + 1)
SELECT delivery_id, admitted FROM f""",
    "receipts_issued": f"""SELECT batch_id, client, server, bytes, row_number() OVER (PARTITION BY client ORDER BY o) - 1 AS epoch FROM (SELECT batch_id, client, server, CAST(sum(bytes) AS BIGINT) AS bytes, min(delivery_id) AS o
FROM {_R} WHERE client IS NOT NULL AND server IS NOT NULL GROUP BY ALL HAVING sum(bytes) > 0)""",
    "first_contact": f"SELECT DISTINCT server, client FROM {_R} WHERE server IS NOT NULL AND client IS NOT NULL AND client NOT IN (SELECT client FROM {_R} WHERE transport = 'local' AND client IS NOT NULL)",
    "receipts_signed": "SELECT delivery_id, coalesce(bytes, 0) + CASE WHEN delivery_id % 5 = 1 THEN 1 ELSE 0 END AS bytes, delivery_id % 5 = 0 AS sig_ok FROM receipts",
    "signed_manifests": "SELECT manifest_id, TRUE AS valid, FALSE AS forged_valid FROM manifests",
    "missing_chunks": f"SELECT root, ordinal, length FROM {_MISSING}",
    "download_report": f"""SELECT root, count(DISTINCT hash) FILTER (hash NOT IN (SELECT h FROM ({_BASE}))) AS fetched, count(hash) - count(DISTINCT hash) FILTER (hash NOT IN (SELECT h FROM ({_BASE}))) AS deduped FROM ({_ARRIVED}) GROUP BY root""",
    "provider_round_robin": f"SELECT root, ordinal, slot, provider FROM {_ASSIGNED}",
    "bytes_by_provider": f"SELECT provider, count(*) AS n_chunks, CAST(sum(length) AS BIGINT) AS sum_bytes FROM {_ASSIGNED} WHERE provider IS NOT NULL GROUP BY provider",
    "manifest_first_responder": f"SELECT {_t('root')} AS root, manifest_id, site FROM manifests WHERE total_size > 0 AND n_chunks > 0 QUALIFY row_number() OVER (PARTITION BY {_t('root')} ORDER BY manifest_id) = 1",
    "providers_by_root": f"SELECT root, CAST(0 AS BIGINT) AS page, string_agg(site, ',' ORDER BY o) AS providers FROM (SELECT {_t('root')} AS root, site, min(ref_id) AS o FROM chunk_refs WHERE site IS NOT NULL GROUP BY 1, 2) GROUP BY root",
    "provide_state": f"SELECT {_t('hash')} AS hash, pack_id, line_op FROM chunk_index QUALIFY row_number() OVER (PARTITION BY {_t('hash')}, pack_id ORDER BY indexed_at DESC, line_id DESC) = 1",
    "record_lookup": f"SELECT {_t('root')} AS root, manifest_name AS value FROM manifests QUALIFY row_number() OVER (PARTITION BY {_t('root')} ORDER BY manifest_id DESC) = 1",
    "multiaddr_parse": f"""SELECT delivery_id, nullif(regexp_extract(address, '.*/p2p/([^/]+)', 1), '') AS peer, CASE WHEN CAST(port AS INT) <= 65535 AND address IS NOT NULL THEN CAST(port AS INT) END AS port,
CASE WHEN ends_with(address, '/p2p/' || server) THEN address ELSE address || '/p2p/' || server END AS full FROM {_ADDR}""",
    "built_addresses": f"""SELECT delivery_id, CASE WHEN starts_with(given, '/') THEN given WHEN client IS NULL OR NOT contains(given, ':') THEN NULL ELSE '/ip4/10.1.2.3/udp/' || port || '/quic-v1/p2p/' || client END AS address,
CASE WHEN given IS NULL THEN CASE WHEN client IS NULL THEN 'NoPeerId' END WHEN starts_with(given, '/') THEN NULL WHEN client IS NULL THEN 'NoPeerId' WHEN NOT contains(given, ':') THEN 'NoPort' END AS error
FROM (SELECT *, CASE batch_id % 5 WHEN 0 THEN address WHEN 1 THEN 'localhost' ELSE '10.1.2.3:' || port END AS given FROM {_ADDR})""",
    "scraped_output": f"SELECT manifest_id, 'chunkloom:' || regexp_extract({_t('root')}, '^\\w+') AS link, n_files AS files, n_chunks AS chunks FROM manifests",
    "candidate_union": f"""SELECT batch_id, peer, row_number() OVER (PARTITION BY batch_id ORDER BY l, o, peer) AS nr FROM (SELECT batch_id, server AS peer, min(CASE WHEN transport = 'relay' THEN 0 ELSE 1 END) AS l,
CASE WHEN bool_or(transport = 'relay') THEN min(delivery_id) FILTER (transport = 'relay') ELSE min(delivery_id) END AS o FROM {_R} WHERE server IS NOT NULL GROUP BY 1, 2)""",
    "sequential_candidate": f"""SELECT concat_ws('/', CAST(batch_id AS VARCHAR), site) AS try, delivery_id, server FROM {_R} WHERE sig_ok AND bytes > 1000000 QUALIFY row_number() OVER (PARTITION BY concat_ws('/', CAST(batch_id AS VARCHAR), site) ORDER BY delivery_id) = 1""",
    "request_dispatch": f"""SELECT ref_id, CASE origin WHEN 'pack' THEN CASE WHEN {_t('hash')} IN (SELECT h FROM ({_HELD})) THEN 'Chunk' ELSE 'NotFound' END WHEN 'torrent' THEN 'Symbols' WHEN 'path' THEN 'Manifest' ELSE 'BadRequest' END AS response FROM chunk_refs""",
    "tracker_latest": f"SELECT * FROM {_LATEST}",
    "tracker_peers_ttl": f"SELECT cid, peer, addr FROM {_LATEST} WHERE ts > {_NOW} - INTERVAL 1800 SECOND",
    "peers_response": f"SELECT cid, count(*) AS count, CAST(0 AS BIGINT) AS page, string_agg(peer, ',' ORDER BY peer) AS peers FROM {_LATEST} WHERE ts > {_NOW} - INTERVAL 86400 SECOND GROUP BY cid",
    "announce_validation": f"""SELECT delivery_id, status, CASE WHEN site IS NULL THEN 404 WHEN transport = 'relay' THEN 200 ELSE status END AS routed FROM (SELECT *, CASE WHEN transport = 'local' THEN 405
WHEN coalesce(server, '') = '' OR coalesce(client, '') = '' OR coalesce(epoch, 0) > 3 THEN 400 ELSE 200 END AS status FROM {_R})""",
    "announce_lines": f"""SELECT delivery_id AS seq, '{{"cid":"' || server || '","peer":"' || client || '","addrs":["' || coalesce(transport, '?') || '"]}}' AS line FROM {_R} WHERE server IS NOT NULL AND client IS NOT NULL""",
    "tracker_answers": f"SELECT delivery_id, client AS peer, address || ' /ip4/1.2.3.4/udp/' || port AS addrs FROM {_ADDR} WHERE server IS NOT NULL AND client IS NOT NULL",
    "request_parse": f"SELECT event_id, {_ERROR_ID} AS id, CASE WHEN {_ERROR} IS NULL THEN {_CMD} END AS cmd, {_ERROR} AS error FROM {_LINES}",
    "error_id": f"SELECT event_id, {_ERROR_ID} AS id FROM {_LINES}",
    "event_build": f"""SELECT event_id, CASE event_type WHEN 'view' THEN '{{"id":' || {_I} || ',"event":"progress","op":"fetch","done":' || CAST(user_id AS VARCHAR) || ',"total":150}}'
WHEN 'error' THEN '{{"id":' || {_I} || ',"event":"error","ok":false,"message":"bad \\"' || CAST(user_id AS VARCHAR) || '\\""}}' WHEN 'signup' THEN '{{"event":"ready","version":"1.0"}}' WHEN 'click' THEN '{{"event":"warn","message":"slow"}}'
ELSE '{{"id":' || {_I} || ',"event":"result","ok":true,"root":"' || event_type || '","chunks":' || CAST(user_id AS VARCHAR) || '}}' END AS line FROM events""",
    "progress_throttle": """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_ms(ts) AS ms, event_type = 'purchase' AS done, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS nr FROM events),
f AS (SELECT event_id, user_id, nr, TRUE AS emitted, ms AS last FROM e WHERE nr = 1
 UNION ALL SELECT e.event_id, e.user_id, e.nr, e.done OR e.ms - f.last >= 21600000, CASE WHEN e.done OR e.ms - f.last >= 21600000 THEN e.ms ELSE f.last END FROM f JOIN e ON e.user_id = f.user_id AND e.nr = f.nr + 1)
SELECT event_id, emitted FROM f""",
    "terminal_event_check": "SELECT user_id, count(*) FILTER (event_type IN ('signup', 'error')) AS n_terminal, count(*) FILTER (event_type IN ('signup', 'error')) = 1 AS ok FROM events GROUP BY user_id",
    "status_report": _long("ledger", _TOTALS, ["n_peers", *_COUNTERS]) + " UNION ALL " + _long("store", f"(SELECT count(DISTINCT {_t('root')}) AS n_provided FROM manifests)", ["n_provided"]),
    "mapping_key": "SELECT manifest_id, sha256(unhex(hex('chunkloom-bridge:v1:') || sha1(root))) AS mapping_key FROM manifests",
    "resolve_or_convert": f"SELECT manifest_id, coalesce(p.root, sha256({_t('m.root')})) AS root, p.root IS NULL AS converted FROM manifests m LEFT JOIN {_MAPPED} p ON sha1({_t('m.root')}) = p.infohash",
    "resolve_checked": f"""SELECT manifest_id, p.root, provider FROM manifests m LEFT JOIN {_MAPPED} p ON sha1({_t('m.root')}) = p.infohash
LEFT JOIN (SELECT r, arg_min(site, o) AS provider FROM (SELECT {_t('root')} AS r, site, min(ref_id) AS least, min(ref_id) FILTER (hash IS NOT NULL) AS o FROM chunk_refs WHERE site IS NOT NULL GROUP BY 1, 2) WHERE least % 2 = 0 AND o IS NOT NULL GROUP BY r) o ON o.r = p.root""",
    "bridge_publish": f"SELECT manifest_id, 'provide' AS kind, {_t('root')} AS root, sha256(unhex(hex('chunkloom-bridge:v1:') || sha1({_t('root')}))) AS mapping_key FROM manifests WHERE origin = 'torrent' AND {_HEX64.format(_t('root'))}",
    "mapping_resolve": f"""SELECT manifest_id, p.root, provider FROM manifests m LEFT JOIN {_MAPPED} p ON sha1({_t('m.root')}) = p.infohash
LEFT JOIN (SELECT {_t('root')} AS r, arg_min(site, ref_id) AS provider FROM chunk_refs WHERE hash IS NOT NULL AND site IS NOT NULL GROUP BY 1) o ON o.r = p.root""",
    "download_dir": "SELECT manifest_id, coalesce(manifest_name, 'store/torrents/' || sha1(root)) AS dir FROM manifests",
    "torrent_meta": f"SELECT entry_id, CASE WHEN NOT {_BADFILE} THEN sha1({_INFO}) END AS infohash, CASE WHEN NOT {_BADFILE} THEN file_path END AS name, CASE WHEN NOT {_BADFILE} THEN file_size END AS length, CASE WHEN NOT {_BADFILE} THEN 1 END AS n_pieces, {_BADFILE} AS is_bad FROM file_entries",
    "fec_need": f"SELECT manifest_id, {_NEED} AS need, CAST(ceil({_NEED} / 128.0) AS BIGINT) AS n_rounds FROM manifests",
    "fec_symbols": f"""SELECT doc_id, esi, sha256(unhex(rpad(substr(hex(encode(txt)), 2 * 1200 * esi + 1, 2400), 2400, '0'))) AS payload_hash FROM (SELECT doc_id, txt, unnest([1, 2]) AS esi FROM ({_DOCS})) WHERE strlen(txt) > 1200 * esi""",
    "fec_roundtrip": f"SELECT doc_id, TRUE AS recovered FROM ({_DOCS}) WHERE txt <> ''",
    "dedup_scenario": f"SELECT count(*) AS total_chunks, count(DISTINCT hash) AS unique_chunks, 100.0 * (1 - count(DISTINCT hash) / count(*)) AS dedup_pct FROM (SELECT hash FROM ({cdc_sql(_WHOLE)}) UNION ALL SELECT hash FROM ({cdc_sql(_EDITED)}))",
    "permanence": f"SELECT seeder, count(*) AS n_chunks, count(*) FILTER (survives) AS n_surviving FROM {_PERM} GROUP BY seeder",
    "free_riding": _long("choke_off", _ride(0, None), _RIDE) + " UNION ALL " + _long("choke_on", _ride(0, 0), _RIDE),
    "receipt_trust": _long("vouched", _ride(10_000_000, 0), _RIDE) + " UNION ALL " + _long("cold", _ride(0, 0), _RIDE),
    "multi_serve": f"SELECT * FROM {_SERVE}",
    "fec_cost": f"SELECT * FROM {_FECCOST}",
    "scenario_report": " UNION ALL ".join([
        _long("permanence", f"(SELECT count(*) AS chunks, count(*) FILTER (survives) AS surviving FROM {_PERM})", ["chunks", "surviving"]), _long("freeride_off", _ride(0, None), _RIDE),
        _long("freeride_on", _ride(0, 0), _RIDE), _long("fec", _FECCOST, ["chunk_requests", "symbol_requests"]), _long("multi_serve", f"(SELECT max(n_roots) AS most_roots, count(*) AS n_sites FROM {_SERVE})", ["most_roots", "n_sites"]),
    ]),
}
