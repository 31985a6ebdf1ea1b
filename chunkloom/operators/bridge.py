"""Torrent metadata and the registry from info hashes to content ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Limits of the metadata format.
MOST_DEPTH, MOST_PIECE = 32, 64 << 20
MAPPING_TAG = b"chunkloom-bridge:v1:"


class MetaError(ValueError):
    """Why metadata can't be read."""


class _Reader:
    """Walks over encoded values with an explicit stack, so depth is data, not recursion."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def peek(self) -> bytes:
        return self.raw[self.at : self.at + 1]

    def string(self) -> bytes:
        colon = self.raw.find(b":", self.at)
        digits = self.raw[self.at : colon] if colon >= 0 else b""
        if not digits.lstrip(b"+").isdigit() or digits.count(b"+") > digits.startswith(b"+"):
            raise MetaError("bad string length")
        end = colon + 1 + int(digits)
        if end > len(self.raw):
            raise MetaError("string runs past the end")
        self.at = end
        return self.raw[colon + 1 : end]

    def integer(self) -> int:
        end = self.raw.find(b"e", self.at)
        body = self.raw[self.at + 1 : end] if end >= 0 else b""
        sign = body[:1] in (b"-", b"+")
        if not body[sign:].isdigit() or not -(2**63) <= int(body) < 2**63:
            raise MetaError("bad integer")
        self.at = end + 1
        return int(body)

    def value(self, depth: int = 0):
        """One value. Dictionaries keep the first of repeated keys, in the order written."""
        open_at: list = []  # containers being filled, with the key that waits for its value
        while True:
            c = self.peek()
            if depth + len(open_at) > MOST_DEPTH and c != b"e":
                raise MetaError("nested too deep")
            if open_at and isinstance(open_at[-1][0], dict) and c != b"e" and open_at[-1][1] is None:
                open_at[-1][1] = self.string()
                continue
            if c == b"i":
                got = self.integer()
            elif c.isdigit():
                got = self.string()
            elif c in (b"l", b"d"):
                self.at += 1
                open_at.append([[] if c == b"l" else {}, None])
                continue
            elif c == b"e" and open_at and open_at[-1][1] is None:
                self.at += 1
                got = open_at.pop()[0]
            else:
                raise MetaError("unexpected byte" if c else "unterminated")
            if not open_at:
                return got
            box = open_at[-1]
            if isinstance(box[0], dict):
                box[0].setdefault(box[1], got)
                box[1] = None
            else:
                box[0].append(got)


def decode(raw: bytes) -> tuple[object, int]:
    """The value at the front of ``raw`` and how many bytes it takes."""
    r = _Reader(raw)
    return r.value(), r.at


def _want(box: dict, key: bytes, kind: type, name: str):
    got = box.get(key) if isinstance(box, dict) else None
    if not isinstance(got, kind):
        raise MetaError(f"{name} missing")
    return got


def _safe(path: str) -> str:
    parts = path.split("/")
    if not path or path.startswith("/") or ".." in parts or parts[0] == ".":
        raise MetaError("unsafe path")
    return path


def _length(n: int) -> int:
    if n < 0:
        raise MetaError("length out of range")
    return n


def parse_metainfo(raw: bytes) -> dict:
    """``{infohash, name, files [(path, length)], piece_length, piece_hashes}``; raises ``MetaError``.

    The info hash is the SHA-1 of the info dictionary's bytes as they stand. What
    follows the info dictionary isn't looked at.
    """
    r = _Reader(raw)
    if r.peek() != b"d":
        raise MetaError("no dictionary")
    r.at = 1
    while True:
        if r.peek() in (b"e", b""):
            raise MetaError("info missing")
        if r.string() == b"info":
            break
        r.value()
    start = r.at
    info = r.value()
    name = _want(info, b"name", bytes, "name").decode("utf-8", "replace")
    piece = _want(info, b"piece length", int, "piece length")
    if not 0 < piece <= MOST_PIECE:
        raise MetaError("piece length out of range")
    pieces = _want(info, b"pieces", bytes, "pieces")
    if len(pieces) % 20:
        raise MetaError("pieces not a multiple of 20")
    if b"files" in info:
        files = []
        for entry in _want(info, b"files", list, "files"):
            length = _length(_want(entry, b"length", int, "file length"))
            parts = _want(entry, b"path", list, "file path")
            if not all(isinstance(p, bytes) for p in parts):
                raise MetaError("file path part")
            files.append((_safe("/".join(p.decode("utf-8", "replace") for p in parts)), length))
    else:
        files = [(_safe(name), _length(_want(info, b"length", int, "length")))]
    return {
        "infohash": hashlib.sha1(raw[start : r.at]).digest(), "name": name, "files": files, "piece_length": piece,
        "piece_hashes": [pieces[i : i + 20] for i in range(0, len(pieces), 20)],
    }


META = "infohash binary, name string, piece_length bigint, n_pieces bigint, files array<struct<path:string,length:bigint>>, error string"


def read_metainfo(df: DataFrame, ident: str, content: str) -> DataFrame:
    """``ident`` and the metadata of each torrent file, or ``error``; null content is an error too."""
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = pa.struct([("path", pa.string()), ("length", pa.int64())])
        kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.list_(file), pa.string()]
        for b in batches:
            rows = []
            for raw in b.column(1).to_pylist():
                try:
                    m = parse_metainfo(raw or b"")
                    rows.append((m["infohash"], m["name"], m["piece_length"], len(m["piece_hashes"]), [{"path": p, "length": n} for p, n in m["files"]], None))
                except MetaError as e:
                    rows.append((None, None, None, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=[ident, *(f.split()[0] for f in META.replace("array<struct<path:string,length:bigint>>", "a").split(", "))])

    return df.select(ident, F.col(content).cast("binary")).mapInArrow(run, f"{ident} {kind}, {META}")


def mapping_key(infohash: Column, tag: bytes = MAPPING_TAG) -> Column:
    """Key of the registry entry of an info hash."""
    return F.unhex(F.sha2(F.concat(F.lit(tag), infohash), 256))


def current_mappings(log: DataFrame, key: str, root: str, order: str) -> DataFrame:
    """The last registered root of each key; one that isn't 32 bytes is none."""
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(root), F.col(order)).alias("l")).select(key, F.col("l")[root].alias(root))
    return last.where(F.length(root) == 32)


def resolve_or_convert(asked: DataFrame, mappings: DataFrame, key: str, root: str, made: Column) -> DataFrame:
    """``asked`` with ``root`` and ``converted``: the registered root, else the one that converting makes."""
    met = asked.join(mappings.select(F.col(key).alias("__k"), F.col(root).alias("__r")), F.col(key) == F.col("__k"), "left")
    return met.select(*asked.columns, F.coalesce("__r", made).alias("root"), F.col("__r").isNull().alias("converted"))


def resolve(asked: DataFrame, mappings: DataFrame, offers: DataFrame, key: str, root: str, order: str, checks: DataFrame | None = None) -> DataFrame:
    """``asked`` with the root and the first offer that succeeds: mapping, then providers in order; null where none does.

    With ``checks (key, root, provider, verified)``, what the pieces of each download
    told (``verify_pieces``), an offer counts only if its content is that of the asked
    key; one that wasn't checked doesn't. So a mapping to other content gives nothing.
    """
    met = asked.join(mappings.select(F.col(key).alias("__k"), F.col(root).alias("root")), F.col(key) == F.col("__k"), "left")
    good = offers.where(F.coalesce("ok", F.lit(False))).select(F.col(root).alias("__or"), "provider", F.col(order).alias("__o"))
    if checks is None:
        first = good.groupBy("__or").agg(F.min_by("provider", "__o").alias("provider"))
        return met.join(first, F.col("root") == F.col("__or"), "left").select(*asked.columns, "root", "provider")
    told = checks.where("verified").select(F.col(key).alias("__ck"), F.col(root).alias("__cr"), F.col("provider").alias("__cp")).distinct()
    passed = told.join(good, (F.col("__cr") == F.col("__or")) & (F.col("__cp") == F.col("provider")))
    first = passed.groupBy("__ck", "__cr").agg(F.min_by("provider", "__o").alias("provider"))
    return met.join(first, (F.col(key) == F.col("__ck")) & (F.col("root") == F.col("__cr")), "left").select(*asked.columns, "root", "provider")


def publish(made: DataFrame, infohash: str, root: str, order: str) -> tuple[DataFrame, DataFrame]:
    """What announcing bridged content ``(infohash, root, order)`` appends: rows for the provider records and for the mappings.

    Providers get ``(root, kind, order)`` with kind ``provide``, mappings ``(key, root,
    order)`` with the key of ``mapping_key``. A null info hash or root announces nothing.
    """
    whole = made.where(F.col(infohash).isNotNull() & F.col(root).isNotNull())
    records = whole.select(F.col(root).alias("root"), F.lit("provide").alias("kind"), F.col(order).alias("order"))
    return records, whole.select(mapping_key(F.col(infohash)).alias("key"), F.col(root).alias("root"), F.col(order).alias("order"))


def download_dir(source: Column, base: str, chosen: Column | None = None) -> Column:
    """The folder of a download: the chosen one, else the SHA-1 of the input below ``base``."""
    own = F.concat(F.lit(base.rstrip("/") + "/"), F.sha1(source))
    return own if chosen is None else F.coalesce(chosen, own)
