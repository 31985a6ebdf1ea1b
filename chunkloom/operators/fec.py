"""Erasure coding: a systematic code over GF(256) in blocks, and the plans around it.

The source symbols of a content are cut into blocks of at most ``BLOCK`` and each block
gets repair symbols from a Cauchy matrix, so any as many symbols of a block as it has
source symbols rebuild it. Symbol numbers run over the blocks in turn, so a run of lost
numbers is spread evenly. Blocks are coded on their own: the work grows with the size,
and a content of any size is spread over tasks. The code is this project's own (the
same contract as fountain codes, not their bits).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chunkloom.sources.state import load_state, save_part

#: Bytes of a symbol, repair symbols of a served content, symbols asked for at once, source symbols of a block.
SYMBOL, REPAIR, BATCH, BLOCK = 1200, 64, 128, 128


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """All products and all inverses modulo x^8 + x^4 + x^3 + x^2 + 1, from the powers of the generator 2."""
    exp, log, x = np.zeros(510, np.uint8), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i], log[x] = x, i
        x = (x << 1) ^ (0x11D if x & 0x80 else 0)
    exp[255:] = exp[:255]
    product = exp[log[:, None] + log[None, :]]
    product[0], product[:, 0] = 0, 0
    return product, exp[255 - log]


def n_blocks(size: int, symbol: int = SYMBOL) -> int:
    """Blocks of a content: as few as hold its source symbols."""
    return max(1, -(-size // (symbol * BLOCK)))


def config_for(size: int, symbol: int = SYMBOL) -> bytes:
    """12 bytes that decoding needs, from size and symbol size alone: 5-byte size, a zero, 2-byte symbol size, 2-byte number of blocks, sub-blocks, alignment."""
    return size.to_bytes(5, "big") + b"\0" + struct.pack(">HHBB", symbol, n_blocks(size, symbol), 1, 8)


def _shape(size: int, symbol: int) -> tuple[int, np.ndarray]:
    """Source symbols of a content, and where each block begins among them (one more entry for the end)."""
    k, blocks = -(-size // symbol), n_blocks(size, symbol)
    sizes = k // blocks + (np.arange(blocks) < k % blocks)
    return k, np.r_[0, np.cumsum(sizes)].astype(np.int64)


def _place(esi: np.ndarray, k: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, number within the block) of symbols. The k source symbols and the repair symbols are dealt out in turn."""
    per, more = divmod(k, blocks)
    repair = np.maximum(esi - k, 0)
    block = np.where(esi < k, esi, repair) % blocks
    own = per + (block < more)
    return block, np.where(esi < k, esi // blocks, own + repair // blocks)


def _rows(numbers: np.ndarray, k: int) -> np.ndarray:
    """Coefficients of repair symbols over a block's ``k`` source symbols: a Cauchy matrix, random rows beyond its 256 - k."""
    out = _tables()[1][np.minimum(numbers, 255)[:, None] ^ np.arange(k)]
    for r in np.flatnonzero(numbers > 255).tolist():
        out[r] = np.random.default_rng([k, int(numbers[r])]).integers(1, 256, k, np.uint8)
    return out


def _mix(rows: np.ndarray, source: np.ndarray) -> np.ndarray:
    """The product of two matrices over GF(256)."""
    product, out = _tables()[0], np.zeros((len(rows), source.shape[1]), np.uint8)
    for c in range(rows.shape[1]):
        out ^= product[rows[:, c]][:, source[c]]
    return out


def _inverse(matrix: np.ndarray) -> np.ndarray | None:
    """The inverse over GF(256); None for a singular matrix."""
    product, inverse = _tables()
    n = len(matrix)
    both = np.concatenate([matrix, np.eye(n, dtype=np.uint8)], axis=1)
    for c in range(n):
        pivots = np.flatnonzero(both[c:, c])
        if not len(pivots):
            return None
        if pivots[0]:
            both[[c, c + pivots[0]]] = both[[c + pivots[0], c]]
        both[c] = product[inverse[both[c, c]], both[c]]
        factors = both[:, c].copy()
        factors[c] = 0
        both ^= product[factors][:, both[c]]
    return both[:, n:]


def encode(data: bytes, repair: int = REPAIR, symbol: int = SYMBOL) -> list[bytes]:
    """Source symbols (the last padded with zeros), then ``repair`` mixed ones, in order of number; none for no data."""
    if not data:
        return []
    k, begins = _shape(len(data), symbol)
    blocks = len(begins) - 1
    source = np.frombuffer(data.ljust(k * symbol, b"\0"), np.uint8).reshape(k, symbol)
    block, number = _place(np.arange(k + repair), k, blocks)
    out = np.empty((k + repair, symbol), np.uint8)
    out[:k] = source[begins[block[:k]] + number[:k]]
    for b in range(blocks):
        own = np.flatnonzero(block[k:] == b) + k
        part = source[begins[b] : begins[b + 1]]
        out[own] = _mix(_rows(number[own], len(part)), part)
    return [s.tobytes() for s in out]


def decode_block(k: int, numbers: np.ndarray, payloads: np.ndarray) -> np.ndarray | None:
    """A block's ``k`` source symbols from distinct symbols in any order; None if they don't suffice."""
    have = numbers < k
    source = np.zeros((k, payloads.shape[1]), np.uint8)
    source[numbers[have]] = payloads[have]
    lost = np.setdiff1d(np.arange(k), numbers[have])
    spare = np.flatnonzero(~have)
    if len(lost) > len(spare):
        return None
    if len(lost):
        order = spare[np.argsort(numbers[spare])]  # Cauchy rows first: any of them are independent
        used = order[: len(lost)]
        rows = _rows(numbers[used], k)
        inverse = _inverse(rows[:, lost])
        if inverse is None:  # random rows among them: all there are, by elimination
            rows = _rows(numbers[order], k)
            chosen = _independent(rows[:, lost])
            if len(chosen) < len(lost):
                return None
            used, rows = order[chosen], rows[chosen]
            inverse = _inverse(rows[:, lost])
        known = np.setdiff1d(np.arange(k), lost)
        source[lost] = _mix(inverse, payloads[used] ^ _mix(rows[:, known], source[known]))
    return source


def _independent(rows: np.ndarray) -> np.ndarray:
    """As many independent rows as there are, by number."""
    product, inverse = _tables()
    work, chosen = rows.copy(), []
    for r in range(len(work)):
        at = np.flatnonzero(work[r])
        if len(at):
            chosen.append(r)
            own = product[inverse[work[r, at[0]]], work[r]]
            factors = work[r + 1 :, at[0]].copy()
            work[r + 1 :] ^= product[factors][:, own]
        if len(chosen) == rows.shape[1]:
            break
    return np.array(chosen, np.int64)


def decode(size: int, symbols: list[tuple[int, bytes]], symbol: int = SYMBOL) -> bytes | None:
    """The content from (number, symbol) pairs in any order, padding cut off; None if they don't suffice. Symbols of another length don't count."""
    if size == 0:
        return b""
    kept = {int(e): p for e, p in symbols if len(p) == symbol}
    k, begins = _shape(size, symbol)
    esi = np.array(sorted(kept), np.int64)
    payloads = np.frombuffer(b"".join(kept[e] for e in esi.tolist()), np.uint8).reshape(-1, symbol)
    block, number = _place(esi, k, len(begins) - 1)
    out = []
    for b in range(len(begins) - 1):
        own = block == b
        got = decode_block(int(begins[b + 1] - begins[b]), number[own], payloads[own])
        if got is None:
            return None
        out.append(got.tobytes())
    return b"".join(out)[:size]


def encode_symbols(contents: DataFrame, root: str, data: str, repair: int = REPAIR, symbol: int = SYMBOL) -> DataFrame:
    """``(root, size, esi, payload)`` of each content, a bounded row; no symbols for null and empty ones."""
    kind = contents.schema[root].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, sizes, rows = [], [], []
            for i, raw in enumerate(b.column(1).to_pylist()):
                own = encode(raw or b"", repair, symbol)
                made.append(own)
                sizes += [len(raw or b"")] * len(own)
                rows += [i] * len(own)
                if len(rows) >= 4096 or (i == b.num_rows - 1 and rows):
                    esi = [e for o in made for e in range(len(o))]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(sizes, pa.int64()), pa.array(esi, pa.int64()), pa.array([p for o in made for p in o], pa.binary())], names=[root, "size", "esi", "payload"])
                    made, sizes, rows = [], [], []

    return contents.select(root, F.col(data).cast("binary")).mapInArrow(run, f"{root} {kind}, size bigint, esi bigint, payload binary")


def decode_symbols(symbols: DataFrame, root: str, symbol: int = SYMBOL) -> DataFrame:
    """``(root, data)`` from whatever symbols are there; null where they don't suffice.

    Symbols are brought together per block, so a task never gets more than one block's
    (repeated symbols aside, which are dropped as they come); null roots are one content.
    Symbols of another length don't count, those of an unknown size are left out.
    """
    kind = symbols.schema[root].dataType.simpleString()
    k = F.greatest(F.lit(1), F.ceil(F.col("size") / symbol)).cast("bigint")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / (symbol * BLOCK))).cast("bigint")
    turn = F.when(F.col("esi") < k, F.col("esi")).otherwise(F.col("esi") - k)
    dealt = symbols.where(F.col("size") >= 0).select(F.col(root).alias("root"), F.col("size").cast("bigint").alias("size"), F.pmod(turn, blocks).alias("block"), F.col("esi").cast("bigint").alias("esi"), "payload")
    placed = dealt.repartition("root", "block").sortWithinPartitions("root", "block", "esi")

    def solve(own: dict) -> bytes | None:
        size, esi = own["size"], np.array(own["esi"], np.int64)
        if size == 0:
            return b""
        total, begins = _shape(size, symbol)
        number = _place(esi, total, len(begins) - 1)[1]
        b = own["block"]
        got = decode_block(int(begins[b + 1] - begins[b]), number, np.frombuffer(b"".join(own["payload"]), np.uint8).reshape(-1, symbol))
        return None if got is None else got.tobytes()[: max(0, size - int(begins[b]) * symbol)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict | None = None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["root", "size", "block", "data"])

        for b in batches:
            key_type = b.schema.field(0).type
            for r, size, block, esi, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own is None or (own["root"], own["block"]) != (r, block):
                    if own is not None:
                        done.append((own["root"], own["size"], own["block"], solve(own)))
                    own = {"root": r, "size": size, "block": block, "esi": [], "payload": []}
                if payload is not None and len(payload) == symbol and (not own["esi"] or own["esi"][-1] != esi):
                    own["esi"].append(esi)
                    own["payload"].append(payload)
            if done:
                yield flush()
        if own is not None:
            done.append((own["root"], own["size"], own["block"], solve(own)))
            yield flush()

    solved = placed.mapInArrow(run, f"root {kind}, size bigint, block bigint, data binary")
    met = solved.groupBy("root").agg(F.max("size").alias("size"), F.count("data").alias("n"), F.array_sort(F.collect_list(F.when(F.col("data").isNotNull(), F.struct("block", "data")))).alias("parts"))
    whole = F.when(F.col("n") == blocks, F.col("parts.data"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [None if p is None else b"".join(p) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=[root, "data"])

    return met.select("root", whole.cast("array<binary>").alias("parts")).mapInArrow(join, f"{root} {kind}, data binary")


class SymbolCache:
    """Symbols of served contents, made once per root when first asked for, kept in a folder."""

    def __init__(self, spark: SparkSession, folder: str, root: str, repair: int = REPAIR, symbol: int = SYMBOL):
        self.spark, self.folder, self.root, self.repair, self.symbol = spark, folder, root, repair, symbol

    def symbols(self, contents: DataFrame, data: str) -> DataFrame:
        """The symbols of all ``contents``; only those of roots not there yet are made and appended."""
        shape = f"{self.root} {contents.schema[self.root].dataType.simpleString()}, size bigint, esi bigint, payload binary"
        kept = load_state(self.spark, self.folder, shape)
        new = contents.join(kept.select(self.root).distinct(), self.root, "left_anti")
        made = encode_symbols(new, self.root, data, self.repair, self.symbol)
        if new.take(1):
            save_part(made, self.folder)
        return load_state(self.spark, self.folder, shape).join(contents.select(self.root).distinct(), self.root, "left_semi")


def symbol_range(symbols: DataFrame, start: Column, count: Column) -> DataFrame:
    """Symbols ``[start, start + count)``; none past the end."""
    return symbols.where((F.col("esi") >= start) & (F.col("esi") < start + count))


def needed(size: Column, symbol: int = SYMBOL) -> Column:
    """Symbols to collect before decoding is tried: at least one."""
    return F.greatest(F.lit(1), F.ceil(size / symbol)).cast("bigint")


def rounds(size: Column, symbol: int = SYMBOL, batch: int = BATCH) -> Column:
    """Requests for that many symbols."""
    return F.ceil(needed(size, symbol) / batch).cast("bigint")
