"""Cutting byte strings into pieces: content-defined chunks and fixed-size pieces.

Content-defined cuts depend on a hash of the last ``WINDOW`` bytes only, so an edit
moves no cut far from it. The cut points are this project's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.operators.prefix import running_total

#: Sizes of the default form: least, average, largest.
MIN_SIZE, AVG_SIZE, MAX_SIZE = 16 << 10, 64 << 10, 256 << 10
WINDOW = 16


@lru_cache(maxsize=1)
def gear_table() -> np.ndarray:
    """A pseudo-random 32-bit number per byte value: the first four bytes of its SHA-256."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)


def window_hashes(data: np.ndarray) -> np.ndarray:
    """Per position the hash of the bytes up to and with it: sum of gear[b[i-j]] * 2**j for j < WINDOW, mod 2**32."""
    out = gear_table()[data]
    step = 1
    while step < WINDOW:  # the sum over 2n bytes from two sums over n
        wider = out.copy()
        wider[step:] += out[:-step] << np.uint32(step) if step < len(out) else 0
        out, step = wider, 2 * step
    return out


def masks(average: int) -> tuple[int, int]:
    """(strict, loose): low bits that must be zero before and after the average size."""
    bits = max(1, average.bit_length() - 1)
    return (1 << (bits + 1)) - 1, (1 << max(0, bits - 1)) - 1


def cut_points(data: bytes, least: int = MIN_SIZE, average: int = AVG_SIZE, most: int = MAX_SIZE) -> list[int]:
    """Ends of the chunks; none for no bytes. A chunk has ``least`` bytes or more (but the last) and ``most`` at most."""
    if not data:
        return []
    h = window_hashes(np.frombuffer(data, np.uint8))
    strict, loose = masks(average)
    # a cut behind position i: chunk length i + 1 - start
    at_loose = np.flatnonzero(h & np.uint32(loose) == 0)
    at_strict = np.flatnonzero(h & np.uint32(strict) == 0)
    ends, start, n = [], 0, len(data)
    while n - start > least:
        a = np.searchsorted(at_strict, start + least - 1)
        b = np.searchsorted(at_loose, start + average - 1)
        one = int(at_strict[a]) + 1 if a < len(at_strict) else n
        two = int(at_loose[b]) + 1 if b < len(at_loose) else n
        end = min(one if one < start + average else two, start + most, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def cut_stream(blocks: Iterable[bytes], least: int = MIN_SIZE, average: int = AVG_SIZE, most: int = MAX_SIZE) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the chunks of a file that comes in blocks: those of ``cut_points``, with a block and ``most`` bytes held at once."""
    strict, loose = masks(average)
    before, held, at = b"", b"", 0  # the last bytes cut off, which hashes still rest on
    source = iter(blocks)
    while True:
        block = next(source, None)
        held += block or b""
        if block is not None and len(held) < most:
            continue
        h = window_hashes(np.frombuffer(before + held, np.uint8))[len(before) :] if held else np.zeros(0, np.uint32)
        at_loose = np.flatnonzero(h & np.uint32(loose) == 0)
        at_strict = np.flatnonzero(h & np.uint32(strict) == 0)
        start, n = 0, len(held)
        # a cut is settled once ``most`` bytes are there, or the file's end
        while n - start >= most or (block is None and n > start):
            end = n
            if n - start > least:
                a, b = np.searchsorted(at_strict, start + least - 1), np.searchsorted(at_loose, start + average - 1)
                one = int(at_strict[a]) + 1 if a < len(at_strict) else n
                two = int(at_loose[b]) + 1 if b < len(at_loose) else n
                end = min(one if one < start + average else two, start + most, n)
            yield at + start, held[start:end]
            start = end
        if block is None:
            return
        before, held, at = (before + held[:start])[-(WINDOW - 1) :], held[start:], at + start


def content_chunks(
    files: DataFrame, ident: str, data: str, least: int = MIN_SIZE, average: int = AVG_SIZE, most: int = MAX_SIZE, with_bytes: bool = False
) -> DataFrame:
    """Chunks ``(ident, ordinal, file_offset, length, hash)`` of each file, in order; the file is a bounded row.

    ``ident`` is a 64-bit integer. Null and empty data give no chunks.
    """
    fields = f"{ident} bigint, ordinal bigint, file_offset bigint, length bigint, hash binary" + (", bytes binary" if with_bytes else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = 0
                for k, end in enumerate(cut_points(raw or b"", least, average, most)):
                    piece = raw[start:end]
                    for col, v in zip(cols, (key, k, start, end - start, hashlib.sha256(piece).digest(), piece), strict=True):
                        col.append(v)
                    start = end
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            take = 6 if with_bytes else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:take], kinds, strict=False)], names=[f.split()[0] for f in fields.split(", ")])

    return files.select(F.col(ident).cast("bigint"), F.col(data).cast("binary").alias("data")).mapInArrow(run, fields)


def fixed_pieces(files: DataFrame, tree: str, order: str, data: Column, size: int) -> DataFrame:
    """The files of a tree, joined in order, cut every ``size`` bytes: ``(tree, piece, length, bytes)``; the last is short.

    A piece may span files. Its bytes are gathered from slices, ``size`` bytes at most.
    Null and empty files add nothing; ``order`` is an integer, unique in a tree.
    """
    sized = files.select(F.col(tree), F.col(order), data.cast("binary").alias("data")).where(F.length("data") > 0)
    # only sizes go through the running total; the bytes are joined to it once
    slim = sized.select(F.col(tree).alias("__t"), F.col(order).alias("__o"), F.length("data").cast("bigint").alias("n"))
    bases = running_total(slim, "__t", "__o", F.col("n"), "base")
    placed = sized.join(bases, F.col(tree).eqNullSafe(F.col("__t")) & (F.col(order) == F.col("__o"))).drop("__t", "__o")
    first, last = F.floor(F.col("base") / size).cast("bigint"), F.floor((F.col("base") + F.col("n") - 1) / size).cast("bigint")
    slices = placed.select("*", F.explode(F.sequence(first, last)).alias("piece"))
    low, high = F.greatest(F.col("piece") * size, F.col("base")), F.least((F.col("piece") + 1) * size, F.col("base") + F.col("n"))
    part = F.substring(F.col("data"), (low - F.col("base") + 1).cast("int"), (high - low).cast("int"))
    cut = slices.select(tree, "piece", low.alias("low"), F.hex(part).alias("part"))
    joined = cut.groupBy(tree, "piece").agg(F.array_sort(F.collect_list(F.struct("low", "part"))).alias("parts"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda x: x["part"]), ""))
    return joined.select(tree, "piece", F.length(whole).cast("bigint").alias("length"), whole.alias("bytes"))


def verify_pieces(pieces: DataFrame, expected: DataFrame, tree: str, sha1: str = "sha1") -> DataFrame:
    """``(tree, n_pieces, n_bad, verified)``: pieces against expected SHA-1 texts ``(tree, piece, sha1)``.

    A piece on one side only is bad. A tree nobody expects, or without pieces, isn't verified.
    """
    own = pieces.select(F.col(tree).alias("t"), F.col("piece").alias("p"), F.sha1("bytes").alias("own"))
    want = expected.select(F.col(tree).alias("wt"), F.col("piece").alias("wp"), F.lower(sha1).alias("want"))
    both = own.join(want, (F.col("t") == F.col("wt")) & (F.col("p") == F.col("wp")), "full")
    bad = F.count_if(F.coalesce(F.col("own") != F.col("want"), F.lit(True)))
    return both.groupBy(F.coalesce("t", "wt").alias(tree)).agg(F.count("*").alias("n_pieces"), bad.alias("n_bad")).withColumn("verified", F.col("n_bad") == 0)
