"""Content hashes, hash-tree nodes and their text forms as column expressions."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

# Domain tags of leaves, inner nodes and the empty tree.
LEAF_TAG, NODE_TAG, EMPTY_TAG = b"\x00", b"\x01", b"\x02"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_hash(data: Column | str, digest: str = "sha256") -> Column:
    """32-byte hash of binary or text (as UTF-8); null stays null.

    ``sha256`` is computed in the JVM; ``blake3`` by an Arrow UDF in numpy.
    """
    data = _col(data)
    if digest == "sha256":
        return F.unhex(F.sha2(data, 256))
    if digest == "blake3":
        return blake3_udf()(data.cast("binary"))
    raise ValueError(f"unknown digest {digest!r}")


def hash_text(h: Column | str) -> Column:
    """64 lower-case hex digits."""
    return F.lower(F.hex(_col(h)))


def hash_from_text(text: Column | str) -> Column:
    """The 32 bytes of exactly 64 hex digits of either case; null for anything else."""
    t = _col(text)
    return F.when(t.rlike(r"\A[0-9a-fA-F]{64}\z"), F.unhex(t))


def short_form(h: Column | str) -> Column:
    """``Hash(`` the first 12 digits and an ellipsis ``)``, for logs."""
    return F.concat(F.lit("Hash("), F.substring(hash_text(h), 1, 12), F.lit("…)"))


def leaf_node(h: Column | str) -> Column:
    return content_hash(F.concat(F.lit(LEAF_TAG), _col(h)))


def inner_node(left: Column, right: Column) -> Column:
    return content_hash(F.concat(F.lit(NODE_TAG), left, right))


def empty_root() -> Column:
    return content_hash(F.lit(EMPTY_TAG))


# BLAKE3, fixed values of the published algorithm.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The compression of many blocks at once: arrays of n columns, 32-bit words; gives the 8 words of the chaining value."""
    n = words.shape[1]
    v = np.empty((16, n), np.uint32)
    v[:8] = cv
    for i in range(4):
        v[8 + i] = _IV[i]
    v[12], v[13] = (counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32)
    v[14], v[15] = length, flags
    m = words

    def rotr(x: np.ndarray, k: int) -> np.ndarray:
        return (x >> np.uint32(k)) | (x << np.uint32(32 - k))

    def mix(a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
        v[a] += v[b] + x
        v[d] = rotr(v[d] ^ v[a], 16)
        v[c] += v[d]
        v[b] = rotr(v[b] ^ v[c], 12)
        v[a] += v[b] + y
        v[d] = rotr(v[d] ^ v[a], 8)
        v[c] += v[d]
        v[b] = rotr(v[b] ^ v[c], 7)

    for turn in range(7):
        for k in range(4):
            mix(k, 4 + k, 8 + k, 12 + k, m[2 * k], m[2 * k + 1])
        for k in range(4):
            mix(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, m[8 + 2 * k], m[9 + 2 * k])
        if turn < 6:
            m = m[list(_PERMUTATION)]
    return v[:8] ^ v[8:]


def blake3(data: bytes) -> bytes:
    """BLAKE3-256 of one message; all its 1024-byte chunks are compressed side by side."""
    iv = np.array(_IV, np.uint32).reshape(8, 1)
    chunks = max(1, -(-len(data) // 1024))
    padded = np.frombuffer(data.ljust(chunks * 1024, b"\0"), "<u4").reshape(chunks, 16, 16)
    sizes = np.full(chunks, 1024)
    sizes[-1] = len(data) - (chunks - 1) * 1024
    blocks = np.maximum(1, -(-sizes // 64))
    cv = np.repeat(iv, chunks, 1)
    index = np.arange(chunks, dtype=np.uint64)
    for b in range(int(blocks.max())):
        on = np.flatnonzero(blocks > b)
        last = blocks[on] == b + 1
        length = np.where(last, sizes[on] - 64 * b, 64).astype(np.uint32)
        flags = np.where(last, _CHUNK_END, 0) + (_CHUNK_START if b == 0 else 0) + np.where(last & (chunks == 1), _ROOT, 0)
        cv[:, on] = _compress(cv[:, on], np.ascontiguousarray(padded[on, b].T), index[on], length, flags.astype(np.uint32))
    while cv.shape[1] > 1:
        # the left subtree is the largest power of two of chunks: pair neighbours, carry the odd one
        pairs = cv.shape[1] // 2
        words = np.concatenate([cv[:, 0 : 2 * pairs : 2], cv[:, 1 : 2 * pairs : 2]])
        flags = np.full(pairs, _PARENT + (_ROOT if cv.shape[1] == 2 else 0), np.uint32)
        up = _compress(np.repeat(iv, pairs, 1), words, np.zeros(pairs, np.uint64), np.full(pairs, 64, np.uint32), flags)
        cv = np.concatenate([up, cv[:, 2 * pairs :]], 1)
    return struct.pack("<8I", *cv[:, 0].tolist())


def blake3_udf():
    """The Arrow UDF ``binary -> binary`` of ``blake3``."""

    @F.udf("binary", useArrow=True)
    def digest(data):
        return None if data is None else blake3(bytes(data))

    return digest


def to_arrow_hex(values: list[bytes | None]) -> pa.Array:
    return pa.array([None if v is None else v.hex() for v in values], pa.string())
