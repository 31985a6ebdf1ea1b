"""Signing identities (Ed25519 of RFC 8032), in plain Python for small tables.

Points are kept in extended coordinates. Malformed keys and signatures are invalid,
never an error.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import functions as F, types as T

P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
_ROOT = pow(2, (P - 1) // 4, P)


def _recover_x(y: int, sign: int) -> int | None:
    if y >= P:
        return None
    x2 = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    if x2 == 0:
        return None if sign else 0
    x = pow(x2, (P + 3) // 8, P)
    if (x * x - x2) % P:
        x = x * _ROOT % P
    if (x * x - x2) % P:
        return None
    return P - x if x & 1 != sign else x


def _point(x: int, y: int) -> tuple[int, int, int, int]:
    return x, y, 1, x * y % P


_BY = 4 * pow(5, P - 2, P) % P
BASE, ZERO = _point(_recover_x(_BY, 0), _BY), (0, 1, 1, 0)


def _add(p: tuple, q: tuple) -> tuple:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _double(p: tuple) -> tuple:
    a, b = p[0] * p[0] % P, p[1] * p[1] % P
    h, g = a + b, a - b
    e, f = h - (p[0] + p[1]) ** 2 % P, 2 * p[2] * p[2] + g
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(k: int, p: tuple) -> tuple:
    """By digits of 4 bits, from the highest."""
    row = [ZERO]
    for _ in range(15):
        row.append(_add(row[-1], p))
    q = ZERO
    for shift in range(max(0, k.bit_length() - 1) // 4 * 4, -1, -4):
        q = _double(_double(_double(_double(q))))
        if (digit := k >> shift & 15):
            q = _add(q, row[digit])
    return q


def _table(p: tuple) -> list[list[tuple]]:
    """Multiples 0 to 15 of a point times 16**i for each of 64 digits."""
    table = []
    for _ in range(64):
        row = [ZERO]
        for _ in range(15):
            row.append(_add(row[-1], p))
        table.append(row)
        p = _add(row[-1], p)
    return table


@lru_cache(maxsize=1)
def _base_table() -> list[list[tuple]]:
    return _table(BASE)


def _times_by(table: list[list[tuple]], k: int) -> tuple:
    q = ZERO
    for row in table:
        if k & 15:
            q = _add(q, row[k & 15])
        k >>= 4
    return q


def _times_base(k: int) -> tuple:
    return _times_by(_base_table(), k)


#: Keys that a worker met: how often, and from the fourth time on the table of its multiples. A few keys sign most messages.
_MET: dict[bytes, list] = {}


def _key_point(key: bytes) -> tuple[tuple | None, list | None]:
    """The point of a public key (None if it's invalid or of small order), and its table if it's met often."""
    met = _MET.get(key)
    if met is None:
        if len(_MET) >= 2_000:
            _MET.clear()
        point = _unpack(key)
        met = _MET[key] = [None if point is None or _small(point) else point, 0, None]
    met[1] += 1
    if met[1] == 4 and met[0] is not None:
        met[2] = _table(met[0])
    return met[0], met[2]


def _same(p: tuple, q: tuple) -> bool:
    return (p[0] * q[2] - q[0] * p[2]) % P == 0 and (p[1] * q[2] - q[1] * p[2]) % P == 0


def _pack(p: tuple) -> bytes:
    inverse = pow(p[2], P - 2, P)
    x, y = p[0] * inverse % P, p[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(raw: bytes) -> tuple | None:
    y = int.from_bytes(raw, "little")
    x = _recover_x(y & ((1 << 255) - 1), y >> 255)
    return None if x is None else _point(x, y & ((1 << 255) - 1))


def _small(p: tuple) -> bool:
    return _same(_double(_double(_double(p))), ZERO)


@lru_cache(maxsize=10_000)
def _expand(seed: bytes) -> tuple[int, bytes, bytes]:
    """Secret number, prefix and public key of a seed."""
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | (1 << 254)
    return a, h[32:], _pack(_times_base(a))


def public_key(seed: bytes) -> bytes:
    return _expand(seed)[2]


def _scalar(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix, key = _expand(seed)
    r = _scalar(prefix, message)
    point = _pack(_times_base(r))
    return point + ((r + _scalar(point, key, message) * a) % ORDER).to_bytes(32, "little")


def verify(key: bytes | None, message: bytes | None, signature: bytes | None) -> bool:
    """Strict check: canonical numbers, no points of small order."""
    if key is None or message is None or signature is None or len(key) != 32 or len(signature) != 64:
        return False
    s = int.from_bytes(signature[32:], "little")
    own, table = _key_point(key)
    r = _unpack(signature[:32])
    if s >= ORDER or own is None or r is None or _small(r):
        return False
    h = _scalar(signature[:32], key, message)
    return _same(_times_base(s), _add(r, _times(h, own) if table is None else _times_by(table, h)))


@F.udf(T.BinaryType(), useArrow=True)
def public_key_udf(seed):
    return None if seed is None or len(seed) != 32 else public_key(bytes(seed))


@F.udf(T.BinaryType(), useArrow=True)
def sign_udf(seed, message):
    return None if seed is None or message is None or len(seed) != 32 else sign(bytes(seed), bytes(message))


@F.udf(T.BooleanType(), useArrow=True)
def verify_udf(key, message, signature):
    return verify(*(None if x is None else bytes(x) for x in (key, message, signature)))
