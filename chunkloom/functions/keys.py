"""Normalised hexadecimal text and compact, injective join keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hex_text(col: Column | str) -> Column:
    """Hex text as compared: white space trimmed on both sides, lower case."""
    return F.lower(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(" \t\r\n")))


def hex_key(col: Column | str) -> Column:
    """Binary key equal exactly when ``hex_text`` is equal; half the size for whole hex.

    A leading byte tells unhexed values (00) from text that isn't whole hex (01),
    so damaged text never meets another key. Null stays null.
    """
    text = hex_text(col)
    return F.when(text.rlike("^([0-9a-f]{2})+$"), F.concat(F.lit(b"\x00"), F.unhex(text))).otherwise(
        F.concat(F.lit(b"\x01"), F.encode(text, "UTF-8"))
    )


def hex_of_key(col: Column | str) -> Column:
    """The text a ``hex_key`` was made of."""
    c = F.col(col) if isinstance(col, str) else col
    body = F.substring(c, 2, 2147483647)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x00"), F.lower(F.hex(body))).otherwise(F.decode(body, "UTF-8"))


def identity_digest(*cols: Column) -> Column:
    """SHA-256 over length-prefixed values; null when any value is null."""
    parts = []
    for c in cols:
        s = c.cast("string")
        parts += [F.length(s).cast("string"), F.lit(":"), s]
    return F.unhex(F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256))
