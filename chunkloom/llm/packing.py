"""Filling fixed-capacity containers: first-fit decreasing in randomised groups.

Documents are dealt into groups of about ``GROUP_ITEMS`` by a hash of their id;
each group is packed on its own, largest item first, each into the first container
with room, found in a tournament tree over the containers' free room in O(log n).
A text above the capacity is cut into full pieces and a rest; no other is cut.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Expected documents of one group: large enough to pack tightly, small enough for any task.
GROUP_ITEMS = 20_000
TOKENIZER, MOST_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken", 32 << 20
#: Pre-splitting of texts that belongs to the byte-level vocabularies, a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str = PATTERN):
    """A public byte-level tokenizer from the content of its file; made once per worker."""
    import tiktoken

    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})


def vocabulary(path: str = TOKENIZER) -> bytes:
    """The tokenizer's file, read by the driver; at most ``MOST_RANKS`` bytes, as it is sent to every task."""
    with open(path, "rb") as f:
        ranks = f.read(MOST_RANKS + 1)
    if len(ranks) > MOST_RANKS:
        raise ValueError(f"{path}: more than {MOST_RANKS} bytes")
    return ranks


def token_counts(docs: DataFrame, ident: str, text: str, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``(ident, n_tokens)`` of every row; null and empty texts have 0 tokens. Only the driver needs the tokenizer's file."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value, pattern).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=[ident, "n_tokens"])

    return docs.select(F.col(ident).cast("bigint").alias(ident), text).mapInArrow(run, f"{ident} bigint, n_tokens bigint")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item (numbered from 0); items above the capacity aren't allowed.

    Equal sizes keep their order. Leaf i of the tournament tree is the free room of
    container i, an inner node the larger of its children: going down to the left
    wherever there's room finds the first container that fits.
    """
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    out = np.empty(n, np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, at = int(sizes[item]), 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        out[item] = at - leaves
        tree[at] -= size
        at >>= 1
        while at:
            room = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == room:
                break
            tree[at] = room
            at >>= 1
    return out


def pack(sizes: DataFrame, ident: str, capacity: int, n_items: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Contents of all containers from ``(ident, n_tokens)`` with unique ids.

    ``(container_id, slot, ident, piece, first_token, n_tokens, container_tokens)``; a
    text without tokens needs no room and has a null container. Ids may be null or
    repeated: rows are then still packed, each for itself.
    """
    groups = max(1, -(-n_items // group_items))
    dealt = sizes.select(F.col(ident).cast("bigint").alias("item"), "n_tokens", F.pmod(F.xxhash64(ident), F.lit(groups)).alias("grp"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        tokens = pdf["n_tokens"].to_numpy(np.int64)
        pieces = np.maximum(1, -(-tokens // capacity))
        row = np.repeat(np.arange(len(pdf)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, tokens[row] - piece * capacity)
        some = np.flatnonzero(size > 0)
        where = np.full(len(row), -1, np.int64)
        where[some] = first_fit_decreasing(size[some], capacity)
        out = pd.DataFrame({"item": pdf["item"].astype("Int64").array[row], "piece": piece, "first_token": piece * capacity, "n_tokens": size, "bin": where})
        out["container_tokens"] = out.groupby("bin")["n_tokens"].transform("sum")
        out["slot"] = out.groupby("bin").cumcount()
        out["grp"] = pdf["grp"].iloc[0]
        return out

    kept = "item bigint, piece bigint, first_token bigint, n_tokens bigint, bin bigint, container_tokens bigint, slot bigint, grp bigint"
    packed = dealt.groupBy("grp").applyInPandas(fill, kept)
    there = F.col("bin") >= 0
    return packed.select(
        F.when(there, F.col("grp") * F.lit(1 << 32) + F.col("bin")).alias("container_id"), F.when(there, F.col("slot")).alias("slot"),
        F.col("item").alias(ident), "piece", "first_token", "n_tokens", F.when(there, F.col("container_tokens")).alias("container_tokens"),
    )
