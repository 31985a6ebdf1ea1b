import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chunkloom.functions import digest as dg
from chunkloom.operators import merkle as mk
from chunkloom.operators.prefix import dense_index, running_total

H = lambda x: hashlib.sha256(x).digest()


def levels_of(hashes):
    level = [H(b"\x00" + h) for h in hashes]
    out = [level]
    while len(level) > 1:
        level = [H(b"\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        out.append(level)
    return out


def leaves(spark, sizes):
    data = [(f"t{n}", i, H(f"chunk-{i}".encode())) for n in sizes for i in range(n)]
    return spark.createDataFrame(data, "tree string, idx bigint, h binary"), {f"t{n}": [H(f"chunk-{i}".encode()) for i in range(n)] for n in sizes}


SIZES = [1, 2, 3, 4, 5, 7, 8, 16, 31, 100, 1024, 1025, 2500]


def test_roots_match_a_plain_fold_for_odd_and_large_trees(spark):
    df, own = leaves(spark, SIZES)
    got = {r["tree"]: bytes(r["root"]) for r in mk.merkle_roots(df, "tree", "idx", "h").collect()}
    assert got == {t: levels_of(h)[-1][0] for t, h in own.items()}


def test_levels_list_every_node(spark):
    df, own = leaves(spark, [1, 2, 5, 31, 1030])
    got = {(r["tree"], r["level"], r["i"]): bytes(r["h"]) for r in mk.merkle_nodes(df, "tree", "idx", "h").collect()}
    want = {(t, k, i): n for t, h in own.items() for k, level in enumerate(levels_of(h)) for i, n in enumerate(level)}
    assert got == want


def test_every_proof_holds_and_forged_ones_do_not(spark):
    df, _ = leaves(spark, [1, 2, 3, 5, 7, 31])
    proofs = mk.merkle_proofs(mk.merkle_nodes(df, "tree", "idx", "h"), "tree", df, "idx").withColumnsRenamed({"tree": "t", "idx": "i"})
    roots = mk.merkle_roots(df, "tree", "idx", "h").withColumnRenamed("tree", "rt")
    met = df.join(proofs, (F.col("tree") == F.col("t")) & (F.col("idx") == F.col("i"))).join(roots, F.col("tree") == F.col("rt"))
    flags = met.select(mk.proof_holds("h", "steps", "root").alias("a"), mk.proof_holds(dg.leaf_node("h"), "steps", "root").alias("b")).collect()
    assert len(flags) == 49 and all(r["a"] and not r["b"] for r in flags)


def test_no_proof_out_of_range_and_empty_root(spark):
    df, _ = leaves(spark, [3])
    asked = spark.createDataFrame([("t3", 3), ("nobody", 0)], "tree string, idx bigint")
    assert mk.merkle_proofs(mk.merkle_nodes(df, "tree", "idx", "h"), "tree", asked, "idx").count() == 0
    assert mk.merkle_roots(df.limit(0), "tree", "idx", "h").count() == 0
    assert spark.range(1).select(dg.hash_text(dg.empty_root())).first()[0] == hashlib.sha256(b"\x02").hexdigest()


def test_hash_text_forms(spark):
    whole = "AB" * 32
    df = spark.createDataFrame([(whole,), (whole[:-1],), (whole + "\n",), ("zz" * 32,), (None,)], "t string")
    got = [r[0] for r in df.select(dg.hash_text(dg.hash_from_text("t"))).collect()]
    assert got == [whole.lower(), None, None, None, None]
    short = df.select(dg.short_form(dg.hash_from_text("t"))).first()[0]
    assert short == "Hash(" + "ab" * 6 + "…)"


@pytest.mark.parametrize(("data", "want"), [
    (b"", "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"),
    (b"\x00", "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"),
    (b"abc", "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"),
    (bytes(i % 251 for i in range(1024)), "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"),
    (bytes(i % 251 for i in range(1025)), "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"),
])
def test_blake3_vectors(data, want):
    assert dg.blake3(data).hex() == want


def test_blake3_as_a_column(spark):
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(dg.hash_text(dg.content_hash("t", "blake3"))).collect()] == [dg.blake3(b"abc").hex(), None]


def test_running_totals_over_blocks_nulls_and_ties_of_groups(spark):
    data = [("a", i * 40_000, i) for i in range(6)] + [(None, 5, None), (None, 70_000, 2), (None, None, 7)]
    df = spark.createDataFrame(data, "g string, o bigint, v bigint")
    got = {(r["g"], r["o"]): r["t"] for r in running_total(df, "g", "o", F.col("v"), "t").collect()}
    assert got == {("a", i * 40_000): sum(range(i)) for i in range(6)} | {(None, None): 0, (None, 5): 7, (None, 70_000): 7}
    assert rows(dense_index(df.where("g = 'a'"), "g", "o").select("idx")) == [(i,) for i in range(6)]
    assert dense_index(df.limit(0), "g", "o").count() == 0
