"""What the plans must not have, and that scans read only what they need."""

import os
import re

import pytest
from test_queries import DATA, core

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(core("QUERIES")))
def test_no_query_pairs_all_rows(spark, name):
    text = plan(core("QUERIES")[name](spark, DATA))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)


@pytest.mark.parametrize(("name", "columns"), [
    ("p5_found", {"hash", "server"}), ("store_put_is_new", {"ref_id", "hash"}), ("receipt_bag_top50", {"delivery_id", "server", "client", "bytes", "epoch", "sig"}),
    ("tree_shape", {"root", "file_path"}), ("fec_need", {"manifest_id", "total_size"}),
])
def test_scans_read_only_needed_columns(spark, name, columns):
    text = plan(core("QUERIES")[name](spark, DATA))
    read = {c for m in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in re.findall(r"(\w+):", m)}
    assert read <= columns


def test_filters_reach_the_scan_and_top_k_is_limited_early(spark):
    assert "IsNotNull(site)" in plan(core("QUERIES")["multi_serve"](spark, DATA))
    assert "WindowGroupLimit" in plan(core("QUERIES")["unchoke_rank"](spark, DATA))
    assert "WindowGroupLimit" in plan(core("QUERIES")["receipt_bag_top50"](spark, DATA))
