"""Hash trees over ordered leaves: roots, levels, inclusion proofs and their check.

An odd node of a level is carried up unchanged. Trees are folded in aligned blocks
of ``FAN`` leaves (a power of two): a block's fold is a node of the tree, so a tree
of any size takes a few rounds of groups of at most ``FAN`` hashes: as many as the
tallest tree needs. ``most`` bounds the leaves of a tree where the caller knows a bound
(the rows of the table, say); otherwise the largest position is looked up first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.functions.digest import empty_root, inner_node, leaf_node

FAN_LEVELS = 10
FAN = 1 << FAN_LEVELS


def rounds_for(most: int) -> int:
    """Rounds of folding that trees of up to so many leaves take."""
    rounds = 1
    while FAN**rounds < most:
        rounds += 1
    return rounds


def _most(leaves: DataFrame, index: str, most: int | None) -> int:
    return most if most is not None else (leaves.agg(F.max(index)).first()[0] or 0) + 1


def next_level(nodes: Column) -> Column:
    """The parents of an array of nodes."""
    half = F.sequence(F.lit(0), ((F.size(nodes) + 1) / 2).cast("int") - 1)
    return F.transform(half, lambda i: F.when(2 * i + 1 < F.size(nodes), inner_node(F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1))).otherwise(F.get(nodes, 2 * i)))


def fold_array(nodes: Column, levels: int = FAN_LEVELS) -> Column:
    """The root of an array of leaf nodes, at most ``2 ** levels`` of them; the empty root for none."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(F.size(nodes), F.lit(2)))).cast("int"))
    root = F.get(F.aggregate(steps, nodes, lambda acc, _: next_level(acc)), F.lit(0))
    return F.when(F.size(nodes) == 0, empty_root()).otherwise(root)


def _fold_blocks(nodes: DataFrame) -> DataFrame:
    block = F.floor(F.col("i") / FAN).cast("bigint")
    lists = nodes.groupBy("tree", block.alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("l"))
    return lists.select("tree", F.col("b").alias("i"), fold_array(F.transform("l", lambda x: x["h"])).alias("h"))


def merkle_roots(leaves: DataFrame, tree: str, index: str, chunk_hash: str, most: int | None = None) -> DataFrame:
    """``(tree, root)`` of each tree from its chunk hashes, at dense positions 0, 1, ...

    A tree without rows has no row here; its root is ``empty_root()``. Null hashes are
    not allowed: give every leaf a hash first. Null trees are one tree. A tree of more
    than ``most`` leaves that takes another round raises.
    """
    nodes = leaves.select(F.col(tree).alias("tree"), F.col(index).cast("bigint").alias("i"), leaf_node(chunk_hash).alias("h"))
    for _ in range(rounds_for(_most(leaves, index, most))):
        nodes = _fold_blocks(nodes)
    root = F.when(F.col("i") == 0, F.col("h")).otherwise(F.raise_error(F.lit("a tree has more leaves than stated")))
    return nodes.select(F.col("tree").alias(tree), root.alias("root"))


def merkle_nodes(leaves: DataFrame, tree: str, index: str, chunk_hash: str, most: int | None = None) -> DataFrame:
    """All nodes ``(tree, level, i, h)``, level 0 the leaf nodes; carried nodes are listed on every level.

    Blocks give ``FAN_LEVELS`` levels at once; their tops are the leaves of the next
    round. A tree's levels end with its root. ``most`` as in ``merkle_roots``.
    """
    base = leaves.select(F.col(tree).alias("tree"), F.col(index).cast("bigint").alias("i"), leaf_node(chunk_hash).alias("h"))
    height = base.groupBy(F.col("tree").alias("t")).agg(F.ceil(F.log2(F.count("*").cast("double"))).cast("int").alias("height"))
    top = _most(leaves, index, most)
    out, low = base.select("tree", F.lit(0).alias("level"), "i", "h"), 0
    for _ in range(rounds_for(top)):
        block = F.floor(F.col("i") / FAN).cast("bigint")
        lists = base.groupBy("tree", block.alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("l"))
        stack = F.aggregate(
            F.sequence(F.lit(1), F.lit(max(1, min(FAN_LEVELS, (top - 1).bit_length() - low)))), F.array(F.transform("l", lambda x: x["h"])),
            lambda acc, _: F.array_append(acc, next_level(F.element_at(acc, -1))),
        )
        each = lists.select("tree", "b", F.posexplode(stack).alias("k", "nodes")).where(F.col("k") > 0)
        flat = each.select("tree", "b", "k", F.posexplode("nodes").alias("p", "h"))
        at = F.col("b") * F.expr(f"shiftleft(1L, {FAN_LEVELS} - k)") + F.col("p")
        upper = flat.select("tree", (F.col("k") + low).cast("int").alias("level"), at.alias("i"), "h")
        out = out.unionByName(upper)
        base = lists.select("tree", F.col("b").alias("i"), fold_array(F.transform("l", lambda x: x["h"])).alias("h"))
        low += FAN_LEVELS
    small = F.when(F.col("height") <= (top - 1).bit_length(), F.col("height")).otherwise(F.raise_error(F.lit("a tree has more leaves than stated")))
    kept = out.join(height, F.col("tree").eqNullSafe(F.col("t"))).where(F.col("level") <= small)
    return kept.select(F.col("tree").alias(tree), "level", F.col("i"), "h")


def merkle_proofs(nodes: DataFrame, tree: str, asked: DataFrame, index: str) -> DataFrame:
    """``(tree, index, steps)`` for the asked leaves: siblings from the leaf up, with the side they are on.

    A level on which the node is carried gives no step; positions out of range give
    no row. ``nodes`` comes from ``merkle_nodes``; a leaf has one step per level, some
    tens at most.
    """
    known = nodes.select(F.col(tree).alias("t"), "level", F.col("i").alias("n"), "h")
    # the root's level and the number of leaves, so each leaf has a row per level of its own tree
    there = known.groupBy(F.col("t").alias("lt")).agg(F.max("level").alias("height"), F.count_if(F.col("level") == 0).alias("n_leaves"))
    probe = asked.select(F.col(tree).alias("at"), F.col(index).cast("bigint").alias("ai")).join(there, F.col("at").eqNullSafe(F.col("lt")))
    inside = probe.where((F.col("ai") >= 0) & (F.col("ai") < F.col("n_leaves")))
    levels = inside.select("at", "ai", F.explode(F.sequence(F.lit(0), F.greatest(F.col("height") - 1, F.lit(0)))).alias("k"))
    path = levels.withColumn("own", F.expr("shiftright(ai, k)"))
    sibling = F.col("own").bitwiseXOR(F.lit(1).cast("bigint"))
    # above the root there are no nodes, so the root finds no sibling
    joined = path.join(known, F.col("at").eqNullSafe(F.col("t")) & (F.col("k") == F.col("level")) & (sibling == F.col("n")), "left")
    step = F.when(F.col("h").isNotNull(), F.struct("k", (F.col("own") % 2 == 1).alias("sibling_on_left"), F.col("h").alias("hash")))
    lists = joined.groupBy("at", "ai").agg(F.array_sort(F.collect_list(step)).alias("s"))
    slim = F.transform("s", lambda x: F.struct(x["sibling_on_left"].alias("sibling_on_left"), x["hash"].alias("hash")))
    return lists.select(F.col("at").alias(tree), F.col("ai").alias(index), slim.alias("steps"))


def proof_holds(chunk_hash: Column | str, steps: Column | str, root: Column | str) -> Column:
    """Whether folding the steps onto the leaf gives the root; the position is only implied by the sides."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    top = F.aggregate(as_col(steps), leaf_node(chunk_hash), lambda acc, s: F.when(s["sibling_on_left"], inner_node(s["hash"], acc)).otherwise(inner_node(acc, s["hash"])))
    return F.coalesce(top == as_col(root), F.lit(False))
