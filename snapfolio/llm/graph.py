"""Connected groups of nodes that share buckets, without emitting all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from snapfolio.sources.scratch import passing, written

#: Rounds after which labels must have settled; each about doubles the reach of a label.
MOST_ROUNDS = 60
#: The last comparison carries texts to every bucket of their nodes. Beyond this number of rows the buckets are dealt into
#: slices, one compared after the other, so that their shuffle files take a quarter of the disk.
WHOLE_ROWS, SLICES = 50_000, 4


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of links ``a, b``: component is the least node
    that can be reached. Nodes without links are not in it.

    Every round takes the least label among the neighbours, then the label of that label.
    All joins are on a node and can be split where one node has very many links.
    """
    with passing() as stay:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = written(both.distinct(), "links")
        labels = written(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min("b").alias("label"))
            .select("node", F.least("node", "label").alias("label")),
            "labels",
        )
        for _ in range(MOST_ROUNDS):
            near = (
                both.join(labels, both["b"] == labels["node"])
                .groupBy("a")
                .agg(F.min("label").alias("near"))
            )
            nearer = labels.join(near, labels["node"] == near["a"]).select(
                "node", F.col("label").alias("was"), F.least("label", "near").alias("label")
            )
            far = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
            new = written(
                nearer.join(far, nearer["label"] == far["_n"], "left").select(
                    "node", F.least("label", F.coalesce("_l", "label")).alias("label"), "was"
                ),
                "labels",
            )
            labels = new.select("node", "label")
            if new.filter("label <> was").isEmpty():
                stay(new)
                return labels.withColumnRenamed("label", "component")
    raise RuntimeError("labels did not settle")


def rooted(links: DataFrame) -> DataFrame:
    """``components`` of links ``a, b`` with a < b of which every b has one: they form trees, and each round doubles
    the steps to a node's root. A round has a row per node, however many links a node has."""
    with passing() as stay:
        roots = links.select("a").distinct().join(links.select(F.col("b").alias("a")), "a", "left_anti")
        labels = written(
            links.select(F.col("b").alias("node"), F.col("a").alias("label")).union(roots.select("a", "a")), "labels"
        )
        for _ in range(MOST_ROUNDS):
            far = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
            new = written(
                labels.join(far, labels["label"] == far["_n"]).select(
                    "node", F.col("_l").alias("label"), F.col("label").alias("was")
                ),
                "labels",
            )
            labels = new.select("node", "label")
            if new.filter("label <> was").isEmpty():
                stay(new)
                return labels.withColumnRenamed("label", "component")
    raise RuntimeError("labels did not settle")


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose nodes are in different components. A node without component is its own."""

    def of(node: str) -> DataFrame:
        return groups.select(F.col("node").alias(node), F.col("component").alias(f"_{node}"))

    found = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return found.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components that ``groups`` become by more links. Only the groups that these links join are looked at."""
    if links.isEmpty():
        return groups

    def of(node: str) -> DataFrame:
        return groups.select(F.col("node").alias(node), F.col("component").alias(f"_{node}"))

    with passing() as stay:
        between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
            F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")
        )
        # Groups go by their least nodes, and so do groups of groups.
        merged = components(between.filter("a <> b").distinct())
        wider = merged.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        old = groups.join(wider, groups["component"] == wider["_n"], "left").select(
            "node", F.coalesce("_c", "component").alias("component")
        )
        new = merged.join(groups.select("node"), "node", "left_anti").select("node", "component")
        return stay(written(old.union(new), "groups"))


def bucket_components(
    rows: DataFrame,
    marks: DataFrame,
    table: Column,
    near: Callable[[str, str], Column],
    first_table: Callable[[str, str], Column],
    confirm: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``node, component`` over all links between nodes that share a bucket.

    rows         ``bucket, node`` (BIGINT), once per table and node
    marks        ``node`` and a few narrow columns
    table        the table that a bucket is in
    near         from the prefixes of two nodes' marks: a condition that holds for all links
    first_table  from the same: the first table in which the two share a bucket
    confirm      keeps of pairs ``a, b`` (a < b) those that are links

    First every node is compared with the least node of its buckets: with the least of these that may be near, which
    joins nearly all of a large group with one comparison and one link per node, then with the others that are in
    another component by then. Of the other pairs only those that are
    still in different components can matter, and all of these are compared. So the components are
    those of all links, though most pairs of a group are never made.
    """
    pivots = rows.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n"))
    crowded = written(rows.join(pivots.filter("n > 1"), "bucket"), "crowded")
    return crowded_components(crowded, marks, table, near, first_table, confirm)


def crowded_components(
    crowded: DataFrame,
    marks: DataFrame,
    table: Column,
    near: Callable[[str, str], Column],
    first_table: Callable[[str, str], Column],
    confirm: Callable[[DataFrame], DataFrame],
    whole: DataFrame | None = None,
    linked: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """``bucket_components`` from the written rows ``bucket, node, pivot, n`` of buckets with n > 1 nodes, of which
    the pivot is the least. With ``whole``, columns of a ``node``, and ``linked``, the condition on the prefixes of two
    nodes' columns that ``confirm`` stands for, the last comparison of all pairs makes links alone."""
    columns = [c for c in marks.columns if c != "node"]

    def named(prefix: str) -> DataFrame:
        return marks.select(*[F.col(c).alias(f"{prefix}{c}") for c in ["node", *columns]])

    first = crowded.filter("node > pivot").select(
        F.col("pivot").alias("x_node"), F.col("node").alias("y_node")
    ).distinct()
    first = (
        first.join(named("x_"), "x_node")
        .join(named("y_"), "y_node")
        .filter(near("x_", "y_"))
        .select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))
    )
    first = written(first, "pairs")
    least = written(first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    groups = rooted(written(confirm(least), "links"))
    tried = least.select(F.col("a").alias("_tried"), "b")
    others = first.join(tried, "b").filter(F.col("a") != F.col("_tried")).select("a", "b")
    groups = joined(groups, written(confirm(written(apart(others, groups), "pairs")), "links"))
    # In a bucket of two the only pair has been compared.
    placed = crowded.filter("n > 2").join(groups, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")
    )
    placed = written(placed, "placed")
    split = (
        placed.groupBy("bucket")
        .agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
        .filter("_lo <> _hi")
        .select("bucket")
    )
    rest = placed.join(split, "bucket", "left_semi").join(marks, "node")
    rest = written(rest if whole is None else rest.join(whole, "node"), "rest")
    rest = rest.withColumn("table", table)
    every = ["bucket", "table", "node", "component", *columns]
    if whole is not None:
        every += [c for c in whole.columns if c != "node"]

    def second(rest: DataFrame) -> DataFrame:
        x = rest.select(*[F.col(c).alias(f"x_{c}") for c in every])
        y = rest.select(*[F.col(c).alias(f"y_{c}") for c in every])
        # All of it is part of the join, so that a pair leaves the join once, or not at all.
        pairs = x.join(
            y,
            (F.col("x_bucket") == F.col("y_bucket"))
            & (F.col("x_node") < F.col("y_node"))
            & (F.col("x_component") != F.col("y_component"))
            & near("x_", "y_")
            & (F.col("x_table") == first_table("x_", "y_"))
            & (F.lit(True) if whole is None else linked("x_", "y_")),
        )
        return written(pairs.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")), "pairs")

    if whole is None:
        return joined(groups, written(confirm(second(rest)), "links"))
    slices = 1 if rest.count() <= WHOLE_ROWS else SLICES
    slice_of = F.pmod(F.xxhash64("bucket"), F.lit(slices))
    return joined(groups, reduce(DataFrame.union, [second(rest.filter(slice_of == k)) for k in range(slices)]))
