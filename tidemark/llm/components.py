"""Connected components by alternating star steps (a distributed union-find) on built-in functions only.

Every round links each node to the smallest neighbour known, first from larger to smaller, then among the smaller ones,
until the edges form stars around the smallest node of each component. A hub with very many edges is joined like any
skewed key; no neighbour list is ever gathered. Rounds are cut by tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import few_tasks, shared_table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node in ``edges (a, b)``; the component is its smallest node."""
    size = edges.count()
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = shared_table(few_tasks(few_tasks(edges, size).distinct(), size), "links")
    before = _state(edges)
    while before[0]:
        few = lambda df, n=2 * before[0]: few_tasks(df, n)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = few(few(large).distinct())
        # each node's smaller neighbours, and the node itself, to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = shared_table(few(few(small.filter("a <> b")).distinct()), "links")
        now = _state(edges)
        if now == before:
            break
        before = now
    root = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return root.unionByName(few_tasks(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct(), size))


HUB_ROUNDS = 4
#: Per cent of similarity to a hub from which a member counts as near it and its differences are kept.
NEAR = 30


def _pairs(a: Column, b: Column, rows: DataFrame) -> DataFrame:
    """Distinct pairs; b is the side that many pairs share."""
    return rows.filter(a != b).select(a.alias("a"), b.alias("b")).distinct()


def _sized(tested: DataFrame) -> DataFrame:
    return tested.select("a", "b", "n", F.size("gone").cast("long").alias("r"), F.size("new").cast("long").alias("m"), "gone", "new")


def _linked(percent: int) -> Column:
    """Similarity of a to b: b has n elements, r of them are missing in a, which has m others."""
    return F.lit(100) * (F.col("n") - F.col("r")) >= F.lit(percent) * (F.col("n") + F.col("m"))


def _by_difference(near: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one hub that may be linked although one of them is not linked to the hub.

    A member, near or far, lacks r of the hub's n elements and adds m others. With ``load = (100 r + percent m) / (100 + percent)``,
    two members x, y are linked if and only if they have ``need = load_x + load_y - limit`` lacking or added elements in
    common, where ``limit = (100 - percent) n / (100 + percent)``; a member that the hub does not link has a load above
    the limit. Two members either share an added element, or all they share is lacking. In both cases the first shared
    element, by rarity among the hub's members, must stand so early in both lists that ``need`` can still be reached.
    Whatever y is, its load holds what it shares with x, so ``100 added + percent lacking`` of the numbers shared is at
    least ``100 r + percent m - (100 - percent) n``. Near copies with edits of their own almost never pass, and strangers
    with a passage in common do not, however many they are.
    """
    whole = 100 + percent
    rows = near.select("a", "b", (F.lit(100) * F.col("r") + F.lit(percent) * F.col("m")).alias("load"), (F.lit(100 - percent) * F.col("n")).alias("limit"), "r", "m", "gone", "new")
    apart = rows.filter("load > limit").select("b").distinct()
    size = rows.agg(F.count(F.lit(1)), F.sum(F.col("r") + F.col("m"))).head()
    few = lambda df: few_tasks(df, size[1] or 0)
    rows = few_tasks(rows.join(apart, "b", "left_semi"), size[0], 2_000).join(comp.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    tag = lambda c, added: F.transform(c, lambda e: F.struct(F.lit(added).alias("added"), e.alias("e")))
    each = rows.select("a", "b", "component", "load", "limit", "r", "m", F.explode(F.concat(tag("gone", False), tag("new", True))).alias("x")).select("*", "x.added", "x.e").drop("x")
    often = each.groupBy("b", "added", "e").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    own = W.partitionBy("b", "a", "added")
    each = few(each.join(often, ["b", "added", "e"]))
    # how many of the list come from here on, elements of its own being first; lacking ones can follow added ones
    each = each.withColumn("left", F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy("c", "e")) + 1).withColumn("most", F.col("left") + F.when(F.col("added"), F.col("r")).otherwise(0))
    reach = F.when(F.col("added"), F.lit(100) * F.col("left") + F.lit(percent) * F.col("r")).otherwise(F.lit(percent) * F.col("left"))
    each = each.filter(reach >= F.col("load") - F.col("limit"))
    each = each.withColumn("less", F.col("most") > F.floor(F.col("load") / whole)).withColumn("more", (F.col("load") > F.col("limit")) & (F.col("most") >= F.ceil((F.col("load") - F.col("limit")) / whole)))
    each = shared_table(few(each.filter("less OR more")), "differences")
    x = each.filter("more").select("b", "added", "e", F.col("a").alias("x"), F.col("component").alias("cx"), F.col("load").alias("lx"), F.col("left").alias("fx"), F.col("r").alias("rx"))
    need = F.ceil((F.col("lx") + F.col("load") - F.col("limit")) / whole)
    hit = x.join(each.filter("less"), ["b", "added", "e"]).filter(
        (F.col("component") != F.col("cx")) & ((F.col("lx") > F.col("load")) | ((F.col("lx") == F.col("load")) & (F.col("x") > F.col("a"))))
        & (F.least("left", "fx") + F.when(F.col("added"), F.least("r", "rx")).otherwise(0) >= need))
    return _pairs(F.col("x"), F.col("a"), hit)


def _members(rows: DataFrame, order: Column, size: int) -> DataFrame:
    """``key, id, hub``: the members of each bucket, and its first by ``order``, the hub."""
    hubs = rows.groupBy("key").agg(F.max(order)["id"].alias("hub"))
    return shared_table(few_tasks(rows.select("key", "id").join(hubs, "key").filter("id <> hub"), size), "members")


def _open(rows: DataFrame, near: DataFrame, percent: int, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``key, id`` of members that their hub does not link, in buckets where it is far from one of them."""
    met = near.select(F.col("a").alias("id"), F.col("b").alias("hub"), _linked(percent).alias("linked"), (F.lit(100) * (F.col("n") - F.col("r")) < F.lit(NEAR) * (F.col("n") + F.col("m"))).alias("away"))
    loose = few(rows.join(met, ["id", "hub"], "left").filter("linked IS NULL OR NOT linked"))
    far = loose.groupBy("key").agg(F.max(F.coalesce("away", F.lit(True))).alias("far"), F.count(F.lit(1)).alias("c")).filter("far AND c > 1").select("key")
    return shared_table(few(loose.join(far, "key", "left_semi").select("key", "id")), "open")


def bucket_components(bands: DataFrame, test: Callable[[DataFrame, int], DataFrame], percent: int) -> DataFrame:
    """``node, component`` under the links (similarity of ``percent`` or more) among members of one bucket of
    ``bands (key, id)``.

    ``test(pairs, least)`` returns ``a, b, n, gone, new`` of the pairs (a, b) with at least ``least`` per cent: the
    size of b's set, its elements that a lacks, and the elements that only a has.

    No bucket is expanded into all pairs. Its members are tested against one hub, the member that meets most others.
    Links among members near the hub are then found by their differences from it (``_by_difference``). Where some
    member is far from the hub, those it does not link go on to a second hub, and all their differences from that one are
    kept, near or far: a member linked to the first hub cannot be linked to one that is far. So no link is lost. More hubs
    follow only while they link at least a tenth of what is open, which spares the search pairs of one component.
    """
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    buckets = shared_table(bands.join(shared, "key"), "buckets")
    size = buckets.count()
    few = lambda df: few_tasks(df, size)
    score = buckets.groupBy("id").agg(F.sum("members").alias("score"))
    rows = _members(few(buckets.join(score, "id")), F.struct("score", (-F.col("id")).alias("low"), "id"), size)
    pairs = shared_table(few(_pairs(F.col("id"), F.col("hub"), rows)), "tests")
    near = shared_table(_sized(test(pairs, NEAR)), "near")
    still = _open(rows, near, percent, few)
    for turn in range(HUB_ROUNDS - 1):
        before, size = size, still.count()
        if not size or turn and 10 * size > 9 * before:
            break
        rows = _members(still, F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), "id"), size)
        pairs = shared_table(few(_pairs(F.col("id"), F.col("hub"), rows).join(near.select("a", "b"), ["a", "b"], "left_anti")), "tests")
        near = near.unionByName(shared_table(_sized(test(pairs, 0)), "near"))
        still = _open(rows, near, percent, few)
    found = near.filter(_linked(percent)).select("a", "b")
    comp = shared_table(components(found), "components")
    rest = shared_table(few_tasks(_by_difference(near, comp, percent), near.count()), "tests")
    if not rest.isEmpty():
        more = shared_table(_sized(test(rest, percent)).filter(_linked(percent)).select("a", "b"), "links")
        comp = shared_table(components(found.unionByName(more)), "components")
    return comp
