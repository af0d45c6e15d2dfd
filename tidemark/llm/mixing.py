"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies each of its documents should get. The whole part is
given to all; the fractional parts are rounded so that their sum in words stays: two documents meet, words of
probability mass move at random from one to the other until one of them is settled (taken or not), the other meets the
next. Each document keeps its expected number of copies, and a source misses its target by less than one document.

Documents meet inside bounded groups (``group``), each leaving at most one open document; the open ones meet in a
reduction tree of the same step until one per source is left, which is decided by its own mass. A hot source is only
more groups. Random numbers are hashes of seed, level and id, so reruns agree.

Defined results: null texts count as size 0; the null source is a source of its own, last; rows with the same source
and id (also null) are one document whose size is their sum and which is taken or left together; an empty table or
sources without words give targets of 0; other columns are ignored by ``mix`` and kept by ``apply_mix``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, shared_table, words

UNIT = "source string, doc_id long, size long, whole long, mass double, open boolean, extra long, node long, u long"


def targets(units: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, n_docs, source_size, weight, target``: ``share`` of all words split by weight, no source above
    ``most`` times its size, the excess reshared by weight. One row per source, so its windows are small."""
    per = units.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights) + 1))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("fill", F.col("cap") / F.col("weight"))
    order = [F.col("fill"), F.col("source").asc_nulls_last()]
    before, every = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1), W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    past = lambda c: F.sum(c).over(every) - F.coalesce(F.sum(c).over(before), F.lit(0.0))  # noqa: E731  of this source and fuller ones
    spare = F.sum(F.col("source_size")).over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    per = per.withColumn("level", spare / past("weight"))  # words per weight if all emptier sources stop at their cap
    per = per.withColumn("common", F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", F.col("source").isNull().alias("last"), "source", "level"))).over(every)["level"])
    return per.select("source", "n_docs", "source_size", "weight", F.when(F.col("fill") <= F.col("level"), F.col("cap")).otherwise(
        F.col("weight") * F.col("common")).alias("target"))


def _settle(last: bool, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Pivotal rounding of one group; with ``last`` the document left open is decided too."""

    def draw(u: int) -> float:
        x = (int(u) ^ (level * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & 0xFFFFFFFFFFFFFFFF
        return ((x ^ (x >> 31)) >> 11) / 2**53

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", na_position="first", kind="stable").reset_index(drop=True)
        size, mass, chance = pdf["size"].tolist(), pdf["mass"].tolist(), [draw(u) for u in pdf["u"]]
        extra, still, a = [0] * len(pdf), [False] * len(pdf), -1
        for b in range(len(pdf)):
            if mass[b] <= 0.0 or mass[b] >= size[b]:  # settled already
                extra[b] = int(mass[b] > 0.0)
                continue
            if a < 0:
                a = b
                continue
            up, down = min(size[a] - mass[a], mass[b]), min(mass[a], size[b] - mass[b])
            if chance[b] * (up + down) < down:  # a gains: full, or b empty
                a_ends = size[a] - mass[a] <= mass[b]
                left = mass[b] - up if a_ends else mass[a] + up
                extra[a if a_ends else b] = int(a_ends)
            else:  # a loses: empty, or b full
                a_ends = mass[a] <= size[b] - mass[b]
                left = mass[b] + down if a_ends else mass[a] - down
                extra[a if a_ends else b] = int(not a_ends)
            a = b if a_ends else a
            mass[a] = left
            if left <= 0.0 or left >= size[a]:
                extra[a], a = int(left > 0.0), -1
        if a >= 0:
            if last:
                extra[a] = int(chance[a] * size[a] < mass[a])
            else:
                still[a] = True
        return pdf.assign(mass=mass, extra=extra, open=still)

    return run


def mix(units: DataFrame, plan: DataFrame, seed: int = 7, group: int = 4096) -> DataFrame:
    """``source, doc_id, size, source_size, target, copies`` for units ``source, doc_id, size``."""
    copies = F.try_divide(F.col("target"), F.col("source_size"))  # null for a source without words
    rows = units.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", F.coalesce(copies, F.lit(0.0)))
    rows = rows.withColumn("whole", F.floor("rate").cast("long")).withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "source"))
    rows = rows.withColumn("mass", (F.col("rate") - F.col("whole")) * F.col("size")).withColumn("open", F.lit(True)).withColumn("extra", F.lit(0).cast("long"))
    rows = rows.withColumn("node", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.ceil(F.col("n_docs") / group)).cast("long"))
    nodes = int((plan.agg(F.max("n_docs")).head()[0] or 0) + group - 1) // group  # of the largest source
    done, level = None, 0
    open_rows = rows.select(*[c.split()[0] for c in UNIT.split(", ")])
    while True:
        settled = shared_table(open_rows.groupBy("source", "node").applyInPandas(_settle(nodes <= 1, level), UNIT), f"mix-{level}")
        closed = settled.filter(~F.col("open"))
        done = closed if done is None else done.unionByName(closed)
        if nodes <= 1:
            break
        nodes, level = (nodes + group - 1) // group, level + 1
        open_rows = settled.filter("open").withColumn("node", F.floor(F.col("node") / group).cast("long"))
    done = done.withColumn("copies", F.col("whole") + F.col("extra")).select("source", "doc_id", "size", "copies")
    sizes = plan.select(F.col("source").alias("of"), "source_size", "target")
    return done.join(sizes, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def units_of(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One unit per source and id with its words; only ids and counts are shuffled."""
    sized = df.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    return sized.groupBy("source", "doc_id").agg(F.sum("size").alias("size"))


def mixed(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, **cols) -> DataFrame:
    units = shared_table(units_of(df, **cols), "mix-units")
    return mix(units, shared_table(targets(units, weights, share, most), "mix-plan"), seed)


def apply_mix(df: DataFrame, mixed_units: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``df``'s rows repeated as often as the mix takes them, with all their columns."""
    row, a, b, n = fresh("row"), fresh("id"), fresh("source"), fresh("copies")
    boxed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row))
    take = mixed_units.filter("copies > 0").select(F.col("doc_id").alias(a), F.col("source").alias(b), F.col("copies").alias(n))
    hit = boxed.join(take, F.col(row)[id_col].cast("long").eqNullSafe(F.col(a)) & F.col(row)[source_col].cast("string").eqNullSafe(F.col(b)))
    return hit.select(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))).alias(n)).select(f"{row}.*")
