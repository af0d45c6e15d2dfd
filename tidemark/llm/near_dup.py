"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles becomes ``M`` registers: register i holds the exponentially spaced, truncated minimum
of the set under hash i, ``floor(1 - log_B(min / A))`` cut to 16 bits. Sketches of parts merge by the maximum; equal
registers are the more likely the more similar two sets are. Steps:

1. One pass over the texts: set size, 128-bit set fingerprint and registers. Equal sets fall into one class.
2. Bands of ``ROWS`` registers are the candidate buckets (at a similarity of 0.8 a pair misses all 32 with p = 3e-6).
3. No bucket is expanded into all pairs: each tests its members against a hub or two, and the differences from the hub lead
   to all further links (``components.bucket_components``). No link between members of a bucket is lost.
4. A pair is first compared by the joint likelihood of its registers, given both exact set sizes; where the wanted
   similarity is e^20 times less likely than the estimate below it, the pair goes. Others are verified on the full sets of
   whole texts.
5. Components of all links by star steps.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; equal rows share one
component; unlike texts under one id are classes of their own, each kept or linked by itself; rows without id are linked with nothing and kept; an empty table gives an empty result; other columns
are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import few_tasks, fresh, give_back, shared_table, sized, small_batches
from tidemark.llm.components import bucket_components
from tidemark.llm.textnp import BASE, Words, mix, slices, text_shingles

M, ROWS = 160, 5
B, A, TOP = 1.001, 20.0, 65535


def registers(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (texts x M, 16 bit) of consecutive non-empty runs of shingle hashes."""
    seeds = mix(np.arange(1, 2 * M + 1, dtype=np.uint64) * np.uint64(BASE))
    low = np.empty((len(starts), M), np.uint64)
    for i in range(M):
        low[:, i] = np.minimum.reduceat((shingles ^ seeds[i]) * (seeds[M + i] | np.uint64(1)), starts)
    x = -np.log1p(-(low.astype(np.float64) + 1.0) / 2.0**64 * (1 - 1e-16))
    return np.clip(np.floor(1.0 - np.log(x / A) / np.log(B)), 0, TOP).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    """Probability scale of the registers' order statistics at base B."""
    return -np.log1p(-x * (B - 1) / B) / np.log(B)


def log_likelihood(j: np.ndarray, more: int, less: int, same: int, n_a: int, n_b: int) -> np.ndarray:
    """Of similarity ``j`` given how many registers of a are above, below and equal to those of b."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    up, down = _p(np.maximum(u - v * j, 1e-12)), _p(np.maximum(v - u * j, 1e-12))
    return more * np.log(np.maximum(up, 1e-300)) + less * np.log(np.maximum(down, 1e-300)) + same * np.log(np.maximum(1 - up - down, 1e-300))


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(maximum-likelihood similarity, grid, log-likelihood on the grid); the grid ends at the largest similarity the sizes allow."""
    grid = np.linspace(0.0, min(n_a, n_b) / max(n_a, n_b), 129)
    ll = log_likelihood(grid, int((a > b).sum()), int((a < b).sum()), int((a == b).sum()), n_a, n_b)
    return float(grid[int(np.argmax(ll))]), grid, ll


def plausible(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, threshold: float, nats: float = 20.0) -> bool:
    """False where the threshold is ruled out by the sizes, or by ``nats`` of likelihood."""
    if min(n_a, n_b) < threshold * max(n_a, n_b) - 1e-9:
        return False
    best, grid, ll = estimate(a, b, n_a, n_b)
    return best >= threshold or float(ll[grid >= threshold - 1e-9].max(initial=-np.inf)) >= float(ll.max()) - nats


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set, as signed integers."""
    sums = mix(shingles).sum(dtype=np.uint64), mix(shingles ^ np.uint64(BASE)).sum(dtype=np.uint64)
    return tuple(int(x.astype(np.int64)) for x in sums)


def sketches(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``doc_id, tie, n, h1, h2, regs`` of every row: the hash of its text, size and fingerprint of its set, and the
    registers, null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids = batch.column(0)
            for at, data, offs in slices(batch.column(1).cast(pa.binary())):
                sh, first = words.shingles(data, offs, k)
                full = np.flatnonzero(np.diff(first))
                n, h = np.zeros(len(offs) - 1, np.int64), np.zeros((2, len(offs) - 1), np.uint64)
                regs: list[bytes | None] = [None] * (len(offs) - 1)
                if len(full):
                    made = registers(sh, first[:-1][full])
                    for r, d in enumerate(full):
                        own = np.unique(sh[first[d]:first[d + 1]])
                        n[d], regs[d] = len(own), made[r].tobytes()
                        h[:, d] = np.array(fingerprint(own), np.int64).view(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(offs) - 1), batch.column(2).slice(at, len(offs) - 1), pa.array(n), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.array(regs, pa.binary())],
                    ["doc_id", "tie", "n", "h1", "h2", "regs"])
        give_back()

    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), tie.alias("tie")).mapInArrow(
        run, "doc_id long, tie long, n long, h1 long, h2 long, regs binary")


def _tested(pairs: DataFrame, sets: DataFrame, texts: DataFrame, k: int, least: int) -> DataFrame:
    """``a, b, n, gone, new`` of the ``pairs (a, b)`` with ``least`` per cent or more: likelihood first, then the full
    sets. Several pairs of one b follow each other, so its set is made once."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(name) for name in batch.schema.names}
            ra, rb = (np.frombuffer(b"".join(c[x].to_pylist()), "<u2").reshape(-1, M) for x in ("r_a", "r_b"))
            na, nb = c["n_a"].to_pylist(), c["n_b"].to_pylist()
            mask = pa.array([plausible(ra[i], rb[i], na[i], nb[i], least / 100) for i in range(len(na))], pa.bool_())
            yield pa.RecordBatch.from_arrays([c["a"], c["b"]], ["a", "b"]).filter(mask)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, b_set = Words(), None, None
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("t_a"), batch.column("t_b")):
                if b != held:
                    held, b_set = b, text_shingles(words, tb.as_py(), k)
                a_set = text_shingles(words, ta.as_py(), k)
                gone = np.setdiff1d(b_set, a_set, assume_unique=True)
                both = len(b_set) - len(gone)
                if 100 * both >= least * (len(a_set) + len(gone)):
                    out.append((a, b, len(b_set), gone.view(np.int64), np.setdiff1d(a_set, b_set, assume_unique=True).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64() if j < 3 else pa.list_(pa.int64())) for j in range(5)], ["a", "b", "n", "gone", "new"])
        give_back()

    n = pairs.count()
    close = few_tasks(few_tasks(pairs.join(side("a"), "a"), n, 10_000).join(side("b"), "b"), n, 10_000).mapInArrow(likely, "a long, b long")
    close = shared_table(close, "near-pairs")
    n = close.count()
    needed = few_tasks(close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id"))).distinct(), 2 * n)
    needed = shared_table(few_tasks(needed.join(sets.select("id", "doc", "tie"), "id"), 2 * n), "needed-texts")
    own = texts.join(sized(needed), ["doc", "tie"]).select("id", "text").dropDuplicates(["id"])  # hashed by id, as the next join needs it
    rows = few_tasks(close.join(own.select(F.col("id").alias("a"), F.col("text").alias("t_a")), "a"), n, 2_000)
    rows = few_tasks(rows.join(own.select(F.col("id").alias("b"), F.col("text").alias("t_b")), "b"), n, 2_000)
    return rows.select("a", "b", "t_a", "t_b").mapInArrow(exact, "a long, b long, n long, gone array<long>, new array<long>")


def links(sets: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``node, component`` of the sets (``id, n, regs`` and ``doc, tie`` of one row) that have a link; ``texts (doc, tie,
    text)``."""
    bands = sets.select("id", F.explode(F.sequence(F.lit(0), F.lit(M // ROWS - 1))).alias("band"), "regs").select(
        F.xxhash64("band", F.substring("regs", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("key"), "id")
    return bucket_components(bands, lambda pairs, least: _tested(pairs, sets, texts, k, least), percent)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    marked = _marked(df, id_col, text_col, k, percent)
    return marked.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def _marked(df: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """``doc_id, tie, h1, h2, n, component_id, kept`` of every row. Nodes are classes of equal sets, not document ids, so
    unlike texts under one id are linked apart."""
    spark = df.sparkSession
    with small_batches(spark):
        made = shared_table(sketches(df, id_col, text_col, k), "near-sketches")
    classes = made.filter("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "tie")).alias("one"), F.first("regs").alias("regs"))
    classes = classes.select("h1", "h2", "n", "regs", F.col("one.doc_id").alias("doc"), "one.tie")
    classes = shared_table(classes.withColumn("id", F.monotonically_increasing_id()), "near-classes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("text"))
    with small_batches(spark):
        comp = links(classes.select("id", "doc", "tie", "n", "regs"), texts, k, percent).withColumnRenamed("node", "id")
    joined = classes.select("id", "doc", "h1", "h2", "n").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    stays = comp.join(classes.select("id", "doc"), "id").groupBy("component").agg(F.min(F.struct("doc", "id")).alias("least"))
    label = joined.join(stays, "component", "left").select(
        "h1", "h2", "n", F.coalesce("least.doc", "doc").alias("root"), F.coalesce(F.col("least.id") == F.col("id"), F.lit(True)).alias("own"))
    out = made.drop("regs").join(label, ["h1", "h2", "n"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")))
    kept = F.coalesce((F.col("doc_id") == F.col("component_id")) & F.coalesce("own", F.lit(True)), F.lit(True))
    return out.select("doc_id", "tie", "h1", "h2", "n", "component_id", kept.alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``df`` without the documents whose component has a smaller id, with all its columns; of rows that share an id and
    a set one stays. Unlike texts under one id are judged apart, each by its own text."""
    row, own, tie = fresh("row"), fresh("id"), fresh("tie")
    marks = shared_table(_marked(df, id_col, text_col, k, percent), "near-marks")
    group = ["doc_id", "h1", "h2", "n"]
    again = marks.filter("kept AND doc_id IS NOT NULL").groupBy(*group).agg(F.min("tie").alias("one"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    again = shared_table(again, "near-again")
    several = not again.isEmpty()
    dropped = marks.filter("NOT kept").select("doc_id", "tie")
    if several:
        dropped = dropped.unionByName(marks.filter("kept").join(again, group).filter("tie <> one").select("doc_id", "tie"))
    dropped = dropped.distinct().toDF(own, tie)
    boxed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row))
    boxed = boxed.withColumn(own, F.col(row)[id_col].cast("long")).withColumn(tie, F.xxhash64(F.coalesce(F.col(row)[text_col], F.lit(""))))
    left = boxed.join(sized(dropped), [own, tie], "left_anti")
    if several:  # equal rows: one of them stays
        equal = again.select("doc_id", "one").distinct().toDF(own, tie)
        one = left.join(equal, [own, tie], "left_semi").groupBy(own, tie).agg(F.first(row).alias(row))
        left = left.join(equal, [own, tie], "left_anti").unionByName(one.select(*left.columns))
    return left.select(f"{row}.*")
