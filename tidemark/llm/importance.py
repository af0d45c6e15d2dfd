"""Draw documents that look like a target text: importance weights on hashed word runs, sampled with Gumbel noise.

Features of a text are all runs of 1 to ``runs`` consecutive words, joined by one space; a feature's bucket is its CRC-32
modulo ``buckets``. Steps:

1. Each text is read once. Its words, each with one space behind it, form a normalised byte string over which the CRC
   runs; only the registers at the borders of words are kept. The CRC of any run of words follows from the two at its
   ends (``crc.part``), so no run is cut out or hashed again, whatever its length. Bytes are read in pieces, so
   memory grows with the words of a few texts and not with their bytes.
2. Buckets are counted per task and added up, for the documents and for the target.
3. A bucket's gain is ``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))``; a document's weight is the
   floored mean of its features' gains. The gains, one number a bucket, travel with the job.
4. The score is the weight plus Gumbel noise from ``sha256(seed:doc_id)``. The highest scores are a draw without
   replacement by weight. Only the number of documents per score (scores are whole numbers in a narrow range) is added
   up in one place; it gives the lowest score drawn, and every drawn document its rank within the documents of its score.

Defined results: null, empty and wordless texts have no features, weight 0, and too few words to be drawn; rows without
id have no noise, score or rank; rows that repeat are documents of their own, with equal scores and different ranks; an
empty table gives an empty result; an empty target makes gains depend on the documents alone; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import crc
from tidemark.llm.common import fresh, shared_table
from tidemark.llm.textnp import slices

BUCKETS = 10_000
#: Bytes read at once.
PIECE = 1 << 20


def _letters() -> np.ndarray:
    """Bytes of words as themselves, A-Z as a-z, all others 0. All bytes of non-ASCII characters belong to words."""
    table = np.zeros(256, np.uint8)
    for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[first:last + 1] = np.arange(first, last + 1)
    table[0x41:0x5B] = table[0x61:0x7B]
    return table


LETTERS = _letters()


def borders(data: np.ndarray, offs: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(register before, register after, begin, end, text) of all words of consecutive texts; begin and end count bytes
    of the normalised string, in which texts follow each other."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    at = carry = 0
    inside_before = False
    first = np.unique(offs[:-1])
    starts = []
    for lo in range(0, len(data), piece):
        raw = LETTERS[data[lo:lo + piece]]
        inside = raw != 0
        cut = first[np.searchsorted(first, lo):np.searchsorted(first, lo + len(raw))] - lo  # a text begins here
        before = np.empty(len(raw), bool)
        before[0], before[1:] = inside_before, inside[:-1]
        ends = before & ~inside
        ends[cut] = before[cut]
        begins = inside & ~before
        begins[cut] = inside[cut]
        gap = before & ~inside
        gap[cut] = False  # a word at the end of its text has no space behind it
        kept = inside | gap
        place = np.cumsum(kept) - kept  # normalised position of each byte
        raw[~inside] = 32
        registers = crc.running(raw[kept], carry)
        for k, where in enumerate((begins, ends)):
            p = place[where]
            found[k].append(registers[p])
            found[2 + k].append(p + at)
        starts.append(np.flatnonzero(begins) + lo)
        at, carry, inside_before = at + int(kept.sum()), int(registers[-1]), bool(inside[-1])
    if inside_before:
        found[1].append(np.array([carry], np.uint32))
        found[3].append(np.array([at], np.int64))
    r0, r1, b, e = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    text = np.searchsorted(offs, np.concatenate(starts), "right") - 1 if starts else np.zeros(0, np.int64)
    return r0.astype(np.uint32), r1.astype(np.uint32), b, e, text


def run_checksums(data: np.ndarray, offs: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32 of every run of 1 to ``runs`` words, its text, words of each text); runs of one length follow each other."""
    r0, r1, b, e, text = borders(data, offs)
    sums, of = [], []
    for n in range(1, min(runs, len(text)) + 1):
        last = slice(n - 1, None)
        own = np.flatnonzero(text[:len(text) - n + 1] == text[last])
        sums.append(crc.part(r0[own], r1[last][own], (e[last] - b[:len(b) - n + 1])[own]))
        of.append(text[own])
    words = np.bincount(text, minlength=len(offs) - 1) if len(text) else np.zeros(len(offs) - 1, np.int64)
    empty = np.zeros(0, np.int64)
    return np.concatenate(sums) if sums else empty.astype(np.uint32), np.concatenate(of) if of else empty, words


def _features(df: DataFrame, id_col: str, text_col: str, runs: int, buckets: int) -> DataFrame:
    """``doc_id, n_words, n_features, found``: the buckets of all features of every row as unsigned integers."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offs in slices(batch.column(1)):
                sums, of, words = run_checksums(data, offs, runs)
                bucket = (sums % np.uint32(buckets)).astype(kind)
                if runs > 1:
                    bucket = bucket[np.argsort(of, kind="stable")]
                count = np.bincount(of, minlength=len(words))
                ends = np.concatenate([[0], np.cumsum(count)])
                found = pa.array([bucket[ends[i]:ends[i + 1]].tobytes() for i in range(len(words))], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(words)), pa.array(words, pa.int64()), pa.array(count, pa.int64()), found],
                                                 ["doc_id", "n_words", "n_features", "found"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_features long, found binary")


def _values(column: pa.Array, buckets: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2" if buckets <= 1 << 16 else "<u4")


def counted(features: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n`` over all features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_values(batch.column(0), buckets), minlength=buckets)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["bucket", "n"])

    return features.select("found").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` of every bucket, from the counts of both sides."""
    spark = documents.sparkSession
    both = documents.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    both = shared_table(spark.range(buckets).withColumnRenamed("id", "bucket").join(both, "bucket", "left").fillna(0), "importance-counts")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).head()
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _weights(features: DataFrame, table: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column(2), np.int64)
            total = np.concatenate([[0], np.cumsum(table[_values(batch.column(3), len(table))])])
            ends = np.concatenate([[0], np.cumsum(n)])
            weight = (total[ends[1:]] - total[ends[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, id_col: str) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weighed(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", runs: int = 1,
            buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    features = shared_table(_features(df, id_col, text_col, runs, buckets), "importance-features")
    wanted = _features(target.select(F.lit(0).alias("row"), F.col(target_col).alias("text")), "row", "text", runs, buckets)
    table = np.zeros(buckets, np.int64)
    for row in gains(counted(features, buckets), counted(wanted, buckets), buckets).toLocalIterator():
        table[row.bucket] = row.gain
    return _weights(features, table)


def resampled(df: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, **options) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; ``rank`` is null where a document is not drawn."""
    made = weighed(df, target, **options).withColumn("score", F.col("weight") + noise(seed, "doc_id"))
    made = shared_table(made.withColumn("may", (F.col("n_words") >= least_words) & F.col("score").isNotNull()), "importance-scores")
    per_score = made.filter("may").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)  # scores are whole numbers in a narrow range
    per_score = per_score.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0).cast("long")))
    most = made.filter("may").count() * percent // 100
    open_scores = shared_table(per_score.filter(F.col("above") < most).select("score", "above"), "importance-cut")
    lowest = open_scores.agg(F.min("score")).head()[0]
    empty = F.lit(None).cast("long")
    if lowest is None:
        return made.select("doc_id", "n_features", "weight", "score", empty.alias("rank"))
    hopeful = F.col("may") & (F.col("score") >= lowest)
    drawn = made.filter(hopeful).join(open_scores, "score")
    place = F.col("above") + F.row_number().over(W.partitionBy("score").orderBy("doc_id"))
    drawn = drawn.withColumn("place", place).select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= most, F.col("place")).cast("long").alias("rank"))
    return drawn.unionByName(made.filter(~hopeful).select("doc_id", "n_features", "weight", "score", empty.alias("rank")))


def take(df: DataFrame, drawn: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that were drawn, with all their columns."""
    mark = fresh("drawn")
    ids = drawn.filter("rank IS NOT NULL").select(F.col("doc_id").alias(mark)).distinct()
    return df.join(ids, F.col(id_col).cast("long") == F.col(mark), "left_semi")
