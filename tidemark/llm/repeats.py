"""Repeated byte strings: every byte covered by an ``L``-byte string that also starts earlier goes.

Merging the suffixes of a whole corpus is cut down, without losing a match, to the places where copies begin, end or
differ:

1. *Anchors.* Each start s of an L-byte string picks the smallest hash of the K-byte strings in it (leftmost), so equal
   strings pick the same anchor at the same place. Consecutive starts with one anchor form a range; its bytes have a hash.
2. *Classes.* Anchors that occur once cannot belong to a repeat. Ranges with equal anchor and equal bytes are one class:
   all but the earliest are repeated throughout. Only anchors with several classes are left, one range of each class.
3. *Suffixes.* The bytes of those ranges, grouped by anchor, are the shards' texts. Each shard's suffixes are sorted once
   into a Burrows-Wheeler transform; the transforms are merged by refining an interleave vector, one symbol a round: a
   stable sort of the vector by the symbols it brings together gives the order by one symbol more, and a border between
   neighbours first seen in round h says that their common prefix has h - 1 symbols. Before, each text is cut to the
   starts whose strings have a hash that comes twice, and texts that are equal then are merged as one, again and again
   until nothing falls away (``_open_parts``): equal strings have equal hashes, so none is lost. After L rounds what is still
   between two borders is a repeated interval; its earliest start stays, the others are repeats. No suffix is compared
   or sorted again in the merge.

Anchors with more than ``hot`` occurrences are aggregated before the shuffle and their ranges merged in salted groups,
whose survivors meet by exact string; the setting changes plans, not results.

Matches never cross documents; earlier means smaller id, or the same document and an earlier start.

Defined results: null and empty texts have no bytes; texts shorter than L keep all; rows without id come first, ordered
by a hash of their text; rows with one id and one text are the same document and get equal results, rows with one id
and different texts are ordered by a hash of the text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import shared_table
from tidemark.llm.textnp import BASE, FOLD, Words, mix, slices

L, K = 100, 32
RANGE_SCHEMA = "id long, tie long, lo long, hi long"


def anchors(words: Words, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor, first start, last start, anchor hash, hash of the range's bytes); positions within their text."""
    n, w = len(data), L - K + 1
    if n < L:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    words._powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words.table[data] * words.up[:n], out=total[1:])
    h = mix((total[K:] - total[:-K]) * words.down[:n - K + 1])
    low, size = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= w:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    if w > size:
        low = np.minimum(low[:-(w - size)], low[w - size:])
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:len(low)]
    s = np.flatnonzero(np.arange(len(low)) + L <= offs[1:][text])
    a = (low[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)
    i = np.flatnonzero(new)
    lo, hi, a = s[i], s[np.append(i[1:], len(s)) - 1], a[i]
    whole = mix((total[hi + L] - total[lo]) * words.down[lo]) ^ mix(((a - lo) * 1024 + (hi - lo)).astype(np.uint64) * np.uint64(FOLD) + np.uint64(BASE))
    d = text[lo]
    return d, a - offs[d], lo - offs[d], hi - offs[d], h[a], whole


def first_of_text(d: np.ndarray, fp: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """True where a text has its first range of a class."""
    order = np.lexsort((np.arange(len(d)), whole, fp, d))
    same = np.zeros(len(d), bool)
    same[1:] = (d[order][1:] == d[order][:-1]) & (fp[order][1:] == fp[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    out = np.empty(len(d), bool)
    out[order] = ~same
    return out


# --- merging shard transforms -----------------------------------------------------------------------------------------

def shard_transform(symbols: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, transform) of texts that end in symbol 0 and begin at ``begin``; equal suffixes in text order."""
    n = len(symbols)
    length = np.diff(np.append(begin, n))
    end = np.repeat(begin + length, length)  # behind the text of each suffix
    padded = np.append(symbols, np.zeros(8, np.uint8)).astype(np.uint64)
    key, here = np.zeros(n, np.uint64), np.arange(n)
    for j in range(8):
        key = (key << np.uint64(8)) | np.where(here + j < end, padded[j:n + j], np.uint64(0))
    step = 8
    while True:  # ranks by 8, 16, 32 ... symbols
        sa = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[sa][1:] != key[sa][:-1]
        rank = np.empty(n, np.int64)
        rank[sa] = np.cumsum(new)
        if step >= length.max() or rank.max() == n:
            break
        after = np.where(here + step < end, rank[np.minimum(here + step, n - 1)], 0)
        key, step = (rank * (n + 1) + after).astype(np.uint64), step * 2
    before = np.where(np.isin(sa, begin), 0, symbols[sa - 1])
    return sa, before.astype(np.uint8)


def merge_transforms(transforms: list[np.ndarray], texts: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the concatenated shards at each merged place, interval number, common prefix with the place before).

    Common prefixes are counted up to ``rounds``; places of one interval agree on ``rounds`` symbols.
    """
    sizes = list(map(len, transforms))
    n, first = sum(sizes), np.concatenate([[0], np.cumsum(sizes)])
    symbols = np.concatenate(transforms)
    z = np.repeat(np.arange(len(transforms), dtype=np.uint16), sizes)
    src, block = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    common, border = np.full(n, rounds, np.int32), np.empty(n, bool)
    for h in range(1, rounds + 1):
        b = symbols[src]
        order = np.argsort(b, kind="stable")
        b, z, block = b[order], z[order], block[order]
        border[0] = True
        border[1:] = (b[1:] != b[:-1]) | (block[1:] != block[:-1])
        border[1:texts] = False  # the ends of texts are alike and stay in shard order
        z[:texts] = np.sort(z[:texts], kind="stable")
        common[border & (common == rounds)] = h - 1
        block = np.cumsum(border, dtype=np.int32)
        for j in range(len(sizes)):  # a shard's own order never changes
            src[np.flatnonzero(z == j)] = np.arange(first[j], first[j + 1], dtype=np.int32)
    return src, block, common


def _open_parts(words: Words, raw: np.ndarray, begin: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(contexts to merge, their first and last start, which contexts are a part of an earlier one from which to which start).

    Contexts at ``begin`` in ``raw`` are in order of rank. Parts that hold all starts with a string that may come twice;
    of equal parts the first stands for all, the others (index, first, last start) are repeated throughout.
    """
    words._powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(words.table[raw] * words.up[:len(raw)], out=total[1:])
    own, lo, hi, again = np.arange(len(begin)), np.zeros(len(begin), np.int64), last.astype(np.int64), []
    while len(own):
        count = hi - lo + 1
        which = np.repeat(np.arange(len(own)), count)
        start = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]
        at = begin[own][which] + start
        _, code, times = np.unique(mix((total[at + L] - total[at]) * words.down[at]), return_inverse=True, return_counts=True)
        twice = times[code] > 1
        which, start = which[twice], start[twice]
        keep, first = np.unique(which, return_index=True)
        cut_lo, cut_hi = start[first], start[np.append(first[1:], len(which))[:len(keep)] - 1]
        stays, seen = np.ones(len(keep), bool), set()
        for j, (i, x, y) in enumerate(zip((begin[own[keep]]).tolist(), cut_lo.tolist(), cut_hi.tolist())):
            part = raw[i + x:i + y + L].tobytes()
            stays[j] = part not in seen
            seen.add(part)
        again.append(np.stack([own[keep], cut_lo, cut_hi])[:, ~stays])
        done = len(keep) == len(own) and stays.all()
        own, lo, hi = own[keep][stays], cut_lo[stays], cut_hi[stays]
        if done:
            break
    return own, lo, hi, np.concatenate([np.zeros((3, 0), np.int64), *again], axis=1)


def repeated_starts(contexts: list[bytes], last: np.ndarray, rank: np.ndarray, shard_symbols: int = 1 << 15) -> list[np.ndarray]:
    """Of each context the offsets 0..last whose L bytes also start in a context of lower ``rank`` (or earlier in it)."""
    by = np.argsort(rank, kind="stable")
    ordered, words = [contexts[i] for i in by], Words(lower=False)
    sizes = np.array([len(c) for c in ordered])
    own, lo, hi, again = _open_parts(words, np.frombuffer(b"".join(ordered), np.uint8), np.cumsum(sizes) - sizes, np.asarray(last)[by])
    found: list[list[np.ndarray]] = [[] for _ in contexts]
    for i, x, y in again.T.tolist():
        found[by[i]].append(np.arange(x, y + 1))
    if len(own):
        parts = [ordered[i][x:y + L] for i, x, y in zip(own.tolist(), lo.tolist(), hi.tolist())]
        for i, x, o in zip(own.tolist(), lo.tolist(), _merged_starts(parts, hi - lo, np.arange(len(parts)), shard_symbols)):
            found[by[i]].append(o + x)
    none = np.zeros(0, np.int64)
    return [none if not f else f[0] if len(f) == 1 else np.sort(np.concatenate(f)) for f in found]


def _merged_starts(contexts: list[bytes], last: np.ndarray, rank: np.ndarray, shard_symbols: int = 1 << 15) -> list[np.ndarray]:
    """``repeated_starts`` by merging the transforms of shards."""
    raw = np.frombuffer(b"".join(c + b"\xff" for c in contexts), np.uint8)
    sizes = np.array([len(c) + 1 for c in contexts])
    ends = np.cumsum(sizes)
    symbols = (raw + np.uint8(1))  # 0xff never occurs in UTF-8: it becomes the end symbol 0
    symbols[np.setdiff1d(np.flatnonzero(symbols == 0), ends - 1)] = 255
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], shard_symbols), "left"), len(contexts)))
    sas, bwts = [], []
    for x, y in zip(cuts[:-1], cuts[1:]):
        from_, to = ends[x] - sizes[x], ends[y - 1]
        sa, bwt = shard_transform(symbols[from_:to], (ends[x:y] - sizes[x:y]) - from_)
        sas.append(sa + from_)
        bwts.append(bwt)
    src, block, _ = merge_transforms(bwts, len(contexts), L)
    place = np.concatenate(sas)[src]
    owner = np.searchsorted(ends, place, "right")
    offset = place - (ends - sizes)[owner]
    on = offset <= last[owner]
    owner, offset, block = owner[on], offset[on], block[on]
    order = np.lexsort((offset, rank[owner], block))
    again = np.zeros(len(order), bool)
    again[1:] = block[order][1:] == block[order][:-1]
    owner, offset = owner[order][again], offset[order][again]
    by = np.lexsort((offset, owner))
    return np.split(offset[by], np.searchsorted(owner[by], np.arange(1, len(contexts))))


# --- plan -------------------------------------------------------------------------------------------------------------

def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, id, tie, text``: the order key stands in for missing ids and splits ids that repeat."""
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    h = F.xxhash64("text")
    own = own.withColumn("id", F.coalesce("doc_id", F.shiftrightunsigned(h, 2) + F.lit(-(1 << 63))))
    repeated = not own.groupBy("doc_id").count().filter("doc_id IS NOT NULL AND count > 1").isEmpty()
    return own.withColumn("tie", h if repeated else F.lit(0).cast("long")).select("doc_id", "id", "tie", "text")


def _packed(texts: DataFrame) -> DataFrame:
    """The texts compressed for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            z = pa.array([pack(t.as_buffer()) for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], z], ["doc_id", "id", "tie", "z"])

    return texts.mapInArrow(run, "doc_id long, id long, tie long, z binary")


def _ranges(texts: DataFrame) -> DataFrame:
    """``fp, whole, id, tie, p`` of each text's first range of every class; p holds the anchor and the range around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=False)
        for batch in batches:
            ids, ties = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for at, data, offs in slices(batch.column(3)):
                d, a, lo, hi, fp, whole = anchors(words, data, offs)
                on = first_of_text(d, fp, whole)
                d, p = d[on] + at, (a[on] << 16) | ((a[on] - lo[on]) << 8) | (hi[on] - a[on] + 128)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[on].view(np.int64), whole[on].view(np.int64), ids[d], ties[d], p)], ["fp", "whole", "id", "tie", "p"])

    return texts.mapInArrow(run, "fp long, whole long, id long, tie long, p long")


def _bounds(p):
    """First and last start of a packed range (columns or numbers)."""
    a = p // 65536 if not hasattr(p, "_jc") else F.shiftright(p, 16)
    return a - (p.bitwiseAND(F.lit(65535)) / 256).cast("long"), a + p.bitwiseAND(F.lit(255)) - 128


def _classes(texts: DataFrame, hot: int) -> DataFrame:
    """Rows ``kind, fp, n, id, tie, p``: 0 a repeated range, 1 a range that is none although listed, 2 a class's earliest
    range at an anchor with several classes."""
    ranges = _ranges(texts)
    often = ranges.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = ranges.join(often, "fp")
    pick = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "fp", "n", "id", "tie", "p")
    own = W.partitionBy("fp", "whole").orderBy("id", "tie", "p")
    every = W.partitionBy("fp")
    cold = found.filter(F.col("n") <= hot).withColumn("low", F.min("whole").over(every)).withColumn("high", F.max("whole").over(every))
    cold = cold.withColumn("rank", F.rank().over(own)).select(
        F.when(F.col("rank") > 1, 0).when(F.col("low") < F.col("high"), 2).alias("kind"), "fp", "n", "id", "tie", "p").filter("kind IS NOT NULL")
    many = found.filter(F.col("n") > hot)
    first = many.groupBy("fp", "whole").agg(F.min(F.struct("id", "tie", "p")).alias("x"), F.first("n").alias("n")).select("fp", "n", "x.*")
    return cold.unionByName(pick(many, 0)).unionByName(first.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("kind"), "fp", "n", "id", "tie", "p"))


def _contexts(reps: DataFrame, packed: DataFrame) -> DataFrame:
    """``fp, n, id, tie, lo, last, context``: the bytes of each range, from its first start to the end of its last string."""
    lo, hi = _bounds(F.col("p"))
    wanted = reps.select("fp", "n", "id", "tie", lo.alias("lo"), hi.alias("hi")).groupBy("id", "tie").agg(F.collect_list(F.struct("fp", "n", "lo", "hi")).alias("want"))
    once = packed.select("id", "tie", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i, t, z, want in zip(*(batch.column(j) for j in range(4))):
                text, rows = unpack(z.as_buffer()), {(w["fp"], w["lo"]): w for w in want.as_py()}.values()
                yield pa.RecordBatch.from_arrays([
                    pa.array([w["fp"] for w in rows], pa.int64()), pa.array([w["n"] for w in rows], pa.int64()), pa.array([i.as_py()] * len(rows), pa.int64()),
                    pa.array([t.as_py()] * len(rows), pa.int64()), pa.array([w["lo"] for w in rows], pa.int64()), pa.array([w["hi"] - w["lo"] for w in rows], pa.int64()),
                    pa.array([text[w["lo"]:w["hi"] + L] for w in rows], pa.binary())], ["fp", "n", "id", "tie", "lo", "last", "context"])

    return once.join(wanted, ["id", "tie"]).select("id", "tie", "z", "want").mapInArrow(run, "fp long, n long, id long, tie long, lo long, last long, context binary")


def _merged(contexts: DataFrame, hot: int, run_symbols: int = 1 << 17) -> DataFrame:
    """``id, tie, lo, hi`` of the starts repeated among the contexts of one anchor, and (salted groups only) the starts
    that are not, with their strings: ``fp, at, string``."""
    salted = contexts.withColumn("salts", F.ceil(F.col("n") / hot).cast("long")).withColumn(
        "salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("id", "lo"), F.col("salts"))).otherwise(F.lit(0).cast("long")))
    placed = salted.repartition("fp", "salt").sortWithinPartitions("fp", "salt").select("fp", "salt", "salts", "id", "tie", "lo", "last", "context")
    names = ["id", "tie", "lo", "hi", "fp", "at", "string"]
    types = [pa.int64()] * 6 + [pa.binary()]

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({(r[3], r[4], r[5]): r for r in rows}.values())  # repeated rows of one document count once
        rows.sort(key=lambda r: r[3:6])
        out = []
        again = repeated_starts([r[7] for r in rows], np.array([r[6] for r in rows]), np.arange(len(rows)))
        for r, o in zip(rows, again):
            if not len(o) and r[2] == 1:
                continue
            cut = np.flatnonzero(np.diff(o) != 1) + 1
            out += [(r[3], r[4], r[5] + int(x[0]), r[5] + int(x[-1]), None, None, None) for x in np.split(o, cut) if len(x)]
            if r[2] > 1:
                out += [(r[3], r[4], r[5] + j, r[5] + j, r[0], j, r[7][j:j + L]) for j in sorted(set(range(r[6] + 1)) - set(o.tolist()))]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != group and size >= run_symbols:
                    yield solve(held)
                    held, size = [], 0
                group = row[:2]
                held.append(row)
                size += len(row[7])
        if held:
            yield solve(held)

    return placed.mapInArrow(run, "id long, tie long, lo long, hi long, fp long, at long, string binary")


def _cut(words: Words, docs: pa.Array, texts: list[bytes], listed: pa.Array) -> pa.RecordBatch:
    """The result rows of some texts: their own repeated ranges and the ``listed`` ones go."""
    import hashlib

    import pyarrow.compute as pc

    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    d, _, lo, hi, fp, whole = anchors(words, data, offs)
    on = ~first_of_text(d, fp, whole)
    lo, hi = lo[on] + offs[d[on]], hi[on] + offs[d[on]]
    rows, of = pc.list_flatten(listed), pc.list_parent_indices(listed).to_numpy()
    x, y, kind = (rows.field(j).to_numpy() for j in range(3))
    x, y = x + offs[of], y + offs[of]
    key = x * 128 + (y - x)  # a range has at most L - K + 1 starts
    gone = (kind == 3) | ((kind == 0) & ~np.isin(key, key[kind == 1]))
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, np.concatenate([lo, x[gone]]), 1)
    np.add.at(edge, np.concatenate([hi, y[gone]]) + L, -1)
    gone = np.cumsum(edge)[:-1] > 0
    first, end = gone.copy(), gone.copy()  # the first and last byte of a span; none crosses texts
    first[1:] &= ~gone[:-1]
    end[:-1] &= ~gone[1:]
    start, close = offs[:-1][np.diff(offs) > 0], offs[1:][np.diff(offs) > 0] - 1
    first[start], end[close] = gone[start], gone[close]
    first, end = np.flatnonzero(first), np.flatnonzero(end) + 1
    own = np.searchsorted(offs, first, "right") - 1
    spans = np.searchsorted(first, offs)
    kept, left = data[~gone], np.concatenate([[0], np.cumsum(~gone)])[offs]
    shas = [hashlib.sha256(kept[i:j].tobytes()).hexdigest() for i, j in zip(left[:-1].tolist(), left[1:].tolist())]
    span = pa.StructArray.from_arrays([pa.array(first - offs[own]), pa.array(end - offs[own])], ["from", "to"])
    return pa.RecordBatch.from_arrays(
        [docs, pa.array(np.diff(offs)), pa.array(np.diff(offs) - np.diff(left)), pa.array(np.diff(spans)), pa.array(shas, pa.string()), pa.ListArray.from_arrays(pa.array(spans, pa.int32()), span)],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = 20_000) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row; spans are (from, to) byte offsets."""
    texts = _texts(df, id_col, text_col)
    packed = _packed(texts)
    classes = shared_table(_classes(texts, hot), "repeat-classes")
    merged = shared_table(_merged(_contexts(classes.filter("kind = 2"), packed), hot), "repeat-starts")
    survivors = merged.filter("string IS NOT NULL")
    second = survivors.withColumn("rank", F.rank().over(W.partitionBy("string").orderBy("id", "tie", "lo"))).filter("rank > 1")
    lo, hi = _bounds(F.col("p"))
    found = classes.filter("kind < 2").select("id", "tie", lo.alias("lo"), hi.alias("hi"), "kind")
    found = found.unionByName(merged.filter("string IS NULL").select("id", "tie", "lo", "hi", F.lit(3).alias("kind")))
    found = found.unionByName(second.select("id", "tie", "lo", "hi", F.lit(3).alias("kind")))
    lists = found.groupBy("id", "tie").agg(F.collect_set(F.struct("lo", "hi", "kind")).alias("found"))  # as many as the text has ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, words = zstandard.ZstdDecompressor().decompress, Words(lower=False)
        for batch in batches:
            at = 0
            while at < len(batch):
                texts, size = [], 0
                while at + len(texts) < len(batch) and size < 1 << 20:
                    texts.append(unpack(batch.column(1)[at + len(texts)].as_buffer()))
                    size += len(texts[-1])
                yield _cut(words, batch.column(0).slice(at, len(texts)), texts, batch.column(2).slice(at, len(texts)))
                at += len(texts)

    return packed.join(lists, ["id", "tie"], "left").select("doc_id", "z", "found").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from: long, to: long>>")
