"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item of n shingles is contained in a document if at least ``percent`` of them occur there, so at most
``m = n - ceil(percent n / 100)`` may be missing. Items are partitioned by size (powers of two of n). A partition's
items are sketched by their ``m_max + SPARE`` smallest hashes (bottom-k MinHash), where ``m_max`` belongs to the
partition's largest item; of an item's sketch at least ``length - m`` must occur in any document that contains it, so
the search misses none, whatever the document's length. Documents smaller than a partition's smallest requirement skip
it. Candidates are verified on the exact word sequences of whole texts.

The test set is the stated query set: it is taken in blocks of bounded rows and bytes, each block travels to the tasks
and meets every document in one pass without a shuffle.

Defined results: null, empty and blank texts and items contain nothing and are contained in nothing; a text or item of
fewer words than ``k`` is one shingle, its whole sequence; items that repeat (same id and text) count once; repeated
documents are judged row by row; an empty table gives an empty result; other columns are ignored by ``contained`` and
kept by ``drop_contaminated``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD
from tidemark.llm.textnp import Words, slices, text_shingles

SPARE = 2
FOUND = "doc_id long, item_id long, n_item long, n_shared long"


def word_tuples(text: str, k: int) -> set[tuple[str, ...]]:
    """The distinct ``k``-word shingles of one text, as words (A-Z as a-z)."""
    low = text.translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(WORD, low)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def missing(n: int, percent: int) -> int:
    return n - -(-percent * n // 100)


class ItemIndex:
    """Sketches of one block of items, by size partition."""

    def __init__(self, items: list[tuple[int, str]], k: int, percent: int) -> None:
        words = Words()
        self.items = [(i, t, s) for i, t in items if len(s := text_shingles(words, t.encode(), k))]
        parts: dict[int, list[int]] = {}
        for at, (_, _, s) in enumerate(self.items):
            parts.setdefault(len(s).bit_length(), []).append(at)
        self.partitions = []
        for members in parts.values():
            length = max(missing(len(self.items[at][2]), percent) for at in members) + SPARE
            rows = [(h, at) for at in members for h in self.items[at][2][:length]]
            keys, owner = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 20, bool)  # rules out nearly all shingles of a document at one look each
            seen[(keys >> np.uint64(44)).astype(np.int64)] = True
            need = {at: min(length, len(self.items[at][2])) - missing(len(self.items[at][2]), percent) for at in members}
            least = min(len(self.items[at][2]) - missing(len(self.items[at][2]), percent) for at in members)
            self.partitions.append((keys[order], owner[order], seen, need, least))

    def candidates(self, shingles: np.ndarray, text_of: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) with enough of the item's sketch in the text. ``sizes``: shingles per text."""
        out = set()
        slot = (shingles >> np.uint64(44)).astype(np.int64)
        for keys, owner, seen, need, least in self.partitions:
            hit = np.flatnonzero(seen[slot])
            hit = hit[sizes[text_of[hit]] >= least]
            lo, hi = np.searchsorted(keys, shingles[hit], "left"), np.searchsorted(keys, shingles[hit], "right")
            pairs = {(int(t), int(owner[j]), int(keys[j])) for t, a, b in zip(text_of[hit], lo, hi) for j in range(a, b)}
            count: dict[tuple[int, int], int] = {}
            for t, at, _ in pairs:
                count[t, at] = count.get((t, at), 0) + 1
            out |= {x for x, c in count.items() if c >= need[x[1]]}
        return out


def _searcher(items: list[tuple[int, str]], k: int, percent: int) -> Callable[[pa.Array], Iterator[tuple[int, int, int, int]]]:
    """A function from a column of texts to (row, item id, item's shingles, shared shingles), verified."""
    state: dict = {}

    def search(column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        if not state:
            state.update(words=Words(), index=ItemIndex(items, k, percent), known={})
        words, index, known = state["words"], state["index"], state["known"]
        for at, data, offs in slices(column):
            sh, first = words.shingles(data, offs, k)
            sizes = np.diff(first)
            found = sorted(index.candidates(sh, np.repeat(np.arange(len(sizes)), sizes), sizes))
            last, own = -1, set()
            for d, i in found:
                if d != last:
                    last, own = d, word_tuples(bytes(data[offs[d]:offs[d + 1]]).decode("utf-8", "replace"), k)
                if i not in known:
                    known[i] = word_tuples(index.items[i][1], k)
                shared = len(known[i] & own)
                if 100 * shared >= percent * len(known[i]):
                    yield at + d, index.items[i][0], len(known[i]), shared

    return search


def item_blocks(items: DataFrame, id_col: str, text_col: str, rows: int = 20_000, text_bytes: int = 32 << 20) -> Iterator[list[tuple[int, str]]]:
    """Distinct items in blocks of about ``rows`` items and ``text_bytes`` bytes at most."""
    own = items.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).distinct()
    n, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).head()
    blocks = max(1, -(-n // rows), -(-size // text_bytes))
    for b in range(blocks):
        yield [(r.i, r.t) for r in own.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()]


def contained(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
              k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared`` of every document that contains an item."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = None
    for block in item_blocks(items, item_id, item_text):
        search = _searcher(block, k, percent)

        def run(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(search(batch.column(1).cast(pa.binary())))
                ids = batch.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([h[j] for h in hits], pa.int64()) for j in (1, 2, 3))], ["doc_id", "item_id", "n_item", "n_shared"])

        part = rows.mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that contain no item, with all their columns."""
    at, schema = df.columns.index(text_col), T.StructType(df.schema.fields)
    for block in item_blocks(items, item_id, item_text):
        search = _searcher(block, k, percent)

        def run(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                mask[[h[0] for h in search(batch.column(at).cast(pa.binary()))]] = False
                yield batch.filter(pa.array(mask))

        df = df.mapInArrow(run, schema)
    return df
