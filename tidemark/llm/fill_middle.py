"""Fill-in-middle: cut texts at two boundaries of characters, words or lines and move the middle to the end.

All bytes of a few texts form one wavelet matrix over character classes: three bit vectors, each sorted stably by the bit
before, with counts of ones per block of 64. ``rank(c, p)``, the number of bytes of class c before p, walks down the three
vectors. Boundaries are counted by combining ranks, per text by differences at its ends:

* characters: bytes that do not continue a character;
* lines: newlines, and one more if the text ends without one;
* words: first characters of words (white space in front belongs to the first word, other white space to the word before
  it); a text of white space only is one unit.

The cut after unit j is found by bisection on the rank of the class, for all texts of the batch at once. No list of
boundaries is made, and three bits a byte and their counts serve every unit.

The two cuts and the form follow from ``sha256(seed:id)``. A text that contains a mark, or that would not be rebuilt
exactly from its output, stays plain.

Defined results: null and empty texts have no units and give an empty plain output; rows without id hash as ``seed:``
alone; repeated rows give equal outputs; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textnp import slices

#: Classes: a byte that continues a character, newline, other ASCII white space, first character of a word, any other.
MORE, LINE, BLANK, FIRST, OTHER = range(5)
LEVELS = 3
MARKS = ("<P>", "<S>", "<M>")
BLOCK = 64


def classes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The class of every byte of consecutive UTF-8 texts."""
    kind = np.full(256, OTHER, np.uint8)
    kind[0x80:0xC0] = MORE
    kind[[32, 9, 11, 12, 13]] = BLANK
    kind[10] = LINE
    out = kind[data]
    white = (out == BLANK) | (out == LINE)
    begins = np.empty(len(out), bool)
    begins[:1], begins[1:] = True, white[:-1]
    begins[offs[:-1][offs[:-1] < len(out)]] = True
    out[begins & (out == OTHER)] = FIRST
    return out


class WaveletMatrix:
    """Ranks and selections of the values below ``2 ** levels`` of a sequence."""

    def __init__(self, values: np.ndarray, levels: int = LEVELS) -> None:
        self.n, self.levels = len(values), levels
        self.words, self.ones, self.zeros = [], [], []
        for level in reversed(range(levels)):
            bit = (values >> level) & 1
            packed = np.zeros(-(-self.n // BLOCK) * 8 + 8, np.uint8)
            bits = np.packbits(bit, bitorder="little")
            packed[:len(bits)] = bits
            words = packed.view("<u8")
            self.words.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)]))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _ones(self, level: int, p: np.ndarray) -> np.ndarray:
        """Ones before each position of a level."""
        block, low = p // BLOCK, (p % BLOCK).astype(np.uint64)
        return self.ones[level][block] + np.bitwise_count(self.words[level][block] & ((np.uint64(1) << low) - np.uint64(1)))

    def rank(self, value: int, p: np.ndarray) -> np.ndarray:
        """How often ``value`` occurs before each position."""
        low, p = 0, np.asarray(p, np.int64)
        for i in range(self.levels):
            ones, ones_low = self._ones(i, p), self._ones(i, np.array([low]))[0]
            if (value >> (self.levels - 1 - i)) & 1:
                p, low = self.zeros[i] + ones, self.zeros[i] + int(ones_low)
            else:
                p, low = p - ones, low - int(ones_low)
        return p - low

    def first_with(self, count, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The least position in [low, high] where the rising ``count(position)`` reaches ``wanted``; high where none does."""
        low, high = np.array(low, np.int64), np.array(high, np.int64)
        while (on := low < high).any():
            middle = (low + high) // 2
            reached = count(middle) >= wanted
            high, low = np.where(on & reached, middle, high), np.where(on & ~reached, middle + 1, low)
        return low


class Boundaries:
    """Counts and places of unit boundaries in consecutive texts."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        self.data, self.offs = data, offs
        self.matrix = WaveletMatrix(classes(data, offs))
        self.begin, self.end = offs[:-1], offs[1:]

    def chars_before(self, p: np.ndarray) -> np.ndarray:
        return p - self.matrix.rank(MORE, p)

    def count(self, unit: str) -> np.ndarray:
        rank, full = self.matrix.rank, self.end > self.begin
        if unit == "char":
            return self.chars_before(self.end) - self.chars_before(self.begin)
        if unit == "word":
            return np.maximum(rank(FIRST, self.end) - rank(FIRST, self.begin), full)
        tail = rank(LINE, self.end) == rank(LINE, np.maximum(self.end - 1, self.begin))
        return rank(LINE, self.end) - rank(LINE, self.begin) + (full & tail)

    def after(self, unit: str, j: np.ndarray) -> np.ndarray:
        """Position behind the j-th unit of each text."""
        if unit == "line":
            rank = lambda p: self.matrix.rank(LINE, p)
            return self.matrix.first_with(rank, self.begin, self.end, rank(self.begin) + j)
        rank = self.chars_before if unit == "char" else lambda p: self.matrix.rank(FIRST, p)
        # the place of the first byte of unit j + 1: the last position with j units before it
        found = self.matrix.first_with(lambda p: rank(p), self.begin, self.end + 1, rank(self.begin) + j + 1) - 1
        return np.where(j == 0, self.begin, np.minimum(found, self.end))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit integers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def rebuilt(output: bytes, form: str, marks: Sequence[bytes]) -> bytes:
    """The text of an output; in Python, to prove an output before it is returned."""
    p, s, m = marks
    if form == "plain":
        return output
    if form == "psm":
        prefix, _, rest = output[len(p):].partition(s)
        suffix, _, middle = rest.partition(m)
    else:
        suffix, _, rest = output[len(s):].partition(p)
        prefix, _, middle = rest.partition(m)
    return prefix + middle + suffix


def transformed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = 7, percent: int = 100,
                spm_percent: int = 50, marks: Sequence[str] = MARKS) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row: n units, ``form`` plain, psm (prefix, suffix,
    middle) or spm (suffix, prefix, middle), each part behind its mark."""
    if unit not in ("char", "word", "line"):
        raise ValueError(f"unknown unit {unit}")
    m_p, m_s, m_m = encoded = [m.encode() for m in marks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offs in slices(batch.column(1)):
                ids = batch.column(0).slice(at, len(offs) - 1)
                found = Boundaries(data, offs)
                n = found.count(unit)
                h = np.array([draws(seed, i) for i in ids.to_pylist()], np.int64)
                one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
                cut = [found.after(unit, np.minimum(one, two)), found.after(unit, np.maximum(one, two))]
                begin, first, second = (found.chars_before(x) for x in (found.begin, *cut))
                raw, forms, outputs = data.tobytes(), [], []
                for i in range(len(n)):
                    lo, a, b, hi = int(offs[i]), int(cut[0][i]), int(cut[1][i]), int(offs[i + 1])
                    text, form = raw[lo:hi], "spm" if h[i, 3] % 100 < spm_percent else "psm"
                    if not text or h[i, 2] % 100 >= percent or any(m in text for m in encoded):
                        form = "plain"
                    else:
                        prefix, middle, suffix = raw[lo:a], raw[a:b], raw[b:hi]
                        output = b"".join((m_p, prefix, m_s, suffix, m_m, middle) if form == "psm" else (m_s, suffix, m_p, prefix, m_m, middle))
                        form = form if rebuilt(output, form, encoded) == text else "plain"
                    forms.append(form)
                    outputs.append(text if form == "plain" else output)
                cut_up = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(first - begin, pa.int64(), mask=cut_up),
                     pa.array(second - first, pa.int64(), mask=cut_up), pa.array(outputs, pa.binary())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kinds = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
    out = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, kinds)
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The exact text from an output and its form, with built-in functions."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
