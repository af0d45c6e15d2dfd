"""Token-id output: length-delimited binary records with masked checksums, and an offset index for shuffled reads.

One record per document, in ascending id order over all files::

    u64 payload length | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of the payload | \\n

    payload: u8 flags (1: id is null, 2: ids are 32 bit) | i64 id | token ids, little-endian, 16 or 32 bit

The masked form is ``rotate_right(crc, 15) + 0xA282EAD8`` as in common record files; the last byte is the separator of
Spark's text writer, through which frames reach any file system and the writer's commit protocol. Readers go by the
lengths, so separators inside a payload do no harm. Text is shuffled once, by ranges of the id; encoding, framing and
writing happen in the tasks that hold a range. The index has one row per record (file, offset, length, tokens).

Defined results: null and empty texts give a record of the end id alone; null ids come first; rows with equal ids stay
separate records, ordered by a hash of their text; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import sys
import zlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase
from types import ModuleType

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, shared_table, small_batches, tasks, work_dir

MASK_DELTA = 0xA282EAD8
HEAD, TAIL, META = "<QI", "<I", "<Bq"
HEAD_SIZE, TAIL_SIZE, META_SIZE = map(struct.calcsize, (HEAD, TAIL, META))
INDEX_SCHEMA = "doc_id long, part int, piece int, offset long, length long, n_tokens long, local_start long, ids_crc32 long"


class CorruptRecord(ValueError):
    """A frame whose checksums or lengths do not agree."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without the writer's separator."""
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, struct.pack(TAIL, masked(size)), payload, struct.pack(TAIL, masked(payload))))


def frames(content: bytes) -> Iterator[tuple[int, int, memoryview]]:
    """(offset, frame length, payload) of each record; raises on damage."""
    view, at = memoryview(content), 0
    while at < len(view):
        if at + HEAD_SIZE > len(view):
            raise CorruptRecord(f"cut header at {at}")
        size, check = struct.unpack_from(HEAD, view, at)
        end = at + HEAD_SIZE + size
        if check != masked(view[at:at + 8]) or end + TAIL_SIZE > len(view):
            raise CorruptRecord(f"bad length at {at}")
        payload = view[at + HEAD_SIZE:end]
        if struct.unpack_from(TAIL, view, end)[0] != masked(payload):
            raise CorruptRecord(f"bad payload at {at}")
        yield at, end + TAIL_SIZE - at, payload
        at = end + TAIL_SIZE + 1


def decode(payload: bytes | memoryview):
    """(id or None, token ids as unsigned 32-bit numpy array)."""
    import numpy as np

    flags, doc = struct.unpack_from(META, payload, 0)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=META_SIZE).astype("<u4")
    return None if flags & 1 else doc, ids


MARKS = b".,;:!?|%$*#&"


class WordMemory:
    """A tokenizer and the packed ids of the words met before.

    ``most`` bounds the bytes its keys, values and table take, as Python reports them; beyond it all words are forgotten.
    Functions travel to tasks by value and classes are made anew there, so a Python worker keeps its one memory as an
    entry of ``sys.modules``, where later tasks of the same tokenizer find it; that of another one is dropped.
    """

    PLACE = "tidemark_word_memory"

    @classmethod
    def of(cls, path: str, most: int) -> "WordMemory":
        found = sys.modules.get(cls.PLACE)
        if found is None or (found.path, found.memory.most) != (path, most):
            sys.modules[cls.PLACE] = found = ModuleType(cls.PLACE)
            found.path, found.memory = path, cls(path, most)
        return found.memory

    def __init__(self, path: str, most: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = {i for t, i in self.tokenizer.get_vocab(True).items() if t.endswith("</w>")}
        pieces = self.tokenizer.pre_tokenizer and self.tokenizer.pre_tokenizer.pre_tokenize_str
        normal = self.tokenizer.normalizer and self.tokenizer.normalizer.normalize_str
        #: A mark behind a letter starts a piece; capital ASCII letters are read as small ones.
        self.parts = bool(pieces) and all(len(found := pieces("a" + m * n)) > 1 and found[0][0] == "a" for m in MARKS.decode() for n in (1, 2))
        self.folds = bool(normal) and normal(ascii_uppercase) == ascii_lowercase
        self.most, self.ids, self.content = most, {}, 0

    def learn(self, word: bytes, ids: bytes) -> None:
        self.ids[word] = ids
        self.content += sys.getsizeof(word) + sys.getsizeof(ids)

    def full(self) -> bool:
        return self.content + sys.getsizeof(self.ids) > self.most

    def forget(self) -> None:
        self.ids, self.content = {}, 0


def word_encoder(path: str, wide: bool, remember: int):
    """A function from text bytes to packed ids that works word by word and remembers words, and its memory.

    ASCII white space always ends a piece of these tokenizers (see ``encode``). New words of a text are encoded
    together where their number of pieces is known, a letter run being one piece and the punctuation marks after it
    another; the ends of pieces tell them apart, and any doubt sends them through one by one. Words of ASCII letters are
    put together from their letters and the marks behind them, so that neither marks nor capitals make a word new.
    """
    from array import array

    memory = WordMemory.of(path, remember)
    tok, ends = memory.tokenizer, memory.ends
    code, marks = "I" if wide else "H", MARKS.decode()

    def ids_of(text: str) -> list[int]:
        return tok.encode(text, add_special_tokens=False).ids

    def parts(w: bytes) -> tuple[bytes, ...]:
        """ASCII letters, small where that is the same, and the marks behind them; other words whole."""
        core = w.rstrip(MARKS) if memory.parts else w
        if not core.isalpha():
            return (w,)
        low = core.lower() if memory.folds else core
        return (low,) if len(core) == len(w) else (low, w[len(core):])

    def learn(new: list[bytes]) -> None:
        made = [(w, parts(w)) for w in new]
        encode_new({p for _, found in made for p in found if p not in memory.ids})
        for w, found in made:
            if found[0] is not w and w not in memory.ids:
                memory.learn(w, b"".join([memory.ids[p] for p in found]))

    def encode_new(new: set[bytes]) -> None:
        joined, pieces, rest = [], [], []
        for w in new:
            text = w.decode("utf-8", "replace")
            n = 1 if text.isalpha() else 2 if text.rstrip(marks).isalpha() else 0
            if n:
                joined.append((w, text))
                pieces.append(n)
            else:
                rest.append((w, text))
        # the fast call leaves out the offsets, which nobody reads
        all_ids = tok.encode_batch_fast([" ".join(t for _, t in joined)], add_special_tokens=False)[0].ids if joined else []
        cuts = [i + 1 for i, x in enumerate(all_ids) if x in ends]
        if len(cuts) == sum(pieces) and (not cuts or cuts[-1] == len(all_ids)):
            start, at = 0, 0
            for (w, _), n in zip(joined, pieces):
                at += n
                memory.learn(w, array(code, all_ids[start:cuts[at - 1]]).tobytes())
                start = cuts[at - 1]
        else:
            rest += joined
        for w, text in rest:
            memory.learn(w, array(code, ids_of(text)).tobytes())

    def run(text: bytes) -> bytes:
        words = text.split()
        ids = list(map(memory.ids.get, words))
        if None in ids:
            if memory.full():
                memory.forget()
                ids = [None] * len(words)
            learn(list({w for w, i in zip(words, ids) if i is None}))
            ids = list(map(memory.ids.get, words))
        return b"".join(ids)

    return memory, run


def encode(df: DataFrame, path: str, out: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None,
           records_per_file: int = 50_000, by_word: bool = True, remember: int = 112 << 20) -> str:
    """Write the records of ``df`` below ``out`` and return ``out``.

    ``by_word``: the tokenizer drops white space and never joins across it, so encoding word by word is exact; pass
    False for tokenizers that keep spaces. ``remember`` bounds the bytes of words a Python worker remembers. ``path`` must
    be readable on the driver and every executor.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())  # equal rows of a hot id can be split
    order = [F.col("id").asc_nulls_first(), F.col("tie"), F.col("row")]
    placed = rows.repartitionByRange(files or tasks(df.sparkSession), *order).sortWithinPartitions(*order).select("id", "text")

    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(path).get_vocab_size(True) > 65536

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from array import array

        memory, fast = word_encoder(path, wide, remember)
        tok = memory.tokenizer
        code = "I" if wide else "H"
        last = array(code, [end_id]).tobytes()
        for batch in batches:
            texts, out_rows, held = batch.column(1).cast(pa.binary()), [], 0
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                content = text.as_py()
                ids = fast(content) if by_word else array(code, tok.encode(content.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
                out_rows.append(frame(struct.pack(META, (doc is None) | wide << 1, doc or 0) + ids + last))
                held += len(out_rows[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out_rows, pa.binary())], ["frame"])
                    out_rows, held = [], 0
            if out_rows:
                yield pa.RecordBatch.from_arrays([pa.array(out_rows, pa.binary())], ["frame"])
        give_back()

    with small_batches(df.sparkSession):
        placed.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("frame")).write.option(
            "maxRecordsPerFile", records_per_file).option("lineSep", "\n").text(out)
    return out


def _files(spark: SparkSession, out: str) -> DataFrame:
    """One row per file, in the order of the writer's tasks. A file's size is bounded by ``records_per_file``."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select(
        F.regexp_extract(name, r"^part-(\d+)-", 1).cast("int").alias("part"), F.regexp_extract(name, r"-c(\d+)\.", 1).cast("int").alias("piece"), "content")


def build_index(spark: SparkSession, out: str) -> DataFrame:
    """Read every record of ``out`` and write the offset index beside it (``<out>-index``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, piece, content in zip(*(batch.column(i) for i in range(3))):
                rows, start = [], 0
                for at, length, payload in frames(content.as_buffer()):
                    doc, ids = decode(payload)
                    rows.append((doc, part.as_py(), piece.as_py(), at, length, len(ids), start, zlib.crc32(ids)))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5))] if rows else
                    [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5)],
                    ["doc_id", "part", "piece", "offset", "length", "n_tokens", "local_start", "ids_crc32"])

    path = f"{out}-index"
    _files(spark, out).mapInArrow(run, INDEX_SCHEMA).write.parquet(path)
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


def with_start(index: DataFrame) -> DataFrame:
    """The index with ``start``: ids of all records before. The only ordered window has one row per file."""
    sums = index.groupBy("part", "piece").agg(F.sum("n_tokens").alias("n"))
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return index.join(base.drop("n"), ["part", "piece"]).withColumn("start", F.col("base") + F.col("local_start")).drop("base", "local_start")


def read_at(spark: SparkSession, out: str, wanted: DataFrame) -> DataFrame:
    """``doc_id, ids`` of the wanted index rows (any subset, any order): each file is opened once and sliced at the
    wanted offsets, so a shuffled or sampled read costs no scan of the other records' checksums or ids."""
    per_file = wanted.groupBy("part", "piece").agg(F.collect_list(F.struct("offset", "length")).alias("at"))  # bounded by records_per_file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, at in zip(batch.column(0), batch.column(1).to_pylist()):
                view = memoryview(content.as_buffer())
                found = [decode(payload) for x in at for _, _, payload in frames(view[x["offset"]:x["offset"] + x["length"]])]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return _files(spark, out).join(per_file, ["part", "piece"]).select("content", "at").mapInArrow(run, "doc_id long, ids array<long>")


def encoded(df: DataFrame, path: str, end_id: int, **options) -> DataFrame:
    """Encode, write, index, and return the index rows with global starts, all taken from the files."""
    spark = df.sparkSession
    out = encode(df, path, work_dir(spark, "records"), end_id, **options)
    return with_start(build_index(spark, out)).select("doc_id", "start", "n_tokens", "ids_crc32", "part", "piece", "offset", "length")


__all__ = ["CorruptRecord", "build_index", "decode", "encode", "encoded", "frame", "frames", "read_at", "shared_table", "with_start"]
