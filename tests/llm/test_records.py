import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, clashing, empty
from tidemark.llm import tokens
from tidemark.session import work_dir

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, END = public_tokenizers.path("word_bpe_49k.json"), 2


def whole(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return [tok.encode(t or "", add_special_tokens=False).ids + [END] for t in texts]


def test_records_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(["a'll do's l'été", "<|endoftext|> a<|endoftext|>b", "éa ́b q.. q.x a|", "ﬁn Ⅷ ㎏ ٣٤ ab12", "한국어 말 it's", None, "", "word " * 3000, "x" * 5000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = tokens.encoded(df, PATH, END, files=3, records_per_file=2).orderBy("doc_id").collect()
    start = 0
    for r, ids in zip(got, whole(t for _, t in rows)):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_shuffled_reads(spark):
    df = spark.createDataFrame([(i, f"number {i} of many words") for i in range(40)], "doc_id long, text string")
    out = tokens.encode(df, PATH, work_dir(spark, "t"), END, files=2, records_per_file=7)
    index = tokens.build_index(spark, out)
    wanted = index.filter("doc_id % 3 = 0").orderBy(F.rand(1))
    got = {r.doc_id: list(r.ids) for r in tokens.read_at(spark, out, wanted).collect()}
    assert got == {i: ids for i, ids in enumerate(whole(f"number {i} of many words" for i in range(40))) if i % 3 == 0}


def test_damage_is_found():
    good = tokens.frame(struct.pack("<Bq", 0, 7) + b"\x01\x00\x02\x00") + b"\n"
    (_, _, payload), = tokens.frames(good)
    assert tokens.decode(payload)[0] == 7 and tokens.decode(payload)[1].tolist() == [1, 2]
    for at in (0, 9, 14, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(tokens.CorruptRecord):
            list(tokens.frames(bytes(bad)))
    with pytest.raises(tokens.CorruptRecord):
        list(tokens.frames(good[:10]))


def test_awkward_rows(spark):
    df = clashing(awkward(spark))
    got = tokens.encoded(df, PATH, END, files=2).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert len(got) == df.count() and ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert {r.doc_id: r.n_tokens for r in got}[0] == 1 and got[-1].start == sum(r.n_tokens for r in got[:-1])
    assert tokens.encoded(empty(spark), PATH, END).count() == 0


def test_marks_and_capitals_make_no_new_word():
    memory, run = tokens.word_encoder(PATH, False, 1 << 20)
    real, seen = memory.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **kw):
            seen.extend(" ".join(texts).split())
            return real.encode_batch_fast(texts, **kw)

        def encode(self, text, **kw):
            seen.append(text)
            return real.encode(text, **kw)

    memory.forget()
    memory.tokenizer = Counting()
    try:
        _, run = tokens.word_encoder(PATH, False, 1 << 20)
        texts = ["Quixotry quixotry, QUIXOTRY!!! quixotry.", "quixotry;; Quixotry?! don't Don't İ. \u0130 J\u030c. l'Été.. ab1. ...", ".. a|| A|"]
        for text in texts:
            assert np.frombuffer(run(text.encode()), "<u2").tolist() == real.encode(text, add_special_tokens=False).ids
    finally:
        memory.tokenizer = real
        memory.forget()
    assert sum("quixotry" in w.lower() for w in seen) == 1
