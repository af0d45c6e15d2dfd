"""Running CRCs, feature buckets and the draw against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.helpers import awkward, clashing, empty, lower, sentence
from tidemark.llm import crc, importance
from tidemark.llm.textnp import slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, runs):
    w = WORD.findall(lower(text or ""))
    return len(w), [" ".join(w[i:i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 40_000])
def test_any_part_from_two_prefixes(n):
    rnd = random.Random(n)
    data = bytes(rnd.randrange(256) for _ in range(n))
    run = crc.running(np.frombuffer(data, np.uint8))
    for _ in range(30):
        a = rnd.randrange(n + 1)
        b = rnd.randrange(a, n + 1)
        assert int(crc.part(run[a:a + 1], run[b:b + 1], np.array([b - a]))[0]) == zlib.crc32(data[a:b])


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_runs_of_words(piece, monkeypatch):
    monkeypatch.setattr(importance.borders, "__defaults__", (piece,))
    rnd = random.Random(2)
    texts = ["", "Abc, d", "  ", "x", "Größe été 한국어 😀 naïve", "b", ".", "end", "q" * 3000 + " z"] + [sentence(rnd, rnd.randrange(40)) + rnd.choice(["", " ", ".\n"]) for _ in range(100)]
    data = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    sums, of, words = importance.run_checksums(np.frombuffer(b"".join(data), np.uint8), offs, 3)
    for i, t in enumerate(texts):
        n, found = features(t, 3)
        assert words[i] == n and sorted(map(int, sums[of == i])) == sorted(zlib.crc32(f.encode()) for f in found)


def brute(docs, target, percent, least, seed, runs, buckets):
    count = lambda texts: np.bincount([bucket(f, buckets) for t in texts for f in features(t, runs)[1]], minlength=buckets)
    s, t = count(x for _, x in docs), count(target)
    gain = [math.floor(1000 * math.log((b + 1) * (int(s.sum()) + buckets) / ((a + 1) * (int(t.sum()) + buckets)))) for a, b in zip(map(int, s), map(int, t))]
    rows = []
    for i, x in docs:
        n, own = features(x, runs)
        weight = sum(gain[bucket(f, buckets)] for f in own) // len(own) if own else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, n, len(own), weight, score, None])
    may = sorted((r for r in rows if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for place, r in enumerate(may[:percent * len(may) // 100]):
        r[5] = place + 1
    return sorted(((i, f, w, sc, rank) for i, _, f, w, sc, rank in rows), key=str)


@pytest.mark.parametrize("percent, runs, buckets", [(10, 1, 10_000), (50, 3, 100), (100, 2, 70_000)])
def test_draw_against_brute_force(spark, percent, runs, buckets):
    rnd = random.Random(4)
    more = [(100 + i, sentence(rnd, rnd.randrange(15, 60), 30 + 300 * (i % 2)), "en", "s", 1) for i in range(150)]
    docs = awkward(spark, more)
    target = [sentence(rnd, 40, 30) for _ in range(20)] + [None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for df in (docs, clashing(docs).drop("text_")):
        got = importance.resampled(df, bench, percent=percent, runs=runs, buckets=buckets).collect()
        want = brute([(r.doc_id, r.text) for r in docs.collect()], target, percent, 20, 2024, runs, buckets)
        assert sorted(map(tuple, got), key=str) == want
    kept = importance.take(docs, importance.resampled(docs, bench, percent=percent, runs=runs, buckets=buckets))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[0] for w in want if w[4]}


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert importance.resampled(empty(spark), bench).count() == 0
    rows = importance.resampled(awkward(spark), bench.limit(0)).collect()
    assert len(rows) == awkward(spark).count()


def test_slices_of_nothing():
    import pyarrow as pa

    assert list(slices(pa.array([], pa.binary()))) == []
