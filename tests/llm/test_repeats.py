import hashlib
import random

import numpy as np
import pytest

from tests.llm.helpers import awkward, clashing, empty, sentence
from tidemark.llm import repeats as R


def brute(rows):
    """Result per (id, text) by looking at every 100-byte string in order."""
    seen, out = set(), {}
    for i, text in rows:
        b = (text or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for at in range(len(b) - R.L + 1):
            s = b[at:at + R.L]
            if s in seen:
                edge[at] += 1
                edge[at + R.L] -= 1
            seen.add(s)
        gone = np.cumsum(edge)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def texts(seed):
    rnd = random.Random(seed)
    common = [sentence(rnd, 40) for _ in range(4)]
    out = []
    for _ in range(60):
        parts = [sentence(rnd, rnd.randrange(1, 60)) if rnd.random() < 0.5 else rnd.choice(common)[rnd.randrange(30):][:rnd.randrange(60, 220)] for _ in range(rnd.randrange(1, 6))]
        out.append("é".join(parts))
    return out + ["ab" * 300, "ab" * 200, "z" * 99, "z" * 100, "z" * 101, out[3], out[3], "", None]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_against_brute_force(spark, hot):
    rows = list(enumerate(texts(1)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    assert got == brute(rows)


def test_merged_transforms():
    rnd = random.Random(2)
    base = bytes(rnd.choice(b"abc") for _ in range(400))
    contexts, last = [], []
    for _ in range(60):
        n, at = rnd.randint(0, 60), rnd.randint(0, 30)
        c = bytearray(base[at:at + n + R.L])
        if rnd.random() < 0.5:
            c[rnd.randrange(len(c))] = ord("z")
        contexts.append(bytes(c))
        last.append(n)
    seen, want = set(), []
    for c, n in zip(contexts, last):
        own = []
        for j in range(n + 1):
            if c[j:j + R.L] in seen:
                own.append(j)
            seen.add(c[j:j + R.L])
        want.append(own)
    for shard in (150, 1000, 1 << 17):
        assert [x.tolist() for x in R.repeated_starts(contexts, np.array(last), np.arange(60), shard)] == want


def test_common_prefixes_of_a_merge():
    data = [b"banana", b"bandana", b"ananas"]
    made = []
    for d in data:
        symbols = np.frombuffer(d + b"\0", np.uint8)
        made.append(R.shard_transform(symbols, np.array([0])))
    src, _, common = R.merge_transforms([b for _, b in made], 3, 10)
    suffixes = [d[i:] for d, (sa, _) in zip(data, made) for i in sa]
    merged = [suffixes[j] for j in src]
    assert merged == sorted(merged)
    for p in range(1, len(merged)):
        n = next((i for i, (x, y) in enumerate(zip(merged[p - 1] + b"\0", merged[p] + b"\0")) if x != y), None)
        assert n is None or min(n, 10) == common[p]


def test_awkward_rows(spark):
    df = clashing(awkward(spark))
    got = R.repeats(df).collect()
    assert len(got) == df.count() and R.repeats(empty(spark)).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[0].n_bytes == by[1].n_bytes == 0 and by[9].n_removed == 0
    assert by[11].n_removed == 300 and by[10].n_removed == 299  # all but the first start repeats
    assert by[3].n_removed == by[3].n_bytes  # the row without id comes first
    assert len({r.n_removed for r in got if r.doc_id == 4}) == 1


def test_only_open_parts_are_merged(monkeypatch):
    """Borders of plain copies, cut to what they share, are equal and need no merge; what differs on is merged."""
    rnd = random.Random(7)
    letters = lambda n: bytes(rnd.choice(b"abcdefgh") for _ in range(n))
    contexts = []
    for _ in range(40):
        core = letters(130)
        contexts += [letters(20) + core + letters(9), core + letters(30), letters(25) + core]
    core = letters(160)
    contexts += [letters(5) + core[:140], core[20:] + letters(5), letters(8) + core[8:150] + letters(3)]
    last = [len(c) - R.L for c in contexts]
    seen, want = set(), []
    for c, n in zip(contexts, last):
        own = [j for j in range(n + 1) if c[j:j + R.L] in seen]
        seen |= {c[j:j + R.L] for j in range(n + 1)}
        want.append(own)
    merged, orig = [], R.merge_transforms
    monkeypatch.setattr(R, "merge_transforms", lambda transforms, *a: merged.append(sum(map(len, transforms))) or orig(transforms, *a))
    got = R.repeated_starts(contexts, np.array(last), np.arange(len(contexts)))
    assert [x.tolist() for x in got] == want
    assert 0 < sum(merged) < 1000 < sum(map(len, contexts))
