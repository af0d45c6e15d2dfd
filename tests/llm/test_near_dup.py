import random

import numpy as np
import pytest

from tests.llm.helpers import awkward, classes, clashing, empty, sentence, shingles
from tidemark.llm import near_dup
from tidemark.llm.components import components


def edited(rnd, words, edits):
    w = list(words)
    for _ in range(edits):
        kind, at = rnd.random(), rnd.randrange(len(w))
        if kind < 0.6:
            w[at] = f"e{rnd.randrange(10**6)}"
        elif kind < 0.8:
            del w[at]
        else:
            w.insert(at, f"e{rnd.randrange(10**6)}")
    return w


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_against_brute_force(spark, seed):
    """A group of near copies around the threshold, chains of edits, sub-groups with common edits, and strangers."""
    rnd = random.Random(seed)
    base, texts = sentence(rnd, 120, 10**6).split(), []
    texts += [" ".join(edited(rnd, base, rnd.randrange(1, 14))) for _ in range(120)]
    chain = base
    for _ in range(25):
        chain = edited(rnd, chain, 3)
        texts.append(" ".join(chain))
    half = edited(rnd, base, 12)
    texts += [" ".join(edited(rnd, half, rnd.randrange(1, 6))) for _ in range(25)]
    cut = base[:80]
    texts += [" ".join(edited(rnd, cut, rnd.randrange(0, 4))) for _ in range(15)] + [sentence(rnd, rnd.randrange(1, 50), 60) for _ in range(40)]
    rnd.shuffle(texts)
    want = classes({i: shingles(t, 4) for i, t in enumerate(texts)}, 80)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dup.near_duplicates(df, k=4).collect()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.n_shingles == len(shingles(texts[d], 4)) and r.kept == (r.component_id == d) for d, r in got.items())


def test_awkward_rows(spark):
    df = clashing(awkward(spark))
    got = near_dup.near_duplicates(df).orderBy("doc_id", "n_shingles").collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[0].kept and by[2].component_id == 2
    assert by[4].component_id == by[5].component_id == 3 and by[7].component_id == 6 and by[11].component_id == 10
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    left = near_dup.drop_near_duplicates(df)
    assert left.columns == df.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 6, 8, 9, 10] and ids.count(None) == 2
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "other words are here now")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dup.drop_near_duplicates(twice).collect()) == [1, 2]


def test_empty_table(spark):
    assert near_dup.near_duplicates(empty(spark)).count() == 0 and near_dup.drop_near_duplicates(empty(spark)).count() == 0


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
    both = np.concatenate([a, b])
    r = near_dup.registers(np.concatenate([a, both, b]), np.array([0, 900, 1900]))
    assert (near_dup.merge(r[0], r[2]) == r[1]).all()
    assert abs(near_dup.estimate(r[0], r[1], 900, 1000)[0] - 0.9) < 0.1
    assert near_dup.plausible(r[0], r[1], 900, 1000, 0.9) and not near_dup.plausible(r[0], r[2], 900, 100, 0.2)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_unlike_texts_under_one_id(spark):
    rnd = random.Random(6)
    a, b = (sentence(rnd, 100, 10**6) for _ in range(2))
    rows = [(1, a), (1, b), (2, b + " tail"), (3, a + " end"), (4, "only here " + sentence(rnd, 30, 10**6)), (4, a + " end more"), (1, a.upper()), (5, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df, k=4).collect())
    assert got == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 1, False), (4, 4, True), (5, 5, True), (5, 5, True)]
    left = sorted(near_dup.drop_near_duplicates(df).collect(), key=str)
    assert [r.doc_id for r in left] == [1, 1, 4, 5] and {r.text for r in left if r.doc_id == 1} - {a, a.upper()} == {b}


def test_member_that_was_hub_of_its_hub(spark):
    """x meets h in a bucket of their own with x as hub, then h is the hub of a large bucket: the link of x to y, near h but
    not linked to it, hangs on the differences from h."""
    from pyspark.sql import functions as F

    from tidemark.llm import components as C

    rnd = random.Random(1)
    core = {f"s{i}" for i in range(200)}
    sets = {"h": core}
    mark = {f"e{i}" for i in range(60)}
    sets["x"], sets["y"] = core | mark, core | mark | {"z"}
    sets |= {f"m{i}": core | {f"o{i}-{j}" for j in range(10)} for i in range(90)}
    sets["f"] = {f"far{i}" for i in range(200)}
    # ids that make x the first hub (the smallest id) and h the hub of the second round (the largest hash)
    second = spark.range(1, len(sets)).orderBy(F.desc(F.xxhash64(F.lit(0), "id"))).first().id
    rest = iter(i for i in range(1, len(sets)) if i != second)
    ids = {n: 0 if n == "x" else second if n == "h" else next(rest) for n in sets}
    bands = [("K1", ids[n]) for n in "xh"] + [("K2", ids[n]) for n in sets]
    bands += [(f"L{i}", ids["f"]) for i in range(3)] + [(f"L{i}", ids[n]) for i in range(3) for n in [m for m in sets if m[0] == "m"][30 * i:30 * i + 30]]
    code = {e: i for i, e in enumerate(sorted(set().union(*sets.values())))}
    table = spark.createDataFrame([(ids[n], sorted(code[e] for e in s)) for n, s in sets.items()], "id long, s array<long>")

    def test(pairs, least):
        side = lambda c: table.select(F.col("id").alias(c), F.col("s").alias(f"s_{c}"))
        rows = pairs.join(side("a"), "a").join(side("b"), "b").select(
            "a", "b", F.size("s_b").cast("long").alias("n"), F.array_except("s_b", "s_a").alias("gone"), F.array_except("s_a", "s_b").alias("new"))
        return rows.filter(100 * (F.col("n") - F.size("gone")) >= least * (F.col("n") + F.size("new")))

    comp = {r.node: r.component for r in C.bucket_components(spark.createDataFrame(bands, "key string, id long"), test, 80).collect()}
    assert comp[ids["x"]] == comp[ids["y"]]


def test_small_tables_take_few_tasks(spark):
    """However many shuffle partitions there are, tables between the steps are written by tasks that their rows need."""
    import glob

    from tidemark.session import work_dir

    rnd = random.Random(9)
    base = sentence(rnd, 100, 10**6).split()
    rows = [(i, " ".join(edited(rnd, base, rnd.randrange(0, 9)))) for i in range(150)]
    want = classes({i: shingles(t, 4) for i, t in rows}, 80)
    root = work_dir(spark).rsplit("/", 1)[0]
    before, keys = set(glob.glob(f"{root}/*")), {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want
    made = [d for d in set(glob.glob(f"{root}/*")) - before if d.split("/")[-1].split("-")[0] in ("links", "members", "tests", "near", "open", "differences") and "sketches" not in d and "classes" not in d]
    assert made and max(len(glob.glob(f"{d}/part-*")) for d in made) <= 2 * spark.sparkContext.defaultParallelism


def test_strangers_in_one_bucket_are_not_paired(spark):
    """150 sets with a passage in common, some with near copies, one with 20: tests do not grow with the square of the bucket (17,020 pairs)."""
    from pyspark.sql import functions as F

    from tidemark.llm import components as C

    passage = [f"p{i}" for i in range(12)]
    sets = [passage + [f"s{i}-{j}" for j in range(40 + i % 9)] for i in range(150)]
    sets += [s[:-2] + [f"new{i}"] for i, s in enumerate(sets[::10])] + [sets[3] + [f"more{i}"] for i in range(20)]
    want = classes({i: set(s) for i, s in enumerate(sets)}, 80)
    code = {e: i for i, e in enumerate(sorted({e for s in sets for e in s}))}
    table, tested = spark.createDataFrame([(i, sorted(code[e] for e in s)) for i, s in enumerate(sets)], "id long, s array<long>"), []

    def test(pairs, least):
        tested.append(pairs.count())
        side = lambda c: table.select(F.col("id").alias(c), F.col("s").alias(f"s_{c}"))
        rows = pairs.join(side("a"), "a").join(side("b"), "b").select(
            "a", "b", F.size("s_b").cast("long").alias("n"), F.array_except("s_b", "s_a").alias("gone"), F.array_except("s_a", "s_b").alias("new"))
        return rows.filter(100 * (F.col("n") - F.size("gone")) >= least * (F.col("n") + F.size("new")))

    bands = spark.createDataFrame([("K", i) for i in range(len(sets))], "key string, id long")
    comp = {r.node: r.component for r in C.bucket_components(bands, test, 80).collect()}
    assert {i: comp.get(i, i) for i in range(len(sets))} == want
    assert sum(tested) <= 6 * len(sets)
