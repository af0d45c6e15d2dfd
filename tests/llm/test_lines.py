import os
import random
import time

from tests.llm.helpers import awkward, clashing, empty, sentence
from tidemark.llm import line_dedup


def brute(rows, percent=80, k=8):
    first = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\r\x0b\x0c"):
                first.setdefault(line, (d, i))
    lines = sorted(first, key=first.get)
    sets = {x: {x[i:i + k] for i in range(max(1, len(x) - k + 1))} for x in lines}
    up = {x: x for x in lines}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y, key=first.get)] = min(x, y, key=first.get)
    return {d: [i for i, x in enumerate((t or "").split("\n")) if x in first and first[find(x)] != (d, i)] for d, t in rows}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    base = [sentence(rnd, 40, 10**6) for _ in range(3)]
    rows = []
    for d in range(50):
        lines = []
        for _ in range(4):
            w = rnd.choice(base).split()
            for _ in range(rnd.randrange(0, 6)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            lines.append(" ".join(w) if rnd.random() < 0.7 else rnd.choice(("", " ", "short", "abc", sentence(rnd, 9, 10**6))))
        rows.append((d, "\n".join(lines)))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    missed = sum(list(r.removed) != want[r.doc_id] for r in got)
    assert missed == 0
    texts = dict(rows)
    for r in got:
        assert r.text == "\n".join(x for i, x in enumerate(texts[r.doc_id].split("\n")) if i not in r.removed) and r.n_removed == len(r.removed)


def test_every_bin_is_in_a_band(spark):
    """Lines of one repeated sign have a single shingle, which may lie in any bin; a full stop adds one shingle of five."""
    rnd = random.Random(8)
    lines = [c * n for c in "!=-*_.~#\u2014\u2501\u2026" for n in (9, 12, 30)]
    for _ in range(400):
        line = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(11))
        lines += [line, line + "."]
    rows = list(enumerate(lines))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()
    want = brute(rows)
    assert [r.doc_id for r in got if list(r.removed) != want[r.doc_id]] == [] and len(got) == len(rows)


def test_awkward_rows(spark):
    df = clashing(awkward(spark))
    got = line_dedup.dedup_lines(df, with_text=False).collect()
    assert len(got) == df.count() and line_dedup.dedup_lines(empty(spark)).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[0].n_removed == by[1].n_removed == by[2].n_removed == 0 and list(by[8].removed) == [1] and list(by[11].removed) == [0]
    assert by[6].n_removed == 0 and by[7].n_removed == 150 and by[3].n_removed == 1  # the row without id is first


def test_only_built_in_functions(spark):
    plan = line_dedup.dedup_lines(awkward(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_written_tables_stay_below_the_text(spark, monkeypatch):
    """Unlike lines with a phrase in common share buckets; no list of their differences is written."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    phrase = " ".join(word() for _ in range(20))
    rows = [(i, " ".join([phrase, *(word() for _ in range(30))])) for i in range(600)]
    monkeypatch.setattr(line_dedup, "bucket_components", None)  # hub tests write lists of differences
    folder = spark.conf.get("spark.checkpoint.dir")
    used = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = used()
    got = line_dedup.dedup_lines(df, with_text=False).collect()
    assert len(got) == 600 and not any(r.n_removed for r in got)
    assert used() - before < 3 * sum(len(t) for _, t in rows)


def test_small_and_large_buckets_agree(spark, monkeypatch):
    """Families of edited copies: pairs by marks, hubs, and both beside each other give the links of brute force."""
    rnd = random.Random(6)
    rows = []
    for f in range(6):
        base = sentence(rnd, 50, 10**6).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randrange(0, 9)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), brute(rows)
    for small in (line_dedup.SMALL, 5, 1):
        monkeypatch.setattr(line_dedup, "SMALL", small)
        assert {r.doc_id: list(r.removed) for r in line_dedup.dedup_lines(df, with_text=False).collect()} == want


def family(rnd, copies, words=50, edits=9):
    base = sentence(rnd, words, 10**6).split()
    for _ in range(copies):
        w = list(base)
        for _ in range(rnd.randrange(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        yield " ".join(w)


def test_pairs_left_by_the_hubs_are_found(spark, monkeypatch):
    """With one or two hubs to a bucket most links are met later; parts of lines that come twice count once."""
    rnd = random.Random(12)
    lines = [x for _ in range(4) for x in family(rnd, 14)]
    for _ in range(6):
        half = sentence(rnd, 14, 10**6)
        lines += [f"{half} {x} {half}" for x in family(rnd, 5, 4, 3)]
    rows = list(enumerate(lines))
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), brute(rows)
    for hubs, words in ((1, 1), (2, 8), (line_dedup.HUBS, 1)):
        monkeypatch.setattr(line_dedup, "HUBS", hubs)
        monkeypatch.setattr(line_dedup, "WORDS", words)
        assert {r.doc_id: list(r.removed) for r in line_dedup.dedup_lines(df, with_text=False).collect()} == want


def test_tables_grow_with_the_lines_of_a_family(spark, monkeypatch):
    """Near copies of one line share buckets; their pairs, 45,000 of 300 lines, are not written."""
    rows = list(enumerate(family(random.Random(9), 300)))
    kept, counts = line_dedup.shared_table, {}

    def counted(df, name):
        out = kept(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(line_dedup, "shared_table", counted)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False)
    assert {r.doc_id: list(r.removed) for r in got.collect()} == brute(rows)
    assert max(counts.values()) <= 20 * len(rows), counts


def test_shuffle_files_go_with_their_step(spark):
    """Only the last job, which the caller runs, leaves shuffle files; the session's setting is as before."""
    jvm = spark._jvm

    def files():
        found = jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())
        return {f.getName() for f in found if f.getName().startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    df = spark.createDataFrame(list(enumerate(family(random.Random(2), 30))), "doc_id long, text string")
    before, was = files(), spark.conf.get(key)
    out = line_dedup.dedup_lines(df, with_text=False)
    for _ in range(20):  # they go in the background
        if left := files() - before:
            time.sleep(0.5)
    assert not left and spark.conf.get(key) == was
    assert out.count() == out.count() == 30
