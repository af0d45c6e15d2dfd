"""Quality rules, license scans, decontamination and mixing."""

import os
import textwrap

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.llm.helpers import awkward, clashing, empty, shingles
from tidemark.llm import decontam, licenses, mixing, quality

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are absent")


@given
@pytest.mark.parametrize("name", ["op1_license_sentences", "op7_quality_rules", "op9_benchmark_containment"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    assert set(got.columns) == set(want.columns)
    assert sorted(map(tuple, got[list(want.columns)].values.tolist())) == sorted(map(tuple, want.values.tolist())) and len(want)


def test_quality_awkward(spark):
    df = clashing(awkward(spark))
    got = {r.doc_id: r for r in quality.measure(df).collect()}
    assert got[0].n_words == 0 and got[0].base_failed and not got[2].kept and got[3].kept and not got[10].kept
    assert got[8].n_dup_lines == 1 and got[8].n_words == 10 and got[8].n_repeat_words == 10
    left = quality.keep(df)
    assert left.columns == df.columns and left.count() == quality.measure(df).filter("kept").count()
    assert quality.keep(empty(spark)).count() == 0
    plan = quality.measure(df)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_quality_thresholds(spark):
    words = "the of and to in is it that for with".split()
    good = " ".join(words[i % 10] + ("" if i % 3 else str(i)) for i in range(90))
    rows = [(1, good), (2, good.replace(" ", " # ")), (3, " ".join(f"zz{i}" for i in range(90))), (4, " ".join("q" * 40 + str(i) for i in range(60)) + " the" * 9), (5, ("same line of the text\n" * 30)),
            (6, "the of and " * 40)]
    got = {r.doc_id: r.kept for r in quality.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_licenses(spark):
    mit = licenses.SENTENCES["MitGrant"] + "\n" + licenses.SENTENCES["MitNotice"]
    rows = [(1, "Some code.\nLicensed under the Apache License, Version 2.0.\nMore."), (2, mit), (3, "released UNDER the  mit license! Released under the MIT License."), (4, None), (5, ""),
            (6, licenses.SENTENCES["BsdRetain"] + " " + licenses.SENTENCES["BsdBinary"] + "\n" + licenses.SENTENCES["BsdEndorse"]), (7, licenses.SENTENCES["BsdRetain"] + "\nOther words here.\n" + licenses.SENTENCES["BsdBinary"]),
            (8, "\n".join(licenses.SENTENCES[x] for x in ("ApacheGrantYou", "ApacheCopy", "ApacheAsIs", "ApacheSee"))), (9, "Licensed under CC BY-NC 4.0. All rights reserved."), (9, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS license", "doc_id AS r")
    got = sorted((r.doc_id, r.license, r.n_matches) for r in licenses.scan(df).collect())
    assert got == [(1, "Apache-2.0", 1), (2, "MIT", 1), (3, "MIT", 2), (6, "BSD-3-Clause", 1), (7, "UNMATCHED", 2), (8, "Apache-2.0", 1), (9, "All-Rights-Reserved", 1), (9, "CC-BY-NC-4.0", 1),
                   (9, "CC-BY-NC-4.0", 1)]
    assert licenses.scan(empty(spark)).count() == 0


def wrapped(names, width, mark="", numbers=False):
    lines = []
    for i, name in enumerate(names.split()):
        lines += textwrap.wrap((f"{i + 1}. " if numbers else "") + licenses.SENTENCES[name], width, subsequent_indent="   " if numbers else "") + [""]
    return "\n".join((mark + x).rstrip() for x in lines)


def test_wrapped_licenses(spark):
    apache = "\n".join([
        "/*", " * Copyright 2020 A. Body", " *", ' * Licensed under the Apache License, Version 2.0 (the "License");', " * you may not use this file except in compliance with the License.",
        " * You may obtain a copy of the License at", " *", " *     http://www.apache.org/licenses/LICENSE-2.0", " *", " * Unless required by applicable law or agreed to in writing, software",
        ' * distributed under the License is distributed on an "AS IS" BASIS,', " * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        " * See the License for the specific language governing permissions and", " * limitations under the License.", " */", "package a;"])
    gpl, mit, bsd = "GplFree GplUseful GplSee", "MitGrant MitNotice", "BsdRetain BsdBinary BsdEndorse"
    made = [("Apache-2.0", 4, apache), ("Apache-2.0", 4, apache.replace("\n", "\r\n"))]
    for width in (40, 70, 80):
        for mark in ("", "# ", " * ", "// "):
            made += [("MIT", 2, "Copyright (c) 2020 A. Body\n\n" + wrapped(mit, width, mark)), ("GPL-3.0-or-later", 3, wrapped(gpl, width, mark) + "\nint a;"),
                     ("BSD-3-Clause", 3, wrapped(bsd, width, mark, True)), ("BSD-2-Clause", 2, wrapped("BsdRetain BsdBinary", width, mark))]
    made += [("All-Rights-Reserved", 1, "Copyright 2020 A. Body\nAll rights reserved.\nmore"), ("Apache-2.0", 1, "Licensed under the\nApache License, Version\n2.0.")]
    made += [("CC-BY-4.0", 1, "Notes\n1. Licensed under\n   CC BY 4.0.\n2. More")]
    made += [("GPL-3.0", 2, "This work is licensed under the GNU General Public License, version\n3. " + licenses.SENTENCES["MitNotice"])]
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(made)] + [(900, "not\n" + wrapped("MitNotice", 70).replace("The", "the other")), (901, "All rights\nare reserved.")], "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.n_matches, r.n_sentences) for r in licenses.scan(df).collect())
    assert got == sorted([(i, name, 1, n) for i, (name, n, _) in enumerate(made)] + [(len(made) - 1, "UNMATCHED", 1, 2)])


def test_whole_sentences_of_gnu_licenses(spark):
    free = "This {} is free software{} you can redistribute it and/or modify\nit under the terms of the GNU {} Public License as published by\nthe Free Software Foundation{}"
    later = "either version {} of the License, or\n(at your option) any later version."
    useful = "\n\nThis {} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU {} Public License for more details.\n"
    made = [("program", ":", "General", ", " + later.format(3), "GPL-3.0-or-later"), ("program", ";", "General", "; " + later.format(2), "GPL-2.0-or-later"), ("program", ";", "General", "; version 2 of the License.", "GPL-2.0-only"),
            ("program", ":", "General", ", version 3 of the License.", "GPL-3.0-only"), ("library", ";", "Library General", "; " + later.format(2), "LGPL-2.0-or-later"),
            ("library", ";", "Lesser General", "; " + later.format("2.1"), "LGPL-2.1-or-later"), ("program", ":", "Lesser General", ", " + later.format(3), "LGPL-3.0-or-later"),
            ("program", ":", "Affero General", ", " + later.format(3), "AGPL-3.0-or-later")]
    rows = [(i, free.format(a, b, c, d) + useful.format(a, c)) for i, (a, b, c, d, _) in enumerate(made)]
    parts = ["This program is free software: you may look at it.", "This program is free software; ask us.", 'Licensed under the Apache License, Version 2.0 (the "License"); no more is granted.']
    rows += [(900 + i, t) for i, t in enumerate(parts)]
    got = sorted((r.doc_id, r.license, r.n_matches, r.n_sentences) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(i, m[4], 1, 3) for i, m in enumerate(made)]


def test_containment_against_brute_force(spark):
    import random

    rnd = random.Random(9)
    items = [" ".join(f"i{i}x{j}" for j in range(n)) for i, n in enumerate([1, 3, 5, 6, 9, 14, 25, 40, 57])] + ["", None, "the same item text for two rows now", "the same item text for two rows now"]
    docs = []
    for d in range(120):
        body = [f"b{rnd.randrange(500)}" for _ in range(rnd.randrange(0, 900))]
        item = (rnd.choice(items) or "").split()
        for _ in range(rnd.choice((0, 0, 1, 2, 4))):
            if item:
                item[rnd.randrange(len(item))] = "changed"
        at = rnd.randrange(len(body) + 1)
        docs.append((d, " ".join(body[:at] + [w.upper() if rnd.random() < 0.3 else w for w in item] + body[at:])))
    docs += [(200, items[0]), (201, items[1]), (202, None), (202, None)]
    rows = [(0 if i > 10 else i, t) for i, t in enumerate(items)]
    want = sorted((d, i, len(y), len(shingles(t, 5) & y)) for d, t in docs for i, t2 in set(rows) for y in [shingles(t2, 5)] if y and 100 * len(shingles(t, 5) & y) >= 80 * len(y))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")
    assert sorted(map(tuple, decontam.contained(df, bench).collect())) == want and len(want) > 20
    left = decontam.drop_contaminated(clashing(df), bench)
    assert left.columns == clashing(df).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if d not in {w[0] for w in want})


def test_containment_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "item_blocks", lambda items, a, b: ([(r[0], r[1] or "")] for r in items.select(a, b).collect()))
    df = awkward(spark)
    bench = spark.createDataFrame([(1, "Is the of and to in it that"), (2, "nothing like this is there at all")], "item_id long, text string")
    assert {r.doc_id for r in decontam.contained(df, bench).collect()} == {None, 3, 4, 5}
    assert decontam.drop_contaminated(df, bench.limit(0)).count() == df.count()


def water(sizes, weights, share=1.5, most=2.0):
    total, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = (total - sum(out.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > most * sizes[s]}
        if not full:
            return out | {s: weights[s] * level for s in open_}
        out |= {s: most * sizes[s] for s in full}
        open_ -= full
    return out


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"s{int(rng.integers(0, 7)) if i % 3 else 0}", int(rng.integers(0, 60))) for i in range(3000)]
    units = spark.createDataFrame(rows, "doc_id long, source string, size long")
    plan = mixing.targets(units)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))})
    got = {r.source: r.target for r in plan.collect()}
    assert all(abs(got[s] - want[s]) < 1e-6 * want[s] for s in want)
    first = {r.doc_id: r for r in mixing.mix(units, plan, group=50).collect()}
    again = {r.doc_id: r for r in mixing.mix(units.repartition(7), plan, group=50).collect()}
    assert first == again and len(first) == len(rows)
    for s in sizes:
        taken = sum(r.size * r.copies for r in first.values() if r.source == s)
        assert abs(taken - want[s]) <= 60 and all(r.copies <= 2 for r in first.values())


def test_mix_awkward(spark):
    df = clashing(awkward(spark))
    mixed = mixing.mixed(df)
    got = mixed.collect()
    assert len(got) == 14 and all(0 <= r.copies <= 2 for r in got)  # the repeated row is one document
    taken = mixing.apply_mix(df, mixed)
    assert taken.columns == df.columns
    rows = {(r.source, r.doc_id): r.copies for r in got}
    assert taken.count() == sum(c * (2 if k == (None, 4) else 1) for k, c in rows.items())
    assert mixing.mixed(empty(spark)).count() == 0 and mixing.apply_mix(empty(spark), mixing.mixed(empty(spark))).count() == 0


def test_mix_source_without_words(spark):
    rows = [(1, None, "empty"), (2, " \n", "empty"), (3, "a b c", "words"), (4, "d e", "words"), (5, "f", None)]
    got = {r.doc_id: r for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == 5 and got[1].target == got[2].target == 0 and got[1].copies == got[2].copies == 0
    assert all(got[i].copies in (0, 1, 2) for i in (3, 4, 5)) and sum(got[i].copies * got[i].size for i in (3, 4)) > 0
    only = mixing.mixed(spark.createDataFrame(rows[:2], "doc_id long, text string, source string")).collect()
    assert [r.copies for r in only] == [0, 0]
