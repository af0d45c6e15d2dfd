"""URL filters: rules, link graph and verdicts against SQL and a plain version."""

import random

import pytest

from tests.llm.helpers import clashing
from tidemark.llm import hosts, sql
from tidemark.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string"


def web(n_hosts=40, n_pages=300, hub=True, seed=3):
    rnd = random.Random(seed)
    names = [f"{rnd.choice(['', 'www.', 'Blog.'])}h{i}.example.{rnd.choice(['net', 'com', 'org'])}" for i in range(n_hosts)]
    rows = []
    for i in range(n_pages):
        host = names[0] if hub and i % 3 == 0 else rnd.choice(names)
        to = [names[0]] * (hub and rnd.random() < 0.5) + [rnd.choice(names) for _ in range(rnd.randrange(4))]
        links = "".join(rnd.choice(['<a href="https://{}/x">t</a>', "<A class=a HREF='//{}'>t</a>", "<a href=http://{}:80?q>t</a>", "<a href=/{}>t</a>", '<!-- <a href="http://{}.hidden/"> -->',
                                    '<script>"<a href=\'http://{}.script/\'>"</script>', '<link href="http://{}.link/">', '<a data-href="http://{}.data/">']).format(h) for h in to)
        rows.append((i, f"{rnd.choice(['http', 'https'])}://{host}/{rnd.choice(['en', 'fr', 'de', 'es'])}/{i}{rnd.choice(['', '?a=/fr/', '#x', '/'])}", f"<p>{links}</p>" * rnd.choice([1, 2])))
    return rows


AWKWARD = [(1000, None, None), (1001, "no scheme.net/", "<a href='http://a.net'>"), (1002, "://", ""), (1003, "x://Net/?a", "text"), (1004, "http://net", "x" * 200_000), (1005, "http://example.net/en/", "<a href='//"),
           (1006, "http://notexample.net/en/a", None), (1007, "http://A.B.ORG/fr/../x#http://net/", "<a href='http://net/'></a>" * 2000), (1007, "http://A.B.ORG/fr/../x#http://net/", "<a href='http://net/'></a>" * 2000),
           (None, "http://é.com/de/x", "<a href='http://net/'>"), (1008, "http://org/fr/", "<a href='https://q.com'><a href='https://é.com'>"), (1009, "http://q.com\nx/de/", "")]


def plain(rows):
    """The same by dictionaries."""
    import re

    parts, said = [], []
    for _, url, _ in rows:
        m = re.search(hosts.URL.replace("(?s)^", "(?s)"), url or "")
        host, path = (hosts.lower and m.group(1).translate({c: c + 32 for c in range(65, 91)}), m.group(2)) if m else ("", "")
        fit = [(len(r), r, v) for v, r in URL_RULES for a, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])] if (host == a or host.endswith("." + a)) and path.startswith(p)]
        parts.append((host, path))
        said.append(max(fit)[1:] if fit else (None, None))
    out, into = {}, {}
    for (host, _), (_, _, html) in zip(parts, rows):
        for b in re.findall(hosts.LINK.replace("(?is)", ""), re.sub(hosts.HIDDEN, " ", html or ""), re.I | re.S):
            b = b.translate({c: c + 32 for c in range(65, 91)})
            if host and b and host != b:
                out.setdefault(host, set()).add(b)
                into.setdefault(b, set()).add(host)
    score = []
    for verdict, graph in (("allow", out), ("block", into)):
        new = {}
        for h in {h for h, _ in parts if h}:
            own = [v for (x, _), (_, v) in zip(parts, said) if x == h]
            new[h] = sum(v == verdict for v in own) * hosts.UNIT // len(own)
        total = dict(new)
        for _ in range(hosts.rounds()):
            nxt = {}
            for h, mass in new.items():
                for b in graph.get(h, ()):
                    nxt[b] = nxt.get(b, 0) + mass * hosts.KEEP // (hosts.OF * len(graph[h]))
            for h, mass in nxt.items():
                total[h] = total.get(h, 0) + mass
            new = nxt
        score.append(total)
    want = []
    for (i, _, _), (host, path), (rule, verdict) in zip(rows, parts, said):
        t, d = (s.get(host, 0) for s in score)
        want.append((i, host, path, rule, verdict or ("block" if d - t >= hosts.UNIT * hosts.THRESHOLD else "allow"), t, d))
    return sorted(want, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("rows", [web(), web(hub=False, seed=9) + AWKWARD, AWKWARD], ids=["hub", "even", "awkward"])
def test_against_plain_version_and_sql(spark, rows):
    import duckdb

    pages = spark.createDataFrame(rows, PAGES)
    want = plain(rows)
    assert got(hosts.judged(pages, URL_RULES)) == want
    if rows is not AWKWARD:
        assert {v for _, _, _, rule, v, _, _ in want if rule is None} == {"allow", "block"}
    con = duckdb.connect()
    frame = pages.toPandas()
    frame["page_id"] = frame["page_id"].astype("Int64")
    con.register("pages", frame)
    assert sorted(con.execute(sql.HOSTS).fetchall(), key=str) == want


def test_rule_table_gives_the_same(spark):
    pages = spark.createDataFrame(web() + AWKWARD, PAGES)
    listed = URL_RULES + [("block", "h1.example.com/en/1"), ("allow", "h1.example.com/en/10"), ("block", "org/"), ("allow", "example.org/"), ("allow", "com")]
    rules = spark.createDataFrame(listed, "verdict string, rule string")
    assert got(hosts.judged(pages, rules)) == got(hosts.judged(pages, listed))


def test_empty_and_clashing(spark):
    assert hosts.judged(spark.createDataFrame([], PAGES), URL_RULES).count() == 0
    pages = spark.createDataFrame(web(n_pages=50), PAGES)
    loud = clashing(pages).withColumns({c: pages["url"] for c in ("host", "path", "rule", "verdict", "trust", "links", "said")})
    assert got(hosts.judged(loud, URL_RULES)) == got(hosts.judged(pages, URL_RULES))
