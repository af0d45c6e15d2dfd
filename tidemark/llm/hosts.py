"""URL filters by rules and by trust carried over the link graph of hosts.

1. A rule ``host/path`` fits the urls of its host and of all subdomains whose path starts with the rule's path; the
   longest fitting rule decides (of equal ones that with the longer host, then a block).
2. Hosts are joined by the links of their pages (``<a href>`` with a host of its own, outside comments, scripts and
   styles; each pair of hosts once, links inside a host not at all).
3. Personalised PageRank: a host is a trusted seed by the share of its pages that rules allow and a blocked seed by the
   share they block. Trust follows the links and is divided among the hosts linked to; distrust goes against the links,
   to the hosts that link to a blocked one, divided among them. Each step passes on 17/20 of the mass. What a host
   without links holds would return to the seeds, which scales all scores alike; it is left out, so that a host that rules
   block altogether has a distrust of at least one, whatever the number of hosts.
4. A host is blocked where its distrust exceeds its trust by ``threshold`` or more. Pages without a rule take the verdict
   of their host; hosts that no mass reaches are allowed.

Mass is counted in whole hundred-millionths and only what arrived in the last round is passed on, so results do not
depend on the order of sums, and a round works on hosts that still receive something. The number of rounds follows from
``tolerance``: what is left to pass on after them is below that part of the seeds. Each round is one join and one sum by
host, cut by a table in the shared folder.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule, is no node and is allowed;
null, empty and very long pages give whatever links they have; repeated rows count once each in the shares and stay in
the result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_table, sized

UNIT = 10**8
KEEP, OF = 17, 20
THRESHOLD = 0.5
TOLERANCE = 1e-3

#: Parts of a page whose links do not count, and the host of a link; both also hold for RE2.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script[^>]*>|<style\b.*?</style[^>]*>"
LINK = r"(?is)<a[\x20\x09-\x0D](?:[^>]*?[\x20\x09-\x0D\x22\x27])?href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*[\x22\x27]?[\x20\x09-\x0D]*(?:https?:)?//([^/?#\x20\x09-\x0D\x22\x27<>\\]+)"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rounds(tolerance: float = TOLERANCE) -> int:
    return math.ceil(math.log(tolerance) / math.log(KEEP / OF))


def lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url, both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return lower(F.regexp_extract(text, URL, 1)), F.regexp_extract(text, URL, 2)


def _parted(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host, "/" + path


def listed_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """Struct ``(rule, verdict)`` of the rule that decides, null without one; for lists of up to some hundred
    ``(verdict, rule)``, compiled into one expression."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/") if "/" in r[1] else len(r[1]), r[0] == "block")):
        at, start = _parted(rule)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def with_rule_table(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``df (host, path, ...)`` with ``rule`` and ``verdict`` from a table ``rules (verdict, rule)`` of any size.

    Each distinct url looks up its own prefixes: the suffixes of its host that some rule has, with the path cut at the
    lengths that rules of this suffix have. Nothing is compared with all rules of a host.
    """
    table = rules.select("verdict", "rule", F.substring_index("rule", "/", 1).alias("r_host"),
                         F.expr("concat('/', CASE WHEN instr(rule, '/') > 0 THEN substr(rule, instr(rule, '/') + 1) ELSE '' END)").alias("r_path"))
    lengths = table.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))
    urls = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = urls.select("host").distinct().select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("r_host"))
    known = suffixes.join(lengths, "r_host").select("host", "r_host", F.explode("lengths").alias("length"))
    tried = urls.join(known, "host").filter(F.length("path") >= F.col("length")).select("host", "path", "r_host", F.expr("substr(path, 1, length)").alias("r_path"))
    best = F.max(F.struct(F.length("rule"), F.length("r_host"), F.col("verdict") == "block", "rule", "verdict"))
    found = tried.join(table, ["r_host", "r_path"]).groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")
    return df.join(found, ["host", "path"], "left")


def linked_hosts(html: Column) -> Column:
    """Distinct hosts that a page links to."""
    page = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(page, F.lit(LINK), 1), lower))


def propagated(seeds: DataFrame, links: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, trust, distrust`` of all hosts reached, from ``seeds (host, trust, distrust)`` over ``links (a, b)``."""
    edges = shared_table(links.filter("a <> b AND a <> '' AND b <> ''").distinct(), "host-links")
    forth = edges.join(edges.groupBy("a").agg(F.count(F.lit(1)).alias("deg")), "a").select(F.lit(True).alias("good"), F.col("a").alias("host"), F.col("b").alias("to"), "deg")
    back = edges.join(edges.groupBy("b").agg(F.count(F.lit(1)).alias("deg")), "b").select(F.lit(False).alias("good"), F.col("b").alias("host"), F.col("a").alias("to"), "deg")
    steps = shared_table(forth.unionByName(back), "host-steps")
    start = seeds.select(F.lit(True).alias("good"), "host", F.col("trust").alias("mass")).union(seeds.select(F.lit(False), "host", F.col("distrust")))
    new = shared_table(start.filter("mass > 0"), "host-mass")
    total = new
    for _ in range(0 if steps.isEmpty() else rounds(tolerance)):
        passed = new.join(steps, ["good", "host"]).select("good", F.col("to").alias("host"), F.expr(f"mass * {KEEP} div ({OF} * deg)").alias("mass"))
        new = shared_table(passed.filter("mass > 0").groupBy("good", "host").agg(F.sum("mass").alias("mass")), "host-mass")
        if new.isEmpty():
            break
        total = total.unionByName(new)
    part = lambda good: F.coalesce(F.sum(F.when(F.col("good") == good, F.col("mass"))), F.lit(0).cast("long"))
    return total.groupBy("host").agg(part(True).alias("trust"), part(False).alias("distrust"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
           threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page; the last two are its host's, in units."""
    host, path = url_parts(F.col(url_col))
    made = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), linked_hosts(F.col(html_col)).alias("links"))
    if isinstance(rules, DataFrame):
        made = with_rule_table(made, rules).withColumnRenamed("verdict", "said")
    else:
        made = made.withColumn("found", listed_rule(rules, F.col("host"), F.col("path"))).select("*", "found.rule", F.col("found.verdict").alias("said")).drop("found")
    made = shared_table(made, "host-pages")
    share = lambda verdict: F.expr(f"count_if(said = '{verdict}') * {UNIT} div count(*)")
    seeds = made.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    links = made.select(F.col("host").alias("a"), F.explode("links").alias("b"))
    scores = shared_table(propagated(seeds, links, tolerance), "host-scores")
    zero = F.lit(0).cast("long")
    out = made.join(sized(scores), "host", "left").withColumns({c: F.coalesce(c, zero) for c in ("trust", "distrust")})
    bad = F.col("distrust") - F.col("trust") >= math.ceil(threshold * UNIT)
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
