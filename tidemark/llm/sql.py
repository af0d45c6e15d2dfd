"""SQL of those text queries that SQL can express."""

from tidemark.llm import hosts
from tidemark.llm.licenses import RULES, known_sentences, rule_pattern
from tidemark.llm.quality import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_SPACE = r"[\x20\x09-\x0D]+"

#: Measures and verdicts of the quality rules over the view {docs}.
QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM t),
tri AS (SELECT doc_id, i, list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2) AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + d AS p FROM again, (SELECT unnest([0, 1, 2]) AS d)) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(ln) AS BIGINT) AS n_lines, CAST(len(list_filter(ln, lambda x: length(x) < 20)) AS BIGINT) AS n_short_lines,
             CAST(len(list_filter(w, lambda x: x IN ({_STOP}))) AS BIGINT) AS n_stop_words
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_short_lines, n_stop_words,
       NOT base_failed AND 100 * word_chars >= 200 * n_words AND 100 * word_chars <= 1500 * n_words AND 100 * n_symbols <= 10 * n_words
       AND 100 * n_stop_words >= 6 * n_words AND 100 * n_dup_lines <= 50 * n_lines AND 100 * n_short_lines <= 90 * n_lines AS kept
FROM b
"""

#: Items of which 80 per cent or more of the distinct five-word shingles occur in a document; a shorter text is one shingle.
CONTAINMENT = r"""
WITH t AS (SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents
           UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
w AS (SELECT kind, r, id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t WHERE text IS NOT NULL),
s AS (SELECT DISTINCT kind, r, id, array_to_string(list_slice(w, i, i + 4), ' ') AS k
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s WHERE kind = 'i' GROUP BY r)
SELECT d.id AS doc_id, i.id AS item_id, n.n AS n_item, count(*) AS n_shared
FROM s AS i JOIN s AS d ON i.k = d.k AND i.kind = 'i' AND d.kind = 'd' JOIN n ON n.r = i.r
GROUP BY d.r, d.id, i.r, i.id, n.n HAVING 100 * count(*) >= 80 * n.n
"""



def _licenses() -> str:
    names = ", ".join(f"'{k}': '{v}'" for k, v in known_sentences().items())
    steps = [rf"""
WITH p AS (SELECT row_number() OVER () AS r, doc_id, list_filter(list_transform(regexp_split_to_array(
             regexp_replace(coalesce(text, ''), '([.!?:;])[ \t]+', '\1' || chr(10), 'g'), '[\n\r]+'),
             lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS s FROM documents),
l0 AS (SELECT r, doc_id, array_to_string(list_transform(list_filter(list_transform(s, lambda x: coalesce((MAP {{{names}}})[x], '-')), lambda x: x <> ''),
             lambda x: ';' || x || ';'), '') AS l, array_to_string(list_transform(list_filter(list_transform(s, lambda x: coalesce((MAP {{{names}}})[x], '-')),
             lambda x: x <> ''), lambda x: ';' || x || ';'), '') AS a FROM p)"""]
    counts = []
    for j, (_, sequence) in enumerate(RULES):
        pattern = rule_pattern(sequence)
        steps.append(f"l{j + 1} AS (SELECT * REPLACE (regexp_replace(l, '{pattern}', ';-;', 'g') AS l), len(regexp_extract_all(l, '{pattern}')) AS n{j} FROM l{j})")
        counts.append(f"SELECT r, doc_id, a, '{RULES[j][0]}' AS license, n{j} AS n FROM l{len(RULES)}")
    known = "len(regexp_extract_all({}, ';[A-Za-z0-9]+;'))"
    counts.append(f"SELECT r, doc_id, a, 'UNMATCHED', {known.format('l')} FROM l{len(RULES)}")
    return ",\n".join(steps) + f"""
SELECT doc_id, license, CAST(sum(n) AS BIGINT) AS n_matches, CAST(any_value({known.format('a')}) AS BIGINT) AS n_sentences
FROM ({" UNION ALL ".join(counts)}) GROUP BY r, doc_id, license HAVING sum(n) > 0"""


#: Counts per licence of the matches of ordered rules over sequences of known sentences.
LICENSES = _licenses()

#: Verdicts on urls by rule, else by trust and distrust carried over the links of hosts.
HOSTS = rf"""
WITH RECURSIVE rules(verdict, rule, r_host, r_path) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
                                         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
p AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(url, ''), '{hosts.URL}', 1), '{hosts._UPPER}', '{hosts._LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '{hosts.URL}', 2) AS path, regexp_replace(coalesce(html, ''), '{hosts.HIDDEN}', ' ', 'g') AS html FROM pages),
fit AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS said
        FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY r),
seeds AS (SELECT host, count(*) FILTER (said = 'allow') * {hosts.UNIT} // count(*) AS trust, count(*) FILTER (said = 'block') * {hosts.UNIT} // count(*) AS distrust
          FROM p LEFT JOIN fit USING (r) WHERE host <> '' GROUP BY host),
e AS (SELECT DISTINCT host AS a, b FROM (SELECT host, translate(unnest(regexp_extract_all(html, '{hosts.LINK}', 1)), '{hosts._UPPER}', '{hosts._LOWER}') AS b FROM p)
      WHERE host <> b AND host <> '' AND b <> ''),
steps AS (SELECT true AS good, a AS host, b AS nxt, count(*) OVER (PARTITION BY a) AS deg FROM e
          UNION ALL SELECT false, b, a, count(*) OVER (PARTITION BY b) FROM e),
m AS (SELECT 0 AS k, good, host, mass FROM (SELECT true AS good, host, trust AS mass FROM seeds UNION ALL SELECT false, host, distrust FROM seeds) WHERE mass > 0
      UNION ALL
      SELECT k + 1, good, nxt, CAST(sum(mass * {hosts.KEEP} // ({hosts.OF} * deg)) AS BIGINT) FROM m JOIN steps USING (good, host)
      WHERE k < {hosts.rounds()} AND mass * {hosts.KEEP} // ({hosts.OF} * deg) > 0 GROUP BY k, good, nxt),
score AS (SELECT host, CAST(coalesce(sum(mass) FILTER (good), 0) AS BIGINT) AS trust, CAST(coalesce(sum(mass) FILTER (NOT good), 0) AS BIGINT) AS distrust FROM m GROUP BY host)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) >= {int(hosts.UNIT * hosts.THRESHOLD)} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM p LEFT JOIN fit USING (r) LEFT JOIN score USING (host)
"""

#: Texts cut at two line boundaries, the middle moved to the end.
FILL_MIDDLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
             CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS h4 FROM t),
c AS (SELECT *, array_to_string(list_slice(u, 1, least(c1, c2)), '') AS p, array_to_string(list_slice(u, least(c1, c2) + 1, greatest(c1, c2)), '') AS m,
             array_to_string(list_slice(u, greatest(c1, c2) + 1, n), '') AS s,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""

SQL = {"op1_license_sentences": LICENSES, "op9_benchmark_containment": CONTAINMENT, "op7_quality_rules": QUALITY,
       "op11_host_trust": HOSTS, "op13_fill_middle": FILL_MIDDLE}
