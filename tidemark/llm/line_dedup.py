"""Near-duplicate lines over all documents, on built-in functions only.

1. Equal lines are one class. Every class gets its one-permutation MinHash: of the hashes of its ``K``-character shingles
   the smallest of each of 32 ranges of the hash space (an empty range is a value too).
2. All ranges are banded by three, the last two in a band of their own; a band with a shingle is a bucket key (a pair at
   a Jaccard similarity of 0.8 misses all eleven bands with p < 3e-4, at 0.9 with p < 1e-6; equal sets never do).
3. Buckets of up to ``SMALL`` members: a member stays if the last bits of its 32 minima are close enough to those of another
   (at 0.8 a pair is passed over with p < 1e-5). Sizes and parity sketches of the full shingle sets, which rule out no
   linked pair, are compared within joins on the bucket; pairs that pass are tested on whole lines. First each line and the
   hub most like it, then one pair of any two components, then all pairs that lie in different components. Pairs within a
   component are never written, so tables grow with the lines, not with the square of a bucket. Larger buckets: members are
   tested against a hub, and the differences from the hub lead to all further links (``components.bucket_components``).
4. Star steps join links to components; the first line of a component, by document id and line number, stays.

Lines are exploded three times: for the classes, for the texts of lines to be tested, for the decisions.

Defined results: null and empty texts have no lines to remove; blank lines always stay; a line shorter than ``K`` is its
own single shingle; rows without id come first; rows with equal id are ordered by a hash of their text and identical
rows count as one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, dropped_shuffles, few_tasks, filter_here, let, shared_table, sized
from tidemark.llm.components import bucket_components, components

K, BIN_BITS, BANDS, ROWS = 8, 5, 11, 3
#: Buckets of up to this many members are compared pair by pair within a join (a few operations on numbers, a thousandth of
#: a test on whole lines), larger ones go through hubs and lists of differences.
SMALL = 16_384
#: Most bins in which two lines may differ to be tested: of 32, a similarity of 0.8 leaves more unlike with p < 1e-5.
UNLIKE = 17
MARK_BITS = 5
#: Each member of a bucket first meets so many others of it, its hubs.
HUBS = 16
#: A sketch has so many words of 64 bits.
WORDS = 16


def shingles(line: Column) -> Column:
    """Hashes of the K-character shingles of a line, cut out of fixed-width characters at once."""
    last = F.greatest(F.length(line) - K, F.lit(0))
    return let(F.encode(line, "UTF-32"), lambda wide: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.substring(wide, i * 4 + 1, F.lit(4 * K)))))


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    out = own.select("doc_id", "tie", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.col("line").rlike(WORD))
    return out.withColumn("node", F.unhex(F.md5("line")))


def _unlike(a: Column, b: Column) -> Column:
    """In how many marks two numbers differ."""
    x = a.bitwiseXOR(b)
    any_bit = reduce(Column.bitwiseOR, [F.shiftrightunsigned(x, i) for i in range(1, MARK_BITS)], x)
    return F.bit_count(any_bit.bitwiseAND(F.lit(sum(1 << MARK_BITS * j for j in range(BANDS)))))


def _signed(lines: DataFrame) -> DataFrame:
    """``node, doc_id, tie, line_no, n, keys, mark0..`` of each distinct line: its first place, how often it comes, band
    keys (null where all bins are empty), and the last bits of the smallest hash of each bin (of an empty one: 0), ``mark<i>`` holding bin i of each band.
    Equal lines meet first, so each is signed once; its shingles are rows that never leave the task. An empty bin is null
    and adds nothing to the hash of a band."""
    once = lines.groupBy("node").agg(F.min(F.struct("doc_id", "tie", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("line").alias("line"))
    own = ["node", "doc_id", "tie", "line_no", "n"]
    wide = filter_here(once.select("node", "first.*", "n", F.encode("line", "UTF-32").alias("wide")), F.length("wide") >= 0)  # encoded once a line
    each = wide.select(*own, "wide", F.explode(F.sequence(F.lit(1), F.greatest(F.length("wide") - (4 * K - 1), F.lit(1)), F.lit(4))).alias("at"))
    each = each.select(*own, F.xxhash64(F.substring("wide", F.col("at"), F.lit(4 * K))).alias("h")).withColumn("bin", F.shiftrightunsigned("h", 64 - BIN_BITS).cast("int"))
    each = each.withColumn("band", F.floor(F.col("bin") / ROWS).cast("int"))
    low = [f"low{i}" for i in range(ROWS)]
    parts = each.groupBy(*own, "band").agg(*[F.min(F.when(F.col("bin") == F.col("band") * ROWS + i, F.col("h"))).alias(x) for i, x in enumerate(low)])
    mark = lambda x: F.call_function("shiftleft", F.coalesce(F.col(x), F.lit(0)).bitwiseAND(F.lit((1 << MARK_BITS) - 1)), F.col("band") * MARK_BITS)
    parts = parts.select(*own, "band", F.xxhash64("band", *low).alias("key"), *[mark(x).alias(f"m{i}") for i, x in enumerate(low)])
    rows = parts.groupBy(*own).agg(*[F.max(F.when(F.col("band") == j, F.col("key"))).alias(f"key{j}") for j in range(BANDS)], *[F.bit_or(f"m{i}").alias(f"mark{i}") for i in range(ROWS)])
    return rows.select(*own, F.array(*[f"key{j}" for j in range(BANDS)]).alias("keys"), *[f"mark{i}" for i in range(ROWS)])


def _with_lines(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """``pairs`` with both lines; ``own (id, line)``."""
    return pairs.join(own.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a").join(own.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")


def _sets(made: Callable[[Column, Column], Column]) -> Column:
    """``made`` of the sets of shingles of both lines."""
    return let(F.array_distinct(shingles(F.col("line_a"))), lambda x: let(F.array_distinct(shingles(F.col("line_b"))), lambda y: made(x, y)))


def _tested(pairs: DataFrame, own: DataFrame, least: int) -> DataFrame:
    """``a, b, n, gone, new`` of the ``pairs (a, b)`` with ``least`` per cent or more, by the full sets of whole lines."""
    made = _sets(lambda x, y: F.struct(F.size(y).cast("long").alias("n"), F.array_except(y, x).alias("gone"), F.array_except(x, y).alias("new")))
    rows = _with_lines(pairs, own).select("a", "b", made.alias("s")).select("a", "b", "s.*")
    return filter_here(rows, F.lit(100) * (F.col("n") - F.size("gone")) >= F.lit(least) * (F.col("n") + F.size("new")))


def _linked(percent: int) -> Column:
    return F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("both"))


def _links(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The linked ones of ``pairs (a, b, n_a, n_b)``, the sizes of both sets being known, by the full sets of whole lines."""
    rows = _with_lines(pairs.select("a", "b", "n_a", "n_b"), own)
    rows = rows.select("a", "b", "n_a", "n_b", F.size(F.array_intersect(shingles(F.col("line_a")), shingles(F.col("line_b")))).cast("long").alias("both"))
    return shared_table(filter_here(rows, _linked(percent)).select("a", "b"), "links")


def _sketches(own: DataFrame) -> DataFrame:
    """``id, n, s0..``: the size of the set of shingles of a line, and its parity sketch: a bit is set where an odd number of
    shingles has the hash of its place. Shingles that two lines share cancel out, so two sketches differ in at most as many
    bits as the sets in shingles."""
    each = own.select("id", F.explode(F.array_distinct(shingles(F.col("line")))).alias("h"))
    each = each.select("id", F.col("h").bitwiseAND(F.lit(WORDS - 1)).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 8).bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    out = each.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"), *[F.bit_xor(F.when(F.col("word") == i, F.col("bit"))).alias(f"s{i}") for i in range(WORDS)])
    return out.select("id", "n", *[F.coalesce(f"s{i}", F.lit(0).cast("long")).alias(f"s{i}") for i in range(WORDS)])


def _near(rows: DataFrame, pair: Column, percent: int) -> DataFrame:
    """``a, b, n_a, n_b, differ`` of the pairs within a bucket of ``rows (key, id, n, s0..)``, x and y under the condition
    ``pair``, that may be linked by sizes and sketches; no linked pair is left out. Others end within the join."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(WORDS)])
    n, m = F.col("x.n"), F.col("y.n")
    may = (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (F.lit(100 + percent) * differ <= F.lit(100 - percent) * (n + m))
    rows = rows.alias("x").join(rows.alias("y"), (F.col("x.key") == F.col("y.key")) & pair & may)
    up = F.col("x.id") < F.col("y.id")
    return rows.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.when(up, n).otherwise(m).alias("n_a"), F.when(up, m).otherwise(n).alias("n_b"), differ.alias("differ"))


def _best(pairs: DataFrame, *by: Column) -> DataFrame:
    """Of the pairs of each group the one whose sketches differ least."""
    own = F.struct("differ", "a", "b", "n_a", "n_b")
    return pairs.groupBy(*by).agg(F.min(own).alias("p")).select("p.*").distinct()


def _between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The ``pairs`` whose lines lie in different components, with ``of_a, of_b``."""
    of = lambda x: comp.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    rows = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return rows.withColumns({f"of_{x}": F.coalesce(f"of_{x}", x) for x in "ab"}).filter("of_a <> of_b")


def _components(classes: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """``node, component`` under the links among members of one bucket; ``classes (id, node, keys, mark0..)``."""
    bands = classes.select("id", F.explode("keys").alias("key")).filter("key IS NOT NULL")
    buckets = bands.withColumn("c", F.count(F.lit(1)).over(W.partitionBy("key"))).filter("c > 1")
    buckets = shared_table(buckets, "buckets")
    size = buckets.count()
    few = lambda df: few_tasks(df, size)
    marks = [f"mark{i}" for i in range(ROWS)]
    small = few(buckets.filter(F.col("c") <= SMALL)).join(classes.select("id", *marks), "id").select("id", "key", *marks)
    # members with another one in their bucket that they may be linked with, how many there are and their order in it
    alike = reduce(Column.__add__, [_unlike(F.col(f"x.{m}"), F.col(f"y.{m}")) for m in marks]) <= UNLIKE
    met = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & alike, "left_semi").select("key", "id")
    met = met.withColumns({"c": F.count(F.lit(1)).over(W.partitionBy("key")), "rank": F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("id"), "id"))})
    members = shared_table(few(met), "members")
    large = buckets.filter(F.col("c") > SMALL).select("key", "id")
    # whole texts of the lines to be tested, read once
    ids = members.select("id").unionByName(large.select("id"))
    needed = shared_table(few(ids.distinct()).join(classes.select("id", "node"), "id"), "needed-lines")
    own = lines.select("node", "line").join(sized(needed), "node").groupBy("id").agg(F.first("line").alias("line"))
    own = shared_table(own, "lines")
    sketches = shared_table(_sketches(own), "sketches")
    # pairs with a hub of their bucket; each line is tested with the one most like it
    wide = few(members.join(sketches, "id")).select("key", "rank", *sketches.columns)
    near = _near(wide, (F.col("x.id") < F.col("y.id")) & (F.least("x.rank", "y.rank") <= HUBS), percent)
    near = shared_table(few(few(near).distinct()), "near-lines")
    first = shared_table(_best(near.withColumn("node", F.explode(F.array("a", "b"))), F.col("node")), "tests")
    found = _links(first, own, percent)
    if not large.isEmpty():
        found = found.unionByName(bucket_components(large, lambda pairs, least: _tested(pairs, own, least), percent).select(F.col("node").alias("a"), F.col("component").alias("b")))
    comp = shared_table(components(found), "components")
    # then one pair of any two components
    rest = shared_table(_between(near.join(first, ["a", "b"], "left_anti"), comp), "near-lines")
    second = shared_table(_best(rest, F.least("of_a", "of_b"), F.greatest("of_a", "of_b")), "tests")
    found = found.unionByName(_links(second, own, percent))
    comp = shared_table(components(found), "components")
    # then all that lie in different components, also those without a hub
    rest = _between(rest.join(second, ["a", "b"], "left_anti").drop("of_a", "of_b"), comp)
    of = members.filter(F.col("c") > HUBS + 1).join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("of", F.coalesce("component", "id"))
    mixed = of.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).filter("low <> high").select("key")
    of = shared_table(few(of.join(mixed, "key", "left_semi")).select("key", "id", "rank", "of"), "members")
    wide = few(of.join(sketches, "id")).select("key", "rank", "of", *sketches.columns)
    other = _near(wide, (F.col("x.of") < F.col("y.of")) & (F.least("x.rank", "y.rank") > HUBS), percent)
    done = near.select("a", "b")
    rest = rest.select(*other.columns).unionByName(few(few(other).distinct()).join(done, ["a", "b"], "left_anti").select(*other.columns))
    rest = shared_table(rest, "tests")
    more = _links(rest, own, percent)
    return comp if more.isEmpty() else shared_table(components(found.unionByName(more)), "components")


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``doc_id, tie, line_no`` of the lines that go; ``tie`` is the hash of the row's text."""
    lines = _lines(df, id_col, text_col)
    with dropped_shuffles(df.sparkSession):
        classes = shared_table(_signed(lines).withColumn("id", F.monotonically_increasing_id()), "line-classes")
        comp = _components(classes, lines, percent)
    of = classes.select("id", "node", F.struct("doc_id", "tie", "line_no").alias("first"), "n").join(comp.withColumnRenamed("node", "id"), "id", "left")
    stays = of.filter("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("stay"))
    label = of.filter("n > 1 OR component IS NOT NULL").join(stays, "component", "left").select("node", F.coalesce("stay", "first").alias("stay"))
    return lines.drop("line").join(label, "node").filter(F.struct("doc_id", "tie", "line_no") != F.col("stay")).select("doc_id", "tie", "line_no").distinct()


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, with_text: bool = True) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` (line numbers from 0) and, on demand, the ``text`` of the lines that stay."""
    gone = removed_lines(df, id_col, text_col, percent).groupBy(F.col("doc_id").alias("i"), F.col("tie").alias("t")).agg(F.sort_array(F.collect_list("line_no")).alias("removed"))
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    own = own.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))
    if not with_text:
        own = own.drop("text")
    out = own.join(gone, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")), "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    out = out.withColumn("n_removed", F.size("removed").cast("long"))
    if with_text:
        out = out.withColumn("text", F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("removed"), i)), "\n"))
    return out.select("doc_id", "n_lines", "n_removed", "removed", *(["text"] if with_text else []))
