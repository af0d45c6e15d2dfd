"""Quality rules: a threshold table compiled into one projection of built-in functions.

Each rule bounds an integer measure, or the ratio of two of them in per cent. Ratios are compared by integer
products, so results do not depend on floating point. Nothing is shuffled: every measure belongs to one row.

Defined results: a null or blank text has no words and fails; ties and repeated rows are judged one by one; an empty
table gives an empty result; columns other than the id and the text are ignored by ``measure`` and kept by ``keep``,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, filter_here, fresh, let, words

#: Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in is it that for with as on be at by this from are was or an a "
    "le la les de des du et un une en que qui dans pour par sur est au avec pas elle il ne ce "
    "der die das und den von zu mit sich auf für ist im nicht ein eine als auch es dem "
    "el los las y del se con su al lo para como más no una"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; with ``per`` the bounds are per cent of that measure."""

    measure: str
    low: int | None = None
    high: int | None = None
    per: str | None = None


#: Base rules: too short, or mostly made of repeated phrases.
BASE = (Rule("n_words", low=50), Rule("n_repeat_words", high=50, per="n_words"))
#: The threshold table: length, symbol, stop-word and line ratios.
RULES = (
    Rule("word_chars", low=200, high=1500, per="n_words"),  # mean word length 2 to 15
    Rule("n_symbols", high=10, per="n_words"),
    Rule("n_stop_words", low=6, per="n_words"),
    Rule("n_dup_lines", high=50, per="n_lines"),
    Rule("n_short_lines", high=90, per="n_lines"),
)


def _passes(rules: tuple[Rule, ...]) -> Column:
    ok = F.lit(True)
    for r in rules:
        value = F.col(r.measure) * (100 if r.per else 1)
        scale = F.col(r.per) if r.per else F.lit(1)
        if r.low is not None:
            ok = ok & (value >= F.lit(r.low) * scale)
        if r.high is not None:
            ok = ok & (value <= F.lit(r.high) * scale)
    return ok


def _count(array: Column) -> Column:
    return F.size(array).cast("long")


def _covered(triples: Column) -> Column:
    """Words in three-word windows that occur twice or more, by sorting the windows of one text."""
    ordered = F.array_sort(F.transform(triples, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

    def starts(a: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(a, j)["t"] == x["t"], F.lit(False))
        twice = F.filter(a, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def spread(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x)

    return let(let(ordered, starts), spread).cast("long")


def _measures(text: Column) -> Column:
    """All measures of a text as one struct."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def triples(w: Column) -> Column:
        return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(
            F.array().cast("array<string>"))

    def repeated(w: Column) -> Column:
        return let(triples(w), lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(_covered(t)))

    return let(words(text), lambda w: let(lines, lambda ln: F.struct(
        _count(w).alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (_count(ln) - _count(F.array_distinct(ln))).alias("n_dup_lines"),
        repeated(w).alias("n_repeat_words"),
        _count(ln).alias("n_lines"),
        _count(F.filter(ln, lambda x: F.length(x) < 20)).alias("n_short_lines"),
        _count(F.filter(w, lambda x: x.isin(STOP_WORDS))).alias("n_stop_words"))))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_short_lines", "n_stop_words")


def with_measures(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with a column per measure."""
    m = fresh("measures")
    out = df.withColumn(m, _measures(F.coalesce(text, F.lit(""))))
    return out.withColumns({name: F.col(m)[name] for name in MEASURES}).drop(m)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Id, measures, ``base_failed`` and ``kept`` of every row."""
    t = fresh("text")
    out = with_measures(df.select(F.col(id_col), F.col(text_col).alias(t)), F.col(t)).drop(t)
    return out.withColumn("base_failed", ~_passes(base)).withColumn("kept", ~F.col("base_failed") & _passes(rules))


def keep(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """The rows of ``df`` that pass, with all their columns."""
    row = fresh("row")
    boxed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row))
    out = filter_here(with_measures(boxed, F.col(row)[text_col]), _passes(base) & _passes(rules))
    return out.select(f"{row}.*")
