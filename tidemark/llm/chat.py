"""Chat formatting by schema fingerprints, on built-in functions only.

Records are JSON texts of any layout. The nested field paths of a record (its structure without values and scalar
types) are hashed; the hash selects a declarative ``Layout`` that says where turns, roles and texts are. Records become
canonical turns ``role, text`` and are rendered by a ``Template``: a mark, the role, a line break, the text, an end mark.
Control strings inside texts get a backslash behind their first character (one more if there are some already), which
is taken away again on reading, so any text comes back as it was. The loss mask lists the spans of assistant texts in
the rendered string.

Defined results: null texts and roles are empty; a record whose layout is not known, or that is no JSON, has no turns
and a null layout; an empty conversation renders to an empty string; turns with equal numbers are ordered by role and
text; rows without conversation id form one conversation; an empty table gives an empty result; other columns are
ignored. A conversation becomes one string, so all its turns meet in one row.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import fresh

TURNS = "array<struct<role: string, text: string>>"
#: Texts up to this many bytes always fit a variant, if they are JSON.
LONG = 4 << 20
LONGEST = str(2**31 - 1)


@dataclass(frozen=True)
class Layout:
    """Where a record of this structure keeps its turns: a list of turns, or one field per role in order."""

    name: str
    example: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)


#: Known layouts; more can be given to ``canonical``.
LAYOUTS = (
    Layout("messages", '{"messages": [{"role": "", "content": ""}]}', turns="$.messages"),
    Layout("conversations", '{"conversations": [{"from": "", "value": ""}]}', turns="$.conversations", role="from", text="value",
           roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt", '{"prompt": "", "response": ""}', fields=(("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("completion", '{"prompt": "", "completion": ""}', fields=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("instruction", '{"instruction": "", "input": "", "output": ""}',
           fields=(("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Layout("nested", '{"dialog": {"system": "", "turns": [{"speaker": "", "text": ""}]}}', turns="$.dialog.turns", role="speaker", text="text",
           fields=(("system", "$.dialog.system"),)),
)


def field_paths(variant: Column) -> Column:
    """The structure of a JSON value: its nested field names, without scalar types."""
    return F.regexp_replace(F.schema_of_variant(variant), r": (?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9,]+\))?", "")


def fingerprint(variant: Column) -> Column:
    return F.xxhash64(field_paths(variant))


def _mapped(v: Column, layout: Layout) -> Column:
    parts = [F.array(F.struct(F.lit(role).alias("role"), F.coalesce(F.variant_get(v, path, "string"), F.lit("")).alias("text"))) for role, path in layout.fields]
    if layout.turns:
        kind = f"array<struct<`{layout.role}`: string, `{layout.text}`: string>>"
        name = F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair]) if layout.roles else None
        role = lambda t: F.coalesce(*([name[t[layout.role]]] if name is not None else []), t[layout.role], F.lit(""))
        parts.append(F.transform(F.coalesce(F.variant_get(v, layout.turns, kind), F.array().cast(kind)), lambda t: F.struct(
            role(t).alias("role"), F.coalesce(t[layout.text], F.lit("")).alias("text"))))
    return F.concat(*parts).cast(TURNS)


def _fields(text: Column) -> Column:
    """The fields of a JSON object and their values as texts, however long."""
    return F.from_json(text, "map<string,string>", {"maxStringLen": LONGEST})


def _items(text: Column) -> Column:
    return F.from_json(text, "array<map<string,string>>", {"maxStringLen": LONGEST})


def _has_fields(text: Column, example: dict) -> Column:
    """True where a JSON text has the fields of the example, at every level, and no others."""
    same = lambda m, keys: F.array_sort(F.map_keys(m)) == F.array(*[F.lit(k) for k in sorted(keys)])
    fields = _fields(text)
    fits = same(fields, example)
    for name, value in example.items():
        if isinstance(value, dict):
            fits = fits & _has_fields(fields[name], value)
        elif isinstance(value, list):
            items = _items(fields[name])
            fits = fits & items.isNotNull() & F.forall(items, lambda m: same(m, value[0]))
    return F.coalesce(fits, F.lit(False))


def _mapped_text(text: Column, layout: Layout) -> Column:
    """``_mapped`` straight from the text, for records that no variant can hold."""
    at = lambda path: reduce(lambda c, name: _fields(c)[name], path.split(".")[1:], text)
    parts = [F.array(F.struct(F.lit(role).alias("role"), F.coalesce(at(path), F.lit("")).alias("text"))) for role, path in layout.fields]
    if layout.turns:
        name = F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair]) if layout.roles else None
        role = lambda t: F.coalesce(*([name[t[layout.role]]] if name is not None else []), t[layout.role], F.lit(""))
        turns = F.coalesce(_items(at(layout.turns)), F.array().cast("array<map<string,string>>"))
        parts.append(F.transform(turns, lambda t: F.struct(role(t).alias("role"), F.coalesce(t[layout.text], F.lit("")).alias("text"))))
    return F.concat(*parts).cast(TURNS)


def canonical(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with ``layout`` and canonical ``turns`` instead of the record.

    A variant holds some 16 MB. Longer records are read from their text: the layout whose fields they have, level by
    level, is the one the hash of their paths would select.
    """
    v, f = fresh("variant"), fresh("fingerprint")
    df = df.withColumn(v, F.try_parse_json(record)).withColumn(f, fingerprint(F.col(v)))
    known = [(fingerprint(F.parse_json(F.lit(x.example))), x) for x in layouts]
    # an empty list shows no fields of its elements
    known += [(fingerprint(F.parse_json(F.lit(re.sub(r"\[.*?\]", "[]", x.example)))), x) for x in layouts if x.turns]
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for h, x in reversed(known):
        hit = F.col(f) == h
        name, turns = F.when(hit, F.lit(x.name)).otherwise(name), F.when(hit, _mapped(F.col(v), x)).otherwise(turns)
    long_name, long_turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for x in reversed(layouts):
        hit = _has_fields(F.col(record), json.loads(x.example))
        long_name, long_turns = F.when(hit, F.lit(x.name)).otherwise(long_name), F.when(hit, _mapped_text(F.col(record), x)).otherwise(long_turns)
    unread = F.col(v).isNull() & (F.octet_length(record) > LONG)
    return df.withColumn("layout", F.when(unread, long_name).otherwise(name)).withColumn("turns", F.when(unread, long_turns).otherwise(turns)).drop(v, f, record)


@dataclass(frozen=True)
class Template:
    mark: str = "<|turn|>"
    end: str = "<|end|>\n"
    controls: tuple[str, ...] = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]")

    def escape(self, text: Column) -> Column:
        return reduce(lambda c, s: F.regexp_replace(c, re.escape(s[0]) + r"(\\*)" + re.escape(s[1:]), _literal(s[0]) + r"\\$1" + _literal(s[1:])), self.controls, text)

    def unescape(self, text: Column) -> Column:
        return reduce(lambda c, s: F.regexp_replace(c, re.escape(s[0]) + r"\\(\\*)" + re.escape(s[1:]), _literal(s[0]) + r"$1" + _literal(s[1:])), self.controls, text)


def _literal(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def formatted(df: DataFrame, key: str, template: Template = Template(), learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``key, formatted, loss`` of ``key, turns``; loss: ``start, length`` in characters of each text to learn.

    ``key`` must be unique. Offsets are running sums over a conversation's turns.
    """
    rows = df.select(F.col(key).alias("k"), F.posexplode_outer("turns").alias("pos", "t"))
    rows = rows.select("k", "pos", F.concat(F.lit(template.mark), F.url_encode("t.role"), F.lit("\n")).alias("head"), template.escape(F.col("t.text")).alias("body"),
                       F.col("t.role").isin(*learn).alias("learn"))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(template.end))
    before = F.coalesce(F.sum("size").over(W.partitionBy("k").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", before + F.length("head"))
    made = rows.groupBy("k").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "head", "body", "learn", "start")))).alias("t"))
    return made.select(
        F.col("k").alias(key), F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(template.end))), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["learn"]), lambda t: F.struct(t["start"].cast("long").alias("start"), F.length(t["body"]).alias("length"))).alias("loss"))


def parsed(df: DataFrame, template: Template = Template()) -> DataFrame:
    """``df`` of ``formatted, loss`` with the ``turns`` and the ``loss_text`` read back from them."""
    p = fresh("pieces")
    pieces = F.split("formatted", re.escape(template.end))
    df = df.withColumn(p, F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, len(template.mark) + 1, F.length(p))))
    df = df.withColumn("turns", F.transform(p, lambda p: F.struct(
        F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
        template.unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text"))))
    texts = F.transform("loss", lambda s: template.unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"])))
    return df.withColumn("loss_text", F.array_join(texts, "")).drop(p)


def records_of_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One JSON record per conversation of a table with a row per turn, in the plainest layout its turns fit."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = df.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("content")).alias("m"))
    made = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("m")), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    roles, at = F.array_join(F.transform("messages", lambda m: m["role"]), ","), lambda i: F.get("messages", F.lit(i))["content"]
    return made.select("conv_id", F.when((roles == "user,assistant") & (F.size("messages") == 2), F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))))
                       .when((roles == "system,user,assistant") & (F.size("messages") == 3), F.to_json(F.struct(at(0).alias("instruction"), at(1).alias("input"), at(2).alias("output"))))
                       .otherwise(F.to_json(F.struct("messages"))).alias("record"))
