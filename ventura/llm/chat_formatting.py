"""Chat formatting: schema fingerprints select declarative mappings into canonical turns.

A record's nested field paths, restricted to those a layout knows, are sorted and hashed (SHA-256). A layout lists the
path sets it accepts; the first layout, in the order of LAYOUTS, that accepts the record's hash gives the mapping. For a
typed table the paths come from the DataFrame's schema when the plan is built; for records in a JSON column they are
read from each record itself by Spark's variant functions, over all elements of its lists. An empty list has the path
``a[]``, one of plain values ``a[]:``, an empty object ``a{}``; a layout whose list is empty is accepted and gives no turns
but that of its ``system`` field. Everything is DataFrame functions.

Rendered form of a turn: ``<|start|>role<|text|>text<|end|>``. Inside role and text a backslash is doubled and each
control string of LITERALS gets a backslash after its first character, so no text can end or open a turn, and
``unescape`` restores it exactly.

Defined cases: null text or role counts as empty; a null conversation id is a conversation of its own; equal turn
numbers are ordered by role, then text, and repeated rows stay; an empty table gives an empty result; further columns
are ignored whatever their names are; a record no layout accepts gives layout null and no turns (``layouts`` shows it).
A conversation is one output row, as its digest and its rendered text need it whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventura.llm.common import table

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: Control strings of this template and of other public chat templates (fixed values).
LITERALS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths (``a.b``, ``a[].b``) that must and that may be there, and the mapping of a record to its turns."""

    name: str
    required: tuple[str, ...]
    turns: Callable[[Callable[[str, str], Column]], Column] | None
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def paths(self) -> tuple[str, ...]:
        return tuple(sorted({*self.required, *self.optional}))

    def accepted(self) -> list[str]:
        """Fingerprints of all path sets the mapping can read."""
        more = sorted(self.optional)
        beside = [c for k in range(len(more) + 1) for c in combinations(more, k)]
        return [fingerprint({*base, *c}) for base in (self.required, self.lists) if base for c in beside]

    @property
    def lists(self) -> set[str]:
        """What the paths are if the lists that the layout reads are empty; nothing for a layout without lists."""
        return {p.split("[]")[0] + "[]" for p in self.required if "[]" in p}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _pairs(*parts: tuple[str, Column]) -> Column:
    """Turns of the parts that aren't null."""
    made = F.array(*(F.struct(F.lit(role).alias("role"), text.alias("text")) for role, text in parts))
    return F.filter(made, lambda t: t["text"].isNotNull())


def _instruction(get) -> Column:
    ask, more = get("instruction", "string"), get("input", "string")
    return _pairs(("system", get("system", "string")), ("user", F.when(F.coalesce(more, F.lit("")) != "", F.concat(ask, F.lit("\n"), more)).otherwise(ask)), ("assistant", get("output", "string")))


def _renamed(old: str, new: str):
    return lambda t: F.struct(F.when(t["role"] == old, F.lit(new)).otherwise(t["role"]).alias("role"), t["text"].alias("text"))


def _said(value: Column) -> Column:
    """Text of a turn: a plain value, or a list of parts whose texts are joined; parts without text, such as images, say nothing."""
    parts = F.try_variant_get(value, "$", "array<variant>")
    part = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(~F.schema_of_variant(p).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(p, "$", "string")))
    return F.when(parts.isNotNull(), F.array_join(F.transform(parts, part), "")).otherwise(F.try_variant_get(value, "$", "string"))


def _list_of(path: str, role: str, text: str):
    def turns(get) -> Column:
        listed = F.transform(get(path, f"array<struct<{role}:string,{text}:variant>>"), lambda t: F.struct(t[role].alias("role"), _said(t[text]).alias("text")))
        return F.concat(_pairs(("system", get("system", "string"))), listed)

    return turns


SHARE_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Rows that hold one turn each carry no list; ``turn_rows`` reads them.
LAYOUTS = (
    Layout("turn_rows", ("conv_id", "role", "text", "turn"), None),
    Layout("messages", ("messages[].content", "messages[].role"), _list_of("messages", "role", "content"), ("system",)),
    Layout("from_value", ("conversations[].from", "conversations[].value"), _list_of("conversations", "from", "value"), ("system",), SHARE_ROLES),
    Layout("instruction", ("instruction", "output"), _instruction, ("input", "system")),
    Layout("prompt_response", ("prompt", "response"), lambda get: _pairs(("system", get("system", "string")), ("user", get("prompt", "string")), ("assistant", get("response", "string"))), ("system",)),
    Layout("prompt_completion", ("completion", "prompt"), lambda get: _pairs(("user", get("prompt", "string")), ("assistant", get("completion", "string")))),
    Layout("question_answer", ("answer", "question"), lambda get: _pairs(("user", get("question", "string")), ("assistant", get("answer", "string")))),
)


def schema_paths(schema: T.StructType, prefix: str = "") -> set[str]:
    """Nested field paths of a schema; leaves only."""
    found: set[str] = set()
    for f in schema.fields:
        at, kind = prefix + f.name, f.dataType
        while isinstance(kind, T.ArrayType):
            at, kind = f"{at}[]", kind.elementType
        found |= schema_paths(kind, f"{at}.") if isinstance(kind, T.StructType) else {at}
    return found


def record_paths(record: Column) -> Column:
    """Distinct field paths of a variant record: ``a``, ``a.b``, ``a[].b``, and as above for what is empty or a list without objects; null if it is no object."""
    fields = lambda v: F.try_variant_get(v, "$", "map<string,variant>")

    def below(entry: Column) -> Column:
        key, items, inner = entry["key"], F.try_variant_get(entry["value"], "$", "array<variant>"), fields(entry["value"])
        of_items = F.array_distinct(F.flatten(F.transform(items, lambda x: F.coalesce(F.map_keys(fields(x)), F.array().cast("array<string>")))))
        listed = F.when(F.size(of_items) > 0, F.transform(of_items, lambda k: F.concat(key, F.lit("[]."), k))).otherwise(F.array(F.concat(key, F.when(F.size(items) > 0, "[]:").otherwise("[]"))))
        nested = F.when(F.size(F.map_keys(inner)) > 0, F.transform(F.map_keys(inner), lambda k: F.concat(key, F.lit("."), k))).otherwise(F.array(F.concat(key, F.lit("{}"))))
        return F.when(items.isNotNull(), listed).when(inner.isNotNull(), nested).otherwise(F.array(key))

    return F.flatten(F.transform(F.map_entries(fields(record)), below))


def layout_of(paths: Column) -> Column:
    """Name of the first layout that accepts the fingerprint of a record's paths, else null."""
    out = F.lit(None).cast("string")
    for layout in reversed([x for x in LAYOUTS if x.turns is not None]):
        known = F.array(*map(F.lit, sorted({*layout.paths, *layout.lists})))
        own = F.array_sort(F.array_intersect(paths, known))
        out = F.when(F.sha2(F.array_join(own, "\n"), 256).isin(layout.accepted()), F.lit(layout.name)).otherwise(out)
    return out


def record_turns(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Turn rows (conv_id, turn, role, text, layout) of JSON records in any layout of LAYOUTS."""
    rows = df.select(F.col(id_col).alias("conv_id"), F.try_parse_json(F.col(json_col)).alias("record"))
    rows = rows.withColumn("paths", record_paths(F.col("record"))).withColumn("layout", layout_of(F.col("paths")))

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get(F.col("record"), f"$.{path}", kind)

    turns = F.lit(None).cast(TURN)
    for layout in [x for x in LAYOUTS if x.turns is not None]:
        made = layout.turns(get)
        for old, new in layout.roles.items():
            made = F.transform(made, _renamed(old, new))
        turns = F.when(F.col("layout") == layout.name, made.cast(TURN)).otherwise(turns)
    return rows.select("conv_id", "layout", F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text", "layout")


def layouts(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """conv_id and the chosen layout of each record, null where no mapping fits."""
    rows = df.select(F.col(id_col).alias("conv_id"), record_paths(F.try_parse_json(F.col(json_col))).alias("paths"))
    return rows.select("conv_id", layout_of(F.col("paths")).alias("layout"))


def table_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turn rows of a typed table; its schema's fingerprint selects the mapping when the plan is built."""
    paths = schema_paths(df.schema)
    for layout in LAYOUTS:
        if fingerprint(paths & set(layout.paths)) not in layout.accepted():
            continue
        if layout.turns is None:
            return df.select("conv_id", "turn", "role", "text", F.lit(layout.name).alias("layout"))
        record = F.struct(*sorted({p.split(".")[0].split("[")[0] for p in paths & set(layout.paths)}))
        return record_turns(df.select(F.col(id_col).alias("conv_id"), F.to_json(record).alias("record")), "conv_id", "record")
    raise ValueError(f"no layout reads the fields {sorted(paths)}")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for s in LITERALS:
        out = F.replace(out, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def render(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted text and the loss mask as spans of code points (from 1).

    A span also tells its turn (from 0) and its start within it, so that no reader has to count from the text's beginning. Offsets are running sums over a conversation's rows; window and grouping share one shuffle on conv_id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.concat(F.lit(START), escape(role), F.lit(TEXT)).alias("head"), escape(text).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("head") + F.length("body") + F.lit(len(END))
    rows = rows.select("conv_id", "role", "head", "body", F.row_number().over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("at"), F.sum(size.cast("long")).over(order).alias("upto"))
    start, within = F.col("upto") - len(END) - F.length("body") + 1, F.length("head") + 1
    span = F.when(F.col("role") == "assistant", F.struct(start.cast("int").alias("start"), F.length("body").alias("length"), (F.col("at") - 1).cast("int").alias("turn"), within.alias("within")))
    piece = F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    return whole.select(
        "conv_id",
        F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        F.filter(F.col("pieces.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """Turns of a rendered text: array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(F.substring(p, len(START) + 1, 2**31 - 1), TEXT, 1)).alias("role"), unescape(F.substring_index(p, TEXT, -1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, in time linear in the text: it is split into turns once and each span read in its own."""
    of = lambda turns: F.transform(spans, lambda s: unescape(F.substring(F.get(turns, s["turn"]), s["within"], s["length"])))
    # a bound array, as a lambda would split the text again for every span
    return F.array_join(F.get(F.transform(F.array(F.split(formatted, r"<\|end\|>")), of), F.lit(0)), "")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the control conversation -1, formatted, and read back from the formatted text."""
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").unionByName(own, allowMissingColumns=True)
    made = render(table_turns(rows)).withColumn("turns", parse(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for s in LITERALS:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(TEXT) + len(END)} + length({_sql_escape('role')}) + length({_sql_escape('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
