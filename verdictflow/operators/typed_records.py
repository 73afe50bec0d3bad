"""Records of many shapes to typed decision rows, and converters of sources to a fixed head with the raw row kept as VARIANT.

A converter is data: the fixed head, and for each field the paths to try in the raw row and a kind. ``convert`` compiles it to columns, so a
new source is an entry of the registry. Nothing raises on a bad row: ``error`` says what is wrong with it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictflow.functions.decisions import QTYPES, criteria_of, gold_position
from verdictflow.functions.text import english_strict


@dataclass(frozen=True)
class Field:
    """``paths`` are tried in order. Kinds: ``text`` (the first that is not empty, else empty), ``int`` (null if absent, an error if it is
    there and no whole number), ``any`` (VARIANT)."""

    paths: tuple[str, ...]
    kind: str = "text"


@dataclass(frozen=True)
class Question:
    """A question asked of every row. ``gold`` is a path; ``labels`` maps its values to labels (none: as they are); ``keys`` are the options."""

    qid: str
    type: str
    instructions: str
    gold: str
    keys: tuple[str, ...] = ()
    labels: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Converter:
    category: str
    source: str
    task: str
    fields: dict[str, Field]
    state: tuple[str, ...] = ()
    questions: tuple[Question, ...] = ()


def text(*paths: str) -> Field:
    return Field(paths)


def number(path: str) -> Field:
    return Field((path,), "int")


def whole(path: str) -> Field:
    return Field((path,), "any")


# The public sources with their category, task and fields.
CONVERTERS: dict[str, Converter] = {
    "bigvul": Converter("A", "bstee615/bigvul", "vulnerability_detection", {"buggy_code": text("before_fix"), "fixed_code": text("after_fix"), "label": number("vul"), "cve": text("CVE_ID"), "cwe": text("CWE_ID")}),
    "defect_detection": Converter("A", "mcanoglu/defect-detection", "defect_detection", {"code": text("code"), "label": number("label")}),
    "cybernative": Converter("A", "CyberNative/Code_Vulnerability_Security_DPO", "vulnerability_repair", {"instruction": text("prompt", "instruction"), "vulnerable_code": text("vulnerable"), "fixed_code": text("fixed")}),
    "pr_review_bench": Converter("B", "Qodo/PR-Review-Bench", "code_review", {"diff": text("diff"), "comment": text("comment"), "label": number("label")}),
    "hermes": Converter("E", "lambda/hermes-agent-reasoning-traces", "tool_call_trace", {"tools": whole("tools"), "conversations": whole("conversations"), "category_meta": text("category"), "subcategory": text("subcategory")}),
    "trace_commons": Converter("E", "trace-commons/agent-traces", "agent_trace", {"harness": text("harness"), "session_id": text("session_id"), "prompt": whole("prompt"), "messages": whole("messages"), "tools": whole("tools")}),
    "exgentic": Converter("E", "Exgentic/agent-llm-traces", "agent_trace", {"trace_id": text("trace_id"), "harness": text("harness"), "model": text("model"), "messages": whole("messages"), "tool_calls": whole("tool_calls"), "tool_results": whole("tool_results")}),
    "ms_marco": Converter("F", "microsoft/ms_marco", "search_rerank", {"query": text("query"), "query_type": text("query_type"), "passage_texts": whole("passages.passage_text"), "relevance": whole("passages.is_selected"), "answers": whole("answers")}),
    "codesearchnet": Converter("F", "code-search-net/code_search_net", "code_search_rerank", {"language": text("language"), "func_name": text("func_name"), "docstring": text("docstring", "func_documentation"), "code": text("func_code", "code")}),
}


def register(name: str, converter: Converter) -> None:
    if name in CONVERTERS:
        raise ValueError(f"there is a converter {name}")
    CONVERTERS[name] = converter


def value_at(raw: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(raw, "$" + "".join(f"['{p}']" for p in path.split(".")), kind)


def _field(raw: Column, f: Field) -> Column:
    if f.kind == "any":
        return value_at(raw, f.paths[0], "variant")
    if f.kind == "int":
        return value_at(raw, f.paths[0], "string").try_cast("long")
    found = [F.nullif(value_at(raw, p, "string"), F.lit("")) for p in f.paths]
    return F.coalesce(*found, F.lit(""))


def convert(rows: DataFrame, name: str, most: int | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """category, source, task, the converter's fields, raw (VARIANT) and error (null if the row is usable) of each row of ``rows``; with
    ``most``, of the first so many in the given order. A field may have the name of a column of ``rows``, which is then found in raw."""
    c = CONVERTERS[name]
    if most is not None:
        rows = rows.orderBy(*order).limit(most)
    made = rows.select(F.to_variant_object(F.struct(*[F.col(f"`{x}`") for x in rows.columns])).alias("raw"))
    raw = F.col("raw")
    errors = [F.when(value_at(raw, f.paths[0], "string").isNotNull() & _field(raw, f).isNull(), F.lit(f"{n} is not a whole number")) for n, f in c.fields.items() if f.kind == "int"]
    head = [F.lit(c.category).alias("category"), F.lit(c.source).alias("source"), F.lit(c.task).alias("task")]
    return made.select(*head, *[_field(raw, f).alias(n) for n, f in c.fields.items()], raw, F.coalesce(*errors, F.lit(None).cast("string")).alias("error"))


def decisions(rows: DataFrame, name: str, ident: str) -> DataFrame:
    """row_id, source, state, qid, type, instructions, keys, label, error for each row and question of a converter with questions.

    The state is a JSON object of the converter's state fields (one field: its text). Errors: an empty state, a missing gold value, and one
    that fits no option. ``ident`` is a column of ``rows``."""
    c = CONVERTERS[name]
    made = convert(rows, name)
    parts = [F.col(f"`{n}`").cast("string").alias(n) for n in c.state]
    state = parts[0] if len(parts) == 1 else F.to_json(F.struct(*parts))
    empty = F.concat(*[F.coalesce(F.trim(p), F.lit("")) for p in parts]) == ""

    def asked(q: Question) -> Column:
        value = value_at(F.col("raw"), q.gold, "string")
        label = F.coalesce(*[F.when(value == k, F.lit(v)) for k, v in q.labels.items()], F.lit(None)) if q.labels else value
        keys = F.array(*map(F.lit, q.keys)).cast("array<string>") if q.keys else F.lit(None).cast("array<string>")
        fits = gold_position(F.lit(q.type), keys, label).isNotNull()
        error = F.when(F.col("error").isNotNull(), F.col("error")).when(empty, "empty state").when(value.isNull(), "no gold").when(~fits, "gold fits no option")
        parts = {"qid": F.lit(q.qid), "type": F.lit(q.type), "instructions": F.lit(q.instructions), "keys": keys, "label": F.when(fits, label), "error": error}
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    flat = made.select(value_at(F.col("raw"), ident, "string").alias("row_id"), "source", state.alias("state"), F.explode(F.array(*[asked(q) for q in c.questions])).alias("q"))
    return flat.select("row_id", "source", "state", "q.*")


def typed_records(records: DataFrame) -> DataFrame:
    """``records`` (value: JSON text, source) as decision rows: source, domain, state, questions, gold and error (null if usable).

    * questions and gold may be objects or JSON text of objects. A gold value may be ``{"label": ...}``. Questions without gold are left out.
    * Types other than choice, score and noul are noul; criteria are lists or objects, in their order; anything else is no criteria.
    * An object or list as state is its JSON text, a text is trimmed. The domain is domain, else workflow, else ``general``.
    * Errors: not a JSON object, questions or gold that are none, no question with gold, text that is not ASCII in the first 500 characters
      of state, instructions and the first question's criteria."""
    at = lambda path: F.get_json_object("value", path)
    is_object = lambda c: F.startswith(F.ltrim(c), F.lit("{")) & F.try_parse_json(c).isNotNull()
    rows = records.select("source", "value", F.coalesce(at("$.questions"), F.lit("{}")).alias("q"), F.coalesce(at("$.gold"), F.lit("{}")).alias("g"), at("$.state").alias("s"))
    entries = F.map_entries(F.when(is_object(F.col("q")), F.from_json("q", "map<string,string>")))
    golds = F.when(is_object(F.col("g")), F.from_json("g", "map<string,string>"))
    rows = rows.withColumns({"entries": entries, "golds": golds})
    label = lambda v: F.when(F.startswith(v, F.lit("{")) & F.coalesce(F.array_contains(F.json_object_keys(v), "label"), F.lit(False)), F.get_json_object(v, "$.label")).otherwise(v)

    def question(e: Column) -> Column:
        kind = F.lower(F.get_json_object(e["value"], "$.type"))
        return F.struct(
            e["key"].alias("qid"),
            F.when(kind.isin(*QTYPES), kind).otherwise("noul").alias("type"),
            F.coalesce(F.get_json_object(e["value"], "$.instructions"), F.lit("")).alias("instructions"),
            F.array_distinct(criteria_of(F.get_json_object(e["value"], "$.criteria"))).alias("criteria"),
            label(F.get(F.map_values(F.map_filter("golds", lambda k, _: k == e["key"])), F.lit(0))).alias("label"),
        )

    rows = rows.withColumn("asked", F.filter(F.transform("entries", question), lambda q: q["label"].isNotNull()))
    rows = rows.withColumn("state", F.trim("s"))
    first = F.get("asked", F.lit(0))["criteria"]
    shown = F.concat(F.lit("{"), F.array_join(F.transform(first, lambda c: F.concat(F.lit('"'), c["key"], F.lit('": "'), c["desc"], F.lit('"'))), ", "), F.lit("}"))
    probe = F.concat_ws(" ", F.coalesce("state", F.lit("")), F.array_join(F.transform("asked", lambda q: q["instructions"]), " "), F.coalesce(shown, F.lit("{}")))
    error = (
        F.when(~F.coalesce(is_object(F.col("value")), F.lit(False)), "not a JSON object")
        .when(F.col("entries").isNull() | F.col("golds").isNull(), "questions or gold are no object")
        .when(F.size("asked") == 0, "no question with gold")
        .when(~english_strict(probe), "not English")
    )
    nonempty = lambda path: F.nullif(at(path), F.lit(""))
    return rows.select(
        "source",
        F.coalesce(nonempty("$.domain"), nonempty("$.workflow"), F.lit("general")).alias("domain"),
        "state",
        F.transform("asked", lambda q: F.struct(*[q[c].alias(c) for c in ("qid", "type", "instructions", "criteria")])).alias("questions"),
        F.transform("asked", lambda q: F.struct(q["qid"].alias("qid"), q["label"].alias("label"))).alias("gold"),
        error.alias("error"),
    )
