"""JSON states in English in three styles, and tool calls with one argument made wrong: small row functions over Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def _parsed(text: str | None) -> object:
    """The JSON value of a text; a text that is none stands for itself."""
    try:
        return json.loads(text or "")
    except ValueError:
        return text


def _each(render: Callable[[object], str | None]) -> Callable[[pd.Series], pd.Series]:
    return lambda states: pd.Series([None if s is None else render(_parsed(s)) for s in states], dtype=object)


def name_of(key: str) -> str:
    return key.replace("_", " ")


def facts(value: object, path: str = "") -> Iterator[str]:
    """``path is value`` for each leaf; lists number their items from 1."""
    if isinstance(value, dict):
        inner = ((f"{path}{name_of(str(k))}", v) for k, v in value.items())
    elif isinstance(value, list):
        inner = ((f"{path}item {i}", v) for i, v in enumerate(value, 1))
    else:
        yield f"{path.strip()} {value}"
        return
    for label, v in inner:
        if isinstance(v, (dict, list)):
            yield from facts(v, f"{label} ")
        else:
            yield f"{label} is {v}"


@F.pandas_udf(StringType())
def situation(states: pd.Series) -> pd.Series:
    """``Situation: a is b. c item 1 is d.`` for objects and lists; texts stay as they are."""
    return _each(lambda x: x if isinstance(x, str) else f"Situation: {'. '.join(facts(x))}.")(states)


@F.pandas_udf(StringType())
def pairs(states: pd.Series) -> pd.Series:
    """``key: value; key: value`` of an object's own keys, nested values as JSON; anything else stays as it is."""
    return _each(lambda x: "; ".join(f"{name_of(k)}: {v if isinstance(v, str) else json.dumps(v)}" for k, v in x.items()) if isinstance(x, dict) else x if isinstance(x, str) else json.dumps(x))(states)


@F.pandas_udf(StringType())
def log_with_context(states: pd.Series) -> pd.Series:
    """The text under ``log``, then the other keys as context; null for states without one."""

    def render(x: object) -> str | None:
        if not isinstance(x, dict) or "log" not in x:
            return None
        others = (f"{name_of(k)} is {str(v).lower() if isinstance(v, bool) else v}" for k, v in x.items() if k != "log")
        return f"Log:\n{x['log']}\n\nContext: {'; '.join(others)}."

    return _each(render)(states)


def wrong_arguments(call: object, most: int = 3) -> list[tuple[str, dict]]:
    """(what is wrong, call) for the first few ways to make one argument wrong: a changed value, another type, a list without its last item,
    and, if there are two arguments or more, the first one missing. Truth values, empty lists and nested objects stay."""
    if not isinstance(call, dict) or not isinstance(call.get("arguments"), dict):
        return []
    arguments = call["arguments"]
    found: list[tuple[str, dict]] = []

    def put(kind: str, changed: dict) -> None:
        found.append((kind, {**call, "arguments": changed}))

    for k, v in arguments.items():
        if isinstance(v, str):
            put("wrong value", {**arguments, k: f"{v}-x"})
            put("wrong type", {**arguments, k: len(v)})
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            put("wrong value", {**arguments, k: v + 1})
            put("wrong type", {**arguments, k: str(v)})
        elif isinstance(v, list) and v:
            put("shorter list", {**arguments, k: v[:-1]})
    if len(arguments) > 1:
        first = next(iter(arguments))
        put("missing field", {k: v for k, v in arguments.items() if k != first})
    return found[:most]


@F.pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("call", StringType())])))
def corruptions(calls: pd.Series) -> pd.Series:
    """``wrong_arguments`` of each call (JSON text with ``arguments``); none for a text that is no such call."""
    return pd.Series([[{"kind": k, "call": json.dumps(c)} for k, c in wrong_arguments(_parsed(t))] for t in calls], dtype=object)
