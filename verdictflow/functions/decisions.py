"""Decision rows as columns: questions, criteria and gold labels in, probabilities and verdicts out.

Options are arrays, because their order is part of the meaning.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QTYPES = {"choice": 0, "score": 1, "noul": 2}
# Default temperatures by question type, verdict bounds, and how strongly a label is trusted.
TEMPERATURES = {"choice": 1.0255, "score": 1.0340, "noul": 1.1479}
YES, NO, SURE = 0.8, 0.2, 0.6
# What a yes/no question asks where its criteria do not say.
NOUL_CRITERIA = {"false": "no, the statement does not hold", "true": "yes, the statement holds"}
RULE_PEAK, OTHER_PEAK = 0.99, 0.9
RULE_SOURCES = ("our-cases-",)


def round4(c: Column) -> Column:
    """Four places, halves away from zero; not-a-number and infinities become 0."""
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(F.round(c, 4))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp((x - top) / t))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def temperature_of(qtype: Column) -> Column:
    out = F.lit(1.0)
    for name, t in TEMPERATURES.items():
        out = F.when(qtype == name, F.lit(t)).otherwise(out)
    return out


def first_best(p: Column) -> Column:
    """0-based position of the first largest value."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def expected_level(p: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x, i: x * i.cast("double")), F.lit(0.0), lambda a, x: a + x)


def act_probability(act: Column) -> Column:
    """First of two classes; null unless both logits are finite."""
    a, b = F.get(act, F.lit(0)), F.get(act, F.lit(1))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(finite(a) & finite(b), round4(F.lit(1.0) / (F.lit(1.0) + F.exp(b - a))))


def decode(rows: DataFrame, qtype: str = "type", keys: str = "keys", logits: str = "logits", act: str | None = None) -> DataFrame:
    """Answers from logits: probabilities by option, confidence, and choice, score or noul by type.

    Options beyond the logits (cut by the length limit) are dropped and ``truncated`` says so."""
    n = F.least(F.size(keys), F.size(logits))
    out = rows.withColumn("_k", F.slice(keys, F.lit(1), n)).withColumn("_z", F.slice(logits, F.lit(1), n))
    out = out.withColumn("_p", softmax(F.col("_z"), temperature_of(F.col(qtype))))
    best = first_best(F.col("_p"))
    top = F.array_max("_p")
    yes = F.get("_p", F.lit(1))
    t = F.col(qtype)
    return out.select(
        *[F.col(c) for c in rows.columns],
        F.transform("_p", lambda x: round4(x)).alias("probabilities"),
        F.when(t == "choice", F.get("_k", best)).alias("choice"),
        F.when(t == "score", round4(expected_level(F.col("_p")))).alias("score"),
        F.when(t == "noul", round4(yes)).alias("noul"),
        F.when(t == "noul", round4(F.greatest(yes, 1 - yes))).otherwise(round4(top)).alias("confidence"),
        round4(top).alias("answer_confidence"),
        (F.size(keys) > F.size(logits)).alias("truncated"),
        *([act_probability(F.col(act)).alias("act_probability")] if act else []),
    )


def noul_verdict(p: Column) -> Column:
    return F.when(p >= YES, "yes").when(p <= NO, "no").otherwise("unsure")


def choice_verdict(keys: Column, p: Column) -> Column:
    return F.when(F.array_max(p) >= SURE, F.get(keys, first_best(p))).otherwise("unsure")


def criteria_of(text: Column) -> Column:
    """Ordered (key, desc) pairs of criteria given as a JSON object or list; null otherwise. Key order is the text's own."""
    as_map = F.from_json(text, "map<string,string>")
    keys = F.json_object_keys(text)
    objects = F.transform(keys, lambda k: F.struct(k.alias("key"), F.coalesce(F.get(F.map_values(F.map_filter(as_map, lambda a, _: a == k)), F.lit(0)), F.lit("")).alias("desc")))
    lists = F.transform(F.from_json(text, "array<string>"), lambda x: F.struct(x.alias("key"), x.alias("desc")))
    first = F.substring(F.ltrim(text), 1, 1)
    return F.when(first == "{", objects).when(first == "[", lists)


def option_texts(qtype: Column, criteria: Column) -> Column:
    """What the scorer reads for each option."""
    choice = F.transform(criteria, lambda c: F.when((c["desc"] == "") | (c["desc"] == c["key"]), c["key"]).otherwise(F.concat(c["key"], F.lit(": "), c["desc"])))
    score = F.transform(criteria, lambda c, i: F.concat(F.lit("level "), i.cast("string"), F.lit(": "), F.when(c["desc"] != "", c["desc"]).otherwise(c["key"])))
    given = lambda k: F.get(F.filter(criteria, lambda c: (c["key"] == k) & (c["desc"] != "")), F.lit(0))["desc"]
    noul = F.array(*[F.concat(F.lit(f"{k}: "), F.coalesce(given(k), F.lit(text))) for k, text in NOUL_CRITERIA.items()])
    return F.when(qtype == "choice", choice).when(qtype == "score", score).otherwise(noul)


def question_errors(qtype: Column, criteria: Column) -> Column:
    """Errors of a question; empty if it can be asked."""
    few = F.coalesce(F.size(criteria), F.lit(0)) < 2
    errors = F.array(
        F.when(~F.coalesce(qtype.isin(*QTYPES), F.lit(False)), F.lit("unknown type")),
        F.when(qtype.isin("choice", "score") & criteria.isNull(), F.lit("missing criteria")),
        F.when(qtype.isin("choice", "score") & criteria.isNotNull() & few, F.lit("fewer than two options")),
    )
    return F.array_compact(errors)


def truth_label(c: Column) -> Column:
    """``true`` or ``false`` from the usual spellings of yes and no, else null."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "yes", "1"), "true").when(t.isin("false", "no", "0"), "false")


def gold_position(qtype: Column, keys: Column, label: Column) -> Column:
    """0-based position of a gold label: by name, else by index for choice and score; null if it fits no option."""
    by_name = F.array_position(keys, label)
    index = label.try_cast("int")
    noul = F.when(truth_label(label) == "true", 1).when(truth_label(label) == "false", 0)
    other = F.when(by_name > 0, (by_name - 1).cast("int")).when(index.between(0, F.size(keys) - 1), index)
    return F.when(qtype == "noul", noul).otherwise(other)


def spread(position: Column, n: Column, peak: Column) -> Column:
    """Target distribution: ``peak`` at the label, the rest even, six places."""
    rest = F.round((F.lit(1.0) - peak) / F.greatest(F.lit(1), n - 1), 6)
    return F.when(position.isNotNull(), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == position, peak).otherwise(rest)))


def peak_of(source: Column) -> Column:
    rule = F.lit(False)
    for prefix in RULE_SOURCES:
        rule = rule | F.startswith(source, F.lit(prefix))
    return F.when(rule, F.lit(RULE_PEAK)).otherwise(F.lit(OTHER_PEAK))


def normalized(target: Column) -> Column:
    """Sums to 1; even if it sums to 0."""
    total = F.aggregate(target, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.transform(target, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(target)))


def hard_position(target: Column) -> Column:
    """0-based position of the only largest value; null on ties."""
    top = F.array_max(target)
    return F.when(F.size(F.filter(target, lambda x: x == top)) == 1, (F.array_position(target, top) - 1).cast("int"))


def parse_options(c: Column) -> Column:
    """``a|b=text`` to ordered (key, desc) pairs."""
    return F.transform(
        F.split(c, r"\|"), lambda part: F.struct(F.trim(F.split_part(part, F.lit("="), F.lit(1))).alias("key"), F.trim(F.regexp_extract(part, r"=(.*)$", 1)).alias("desc"))
    )


def nli_label(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(0)), F.lit(2)))


def score_with(rows: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], text: str, options: str) -> DataFrame:
    """Append ``logits`` from a pluggable scorer, called on Arrow batches of (text, option texts)."""

    @F.pandas_udf("array<double>")
    def scored(t: pd.Series, o: pd.Series) -> pd.Series:
        return scorer(t, o)

    return rows.withColumn("logits", scored(rows[text], rows[options]))


def lay_out(head: Column, options: Column, state: Column, max_len: int = 1024, head_max: int = 256, cls: int = 50281, sep: int = 50282, mask: int = 50284) -> Column:
    """Struct(ids, markers) of one question: CLS head SEP (MASK option)* SEP state SEP, cut to ``max_len``.

    Options have at most 48 tokens; if they leave the head fewer than 16 they are cut evenly, to 4 tokens at least."""
    one = lambda t: F.array(F.lit(t))
    wide = F.transform(options, lambda o: F.concat(one(mask), F.slice(o, 1, 48)))
    total = lambda os: F.aggregate(os, F.lit(0), lambda a, o: a + F.size(o))
    narrow_to = F.greatest(F.lit(4), F.floor(F.lit(head_max - 16) / F.greatest(F.lit(1), F.size(options))).cast("int"))
    fitted = F.when(F.lit(head_max) - total(wide) < 16, F.transform(wide, lambda o: F.slice(o, F.lit(1), narrow_to))).otherwise(wide)
    start = F.concat(one(cls), F.slice(head, F.lit(1), F.greatest(F.lit(8), F.lit(head_max) - total(fitted))), one(sep))
    before = F.concat(start, F.flatten(fitted), one(sep))
    ids = F.slice(F.concat(before, F.slice(state, F.lit(1), F.greatest(F.lit(0), F.lit(max_len - 1) - F.size(before))), one(sep)), 1, max_len)
    marks = F.transform(fitted, lambda o, i: F.size(start) + F.aggregate(F.slice(fitted, F.lit(1), i), F.lit(0), lambda a, x: a + F.size(x)))
    return F.struct(ids.alias("ids"), F.filter(marks, lambda m: m < max_len).alias("markers"))
