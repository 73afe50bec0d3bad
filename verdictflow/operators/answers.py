"""Answers of judges and models and what is checked on them, generated date questions and facts, gates and request snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictflow.functions.text import hash_bucket, hash_slot
from verdictflow.operators.evaluation import CONFIDENT_RIGHT, CONFIDENT_WRONG, FUNDAMENTALS, last_n, share

# Longest code and comment of a review and its least quality.
CODE_MOST, COMMENT_MOST, QUALITY_LEAST = 5000, 700, 0.6
# What a bare date question is about: the thing, its field, and how a question names the field.
BARE_THINGS = (
    ("task", "deadline", "deadline"),
    ("invoice", "due_date", "due date"),
    ("order", "ship_by", "ship-by date"),
    ("licence", "expires_on", "expiry date"),
    ("ticket", "sla_deadline", "SLA deadline"),
    ("trial", "ends_on", "end date"),
    ("coupon", "valid_until", "last valid date"),
    ("project", "milestone_date", "milestone date"),
)
# Its eight wordings, and how the date compares with today where the answer is yes.
BARE_QUESTIONS = (
    ("Has the {n}'s {f} already passed?", "<"),
    ("Today is {t}. Is {d} already in the past?", "<"),
    ("Is the {f} {d} today or later?", ">="),
    ("Is today ({t}) after the {f}?", "<"),
    ("Is the {f} today?", "="),
    ("Is the {n}'s {f} still in the future?", ">"),
    ("Today is {t}: is the {f} {d} on or before today?", "<="),
    ("Is the {n} past its {f}?", "<"),
)
# How logs write a time.
LOG_TIMES = {"postgres": "yyyy-MM-dd HH:mm:ss.SSS 'UTC'", "iso": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "nginx": "yyyy/MM/dd HH:mm:ss", "clf": "dd/MMM/yyyy:HH:mm:ss '+0000'"}
# The series of a snapshot and their kinds.
SERIES = (
    ("requests_total", "counter"),
    ("request_errors_total", "counter"),
    ("questions_total", "counter"),
    ("input_tokens_total", "counter"),
    ("latency_ms_avg", "gauge"),
    ("latency_ms_p50", "gauge"),
    ("latency_ms_p95", "gauge"),
    ("latency_ms_p99", "gauge"),
    ("latency_ms_max", "gauge"),
)
LATENCIES = 20_000


def legal_answer(kind: Column, answer: Column, options: Column) -> Column:
    """Whether an answer is one that its question allows: a truth value, one of the options, or the number of a level. Quotes around
    it do not count, nor does white space around those; a missing answer and an unknown kind are not legal."""
    a = F.regexp_replace(F.regexp_replace(answer, r"(?U)^\s+|\s+$", ""), r'^"+|"+$', "")
    level = a.rlike("^[0-9]+$") & (a.try_cast("int") < F.size(options))
    legal = F.when(kind == "noul", F.lower(a).isin("true", "false")).when(kind == "choice", F.array_contains(options, a)).when(kind == "score", level)
    return F.coalesce(legal, F.lit(False))


def answer_objects(text: Column) -> Column:
    """JSON objects (as text) in a free answer: the lines that are one, else the objects of the list between the first and last bracket."""

    def whole(x: Column) -> Column:
        return F.startswith(x, F.lit("{")) & F.try_parse_json(x).isNotNull()

    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.regexp_replace(F.trim(x), "^`+|`+$", "")), whole)
    listed = F.filter(F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), "array<string>"), whole)
    return F.when(F.size(lines) > 0, lines).otherwise(F.coalesce(listed, F.array().cast("array<string>")))


def raw_field(line: Column, name: str) -> Column:
    """The first text field ``name`` of a JSON line, read without parsing it; null if it has none."""
    return F.nullif(F.regexp_extract(line, f'"{name}": "([^"]*)"', 1), F.lit(""))


def review_guard(before: Column, after: Column, comment: Column, quality: Column) -> Column:
    """Whether a code review is usable: all parts there, none too long, quality high enough. Missing values fail."""
    there = (F.length(before) > 0) & (F.length(after) > 0) & (F.length(comment) > 0) & (quality >= QUALITY_LEAST)
    return F.coalesce(there & (F.length(before) <= CODE_MOST) & (F.length(after) <= CODE_MOST) & (F.length(comment) <= COMMENT_MOST), F.lit(False))


def reference_id(domain: Column, key: Column) -> Column:
    """An id such as ``ORDER-123456``: up to five letters and digits of the domain (``REF`` without any) and six digits by the key."""
    letters = F.substring(F.regexp_replace(F.upper(F.coalesce(domain, F.lit(""))), "[^A-Z0-9]", ""), 1, 5)
    return F.concat(F.when(letters == "", "REF").otherwise(letters), F.lit("-"), (hash_bucket(key, 900_000) + 100_000).cast("string"))


def log_time(ts: Column, style: str) -> Column:
    return F.date_format(ts, LOG_TIMES[style])


def negated(holds: Column, plain: Sequence[str], negative: Sequence[str], key: Column) -> tuple[Column, Column]:
    """(question, gold) of a rule that ``holds`` or not: one of the wordings by key, the gold turned around for a negative one."""
    wordings, at = [*plain, *negative], F.pmod(key, F.lit(len(plain) + len(negative)))
    return F.get(F.array(*map(F.lit, wordings)), at.cast("int")), holds != (at >= len(plain))


def bare_date(today: Column, date: Column, thing: Column, wording: Column) -> tuple[Column, Column, Column]:
    """(state as JSON, question, gold) of a date without a rule; ``thing`` and ``wording`` are places in the fixed values."""
    t, d = F.date_format(today, "yyyy-MM-dd"), F.date_format(date, "yyyy-MM-dd")

    def of_thing(part: int) -> Column:
        return F.get(F.array(*[F.lit(x[part]) for x in BARE_THINGS]), thing)

    filled = F.get(F.array(*[F.lit(x[0]) for x in BARE_QUESTIONS]), wording)
    for slot, value in {"{n}": of_thing(0), "{f}": of_thing(2), "{t}": t, "{d}": d}.items():
        filled = F.replace(filled, F.lit(slot), value)
    tests: Mapping[str, Column] = {"<": date < today, ">=": date >= today, "=": date == today, ">": date > today, "<=": date <= today}
    gold = reduce(lambda done, i: done.when(wording == i, tests[BARE_QUESTIONS[i][1]]), range(1, len(BARE_QUESTIONS)), F.when(wording == 0, tests[BARE_QUESTIONS[0][1]]))
    state = F.format_string('{"today": "%s", "%s": {"%s": "%s"}}', t, of_thing(0), of_thing(1), d)
    return state, filled, gold


CRITICALITY = ("critical", "standard", "internal-tool")  # fixed values


def obvious_facts(rows: DataFrame, key: Column, threshold: Column, retry_succeeded: Column | None = None) -> DataFrame:
    """Facts of log lines for a gate, far from every threshold: loud ones (half of the keys) and quiet ones, by digests of the key.

    Loud lines are of critical services and no retry of theirs succeeded; of quiet ones ``retry_succeeded`` is as given, else drawn."""

    def draw(name: str) -> Column:
        return F.concat(F.lit(f"{name}:"), key.cast("string"))

    loud = hash_slot(draw("loud")) < 0.5
    quiet_place = F.get(F.array(*map(F.lit, ("development", "staging", "production"))), hash_bucket(draw("place"), 3))
    return rows.select(
        "*",
        loud.alias("loud"),
        F.when(loud, "production").otherwise(quiet_place).alias("environment"),
        F.when(loud, threshold * (hash_bucket(draw("errors"), 31) + 10)).otherwise(1).alias("errors_last_5m"),
        F.when(loud, hash_bucket(draw("users"), 19_501) + 500).otherwise(0).alias("users_affected"),
        F.lit(False).alias("matches_known_benign_pattern"),
        (~loud & (hash_slot(draw("retry")) < 0.5 if retry_succeeded is None else retry_succeeded)).alias("retry_succeeded"),
        F.when(loud, CRITICALITY[0]).otherwise(F.get(F.array(*map(F.lit, CRITICALITY)), hash_bucket(draw("criticality"), 3))).alias("service_criticality"),
    )


def gate_of_answers(gold: DataFrame, answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row over a gate's file: questions whose request failed (no answer) are counted apart, and scores whose gold is no number are
    left out. ``gold`` has keys, kind and gold; ``answers`` keys, pred and sure (null: unsure)."""
    asked = gold.where(~((F.col("kind") == "score") & ~F.col("gold").rlike("^[0-9]+$"))).join(answers, list(keys), "left")
    there, right = F.col("pred").isNotNull(), F.col("sure") == F.col("gold")
    return asked.agg(
        F.count_if(there).alias("n"),
        F.count_if(~there).alias("n_failed"),
        F.avg(F.when(there, (F.col("pred") == F.col("gold")).cast("double"))).alias("accuracy"),
        F.avg(F.when(there, F.coalesce(right, F.lit(False)).cast("double"))).alias("confident_right"),
        F.avg(F.when(there, F.coalesce(~right, F.lit(False)).cast("double"))).alias("confident_wrong"),
    )


def release_gate(metrics: DataFrame, fundamentals_right: Column, size: Column, most: int) -> DataFrame:
    """``failures`` and ``passed`` of a model: the bounds of the basics, of the thirteen fundamentals, and of its size in bytes.
    A missing figure is a failure."""

    def unless(ok: Column, why: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(why))

    checks = (
        unless(F.col("confident_right") >= CONFIDENT_RIGHT, "confident_right"),
        unless(F.col("confident_wrong") <= CONFIDENT_WRONG, "confident_wrong"),
        unless(fundamentals_right >= FUNDAMENTALS, "fundamentals"),
        unless(size <= most, "size"),
    )
    return metrics.withColumn("failures", F.array_compact(F.array(*checks))).withColumn("passed", F.size("failures") == 0)


def full_snapshot(log: DataFrame, order: Sequence[Column], latencies: int = LATENCIES) -> DataFrame:
    """One row of all series over a request log (ms, error, questions, tokens): counts and mean of all requests, quantiles by floor index
    of the last ``latencies`` ones (a top-n, so the sorted list is bounded). Latencies are rounded to hundredths; 0 without requests."""

    def hundredths(x: Column) -> Column:
        return F.coalesce(F.floor(x * 100 + 0.5) / 100, F.lit(0.0))

    totals = log.agg(
        F.count(F.lit(1)).alias("requests_total"),
        F.count_if(F.col("error").isNotNull()).alias("request_errors_total"),
        F.coalesce(F.sum("questions"), F.lit(0)).alias("questions_total"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("input_tokens_total"),
        hundredths(F.avg("ms")).alias("latency_ms_avg"),
    )
    recent = last_n(log.where("ms is not null"), order, latencies).agg(F.sort_array(F.collect_list("ms")).alias("_ms"))
    at = [F.get("_ms", F.floor(F.lit(p) * (F.size("_ms") - 1)).cast("int")) for p in (0.5, 0.95, 0.99, 1.0)]
    points = recent.select(*[hundredths(x).alias(f"latency_ms_{name}") for x, name in zip(at, ("p50", "p95", "p99", "max"), strict=True)])
    return totals.join(F.broadcast(points))


def short_number(v: Column) -> Column:
    """A number of at least 0 in its shortest form: whole ones without a point, from a million on as a power of ten with two digits."""
    text = v.cast("string")
    plain = F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(text)
    whole = F.split_part(text, F.lit("."), F.lit(1))
    spelt = F.regexp_replace(F.concat(F.substring(whole, 1, 1), F.lit("."), F.substring(whole, 2, 20), F.split_part(text, F.lit("."), F.lit(2))), r"\.?0+$", "")
    power = F.concat(spelt, F.lit("e+"), F.lpad((F.length(whole) - 1).cast("string"), 2, "0"))
    java = F.concat(F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.?0+$", ""), F.lit("e+"), F.lpad(F.split_part(text, F.lit("E"), F.lit(2)), 2, "0"))
    return F.when(v < 1e6, plain).when(F.contains(text, F.lit("E")), java).otherwise(power)


def series_lines(snapshot: DataFrame, prefix: str) -> DataFrame:
    """Text exposition of a full snapshot: type and value of each series, in order; see ``short_number``."""
    cells = []
    for name, kind in SERIES:
        cells.append(F.concat(F.lit(f"# TYPE {prefix}_{name} {kind}\n{prefix}_{name} "), short_number(F.col(name).cast("double"))))
    return snapshot.select(F.posexplode(F.array(*cells)).alias("place", "line"))


def legal_share(rows: DataFrame, by: str, legal: Column) -> DataFrame:
    """How many answers of each judge there are and which share of them is legal."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(share(legal), 6).alias("legal_share"))
