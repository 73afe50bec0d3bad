"""Queries over answers, generated questions, gates and snapshots, each with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.operators import answers as N
from verdictflow.plans.catalog import _SLOT, BINARY_HASH, query, read

_ANSWERED = (
    "SELECT l_orderkey, l_linenumber, l_linestatus, CASE l_orderkey % 4 WHEN 0 THEN 'noul' WHEN 1 THEN 'choice' WHEN 2 THEN 'score' END AS kind, "
    "CASE l_linenumber WHEN 1 THEN ' \"True\"' WHEN 2 THEN 'no' WHEN 3 THEN '1' WHEN 4 THEN '2' WHEN 5 THEN '-1' WHEN 6 THEN NULL ELSE chr(9) || '\"no\"' || chr(10) END AS answer FROM lineitem"
)
_LEGAL = "coalesce(CASE kind WHEN 'noul' THEN lower(trim(trim(answer, chr(9) || chr(10) || ' '), '\"')) IN ('true', 'false') WHEN 'choice' THEN trim(trim(answer, chr(9) || chr(10) || ' '), '\"') IN ('yes', 'no') WHEN 'score' THEN trim(answer) IN ('0', '1') END, false)"


@query(f"SELECT l_linestatus, count(*) AS n, round(avg(CASE WHEN {_LEGAL} THEN 1.0 ELSE 0.0 END), 6) AS legal_share FROM ({_ANSWERED}) GROUP BY l_linestatus")
def legal_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_linestatus")
    kind = F.get(F.array(*map(F.lit, ("noul", "choice", "score", None))), F.pmod("l_orderkey", F.lit(4)).cast("int"))
    answer = F.get(F.array(*map(F.lit, (' "True"', "no", "1", "2", "-1", None, '\t"no"\n'))), F.col("l_linenumber") - 1)
    return N.legal_share(rows, "l_linestatus", N.legal_answer(kind, answer, F.array(F.lit("yes"), F.lit("no"))))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 0 END AS n, CASE WHEN c_custkey % 4 <= 1 THEN c_custkey END AS first_key FROM customer")
def answer_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    one = F.format_string('{"k": %s}', k.cast("string"))
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("Answers:\n `"), one, F.lit("`\n{broken\n"), one, F.lit("\n[1]")))
        .when(k % 4 == 1, F.concat(F.lit("Here: [\n"), one, F.lit(", 2,\n\"x\"] done")))
        .when(k % 4 == 2, "none [broken")
    )
    found = N.answer_objects(text)
    return read(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.size(found).alias("n"), F.get_json_object(F.get(found, F.lit(0)), "$.k").cast("long").alias("first_key"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_brand END AS source FROM part")
def raw_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.when(F.col("p_size") % 5 > 0, F.concat(F.lit('"source": "'), "p_brand", F.lit('", ')))
    line = F.concat(F.lit('{"state": {"a": 1}, '), F.coalesce(field, F.lit("")), F.lit('"domain": "x", "sources": "y"}'))
    return read(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand").select("p_partkey", N.raw_field(line, "source").alias("source"))


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 1 AND 5000 AND length(lang) BETWEEN 1 AND 700 AND length(source) BETWEEN 1 AND 5000 AND doc_id % 10 >= 6")
def review_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return docs.where(N.review_guard(F.col("text"), F.col("source"), F.col("lang"), (F.col("doc_id") % 10) / 10)).select("doc_id")


@query(f"SELECT p_partkey, substr(regexp_replace(upper(p_type), '[^A-Z0-9]', '', 'g'), 1, 5) || '-' || CAST(100000 + {BINARY_HASH.format('CAST(p_partkey AS VARCHAR)')} % 900000 AS VARCHAR) AS ref FROM part")
def reference_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part", "p_partkey", "p_type").select("p_partkey", N.reference_id(F.col("p_type"), F.col("p_partkey").cast("string")).alias("ref"))


@query(
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g UTC') AS postgres, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, strftime(ts, '%Y/%m/%d %H:%M:%S') AS nginx, strftime(ts, '%d/%b/%Y:%H:%M:%S +0000') AS clf FROM events"
)
def log_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events", "event_id", "ts").select("event_id", *[N.log_time(F.col("ts"), s).alias(s) for s in N.LOG_TIMES])


@query(
    "SELECT l_orderkey, l_linenumber, ['Is it late?', 'Did it miss its date?', 'Is it still on time?'][1 + l_orderkey % 3] AS question, (l_quantity > 25) <> (l_orderkey % 3 = 2) AS gold FROM lineitem"
)
def negated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("l_quantity") > 25
    question, gold = N.negated(late, ["Is it late?", "Did it miss its date?"], ["Is it still on time?"], F.col("l_orderkey"))
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", question.alias("question"), gold.alias("gold"))


_THING = "['task', 'invoice', 'order', 'licence', 'ticket', 'trial', 'coupon', 'project'][l_linenumber]"
_FIELD = "['deadline', 'due_date', 'ship_by', 'expires_on', 'sla_deadline', 'ends_on', 'valid_until', 'milestone_date'][l_linenumber]"
_NAMED = "['deadline', 'due date', 'ship-by date', 'expiry date', 'SLA deadline', 'end date', 'last valid date', 'milestone date'][l_linenumber]"


@query(
    "WITH x AS (SELECT l_orderkey, l_linenumber, l_orderkey % 8 AS w, CAST(l_shipdate AS DATE) + CAST(l_partkey % 5 - 2 AS INTEGER) AS t, CAST(l_shipdate AS DATE) AS d, "
    f"{_THING} AS n, {_FIELD} AS k, {_NAMED} AS f FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, '{\"today\": \"' || t || '\", \"' || n || '\": {\"' || k || '\": \"' || d || '\"}}' AS state, "
    "CASE w WHEN 0 THEN 'Has the ' || n || '''s ' || f || ' already passed?' WHEN 1 THEN 'Today is ' || t || '. Is ' || d || ' already in the past?' "
    "WHEN 2 THEN 'Is the ' || f || ' ' || d || ' today or later?' WHEN 3 THEN 'Is today (' || t || ') after the ' || f || '?' WHEN 4 THEN 'Is the ' || f || ' today?' "
    "WHEN 5 THEN 'Is the ' || n || '''s ' || f || ' still in the future?' WHEN 6 THEN 'Today is ' || t || ': is the ' || f || ' ' || d || ' on or before today?' "
    "ELSE 'Is the ' || n || ' past its ' || f || '?' END AS question, "
    "CASE WHEN w IN (0, 1, 3, 7) THEN t > d WHEN w = 2 THEN t <= d WHEN w = 4 THEN t = d WHEN w = 5 THEN t < d ELSE t >= d END AS gold FROM x"
)
def bare_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    state, question, gold = N.bare_date(F.date_add(F.col("l_shipdate").cast("date"), (F.col("l_partkey") % 5 - 2).cast("int")), F.col("l_shipdate").cast("date"), F.col("l_linenumber") - 1, (F.col("l_orderkey") % 8).cast("int"))
    return rows.select("l_orderkey", "l_linenumber", state.alias("state"), question.alias("question"), gold.alias("gold"))


def _draw(name: str) -> str:
    return BINARY_HASH.format(f"'{name}:' || CAST(p_partkey AS VARCHAR)")


@query(
    f"WITH x AS (SELECT *, {_SLOT.format(chr(39) + 'loud:' + chr(39) + ' || CAST(p_partkey AS VARCHAR)')} < 0.5 AS loud FROM part) "
    f"SELECT p_partkey, loud, CASE WHEN loud THEN 'production' ELSE ['development', 'staging', 'production'][1 + CAST({_draw('place')} % 3 AS INT)] END AS environment, "
    f"CASE WHEN loud THEN p_size * (10 + {_draw('errors')} % 31) ELSE 1 END AS errors_last_5m, CASE WHEN loud THEN 500 + {_draw('users')} % 19501 ELSE 0 END AS users_affected, "
    f"NOT loud AND {_SLOT.format(chr(39) + 'retry:' + chr(39) + ' || CAST(p_partkey AS VARCHAR)')} < 0.5 AS retry_succeeded, "
    f"CASE WHEN loud THEN 'critical' ELSE ['critical', 'standard', 'internal-tool'][1 + CAST({_draw('criticality')} % 3 AS INT)] END AS service_criticality FROM x"
)
def obvious_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.obvious_facts(read(spark, sf_dir, "part", "p_partkey", "p_size"), F.col("p_partkey"), F.col("p_size")).drop("p_size", "matches_known_benign_pattern")


_GATE = (
    "SELECT count(*) FILTER (WHERE a) AS n, count(*) FILTER (WHERE NOT a) AS n_failed, avg(CASE WHEN a THEN CAST(pred = gold AS INT) END) AS accuracy, "
    "avg(CASE WHEN a THEN CAST(coalesce(sure = gold, false) AS INT) END) AS confident_right, avg(CASE WHEN a THEN CAST(coalesce(sure <> gold, false) AS INT) END) AS confident_wrong "
    "FROM (SELECT o_orderkey % 7 > 0 AS a, o_orderstatus AS gold, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS pred, "
    "CASE WHEN o_orderkey % 5 > 0 THEN CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END END AS sure FROM orders WHERE o_orderkey % 3 > 0)"
)


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    gold = orders.select("o_orderkey", F.when(k % 3 == 0, "score").otherwise("choice").alias("kind"), F.col("o_orderstatus").alias("gold"))
    pred = F.when(k % 9 == 0, "X").otherwise(F.col("o_orderstatus"))
    return N.gate_of_answers(gold, orders.where(k % 7 > 0).select("o_orderkey", pred.alias("pred"), F.when(k % 5 > 0, pred).alias("sure")), ["o_orderkey"])


@query(_GATE)
def gate_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the questions are scores without a number as gold, and every seventh request failed."""
    return _gate(spark, sf_dir)


@query(
    f"SELECT right_of_13, concat_ws(',', CASE WHEN confident_right < 0.9 THEN 'confident_right' END, CASE WHEN confident_wrong > 0.02 THEN 'confident_wrong' END, CASE WHEN right_of_13 < 12 THEN 'fundamentals' END, CASE WHEN size > 1000 THEN 'size' END) AS failures, "
    f"confident_right >= 0.9 AND confident_wrong <= 0.02 AND right_of_13 >= 12 AND size <= 1000 AS passed FROM ({_GATE}), (SELECT r_regionkey + 10 AS right_of_13, r_regionkey * 300 AS size FROM region)"
)
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = read(spark, sf_dir, "region", "r_regionkey").select((F.col("r_regionkey") + 10).alias("right_of_13"), (F.col("r_regionkey") * 300).alias("size"))
    judged = N.release_gate(models.join(F.broadcast(_gate(spark, sf_dir))), F.col("right_of_13"), F.col("size"), 1000)
    return judged.select("right_of_13", F.array_join("failures", ",").alias("failures"), "passed")


_AT = "floor(list_sort(ms)[1 + CAST(floor({} * (len(ms) - 1)) AS BIGINT)] * 100 + 0.5) / 100"
_SNAPSHOT = (
    "SELECT requests_total, request_errors_total, questions_total, input_tokens_total, latency_ms_avg, "
    f"{_AT.format(0.5)} AS latency_ms_p50, {_AT.format(0.95)} AS latency_ms_p95, {_AT.format(0.99)} AS latency_ms_p99, {_AT.format(1.0)} AS latency_ms_max FROM "
    "(SELECT count(*) AS requests_total, count(*) FILTER (WHERE event_id % 20 = 0) AS request_errors_total, CAST(sum(1 + event_id % 3) AS BIGINT) AS questions_total, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens_total, floor(avg(value) * 100 + 0.5) / 100 AS latency_ms_avg FROM events), "
    "(SELECT list(value) AS ms FROM (SELECT value FROM events WHERE value IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 20000))"
)


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    log = read(spark, sf_dir, "events", "event_id", "ts", "value").select("event_id", "ts", F.col("value").alias("ms"), F.when(k % 20 == 0, "failed").alias("error"), (1 + k % 3).alias("questions"), (k % 100).alias("tokens"))
    return N.full_snapshot(log, [F.desc("ts"), F.desc("event_id")])


@query(_SNAPSHOT)
def full_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and mean over all requests, quantiles over the last 20,000: that limit is the operator."""
    return _snapshot(spark, sf_dir)


@query(
    "SELECT CAST(place AS INT) AS place, '# TYPE engine_' || name || ' ' || CASE WHEN place < 4 THEN 'counter' ELSE 'gauge' END || chr(10) || 'engine_' || name || ' ' || CASE WHEN v >= 1e6 THEN rtrim(rtrim(substr(CAST(v AS VARCHAR), 1, 1) || '.' || replace(substr(CAST(v AS VARCHAR), 2), '.', ''), '0'), '.') || 'e+' || lpad(CAST(len(CAST(CAST(floor(v) AS BIGINT) AS VARCHAR)) - 1 AS VARCHAR), 2, '0') WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS line FROM "
    "(SELECT unnest(range(9)) AS place, unnest(['requests_total', 'request_errors_total', 'questions_total', 'input_tokens_total', 'latency_ms_avg', 'latency_ms_p50', 'latency_ms_p95', 'latency_ms_p99', 'latency_ms_max']) AS name, "
    f"unnest([requests_total, request_errors_total, questions_total, input_tokens_total, latency_ms_avg, latency_ms_p50, latency_ms_p95, latency_ms_p99, latency_ms_max]::DOUBLE[]) AS v FROM ({_SNAPSHOT}))"
)
def series_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.series_lines(_snapshot(spark, sf_dir), "engine")
