"""Queries over the reference's own operators, by name, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.functions import conditions as C
from verdictflow.functions import decisions as D
from verdictflow.functions import text as T
from verdictflow.operators import datasets as O
from verdictflow.operators import evaluation as E
from verdictflow.operators import rules as R
from verdictflow.operators import shaping as S

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
TODAY = "DATE '1998-01-01'"
BINARY_HASH = "CAST('0x' || substr(sha256({}), 1, 16) AS UBIGINT)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from verdictflow.plans import catalog_answers, catalog_audit, catalog_families, catalog_leaks, catalog_more, catalog_small, catalog_sources, catalog_steps, stream_catalog  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from verdictflow.plans import catalog_answers, catalog_audit, catalog_families, catalog_leaks, catalog_more, catalog_small, catalog_sources, catalog_steps, stream_catalog  # noqa: F401

    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def hex_order(c: Column) -> Column:
    return F.sha2(c.cast("string").cast("binary"), 256)


# --- leaks -----------------------------------------------------------------------------------------------------------------


def _leaks(spark: SparkSession, sf_dir: str, prepare: Callable[[Column], Column]) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", prepare(F.col("text")).alias("t"))
    items = read(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", prepare(F.col("text")).alias("t"))
    return O.leaks_by_text(docs, items)


_SQUEEZE = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_TOKENS = r"array_to_string(regexp_extract_all(lower(replace({}, '_', ' ')), '[a-z]+|-?[0-9]+(?:\.[0-9]+)?'), ' ')"


def _leak_sql(form: str) -> str:
    d, b = form.format("text"), form.format("text")
    return f"SELECT doc_id, item_id FROM (SELECT doc_id, {d} AS t FROM documents) d JOIN (SELECT item_id, {b} AS u FROM benchmark) b ON contains(t, u) WHERE u <> ''"


@query(_leak_sql(_SQUEEZE))
def leak_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, T.squeeze)


@query(_leak_sql(_TOKENS))
def leak_token_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, lambda c: F.array_join(T.word_tokens(c), " "))


@query(_leak_sql(r"regexp_replace(" + _TOKENS + r", '[0-9]+(\.[0-9]+)?', '#', 'g')"))
def leak_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, lambda c: T.mask_numbers(F.array_join(T.word_tokens(c), " ")))


@query(f"WITH x AS ({_leak_sql(_SQUEEZE)}) SELECT lang, count(*) AS n_kept FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM x) GROUP BY lang")
def leak_removed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = O.anti(read(spark, sf_dir, "documents", "doc_id", "lang"), leak_substring(spark, sf_dir), "doc_id")
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"))


@query(
    "WITH k AS (SELECT doc_id, sha256(lower(trim(text))) AS key FROM documents), t AS (SELECT DISTINCT key FROM k WHERE doc_id % 2 = 1) "
    "SELECT CAST(count(*) FILTER (WHERE key IN (SELECT key FROM t)) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE key NOT IN (SELECT key FROM t)) AS BIGINT) AS misses FROM k WHERE doc_id % 2 = 0"
)
def leak_exact_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents as the training side, odd ones as the test side: two roles of one whole table."""
    keyed = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2(F.lower(F.trim("text")).cast("binary"), 256).alias("key"))
    train, test = keyed.where("doc_id % 2 = 0"), keyed.where("doc_id % 2 = 1")
    hits = O.semi(train, test, "key").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(O.anti(train, test, "key").agg(F.count(F.lit(1)).alias("misses")))


# --- de-duplication and caps -------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) = 1")
def near_dup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2(F.lower(F.trim("text")).cast("binary"), 256).alias("key"))
    return O.keep_first(rows, [F.col("key")], [F.col("doc_id")]).drop("key")


@query(
    "SELECT CAST(count(*) AS BIGINT) AS states, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS repeated, CAST(count(*) FILTER (WHERE labels = 2) AS BIGINT) AS mixed, CAST(sum(n) AS BIGINT) AS n_rows "
    "FROM (SELECT count(*) AS n, count(DISTINCT toxic) AS labels FROM documents JOIN labels USING (doc_id) GROUP BY lower(trim(text)))"
)
def dup_state_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select(F.sha2(F.lower(F.trim("text")).cast("binary"), 256).alias("key"), "toxic")
    per = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("toxic")).alias("labels"))
    return per.agg(
        F.count(F.lit(1)).alias("states"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("labels") == 2).alias("mixed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")
    )


_MASKED = r"regexp_replace(url, '0x[0-9a-fA-F]+|\b[0-9a-fA-F]{6,}\b|[0-9]+', '<*>', 'g')"


@query(f"SELECT {_MASKED} AS template, count(*) AS n FROM pages GROUP BY 1")
def template_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages", "url").groupBy(T.log_template(F.col("url")).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH a AS (SELECT conv_id, turn, text, role FROM conversations QUALIFY row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) <= 3) "
    "SELECT conv_id, turn, role FROM a QUALIFY row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) <= 400"
)
def copies_and_template_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 3 copies of a message, then 400 of a template (here: a role)."""
    rows = read(spark, sf_dir, "conversations").withColumn("_o", F.struct("conv_id", "turn"))
    return O.two_caps(rows, "text", "role", 3, 400, F.col("_o")).select("conv_id", "turn", "role")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS lines FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 15) GROUP BY conv_id")
def first_n_lines_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_lines(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("SELECT conv_id, string_agg(role || ': ' || text, '; ' ORDER BY turn) AS state, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("part"))))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "; ").alias("state"), F.count(F.lit(1)).alias("turns"))


# --- splits and samples ------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CASE WHEN {BINARY_HASH.format('text || chr(10) || lang')} % 10 = 0 THEN 'gate' ELSE 'train' END AS split FROM documents")
def hash_split_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.split_by_hash(read(spark, sf_dir, "documents", "doc_id", "text", "lang"), F.col("text"), F.col("lang")).select("doc_id", "split")


@query(f"SELECT CASE WHEN {BINARY_HASH.format('CAST(o_orderkey AS VARCHAR) || chr(10) || o_orderpriority')} % 10 = 0 THEN 'gate' ELSE 'train' END AS split, count(*) AS n FROM orders GROUP BY 1")
def split_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.split_by_hash(read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority"), F.col("o_orderkey").cast("string"), F.col("o_orderpriority"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


_SLOT = "(CAST(CAST('0x' || substr(sha256({}), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0)"


@query(f"SELECT source, CASE WHEN {_SLOT.format('source')} < 0.1 THEN 'gate' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY 1, 2")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.split_groups(read(spark, sf_dir, "documents", "source"), F.col("source")).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH r AS (SELECT least(1.0, greatest(0.0, coalesce((1000000 - sum(CASE WHEN lang = 'es' THEN octet_length(encode(text)) ELSE 0 END)) / CAST(nullif(sum(CASE WHEN lang <> 'es' THEN octet_length(encode(text)) ELSE 0 END), 0) AS DOUBLE), 1.0))) AS rate FROM documents) "
    f"SELECT doc_id, lang FROM documents, r WHERE lang = 'es' OR {_SLOT.format('CAST(doc_id AS VARCHAR)')} <= rate"
)
def rate_sample_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: Spanish documents first, the others at the rate that fits a million bytes."""
    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "text")
    priority = F.col("lang") == "es"
    return O.sample_by_rate(docs, F.col("doc_id").cast("string"), priority, O.budget_rate(docs, F.octet_length("text"), priority, 1_000_000)).select("doc_id", "lang")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('20260929:' || CAST(doc_id AS VARCHAR))) <= 30")
def reservoir_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.sample_per_group(read(spark, sf_dir, "documents", "doc_id", "source"), ["source"], 30, F.col("doc_id"))


@query(
    "WITH a AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS t FROM documents) "
    "SELECT doc_id, source, lang FROM a WHERE t <= 12 QUALIFY row_number() OVER (PARTITION BY source ORDER BY t, lang) <= 12"
)
def round_robin_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.round_robin(read(spark, sf_dir, "documents", "doc_id", "source", "lang"), "source", "lang", 12, hex_order(F.col("doc_id")))


@query(
    "WITH m AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM labels GROUP BY toxic)) "
    "SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS rn FROM labels), m WHERE rn <= c"
)
def balance_minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.balance(read(spark, sf_dir, "labels", "doc_id", "toxic"), "toxic", hex_order(F.col("doc_id")))


@query(
    "WITH l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'positive' WHEN quality = 0 THEN 'hard' ELSE 'easy' END AS k FROM labels), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS rn FROM l), "
    "n AS (SELECT count(*) FILTER (WHERE k = 'positive') AS p, least(count(*) FILTER (WHERE k = 'hard'), count(*) FILTER (WHERE k = 'positive') // 2) AS h FROM l) "
    "SELECT doc_id FROM r, n WHERE k = 'positive' OR (k = 'hard' AND rn <= h) OR (k = 'easy' AND rn <= p - h)"
)
def stratified_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels")
    return O.stratified_negatives(rows, F.col("toxic") == 1, F.col("quality") == 0, hex_order(F.col("doc_id"))).select("doc_id")


@query("SELECT doc_id, unnest(range(1, CASE WHEN toxic = 1 THEN 4 ELSE 2 END)) AS copy FROM labels")
def repeat_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.repeat_rows(read(spark, sf_dir, "labels"), F.when(F.col("toxic") == 1, 3).otherwise(1))
    return rows.select("doc_id", F.col("copy").cast("long").alias("copy"))


# --- text --------------------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, regexp_full_match(substr(text, 1, 500), '[\x00-\x7F]*') AS is_english FROM documents")
def english_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.english_strict(F.col("text")).alias("is_english"))


@query(r"SELECT doc_id, regexp_full_match(substr(text, 1, 200), '[\x00-\x7F\p{L}]*') AS is_english FROM documents")
def english_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.english_lenient(F.col("text")).alias("is_english"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(lower(replace(text, '_', ' ')), '[a-z]+|-?[0-9]+(?:\.[0-9]+)?')) AS BIGINT) AS n_tokens, sha256(lower(trim(text))) AS key FROM documents")
def token_counts_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.word_tokens(F.col("text"))).cast("long").alias("n_tokens"), F.sha2(F.lower(F.trim("text")).cast("binary"), 256).alias("key"))


@query(
    "SELECT doc_id, CASE WHEN length(trim(text)) <= 80 THEN trim(text) ELSE rtrim(substr(trim(text), 1, 80)) || chr(10) || '...' END AS short, "
    "CASE WHEN length(text) <= 120 THEN text ELSE left(text, 60) || chr(10) || '...' || chr(10) || right(text, 60) END AS ends, substr(sha1(text), 1, 12) AS pair_key FROM documents"
)
def cut_and_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.cut(t, 80).alias("short"), T.clip(t, 120).alias("ends"), T.pair_key(t).alias("pair_key"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_keys(props)[1] AS first_key FROM events")
def canonical_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events", "event_id", "props")
    canonical = T.canonical_json(F.col("props"))
    return rows.select("event_id", F.get_json_object(canonical, "$.k").cast("long").alias("k"), F.get(F.json_object_keys(canonical), F.lit(0)).alias("first_key"))


@query()
def blake2b_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events", "event_id", "props", "event_type").select("event_id", T.exact_question_key("props", "event_type").alias("key"))


@query()
def english_render_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_type", "value", F.from_json("props", "map<string,long>").alias("props"))).alias("state"))
    return rows.select("event_id", T.flat_english("state").alias("text"))


# --- conditions --------------------------------------------------------------------------------------------------------------

_CONDITIONS: dict[str, tuple[str, str, C.Condition]] = {
    "cond_num": ("lineitem", "l_orderkey, l_linenumber", C.Atom("num", "l_quantity", "gte", 30) & ~C.Atom("num", "l_discount", "eq", 0.05)),
    "cond_between": ("part", "p_partkey", C.Atom("num", "p_retailprice", "between", (1000, 1500, True, False))),
    "cond_enum": ("orders", "o_orderkey", C.Atom("enum", "o_orderstatus", "in", ("F", "O")) & C.Atom("enum", "o_orderpriority", "ne", "1-URGENT")),
    "cond_null": ("documents", "doc_id", C.Atom("nullable", "lang", "is_not_null") | C.Atom("nullable", "source", "is_null")),
    "cond_bool": ("labels", "doc_id", C.Atom("enum", "toxic", "not_in", (1,)) & C.Atom("num", "quality", "ne", 0)),
    "cond_text": ("customer", "c_custkey", C.Atom("text", "c_mktsegment", "startswith", "auto") | C.Atom("text", "c_name", "contains", "9")),
}


# Written by hand: what each condition means.
_CONDITION_SQL = {
    "cond_num": "l_quantity IS NOT NULL AND l_quantity >= 30 AND (l_discount IS NULL OR l_discount <> 0.05)",
    "cond_between": "p_retailprice IS NOT NULL AND p_retailprice >= 1000 AND p_retailprice < 1500",
    "cond_enum": "coalesce(o_orderstatus, '') IN ('F', 'O') AND coalesce(o_orderpriority, '') <> '1-URGENT'",
    "cond_null": "lang IS NOT NULL OR source IS NULL",
    "cond_bool": "coalesce(toxic, 0) <> 1 AND (quality IS NULL OR quality <> 0)",
    "cond_text": "coalesce(c_mktsegment, '') ILIKE 'auto%' OR coalesce(c_name, '') LIKE '%9%'",
    "cond_date_before": "coalesce(o_orderdate < TIMESTAMP '1998-01-01', false)",
    "cond_within_days": "coalesce(o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' + INTERVAL 181 DAY, false)",
    "cond_older_than": "coalesce(o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY, false)",
    "cond_tree": "(coalesce(o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 400 DAY, false) OR coalesce(o_totalprice > 200000, false)) AND coalesce(o_orderstatus, '') <> 'P'",
}


def _add_condition(name: str, table: str, keys: str, condition: C.Condition) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = [k.strip() for k in keys.split(",")]
        return read(spark, sf_dir, table).select(*columns, condition.column().alias("holds"))

    run.__name__ = name
    query(f"SELECT {keys}, {_CONDITION_SQL[name]} AS holds FROM {table}")(run)


for _name, (_table, _keys, _condition) in _CONDITIONS.items():
    _add_condition(_name, _table, _keys, _condition)

_DATES: dict[str, C.Condition] = {
    "cond_date_before": C.Atom("date", "o_orderdate", "before"),
    "cond_within_days": C.Atom("date", "o_orderdate", "within_days", 180),
    "cond_older_than": C.Atom("date", "o_orderdate", "older_than", 365),
    "cond_tree": (C.Atom("date", "o_orderdate", "older_than", 400) | C.Atom("num", "o_totalprice", "gt", 200000)) & ~C.Atom("enum", "o_orderstatus", "eq", "P"),
}


def _add_date(name: str, condition: C.Condition) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, "orders").withColumn("today", F.expr(TODAY)).select("o_orderkey", condition.column().alias("holds"))

    run.__name__ = name
    query(f"SELECT o_orderkey, {_CONDITION_SQL[name]} AS holds FROM orders")(run)


for _name, _condition in _DATES.items():
    _add_date(_name, _condition)


def _order_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"))


_LISTS = "(SELECT o_custkey, list(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_custkey)"
_COUNT = C.Atom("list", "priorities", "count_gte", 3)
_HAS = C.Atom("list", "priorities", "contains", "1-URGENT")


@query(f"SELECT o_custkey, coalesce(len(priorities), 0) >= 3 AS holds FROM {_LISTS}")
def cond_list_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_lists(spark, sf_dir).select("o_custkey", _COUNT.column().alias("holds"))


@query(f"SELECT o_custkey, coalesce(list_contains(priorities, '1-URGENT'), FALSE) AS holds FROM {_LISTS}")
def cond_list_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_lists(spark, sf_dir).select("o_custkey", _HAS.column().alias("holds"))


@query(
    "SELECT c_custkey, CASE WHEN c_acctbal >= 10000 THEN 'high_value' WHEN c_acctbal >= 100 THEN 'healthy' WHEN c_acctbal >= 0 THEN 'low_balance' WHEN c_acctbal IS NOT NULL THEN 'overdrawn' END AS band FROM customer"
)
def band_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", C.tier(F.col("c_acctbal"), [0, 100, 10000], ["overdrawn", "low_balance", "healthy", "high_value"]).alias("band"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'review' WHEN o_orderpriority = '1-URGENT' THEN 'rush' ELSE 'normal' END AS branch FROM orders")
def two_branch_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = C.two_branch(C.Atom("num", "o_totalprice", "gt", 300000), C.Atom("enum", "o_orderpriority", "eq", "1-URGENT"), ["review", "rush", "normal"])
    return read(spark, sf_dir, "orders").select("o_orderkey", branch.alias("branch"))


# --- rules -------------------------------------------------------------------------------------------------------------------

_RULE_VALUES = ", ".join(f"('{r}', '{op}', {float(a)})" for r, _, op, a, _ in R._rows(R.NUMERIC_RULES))


@query(
    f"SELECT p_partkey, rule, CASE op WHEN '>=' THEN p_size >= t WHEN '<=' THEN p_size <= t WHEN '>' THEN p_size > t WHEN '<' THEN p_size < t ELSE p_size = t END AS holds FROM part, (VALUES {_RULE_VALUES}) r(rule, op, t)"
)
def numeric_rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's size under each of the 47 rules."""
    return R.apply_numeric_rules(read(spark, sf_dir, "part", "p_partkey", "p_size"), R.numeric_rules(spark), "p_size").select("p_partkey", "rule", "holds")


@query(
    "WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) "
    "SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.s + 1800 AND b.s < a.s + 1800"
)
def overlap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour visits of one user that overlap."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).withColumn("e", F.col("s") + 1800)
    return R.overlapping_pairs(e, "user_id", "s", "e", "event_id", 1800)


@query("SELECT event_id, hour(ts) * 60 + minute(ts) >= 540 AND hour(ts) * 60 + minute(ts) < 1080 AS is_open FROM events")
def time_window_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", R.open_at(F.hour("ts") * 60 + F.minute("ts"), 9, 18).alias("is_open"))


@query(f"SELECT o_orderkey, coalesce({TODAY} > CAST(o_orderdate AS DATE), FALSE) AS overdue, coalesce({TODAY} <= CAST(o_orderdate AS DATE), FALSE) AS valid FROM orders")
def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    today, day = F.expr(TODAY), F.col("o_orderdate").cast("date")
    return read(spark, sf_dir, "orders").select("o_orderkey", R.date_rule(today, day, "after").alias("overdue"), R.date_rule(today, day, "until").alias("valid"))


_FACTS_SQL = (
    "SELECT event_id, CAST(event_id % 4 AS INTEGER) AS base, event_type = 'view' AND event_id % 7 = 0 AS noise, event_id % 3 = 0 AS rate_gated, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 0 END AS transient, "
    "CASE event_id % 3 WHEN 0 THEN 'code_bug' WHEN 1 THEN 'config' END AS failure, CASE WHEN user_id % 2 = 0 THEN 'production' ELSE 'staging' END AS environment, "
    "CASE WHEN user_id % 3 = 0 THEN 'critical' ELSE 'normal' END AS service_criticality, 10 AS alert_threshold_per_5m, CAST(event_id % 23 AS INTEGER) AS errors_last_5m, CAST(user_id % 150 AS INTEGER) AS users_affected, "
    "event_id % 11 = 0 AS matches_known_benign_pattern, event_id % 13 < 6 AS retry_succeeded, user_id % 5 < 2 AS started_after_latest_deploy FROM events"
)
_TRIAGE_SQL = (
    "n AS (SELECT *, noise OR matches_known_benign_pattern OR (rate_gated AND errors_last_5m < alert_threshold_per_5m) OR (coalesce(transient, FALSE) AND retry_succeeded AND errors_last_5m < alert_threshold_per_5m) AS is_noise FROM f), "
    "s AS (SELECT *, CASE WHEN is_noise THEN 0 ELSE least(CASE WHEN environment = 'production' THEN 3 ELSE 1 END, base + CASE WHEN errors_last_5m >= alert_threshold_per_5m OR users_affected >= 100 THEN 1 ELSE 0 END) END AS severity FROM n), "
    "p AS (SELECT *, environment = 'production' AND NOT is_noise AND (severity = 3 OR (severity = 2 AND service_criticality = 'critical')) AS page, NOT is_noise AND started_after_latest_deploy AND coalesce(failure IN ('code_bug', 'config'), FALSE) AS deploy FROM s), "
    "t AS (SELECT *, CASE WHEN is_noise THEN 'ignore' WHEN environment = 'production' AND deploy AND severity >= 2 THEN 'roll_back' WHEN page THEN 'page' ELSE 'ticket' END AS action FROM p)"
)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    return read(spark, sf_dir, "events").select(
        "event_id",
        (i % 4).cast("int").alias("base"),
        ((F.col("event_type") == "view") & (i % 7 == 0)).alias("noise"),
        (i % 3 == 0).alias("rate_gated"),
        F.when(i % 5 != 0, i % 2 == 0).alias("transient"),
        F.when(i % 3 == 0, "code_bug").when(i % 3 == 1, "config").alias("failure"),
        F.when(u % 2 == 0, "production").otherwise("staging").alias("environment"),
        F.when(u % 3 == 0, "critical").otherwise("normal").alias("service_criticality"),
        F.lit(10).alias("alert_threshold_per_5m"),
        (i % 23).cast("int").alias("errors_last_5m"),
        (u % 150).cast("int").alias("users_affected"),
        (i % 11 == 0).alias("matches_known_benign_pattern"),
        (i % 13 < 6).alias("retry_succeeded"),
        (u % 5 < 2).alias("started_after_latest_deploy"),
    )


_LOGINS_SQL = (
    f"SELECT *, CASE event_id % 3 WHEN 0 THEN '28P01' WHEN 1 THEN '40001' END AS template, CASE event_id % 4 WHEN 0 THEN '203.0.113.7' WHEN 1 THEN '10.0.3.7' WHEN 2 THEN '198.51.100.91' END AS source_ip, "
    f"CASE WHEN event_id % 6 < 5 THEN 'database' END AS team FROM ({_FACTS_SQL})"
)


@query(
    f"WITH f AS ({_LOGINS_SQL}), {_TRIAGE_SQL}, x AS (SELECT *, CASE WHEN template = '28P01' AND source_ip IN ('203.0.113.7', '198.51.100.23', '192.0.2.44', '203.0.113.150', '198.51.100.91') AND errors_last_5m >= 10 THEN 'security' ELSE team END AS of_team FROM t) "
    "SELECT event_id, of_team AS team, CASE WHEN NOT noise THEN of_team END AS gold_team, CASE WHEN NOT noise THEN failure END AS gold_kind, CASE WHEN NOT noise AND failure IS NOT NULL THEN CAST(deploy AS VARCHAR) END AS gold_deploy, "
    "CASE WHEN NOT noise THEN CAST(transient AS VARCHAR) END AS gold_retry, CAST(severity AS VARCHAR) AS gold_sev FROM x"
)
def login_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which team gets a log line, failed logins from outside among them, and the questions that its template lets be asked."""
    e = F.col("event_id")
    facts = _facts(spark, sf_dir).withColumns(
        {
            "template": F.when(e % 3 == 0, "28P01").when(e % 3 == 1, "40001"),
            "source_ip": F.get(F.array(*map(F.lit, ("203.0.113.7", "10.0.3.7", "198.51.100.91", None))), (e % 4).cast("int")),
            "team": F.when(e % 6 < 5, "database"),
        }
    )
    gold = R.triage_gold(R.triage(facts))
    return gold.select("event_id", "team", *[F.try_element_at("gold", F.lit(k)).alias(f"gold_{k}") for k in ("team", "kind", "deploy", "retry", "sev")])


@query(f"WITH f AS ({_FACTS_SQL}), {_TRIAGE_SQL} SELECT event_id, is_noise, severity, page, deploy, action FROM t")
def log_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.triage(_facts(spark, sf_dir)).select("event_id", "is_noise", "severity", "page", "deploy", "action")


@query(
    f"WITH f AS ({_FACTS_SQL}), {_TRIAGE_SQL}, a AS (SELECT event_id, action FROM t), b AS (WITH f AS (SELECT * REPLACE (NOT started_after_latest_deploy AS started_after_latest_deploy) FROM ({_FACTS_SQL})), {_TRIAGE_SQL} SELECT event_id, action AS flipped FROM t) "
    "SELECT event_id, action, flipped FROM a JOIN b USING (event_id) WHERE action <> flipped"
)
def near_miss_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose action changes when one fact is flipped."""
    return S.flipped(_facts(spark, sf_dir), "started_after_latest_deploy", "action", R.triage, "event_id")


# --- decisions ---------------------------------------------------------------------------------------------------------------


def _logits(spark: SparkSession, sf_dir: str, qtype: str) -> DataFrame:
    """Stand-in logits from a customer's columns; a real scorer is plugged in by ``score_with``."""
    i = F.col("c_custkey")
    z = [((i * k) % 17).cast("double") / 4.0 for k in ((3, 5, 7) if qtype != "noul" else (3, 5))]
    keys = {"choice": ["ship", "hold", "cancel"], "score": ["low", "medium", "high"], "noul": ["false", "true"]}[qtype]
    return read(spark, sf_dir, "customer", "c_custkey").select(
        "c_custkey", F.lit(qtype).alias("type"), F.array(*map(F.lit, keys)).alias("keys"), F.array(*z).alias("logits"), F.array(z[0], z[1]).alias("act")
    )


def _softmax_sql(factors: tuple[int, ...], t: float) -> str:
    zs = [f"(((c_custkey * {k}) % 17) / 4.0)" for k in factors]
    es = [f"exp(({z} - greatest({', '.join(zs)})) / {t})" for z in zs]
    ps = ", ".join(f"{e} / ({' + '.join(es)}) AS p{i}" for i, e in enumerate(es))
    return f"(SELECT c_custkey, {', '.join(f'{z} AS z{i}' for i, z in enumerate(zs))}, {ps} FROM customer)"


@query(
    f"SELECT c_custkey, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'ship' WHEN p1 >= p2 THEN 'hold' ELSE 'cancel' END AS choice, round(p0, 4) AS p_ship, round(greatest(p0, p1, p2), 4) AS confidence FROM {_softmax_sql((3, 5, 7), 1.0255)}"
)
def softmax_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decode(_logits(spark, sf_dir, "choice")).select("c_custkey", "choice", F.get("probabilities", F.lit(0)).alias("p_ship"), "confidence")


@query(f"SELECT c_custkey, round(p1 + 2 * p2, 4) AS score FROM {_softmax_sql((3, 5, 7), 1.0340)}")
def score_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decode(_logits(spark, sf_dir, "score")).select("c_custkey", "score")


@query(f"SELECT c_custkey, round(p1, 4) AS noul, round(greatest(p1, 1 - p1), 4) AS confidence FROM {_softmax_sql((3, 5), 1.1479)}")
def noul_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decode(_logits(spark, sf_dir, "noul")).select("c_custkey", "noul", "confidence")


@query("SELECT c_custkey, round(1 / (1 + exp(((c_custkey * 5) % 17) / 4.0 - ((c_custkey * 3) % 17) / 4.0)), 4) AS act_probability FROM customer")
def act_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decode(_logits(spark, sf_dir, "noul"), act="act").select("c_custkey", "act_probability")


_NOUL = _softmax_sql((3, 5), 1.1479)


@query(f"SELECT c_custkey, CASE WHEN p >= 0.8 THEN 'yes' WHEN p <= 0.2 THEN 'no' ELSE 'unsure' END AS verdict FROM (SELECT c_custkey, round(p1, 4) AS p FROM {_NOUL})")
def verdict_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noul_confidence(spark, sf_dir).select("c_custkey", D.noul_verdict(F.col("noul")).alias("verdict"))


@query(f"SELECT c_custkey FROM (SELECT c_custkey, round(p1, 4) AS p FROM {_NOUL}) WHERE p >= 0.8")
def filter_yes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_band(spark, sf_dir).where("verdict = 'yes'").select("c_custkey")


@query(
    f"SELECT c_mktsegment, c_custkey, CAST(r AS INTEGER) AS place FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(p1, 4) DESC, c_custkey) AS r FROM {_NOUL} JOIN customer USING (c_custkey)) WHERE r <= 3"
)
def rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 3 of each segment: a top-k report."""
    rows = noul_confidence(spark, sf_dir).join(read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), "c_custkey")
    from pyspark.sql import Window

    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("noul"), "c_custkey")
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 3").select("c_mktsegment", "c_custkey", "place")


@query(
    f"SELECT c_custkey, CASE WHEN round(greatest(p0, p1, p2), 4) >= 0.6 THEN CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'ship' WHEN p1 >= p2 THEN 'hold' ELSE 'cancel' END ELSE 'unsure' END AS picked FROM {_softmax_sql((3, 5, 7), 1.0255)}"
)
def pick_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decode(_logits(spark, sf_dir, "choice")).select("c_custkey", F.when(F.col("confidence") >= D.SURE, F.col("choice")).otherwise("unsure").alias("picked"))


_ANSWERS = (
    "(SELECT l.doc_id, d.lang, toxic = 1 AS gold, CASE WHEN l.doc_id % 10 < 8 THEN toxic = 1 ELSE toxic <> 1 END AS pred, "
    "CASE WHEN l.doc_id % 10 < 7 THEN toxic = 1 WHEN l.doc_id % 10 = 9 THEN toxic <> 1 END AS sure FROM labels l JOIN documents d USING (doc_id))"
)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as gold; predictions that are right for eight ids of ten and sure for eight of ten."""
    gold, i = F.col("toxic") == 1, F.col("doc_id")
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents", "doc_id", "lang", "source"), "doc_id")
    return rows.select("doc_id", "lang", "source", gold.alias("gold"), F.when(i % 10 < 8, gold).otherwise(~gold).alias("pred"), F.when(i % 10 < 7, gold).when(i % 10 == 9, ~gold).alias("sure"))


_SHARES = (
    "count(*) AS n, round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN sure = gold THEN 1.0 ELSE 0.0 END), 6) AS confident_right, round(avg(CASE WHEN sure <> gold THEN 1.0 ELSE 0.0 END), 6) AS confident_wrong"
)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"SELECT lang, {_SHARES} FROM {_ANSWERS} GROUP BY lang")
def gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.gate_metrics(_answers(spark, sf_dir), ["lang"]))


@query(f"SELECT lang, confident_right >= 0.9 AND confident_wrong <= 0.02 AS passed FROM (SELECT lang, {_SHARES} FROM {_ANSWERS} GROUP BY lang)")
def gate_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gate_failures(E.gate_metrics(_answers(spark, sf_dir), ["lang"])).select("lang", "passed")


@query(f"SELECT coalesce(lang, 'total') AS lang, count(*) AS n, round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {_ANSWERS} GROUP BY ROLLUP (lang)")
def per_type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.per_type_and_total(_answers(spark, sf_dir), "lang"))


@query(
    "WITH r AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), f AS (SELECT o_custkey, min(rank) AS rank FROM r WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) "
    "SELECT count(*) AS queries, round(avg(1.0 / rank), 6) AS mrr, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1 FROM f"
)
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").withColumn("relevant", F.col("o_orderpriority") == "1-URGENT")
    return _rounded(E.mean_reciprocal_rank(rows, "o_custkey", "o_totalprice", "relevant", "o_orderkey"))


_GRID = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0]


@query(
    "WITH z AS (SELECT c_mktsegment, ((c_custkey * 3) % 17) / 4.0 AS a, ((c_custkey * 5) % 17) / 4.0 AS b, c_custkey % 2 AS y FROM customer), "
    f"l AS (SELECT c_mktsegment, t, avg(ln(exp((a - greatest(a, b)) / t) + exp((b - greatest(a, b)) / t)) - (CASE WHEN y = 0 THEN a ELSE b END - greatest(a, b)) / t) AS loss, count(*) AS n FROM z, (SELECT unnest({_GRID}) AS t) GROUP BY 1, 2) "
    "SELECT c_mktsegment, max(n) AS n, CAST(CASE WHEN max(n) < 10 THEN 1.0 ELSE arg_min(t, round(loss, 9)) END AS DOUBLE) AS temperature, round(min(loss), 6) AS loss FROM l GROUP BY 1"
)
def temperature_grid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select("c_mktsegment", F.array(((i * 3) % 17).cast("double") / 4, ((i * 5) % 17).cast("double") / 4).alias("logits"), (i % 2).cast("int").alias("label"))
    return E.temperature_grid(rows, "c_mktsegment", "logits", "label", _GRID)


# --- audits ------------------------------------------------------------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stand-in judges of each labelled document; one abstains now and then."""
    i, gold = F.col("doc_id"), F.col("toxic")
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents", "doc_id", "source", "lang"), "doc_id")
    a = F.when(i % 50 == 0, 1 - gold).otherwise(gold)
    b = F.when(i % 9 == 0, 1 - gold).when(i % 31 != 0, gold)
    return rows.select("doc_id", "source", "lang", gold.alias("gold"), F.explode(F.create_map(F.lit("a"), a, F.lit("b"), b)).alias("judge", "verdict"))


_JUDGED = (
    "(SELECT doc_id, source, lang, toxic AS gold, judge, CASE WHEN judge = 'a' THEN CASE WHEN doc_id % 50 = 0 THEN 1 - toxic ELSE toxic END ELSE CASE WHEN doc_id % 9 = 0 THEN 1 - toxic WHEN doc_id % 31 <> 0 THEN toxic END END AS verdict "
    "FROM labels JOIN documents USING (doc_id), (VALUES ('a'), ('b')) j(judge))"
)
_TRUST = f"(SELECT judge, lang, count(*) AS n, avg(CASE WHEN verdict = gold THEN 1.0 ELSE 0.0 END) AS accuracy FROM {_JUDGED} GROUP BY 1, 2)"


@query(f"SELECT judge, lang, n, round(accuracy, 6) AS accuracy, n >= 50 AND accuracy >= 0.9 AS trusted FROM {_TRUST}")
def calibration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.calibration_table(_judged(spark, sf_dir), ["judge", "lang"]))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir)
    trusted = E.calibration_table(judged, ["judge", "lang"]).where("trusted").select("judge", "lang", F.lit(True).alias("ok"))
    against = F.count_if(F.col("ok") & (F.col("verdict") != F.col("gold")))
    return judged.join(trusted, ["judge", "lang"], "left").groupBy("doc_id", "source").agg(against.alias("against")).withColumn("verdict", E.audit_verdict(F.col("against")))


_VERDICTS = (
    f"(SELECT doc_id, source, CASE WHEN c >= 2 THEN 'BAD' WHEN c = 1 THEN 'SUSPECT' ELSE 'OK' END AS verdict FROM (SELECT doc_id, source, count(*) FILTER (WHERE t.n >= 50 AND t.accuracy >= 0.9 AND verdict <> gold) AS c FROM {_JUDGED} j JOIN {_TRUST} t ON j.judge = t.judge AND j.lang = t.lang GROUP BY 1, 2))"
)


@query(f"SELECT doc_id, verdict FROM {_VERDICTS}")
def verdict_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("doc_id", "verdict")


@query(
    f"SELECT source, count(*) AS n, count(*) FILTER (WHERE verdict = 'BAD') AS bad, count(*) FILTER (WHERE verdict = 'SUSPECT') AS suspect, round(count(*) FILTER (WHERE verdict = 'BAD') / CAST(count(*) AS DOUBLE), 4) AS bad_rate, "
    f"CASE WHEN count(*) FILTER (WHERE verdict = 'BAD') / CAST(count(*) AS DOUBLE) >= 0.15 THEN 'REVIEW' ELSE 'KEEP' END AS decision FROM {_VERDICTS} GROUP BY source"
)
def review_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.review_sources(_verdicts(spark, sf_dir))


@query(
    "SELECT source, CASE WHEN n < 20 THEN 'INSUFFICIENT' WHEN bad / n >= 0.25 OR unclear / n >= 0.4 THEN 'DROP' WHEN bad / n >= 0.1 THEN 'REVIEW' ELSE 'KEEP' END AS decision FROM "
    "(SELECT source, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE quality = 0) AS bad, count(*) FILTER (WHERE toxic = 1) AS unclear FROM labels JOIN documents USING (doc_id) GROUP BY source)"
)
def source_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents", "doc_id", "source"), "doc_id")
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("toxic") == 1).alias("unclear"))
    return counts.select("source", E.source_decision(F.col("n"), F.col("bad"), F.col("unclear")).alias("decision"))


@query(
    "WITH k AS (SELECT doc_id, lower(trim(text)) AS state, toxic FROM documents JOIN labels USING (doc_id)), f AS (SELECT state, arg_min(toxic, doc_id) AS first_answer FROM k GROUP BY state) "
    "SELECT doc_id, first_answer, toxic IS DISTINCT FROM first_answer AS conflict FROM k JOIN f USING (state)"
)
def contradiction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.sha2(F.lower(F.trim("text")).cast("binary"), 256).alias("state"), "toxic")
    return O.contradictions(rows, ["state"], "toxic", "doc_id").select("doc_id", "first_answer", "conflict")


@query(
    "WITH c AS (SELECT source, quality, count(*) AS c FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2) SELECT source, CAST(sum(c) AS BIGINT) AS n, string_agg(quality || '=' || c, ', ' ORDER BY c DESC, quality) AS counts, "
    "round(max(c) / CAST(sum(c) AS DOUBLE), 4) AS top_share, sum(c) < 20 AS few, sum(c) > 1 AND max(c) / CAST(sum(c) AS DOUBLE) > 0.8 AS one_sided FROM c GROUP BY source"
)
def label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.label_report(read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents", "doc_id", "source"), "doc_id"), "source", "quality")


# --- shaping -----------------------------------------------------------------------------------------------------------------

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PRIORITY_SQL = "[" + ", ".join(f"'{p}'" for p in _PRIORITIES) + "]"


def _target() -> Column:
    return F.transform(F.array(*map(F.lit, _PRIORITIES)), lambda k: F.when(k == F.col("o_orderpriority"), 1.0).otherwise(0.0))


@query(f"SELECT o_orderkey, CASE WHEN list_position({_PRIORITY_SQL}, o_orderpriority) > 0 THEN list_position({_PRIORITY_SQL}, o_orderpriority) - 1 END AS label FROM orders")
def one_hot_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", D.hard_position(_target()).alias("label"))


@query(f"SELECT o_orderkey, k AS option, CAST(CASE WHEN k = o_orderpriority THEN 0.9 ELSE 0.025 END AS DOUBLE) AS p FROM orders, (SELECT unnest({_PRIORITY_SQL}) AS k) WHERE list_contains({_PRIORITY_SQL}, o_orderpriority)")
def spread_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(*map(F.lit, _PRIORITIES))
    at = D.gold_position(F.lit("choice"), keys, F.col("o_orderpriority"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", keys.alias("keys"), D.spread(at, F.size(keys), D.peak_of(F.lit("imported"))).alias("p"))
    return rows.where("p is not null").select("o_orderkey", F.inline(F.arrays_zip("keys", "p"))).toDF("o_orderkey", "option", "p")


@query(f"SELECT o_orderkey, k AS hypothesis, CASE WHEN k = o_orderpriority THEN 1 ELSE 2 END AS label FROM orders, (SELECT unnest({_PRIORITY_SQL}) AS k)")
def mc_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.option_pairs(read(spark, sf_dir, "orders"), ["o_orderkey"], F.array(*map(F.lit, _PRIORITIES)), F.col("o_orderpriority"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'documents' AS kind FROM documents UNION ALL SELECT 'pages' FROM pages UNION ALL SELECT 'benchmark' FROM benchmark UNION ALL SELECT 'conversations' FROM conversations) GROUP BY kind")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [read(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(c).alias("text")) for t, c in (("documents", "text"), ("pages", "html"), ("benchmark", "text"), ("conversations", "text"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT CAST(count(*) AS BIGINT) AS customers, CAST(count(*) FILTER (WHERE o) AS BIGINT) AS with_orders, CAST(count(*) FILTER (WHERE NOT o) AS BIGINT) AS without FROM (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS o FROM customer)"
)
def set_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer", "c_custkey").distinct()
    b = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(a, "customers").join(n(a.intersect(b), "with_orders")).join(n(a.exceptAll(b), "without"))


@query(
    "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations"
)
def carry_forward_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.when(F.col("role") == "user", F.col("text"))
    return O.carry_forward(read(spark, sf_dir, "conversations"), "conv_id", "turn", heading).select("conv_id", "turn", "heading")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do if the clicks are already in the checkpoint."""
    rows = read(spark, sf_dir, "events", "event_id", "event_type")
    return O.anti(rows.select("event_id"), rows.where("event_type = 'click'").select("event_id"), "event_id")


# --- request metrics ---------------------------------------------------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.col("value").alias("ms"), F.when(F.col("event_id") % 20 == 0, "failed").alias("error"))


@query("SELECT count(*) AS requests, count(*) FILTER (WHERE event_id % 20 = 0) AS errors, round(sum(value), 2) AS ms_sum, round(avg(value), 4) AS ms_avg FROM events")
def request_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.request_totals(_log(spark, sf_dir))


@query("SELECT event_type, count(*) AS requests, count(*) FILTER (WHERE event_id % 20 = 0) AS errors, round(sum(value), 2) AS ms_sum, round(avg(value), 4) AS ms_avg FROM events GROUP BY event_type")
def per_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.request_totals(_log(spark, sf_dir), ["event_type"])


_Q = "list_sort(list(value))[1 + CAST(floor({} * (count(value) - 1)) AS BIGINT)]"


@query(f"SELECT event_type, count(value) AS n, {_Q.format(0.5)} AS p50, {_Q.format(0.95)} AS p95, {_Q.format(0.99)} AS p99, {_Q.format(1.0)} AS top FROM events WHERE value IS NOT NULL GROUP BY event_type")
def floor_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.floor_quantiles(_log(spark, sf_dir), ["event_type"], "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "top": 1.0})


@query("SELECT event_id, value AS ms FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def last_n_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 200 requests: the limit is the operator."""
    return E.last_n(_log(spark, sf_dir), [F.desc("ts"), F.desc("event_id")], 200).select("event_id", "ms")


@query(
    "SELECT unnest(['engine_requests ' || CAST(count(*) AS VARCHAR), 'engine_errors ' || CAST(count(*) FILTER (WHERE event_id % 20 = 0) AS VARCHAR)]) AS line FROM events"
)
def prometheus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.exposition(E.request_totals(_log(spark, sf_dir)).select("requests", "errors"), "engine")


@query()
def scorer_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugged-in scorer (text lengths as logits) and the decode of its answers."""
    import pandas as pd

    def lengths(texts: pd.Series, options: pd.Series) -> pd.Series:
        return pd.Series([[float(len(t or "") % (7 + i)) for i in range(len(o))] for t, o in zip(texts, options, strict=True)])

    rows = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", "text", F.lit("choice").alias("type"), F.array(F.lit("keep"), F.lit("drop")).alias("keys"))
    return D.decode(D.score_with(rows, lengths, "text", "keys")).select("doc_id", "choice", "confidence")
