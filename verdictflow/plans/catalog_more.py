"""More queries over the reference's operators: shaping, functions by kind, joins of stages and judges, catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.functions import decisions as D
from verdictflow.functions import text as T
from verdictflow.operators import datasets as O
from verdictflow.operators import domains as B
from verdictflow.operators import normalize as N
from verdictflow.operators import shaping as S
from verdictflow.plans.catalog import TODAY, query, read

# --- catalogs ----------------------------------------------------------------------------------------------------------------

_BANDS = ", ".join(f"('{d.name}', {list(d.thresholds)}, {list(d.labels)})" for d in B.domains())


@query(f"SELECT c_custkey, domain, labels[len(list_filter(th, lambda t: c_acctbal >= t)) + 1] AS band FROM customer, (VALUES {_BANDS}) d(domain, th, labels)")
def domain_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account balance in the bands of the 43 domains."""
    return B.apply_bands(read(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), B.band_table(spark), "c_acctbal").select("c_custkey", "domain", "band")


@query(
    f"SELECT o_orderkey, CASE WHEN coalesce(order_total_usd >= 50, FALSE) THEN 'first' WHEN payment_status IS NOT DISTINCT FROM 'paid' THEN 'second' ELSE 'neither' END AS branch FROM "
    "(SELECT o_orderkey, o_totalprice / 1000 AS order_total_usd, CASE WHEN o_orderstatus = 'F' THEN 'paid' END AS payment_status FROM orders)"
)
def domain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two rules of one domain over orders shaped as its states."""
    d = next(x for x in B.domains() if x.name == "ecommerce_orders")
    states = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("order_total_usd"), F.when(F.col("o_orderstatus") == "F", "paid").alias("payment_status"))
    return states.select("o_orderkey", d.branch().alias("branch"))


# --- shaping -----------------------------------------------------------------------------------------------------------------


@query(
    r"SELECT doc_id, trim(text, ' ') AS premise, lang AS hypothesis, least(greatest(CAST(doc_id % 5 - 1 AS INTEGER), 0), 2) AS label FROM documents WHERE trim(text, ' ') <> '' AND lang <> '' AND regexp_full_match(substr(trim(text, ' '), 1, 500), '[\x00-\x7F]*')"
)
def flat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return N.flat_pairs(docs, F.col("text"), F.col("lang"), (F.col("doc_id") % 5 - 1).cast("string"), "documents", ["doc_id"]).drop("source")


@query("SELECT conv_id, turn, code, label FROM (SELECT conv_id, turn, text AS code, TRUE AS label FROM conversations UNION ALL SELECT conv_id, turn, role, FALSE FROM conversations)")
def before_after_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.before_after(read(spark, sf_dir, "conversations", "conv_id", "turn", "text", "role"), "text", "role")


@query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS option FROM part")
def parsed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types read as option lists (blanks for bars)."""
    options = D.parse_options(F.replace(F.col("p_type"), F.lit(" "), F.lit("|")))
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(F.transform(options, lambda o: o["key"])).alias("option"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'true' WHEN o_orderstatus = 'O' THEN 'false' END AS label, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END AS position FROM orders"
)
def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "0").otherwise("maybe")
    keys = F.array(F.lit("false"), F.lit("true"))
    return read(spark, sf_dir, "orders").select("o_orderkey", D.truth_label(word).alias("label"), D.gold_position(F.lit("noul"), keys, F.trim(word)).alias("position"))


@query("SELECT c_custkey, round(a / (a + b + c), 6) AS p0, round(c / (a + b + c), 6) AS p2 FROM (SELECT c_custkey, 1.0 + c_custkey % 3 AS a, 1.0 + c_custkey % 5 AS b, 1.0 + c_custkey % 7 AS c FROM customer)")
def normalized_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    p = D.normalized(F.array(*[(i % k + 1).cast("double") for k in (3, 5, 7)]))
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(F.get(p, F.lit(0)), 6).alias("p0"), F.round(F.get(p, F.lit(2)), 6).alias("p2"))


# --- joins -------------------------------------------------------------------------------------------------------------------


@query(
    "WITH a AS (SELECT doc_id, quality AS first_stage FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, toxic AS second_stage FROM labels WHERE doc_id % 2 = 0) SELECT doc_id, first_stage, second_stage FROM a FULL JOIN b USING (doc_id)"
)
def stage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of two stages, each over its own share of the items, side by side."""
    rows = read(spark, sf_dir, "labels")
    a = rows.where("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("first_stage"))
    return S.stage_outcomes(a, rows.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("second_stage")), ["doc_id"], ("first_stage", "second_stage"))


@query("SELECT d.doc_id, a.quality AS judge_a, b.toxic AS judge_b, coalesce(a.quality, b.toxic, -1) AS used FROM documents d LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN (SELECT * FROM labels WHERE toxic = 1) b ON b.doc_id = d.doc_id")
def two_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, labels = read(spark, sf_dir, "documents", "doc_id"), read(spark, sf_dir, "labels")
    out = S.two_judges(items, labels.select("doc_id", F.col("quality").alias("judge_a")), labels.where("toxic = 1").select("doc_id", F.col("toxic").alias("judge_b")), "doc_id", ("judge_a", "judge_b"))
    return out.select("doc_id", "judge_a", "judge_b", F.coalesce("judge_a", "judge_b", F.lit(-1)).alias("used"))


@query(r"SELECT page_id, key, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(url, '[0-9]+')) AS key FROM pages) GROUP BY 1, 2")
def extracted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in a line, by regular expression."""
    return S.extracted_keys(read(spark, sf_dir, "pages", "page_id", "url"), "page_id", "url", "[0-9]+")


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS kept FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY o_custkey")
def leaked_questions_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the questions of a customer's row; those with a known key are dropped, rows left empty go."""
    orders = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    rows = orders.groupBy(F.col("o_custkey").alias("row_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("questions"))
    leaked = orders.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("key"))
    return O.drop_questions(rows, leaked, F.col("question")).select(F.col("row_id").alias("o_custkey"), F.col("questions").alias("kept"))


# --- functions ---------------------------------------------------------------------------------------------------------------


@query(
    r"SELECT doc_id, replace(replace(text, '[MASK]', ' '), chr(27), '') AS unmasked, CASE WHEN regexp_extract(text, '^(.+?[.!?])(\s|$)', 1) <> '' THEN substr(regexp_extract(text, '^(.+?[.!?])(\s|$)', 1), 1, 300) ELSE substr(text, 1, 300) END AS sentence FROM documents"
)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.replace(T.unmask(t), F.lit("\x1b"), F.lit("")).alias("unmasked"), T.first_sentence(t).alias("sentence"))


@query(
    f"SELECT o_orderkey, CAST({TODAY} - CAST(o_orderdate AS DATE) AS INTEGER) AS age_days, date_trunc('month', o_orderdate)::DATE - 1 AS month_end, printf('%02d:%02d', CAST(o_orderkey % 1440 // 60 AS INTEGER), CAST(o_orderkey % 60 AS INTEGER)) AS clock FROM orders"
)
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    m = (F.col("o_orderkey") % 1440).cast("int")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.datediff(F.expr(TODAY), day).alias("age_days"), F.date_sub(F.trunc(day, "MM"), 1).alias("month_end"), T.clock(m).alias("clock"))


@query(
    "SELECT c_custkey, round(c_acctbal / pow(10, length(CAST(abs(CAST(trunc(c_acctbal) AS BIGINT)) AS VARCHAR)) - 2)) * pow(10, length(CAST(abs(CAST(trunc(c_acctbal) AS BIGINT)) AS VARCHAR)) - 2) AS nice, round(greatest(abs(c_custkey % 3 - c_custkey % 5), abs(c_custkey % 7 - 2)), 4) AS gap FROM customer"
)
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds rounded to their magnitude; the largest difference of two vectors."""
    v, i = F.col("c_acctbal"), F.col("c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", S.nice(v).alias("nice"), S.largest_gap(F.array(i % 3, i % 7), F.array(i % 5, F.lit(2))).alias("gap"))


@query(
    "SELECT p_partkey, list_concat([p_size % 10, p_size % 7], list_value(0, 0)) AS padded, list_contains([p_size % 10, p_size % 7], 3) AS has_three, list_sort(list_distinct([p_size % 10, p_size % 7])) AS both FROM part"
)
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array(F.col("p_size") % 10, F.col("p_size") % 7)
    return read(spark, sf_dir, "part").select("p_partkey", S.padded(a, 4).alias("padded"), F.array_contains(a, 3).alias("has_three"), F.sort_array(F.array_distinct(a)).alias("both"))


@query("SELECT p_partkey, [p_size, p_partkey % 10, 0] > [25, 5, 9] AS newer FROM part")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"), F.lit("0"))
    return read(spark, sf_dir, "part").select("p_partkey", (T.version(text) > T.version(F.lit("25.5.9"))).alias("newer"))


@query("SELECT p_partkey, CASE WHEN h < 0.2 THEN 24 WHEN h < 0.4 THEN 26 ELSE p_size END AS sampled FROM (SELECT p_partkey, p_size, CAST(CAST('0x' || substr(sha256('s' || CAST(p_partkey AS VARCHAR)), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0 AS h FROM part)")
def boundary_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fifths of the values one step beside a threshold (25), by hashed uniforms."""
    return read(spark, sf_dir, "part").select("p_partkey", S.near_threshold(F.col("p_partkey"), F.col("p_size"), 25).alias("sampled"))


@query(
    "SELECT c_custkey, round(ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) - (a - greatest(a, b)), 6) AS loss, round(1.5 * (ln(pa) - ln(1 - pa)), 6) AS recovered FROM (SELECT *, exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS pa FROM (SELECT c_custkey, ((c_custkey * 3) % 17) / 4.0 AS a, ((c_custkey * 5) % 17) / 4.0 AS b FROM customer))"
)
def loss_and_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy of the first option, and the difference of logits recovered from probabilities."""
    i = F.col("c_custkey")
    p: Column = D.softmax(F.array(((i * 3) % 17).cast("double") / 4, ((i * 5) % 17).cast("double") / 4))
    first, second = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(S.cross_entropy(p, F.lit(0)), 6).alias("loss"), F.round(S.logit_gap(first, second, 1.5), 6).alias("recovered"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "source", "lang").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, coalesce(count(*) FILTER (WHERE toxic = 0), 0) AS clean, coalesce(count(*) FILTER (WHERE toxic = 1), 0) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def gold_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents", "doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, lang, count(*) AS n_rows FROM documents GROUP BY lang")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdictflow.sources.writers import manifest as build

    return build(read(spark, sf_dir, "documents", "lang", "text"), ["lang"], "text").select("bytes", "lang", F.col("rows").alias("n_rows"))


@query(
    "WITH i AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, role, text FROM conversations), t AS (SELECT DISTINCT role, text, sha256(text) AS d FROM i), "
    "r AS (SELECT role, text, coalesce(lead(text) OVER (PARTITION BY role ORDER BY d), first(text) OVER (PARTITION BY role ORDER BY d)) AS n FROM t), "
    "f AS (SELECT text, row_number() OVER (ORDER BY d) AS k FROM (SELECT DISTINCT text, d FROM t)) "
    "SELECT id, CASE WHEN n <> r.text THEN n ELSE (SELECT arg_min(f.text, f.k) FROM f WHERE f.text <> r.text) END AS negative FROM i JOIN r ON r.role = i.role AND r.text = i.text"
)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id")
    return N.hard_negatives(read(spark, sf_dir, "conversations").select(ident, "role", "text"), "role", "id", "text")
