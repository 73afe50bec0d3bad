"""Queries over sources: CSV records, converters and typed records, each with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.operators import typed_records as T
from verdictflow.plans.catalog import query, read
from verdictflow.sources import csv_records as R
from verdictflow.sources import readers

# One CSV file for each customer: a record for each order, every third with a line break in its state, every seventh with a cell too many,
# every eleventh with blank cells only; every fifth customer's file lacks the column ``answer``.
_LINES = """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r,
  sum(CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 3 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS line FROM orders)
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    state = F.concat(F.lit('"total, '), F.col("o_orderpriority"), F.when(key % 3 == 0, F.lit("\n")).otherwise(F.lit(" ")), F.lit('""'), key.cast("string"), F.lit('"""'))
    full = F.concat(state, F.lit(",Is it late?, "), F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "No").otherwise("perhaps"), F.when(key % 7 == 0, F.lit(",more")).otherwise(F.lit("")))
    line = F.when(key % 11 == 0, F.lit(" ,,")).otherwise(full)
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("x"))
    header = F.concat(F.lit("﻿State , QUESTION,"), F.when(F.col("o_custkey") % 5 == 0, "verdict").otherwise("Answer"))
    return rows.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file"), F.concat_ws("\r\n", header, F.array_join(F.transform("x", lambda r: r["line"]), "\r\n")).alias("content"))


@query(
    _LINES + "SELECT 'c' || CAST(o_custkey AS VARCHAR) AS file, r AS record, line - CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS first_line, CAST(line AS BIGINT) AS line, "
    "CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'total, ' || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) ELSE ' ' END || '\"' || CAST(o_orderkey AS VARCHAR) || '\"' END AS state, "
    "CAST(CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 = 0 THEN 4 ELSE 3 END AS INTEGER) AS cells FROM o"
)
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of every file with its place."""
    return R.csv_records(_files(spark, sf_dir)).where("record > 0").select("file", "record", "first_line", "line", F.get("cells", F.lit(0)).alias("state"), F.size("cells").alias("cells"))


@query(
    _LINES + "SELECT 'c' || CAST(o_custkey AS VARCHAR) AS file, CAST(line AS BIGINT) AS line, CASE WHEN o_orderkey % 7 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' END END AS label, "
    "CASE WHEN o_orderkey % 7 = 0 THEN 'row has more cells than the header (1 extra)' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'answer fits no option' ELSE '' END AS errors FROM o WHERE o_orderkey % 11 <> 0 AND o_custkey % 5 <> 0 "
    "UNION ALL SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR), CAST(1 AS BIGINT), NULL, 'no column answer' FROM orders WHERE o_custkey % 5 = 0"
)
def csv_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision rows of the same files, with ragged records, files without a required column and answers that fit no option flagged."""
    rows = readers.decisions_of_records(R.csv_records(_files(spark, sf_dir)))
    return rows.select("file", "line", "label", F.array_join("errors", "; ").alias("errors"))


T.register("documents", T.Converter("D", "documents", "text_quality", {"text": T.text("text"), "lang": T.text("lang"), "n_chars": T.number("n_chars")}, ("lang", "text"), (
    T.Question("toxic", "noul", "Is the text toxic?", "toxic", (), {"0": "false", "1": "true"}),
    T.Question("lang", "choice", "Which language is it?", "lang", ("en", "de", "fr")),
)))
T.register("conversations", T.Converter("E", "conversations", "speaker", {"text": T.text("text"), "turn": T.number("turn")}, ("text",), (T.Question("role", "choice", "Who speaks?", "role", ("user", "assistant")),)))
T.register("pages", T.Converter("F", "pages", "depth", {"url": T.text("url", "page_id"), "page_id": T.number("page_id")}, ("url",), (T.Question("depth", "score", "How deep is the page?", "depth", ("top", "one", "two", "three")),)))


@query(
    "WITH d AS (SELECT doc_id, lang, text, toxic FROM documents LEFT JOIN labels USING (doc_id)) "
    "SELECT CAST(doc_id AS VARCHAR) AS row_id, sha256(text) AS state, 'toxic' AS qid, 'noul' AS type, CASE toxic WHEN 0 THEN 'false' WHEN 1 THEN 'true' END AS label, CASE WHEN trim(lang || text, ' ') = '' THEN 'empty state' WHEN toxic IS NULL THEN 'no gold' END AS error FROM d "
    "UNION ALL SELECT CAST(doc_id AS VARCHAR), sha256(text), 'lang', 'choice', CASE WHEN lang IN ('en', 'de', 'fr') THEN lang END, CASE WHEN trim(lang || text, ' ') = '' THEN 'empty state' WHEN lang IS NULL THEN 'no gold' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'gold fits no option' END FROM d"
)
def documents_to_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents", "doc_id", "lang", "text", "n_chars").join(read(spark, sf_dir, "labels", "doc_id", "toxic"), "doc_id", "left")
    return T.decisions(rows, "documents", "doc_id").select("row_id", F.sha2(F.get_json_object("state", "$.text").cast("binary"), 256).alias("state"), "qid", "type", "label", "error")


@query("SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS row_id, text AS state, CASE WHEN role IN ('user', 'assistant') THEN role END AS label, CASE WHEN trim(text, ' ') = '' THEN 'empty state' WHEN role NOT IN ('user', 'assistant') THEN 'gold fits no option' END AS error FROM conversations")
def conversations_to_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").withColumn("row", F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")))
    return T.decisions(rows, "conversations", "row").select("row_id", "state", "label", "error")


@query(
    "WITH p AS (SELECT page_id, url, len(regexp_extract_all(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/[^/]+')) AS d FROM pages) "
    "SELECT CAST(page_id AS VARCHAR) AS row_id, url AS state, CASE WHEN d < 4 THEN CAST(d AS VARCHAR) END AS label, CASE WHEN d >= 4 THEN 'gold fits no option' END AS error FROM p"
)
def pages_to_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = F.size(F.regexp_extract_all(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), F.lit("/[^/]+"), 0))
    return T.decisions(read(spark, sf_dir, "pages", "page_id", "url").withColumn("depth", depth), "pages", "page_id").select("row_id", "state", "label", "error")


@query(
    "WITH c AS (SELECT conv_id, turn, role, text, (conv_id + turn) % 4 AS k FROM conversations) SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS source, "
    "CASE WHEN k = 1 THEN 'work' ELSE 'general' END AS domain, trim(text, ' ') AS state, CASE WHEN k = 3 THEN '' ELSE 'who:choice' END AS questions, CASE WHEN k = 3 THEN '' ELSE 'who:' || role END AS gold, "
    "CASE WHEN k = 3 THEN 'no question with gold' WHEN NOT regexp_full_match(substr(trim(text, ' ') || ' Who? {\"user\": \"user\", \"assistant\": \"assistant\"}', 1, 500), '[\\x00-\\x7F]*') THEN 'not English' END AS error FROM c"
)
def typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as JSON records of four shapes (questions as object or text, gold plain, as ``{label}`` or missing) in one form."""
    k = (F.col("conv_id") + F.col("turn")) % 4
    asked = F.lit('{"who": {"type": "Choice", "instructions": "Who?", "criteria": ["user", "assistant"]}, "else": {"type": "noul"}}')
    plain = F.concat(F.lit('{"who": "'), F.col("role"), F.lit('", "else": null}'))
    labelled = F.concat(F.lit('{"who": {"label": "'), F.col("role"), F.lit('", "probabilities": [1, 0]}}'))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'^\{"x":(.*)\}$', 1)
    value = F.concat(
        F.lit('{"state": '), quoted(F.concat(F.lit("  "), F.col("text"), F.lit(" "))), F.lit(', "questions": '), F.when(k == 0, quoted(asked)).otherwise(asked),
        F.lit(', "gold": '), F.when(k == 0, quoted(plain)).when(k == 1, plain).when(k == 2, labelled).otherwise(F.lit("{}")), F.when(k == 1, F.lit(', "domain": "", "workflow": "work"}')).otherwise(F.lit("}")),
    )
    rows = read(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("source"), value.alias("value"))
    listed = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit(":"), x[b])), ",")
    return T.typed_records(rows).select("source", "domain", "state", listed("questions", "qid", "type").alias("questions"), listed("gold", "qid", "label").alias("gold"), "error")
