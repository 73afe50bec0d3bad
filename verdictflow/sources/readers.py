"""Readers of decision data: JSON lines, CSV, test files, raw logs and Markdown lists. All are DataFrame scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.functions.decisions import parse_options, truth_label
from verdictflow.functions.text import squeeze
from verdictflow.operators.containment import first_contained
from verdictflow.operators.datasets import split_by_hash
from verdictflow.sources.csv_records import named_cells, read_csv_records

REQUIRED = ("state", "question", "answer")
# Other names of the yes/no question type.
NOUL_NAMES = ("noul", "yes/no", "yesno", "bool", "boolean")


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row for each line that is JSON (plain or .gz by name); blank and broken lines are dropped.

    Without a schema the row is (value, data VARIANT)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if schema is None:
        return lines.withColumn("data", F.try_parse_json("value")).where("data is not null")
    parsed = lines.withColumn("data", F.from_json("value", schema, {"mode": "PERMISSIVE"})).where(F.try_parse_json("value").isNotNull())
    return parsed.select("data.*")


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return df.select(*columns) if columns else df


def read_decisions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Decision rows of CSV files with ``file``, ``line`` (where the record ends; the header is line 1) and ``errors``; see ``build_decisions``.

    Header names are trimmed and lower-cased, a byte order mark is ignored. A file without a required column is one row with an error for each;
    a record with more cells than the header has that error only. Records of blank cells are left out."""
    return decisions_of_records(read_csv_records(spark, path))


def decisions_of_records(records: DataFrame) -> DataFrame:
    named = named_cells(records, REQUIRED, ("type", "options", "split", "source"))
    out = build_decisions(named)
    bad = F.size("flaws") > 0
    return out.withColumns({"errors": F.when(bad, F.col("flaws")).otherwise(F.col("errors")), "label": F.when(~bad, F.col("label"))}).drop("flaws", "record")


def question_type(c: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when((t == "") | t.isin(*NOUL_NAMES), "noul").otherwise(t)


def build_decisions(rows: DataFrame) -> DataFrame:
    """CSV records to decisions: type, criteria, label, split and the errors of each record (empty if it is usable)."""
    out = rows.withColumns({"type": question_type(F.col("type")), "criteria": F.when(F.trim("options") != "", parse_options(F.col("options")))})
    keys = F.transform("criteria", lambda c: c["key"])
    answer = F.trim(F.coalesce("answer", F.lit("")))
    by_name = F.get(F.filter(keys, lambda k: F.lower(k) == F.lower(answer)), F.lit(0))
    label = F.when(F.col("type") == "noul", truth_label(answer)).otherwise(by_name)
    state = F.trim(F.coalesce("state", F.lit("")))
    listed = F.col("type").isin("choice", "score")
    errors = F.array(
        F.when(state == "", F.lit("empty state")),
        F.when(F.startswith(state, F.lit("{")) & F.try_parse_json(state).isNull(), F.lit("state is not valid JSON")),
        F.when(F.regexp_replace(state, r"\s", "") == "{}", F.lit("state is an empty object")),
        F.when(F.trim(F.coalesce("question", F.lit(""))) == "", F.lit("empty question")),
        F.when(~F.col("type").isin("noul", "choice", "score"), F.lit("unknown type")),
        F.when(listed & (F.coalesce(F.size(keys), F.lit(0)) < 2), F.lit("fewer than two options")),
        F.when(listed & F.exists(keys, lambda k: k == ""), F.lit("empty option name")),
        F.when(listed & (F.size(F.array_distinct(keys)) < F.size(keys)), F.lit("repeated option")),
        F.when(F.col("type").isin("noul", "choice", "score") & label.isNull(), F.lit("answer fits no option")),
        F.when(F.col("split").isNotNull() & (F.trim("split") != "") & ~F.lower(F.trim("split")).isin("train", "test", "gate"), F.lit("unknown split")),
    )
    out = out.withColumns({"label": label, "errors": F.array_compact(errors), "source": F.coalesce("source", F.lit("your-data"))})
    explicit = F.when(F.trim("split") != "", F.lower(F.trim("split")))
    return split_by_hash(out.withColumn("_given", explicit).drop("split"), state, F.trim("question"), F.col("_given")).drop("_given")


def read_test_questions(spark: SparkSession, path: str) -> DataFrame:
    """(file, state, instructions, type) of a test file: CSV, a JSON list, or JSON lines. CSV rows match any type (``*``)."""
    name = F.input_file_name().alias("file")
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        kind = F.coalesce("type", F.lit("*")) if "type" in rows.columns else F.lit("*")
        return rows.select(name, "state", F.col("instructions" if "instructions" in rows.columns else "question").alias("instructions"), kind.alias("type"))
    schema = "state string, questions map<string, struct<type:string, instructions:string>>"
    if path.endswith(".json"):
        rows = spark.read.option("wholetext", True).text(path).select(name, F.inline(F.from_json("value", f"array<struct<{schema.replace('state string', 'state:string').replace('questions map', 'questions:map')}>>")))
    else:
        rows = spark.read.text(path).select(name, F.from_json("value", schema).alias("d")).where("d is not null").select("file", "d.*")
    flat = rows.select("file", "state", F.explode("questions").alias("qid", "q"))
    return flat.select("file", "state", F.col("q.instructions").alias("instructions"), F.coalesce("q.type", F.lit("noul")).alias("type"))


def read_log_lines(spark: SparkSession, path: str, fields: int = 10) -> DataFrame:
    """(alert, message, parts): space-separated log lines of at most ``fields`` parts; the first tells the alert, ``-`` none."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", " ", fields).alias("parts"))
    alert = F.get("parts", F.lit(0))
    return rows.select(F.when(alert != "-", alert).alias("alert"), F.get("parts", F.lit(fields - 1)).alias("message"), "parts")


def label_lines(lines: DataFrame, labels: DataFrame, text: str = "value") -> DataFrame:
    """Lines with ``label``: that of the first key (by ``pos``) which the line contains anywhere. ``labels`` is (key, label, pos)."""
    return first_contained(lines, text, labels)


def read_markdown_list(spark: SparkSession, path: str) -> DataFrame:
    """(heading, company, url, text) of ``[Company](url). text`` lines under their ``## heading``."""
    lines = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    heading = F.when(F.col("line").rlike(r"^##\s+"), F.trim(F.regexp_replace("line", r"^##\s+", "")))
    from verdictflow.operators.datasets import carry_forward

    item = r"^\[([^\]]+)\]\(([^)]+)\)\.?\s*(.*)$"
    rows = carry_forward(lines, "file", "n", heading).where(F.col("line").rlike(item))
    return rows.select("heading", *[F.regexp_extract("line", item, i).alias(c) for i, c in ((1, "company"), (2, "url"), (3, "text"))])


def state_kind(c: Column) -> Column:
    first = F.substring(F.ltrim(c), 1, 1)
    parsed = F.try_parse_json(c)
    return F.when((first == "{") & parsed.isNotNull(), "object").when((first == "[") & parsed.isNotNull(), "list").otherwise("text")


def version_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, version): length and modification time of each file, by Hadoop's file systems (any store Spark reads)."""
    return spark.read.format("binaryFile").load(path).select("path", F.concat_ws("-", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).alias("version"))


def same_text(a: Column, b: Column) -> Column:
    return squeeze(a) == squeeze(b)
