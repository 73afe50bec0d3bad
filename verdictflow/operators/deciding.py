"""States and questions to answers: parse, encode, score by a plugged-in model, decode. One row for each state and question."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from verdictflow.functions.decisions import choice_verdict, criteria_of, decode, lay_out, noul_verdict, option_texts, question_errors
from verdictflow.functions.encoding import UNKNOWN, BytePairs, bpe_ids
from verdictflow.functions.text import unmask

Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def parse_questions(rows: DataFrame, questions: str = "questions") -> DataFrame:
    """``rows`` with one row for each question of a JSON object (qid: question), in its order: qid, type, instructions, criteria, keys,
    options, errors. Text that is no object is one row without a qid and with an error."""
    text = F.col(questions)
    entries = F.map_entries(F.when(F.try_parse_json(text).isNotNull() & F.startswith(F.ltrim(text), F.lit("{")), F.from_json(text, "map<string,string>")))
    flat = rows.withColumn("_q", F.explode_outer(entries))
    at = lambda path: F.get_json_object("_q.value", path)
    flat = flat.withColumns({"qid": F.col("_q.key"), "type": at("$.type"), "instructions": F.coalesce(at("$.instructions"), F.lit("")), "criteria": criteria_of(at("$.criteria"))}).drop("_q")
    level = F.transform("criteria", lambda c, i: i.cast("string"))
    keys = F.when(F.col("type") == "noul", F.array(F.lit("false"), F.lit("true"))).when(F.col("type") == "score", level).otherwise(F.transform("criteria", lambda c: c["key"]))
    errors = F.when(F.col("qid").isNull(), F.array(F.lit("questions are no JSON object"))).otherwise(question_errors(F.col("type"), F.col("criteria")))
    return flat.withColumns({"keys": keys, "options": option_texts(F.col("type"), F.col("criteria")), "errors": errors})


def encode(questions: DataFrame, vocabulary: str, state: str = "state", max_len: int = 1024, head_max: int = 256) -> DataFrame:
    """``questions`` (of ``parse_questions``, with the state's text) with ids, markers (where each option's mask is) and input_tokens; null for
    questions with errors. The mask's name in users' text is a blank."""
    ids = bpe_ids(vocabulary)
    asked = F.size("errors") == 0
    head = F.when(asked, F.concat(F.col("type"), F.lit(" question: "), unmask(F.col("instructions"))))
    encoded = questions.withColumns({"_head": ids(head), "_state": ids(unmask(F.when(asked, F.coalesce(F.col(state), F.lit("")))))})
    encoded = encoded.withColumn("_options", option_ids(vocabulary)(F.when(asked, F.transform("options", lambda o: F.concat(F.lit(" "), unmask(o))))))
    laid = encoded.withColumn("_l", F.when(asked, lay_out(F.col("_head"), F.col("_options"), F.col("_state"), max_len, head_max)))
    return laid.select(*[F.col(f"`{c}`") for c in questions.columns], F.col("_l.ids").alias("ids"), F.col("_l.markers").alias("markers"), F.size("_l.ids").alias("input_tokens"))


def option_ids(vocabulary: str) -> Callable:
    """As ``bpe_ids`` for arrays of texts."""

    @F.pandas_udf(ArrayType(ArrayType(IntegerType())))
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pairs = BytePairs.of(vocabulary, UNKNOWN)
        for part in parts:
            yield pd.Series([None if o is None else [pairs.ids(t) for t in o] for o in part], dtype=object)

    return ids


def decide(rows: DataFrame, scorer: Scorer, vocabulary: str, state: str = "state", questions: str = "questions") -> DataFrame:
    """``rows`` with an answer to each of their questions: qid, type, probabilities, choice, score, noul, confidence, verdict, input_tokens and
    errors (the answer is null if there are any). The scorer gets batches of (ids, markers) and gives a logit for each marker."""
    encoded = encode(parse_questions(rows, questions), vocabulary, state)

    @F.pandas_udf(ArrayType(DoubleType()))
    def scored(ids: pd.Series, markers: pd.Series) -> pd.Series:
        return scorer(ids, markers)

    good, bad = encoded.where(F.size("errors") == 0), encoded.where(F.size("errors") > 0)
    answered = decode(good.withColumn("logits", scored("ids", "markers")))
    p, t = F.col("probabilities"), F.col("type")
    answered = answered.withColumn("verdict", F.when(t == "noul", noul_verdict(F.get(p, F.lit(1)))).when(t == "choice", choice_verdict(F.col("keys"), p)))
    out = [*[F.col(f"`{c}`") for c in rows.columns], "qid", "type", "probabilities", "choice", "score", "noul", "confidence", "verdict", "input_tokens", "errors"]
    empty = {"probabilities": "array<double>", "choice": "string", "score": "double", "noul": "double", "confidence": "double", "verdict": "string"}
    return answered.select(*out).unionByName(bad.withColumns({k: F.lit(None).cast(v) for k, v in empty.items()}).select(*out))
