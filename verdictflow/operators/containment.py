"""Which of many strings occur in which texts.

Up to ``AUTOMATON_CHARS`` characters of strings, one automaton finds all of them in one pass over the texts, which are not shuffled. Beyond
that, strings of ``LONG`` bytes or more are joined by a byte gram that each text samples by content (winnowing: of every ``WINDOW`` grams in a
row the one with the least hash), then compared; shorter ones go through automata of bounded size, one pass each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

#: Characters of one automaton (some 100 bytes each in a worker).
AUTOMATON_CHARS = 1 << 20
GRAM, WINDOW = 8, 8
LONG = GRAM + WINDOW - 1
MIX = np.uint64(0x9E3779B97F4A7C15)


def automaton_of(strings: list[str], values: list) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for s, v in zip(strings, values, strict=True):
        found.add_word(s, v)
    found.make_automaton()
    return found


def digest(c: Column | str) -> Column:
    return F.md5(F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary"))


def found_by_automaton(texts: DataFrame, strings: list[str]) -> DataFrame:
    """(ident, digest) of each of the strings that occurs in ``texts`` (ident, text)."""
    kind = texts.schema["ident"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton_of(strings, [hashlib.md5(s.encode()).hexdigest() for s in strings]).iter
        for batch in batches:
            at, which = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                hits = {v for _, v in find(t)} if t else ()
                at += [i] * len(hits)
                which += hits
            yield pa.RecordBatch.from_arrays([batch.column("ident").take(pa.array(at, pa.int64())), pa.array(which, pa.string())], names=["ident", "digest"])

    schema = f"ident {kind}, digest string"
    return texts.select("ident", "text").mapInArrow(run, schema) if strings else texts.sparkSession.createDataFrame([], schema)


def sampled_grams(data: bytes) -> np.ndarray:
    """Grams of a text, one at least in every ``LONG`` bytes in a row, chosen by content only."""
    if len(data) < LONG:
        return np.zeros(0, np.int64)
    grams = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), GRAM).copy().view(np.uint64)[:, 0]
    h = grams * MIX
    h ^= h >> np.uint64(29)
    h *= MIX
    least = h[: len(h) - WINDOW + 1].copy()
    for k in range(1, WINDOW):
        np.minimum(least, h[k : len(h) - WINDOW + 1 + k], out=least)
    return np.unique(least).view(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def grams_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: sampled_grams((t or "").encode()))


def found_by_grams(texts: DataFrame, strings: DataFrame) -> DataFrame:
    """(ident, digest) of the ``strings`` (s, digest) of ``LONG`` bytes or more: a join of slim rows, then the texts are compared."""
    anchors = strings.withColumn("gram", F.array_min(grams_of("s"))).select("gram", "digest")
    slim = texts.select("ident", F.explode_outer(grams_of("text")).alias("gram")).where("gram is not null")
    pairs = slim.join(anchors, "gram").select("ident", "digest").distinct()
    return pairs.join(strings, "digest").join(texts.select("ident", "text"), "ident").where(F.contains("text", "s")).select("ident", "digest").distinct()


def contained(texts: DataFrame, strings: DataFrame, chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(ident, name) of each string of ``strings`` (name, s) that occurs in a text of ``texts`` (ident, text).

    Null and empty strings occur nowhere, nothing occurs in a null text; equal strings are all reported; idents should be unique."""
    own = strings.where("s <> ''").select("name", "s", digest("s").alias("digest"))
    distinct = own.select("s", "digest").distinct()
    total = distinct.agg(F.coalesce(F.sum(F.length("s")), F.lit(0)).alias("n")).first()["n"]
    if total <= chars:
        found = found_by_automaton(texts, sorted(r["s"] for r in distinct.select("s").collect()))
    else:
        short, long = distinct.where(F.octet_length("s") < LONG), distinct.where(F.octet_length("s") >= LONG)
        found = found_by_grams(texts, long)
        passes = -(-short.agg(F.coalesce(F.sum(F.length("s")), F.lit(0)).alias("n")).first()["n"] // max(1, chars // 2))
        for k in range(passes):
            some = short.where(F.pmod(F.xxhash64("s"), F.lit(passes)) == k).select("s").collect()
            found = found.union(found_by_automaton(texts, sorted(r["s"] for r in some)))
    return found.join(own.select("name", "digest"), "digest").select("ident", "name")


def first_contained(lines: DataFrame, text: str, labels: DataFrame, name: str = "label", chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``lines`` with a column ``name``: the label of the first key (by ``pos``, then key) of ``labels`` (key, label, pos) that the text
    contains, null if none does. Empty keys are in no text. While the keys fit one automaton this is a column, without a join."""
    # Kept while it is looked at twice, as what finds the keys may be dear.
    keys = labels.where("key <> ''").groupBy("key").agg(F.min(F.struct("pos", "label")).alias("x")).select("key", "x.pos", "x.label").persist()
    if keys.agg(F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("n")).first()["n"] <= chars:
        listed = [(r["key"], r["label"]) for r in keys.orderBy("pos", "key").collect()]
        keys.unpersist()
        kind = labels.schema["label"].dataType
        if not listed:
            return lines.withColumn(name, F.lit(None).cast(kind))

        @F.pandas_udf(kind)
        def first(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            find = automaton_of([k for k, _ in listed], list(range(len(listed)))).iter
            for part in parts:
                best = (min((v for _, v in find(t)), default=-1) if t else -1 for t in part)
                yield pd.Series([listed[i][1] if i >= 0 else None for i in best], dtype=object)

        return lines.withColumn(name, first(F.col(f"`{text}`").cast("string")))
    own = digest(F.col(f"`{text}`").cast("string"))
    texts = lines.select(own.alias("ident"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null").distinct()
    hits = contained(texts, keys.select(F.struct("pos", "key", "label").alias("name"), F.col("key").alias("s")), chars)
    best = hits.groupBy("ident").agg(F.min("name").alias("found")).select(F.col("ident").alias("_ident"), F.col("found.label").alias("_label"))
    out = lines.join(best, own == F.col("_ident"), "left")
    return out.select(*[lines[f"`{c}`"] for c in lines.columns], F.col("_label").alias(name))
