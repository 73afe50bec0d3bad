"""Normalisation of mixed sources to decision rows and to flat pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictflow.functions.decisions import RULE_SOURCES, gold_position, nli_label, peak_of, spread
from verdictflow.functions.text import english_strict

#: Converters by name: each takes a source's DataFrame to the fixed head and the raw rest.
CONVERTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def converter(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        CONVERTERS[name] = f
        return f

    return add


def fixed_head(rows: DataFrame, category: str, source: str, task: str) -> DataFrame:
    """(category, source, task, raw): the whole row as VARIANT."""
    return rows.select(F.lit(category).alias("category"), F.lit(source).alias("source"), F.lit(task).alias("task"), F.to_variant_object(F.struct("*")).alias("raw"))


def adapt(rows: DataFrame) -> DataFrame:
    """(row_id, source, qid, type, keys, label) to rows with ``position`` and ``target``; labels that fit no option are dropped."""
    position = gold_position(F.col("type"), F.col("keys"), F.col("label"))
    out = rows.withColumn("position", position).where("position is not null")
    n = F.when(F.col("type") == "noul", 2).otherwise(F.size("keys"))
    return out.withColumn("target", spread(F.col("position"), n, peak_of(F.col("source"))))


def is_priority(source: Column) -> Column:
    out = F.startswith(source, F.lit("typed-decisions/"))
    for p in RULE_SOURCES:
        out = out | F.startswith(source, F.lit(p))
    return out


def flat_pairs(rows: DataFrame, premise: Column, hypothesis: Column, label: Column, source: str, keep: Sequence[str] = ()) -> DataFrame:
    """(premise, hypothesis, label, source) and the columns to keep: trimmed, English, not empty, labels held to 0, 1 and 2."""
    out = rows.select(*keep, F.trim(premise).alias("premise"), F.trim(hypothesis).alias("hypothesis"), nli_label(label).alias("label"), F.lit(source).alias("source"))
    return out.where((F.col("premise") != "") & (F.col("hypothesis") != "") & F.col("label").isNotNull() & english_strict(F.col("premise")))


def before_after(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Two rows for each pair: the text before is positive, the text after negative."""
    pair = F.array(F.struct(F.col(before).alias("code"), F.lit(True).alias("label")), F.struct(F.col(after).alias("code"), F.lit(False).alias("label")))
    return rows.withColumn("_p", F.explode(pair)).select(*[c for c in rows.columns if c not in (before, after)], "_p.code", "_p.label")


def diff_window(before: Column, after: Column, lead: int = 8, limit: int = 2000) -> Column:
    """``after`` from ``lead`` lines before its first changed line, cut to ``limit`` characters."""
    a, b = F.split(before, "\n"), F.split(after, "\n")
    changed = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    first = F.greatest(F.lit(1), F.when(changed > 0, changed).otherwise(F.lit(1)).cast("int") - lead)
    return F.substring(F.array_join(F.slice(b, first, F.size(b)), "\n"), 1, limit)


def pick_phrasing(key: Column, phrasings: list[str]) -> Column:
    """One of the phrasings, by the hash of a key."""
    return F.get(F.array(*map(F.lit, phrasings)), F.pmod(F.xxhash64(key), F.lit(len(phrasings))).cast("int"))


def hard_negatives(items: DataFrame, group: str, ident: str, text: str) -> DataFrame:
    """(ident, negative): for each item another text, that of the next item of its group in the ring of the texts' digests. Where a group has
    one text only it is the first by digest of all other texts, null if there are none. Items without a text have no negative.

    No task holds a group: rings are cut into parts by the first digits of the digest, neighbours are found within parts, and a part's last
    text is followed by the first of the next part."""
    texts = items.select(F.col(group).alias("g"), F.col(text).alias("t")).where("t is not null").distinct().withColumn("d", F.sha2(F.col("t").cast("binary"), 256)).withColumn("p", F.substring("d", 1, 4))
    least = F.min(F.struct("d", "t"))
    firsts = texts.groupBy("g", "p").agg(least.alias("least"))
    ring = Window.partitionBy("g").orderBy("p")  # at most 65,536 parts a group
    start = F.first("least").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = firsts.select("g", "p", F.coalesce(F.lead("least").over(ring), start)["t"].alias("after"))
    within = Window.partitionBy("g", "p").orderBy("d")
    found = texts.withColumn("within", F.lead("t").over(within)).join(after.withColumnRenamed("g", "ag").withColumnRenamed("p", "ap"), F.col("g").eqNullSafe(F.col("ag")) & (F.col("p") == F.col("ap")))
    found = found.select("g", "t", F.coalesce("within", "after").alias("next"))
    two = texts.select("t", "d").distinct().orderBy("d").limit(2).agg(F.sort_array(F.collect_list(F.struct("d", "t"))).alias("two"))
    a, b = F.get("two", F.lit(0))["t"], F.get("two", F.lit(1))["t"]
    found = found.join(F.broadcast(two)).select("g", "t", F.when(F.col("next") != F.col("t"), F.col("next")).otherwise(F.when(a != F.col("t"), a).otherwise(b)).alias("negative"))
    same = F.col("_g").eqNullSafe(F.col("g")) & (F.col("_t") == F.col("t"))
    return items.select(F.col(ident), F.col(group).alias("_g"), F.col(text).alias("_t")).join(found, same, "left").select(ident, "negative")
