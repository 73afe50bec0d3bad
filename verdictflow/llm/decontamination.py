"""Benchmark decontamination: a broadcast set of test n-grams, one scan of the training words, exact verification of hits.

Windows are looked up by a 64-bit hash and every hit is checked word by word in the words of the row, which are cut once, so a hash
collision costs time and never a result, and time is in proportion to words and hits.
All work is DataFrame functions. The benchmark side is broadcast only while its measured size is below ``BROADCAST_BYTES``;
beyond that a shuffle join of slim rows (text key, place, hash) finds the places and the texts are fetched once to verify them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictflow.llm.common import fresh, materialize, table, text_or_empty

WINDOW = 10
#: Text bytes of the benchmark up to which its windows (about eight times as many bytes) are broadcast.
BROADCAST_BYTES = 16 << 20
#: Contaminated rows up to which their keys (some 60 bytes each) are broadcast.
BROADCAST_ROWS = 1 << 19
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Letters that full lower-casing changes beyond A-Z (by Java's classes, and those that its tables may not know yet), and those among them
#: that share their small letter with another one.
NEWER = r"\x{1C89}\x{2C2F}\x{A7C0}\x{A7CB}\x{A7CC}\x{A7D0}\x{A7D6}\x{A7D8}\x{A7DA}\x{A7DC}\x{10570}-\x{10595}\x{10D50}-\x{10D65}"
CAPITALS = rf"[\x{{80}}-\x{{10FFFF}}&&[\p{{Lu}}\p{{Lt}}\p{{IsUppercase}}{NEWER}]]"
SECOND = "\u212b\u2126\u03f4\u01c5\u01c8\u01cb\u01f2"
MARK = "\ue000"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case, in a form that is equal for equal words only.

    Full lower-casing is fast but changes other capitals too. Those are marked first, so that they stay apart from small letters; texts
    without any are scanned for them once and left as they are. Capital sigma, whose small letter depends on its neighbours, is lowered
    by itself. None of this moves a word's bounds."""
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(MARK + "0")), f"([{SECOND}])", f"$1{MARK}2")
    marked = F.replace(F.regexp_replace(marked, f"({CAPITALS}(?<![{SECOND}]))", f"$1{MARK}1"), F.lit("\u03a3"), F.lit("\u03c3"))
    told = F.when(text.rlike(f"{MARK}|{CAPITALS}"), marked).otherwise(text)
    return F.array_remove(F.split(F.regexp_replace(F.lower(told), NOT_WORD, " "), " "), "")


def _hash_of(words: str, at: str, n: int) -> str:
    return "xxhash64(" + ", ".join([str(n), *[f"get({words}, {at} + {k})" for k in range(n)]]) + ")"


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each window of each item: item_id, len, words, hash."""
    cut = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(text_or_empty()).alias("w")).where("size(w) > 0")
    cut = cut.select("*", F.least(F.size("w"), F.lit(window)).alias("len"))
    rows = cut.select("item_id", "len", F.expr("explode_outer(transform(sequence(0, size(w) - len), i -> slice(w, i + 1, len)))").alias("words"))
    chosen: Column = F.lit(None).cast("long")
    for n in range(1, window + 1):
        chosen = F.when(F.col("len") == n, F.expr(_hash_of("words", "0", n))).otherwise(chosen)
    return rows.select("item_id", "len", "words", chosen.alias("hash")).distinct()


def window_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(hits, windows). hits: row, doc_id, n_words and either pos null, once for each document, or pos, len, window_id for a
    verified occurrence. windows: window_id, item_id."""
    spark = docs.sparkSession
    windows = benchmark_windows(items, window)
    windows = materialize(windows.withColumn("window_id", F.md5(F.concat_ws(" ", "words").cast("binary"))), "windows")
    facts = windows.agg(F.coalesce(F.sum(F.lit(8) * (F.octet_length(F.concat_ws(" ", "words")) + 40)), F.lit(0)).alias("bytes"), F.sort_array(F.collect_set("len")).alias("lengths")).first()
    lengths = facts["lengths"] or [window]  # at most ``window`` values
    distinct = windows.select("window_id", F.col("len").alias("w_len"), "words", F.col("hash").alias("w_hash")).distinct()
    same = (F.col("hash") == F.col("w_hash")) & (F.col("len") == F.col("w_len"))
    verified = F.slice("w", F.col("pos") + 1, F.col("len")) == F.col("words")
    arrays = []
    for n in lengths:
        ahead = ", ".join([str(n), "x", *[f"get(w, i + {k})" for k in range(1, n)]])
        arrays.append(f"transform(slice(w, 1, greatest(size(w) - {n - 1}, 0)), (x, i) -> struct({n} as len, cast(i as int) as pos, xxhash64({ahead}) as hash))")
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    rows = texts.select("doc_id", F.monotonically_increasing_id().alias("row"), "text", words_of(F.col("text")).alias("w"))
    head = "array(struct(0 as len, -1 as pos, cast(null as bigint) as hash))"
    if facts["bytes"] <= 8 * BROADCAST_BYTES:
        # The outer form: for the inner one Spark infers a filter on the array, pushes it below ``w`` and cuts the text anew for every word.
        scan = rows.select("doc_id", "row", "w", F.size("w").alias("n_words"), F.expr(f"inline_outer(concat({', '.join([head, *arrays])}))"))
        joined = scan.join(F.broadcast(distinct), same, "left").where((F.col("pos") < 0) | (F.col("window_id").isNotNull() & verified))
        return joined.select("row", "doc_id", "n_words", "pos", "len", "window_id"), windows.select("window_id", "item_id").distinct()
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    slim = rows.select(digest.alias("key"), F.expr(f"inline_outer(concat({', '.join(arrays)}))")).where("hash is not null")
    places = slim.join(distinct, same).select("key", "pos", "len", "window_id", "words").distinct()  # equal texts have the same places
    listed = places.groupBy("key").agg(F.collect_list(F.struct("pos", "len", "window_id", "words")).alias("p"))
    keyed = materialize(rows.select("doc_id", "row", F.size("w").alias("n_words"), digest.alias("key")), "rows")
    one = texts.select(digest.alias("key"), "text").join(listed, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("p").alias("p"))
    hits = one.select("key", "p", words_of(F.col("text")).alias("w")).select("key", "w", F.explode_outer("p").alias("h")).select("key", "w", "h.*").where(verified).select("key", "pos", "len", "window_id")
    of_rows = keyed.join(hits, "key").select("row", "doc_id", "n_words", "pos", "len", "window_id")
    heads = keyed.select("row", "doc_id", "n_words", F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("string").alias("window_id"))
    return heads.union(of_rows), windows.select("window_id", "item_id").distinct()


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    * A null or empty text has no words and no hits; items without words have no window; an empty benchmark hits nothing
      (items_sha256 is then that of the empty string). Null item ids are left out of the list and the count.
    * Items with the same words share their windows and are all listed. Repeated rows are reported alike, each once.
    * Columns other than doc_id, item_id and text are not read.
    """
    hits, window_items = window_hits(docs, items, window)
    hits = materialize(hits, "hits")
    # Reach of what came before in the same document: words already counted are not counted again.
    order = Window.partitionBy("row").orderBy("pos", "len").rowsBetween(Window.unboundedPreceding, -1)
    starts = hits.where("pos >= 0").groupBy("row", "pos").agg(F.max("len").alias("len"))
    covered = (
        starts.select("row", "pos", "len", F.coalesce(F.max(F.col("pos") + F.col("len")).over(order), F.lit(0)).alias("reach"))
        .groupBy("row")
        .agg(F.sum(F.greatest(F.lit(0), F.col("pos") + F.col("len") - F.greatest("pos", "reach"))).cast("long").alias("n_hit"))
    )
    found = (
        hits.where("pos >= 0").select("row", "window_id").distinct().join(window_items.where("item_id is not null"), "window_id")
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    return (
        hits.where("pos < 0")
        .join(covered, "row", "left")
        .join(found, "row", "left")
        .select(
            "doc_id",
            F.col("n_words").cast("long").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))).cast("binary"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, columns unchanged. Rows are told apart by doc_id and text.

    * Rows with a null or empty text have no words and stay, as all rows do if the benchmark is empty or has no words.
    * Repeated rows stay or go together; an empty table stays empty; columns may have any names.
    * The keys of what goes are broadcast if they are few when counted (``BROADCAST_ROWS``), so no text is shuffled; beyond that the
      anti join shuffles both sides."""
    bad_id, bad_digest = fresh(docs, "bad_id", "bad_digest")
    digest = F.unhex(F.md5(text_or_empty().cast("binary")))
    slim = docs.select(F.struct(F.col("doc_id"), digest.alias("digest")).alias("doc_id"), F.col("text"))
    hits, _ = window_hits(slim, items, window)
    bad = hits.where("pos >= 0").select(F.col("doc_id.doc_id").alias(bad_id), F.col("doc_id.digest").alias(bad_digest)).distinct()
    bad = materialize(bad, "contaminated")
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(bad_id)) & (digest == F.col(bad_digest)), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM w, lens)),
h AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw ON hw.doc_id = w.doc_id LEFT JOIN hi ON hi.doc_id = w.doc_id
"""
