"""Source divergence audit: how far the term distributions of a language's sources lie apart, and which terms set a source off.

1. Each task counts the terms of a block of documents and hands on one row for each (lang, term) of it with its sources' counts, so there is
   no row for a word or a document.
2. Terms in enough documents of the language are kept and dealt by hash into vocabulary chunks of some ``CHUNK`` terms, numbered in each.
3. Each group's counts of a chunk are packed into one row (term numbers, counts). Groups are dealt into blocks; a task is a block by a block
   within a slab of chunks. Packed rows go to every tile of their block; a task reads them chunk after chunk, lays a chunk's counts out as two
   small matrices and adds to its submatrix of pairs. It holds one chunk of two blocks, never a whole vocabulary.
4. Submatrices are added up over slabs.

Everything is integers. Neither a language, a source, nor a term is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictflow.llm.common import materialize, release, table

MIN_DOCUMENTS = 30
PRIOR, SCALE = 5, 1_000_000_000
RANKS = 50
#: Terms of a chunk, chunks of a slab, groups of a block (all on average, as they are dealt by hash).
CHUNK, SLAB, BLOCK = 4096, 16, 32
#: Bytes of documents that a task counts at once, and of counts that it packs at once; kept terms up to which their table (some 50 bytes each)
#: is broadcast.
COUNTED_BYTES, PACKED_BYTES, BROADCAST_TERMS = 12 << 20, 24 << 20, 1 << 19
#: Lower-case ASCII letters and all bytes from 0x80 stay, capitals become small, everything else separates.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in a sorted array."""
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(x)])


def term_lists(texts: pa.Array) -> pa.ListArray:
    """The terms of each text, with empty strings between separators: all bytes are mapped at once, where they lie."""
    valid, offsets, data = texts.buffers()
    mapped = pa.py_buffer((data or pa.py_buffer(b"")).to_pybytes().translate(LETTERS))
    return pc.split_pattern(type(texts).from_buffers(len(texts), offsets, mapped, valid, -1, texts.offset), " ")


def count_block(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Counts of one block of documents: lang, term, docs, total, sources, n (a list each), one row for each term of a language."""
    lists, langs, sources = term_lists(texts), langs.dictionary_encode(), sources.dictionary_encode()
    lengths, words = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().dictionary_encode()
    code, terms = words.indices.to_numpy(), words.dictionary
    doc = np.repeat(np.arange(len(texts)), lengths)
    real = code != terms.index("").as_py()
    code, doc = code[real].astype(np.int64), doc[real]
    lang_of_doc, source_of_doc = (x.indices.to_numpy().astype(np.int64) for x in (langs, sources))
    n_langs, n_sources, n_docs = len(langs.dictionary), len(sources.dictionary), len(texts)
    row_of_doc = lang_of_doc * n_sources + source_of_doc
    by_group = np.sort(code * (n_langs * n_sources) + row_of_doc[doc])
    at, n = runs(by_group)
    row, source = np.divmod(by_group[at], n_sources)  # row: term and language
    starts, _ = runs(row)
    in_doc = np.sort(code * n_docs + doc)
    in_doc = in_doc[runs(in_doc)[0]]
    _, docs = runs(np.sort(in_doc // n_docs * n_langs + lang_of_doc[in_doc % n_docs]))
    offsets = pa.array(np.r_[starts, len(row)].astype(np.int32))
    columns = [
        langs.dictionary.take(pa.array(row[starts] % n_langs)),
        terms.take(pa.array(row[starts] // n_langs)),
        pa.array(docs),
        pa.array(np.add.reduceat(n, starts) if len(starts) else n),
        pa.ListArray.from_arrays(offsets, sources.dictionary.take(pa.array(source))),
        pa.ListArray.from_arrays(offsets, pa.array(n)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "docs", "total", "sources", "n"])


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size`` bytes or more, but for the last."""
    held: list[pa.RecordBatch] = []
    joined = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if held and sum(b.nbytes for b in held) >= size:
            yield joined()
            held = []
    if held:
        yield joined()


def count_terms(docs: DataFrame, size: int = COUNTED_BYTES) -> DataFrame:
    """Counts by block of documents, see ``count_block``; the same term of a language has a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, size):
            yield count_block(*(batch.column(c) for c in ("lang", "source", "text")))

    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return texts.mapInArrow(run, "lang string, term string, docs long, total long, sources array<string>, n array<long>")


def kept_terms(counts: DataFrame, least: int = MIN_DOCUMENTS, chunk: int = CHUNK) -> DataFrame:
    """lang, term, total, chunk, at, chunk_terms: the terms kept for each language, numbered from 0 within their chunk."""
    kept = counts.groupBy("lang", "term").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = materialize(kept.select("lang", "term", "total"), "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    dealt = kept.join(sizes, "lang").withColumn("chunk", F.expr(f"cast(pmod(xxhash64(term), ceil(v / {chunk})) as int)"))
    of_chunk = Window.partitionBy("lang", "chunk")
    place = (F.row_number().over(of_chunk.orderBy("term")) - 1).alias("at")
    out = materialize(dealt.select("lang", "term", "total", "chunk", place, F.count(F.lit(1)).over(of_chunk).cast("int").alias("chunk_terms")), "chunks")
    release(kept)
    return out


def pack_counts(counts: DataFrame, terms: DataFrame, few: int = BROADCAST_TERMS) -> DataFrame:
    """lang, source, chunk, at, n: the packed vector of counts of each group and chunk in which it has terms. The kept terms are broadcast if
    they are few when counted; beyond that both sides are shuffled. Each task packs what it has, so rows of whole vectors are shuffled, and
    those of one group and chunk are added up one after another into an array of the chunk's length."""
    schema = "lang string, source string, chunk int, at array<int>, n array<long>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, PACKED_BYTES):
            langs, lists = batch.column("lang").dictionary_encode(), batch.column("sources")
            sources = lists.flatten().dictionary_encode()
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            chunk, at = (batch.column(c).to_numpy().astype(np.int64) for c in ("chunk", "at"))
            n = batch.column("n").flatten().to_numpy()
            key = (langs.indices.to_numpy()[of] * np.int64(len(sources.dictionary)) + sources.indices.to_numpy()) * (chunk.max() + 1) + chunk[of]
            order = np.argsort(key, kind="stable")
            starts, _ = runs(key[order])
            first = order[starts]
            offsets = pa.array(np.r_[starts, len(key)].astype(np.int32))
            columns = [
                langs.take(pa.array(of[first])).cast(pa.string()),
                sources.take(pa.array(first)).cast(pa.string()),
                pa.array(chunk[of[first]].astype(np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(at[of[order]].astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(n[order])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "chunk", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(sums)
            return pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "chunk"), key, strict=True)) | {"at": at.astype(np.int32), "n": sums[at]}], schema=into)

        into = pa.schema([("lang", pa.string()), ("source", pa.string()), ("chunk", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
        for batch in batches:
            for i, now in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "chunk")), strict=True)):
                if now != key:
                    if key is not None:
                        yield out()
                    key, sums = now, np.zeros(0, np.int64)
                at, n = (batch.column(c)[i].values.to_numpy() for c in ("at", "n"))
                if len(at) and at.max() >= len(sums):
                    sums = np.r_[sums, np.zeros(at.max() + 1 - len(sums), np.int64)]
                np.add.at(sums, at, n)
        if key is not None:
            yield out()

    right = terms.select("lang", "term", "chunk", "at")
    joined = counts.select("lang", "term", "sources", "n").join(F.broadcast(right) if terms.count() <= few else right, ["lang", "term"])
    packed = joined.select("lang", "chunk", "at", "sources", "n").mapInArrow(pack, schema)
    order = ["lang", "source", "chunk"]
    return packed.repartition(*order).sortWithinPartitions(*order).mapInArrow(add, schema)


def probability(count: Column, of: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (of + 5 terms)), in decimals of 38 digits; null without terms."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.when(terms > 0, F.call_function("div", wide(count + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(of + PRIOR * terms)) + 1)


def probabilities(counts: np.ndarray, of: int, terms: int) -> np.ndarray:
    """The same for an array. Nine decimals are divided out three at a time, which is exact up to 9 * 10^15 tokens."""
    out, rest, by = np.zeros_like(counts), counts + PRIOR, of + PRIOR * terms
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, by)
        out = out * 1000 + whole
    return out + 1


def tile(rows: pd.DataFrame, state: dict) -> None:
    """Add one chunk of a tile to its submatrix."""
    size = int(rows["chunk_terms"].iloc[0])
    laid = []
    for side in (0, 1):
        names, zero, of, terms = state["groups"][side]
        p = np.repeat(zero[:, None], size, axis=1)
        mine = rows[rows["side"] == side]
        for source, at, n in zip(mine["source"], mine["at"], mine["n"], strict=True):
            i = state["index"][side][source]
            p[i, np.asarray(at)] = probabilities(np.asarray(n, np.int64), int(of[i]), int(terms))
        laid.append(p)
    left, right = laid if state["sides"] == 2 else (laid[0], laid[0])
    for i in range(len(left)):
        state["sum"][i] += np.abs(right - left[i]).sum(axis=1)
    state["seen"] += size


def pair_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by tile and chunk; headers (chunk -1) name a tile's groups. One row for each pair of a tile, from both sides."""
    state: dict | None = None

    def begin(key: tuple, heads: pd.DataFrame) -> dict:
        out = {"key": key, "groups": [], "index": [], "seen": 0, "slab_terms": int(heads["chunk_terms"].iloc[0]), "sides": 1 if key[1] == key[2] else 2}
        for side in (0, 1):
            mine = heads[heads["side"] == side]
            of, terms = mine["group_tokens"].to_numpy(np.int64), int(heads["v"].iloc[0])
            zero = np.array([probabilities(np.zeros(1, np.int64), int(x), terms)[0] if terms else 0 for x in of], np.int64)
            out["groups"].append((mine["source"].tolist(), zero, of, terms))
            out["index"].append({s: i for i, s in enumerate(mine["source"])})
        out["sum"] = np.zeros((len(out["groups"][0][0]), len(out["groups"][out["sides"] - 1][0])), np.int64)
        return out

    def end(s: dict) -> pd.DataFrame:
        (a, zero_a, *_), (b, zero_b, *_) = s["groups"][0], s["groups"][s["sides"] - 1]
        total = s["sum"] + (s["slab_terms"] - s["seen"]) * np.abs(zero_a[:, None] - zero_b[None, :])  # terms that no group here has
        i, j = np.indices(total.shape)
        i, j = i.ravel(), j.ravel()
        if s["sides"] == 1:
            i, j = i[i != j], j[i != j]
        names_a, names_b = np.array(a, object), np.array(b, object)
        out = pd.DataFrame({"lang": s["key"][0], "source": names_a[i], "item": names_b[j], "value": total[i, j]})
        return out if s["sides"] == 1 else pd.concat([out, out.rename(columns={"source": "item", "item": "source"})[out.columns]])

    def parts() -> Iterator[tuple[tuple, int, pd.DataFrame]]:
        """(tile, chunk, its rows), whole."""
        held, held_key = [], None
        for batch in batches:
            for (*key, chunk), rows in batch.groupby(["lang", "a", "b", "slab", "chunk"], sort=False):
                if held and held_key != (tuple(key), chunk):
                    yield *held_key, pd.concat(held)
                    held = []
                held_key = (tuple(key), chunk)
                held.append(rows)
        if held:
            yield *held_key, pd.concat(held)

    for key, chunk, rows in parts():
        if state is None or state["key"] != key:
            if state is not None:
                yield end(state)
            state = begin(key, rows)
        if chunk >= 0:
            tile(rows, state)
    if state is not None:
        yield end(state)


def pair_values(groups: DataFrame, packed: DataFrame, chunks: DataFrame, slab: int = SLAB, block: int = BLOCK) -> DataFrame:
    """lang, source, item, value for each two sources of a language. groups: lang, source, group_tokens, v; packed: lang, source, chunk, at,
    n; chunks: lang, chunk, chunk_terms."""
    of_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    blocks = groups.join(of_lang, "lang").withColumn("blocks", F.expr(f"cast(ceil(sources / {block}) as int)"))
    blocks = blocks.withColumn("block", F.expr("cast(pmod(xxhash64(source), blocks) as int)"))
    packed = packed.join(chunks, ["lang", "chunk"]).join(blocks.select("lang", "source", "blocks", "block"), ["lang", "source"])
    none = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    shape = lambda slab, chunk, at, n: [
        "lang", "source", "blocks", "block", slab.alias("slab"), chunk.alias("chunk"), "chunk_terms", at.alias("at"), n.alias("n")
    ]
    data = packed.select(*shape(F.expr(f"chunk div {slab}").cast("int"), F.col("chunk"), F.col("at"), F.col("n")), F.lit(0).cast("long").alias("group_tokens"), F.lit(0).cast("long").alias("v"))
    slabs = chunks.groupBy("lang", F.expr(f"cast(chunk div {slab} as int)").alias("slab")).agg(F.sum("chunk_terms").cast("int").alias("chunk_terms"))
    heads = blocks.join(slabs, "lang", "left").withColumns({"slab": F.coalesce("slab", F.lit(0)), "chunk_terms": F.coalesce("chunk_terms", F.lit(0))})
    heads = heads.select(*shape(F.col("slab"), F.lit(-1), *none), "group_tokens", "v")
    sent = data.unionByName(heads).withColumn("other", F.expr("explode(sequence(0, blocks - 1))"))
    sent = sent.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "slab", "chunk", F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "source", "chunk_terms", "at", "n", "group_tokens", "v")
    dealt = sent.repartition("lang", "a", "b", "slab").sortWithinPartitions("lang", "a", "b", "slab", "chunk")
    sums = dealt.mapInPandas(pair_sums, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = MIN_DOCUMENTS, ranks: int = RANKS, chunk: int = CHUNK, slab: int = SLAB, block: int = BLOCK) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank.

    * Null lang, source and text count as empty; the empty lang and source are a language and a source like others.
    * A source without kept terms has all probabilities from its prior; a language without kept terms has pairs of value 0 and no terms;
      a language of one source has no pairs. An empty table gives no rows.
    * Equal values are ranked by the item's UTF-8 bytes. Repeated rows are documents of their own.
    * Columns other than lang, source and text are not read."""
    counts = materialize(count_terms(docs), "counts")
    sources = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    terms = kept_terms(counts, least, chunk)
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_tokens"))
    packed = materialize(pack_counts(counts, terms), "packed")
    release(counts)
    tokens = packed.groupBy("lang", "source").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("group_tokens"))
    groups = sources.join(tokens, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = materialize(groups.na.fill(0, ["group_tokens", "v", "lang_tokens"]), "groups")
    order = [F.col("value").desc(), F.col("item").asc()]
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    pairs = pair_values(groups, packed, terms.select("lang", "chunk", "chunk_terms").distinct(), slab, block)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", place)
    p, q = probability(F.col("n"), F.col("group_tokens"), F.col("v")), probability(F.col("total"), F.col("lang_tokens"), F.col("v"))
    flat = packed.select("lang", "source", "chunk", F.explode(F.arrays_zip("at", "n")).alias("x")).select("lang", "source", "chunk", "x.at", "x.n")
    over = flat.join(terms, ["lang", "chunk", "at"]).join(groups, ["lang", "source"])
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value"))
    over = over.where("value > 0").withColumn("rank", place).where(F.col("rank") <= ranks)
    return pairs.unionByName(over)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (n.n + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 5)) // (l.n + 5 * l.v) AS q
  FROM n JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
