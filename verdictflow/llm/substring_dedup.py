"""Removal of long byte strings that occur more than once in a collection, within a document or across documents.

Column-wise Burrows-Wheeler construction needs one round over the whole collection for each byte of its longest text (122,698 rounds
over check_l), so the strings are found another way, with the same exact results:

* Every string of ``SPAN`` bytes has a least fingerprint among its ``GRAM``-byte grams. Starts of strings that follow one another with
  the same fingerprint form a segment, so segments cut a text by content: equal strings lie in segments of equal fingerprint.
* Segments (one for about 170 bytes) are counted by fingerprint and by content. A fingerprint seen once ends the matter; a content
  seen twice makes all its strings repeated.
* Only segments whose fingerprint is shared while their content is not are compared string by string, next to the others of that
  fingerprint. Fingerprints with very many contents are compared as single string hashes in the shuffle instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.llm.common import materialize, partitions, table, text_or_empty

SPAN = 400
GRAM = 64
#: Most string starts of one segment; longer runs of one fingerprint (periodic text) are cut.
SEGMENT = 512
#: Contents of one fingerprint up to which they are compared together in one task.
GROUP = 4096
#: Segments compared at once in a task (whole fingerprints; memory about 10 MB).
CHUNK = 8192
_rng = np.random.default_rng(20240229)
BYTES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
BASES = [int(b) | 1 for b in _rng.integers(1 << 40, 1 << 62, 2)]
MIX = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of the two bases and of their inverses modulo 2**64, extended as texts get longer."""

    size = 0
    up: list[np.ndarray] = []
    down: list[np.ndarray] = []

    @classmethod
    def to(cls, n: int) -> None:
        if n > cls.size:
            cls.size = max(n, 2 * cls.size, 1 << 16)
            one = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(cls.size, b, np.uint64)]))
            cls.up = [one(b) for b in BASES]
            cls.down = [one(pow(b, -1, 1 << 64)) for b in BASES]


class Hashed:
    """Hashes of any substrings of a byte string, from prefix sums."""

    def __init__(self, data: np.ndarray, which: int):
        Powers.to(len(data) + 1)
        self.which = which
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[which][data] * Powers.up[which][: len(data)], dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * Powers.down[self.which][starts]
        h = (h ^ (h >> np.uint64(32))) * MIX
        return h ^ (h >> np.uint64(29))


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row, by block-wise running minima from both sides."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, fingerprint, content hash, inner) of each segment of a text. inner: the fingerprint's gram is in
    the text more than once, so that the segment may hold equal strings itself."""
    n = len(data) - SPAN + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(bool)
    at = np.arange(len(data) - GRAM + 1)
    grams = Hashed(data, 0).of(at, at + GRAM)
    least = window_min(grams, SPAN - GRAM + 1)
    grams.sort()
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    ends = np.concatenate([first[1:], [n]])
    if (ends - first).max() > SEGMENT:
        first = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(first, ends, strict=True)])
        ends = np.concatenate([first[1:], [n]])
    prints = least[first]
    inner = np.searchsorted(grams, prints, "right") - np.searchsorted(grams, prints) > 1
    return first, ends - first, prints, Hashed(data, 1).of(first, ends + SPAN - 1), inner


def string_hashes(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of SPAN bytes in each content, one content after another, and how many each has."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    counts = sizes - SPAN + 1
    offsets = np.repeat(np.cumsum(sizes) - sizes, counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets + within
    return Hashed(data, 1).of(starts, starts + SPAN), counts


def repeated_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def cut_texts(texts: DataFrame, id_type: str) -> DataFrame:
    """Segments of each row of ``texts`` (doc_id, th, text)."""

    empty = segments(np.zeros(0, np.uint8))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, parts = [], []
            for i, text in enumerate(batch["text"]):
                found = segments(np.frombuffer(text.encode(), np.uint8))
                rows.append(np.full(len(found[0]), i))
                parts.append(found)
            at = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
            s, c, k, g, inner = (np.concatenate([empty[j], *[p[j] for p in parts]]) for j in range(5))
            yield pd.DataFrame({"doc_id": batch["doc_id"].values[at], "th": batch["th"].values[at], "s": s.astype(np.int32), "c": c.astype(np.int32), "k": k.view(np.int64), "g": g.view(np.int64), "inner": inner})

    return texts.mapInPandas(run, f"doc_id {id_type}, th long, s int, c int, k long, g long, inner boolean")


def fetch_contents(texts: DataFrame, wanted: DataFrame, id_type: str) -> DataFrame:
    """Contents of the wanted segments (doc_id, th, list of s, c, k, m, hot): bytes, or string hashes for hot fingerprints."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, th, text, segs in zip(batch["doc_id"], batch["th"], batch["text"], batch["segs"], strict=True):
                data = text.encode()
                for x in segs:
                    s, c = x["s"], x["c"]
                    content = data[s : s + c + SPAN - 1]
                    out.append((doc_id, th, s, x["m"], x["k"], None if x["hot"] else content, string_hashes([content])[0].view(np.int64) if x["hot"] else None))
            yield pd.DataFrame(out, columns=["doc_id", "th", "s", "m", "k", "content", "hashes"])

    joined = texts.join(wanted.withColumnsRenamed({"doc_id": "w_id", "th": "w_th"}), texts["doc_id"].eqNullSafe(F.col("w_id")) & (texts["th"] == F.col("w_th")))
    return joined.select("doc_id", "th", "text", "segs").mapInPandas(run, f"doc_id {id_type}, th long, s int, m long, k long, content binary, hashes array<long>")


def compare_contents(contents: DataFrame, id_type: str, n: int) -> DataFrame:
    """Runs of repeated strings in contents that occur once (m = 1), beside the others of their fingerprint."""

    def resolve(rows: list[tuple]) -> list[tuple]:
        hashes, counts = string_hashes([r[5] for r in rows])
        order = np.argsort(hashes, kind="stable")
        h = hashes[order]
        same = h[1:] == h[:-1]
        twice = np.zeros(len(h), bool)
        twice[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        out = []
        for r, e, c in zip(rows, np.cumsum(counts).tolist(), counts.tolist(), strict=True):
            if r[3] == 1:
                out += [(r[0], r[1], r[2] + a, size) for a, size in repeated_runs(twice[e - c : e])]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "th", "s", "c"]
        held: list[tuple] = []
        for batch in batches:
            for row in batch[["doc_id", "th", "s", "m", "k", "content"]].itertuples(index=False, name=None):
                if len(held) >= CHUNK and row[4] != held[-1][4]:
                    yield pd.DataFrame(resolve(held), columns=columns)
                    held = []
                held.append(row)
        if held:
            yield pd.DataFrame(resolve(held), columns=columns)

    return contents.repartition(n, "k").sortWithinPartitions("k").mapInPandas(run, f"doc_id {id_type}, th long, s int, c int")


def repeated_starts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, runs): texts (doc_id, th, text) and, for each, the runs (s, c) of starts of repeated strings.

    Rows with the same doc_id and text share their runs; each counts as an occurrence."""
    spark = docs.sparkSession
    n = partitions(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    cut = materialize(cut_texts(texts, id_type), "segments")
    contents = cut.groupBy("k", "g", "c").agg(F.count(F.lit(1)).alias("m"), F.max("inner").alias("inner"))
    of_print = contents.groupBy("k").agg(F.sum("m").alias("total"), F.count(F.lit(1)).alias("kinds"), F.max("inner").alias("inner"))
    live = contents.drop("inner").join(of_print.where("total > 1 or inner"), "k").select("k", "g", "c", "m", "kinds")
    seen = materialize(cut.join(live, ["k", "g", "c"]), "repeats")
    whole = seen.where("m > 1").select("doc_id", "th", "s", "c")
    open_ = seen.where("kinds > 1 or inner")
    one = open_.where("m = 1").select("doc_id", "th", "s", "c", "k", "m", "kinds")
    of_many = open_.where("m > 1").groupBy("k", "g", "c").agg(F.min(F.struct("doc_id", "th", "s")).alias("r"), F.first("m").alias("m"), F.first("kinds").alias("kinds"))
    wanted = one.union(of_many.select("r.doc_id", "r.th", "r.s", "c", "k", "m", "kinds")).groupBy("doc_id", "th").agg(
        F.collect_set(F.struct("s", "c", "k", "m", (F.col("kinds") > GROUP).alias("hot"))).alias("segs")
    )
    fetched = materialize(fetch_contents(texts, wanted, id_type).dropDuplicates(["doc_id", "th", "s", "k"]), "contents")
    near = compare_contents(fetched.where("content is not null"), id_type, n)
    single = fetched.where("content is null").select("doc_id", "th", "s", "m", "k", F.posexplode("hashes").alias("at", "h"))
    twice = single.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = single.where("m = 1").join(twice, ["k", "h"]).select("doc_id", "th", (F.col("s") + F.col("at")).cast("int").alias("s"), F.lit(1).alias("c"))
    return texts, whole.union(near).union(hot)


def strip_bytes(data: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(what is left of ``data``, number of removed runs): each run (s, c) of starts removes the bytes s to s + c + SPAN - 2."""
    out, at, spans, last = [], 0, 0, -1
    for s, c in sorted(runs):
        e = s + c + SPAN - 1
        if s > last:
            spans += 1
            out.append(data[at:s])
        last = at = max(at, e)
    return b"".join([*out, data[at:]]), spans


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, kept (binary).

    * A null text counts as empty; texts shorter than ``SPAN`` bytes stay whole. Empty tables give empty results.
    * Repeated rows count as occurrences, so all their strings are repeated. Only doc_id and text are read.
    * Adjacent removed bytes form one span. Strings are taken as equal if two 64-bit hashes of them are.
    """
    texts, runs = repeated_starts(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    listed = runs.groupBy(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th")).agg(F.collect_set(F.struct("s", "c")).alias("runs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(batch["doc_id"], batch["text"], batch["runs"], strict=True):
                data = text.encode()
                kept, spans = strip_bytes(data, [(x["s"], x["c"]) for x in found]) if found is not None else (data, 0)
                out.append((doc_id, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    joined = texts.join(listed, texts["doc_id"].eqNullSafe(F.col("r_id")) & (texts["th"] == F.col("r_th")), "left").select("doc_id", "text", "runs")
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return joined.mapInPandas(run, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
