"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes, calibration.

The examples are a bounded sample of labelled rows (``EXAMPLES`` of each label, those with the least hashes of the key). Terms are words
and word beginnings; those of the sample that are associated with the label beyond chance form the vocabulary, and their document
frequencies are counted over all training documents. The index keeps postings by term, cut into blocks of examples with the largest
weight of each term in each block: a query bounds every block, visits blocks from the highest bound down and stops when no block can
hold a nearer example, so the neighbours are exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.llm.common import crc_of_id, materialize, table

#: Documented bound of the fitted sample: examples of each label.
EXAMPLES = 3000
MIN_EXAMPLES_OF_TERM = 6
#: A term is kept if its association (chi-square with one degree of freedom) is at least this.
MIN_ASSOCIATION = 24.0
NEIGHBOURS = 16
BLOCK = 64
PREFIXES = (4, 5)
WORDS = re.compile(r"[^\W\d_]+").findall
THRESHOLD = 0.7
CACHE_WORDS = 500_000


def terms_of_word(word: str) -> list[str]:
    return [word, *[f"{word[:n]}~" for n in PREFIXES if len(word) > n]]


def term_counts(text: str) -> Counter:
    """Counts of the terms of a text."""
    counts: Counter = Counter()
    for w, n in Counter(WORDS(text.lower())).items():
        for t in terms_of_word(w):
            counts[t] += n
    return counts


@dataclass
class TermLookup:
    """Numbers of the vocabulary's terms in texts. Most words have no term: they are kept as a set, so that a text without any term
    costs one set difference. At most ``CACHE_WORDS`` words are remembered."""

    vocabulary: dict[str, int]
    numbers: dict[str, tuple[int, ...]] = field(default_factory=dict)
    without: set[str] = field(default_factory=set)

    def telling(self, words: list[str]) -> set[str]:
        """The words that have a term."""
        found = set(words) - self.without
        for w in [w for w in found if w not in self.numbers]:
            numbers = tuple(self.vocabulary[t] for t in terms_of_word(w) if t in self.vocabulary)
            if numbers:
                self.numbers[w] = numbers
            else:
                self.without.add(w)
                found.discard(w)
        return found

    def counts(self, text: str) -> dict[int, int]:
        """Occurrences of each term of the text, by term number."""
        if len(self.without) + len(self.numbers) > CACHE_WORDS:
            self.without.clear()
            self.numbers.clear()
        words = WORDS(text.lower())
        telling = self.telling(words)
        counts: Counter = Counter()
        if telling:
            for w, n in Counter(filter(telling.__contains__, words)).items():
                for k in self.numbers[w]:
                    counts[k] += n
        return counts


@dataclass
class BlockMaxIndex:
    """Inverted index of unit vectors: for each term, the weights of the examples block by block, and the largest of each block.

    ``postings[t, b]`` are the weights of term t in the examples of block b, zeros included: a few hundred terms
    are associated with the label, so this is some MB, and one block of many terms is one gather (lists of example and weight, cut by block,
    took three times as long)."""

    n_examples: int
    postings: np.ndarray  # terms x blocks x BLOCK
    block_max: np.ndarray  # terms x blocks

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> BlockMaxIndex:
        blocks = -(-max(1, len(vectors)) // BLOCK)
        postings = np.zeros((n_terms, blocks * BLOCK), np.float32)
        for i, (t, w) in enumerate(vectors):
            postings[t, i] = w
        postings = postings.reshape(n_terms, blocks, BLOCK)
        return cls(len(vectors), postings, postings.max(axis=2))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest by exact cosine, nearest first; equal cosines by example number.

        Only examples that share a term with the query (cosine above 0) are returned."""
        w = weights.astype(np.float32)
        bounds = w @ self.block_max[terms]
        order = np.argsort(-bounds, kind="stable")
        best = np.zeros(0, np.int64)
        cosines = np.zeros(0, np.float32)
        at, step = 0, 8
        # A block whose bound is below the k-th best (less rounding) holds nothing nearer.
        while at < len(order) and bounds[order[at]] > 0 and (len(best) < k or bounds[order[at]] >= cosines[-1] - 1e-5):
            chosen = order[at : at + step]  # more blocks each time: few steps even where the bounds are loose
            at += step
            step *= 2
            score = np.tensordot(w, self.postings[terms[:, None], chosen[None, :]], axes=1)
            row, column = np.nonzero(score)
            best = np.concatenate([best, chosen[row] * BLOCK + column])
            cosines = np.concatenate([cosines, score[row, column]])
            keep = np.lexsort((best, -np.round(cosines, 5)))[:k]
            best, cosines = best[keep], cosines[keep]
        return best, cosines.astype(np.float64)


@dataclass
class ToxicityModel:
    vocabulary: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    labels: np.ndarray
    ids: list
    prior: float
    scale: tuple[float, float]  # calibration: probability = sigmoid(a + b * vote)

    def vector(self, terms: Sequence[int], counts: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of the unit TF-IDF vector of a text."""
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        t = np.array(terms, np.int64)
        w = (1 + np.log(np.array(counts, np.float64))) * self.idf[t]
        return t, w / np.sqrt(w @ w)

    def vote(self, neighbours: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic neighbours, each weighted by the inverse of its distance; the missing ones vote as the prior does."""
        weights = 1 / (1.05 - np.minimum(cosines, 1))
        missing = NEIGHBOURS - len(neighbours)
        return float((weights @ self.labels[neighbours] + missing * self.prior) / (weights.sum() + missing))

    def score(self, vote: float) -> float:
        a, b = self.scale
        return float(1 / (1 + np.exp(-(a + b * vote))))

    def judge(self, terms: Sequence[int], counts: Sequence[int]) -> tuple[float, np.ndarray, np.ndarray]:
        """(calibrated score, nearest examples, their cosines)"""
        t, w = self.vector(terms, counts)
        found, cosines = self.index.nearest(t, w, NEIGHBOURS) if len(t) else (np.zeros(0, np.int64), np.zeros(0))
        return self.score(self.vote(found, cosines)), found, cosines


def calibrate(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Logistic curve through (vote, label) by Newton steps, with a small ridge so that separable votes stay finite."""
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a + b * votes)))
        g = np.array([(weights * (labels - p)).sum() - 1e-3 * a, (weights * (labels - p) * votes).sum() - 1e-3 * b])
        r = weights * p * (1 - p)
        h = np.array([[r.sum() + 1e-3, (r * votes).sum()], [(r * votes).sum(), (r * votes * votes).sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, b = a + np.clip(d[0], -5, 5), b + np.clip(d[1], -5, 5)
        if np.abs(d).max() < 1e-6:
            break
    return float(a), float(b)


def choose_vocabulary(counts: list[dict], labels: np.ndarray) -> list[str]:
    """Terms associated with the label: in enough examples, with enough chi-square. However many there are, all are kept."""
    with_term: list[Counter] = [Counter(), Counter()]
    for c, y in zip(counts, labels, strict=True):
        with_term[int(y)].update(c.keys())
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    chosen = []
    for t in sorted(set(with_term[0]) | set(with_term[1])) if n1 and n0 else []:
        a, b = with_term[1][t], with_term[0][t]
        c, d = n1 - a, n0 - b
        if a + b >= MIN_EXAMPLES_OF_TERM and len(labels) * (a * d - b * c) ** 2 >= MIN_ASSOCIATION * max(1e-9, (a + b) * (c + d) * n1 * n0):
            chosen.append(t)
    return chosen


def count_terms(docs: DataFrame, vocabulary: dict[str, int], *keys: str) -> DataFrame:
    """The columns ``keys`` of each document, ``terms`` (numbers of the vocabulary's terms in its text) and ``counts``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = TermLookup(vocabulary)
        for batch in batches:
            found = [lookup.counts(text or "") for text in batch["text"]]
            yield batch[list(keys)].assign(terms=[list(c.keys()) for c in found], counts=[list(c.values()) for c in found])

    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys] + ["terms array<int>, counts array<int>"])
    return docs.select(*keys, "text").mapInPandas(run, schema)


def document_frequencies(terms: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """(documents that have each term, documents) over a table of ``count_terms``. Each task adds up its own documents and sends one row
    for each term it met and one, under -1, for its documents; one row for each term comes to the driver."""
    size = len(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, n = np.zeros(size, np.int64), 0
        for batch in batches:
            n += len(batch)
            if len(batch):
                have += np.bincount(np.concatenate(batch["terms"].to_list()).astype(np.int64), minlength=size)
        found = np.flatnonzero(have)
        yield pd.DataFrame({"term": np.append(found, -1), "n": np.append(have[found], n)})

    sums = terms.select("terms").mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by_term = {r["term"]: r["n"] for r in sums}
    return np.array([by_term.get(i, 0) for i in range(size)], np.int64), by_term.get(-1, 0)


def fit_toxicity(rows: list[tuple[object, str, int]], sizes: dict[int, int], frequencies: Callable[[dict[str, int]], tuple[np.ndarray, int]] | None = None) -> ToxicityModel:
    """``rows`` (id, text, label) are the sampled examples, ``sizes`` the number of labelled rows of each label, ``frequencies`` counts
    the documents that have the terms of a vocabulary (without it, those of the sample)."""
    rows = sorted(rows, key=lambda r: (str(r[0]), r[2], r[1]))
    labels = np.array([r[2] for r in rows], np.float64)
    counts = [term_counts(r[1] or "") for r in rows]
    n1, n0 = labels.sum(), len(rows) - labels.sum()
    vocabulary = {t: i for i, t in enumerate(choose_vocabulary(counts, labels))}
    if frequencies is None or not vocabulary:
        have = Counter(t for c in counts for t in c)
        df, n_docs = np.array([have[t] for t in vocabulary], np.float64), len(rows)
    else:
        df, n_docs = frequencies(vocabulary)
    idf = np.log(1 + n_docs / np.maximum(df, 1))
    total = sizes.get(0, 0) + sizes.get(1, 0)
    prior = sizes.get(1, 0) / total if total else 0.0
    model = ToxicityModel(vocabulary, idf, BlockMaxIndex.build([], len(vocabulary)), labels, [], prior, (0.0, 1.0))
    lookup = TermLookup(vocabulary)
    vectors = [model.vector(list(c.keys()), list(c.values())) for c in (lookup.counts(r[1] or "") for r in rows)]
    # Examples of the same heaviest term stand together, those without a term last: bounds of blocks are then tight, and most low or 0.
    place = sorted(range(len(rows)), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]) if len(vectors[i][0]) else len(vocabulary), -labels[i], i))
    vectors, labels = [vectors[i] for i in place], labels[place]
    model.labels, model.ids = labels, [rows[i][0] for i in place]
    model.index = BlockMaxIndex.build(vectors, len(vocabulary))
    # Calibration by leaving each example out of its own neighbours; weights restore the shares of the labels.
    votes = []
    for i, (t, w) in enumerate(vectors):
        found, cosines = model.index.nearest(t, w, NEIGHBOURS + 1) if len(t) else (np.zeros(0, np.int64), np.zeros(0))
        keep = found != i
        votes.append(model.vote(found[keep][:NEIGHBOURS], cosines[keep][:NEIGHBOURS]))
    weights = np.where(labels == 1, sizes.get(1, 0) / max(1, n1), sizes.get(0, 0) / max(1, n0))
    if len(rows):
        model.scale = calibrate(np.array(votes), labels, weights / max(1e-9, weights.mean()))
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: Callable[[dict[str, int]], DataFrame] | None = None) -> ToxicityModel:
    """Fit on ``docs`` (doc_id, text: the documents to learn from) and ``labels`` (doc_id, toxic).

    The sample is drawn from the labels alone: the ``examples`` keys of each label with the least hashes. Their texts, one for each key,
    are fetched by a join with these keys, so no text is shuffled. A key with both labels counts as toxic; labels other than 0 and 1 and
    null keys are left out. ``terms`` gives the table of ``count_terms`` over ``docs`` for a vocabulary, where the caller keeps one."""
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64(F.lit("toxicity-sample"), "doc_id")
    chosen = [r for y in (0, 1) for r in known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(examples).collect()]
    keys = spark.createDataFrame(chosen, known.schema)  # at most 2 * examples rows
    sample = docs.join(F.broadcast(keys), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()
    counted = terms or (lambda vocabulary: count_terms(docs, vocabulary))
    return fit_toxicity([(r["doc_id"], r["text"], r["toxic"]) for r in sample], sizes, lambda vocabulary: document_frequencies(counted(vocabulary), vocabulary))


def score_terms(terms: DataFrame, model: ToxicityModel, *keys: str, with_evidence: bool = False) -> DataFrame:
    """``keys``, score, predicted and, on request, evidence of each row of a table of ``count_terms`` for the model's vocabulary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            judged = [model.judge(t, c) for t, c in zip(batch["terms"], batch["counts"], strict=True)]
            out = batch[list(keys)].assign(score=[s for s, _, _ in judged])
            if with_evidence:
                out["evidence"] = [
                    [{"id": str(model.ids[i]), "cosine": float(c), "toxic": int(model.labels[i])} for i, c in zip(found, cosines, strict=True)] for _, found, cosines in judged
                ]
            yield out

    schema = ", ".join([f"`{k}` {terms.schema[k].dataType.simpleString()}" for k in keys] + ["score double"])
    schema += ", evidence array<struct<id:string,cosine:double,toxic:int>>" * with_evidence
    out = terms.select(*keys, "terms", "counts").mapInPandas(run, schema)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score_toxicity(docs: DataFrame, model: ToxicityModel, with_evidence: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, score, predicted and, on request, evidence (ids and cosines of the neighbours).

    * A null or empty text, or one without a term of the vocabulary, has no neighbour and gets the calibrated prior.
    * Without labels the vocabulary is empty and every score alike. Repeated rows are scored alike; empty tables stay empty.
    * Whole texts; only doc_id and text are read.
    """
    return score_terms(count_terms(docs, model.vocabulary, "doc_id"), model, "doc_id", with_evidence=with_evidence)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are cut into words once: their terms are kept in a slim table, which gives the document frequencies and is then scored."""
    held_out = F.pmod(crc_of_id(), F.lit(3)) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    kept: list[DataFrame] = []

    def counted(vocabulary: dict[str, int]) -> DataFrame:
        kept.append(materialize(count_terms(docs, vocabulary, "doc_id", "held_out"), "toxicity-terms"))
        return kept[0].where("not held_out")

    model = train_toxicity(docs.where("not held_out"), labels, terms=counted)
    terms = kept[0] if kept else count_terms(docs, model.vocabulary, "doc_id", "held_out")  # no label, no vocabulary
    return score_terms(terms, model, "doc_id", "held_out").select("doc_id", "held_out", "score", "predicted")
