"""Language-model scores by a probabilistic suffix tree over words.

A context is the ``DEPTH`` words before a token or fewer, never reaching across a document's start. The empty context has the corpus
distribution P(w) = (c(w) + 1) / (N + V + 1), with one symbol for all words never seen. A longer context s is smoothed towards the
context without its first word, P_s(w) = (c(s, w) + ALPHA * P_shorter(w)) / (c(s) + ALPHA), and becomes a state of the tree if it
occurs ``MIN_CONTEXT`` times or more in training and passes the divergence test: its distribution must predict what followed it better
than the shorter context's by ``MIN_GAIN`` nats, summed over all its occurrences, each of them predicted from the others. A token is
scored from the longest state that is a suffix of what came before. All thresholds are absolute, so the states grow with the corpus,
and each state's probabilities sum to 1.

The tree is never whole in one place. Documents are packed into blocks, each one row of word numbers. A block sends the counts of its
own words and word pairs (then of triples, then of the gains of its contexts) as packed arrays, one for each bucket of keys; a bucket
adds up what all blocks sent and answers each block with the totals of that block's own keys. Three such rounds give every block the
part of the tree that its documents need. Nothing but N, V and the number of documents reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.llm.common import materialize, table

#: Longest context, in words.
DEPTH = 2
#: Fewest occurrences of a context, and least log likelihood gain (nats) over the shorter one: the divergence test.
MIN_CONTEXT, MIN_GAIN = 2, 2.0
#: Weight of the shorter context's distribution, in occurrences.
ALPHA = 1.5
#: A block of documents ends at so many documents or bytes of text, whichever comes first.
BLOCK_DOCS, BLOCK_BYTES = 4096, 4 << 20
#: Documents in a bucket of keys, on average: buckets grow in number with the corpus and not in size.
BUCKET_DOCS = 2048
#: Bytes of a key that are sent: whole ones of words, 40 bits beside the bucket of longer strings. Buckets do not grow, so two strings of
#: the million in a bucket share one with probability 5e-7, however large the corpus.
KEY_BYTES = {"word": 8, "gain 1": 8, "pair": 5, "triple": 5, "gain 2": 5}
END_KEY = np.uint64(xxhash.xxh3_64_intdigest(b" end"))  # no word holds a space
MIX = np.uint64(0x9E3779B97F4A7C15)
LOG10 = float(np.log(10.0))


def small(numbers: np.ndarray) -> bytes:
    """Numbers are mostly small: on disk and between machines they are sent compressed, first all low bytes, then all higher ones."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def large(data: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def tokens(text: str) -> list[bytes]:
    """Words of a text; ``bytes.lower`` changes A-Z only and ``bytes.split`` splits at the six ASCII spaces."""
    return text.encode().lower().split()


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of strings of words ``a`` with one more word ``b``."""
    h = ((a ^ (a >> np.uint64(32))) * MIX + b) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Block(NamedTuple):
    """Some documents: ``words`` are the keys of their distinct words, ``seq`` the words (and ends) as places in it, ``since`` how many
    words of the document came before each token, ``train`` whether its document is learned from."""

    lengths: np.ndarray
    train_docs: np.ndarray
    words: np.ndarray
    seq: np.ndarray
    since: np.ndarray
    train: np.ndarray

    @classmethod
    def of(cls, lengths: bytes, train: bytes, words: bytes, seq: bytes) -> Block:
        n, t = np.frombuffer(lengths, np.int32).astype(np.int64), np.frombuffer(train, np.uint8).astype(bool)
        at = large(seq, np.uint32).astype(np.int64)
        since = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return cls(n, t, np.frombuffer(words, np.uint64), at, since, np.repeat(t, n))


class Grams(NamedTuple):
    """Strings of two or more words in a block. ``at`` are the tokens that end one, ``of`` its number for each of them, ``keys`` the
    distinct ones in ascending order."""

    at: np.ndarray
    of: np.ndarray
    keys: np.ndarray

    @classmethod
    def ending(cls, at: np.ndarray, keys: np.ndarray) -> Grams:
        found, of = np.unique(keys, return_inverse=True)
        return cls(at, of.astype(np.int64), found)

    def counts(self, train: np.ndarray) -> np.ndarray:
        return np.bincount(self.of[train[self.at]], minlength=len(self.keys)).astype(np.int64)


def pairs_of(b: Block) -> Grams:
    at = np.flatnonzero(b.since >= 1)
    return Grams.ending(at, joined(b.words[b.seq[at - 1]], b.words[b.seq[at]]))


def triples_of(b: Block, pairs: Grams, pair_counts: np.ndarray) -> Grams:
    """Triples whose context was seen often enough to be a state and whose last two words were seen together at all."""
    number = np.full(len(b.seq), -1, np.int64)
    number[pairs.at] = pairs.of
    at = np.flatnonzero(b.since >= 2)
    at = at[(pair_counts[number[at - 1]] >= MIN_CONTEXT) & (pair_counts[number[at]] > 0)]
    return Grams.ending(at, joined(pairs.keys[number[at - 1]], b.words[b.seq[at]]))


class Scores(NamedTuple):
    """log probabilities (natural) of each token of a block by context length, whether its contexts were seen often enough, and their
    numbers (of words and of pairs)."""

    base: np.ndarray
    one: np.ndarray
    two: np.ndarray
    has_one: np.ndarray
    has_two: np.ndarray
    context_one: np.ndarray
    context_two: np.ndarray


def probabilities(b: Block, word_counts: np.ndarray, pairs: Grams, pair_counts: np.ndarray, triples: Grams, triple_counts: np.ndarray, n: int, v: int, left_out: int = 0) -> Scores:
    """``left_out`` is 1 to score each training token as if its own occurrence had not been counted in its contexts."""
    base = np.log((word_counts[b.seq] + 1.0) / (n + v + 1.0))
    number = np.full(len(b.seq), -1, np.int64)
    number[pairs.at] = pairs.of
    context_one = np.full(len(b.seq), -1, np.int64)
    context_one[pairs.at] = b.seq[pairs.at - 1]
    context_two = np.full(len(b.seq), -1, np.int64)
    late = np.flatnonzero(b.since >= 2)
    context_two[late] = number[late - 1]
    c1 = np.where(context_one >= 0, word_counts[context_one], 0)
    c2 = np.where(context_two >= 0, pair_counts[context_two], 0)
    followed1 = np.where(number >= 0, pair_counts[number], 0)
    followed2 = np.zeros(len(b.seq), np.int64)
    followed2[triples.at] = triple_counts[triples.of]
    less = lambda count: np.maximum(count - left_out, 0)
    one = np.log((less(followed1) + ALPHA * np.exp(base)) / (less(c1) + ALPHA))
    two = np.log((less(followed2) + ALPHA * np.exp(one)) / (less(c2) + ALPHA))
    return Scores(base, one, two, c1 >= MIN_CONTEXT, c2 >= MIN_CONTEXT, context_one, context_two)


def gains(context: np.ndarray, longer: np.ndarray, shorter: np.ndarray, use: np.ndarray, size: int) -> np.ndarray:
    """Log likelihood gain of each context over the shorter one on the tokens ``use``."""
    return np.bincount(context[use], (longer - shorter)[use], size)


def chosen(s: Scores, state_one: np.ndarray, state_two: np.ndarray) -> np.ndarray:
    """log probability of each token from the longest state."""
    one = s.has_one & np.where(s.context_one >= 0, state_one[s.context_one], False)
    two = s.has_two & np.where(s.context_two >= 0, state_two[s.context_two], False)
    return np.where(two, s.two, np.where(one, s.one, s.base))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * MIX) >> np.uint64(40)).astype(np.int64) % buckets


def packed(kind: str, block: int, keys: np.ndarray, values: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows (kind, bucket, block, keys, values): in each bucket the keys in their own order."""
    if not len(keys):
        return
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    sent = keys[order].view(np.uint8).reshape(-1, 8)[:, : KEY_BYTES[kind]]
    values, bucket = values[order], bucket[order]
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, z in zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True):
        yield kind, int(bucket[a]), block, sent[a:z].tobytes(), small(values[a:z])


PACKED = "kind string, bucket int, block long, keys binary, values binary"
NAMES = ["kind", "bucket", "block", "keys", "values"]


def unpacked(answers: pd.DataFrame, kind: str, keys: np.ndarray, dtype: type, buckets: int) -> np.ndarray:
    """The answers to a block's own keys, in the order of ``keys``."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    of_kind = answers[answers["kind"] == kind].sort_values("bucket")
    got = np.concatenate([np.zeros(0, dtype), *[large(x, dtype) for x in of_kind["answer"]]])
    if len(got) != len(keys):
        raise RuntimeError("the answers are not those to this block's keys")
    out = np.empty(len(keys), dtype)
    out[order] = got
    return out


def pack_documents(docs: DataFrame, train: str) -> DataFrame:
    """Blocks of ``docs`` (doc_id, text), one row each: block, ids (as text), lengths, train, words, seq. ``train`` is an SQL condition."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.expr(train.replace("_crc", "crc32(cast(coalesce(cast(doc_id as string), '') as binary))")).alias("train"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        block = TaskContext.get().partitionId() << 33
        ids: list = []
        marks: list[bool] = []
        lengths: list[int] = []
        number: dict[bytes, int] = {}
        seq: list[int] = []
        size = 0

        def full() -> pd.DataFrame:
            keys = np.fromiter((END_KEY if w == b"\n" else digest(w) for w in number), np.uint64, len(number))
            at = np.array(seq, np.int64)
            order = np.argsort(-np.bincount(at, minlength=len(keys)), kind="stable")  # frequent words get small numbers
            place = np.empty(len(keys), np.uint32)
            place[order] = np.arange(len(keys), dtype=np.uint32)
            row = (block, list(ids), np.array(lengths, np.int32).tobytes(), np.array(marks, np.uint8).tobytes(), keys[order].tobytes(), small(place[at]))
            return pd.DataFrame([row], columns=["block", "ids", "lengths", "train", "words", "seq"])

        for batch in batches:
            for doc_id, text, mark in zip(batch["doc_id"], batch["text"], batch["train"], strict=True):
                words = tokens(text or "")
                words.append(b"\n")  # the end: no word is a line break
                seq += [number.setdefault(w, len(number)) for w in words]
                ids.append(doc_id)
                marks.append(bool(mark))
                lengths.append(len(words))
                size += len(text or "")
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield full()
                    block += 1
                    size = 0
                    for x in (ids, marks, lengths, number, seq):
                        x.clear()
        if ids:
            yield full()

    return rows.mapInPandas(run, "block long, ids array<string>, lengths binary, train binary, words binary, seq binary")


def add_up(group: pd.DataFrame) -> pd.DataFrame:
    """All rows of one (kind, bucket): totals over the blocks for each block's own keys, and for words the parts of N and V."""
    kind = group["kind"].iloc[0]
    of_gain = kind.startswith("gain")
    width = KEY_BYTES[kind]
    whole = np.zeros((sum(map(len, group["keys"])) // width, 8), np.uint8)
    whole[:, :width] = np.frombuffer(b"".join(group["keys"]), np.uint8).reshape(-1, width)
    values = [large(c, np.float32 if of_gain else np.uint32) for c in group["values"]]
    found, of = np.unique(whole.view(np.uint64).ravel(), return_inverse=True)
    totals = np.bincount(of, np.concatenate(values).astype(np.float64), len(found))
    answer = (totals >= MIN_GAIN).astype(np.uint8) if of_gain else totals.astype(np.uint32)
    cuts = np.cumsum([len(k) // width for k in group["keys"]])[:-1]
    out = [(kind, b, int(block), small(answer[own]), 0, 0) for b, block, own in zip(group["bucket"], group["block"], np.split(of, cuts), strict=True)]
    if kind == "word":
        out.append((kind, int(group["bucket"].iloc[0]), -1, b"", int(totals.sum()), int((totals > 0).sum())))
    return pd.DataFrame(out, columns=["kind", "bucket", "block", "answer", "n", "v"])


def score_documents(docs: DataFrame, training: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` is an SQL condition over doc_id and ``_crc`` (crc32 of the id as text): the rows to learn from.

    * A null text counts as empty: one token, the end. Without training rows N and V are 0, no context is a state and every token has
      the probability 1.
    * Repeated rows count as often as they occur and are scored alike. Empty tables give empty results.
    * Only doc_id and text are read, once: the blocks are written and every later round reads them, so lost executors change nothing.
    * Words are keyed by 64-bit hashes when counted, strings of words by 40 bits within a bucket (see ``KEY_BYTES``).
    * A document is in one block, so memory is that of a block, or of the longest document.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    blocks = materialize(pack_documents(docs.select("doc_id", "text"), training), "blocks")
    n_docs = blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    buckets = max(16, -(-n_docs // BUCKET_DOCS))
    answered = "kind string, bucket int, block long, answer binary, n long, v long"

    def totals(sent: DataFrame) -> DataFrame:
        return materialize(sent.groupBy("kind", "bucket").applyInPandas(add_up, answered), "totals")

    def block_of(row: pd.Series) -> Block:
        return Block.of(row["lengths"], row["train"], row["words"], row["seq"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                b = block_of(row)
                counts = np.bincount(b.seq[b.train], minlength=len(b.words))
                pairs = pairs_of(b)
                rows = [*packed("word", row["block"], b.words, counts.astype(np.uint32), buckets), *packed("pair", row["block"], pairs.keys, pairs.counts(b.train).astype(np.uint32), buckets)]
                yield pd.DataFrame(rows, columns=NAMES)

    slim = blocks.select("block", "lengths", "train", "words", "seq")
    counted = totals(slim.mapInPandas(count, PACKED))
    n, v = counted.where("block < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def with_answers(answers: DataFrame) -> tuple:
        return slim.groupBy("block").cogroup(answers.where("block >= 0").select("block", "kind", "bucket", "answer").groupBy("block"))

    def known(b: Block, a: pd.DataFrame) -> tuple[np.ndarray, Grams, np.ndarray, Grams]:
        words = unpacked(a, "word", b.words, np.uint32, buckets).astype(np.int64)
        pairs = pairs_of(b)
        of_pairs = unpacked(a, "pair", pairs.keys, np.uint32, buckets).astype(np.int64)
        return words, pairs, of_pairs, triples_of(b, pairs, of_pairs)

    def count_triples(rows: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for _, row in rows.iterrows():
            b = block_of(row)
            words, pairs, of_pairs, triples = known(b, a)
            out += packed("triple", row["block"], triples.keys, triples.counts(b.train).astype(np.uint32), buckets)
            none = np.zeros(len(triples.keys), np.int64)
            s = probabilities(b, words, pairs, of_pairs, triples, none, n, v, left_out=1)
            found = np.flatnonzero(words >= MIN_CONTEXT)
            gain = gains(s.context_one, s.one, s.base, b.train & s.has_one, len(words))
            out += packed("gain 1", row["block"], b.words[found], gain[found].astype(np.float32), buckets)
        return pd.DataFrame(out, columns=NAMES)

    tripled = totals(with_answers(counted).applyInPandas(count_triples, PACKED))
    both = counted.unionByName(tripled)

    def gain_of_pairs(rows: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for _, row in rows.iterrows():
            b = block_of(row)
            words, pairs, of_pairs, triples = known(b, a)
            s = probabilities(b, words, pairs, of_pairs, triples, unpacked(a, "triple", triples.keys, np.uint32, buckets).astype(np.int64), n, v, left_out=1)
            found = np.flatnonzero(of_pairs >= MIN_CONTEXT)
            gain = gains(s.context_two, s.two, s.one, b.train & s.has_two, len(of_pairs))
            out += packed("gain 2", row["block"], pairs.keys[found], gain[found].astype(np.float32), buckets)
        return pd.DataFrame(out, columns=NAMES)

    gained = totals(with_answers(both).applyInPandas(gain_of_pairs, PACKED))

    def score(rows: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, row in rows.iterrows():
            b = block_of(row)
            words, pairs, of_pairs, triples = known(b, a)
            s = probabilities(b, words, pairs, of_pairs, triples, unpacked(a, "triple", triples.keys, np.uint32, buckets).astype(np.int64), n, v)
            state_one, state_two = np.zeros(len(words), bool), np.zeros(len(of_pairs), bool)
            found = np.flatnonzero(words >= MIN_CONTEXT)
            state_one[found] = unpacked(a, "gain 1", b.words[found], np.uint8, buckets).astype(bool)
            found = np.flatnonzero(of_pairs >= MIN_CONTEXT)
            state_two[found] = unpacked(a, "gain 2", pairs.keys[found], np.uint8, buckets).astype(bool)
            starts = np.cumsum(b.lengths) - b.lengths
            parts.append(
                pd.DataFrame(
                    {
                        "doc_id": list(row["ids"]),
                        "held_out": ~b.train_docs,
                        "n_tokens": b.lengths,
                        "n_known": np.add.reduceat((words > 0)[b.seq].astype(np.int64), starts),
                        "train_tokens": np.full(len(b.lengths), n, np.int64),
                        "base_score": np.add.reduceat(s.base, starts) / LOG10,
                        "score": np.add.reduceat(chosen(s, state_one, state_two), starts) / LOG10,
                    }
                )
            )
        return pd.concat(parts) if parts else pd.DataFrame([], columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    everything = both.unionByName(gained)
    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = everything.where("block >= 0").select("block", "kind", "bucket", "answer").groupBy("block")
    return blocks.groupBy("block").cogroup(answers).applyInPandas(score, schema).withColumn("doc_id", F.col("doc_id").cast(key))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), "pmod(_crc, 7) <> 2")
