"""Byte-level BPE by corpus-level merge replay.

The distinct words of a block of documents form one corpus. An inverted index from merge rank to the positions where that merge
applies, and a heap of the ranks present, replay the merges in rank order over the whole corpus at once; each merge touches its two
neighbours only. Words are kept between blocks in a bounded cache, encoded and decoded from their ids, so frequent words are replayed and
decoded once per worker; a full cache loses the words that were not met lately, not all of them. With ``forget`` the end of a task loses
them all, as Spark keeps the worker for the tasks of other stages, which would carry them along.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from verdictflow.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bounds of memory per worker: words kept between blocks (long ones are not kept), and text characters in one block.
CACHE_WORDS = 400_000
CACHE_WORD_CHARS = 64
BLOCK_CHARS = 1_000_000


SINGLE = [bytes([i]) for i in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def replay_merges(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Token ids of each word. In every word the lowest rank goes first and, among equal ranks, the leftmost, as a word-by-word
    encoder would do: a merge that makes a lower rank possible sends the rest of the current rank back to the heap."""
    if not words:
        return []
    data = b"".join(words)
    n = len(data)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    token: list[bytes | None] = list(map(SINGLE.__getitem__, data))
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    for e in ends[sizes > 0].tolist():
        right[e - 1] = -1
        if e < n:
            left[e] = -1
    get = ranks.get
    index = first_places(np.frombuffer(data, np.uint8), ends, ranks)
    heap = list(index)
    heapq.heapify(heap)
    find = index.get
    while heap:
        rank = heapq.heappop(heap)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        last = -1
        for k, i in enumerate(places):
            if i == last:
                continue
            last = i
            a = token[i]
            j = right[i]
            if a is None or j < 0 or get(merged := a + token[j]) != rank:
                continue  # a neighbour's merge has changed this place
            token[i], token[j] = merged, None
            r = right[i] = right[j]
            lower = False
            if r >= 0:
                left[r] = i
                if (q := get(merged + token[r])) is not None:
                    lower = q < rank
                    if (at := find(q)) is not None:
                        at.append(i)
                    else:
                        index[q] = [i]
                        heapq.heappush(heap, q)
            p = left[i]
            if p >= 0 and (q := get(token[p] + merged)) is not None:
                lower = lower or q < rank
                if (at := find(q)) is not None:
                    at.append(p)
                else:
                    index[q] = [p]
                    heapq.heappush(heap, q)
            if lower and k + 1 < len(places):
                if rank in index:
                    index[rank].extend(places[k + 1 :])
                else:
                    index[rank] = places[k + 1 :]
                    heapq.heappush(heap, rank)
                break
    kept = np.fromiter((t is not None for t in token), bool, n)
    ids = [ranks[t] for t in token if t is not None]
    last_of = np.concatenate(([0], np.cumsum(kept)))[ends].tolist()
    return [ids[a:b] for a, b in zip([0, *last_of], last_of)]


def first_places(data: np.ndarray, ends: np.ndarray, ranks: dict[bytes, int]) -> dict[int, list[int]]:
    """For each rank the places, ascending, where two bytes of one word are to be merged."""
    pairs = data[:-1].astype(np.int64) << 8 | data[1:]
    inside = np.ones(len(pairs), bool)
    inside[ends[(ends > 0) & (ends < len(data))] - 1] = False
    seen, which = np.unique(pairs, return_inverse=True)
    rank = np.array([ranks.get(bytes(divmod(p, 256)), -1) for p in seen.tolist()], np.int64)[which]
    at = np.flatnonzero(inside & (rank >= 0))
    at = at[np.argsort(rank[at], kind="stable")]
    found, starts = np.unique(rank[at], return_index=True)
    return {r: x.tolist() for r, x in zip(found.tolist(), np.split(at, starts[1:]))}


class Codec:
    """Encoder and decoder of one vocabulary; one for each worker process and vocabulary."""

    made: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        """Lose all words; the vocabulary stays."""
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.old_ids: dict[str, str] = {}
        self.old_decoded: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls.made:
            cls.made[path, pattern] = cls(path, pattern)
        return cls.made[path, pattern]

    def learn(self, pieces: set[str]) -> list[str]:
        """Have all of ``pieces`` coded; returns those that are new. Once half of the words that may be kept are there, they become the old
        ones, which stay as long as it takes for the next half to come and move on if they are met meanwhile."""
        if len(self.ids) > CACHE_WORDS // 2:
            self.old_ids, self.old_decoded, self.ids, self.decoded = self.ids, self.decoded, {}, {}
        missing = pieces.difference(self.ids)
        known = missing.intersection(self.old_ids)
        for p in known:
            self.ids[p] = self.old_ids[p]
            self.decoded[p] = self.old_decoded[p]
        new = list(missing - known)
        for p, ids in zip(new, replay_merges([p.encode() for p in new], self.ranks), strict=True):
            self.ids[p] = " ".join(map(str, ids))
            self.decoded[p] = self.decode(ids)
        return new

    def run(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """(decimal ids joined by a space, bytes decoded from the ids) of each text. A text's pieces are coded separately, so what
        its ids decode to is what the ids of its pieces do, one after another."""
        collecting = gc.isenabled()
        gc.disable()  # many small lists and no cycles: the collector would only go through the cache over and over
        try:
            return self._run(texts)
        finally:
            if collecting:
                gc.enable()

    def _run(self, texts: list[str]) -> list[tuple[str, bytes]]:
        split = [self.pieces(t) for t in texts]
        new = self.learn(set().union(*split))
        ids_of, decoded = self.ids.__getitem__, self.decoded.__getitem__
        out = [(" ".join(map(ids_of, pieces)), b"".join(map(decoded, pieces))) for pieces in split]
        for p in new:
            if len(p) > CACHE_WORD_CHARS:
                del self.ids[p], self.decoded[p]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def blocks(texts: Iterable[str], chars: int = BLOCK_CHARS) -> Iterator[list[str]]:
    block, n = [], 0
    for t in texts:
        block.append(t)
        n += len(t)
        if n >= chars:
            yield block
            block, n = [], 0
    if block:
        yield block


def encode_batches(batches: Iterable[pa.RecordBatch], path: str, pattern: str, with_ids: bool = False, forget: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of ``encode_documents`` for those of a task."""
    codec = Codec.of(path, pattern)
    try:
        for batch in batches:
            counts, digests, back, all_ids = [], [], [], []
            for block in blocks(t.as_py() or "" for t in batch.column("text")):
                for ids, decoded in codec.run(block):
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    digests.append(hashlib.sha256(ids.encode()).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        all_ids.append([int(i) for i in ids.split()])
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)
    finally:
        if forget:
            codec.forget()


def encode_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False, forget: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids (array of int).

    * A null text counts as empty: no tokens, digests of the empty string. Empty tables give empty results.
    * Repeated rows are encoded alike; columns other than doc_id and text are not read.
    * No shuffle; memory is bounded by one Arrow batch, one block and the cache, plus the longest text.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    key = docs.schema["doc_id"].dataType.simpleString()

    schema = f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(lambda batches: encode_batches(batches, path, pattern, with_ids, forget), schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
