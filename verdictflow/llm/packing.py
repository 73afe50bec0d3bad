"""Best-fit packing of tokenized documents into sequences, under three capacities: tokens, documents, attention cost (sum of squared lengths).

What a piece of a document needs follows from its length, so equal lengths are equal items. The corpus is tokenized once; pieces are counted
by length (a table of at most ``TOKENS`` rows); vector best fit is run over lengths in descending order, with whole ranges of equal items and
equal bins moved at once; and the outcome, a bounded list of moves, places every piece by its rank among those of its length. So no task and
no driver sees the documents of more than its own part, and the result is that of placing the pieces one by one.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verdictflow.llm.common import materialize, table

VOCABULARY = "word_bpe_49k.json"
TOKENS, END = 4096, 1
#: Bounds of memory per worker: words kept between batches; longer words are not kept.
CACHE_WORDS, CACHE_WORD_CHARS = 1_000_000, 48


@dataclass(frozen=True)
class Capacity:
    """Of a bin. The defaults of documents and attention follow from the tokens: no bin of so many tokens can exceed them."""

    tokens: int = TOKENS
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> tuple[int, int, int]:
        return self.tokens, self.tokens if self.documents is None else self.documents, self.tokens**2 if self.attention is None else self.attention


@dataclass(frozen=True)
class Move:
    """Items ``first_item`` to ``last_item`` (end exclusive) of a length go to the bins from ``first_bin`` on, ``each`` to a bin, at ``offset``."""

    length: int
    first_item: int
    last_item: int
    first_bin: int
    each: int
    offset: int


def best_fit(counts: Mapping[int, int], capacity: Capacity = Capacity()) -> list[Move]:
    """Vector best fit, longest first: each item goes to the feasible bin whose residual capacity is least in norm, or opens a bin.

    The norm is the sum of squared residuals, each as a share of its capacity and weighted by the share of all bins' capacity that the items
    ask for in this dimension; ties go to the fewer residual tokens, documents, attention. An item leaves its bin the least one, so equal
    items fill it before they go to the next, and bins with equal residuals are treated as one: a move places items in all of them. Every move
    into a bin leaves it less than half of what the length could still use, so moves are bounded by the number of lengths, not by that of items.
    A ValueError if an item fits no empty bin."""
    cap = capacity.vector()
    demand = lambda n: (n, 1, n * n)
    if bad := [n for n in counts if counts[n] and any(d > c for d, c in zip(demand(n), cap, strict=True))]:
        raise ValueError(f"items of length {bad[0]} exceed the capacity of an empty bin")
    asked = [sum(demand(n)[k] * c for n, c in counts.items()) / cap[k] for k in range(3)]
    weight = [a / (sum(asked) or 1) for a in asked]
    open_bins: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residual: ranges of bins
    norm: dict[tuple[int, int, int], float] = {}
    by_tokens: dict[int, set[tuple[int, int, int]]] = defaultdict(set)
    moves: list[Move] = []
    bins = 0

    def put(residual: tuple[int, int, int], first: int, last: int) -> None:
        if last > first and min(residual) > 0:
            open_bins.setdefault(residual, []).append((first, last))
            norm[residual] = sum(w * (r / c) ** 2 for w, r, c in zip(weight, residual, cap, strict=True))
            by_tokens[residual[0]].add(residual)

    def fill(residual: tuple[int, int, int], first: int, last: int, n: int, done: int, left: int) -> int:
        """Put up to ``left`` items of length n into bins of one residual; the number placed."""
        need = demand(n)
        most = min(r // d for r, d in zip(residual, need, strict=True))
        after = lambda k: tuple(r - k * d for r, d in zip(residual, need, strict=True))
        full = min(last - first, left // most)
        if full:
            moves.append(Move(n, done, done + full * most, first, most, cap[0] - residual[0]))
            put(after(most), first, first + full)
        placed = full * most
        if first + full < last and (rest := min(left - placed, most)) > 0:
            moves.append(Move(n, done + placed, done + placed + rest, first + full, rest, cap[0] - residual[0]))
            put(after(rest), first + full, first + full + 1)
            placed, full = placed + rest, full + 1
        put(residual, first + full, last)
        return placed

    for n in sorted((x for x in counts if counts[x] > 0), reverse=True):
        total, done, need = counts[n], 0, demand(n)
        queue = [(norm[r], r) for t in range(n, cap[0] + 1) if t in by_tokens for r in by_tokens[t] if r[1] >= 1 and r[2] >= need[2]]
        heapq.heapify(queue)
        while done < total and queue:
            _, residual = heapq.heappop(queue)
            ranges = sorted(open_bins.pop(residual))
            by_tokens[residual[0]].discard(residual)
            if not by_tokens[residual[0]]:
                del by_tokens[residual[0]]
            for first, last in ranges:
                if done < total:
                    done += fill(residual, first, last, n, done, total - done)
                else:
                    put(residual, first, last)
        if done < total:
            most = min(c // d for c, d in zip(cap, need, strict=True))
            more = -(-(total - done) // most)
            fill(cap, bins, bins + more, n, done, total - done)
            bins += more
    return moves


def core_and_tail(word: str) -> tuple[str, str]:
    """A word as two parts with the same ids, one after another: the vocabulary's rules lower-case, and end a word where punctuation follows
    a letter."""
    core = word.rstrip(".,;:!?")
    if not core or not core[-1].isalpha() or core[-1] > "\u00ff":
        core = word
    return core.lower() if core.isascii() else core, word[len(core) :]


class WordTokens:
    """Token ids of texts, by the library, each distinct word once. The vocabulary's rules drop white space and never join what it separates,
    so a text's ids are those of its parts between blanks, one after another."""

    made: dict[str, WordTokens] = {}

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def together(self, words: list[str]) -> list[bytes]:
        """As ``each`` for words of letters up to U+00FF, which are one word for the library as well: many in one text, cut after the ids that
        end a word; one by one if their number is not that of the words."""
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(words):
            return self.each(words)
        packed, ends = ids.tobytes(), ends.tolist()
        return [packed[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def learn(self, words: list[str]) -> None:
        parts = {w: core_and_tail(w) for w in words}
        new = list({p for both in parts.values() for p in both if p not in self.known})
        plain = [w for w in new if w.isalpha() and max(w) <= "\u00ff" and len(w) <= CACHE_WORD_CHARS]
        taken = set(plain)
        other = [w for w in new if w not in taken]
        for some, code, n in ((plain, self.together, 256), (other, self.each, 4096)):
            for s in range(0, len(some), n):
                self.known.update(zip(some[s : s + n], code(some[s : s + n]), strict=True))
        for w, (core, tail) in parts.items():
            if w not in self.known:
                self.known[w] = self.known[core] + self.known[tail]

    def ids(self, texts: Iterable[str]) -> list[bytes]:
        """Of each text, as little-endian unsigned 32-bit numbers."""
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        new = list({w for words in split for w in words if w not in self.known})
        self.learn(new)
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for w in new:
            if len(w) > CACHE_WORD_CHARS:
                self.known.pop(w, None)
                self.known.pop(core_and_tail(w)[0], None)
        return out


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, tokens: int = TOKENS, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, place (its rank among the pieces of this task and length) and, on request, ids."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    key = docs.schema["doc_id"].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = WordTokens.of(path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            found = coder.ids("" if t is None else t for t in batch.column("text").to_pylist())
            of, rows, all_ids = [], [], []
            for i, ids in enumerate(found):
                ids += last
                for piece, start in enumerate(range(0, len(ids), 4 * tokens)):
                    part = ids[start : start + 4 * tokens]
                    length = len(part) // 4
                    rows.append((piece, start // 4, length, zlib.crc32(part), seen[length]))
                    seen[length] += 1
                    of.append(i)
                    if with_ids:
                        all_ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            piece, start, length, crc, place = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True)) if rows else [pa.array([], pa.int64())] * 5
            columns = [batch.column("doc_id").take(pa.array(of, pa.int64())), piece.cast(pa.int32()), start, length, crc, pa.array([task] * len(of), pa.int32()), place]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]
            if with_ids:
                columns, names = [*columns, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {key}, piece int, start long, length long, ids_crc32 long, task int, place long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def place_pieces(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """``pieces`` (a written table with length, task and place) without task and place, with sequence_id and offset."""
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    per_task = materialize(per_task, "lengths")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most as many as tokens in a bin
    moves = sorted(best_fit(counts, capacity), key=lambda m: (m.length, m.first_item))
    field = lambda name: np.array([getattr(m, name) for m in moves], np.int64)
    length, first_item, first_bin, each, offset = (field(f) for f in ("length", "first_item", "first_bin", "each", "offset"))
    starts = length << 47 | first_item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            m = np.searchsorted(starts, size << 47 | rank, "right") - 1
            whole, within = np.divmod(rank - first_item[m], each[m])
            columns = [batch.column(c) for c in kept] + [pa.array(first_bin[m] + whole), pa.array(offset[m] + within * size)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    kept = [c for c in pieces.columns if c not in ("task", "place")]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")  # a row for each task
    ranked = pieces.join(per_task.select("length", "task", before.alias("before")), ["length", "task"]).withColumn("rank", F.col("before") + F.col("place"))
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id long, offset long"
    return ranked.select(*kept, "rank").mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: Capacity = Capacity(), vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, on request, ids, for each piece of each row of ``docs``.

    * A null or empty text is a document of the end token alone; an empty table gives no rows; repeated rows are packed each for itself.
    * Documents longer than a bin are cut into pieces of its length, the last of which may be shorter; others stay whole.
    * Pieces of one length go to their places in the order of the tasks that read them.
    * Columns other than doc_id and text are not read. A ValueError if a capacity of documents or attention cannot hold a piece."""
    pieces = materialize(cut_pieces(docs, vocabulary, capacity.tokens, with_ids=with_ids), "pieces")
    return place_pieces(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, of a packing with ids; a sequence is one bin, so a group is bounded by the capacity."""
    pieces = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(pieces, lambda p: p["ids"])).alias("ids"))


def op13_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
