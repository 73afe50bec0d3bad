"""Near-duplicates by Order MinHash.

A text is its sequence of five-word shingles, each labelled with its occurrence number, so that all are distinct. A sketch takes the
``TAKE`` shingles with the least hashes and keeps them in text order; equal sketches need common shingles in the same order, which
follows edit similarity rather than set similarity. ``SKETCHES`` sketches with independent hashes make candidate pairs.

Candidates are verified by banded alignment: the longest chain of common labelled shingles that keeps their order, within the band
of offsets that a similar pair can have. Similarity is aligned shingles over all shingles of both (an order-keeping Jaccard), 0.8 or
more. Links join into classes.

No bucket is expanded into pairs. Texts, not rows, are compared: copies share a key and are one from the first shuffle on. In a round
each text is compared with one leader, the one that leads most of its buckets (a bucket is led by its text with the least hash, so the
texts of a family have few leaders); what is linked is one class, and the next round compares only members of other classes. Buckets of
two texts are compared as a pair. Larger ones that still hold several classes go through exact prefix filtering: every text outside a
bucket's largest class meets all members of other classes that it can be similar to, so no pair with a common sketch is left open.
That happens within the cells of a bucket, and pairs are compared in the bucket of their first common sketch only.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.llm.common import fresh, materialize, partitions, release, table, text_or_empty
from verdictflow.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
#: A sketch of a pair at similarity 0.8 agrees with probability 0.8**3 = 0.51; 24 of them all fail with 3e-8.
TAKE, SKETCHES = 3, 24
#: Rounds with leaders, and texts and bytes of shingles of a side of one cell when the rest is linked (larger buckets are cut into a grid,
#: see ``link_open_buckets``; no pair is lost).
LEADER_ROUNDS, GROUP, GROUP_BYTES = 2, 4000, 8 << 20
#: Texts with a common sketch up to whose number their keys (some 100 bytes each) are broadcast to fetch them; beyond, a shuffle join does.
BROADCAST_TEXTS = 1 << 19
MIX = np.uint64(0x9E3779B97F4A7C15)
SEEDS = np.array([xxhash.xxh3_64_intdigest(f"sketch {k}".encode()) for k in range(SKETCHES)], np.uint64)


def text_key() -> Column:
    """128 bits that stand for a text; equal texts are those with equal keys."""
    return F.unhex(F.md5(text_or_empty().cast("binary")))


def word_keys(text: str) -> np.ndarray:
    """One 64-bit key for each word (lower case, split at the six ASCII spaces)."""
    digest = xxhash.xxh3_64_intdigest
    known: dict[bytes, int] = {}
    words = text.lower().encode().split()
    for w in words:
        if w not in known:
            known[w] = digest(w)
    return np.fromiter((known[w] for w in words), np.uint64, len(words))


def shingles(keys: np.ndarray) -> np.ndarray:
    """Labelled shingles in text order; a text of fewer words is one shingle, a text without words has none."""
    if not len(keys):
        return np.zeros(0, np.uint64)
    n = max(1, len(keys) - SHINGLE + 1)
    h = np.full(n, min(len(keys), SHINGLE), np.uint64)
    for k in range(min(SHINGLE, len(keys))):
        h = (h ^ keys[k : k + n]) * MIX
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.arange(n)
    label = np.empty(n, np.uint64)
    label[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    h = (h ^ (label * np.uint64(0xC2B2AE3D27D4EB4F))) * MIX
    return h ^ (h >> np.uint64(32))


def sketches(labelled: np.ndarray) -> np.ndarray:
    """Order MinHash keys of a text, one for each sketch. Texts with fewer shingles than a sketch takes use all they have."""
    n = len(labelled)
    if not n:
        return np.zeros(0, np.uint64)
    take = min(TAKE, n)
    chosen = np.empty((SKETCHES, take), np.int64)
    for k, seed in enumerate(SEEDS):
        h = (labelled ^ seed) * MIX
        h ^= h >> np.uint64(31)
        chosen[k] = np.argpartition(h, take - 1)[:take] if n > take else np.arange(n)
    picked = labelled[np.sort(chosen, axis=1)]  # text order
    keys = SEEDS.copy()
    for t in range(take):
        keys = (keys ^ picked[:, t]) * MIX
        keys ^= keys >> np.uint64(33)
    return keys


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> int:
    """Longest chain of shingles common to both, in the order of both, within the band a pair of this similarity can need."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0
    order = np.argsort(i)
    i, j = i[order], j[order]
    # A pair this similar leaves at most so many shingles unaligned; an offset beyond it would leave more.
    band = int((len(a) + len(b)) * (1 - similarity) / (1 + similarity)) + 1
    j = j[np.abs(i - j) <= band]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect.bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return len(tails)


def similarity_of(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Aligned shingles over all shingles of both; 0 if the lengths alone rule out ``similarity``."""
    small, large = sorted((len(a), len(b)))
    if not small or small < similarity * large:
        return 0.0
    m = aligned(a, b, similarity)
    return m / (len(a) + len(b) - m)


def sketch_texts(texts: DataFrame) -> DataFrame:
    """(key, doc_id, n, sig) for each row of ``texts`` (key, doc_id, text): the number of shingles and the sketches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(word_keys(t)) for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "doc_id": batch["doc_id"], "n": [len(x) for x in found], "sig": [sketches(x).view(np.int64) for x in found]})

    return texts.mapInPandas(run, "key binary, doc_id string, n int, sig array<long>")


def shingle_texts(texts: DataFrame) -> DataFrame:
    """(key, s): the labelled shingles of each row of ``texts`` (key, text), packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "s": [shingles(word_keys(t)).tobytes() for t in batch["text"]]})

    return texts.mapInPandas(run, "key binary, s binary")


class Postings:
    """The shingles of the texts of one cell: which texts have each, and the prefix of each text by rarity."""

    def __init__(self, members: list[np.ndarray], similarity: float):
        self.sizes = np.array([len(m) for m in members])
        _, number, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
        self.of = np.split(number, np.cumsum(self.sizes)[:-1])
        owner = np.repeat(np.arange(len(members), dtype=np.int32), self.sizes)
        self.owner, self.ends = owner[np.argsort(number, kind="stable")], np.cumsum(count)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        # So many of the rarest shingles that two texts of this similarity share one.
        keep = [len(r) - int(np.ceil(similarity * len(r) - 1e-9)) + 1 for r in self.of]
        rare = [r[np.argsort(rank[r])[:k]] for r, k in zip(self.of, keep, strict=True)]
        self.rare = rare
        token, holder = np.concatenate(rare), np.repeat(np.arange(len(rare), dtype=np.int32), [len(r) for r in rare])
        order = np.argsort(token, kind="stable")
        self.token, self.holder = token[order], holder[order]

    def candidates(self, x: int) -> np.ndarray:
        """Texts whose prefix shares a shingle with that of ``x``."""
        low, high = np.searchsorted(self.token, self.rare[x]), np.searchsorted(self.token, self.rare[x], "right")
        return np.unique(np.concatenate([self.holder[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]))

    def common(self, x: int) -> np.ndarray:
        """How many shingles of ``x`` each text has."""
        ends = self.ends[self.of[x]]
        starts = np.where(self.of[x] > 0, self.ends[self.of[x] - 1], 0)
        return np.bincount(np.concatenate([self.owner[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), minlength=len(self.sizes))


def link_bucket(group: pd.DataFrame, similarity: float = SIMILARITY) -> pd.DataFrame:
    """Links (u, v) between the classes of one cell of a bucket: the texts of its row (``rest``) against those of its column (``against``).

    Pairs are left out only where they cannot matter: of one class by now, of lengths, rarest shingles (prefix filtering, exact) or too
    few common shingles to be similar, with an earlier sketch in common, in whose bucket they are compared, or of two texts outside the
    largest class the other way round."""
    keys, rest, against, outside = group["key"].to_numpy(), group["rest"].to_numpy(bool), group["against"].to_numpy(bool), group["outside"].to_numpy(bool)
    if not rest.any() or not against.any():
        return pd.DataFrame([], columns=["u", "v"])
    members = [np.frombuffer(x, np.uint64) for x in group["s"]]
    postings = Postings(members, similarity)
    sizes = postings.sizes
    sig = np.stack(group["sig"].to_numpy())
    k = int(np.flatnonzero(sig[0] == group["band"].iloc[0])[0])
    _, code = np.unique(np.array([r.hex() for r in group["root"]]), return_inverse=True)
    code = code.copy()
    links = []
    for x in np.flatnonzero(rest).tolist():
        y = postings.candidates(x)
        y = y[against[y]]
        y = y[(code[y] != code[x]) & ~(outside[y] & (keys[y] > keys[x])) & (np.minimum(sizes[y], sizes[x]) >= similarity * np.maximum(sizes[y], sizes[x]))]
        if not len(y):
            continue
        same = sig[y] == sig[x]
        first = ~same[:, :k].any(axis=1)
        y, shared = y[first], same[first].sum(axis=1)
        if len(y) > 4:  # aligned shingles are common ones
            enough = postings.common(x)[y] >= (sizes[y] + sizes[x]) * (similarity / (1 + similarity)) - 1e-6
            y, shared = y[enough], shared[enough]
        for at in y[np.argsort(-shared, kind="stable")].tolist():  # the likeliest first, as one link settles a class
            if code[at] != code[x] and similarity_of(members[x], members[at], similarity) >= similarity:
                links.append((max(keys[x], keys[at]), min(keys[x], keys[at])))
                code[code == code[at]] = code[x]
    return pd.DataFrame(links, columns=["u", "v"])


def verify_pairs(pairs: DataFrame, packed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows (u, v) of ``pairs`` that are similar. Two joins bring the packed shingles to each pair."""
    left = packed.select(F.col("key").alias("u"), F.col("s").alias("a"))
    right = packed.select(F.col("key").alias("v"), F.col("s").alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [similarity_of(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), similarity) >= similarity for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield batch.loc[ok, ["u", "v"]]

    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInPandas(run, "u binary, v binary")


def near(a: Column | str, b: Column | str, similarity: float) -> Column:
    """Whether texts of so many shingles can be similar."""
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)


def with_roots(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``members`` (band, key, n) with the class of each so far."""
    if roots is None:
        return members.withColumn("root", F.col("key"))
    return members.join(roots.withColumnRenamed("node", "key"), "key", "left").select("band", "key", "n", F.coalesce("root", "key").alias("root"))


def leader_pairs(now: DataFrame, seed: int, similarity: float) -> DataFrame:
    """Pairs (u, v) of each text with the text of another class that leads most of its buckets, and the texts of buckets of two."""
    least = F.min(F.struct(F.xxhash64(F.lit(seed), "key").alias("h"), F.col("key").alias("leader"), F.col("root").alias("of"), F.col("n").alias("m")))
    most = F.max(F.struct(F.xxhash64(F.lit(seed), "key").alias("h"), F.col("key").alias("other")))
    led = now.groupBy("band").agg(least.alias("p"), most.alias("q"), F.count(F.lit(1)).alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    under = now.join(led.select("band", "p.*", "c"), "band").where("root <> of").where(near("n", "m", similarity))
    votes = under.groupBy("key", "leader").agg(F.count(F.lit(1)).alias("votes"), F.max(F.col("c") == 2).alias("two"))
    first = votes.groupBy("key").agg(F.max(F.struct("votes", "leader")).alias("f")).select("key", "f.leader")
    chosen = first.union(votes.where("two").select("key", "leader"))
    return chosen.select(F.greatest("key", "leader").alias("u"), F.least("key", "leader").alias("v")).distinct()


def link_open_buckets(now: DataFrame, packed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) between the classes of every bucket of three texts or more (those of two are compared as a pair).

    A large bucket is a grid: its texts are cut into columns and those outside its largest class into rows, and a cell compares the
    texts of its row with those of its column. Every pair meets in a cell; a text of the largest class is sent once for each row only."""
    classes = now.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"), F.sum(F.lit(8) * F.col("n")).alias("size"))
    whole = classes.groupBy("band").agg(F.max(F.struct("c", "root", "size")).alias("most"), F.sum("c").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("classes"))
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(n / GROUP), F.ceil(size / GROUP_BYTES)).cast("int")
    open_ = whole.where("classes > 1 and n > 2").select(
        "band", "most.root", parts(F.col("n"), F.col("size")).alias("columns"), parts(F.col("n") - F.col("most.c"), F.col("size") - F.col("most.size")).alias("rows")
    )
    placed = now.join(open_.withColumnRenamed("root", "most"), "band").select(
        "band",
        "key",
        "root",
        (F.col("root") != F.col("most")).alias("outside"),
        "columns",
        "rows",
        F.pmod(F.xxhash64(F.lit("column"), "key"), "columns").cast("int").alias("column"),
        F.pmod(F.xxhash64(F.lit("row"), "key"), "rows").cast("int").alias("row"),
    )
    down = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda y: F.struct(F.col("column").alias("x"), y.alias("y")))
    along = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda x: F.struct(x.alias("x"), F.col("row").alias("y")))
    cells = placed.withColumn("cell", F.explode_outer(F.when(F.col("outside"), F.array_union(down, along)).otherwise(down)))
    cells = cells.select("band", "cell", "key", "root", (F.col("outside") & (F.col("row") == F.col("cell.y"))).alias("rest"), (F.col("column") == F.col("cell.x")).alias("against"), "outside")
    grouped = cells.join(packed, "key").select("band", "cell.x", "cell.y", "key", "root", "outside", "rest", "against", "s", "sig")
    return grouped.groupBy("band", "x", "y").applyInPandas(lambda group: link_bucket(group, similarity), "u binary, v binary").distinct()


def merge_classes(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, root) after the links ``found`` (u, v): only the classes they touch are joined anew."""
    if roots is None:
        return connected_components(found)
    u, v = roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
    between = found.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    new = materialize(connected_components(between).select("node", F.col("root").alias("to")), "classes")
    moved = roots.join(new.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    both = moved.union(new.select("node", F.col("to").alias("root"))).distinct()
    return materialize(both, "roots")


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): the class of each distinct text that has a near-duplicate; nodes are ``text_key``.

    Equal texts share a key and are compared once. Texts without words are alike only if equal."""
    spark = docs.sparkSession
    texts = docs.select(text_key().alias("key"), F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    # Copies become one row before the shuffle and after it; the least id tells which row stands for them.
    sketched = materialize(sketch_texts(texts).groupBy("key", "n", "sig").agg(F.min("doc_id").alias("doc_id")), "sketches")
    bands = sketched.select("key", "n", F.explode("sig").alias("band"))
    shared = bands.groupBy("band").agg(F.min(F.xxhash64("key")).alias("low"), F.max(F.xxhash64("key")).alias("high")).where("low <> high").select("band")
    members = materialize(bands.join(shared, "band"), "members")
    wanted = materialize(sketched.join(members.select("key").distinct(), "key", "left_semi"), "wanted")
    release(sketched)
    few = wanted.select(F.col("key").alias("w"), F.col("doc_id").alias("w_id"))
    if wanted.count() <= BROADCAST_TEXTS:
        few = F.broadcast(few)
    stands = texts.join(few, (F.col("key") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi")
    packed = shingle_texts(stands).groupBy("key").agg(F.first("s").alias("s"))  # repeated rows have the same id and text
    packed = materialize(packed.join(wanted.select("key", "sig"), "key"), "shingles")
    roots: DataFrame | None = None
    tested: DataFrame | None = None
    for r in range(LEADER_ROUNDS):
        pairs = leader_pairs(with_roots(members, roots), r, similarity)
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = materialize(verify_pairs(pairs.repartition(partitions(spark), "u", "v"), packed, similarity), "found")
        roots = merge_classes(roots, found)
    found = materialize(link_open_buckets(with_roots(members, roots), packed, similarity), "found")
    return merge_classes(roots, found)


def classify_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: doc_id and class_id, the smallest doc_id of its class.

    * Equal texts are one class, null and empty texts among them (null counts as empty). Texts of other words, or of the same words
      with other spaces or case, fall together by similarity 1.
    * Null ids keep their row; their class is that of their text, null if all its ids are null.
    * Repeated rows each get a row. Empty tables give an empty result. Columns other than doc_id and text are not read.
    """
    slim = docs.select("doc_id", text_key().alias("key"))
    classes = near_duplicate_classes(docs, similarity).select(F.col("node").alias("key"), "root")
    rooted = slim.join(classes, "key", "left").select("doc_id", F.coalesce("root", "key").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rooted.join(ids, "root").select("doc_id", "class_id", "class_size")


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with one row of each class: that of the smallest doc_id (null first, then by text), columns unchanged.

    * Null and empty texts are one class. Of rows with the same doc_id and text one stays: the one with the least hash of all columns.
    * Empty tables stay empty; columns may have any names. The choice is an aggregation over slim rows."""
    columns = docs.columns
    key, root, ident, first_key, times = fresh(docs, "key", "root", "ident", "first_key", "times")
    keyed = docs.withColumn(key, text_key())
    classes = near_duplicate_classes(docs, similarity).select(F.col("node").alias(key), F.col("root").alias(root))
    slim = keyed.select(F.col("doc_id").alias(ident), key).join(classes, key, "left").select(ident, key, F.coalesce(root, key).alias(root))
    # struct order puts a null id first, so that a class of null ids keeps a row as well
    first = slim.groupBy(root, ident, key).agg(F.count(F.lit(1)).alias(times)).groupBy(root).agg(F.min(F.struct(ident, key, times)).alias("f"))
    first = materialize(first.select(f"f.{ident}", F.col(f"f.{key}").alias(first_key), f"f.{times}"), "first")
    kept = keyed.join(first, keyed["doc_id"].eqNullSafe(first[ident]) & (keyed[key] == first[first_key]), "left_semi")
    if not first.where(F.col(times) > 1).limit(1).count():
        return kept.select(*[F.col(f"`{c}`") for c in columns])
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    one = kept.groupBy(F.col("doc_id").alias(ident), F.col(key)).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(root))
    return one.select(*[F.col(f"{root}.`{c}`").alias(c) for c in columns])


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
