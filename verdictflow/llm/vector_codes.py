"""Compression of vectors to codes: a product quantizer on integers, trained and applied by partial-distance search.

Vectors become integers and are cut into equal parts, each with a codebook of its own. A round of training is one scan: every task adds up
the parts that it assigns to each entry and hands on at most one row for each part and entry, so nothing but those sums is shuffled and
nothing but codebooks (parts x entries x length of a part) reaches the driver or goes back in the tasks' closure.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.llm.common import fresh, materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components beyond this have no exact distance in 64 bits.
LARGEST = 1 << 27
#: Vectors compared at once: with 256 entries, 131,072 partial distances, which a processor's cache holds.
BLOCK = 512
#: Distinct labels up to which their sums are broadcast; beyond it, only those of labels with over 1 / HOT of the rows are.
FEW_LABELS, HOT = 100_000, 10_000


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry for each row of ``x`` (ties to the lower index) and the squared distance, in integers.

    Positions are added up in descending variance of the codebook. After most of them, and again later, the entry that leads so far is
    completed; entries whose sum strictly exceeds the best complete distance are masked out, so only pairs that may win go on. (Whole
    columns are so much cheaper than picked pairs that masks pay from five eighths of the positions on.) Sums are of the type of ``x``."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    n, d = x.shape
    lead = max(1, 5 * d // 8)
    sums = np.zeros((n, len(book)), x.dtype)
    for j in range(lead):
        step = x[:, j, None] - book[None, :, j]
        step *= step
        sums += step
    first = sums.argmin(axis=1)
    rest = x[:, lead:] - book[first, lead:]
    best = sums[np.arange(n), first] + (rest * rest).sum(axis=1)
    row, entry = np.nonzero(sums <= best[:, None])  # by row, entries ascending; the entry completed above is always among them
    sums = sums[row, entry]
    for j in range(lead, d):
        step = x[row, j] - book[entry, j]
        sums += step * step
        if j + 1 == (lead + d) // 2 < d:  # complete the entry that leads now
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.minimum.reduceat(sums, starts)
            at = np.flatnonzero(sums == np.repeat(least, np.diff(np.r_[starts, len(row)])))
            at = at[np.r_[True, row[at][1:] != row[at][:-1]]]
            rest = x[row[at], j + 1 :] - book[entry[at], j + 1 :]
            best[row[at]] = np.minimum(best[row[at]], sums[at] + (rest * rest).sum(axis=1))
        alive = sums <= best[row]
        row, entry, sums = row[alive], entry[alive], sums[alive]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(sums, starts)
    at = np.flatnonzero(sums == np.repeat(least, np.diff(np.r_[starts, len(row)])))
    at = at[np.r_[True, row[at][1:] != row[at][:-1]]]
    return entry[at], sums[at]


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x parts entries, rows x parts distances) for books of shape parts x entries x positions."""
    parts, _, width = books.shape
    entries, distances = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
    if len(x) and width * (int(np.abs(x).max()) + int(np.abs(books).max())) ** 2 < 1 << 31:
        x, books = x.astype(np.int32), books.astype(np.int32)  # no distance overflows
    for s in range(0, len(x), BLOCK):
        for p in range(parts):
            entries[s : s + BLOCK, p], distances[s : s + BLOCK, p] = nearest(x[s : s + BLOCK, p * width : (p + 1) * width], books[p])
    return entries, distances


def matrix(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    if len(x) and (x.max() > LARGEST or x.min() < -LARGEST):
        raise ValueError(f"a component times {SCALE} is beyond {LARGEST}: its distances don't fit 64 bits")
    return x


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (integers) of the rows whose vector is there, without null or non-finite components."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = vectors.where(F.col("embedding").isNotNull() & ~odd)
    return whole.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The first ``entries`` vectors by vec_id (nulls last, then by components), cut into parts: parts x entries x positions."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    rows = [r["v"] for r in kept.select("vec_id", "v").orderBy(*order).limit(entries).collect()]
    width = next((len(v) for v in rows if v and len(v) % parts == 0), None)
    if width is None or any(len(v) != width for v in rows):
        first = kept.where((F.size("v") > 0) & (F.size("v") % parts == 0)).select("vec_id", "v").orderBy(*order).first()
        if first is None:
            return None
        width = len(first["v"])
        rows = [r["v"] for r in kept.where(F.size("v") == width).select("vec_id", "v").orderBy(*order).limit(entries).collect()]
    x = np.array(rows, np.int64)
    return np.ascontiguousarray(x.reshape(len(x), parts, width // parts).transpose(1, 0, 2))


def improved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part to its nearest entry, then each entry to the floor of its parts' mean; unused entries stay."""
    parts, entries, width = books.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), parts * width)
            chosen, _ = assign(x, books)
            for p in range(parts):
                order = np.argsort(chosen[:, p], kind="stable")
                which, starts, n = np.unique(chosen[order, p], return_index=True, return_counts=True)
                if len(which):
                    sums[p, which] += np.add.reduceat(x[order, p * width : (p + 1) * width], starts, axis=0)
                    counts[p, which] += n
        p, e = np.nonzero(counts)
        columns = [p.astype(np.int32), e.astype(np.int32), counts[p, e], *sums[p, e].T.copy()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "n", *(f"s{j}" for j in range(width))])

    schema = "part int, entry int, n long" + "".join(f", s{j} long" for j in range(width))
    found = kept.select("v").mapInArrow(add_up, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)])
    out = books.copy()
    for r in found.collect():  # at most parts x entries rows
        out[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return out


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_sum_of_equals(rows: DataFrame, by: str, value: str, name: str, few: int = FEW_LABELS, hot: int = HOT) -> DataFrame:
    """``name``: the sum of ``value`` over all rows with an equal ``by`` (nulls are equal). ``rows`` should be a written table. Sums are
    broadcast while they are few; beyond that those of hot labels are (at most ``hot``), and only rows of the others are shuffled."""
    key, n = fresh(rows, "same", "times")
    sums = rows.groupBy(F.col(by).alias(key)).agg(F.sum(value).alias(name), F.count(F.lit(1)).alias(n))
    sums = materialize(sums, "label-sums")
    same = F.col(by).eqNullSafe(F.col(key))
    facts = sums.agg(F.count(F.lit(1)).alias("labels"), F.sum(n).alias("rows")).first()
    if facts["labels"] <= few:
        return rows.join(F.broadcast(sums), same).drop(key, n)
    often = sums.where(F.col(n) * hot > facts["rows"])
    tagged = rows.join(F.broadcast(often), same, "left")
    known = tagged.where(F.col(n).isNotNull()).drop(key, n)
    rest = tagged.where(F.col(n).isNull()).drop(key, n, name).join(sums.where(F.col(n) * hot <= facts["rows"]), same).drop(key, n)
    return known.unionByName(rest)


def encode_vectors(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part), error of each kept row of ``vectors``."""
    parts, _, width = books.shape
    kept = kept_vectors(vectors)
    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            fits = pc.equal(pc.list_value_length(v), parts * width)
            chosen, distances = assign(matrix(v.filter(fits), parts * width), books)
            at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
            codes, errors = np.full(len(v), None, object), np.zeros(len(v), np.int64)
            codes[at] = ["".join(c) for c in digits[chosen].tolist()]
            errors[at] = distances.sum(axis=1)
            missing = np.ones(len(v), bool)
            missing[at] = False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, mask=missing)], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row whose vector can be coded.

    * Rows whose vector is null or holds null or non-finite components are left out; an empty table gives no rows.
    * Fewer vectors than ``entries``: the codebook has an entry for each. Null vec_ids come last in the order of the first entries; rows with
      equal ids are ordered by their components. Repeated rows are coded alike, each once.
    * The length of a vector is that of the first kept one that can be cut into equal parts; rows of another length take no part in the
      training and come out with a null code and error, counting nothing towards their label.
    * A component whose integer is beyond 2^27 is an error, as its distances do not fit the 64 bits of the result.
    * Columns other than vec_id, embedding and label are not read."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hexadecimal digits: 1 to 256 entries")
    vectors = vectors.select("vec_id", "embedding", "label")
    kept = kept_vectors(vectors)
    books = first_codebooks(kept, parts, entries)
    if books is None:
        return kept.select("vec_id", F.lit(None).cast("string").alias("code"), *[F.lit(None).cast("long").alias(c) for c in ("error", "label_error")], F.lit(codebooks_digest(np.zeros(0, np.int64))).alias("codebooks_sha256"))
    fitting = kept.where(F.size("v") == books.shape[0] * books.shape[2])
    for _ in range(rounds):
        books = improved(fitting, books)
    coded = materialize(encode_vectors(vectors, books), "codes")
    out = with_sum_of_equals(coded, "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The whole computation for DuckDB, rounds written one after another. Inner products of doubles are exact at this size."""
    floor = "(s - ((s % n) + n) % n) // n"
    steps = [
        """kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) t(p))",
        "ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 256)",
        "b0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN ids USING (vec_id))",
    ]
    for r in range(5):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, p, any_value(label) AS label, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS m
  FROM (SELECT vec_id, label, parts.p, x, e, CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) AS d FROM parts JOIN b{r} USING (p))
  GROUP BY vec_id, p)""")
        if r < 4:
            steps.append(f"""u{r} AS (SELECT p, e, list(CAST({floor} AS DOUBLE) ORDER BY j) AS c FROM (
  SELECT p, m.e AS e, j, CAST(sum(CAST(x[j] AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, 17) t(j) GROUP BY p, m.e, j) GROUP BY p, e)""")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(u{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN u{r} USING (p, e))")
    steps.append("""books AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS s FROM b4)""")
    steps.append("""coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a4 GROUP BY vec_id)""")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM coded, books"


OP11_SQL = _sql()
