"""Dataset operators: de-duplication, caps, splits, sampling, balance, leaks and contradictions.

Order within a group is always a column given by the caller or a hash of a key, never the order of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictflow.functions.text import hash_bucket, hash_slot


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """The names, each changed until no column of ``rows`` has it (in any case)."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def all_of(rows: DataFrame) -> list[Column]:
    """The columns of ``rows``, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in rows.columns]


def keep_first(rows: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key, by aggregation (no group is sorted)."""
    first = F.min_by(F.struct(*all_of(rows)), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return rows.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(first.alias("_r")).select("_r.*")


def cap_per_key(rows: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column]) -> DataFrame:
    """At most ``n`` rows of each key, in order. Spark limits each task's groups before the shuffle (WindowGroupLimit)."""
    (rn,) = fresh(rows, "_rn")
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= n).drop(rn)


def two_caps(rows: DataFrame, message: str, template: str, per_message: int, per_template: int, order: Column) -> DataFrame:
    """At most so many copies of a message, then at most so many of the survivors of a template."""
    return cap_per_key(cap_per_key(rows, [message], per_message, [order]), [template], per_template, [order])


def split_by_hash(rows: DataFrame, state: Column, question: Column, explicit: Column | None = None) -> DataFrame:
    """``split``: one tenth to gate by SHA-256, the rest train; an explicit split wins."""
    hashed = F.when(hash_bucket(F.concat(state, F.lit("\n"), question), 10) == 0, "gate").otherwise("train")
    return rows.withColumn("split", hashed if explicit is None else F.coalesce(explicit, hashed))


def split_groups(rows: DataFrame, group: Column, share: float = 0.1) -> DataFrame:
    """``split`` by the hash of a group, so that no group straddles the splits."""
    return rows.withColumn("split", F.when(hash_slot(group) < share, "gate").otherwise("train"))


def budget_rate(rows: DataFrame, size: Column, priority: Column, budget: int) -> DataFrame:
    """One row: bytes of priority and of bulk rows, and the rate at which bulk rows fit the budget (1 if there are none)."""
    sums = rows.agg(F.coalesce(F.sum(F.when(priority, size)), F.lit(0)).alias("priority_bytes"), F.coalesce(F.sum(F.when(~priority, size)), F.lit(0)).alias("bulk_bytes"))
    rate = F.coalesce(F.try_divide(F.lit(budget) - F.col("priority_bytes"), F.col("bulk_bytes").cast("double")), F.lit(1.0))
    return sums.withColumn("rate", F.least(F.lit(1.0), F.greatest(F.lit(0.0), rate)))


def sample_by_rate(rows: DataFrame, key: Column, priority: Column, rate: DataFrame) -> DataFrame:
    """Priority rows and the bulk rows whose hash is within the rate (a one-row table)."""
    return rows.join(F.broadcast(rate.select(F.col("rate").alias("_rate")))).where(priority | (hash_slot(key) <= F.col("_rate"))).drop("_rate")


def sample_per_group(rows: DataFrame, group: Sequence[str], n: int, key: Column, seed: int = 20260929) -> DataFrame:
    """``n`` rows of each group with the lowest keyed hashes: a reservoir's distribution, the same members every run."""
    return cap_per_key(rows, group, n, [F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)])


def round_robin(rows: DataFrame, source: str, template: str, n: int, order: Column) -> DataFrame:
    """``n`` rows of each source, taken in turns from its templates. For ``n`` up to a thousand Spark limits both numberings within each task
    before it shuffles (WindowGroupLimit), so what meets for a source is ``n`` rows from each task."""
    turn = F.row_number().over(Window.partitionBy(source, template).orderBy(order))
    place = F.row_number().over(Window.partitionBy(source).orderBy("_turn", template))
    return rows.withColumn("_turn", turn).where(F.col("_turn") <= n).withColumn("_place", place).where(F.col("_place") <= n).drop("_turn", "_place")


def least_digests(rows: DataFrame, by: Sequence[str], most: str, digest: Column) -> DataFrame:
    """Of each group the rows with the least hexadecimal digests, as many as the column ``most`` says.

    Groups may hold most of the table. Rows are counted by the first four digits of the digest, which tells for each such part how many
    rows come before it; only within a part are rows numbered, so a task holds parts and never a group."""
    group, key, part, size, before, place = fresh(rows, "_group", "_digest", "_part", "_size", "_before", "_place")
    of_group = F.to_json(F.struct(*[F.col(b).alias(f"k{i}") for i, b in enumerate(by)]))
    cut = rows.withColumns({group: of_group, key: digest}).withColumn(part, F.substring(key, 1, 4))
    sizes = cut.groupBy(group, part).agg(F.count(F.lit(1)).alias(size))
    running = F.sum(size).over(Window.partitionBy(group).orderBy(part))  # at most 65,536 parts a group
    earlier = sizes.select(group, part, (running - F.col(size)).alias(before))
    number = F.col(before) + F.row_number().over(Window.partitionBy(group, part).orderBy(key))
    open_parts = cut.join(earlier, [group, part]).where(F.col(before) < F.col(most))
    return open_parts.withColumn(place, number).where(F.col(place) <= F.col(most)).select(*all_of(rows))


def balance(rows: DataFrame, label: str, digest: Column) -> DataFrame:
    """Every label cut to the size of the smallest, by digests. The size is an aggregate, joined as one row."""
    (most,) = fresh(rows, "_least")
    least = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias(most))
    return least_digests(rows.join(F.broadcast(least)), [label], most, digest).drop(most)


def stratified_negatives(rows: DataFrame, positive: Column, hard: Column, digest: Column) -> DataFrame:
    """All positives and as many negatives, by digests: half of them hard ones if there are enough, the rest easy ones."""
    kind, n, take, most = fresh(rows, "_kind", "_n", "_take", "_most")
    tagged = rows.withColumn(kind, F.when(positive, "positive").when(hard, "hard").otherwise("easy"))
    counts = tagged.agg(F.count_if(F.col(kind) == "positive").alias(n), F.count_if(F.col(kind) == "hard").alias(take))
    counts = counts.select(n, F.least(F.col(take), F.floor(F.col(n) / 2)).alias(take))
    quota = F.when(F.col(kind) == "positive", F.col(n)).when(F.col(kind) == "hard", F.col(take)).otherwise(F.col(n) - F.col(take))
    return least_digests(tagged.join(F.broadcast(counts)).withColumn(most, quota), [kind], most, digest).select(*all_of(rows))


def repeat_rows(rows: DataFrame, weight: Column) -> DataFrame:
    """Each row ``weight`` times (0 or less: not at all)."""
    return rows.withColumn("copy", F.explode(F.when(weight > 0, F.sequence(F.lit(1), weight)).otherwise(F.array().cast("array<int>"))))


def quotas(total: int, keys: Sequence[str]) -> dict[str, int]:
    """Even shares; what is left over goes to the first keys."""
    return {k: total // len(keys) + (i < total % len(keys)) for i, k in enumerate(keys)}


def semi(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is known. Spark broadcasts the known keys if they prove small at run time, else both sides are shuffled."""
    return rows.join(known.select(key).distinct(), key, "left_semi")


def anti(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_anti")


def drop_questions(rows: DataFrame, leaked: DataFrame, key_of: Column) -> DataFrame:
    """Rows (row_id, questions) without their leaked questions; rows left without any go."""
    flat = rows.select("row_id", F.posexplode("questions").alias("at", "question")).withColumn("key", key_of)
    left = flat.join(leaked.select("key").distinct(), "key", "left_anti")
    kept = left.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("at", "question"))).alias("q"))
    return kept.select("row_id", F.transform("q", lambda x: x["question"]).alias("questions"))


def leaks_by_text(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the item's text ``t`` is not empty and occurs in the document's, which is not shuffled while the items fit
    one automaton; see ``contained``."""
    from verdictflow.operators.containment import contained

    found = contained(docs.select(F.col("doc_id").alias("ident"), F.col("t").alias("text")), items.select(F.col("item_id").alias("name"), F.col("t").alias("s")))
    return found.select(F.col("ident").alias("doc_id"), F.col("name").alias("item_id"))


def contradictions(rows: DataFrame, key: Sequence[str], answer: str, order: str) -> DataFrame:
    """``first_answer`` of each key (by order) and ``conflict`` where a row's differs."""
    first = rows.groupBy(*key).agg(F.min_by(answer, order).alias("first_answer"))
    return rows.join(first, list(key)).withColumn("conflict", ~F.col(answer).eqNullSafe(F.col("first_answer")))


def first_lines(rows: DataFrame, key: str, order: str, text: str, n: int = 15) -> DataFrame:
    """The first ``n`` texts of each key, one to a line."""
    few = cap_per_key(rows, [key], n, [F.col(order)])
    lines = F.sort_array(F.collect_list(F.struct(order, text)))
    return few.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x[text]), "\n").alias("lines"))


def carry_forward(lines: DataFrame, group: str, order: str, heading: Column) -> DataFrame:
    """``heading`` of each line: the latest one at or before it in its file."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(heading, ignorenulls=True).over(w))
