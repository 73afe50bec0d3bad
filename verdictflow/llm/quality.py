"""Quality rules by weak supervision.

Rules vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the counts of vote patterns estimates how
accurate every rule is and how common good documents are; the posterior probability of "good" decides.

Features are DataFrame functions over one scan. Their slim rows are written once; the pattern counts, at most
``3 ** len(RULES)`` rows whatever the input, are all that reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.llm.common import WORD_SPACE, materialize, table, text_or_empty

MIN_WORDS = 20
REPEAT_PERCENT = 30
REPEAT_WORDS = 8
KEEP_POSTERIOR = 0.5
EM_ROUNDS = 40
#: Bounds of the share of good documents and of the evidence (log odds) of one vote, so that no rule is ever certain.
PRIOR = (0.02, 0.95)
MOST_EVIDENCE = 6.0
#: Rates of good (1) and bad (-1) votes expected in good and in bad documents before any is seen, and how much that belief
#: weighs, as a share of the documents: a common kind of junk that only one rule sees must not pass for good.
EXPECTED = {1: (0.9, 0.8), -1: (0.002, 0.3)}
PRIOR_STRENGTH = 0.3
#: Low bits of a window's key that hold its position: for texts of fewer than a million windows, and of more.
POSITION_BITS = (20, 31)
RULES = ("length", "word_length", "symbols", "marks", "capitals", "lines", "repeats")


def text_features(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the feature columns, named with ``prefix``.

    Repeated windows are found in the row itself: eight-word window hashes by doubling, sorted with their position packed into
    the low bits, neighbours compared and equal hashes checked word by word. Nothing is shuffled.
    """
    p = prefix
    c = lambda name: f"`{p}{name}`"
    df = docs.withColumn(f"{p}t", text_or_empty(text))
    df = df.withColumns(
        {
            f"{p}words": F.array_remove(F.split(f"{p}t", WORD_SPACE), ""),
            f"{p}lines": F.expr(rf"filter(split({c('t')}, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"),
            f"{p}n_symbols": (F.length(f"{p}t") - F.length(F.regexp_replace(f"{p}t", r"[#*$%&|<>]+", ""))).cast("long"),
            f"{p}n_marks": (F.length(f"{p}t") - F.length(F.regexp_replace(f"{p}t", r"[!-@\[-`{-~]+", ""))).cast("long"),
            f"{p}n_upper": F.length(F.regexp_replace(f"{p}t", r"\P{Lu}+", "")).cast("long"),
        }
    )
    df = df.withColumns(
        {
            f"{p}n_words": F.size(f"{p}words").cast("long"),
            f"{p}word_chars": F.length(F.array_join(f"{p}words", "")).cast("long"),
            f"{p}n_lines": F.size(f"{p}lines").cast("long"),
            f"{p}n_dup_lines": F.expr(f"size({c('lines')}) - size(array_distinct({c('lines')}))").cast("long"),
            f"{p}h1": F.expr(f"transform({c('words')}, w -> xxhash64(w))"),
        }
    ).drop(f"{p}lines", f"{p}t")
    # Windows of half the length first, null where they run past the end: a document without an equal pair of them needs no more work.
    half = REPEAT_WORDS // 2
    ahead = ", ".join(f"get({c('h1')}, i + {k})" for k in range(1, half))
    df = df.withColumn(f"{p}h4", F.expr(f"transform({c('h1')}, (x, i) -> if(i + {half} > size({c('h1')}), -i, xxhash64(x, {ahead})))")).drop(f"{p}h1")
    h4 = c("h4")
    df = df.withColumn(
        f"{p}h8",
        F.expr(
            f"if(size(array_distinct({h4})) = size({h4}), array(), transform(slice({h4}, 1, greatest(size({h4}) - {REPEAT_WORDS - 1}, 0)), (x, i) -> xxhash64(x, get({h4}, i + {half}))))"
        ),
    ).drop(f"{p}h4")
    h = c(f"h{REPEAT_WORDS}")
    df = df.withColumn(f"{p}bits", F.expr(f"if(size({h}) < 1048576, {POSITION_BITS[0]}, {POSITION_BITS[1]})"))
    bits = c("bits")
    df = df.withColumn(
        f"{p}sorted",
        F.expr(
            f"if(size(array_distinct({h})) = size({h}), array(), "
            f"array_sort(transform({h}, (x, i) -> shiftleft(shiftrightunsigned(x, {bits}), {bits}) | cast(i as bigint))))"
        ),
    ).drop(f"{p}h{REPEAT_WORDS}")
    s, low, words = c("sorted"), f"(shiftleft(1L, {bits}) - 1L)", c("words")
    same_words = " and ".join(f"get({words}, cast(a & {low} as int) + {k}) = get({words}, cast(b & {low} as int) + {k})" for k in range(REPEAT_WORDS))
    df = df.withColumn(
        f"{p}same",
        F.expr(f"zip_with(slice({s}, 1, greatest(size({s}) - 1, 0)), slice({s}, 2, greatest(size({s}) - 1, 0)), (a, b) -> shiftright(a ^ b, {bits}) = 0 and {same_words})"),
    )
    same = c("same")
    # Neighbours of one (cut) hash but other words: then, and only then, the windows themselves are sorted, so that no repeat is missed.
    collided = f"exists(zip_with({same}, sequence(0, greatest(size({same}) - 1, 0)), (e, i) -> not e and shiftright(get({s}, i) ^ get({s}, i + 1), {bits}) = 0), e -> coalesce(e, false))"
    windows = f"array_sort(transform({s}, (x, j) -> struct(slice({words}, cast(x & {low} as int) + 1, {REPEAT_WORDS}) as w, cast(x & {low} as int) as at)))"
    equal = lambda a, b: f"(get({c('exact')}, {a}).w = get({c('exact')}, {b}).w)"
    df = df.withColumn(f"{p}exact", F.expr(f"if(size({same}) > 0 and {collided}, {windows}, null)"))
    of_hashes = f"transform({s}, (x, i) -> if(coalesce(get({same}, i), false) or coalesce(get({same}, i - 1), false), cast(x & {low} as int), -1))"
    of_words = f"transform({c('exact')}, (x, i) -> if(coalesce({equal('i', 'i + 1')}, false) or coalesce({equal('i - 1', 'i')}, false), x.at, -1))"
    df = df.withColumn(f"{p}starts", F.expr(f"array_sort(filter(if({c('exact')} is null, {of_hashes}, {of_words}), v -> v >= 0))"))
    st = c("starts")
    df = df.withColumn(
        f"{p}n_repeat_words",
        F.expr(
            f"if(size({st}) = 0, 0L, {REPEAT_WORDS}L + aggregate(zip_with(slice({st}, 1, greatest(size({st}) - 1, 0)), slice({st}, 2, greatest(size({st}) - 1, 0)), "
            f"(a, b) -> least({REPEAT_WORDS}, b - a)), 0L, (acc, v) -> acc + v))"
        ),
    )
    # A row number is not deterministic, so no filter above is pushed below it, where every nested feature would be computed again.
    return df.drop(f"{p}words", f"{p}bits", f"{p}sorted", f"{p}same", f"{p}exact", f"{p}starts").withColumn(f"{p}row", F.monotonically_increasing_id())


def vote(good: Column, bad: Column) -> Column:
    """1 where ``good``, -1 where ``bad``, 0 where neither; nulls abstain."""
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(-1)).when(F.coalesce(good, F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("int")


def rule_votes(prefix: str = "") -> dict[str, Column]:
    """The rules, each over the features of one document."""
    v = lambda name: F.col(f"{prefix}{name}")
    share = lambda a, b: F.try_divide(v(a).cast("double"), v(b).cast("double"))
    enough = v("n_words") >= MIN_WORDS
    mean = share("word_chars", "n_words")
    return {
        "length": vote(v("n_words") >= 50, v("n_words") < MIN_WORDS),
        "word_length": vote(mean.between(3.0, 10.0), (mean < 2.0) | (mean > 15.0)),
        "symbols": vote(share("n_symbols", "n_words") < 0.02, share("n_symbols", "n_words") > 0.1),
        "marks": vote(share("n_marks", "word_chars") < 0.06, share("n_marks", "word_chars") > 0.115),
        "capitals": vote(share("n_upper", "word_chars") < 0.15, share("n_upper", "word_chars") > 0.3),
        "lines": vote((v("n_dup_lines") == 0) & enough, share("n_dup_lines", "n_lines") > 0.5),
        "repeats": vote(share("n_repeat_words", "n_words") < 0.1, share("n_repeat_words", "n_words") > 0.3),
    }


@dataclass(frozen=True)
class VoteModel:
    """log_odds[rule] = evidence (for "good") of a good and of a bad vote; abstaining is no evidence."""

    log_odds: dict[str, tuple[float, float]]
    prior: float

    def posterior(self, votes: dict[str, Column]) -> Column:
        total: Column = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, (good, bad) in self.log_odds.items():
            total = total + F.when(votes[name] > 0, F.lit(good)).when(votes[name] < 0, F.lit(bad)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_votes(patterns: Sequence[tuple[Sequence[int], int]], rules: Sequence[str], rounds: int = EM_ROUNDS) -> VoteModel:
    """Expectation-maximisation over (votes, count) pairs with two latent classes.

    Each rule has its own rate of good and of bad votes in either class, as rules err differently on good and on bad documents.
    The first guess holds documents with a bad vote for bad. A good vote never counts against a document and a bad vote never
    for it, which fixes what the classes mean. Without documents the first guess stays: a bad vote outweighs all good ones.
    """
    total = sum(n for _, n in patterns)
    strength = PRIOR_STRENGTH * total
    guess = [0.02 if min(votes, default=0) < 0 else 0.98 for votes, _ in patterns]
    model = VoteModel(dict.fromkeys(rules, (0.2, -4.0)), 0.8)
    for _ in range(rounds if total else 0):
        good = sum(n * p for (_, n), p in zip(patterns, guess, strict=True))
        prior = min(PRIOR[1], max(PRIOR[0], good / total))
        odds = {}
        for r, name in enumerate(rules):
            ratio = []
            for sign in (1, -1):
                expect_good, expect_bad = EXPECTED[sign]
                in_good = strength * expect_good + sum(n * p for (v, n), p in zip(patterns, guess, strict=True) if v[r] == sign)
                in_bad = strength * expect_bad + sum(n * (1 - p) for (v, n), p in zip(patterns, guess, strict=True) if v[r] == sign)
                ratio.append(math.log((in_good + 1) / (good + strength + 3)) - math.log((in_bad + 1) / (total - good + strength + 3)))
            odds[name] = (min(MOST_EVIDENCE, max(0.0, ratio[0])), max(-MOST_EVIDENCE, min(0.0, ratio[1])))
        model = VoteModel(odds, prior)
        guess = [
            1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(odds[name][v < 0] for name, v in zip(rules, votes, strict=True) if v)))) for votes, _ in patterns
        ]
    return model


def fit_vote_model(featured: DataFrame, prefix: str = "") -> VoteModel:
    """Fit on all rows of ``featured`` that the base rules leave open; the driver gets the pattern counts only (at most 3 ** rules rows)."""
    votes = rule_votes(prefix)
    rows = featured.where(~base_failed(prefix)).select(*[c.alias(k) for k, c in votes.items()]).groupBy(*votes).count().collect()
    return fit_votes(sorted((tuple(r[k] for k in votes), r["count"]) for r in rows), tuple(votes))


def base_failed(prefix: str = "") -> Column:
    v = lambda name: F.col(f"{prefix}{name}")
    return (v("n_words") < MIN_WORDS) | (v("n_repeat_words") * 100 > v("n_words") * REPEAT_PERCENT)


def score_quality(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, the base counts, base_failed, kept, the votes and the posterior.

    * A null text counts as empty: no words, so base_failed and not kept. An empty table gives an empty result.
    * Repeated rows are scored alike. Other columns are not read.
    * Very long texts are handled in the row; window positions have 20 bits, 31 beyond a million words, and where windows of other words
      share the rest of a hash, the words themselves are sorted.
    """
    featured = text_features(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    featured = materialize(featured.drop("text"), "quality")
    votes = rule_votes()
    posterior = fit_vote_model(featured).posterior(votes)
    return featured.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & (posterior >= F.lit(KEEP_POSTERIOR))).alias("kept"),
        posterior.alias("posterior"),
        *[c.alias(f"vote_{k}") for k, c in votes.items()],
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose documents are kept, with their columns unchanged.

    * The features stay in the rows, written once with them, so no key is needed and repeated ids cannot mix: repeated rows stay or go
      together. A null or empty text has no words and goes. An empty table stays empty.
    * Columns of ``docs`` may have any names: the features get a prefix that none of them begins with."""
    p = "_vf_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    featured = materialize(text_features(docs, text, prefix=p), "quality")
    model = fit_vote_model(featured, p)
    return featured.where(~base_failed(p) & (model.posterior(rule_votes(p)) >= F.lit(KEEP_POSTERIOR))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))
