"""Language identification of texts that may mix languages.

Script ranges narrow the candidate languages of each word; character trigrams score the word in every candidate; Viterbi with a
penalty for switching labels runs of words. The language with most letters in its runs is the document's.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_DOCS`` for each language, chosen by a hash of the key); scoring
needs no shuffle.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.llm.common import crc_of_id, table

SAMPLE_DOCS = 1500
SWITCH_PENALTY = 12.0
SMOOTHING = 0.1
IMPOSSIBLE = -1e4
CACHE_WORDS = 400_000
#: A language uses a script if at least this share of its sampled words does.
SCRIPT_SHARE = 0.01
WORDS = re.compile(r"[^\W\d_]+").findall
UNDETERMINED = "und"
# First code point of ranges and their script; the range goes on to the next entry.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other-indic"), (0x0E00, "thai"), (0x0E80, "other-asian"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"),
)
_FIRST = [a for a, _ in SCRIPTS]


def script_of(word: str) -> str:
    """Script of the word's first letter."""
    return "latin" if word.isascii() else SCRIPTS[bisect.bisect_right(_FIRST, ord(word[0])) - 1][1]


def trigrams(word: str) -> list[str]:
    w = f"^^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


@dataclass
class LanguageModel:
    languages: list[str]
    grams: dict[str, int]
    scores: np.ndarray  # one row for each gram and a last one, of zeros, for unknown grams; one column for each language
    scripts: dict[str, np.ndarray]  # script -> mask of languages that use it

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word under each language; languages of other scripts are out."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        unknown, get = len(self.grams), self.grams.get
        flat: list[int] = []
        starts = []
        for w in words:
            starts.append(len(flat))
            p = f"^^{w}$"
            flat += [get(p[i : i + 3], unknown) for i in range(len(w) + 1)]
        out = np.add.reduceat(self.scores[flat], starts, axis=0)
        for i, w in enumerate(words):
            if (mask := self.scripts.get(script_of(w))) is not None and not mask.all():
                out[i, ~mask] = IMPOSSIBLE
        return out


def fit_languages(grams: dict[tuple[str, str], int], scripts: dict[tuple[str, str], int]) -> LanguageModel:
    """From counts by (language, trigram) and by (language, script)."""
    languages = sorted({lang for lang, _ in grams})
    at = {lang: k for k, lang in enumerate(languages)}
    known = {g: i for i, g in enumerate(sorted({g for _, g in grams}))}
    counts = np.zeros((len(known) + 1, len(languages)))
    contexts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    for (lang, g), n in grams.items():
        counts[known[g], at[lang]] = n
        contexts[g[:2]][at[lang]] += n
    alphabet = max(2, len({g[2] for g in known}))
    scores = np.zeros_like(counts)
    for g, i in known.items():
        scores[i] = np.log((counts[i] + SMOOTHING) / (contexts[g[:2]] + SMOOTHING * alphabet))
    totals: dict[str, int] = Counter()
    for (lang, _), n in scripts.items():
        totals[lang] += n
    masks = {s: np.zeros(len(languages), bool) for _, s in scripts}
    for (lang, s), n in scripts.items():
        if lang in at:
            masks[s][at[lang]] = n >= SCRIPT_SHARE * totals[lang]
    return LanguageModel(languages, known, scores.astype(np.float32), {s: m for s, m in masks.items() if m.any()})


def train_languages(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """``labelled`` has doc_id, text, lang. About ``sample_docs`` rows of each language are used: those with the lowest hashes."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([], {}, np.zeros((1, 0), np.float32), {})
    rate = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_docs / n))).otherwise(rate)
    uniform = F.pmod(F.xxhash64(F.lit("language-sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                for w, n in Counter(WORDS(text.lower())).items():
                    seen[lang, "script", script_of(w)] += n
                    for g in trigrams(w):
                        seen[lang, "gram", g] += n
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["lang", "kind", "item", "n"])

    counted = rows.where(uniform < rate).select("lang", "text").mapInPandas(count, "lang string, kind string, item string, n long")
    found = counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).collect()  # bounded by the sample
    split = {kind: {(r["lang"], r["item"]): r["n"] for r in found if r["kind"] == kind} for kind in ("gram", "script")}
    return fit_languages(split["gram"], split["script"])


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label of every row of ``scores``, the word scores of texts one after another, ``lengths[t]`` words each.

    All texts advance one word at a time together, longest first, so a step is one array operation over the texts that go on."""
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    going = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # texts with at least t + 1 words
    switched = np.zeros((n, k), bool)
    best_before = np.zeros(n, np.int16)
    v = scores[starts[: going[0]]].astype(np.float64)
    final = np.zeros(len(order), np.int64)
    for t in range(1, int(sizes[0])):
        m = going[t]
        if m < len(v):
            final[m : len(v)] = v[m:].argmax(1)
            v = v[:m]
        at = starts[:m] + t
        top = v.argmax(1)
        jump = v[np.arange(m), top][:, None] - penalty
        best_before[at] = top
        switched[at] = v < jump
        v = np.maximum(v, jump) + scores[at]
    final[: len(v)] = v.argmax(1)
    labels = np.zeros(n, np.int64)
    now = np.zeros(len(order), np.int64)
    for t in range(int(sizes[0]) - 1, -1, -1):
        m = going[t]
        ends = sizes[:m] == t + 1
        now[:m][ends] = final[:m][ends]
        at = starts[:m] + t
        labels[at] = now[:m]
        if t:
            s = switched[at, now[:m]]
            now[:m] = np.where(s, best_before[at], now[:m])
    return labels


class Labeller:
    """Labels blocks of texts with a bounded cache of word scores."""

    def __init__(self, model: LanguageModel, penalty: float = SWITCH_PENALTY):
        self.model, self.penalty = model, penalty
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)), np.float32)

    def words(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, their lengths in words, and the scores of all words."""
        split = [WORDS(t.lower()) for t in texts]
        if len(self.rows) > CACHE_WORDS:
            self.rows, self.table = {}, self.table[:0]
        rows = self.rows
        new = list({w for ws in split for w in ws if w not in rows})
        for w in new:
            rows[w] = len(rows)
        if new:
            self.table = np.concatenate([self.table, self.model.word_scores(new)])
        flat = [rows[w] for ws in split for w in ws]
        return split, np.fromiter(map(len, split), np.int64, len(split)), self.table[flat]

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        languages = self.model.languages
        if not languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        split, lengths, scores = self.words(texts)
        labels = viterbi(scores, lengths, self.penalty)
        letters = np.fromiter((len(w) for ws in split for w in ws), np.float64, len(labels))
        text_of = np.repeat(np.arange(len(texts)), lengths)
        k = len(languages)
        share = np.bincount(text_of * k + labels, letters, minlength=len(texts) * k).reshape(-1, k)
        total = np.zeros((len(texts), k))
        some = lengths > 0
        if some.any():
            total[some] = np.add.reduceat(scores.astype(np.float64), (np.cumsum(lengths) - lengths)[some], axis=0)
        out = []
        for t, text in enumerate(texts):
            if not lengths[t] or not (text.isascii() or any(c.isalpha() for c in text)):
                out.append((UNDETERMINED, 0.0))
                continue
            best = int(share[t].argmax())
            whole = 1 / np.exp(np.clip(total[t] - total[t][best], -700, 50)).sum()
            out.append((languages[best], float(max(whole, 0.5 if whole > 0.5 else whole) * share[t][best] / share[t].sum())))
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of each run of words with one label, in code points of ``text``."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found = list(re.finditer(r"[^\W\d_]+", low))
        if not found or not self.model.languages:
            return []
        scores = self.model.word_scores([m.group() for m in found])
        labels = viterbi(scores, np.array([len(found)]), self.penalty)
        out: list[tuple[int, int, str]] = []
        for m, k in zip(found, labels.tolist(), strict=True):
            lang = self.model.languages[k]
            if out and out[-1][2] == lang:
                out[-1] = (out[-1][0], m.end(), lang)
            else:
                out.append((m.start(), m.end(), lang))
        return out


def identify_languages(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH_PENALTY, with_spans: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score and, on request, spans.

    * A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was learned.
    * Equal shares go to the language first in alphabetical order. Repeated rows are labelled alike; empty tables stay empty.
    * Whole texts; columns other than doc_id and text are not read, so neither lang nor source can reach a prediction.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model, penalty)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            rows = []
            for i in range(0, len(texts), 2000):
                rows += labeller.label(texts[i : i + 2000])
            out = pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [a for a, _ in rows], "score": [b for _, b in rows]})
            if with_spans:
                out["spans"] = [[{"start": s, "end": e, "lang": x} for s, e, x in labeller.spans(t)] for t in texts]
            yield out

    schema = f"doc_id {key}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * with_spans
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc_of_id(), F.lit(3)) == 1
    model = train_languages(docs.where(~held_out).select("doc_id", "text", "lang"))
    return identify_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
