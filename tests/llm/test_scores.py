"""Language, quality and toxicity of whole documents against plain computations of the same methods."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.test_operators import prose
from verdictflow.llm import language, quality, toxicity

# Language: trigram counts, script masks, Viterbi and shares, one text at a time


def plain_model(rows):
    """rows: (text, lang)."""
    grams, scripts = defaultdict(Counter), defaultdict(Counter)
    for text, lang in rows:
        if text is None or lang is None:
            continue
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            scripts[lang][language.script_of(w)] += 1
            p = f"^^{w}$"
            grams[lang].update(p[i : i + 3] for i in range(len(p) - 2))
    return grams, scripts


def plain_label(text, grams, scripts):
    languages = sorted(grams)
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words:
        return "und", 0.0
    known = {g for c in grams.values() for g in c}
    alphabet = max(2, len({g[2] for g in known}))
    users = {s: {x for x in languages if scripts[x][s] >= language.SCRIPT_SHARE * sum(scripts[x].values())} for s in {s for c in scripts.values() for s in c}}

    def word_score(w, lang):
        users_of = users.get(language.script_of(w))
        if users_of and lang not in users_of:
            return language.IMPOSSIBLE
        total, p = 0.0, f"^^{w}$"
        for i in range(len(p) - 2):
            g = p[i : i + 3]
            if g in known:
                context = sum(n for h, n in grams[lang].items() if h[:2] == g[:2])
                total += math.log((grams[lang][g] + language.SMOOTHING) / (context + language.SMOOTHING * alphabet))
        return total

    scores = [[word_score(w, x) for x in languages] for w in words]
    best = [scores[0]]
    back = []
    for s in scores[1:]:
        top = max(range(len(languages)), key=lambda k: best[-1][k])
        jump = best[-1][top] - language.SWITCH_PENALTY
        back.append([top if best[-1][k] < jump else k for k in range(len(languages))])
        best.append([max(best[-1][k], jump) + s[k] for k in range(len(languages))])
    k = max(range(len(languages)), key=lambda k: best[-1][k])
    labels = [k]
    for b in reversed(back):
        k = b[k]
        labels.append(k)
    letters = Counter()
    for w, k in zip(words, reversed(labels)):
        letters[k] += len(w)
    pick = max(range(len(languages)), key=lambda k: letters[k])
    totals = [sum(s[k] for s in scores) for k in range(len(languages))]
    whole = 1 / sum(math.exp(min(50, max(-700, t - totals[pick]))) for t in totals)
    return languages[pick], (max(whole, 0.5) if whole > 0.5 else whole) * letters[pick] / sum(letters.values())


def test_documents_get_the_language_of_the_method(spark):
    r = random.Random(12)
    sounds = {"aa": ["ka", "ro", "mi", "tel"], "bb": ["scho", "mi", "ung", "ver"], "cc": ["жи", "ро", "ка", "сте"]}
    word = lambda lang: "".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 4)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    train = [(i, text(lang := r.choice(list(sounds)), 25), lang) for i in range(60)] + [(90, None, "aa"), (91, "only text", None)]
    tests = [(i, text(lang := r.choice(list(sounds)), r.randint(1, 30)), lang) for i in range(40)]
    tests += [(i, " ".join([text("aa", 12), text("cc", 9), "12 3!", text("bb", 14)]), None) for i in range(40, 50)] + [(50, None, "aa"), (51, "12 _ !", "bb"), (52, "Zyx", "cc"), (53, text("bb", 20_000), None)]
    schema = "doc_id long, text string, lang string"
    model = language.train_languages(spark.createDataFrame(train, schema))
    grams, scripts = plain_model([x[1:] for x in train])
    out = {x["doc_id"]: x for x in language.identify_languages(spark.createDataFrame(tests, schema), model).collect()}
    assert len(out) == len(tests)
    for i, t, _ in tests:
        if i == 53:
            assert out[i]["lang_pred"] == "bb"
            continue
        lang, score = plain_label(t, grams, scripts)
        assert out[i]["lang_pred"] == lang and out[i]["score"] == pytest.approx(score, abs=2e-3), (i, t)


# Quality: votes, expectation-maximisation and posterior


def plain_votes(x):
    share = lambda a, b: a / b if b else None

    def one(value, good, bad):
        return 0 if value is None else -1 if bad(value) else 1 if good(value) else 0

    n = x["n_words"]
    mean = share(x["word_chars"], n)
    return {
        "length": one(n, lambda v: v >= 50, lambda v: v < quality.MIN_WORDS),
        "word_length": one(mean, lambda v: 3 <= v <= 10, lambda v: v < 2 or v > 15),
        "symbols": one(share(x["n_symbols"], n), lambda v: v < 0.02, lambda v: v > 0.1),
        "repeats": one(share(x["n_repeat_words"], n), lambda v: v < 0.1, lambda v: v > 0.3),
    }


def plain_em(rows, rules):
    """rows: votes of each document (one by one, not by pattern); posterior of each."""
    n, strength = len(rows), quality.PRIOR_STRENGTH * len(rows)
    p = [0.02 if min(v.values()) < 0 else 0.98 for v in rows]
    for _ in range(quality.EM_ROUNDS):
        good = sum(p)
        prior = min(quality.PRIOR[1], max(quality.PRIOR[0], good / n))
        odds = {}
        for name in rules:
            for sign in (1, -1):
                a = strength * quality.EXPECTED[sign][0] + sum(q for v, q in zip(rows, p) if v[name] == sign)
                b = strength * quality.EXPECTED[sign][1] + sum(1 - q for v, q in zip(rows, p) if v[name] == sign)
                e = math.log((a + 1) / (good + strength + 3)) - math.log((b + 1) / (n - good + strength + 3))
                odds[name, sign] = min(quality.MOST_EVIDENCE, max(0.0, e)) if sign > 0 else max(-quality.MOST_EVIDENCE, min(0.0, e))
        p = [1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(odds[k, s] for k, s in v.items() if s)))) for v in rows]
    return p


def test_quality_of_documents_is_that_of_the_method(spark):
    r = random.Random(5)
    texts = [prose(i, r.randint(25, 200)) for i in range(60)] + ["#$ " * 10 + prose(i, 40) for i in range(60, 75)] + [prose(i, 30).upper() for i in range(75, 85)]
    texts += ["\n".join([prose(i, 12)] * 3) for i in range(85, 90)] + ["ab " * 30, "", None, prose(99, 20_000)]
    out = quality.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    rules = [c[5:] for c in out[0].asDict() if c.startswith("vote_")]
    for x in out:
        mine = plain_votes(x)
        assert {k: x[f"vote_{k}"] for k in mine} == mine
    left = [x for x in out if not x["base_failed"]]
    posterior = plain_em([{k: x[f"vote_{k}"] for k in rules} for x in left], rules)
    for x, p in zip(left, posterior, strict=True):
        assert x["posterior"] == pytest.approx(p, abs=1e-9) and x["kept"] == (x["posterior"] >= quality.KEEP_POSTERIOR)
    assert all(not x["kept"] for x in out if x["base_failed"]) and 0 < sum(x["kept"] for x in out) < len(out)


# Toxicity: TF-IDF cosines, neighbours, votes and calibration


def plain_terms(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        out.update([w, *[w[:n] + "~" for n in (4, 5) if len(w) > n]])
    return out


def test_toxicity_of_documents_is_that_of_the_method(spark):
    r = random.Random(8)
    bad = ["vileword", "nastyish", "cruelest"]
    made = lambda y: " ".join([prose(r.randint(0, 999), 20), *(r.choice(bad) for _ in range(r.randint(1, 3) if y else r.random() < 0.04))])
    rows = [(i, made(y := i % 3 == 0), int(y)) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900 + i, made(i % 2)) for i in range(30)] + [(990, None), (991, ""), (992, "vileword " * 20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    learned = docs.where("doc_id < 900")
    model = toxicity.train_toxicity(learned, labels)
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(docs, model, with_evidence=True).collect()}
    # the vocabulary by chi-square, document frequencies, and every cosine by brute force
    n1 = sum(y for *_, y in rows)
    n0 = len(rows) - n1
    sets = [(set(plain_terms(t)), y) for _, t, y in rows]
    vocabulary = set()
    for t in set().union(*(s for s, _ in sets)):
        a, b = sum(t in s and y for s, y in sets), sum(t in s and not y for s, y in sets)
        if a + b >= toxicity.MIN_EXAMPLES_OF_TERM and len(rows) * (a * (n0 - b) - b * (n1 - a)) ** 2 >= toxicity.MIN_ASSOCIATION * (a + b) * (len(rows) - a - b) * n1 * n0:
            vocabulary.add(t)
    assert set(model.vocabulary) == vocabulary and vocabulary
    df = {t: sum(t in s for s, _ in sets) for t in vocabulary}

    def vector(text):
        w = {t: (1 + math.log(n)) * math.log(1 + len(rows) / df[t]) for t, n in plain_terms(text).items() if t in vocabulary}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    examples = [(i, vector(t), y) for i, t, y in rows]

    def vote(text, without=None):
        v = vector(text)
        near = sorted(((round(sum(x * e.get(t, 0) for t, x in v.items()), 4), y) for i, e, y in examples if i != without and v), reverse=True)
        near = [(c, y) for c, y in near if c > 0]
        kept, cut = near[: toxicity.NEIGHBOURS], near[toxicity.NEIGHBOURS :]
        tied = bool(cut) and cut[0][0] == kept[-1][0]  # ties at the edge may be settled either way
        weights = [1 / (1.05 - min(c, 1)) for c, _ in kept]
        missing = toxicity.NEIGHBOURS - len(kept)
        return (sum(w * y for w, (_, y) in zip(weights, kept)) + missing * n1 / len(rows)) / (sum(weights) + missing), tied, [c for c, _ in kept]

    told = 0
    for x in docs.collect():
        v, tied, cosines = vote(x["text"])
        mine = got[x["doc_id"]]
        assert [e["cosine"] for e in mine["evidence"]] == pytest.approx(cosines, abs=2e-4)
        assert mine["predicted"] == int(mine["score"] >= toxicity.THRESHOLD)
        if not tied:
            told += 1
            assert mine["score"] == pytest.approx(1 / (1 + math.exp(-(model.scale[0] + model.scale[1] * v))), abs=5e-3)
    assert told > 20
    # calibration: the slope of the logistic loss is nothing but the ridge's at the fitted curve
    kept = [(vote(t, without=i), y) for i, t, y in rows]
    if not any(tied for (_, tied, _), _ in kept):
        a, b = model.scale
        gradient = sum(y - 1 / (1 + math.exp(-(a + b * v))) for (v, _, _), y in kept)
        assert abs(gradient - 1e-3 * a) < 0.5
    assert docs.count() == len(got) and got[990]["score"] == got[991]["score"]
