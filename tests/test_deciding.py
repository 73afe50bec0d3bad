"""Byte-level ids against a plain port and the library; parsing, encoding and deciding."""

from __future__ import annotations

import json
import random
import unicodedata

import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

from verdictflow.functions.encoding import BytePairs, bpe_ids
from verdictflow.operators import deciding

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "Hello  world's end", "don't   stop\n\n\t x", "é é naïve", "日本語 123 4567", "aaaaaaaa aaaa", "é", "<|endoftext|>", "\x00\x7f", "a" * 500, "…—“q”"]


def plain(text: str) -> list[int]:
    """The library's ids of the normal form, its special token as text."""
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    return library.encode(unicodedata.normalize("NFC", text), add_special_tokens=False).ids


def test_ids_are_those_of_the_library(spark):
    r = random.Random(8)
    letters = "abcdeé 'st1.,\n  日"
    texts = TEXTS + ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(bpe_ids(PATH)("t")).collect()
    assert [g[0] for g in got] == [*map(plain, texts), None]


def test_unknown_letters(tmp_path):
    model = {"model": {"vocab": {"a": 0, "b": 1, "ab": 2, "abab": 3, "Ġ": 4}, "merges": ["a b", ["ab", "ab"]]}}
    (tmp_path / "t.json").write_text(json.dumps(model))
    pairs = BytePairs(str(tmp_path / "t.json"))
    assert pairs.ids("ababab abc") == [3, 2, 4, 2, 50280] and pairs.ids("é") == [50280, 50280] and pairs.ids("é") == pairs.ids("é")


def test_decide(spark):
    questions = {
        "c": {"type": "choice", "instructions": "Which [MASK]?", "criteria": {"x": "", "y": "why"}},
        "s": {"type": "score", "instructions": "How?", "criteria": ["low", "high", "top"]},
        "n": {"type": "noul", "instructions": "Is it?", "criteria": {"true": "it is"}},
        "bad": {"type": "other"},
        "few": {"type": "choice", "criteria": ["one"]},
        "none": {"type": "choice"},
    }
    rows = spark.createDataFrame([(1, "a state", json.dumps(questions)), (2, None, "[]"), (3, "long " * 3000, json.dumps({"n": questions["n"]}))], "id int, state string, questions string")
    parsed = {(r["id"], r["qid"]): r for r in deciding.parse_questions(rows).collect()}
    assert parsed[1, "c"]["options"] == ["x", "y: why"] and parsed[1, "s"]["options"][1] == "level 1: high" and parsed[1, "s"]["keys"] == ["0", "1", "2"]
    assert parsed[1, "n"]["options"] == ["false: no, the statement does not hold", "true: it is"] and parsed[2, None]["errors"]
    encoded = {(r["id"], r["qid"]): r for r in deciding.encode(deciding.parse_questions(rows), PATH).collect()}
    e = encoded[1, "c"]
    want = [50281, *plain("choice question: Which  ?"), 50282, 50284, *plain(" x"), 50284, *plain(" y: why"), 50282, *plain("a state"), 50282]
    assert e["ids"] == want and [want[m] for m in e["markers"]] == [50284, 50284] and e["input_tokens"] == len(want)
    assert encoded[3, "n"]["input_tokens"] == 1024 and encoded[1, "bad"]["ids"] is None

    def scorer(ids: pd.Series, markers: pd.Series) -> pd.Series:
        return pd.Series([[float(i * 3) for i in range(len(m))] for m in markers])

    out = {(r["id"], r["qid"]): r for r in deciding.decide(rows, scorer, PATH).collect()}
    assert out[1, "c"]["choice"] == "y" and out[1, "c"]["verdict"] == "y" and out[1, "n"]["verdict"] == "yes" and out[1, "s"]["score"] > 1.8
    assert all(out[1, q]["errors"] and out[1, q]["confidence"] is None for q in ("bad", "few", "none")) and len(out) == 8
