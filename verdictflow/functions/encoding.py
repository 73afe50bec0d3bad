"""Byte-level BPE ids of texts as an Arrow-batched function: NFC, the usual split, merges by rank, an id for what the vocabulary lacks.

A word's ids do not depend on its neighbours, so each worker merges a distinct word once and keeps it (up to a bound)."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# How text is split into words, and the id of what the vocabulary lacks.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNKNOWN = 50280
KEPT_WORDS, KEPT_CHARS = 300_000, 64


def byte_letters() -> dict[int, str]:
    """A printable letter for each byte: itself where it prints, else the next letters from U+0100 on."""
    prints = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class BytePairs:
    """Vocabulary and merges of a tokenizer file (JSON)."""

    made: dict[tuple[str, int], BytePairs] = {}

    def __init__(self, path: str, unknown: int = UNKNOWN):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        self.unknown = unknown
        self.words = regex.compile(WORDS).findall
        self.known: dict[str, list[int]] = {}

    @classmethod
    def of(cls, path: str, unknown: int) -> BytePairs:
        if (path, unknown) not in cls.made:
            cls.made[path, unknown] = cls(path, unknown)
        return cls.made[path, unknown]

    def merged(self, word: str) -> list[int]:
        parts = [self.letters[b] for b in word.encode()]
        rank = lambda i: self.ranks.get((parts[i], parts[i + 1]), len(self.ranks))
        while len(parts) > 1:
            best = min(map(rank, range(len(parts) - 1)))
            if best == len(self.ranks):
                break
            out, i = [], 0
            while i < len(parts):
                joins = i + 1 < len(parts) and rank(i) == best  # every occurrence, from the left
                out.append(parts[i] + parts[i + 1] if joins else parts[i])
                i += 2 if joins else 1
            parts = out
        return [self.vocabulary.get(p, self.unknown) for p in parts]

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for w in self.words(unicodedata.normalize("NFC", text)):
            ids = self.known.get(w)
            if ids is None:
                ids = self.merged(w)
                if len(w) <= KEPT_CHARS:
                    if len(self.known) >= KEPT_WORDS:
                        self.known.clear()
                    self.known[w] = ids
            out += ids
        return out


def bpe_ids(path: str, unknown: int = UNKNOWN) -> Callable[[Column | str], Column]:
    """A function from text to array of ids; null stays null."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pairs = BytePairs.of(path, unknown)
        for part in parts:
            yield pd.Series([None if t is None else pairs.ids(t) for t in part], dtype=object)

    return ids
