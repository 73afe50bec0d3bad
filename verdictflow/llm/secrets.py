"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Ordinary words take few tokens under a vocabulary learned from ordinary text; random strings take many. A candidate run of
letters, digits and key characters whose characters per token stay below a ratio is reported, unless it is a known kind of digest
or identifier.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed values of the base patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
KINDS = ("assign", "access", "hex", "random")
#: Candidates of the token-efficiency test: runs of key characters with a letter, of this length or more, and their parts between / - _.
RANDOM = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
PART = re.compile(r"[A-Za-z0-9+]{16,}={0,2}")
LETTER = re.compile(r"[A-Za-z]")
#: Characters that are tokenized at once: the time of a run is in proportion to its length.
CHUNK = 256
#: Characters per token below which a candidate counts as random. Ordinary identifiers reach 3 and more, random keys stay near 1.5.
RATIO = 2.2
#: The same for letters of one case (or capitalised): rare and compound words of many languages reach 2.0 there, random letters 1.5 to 1.9.
WORD_RATIO = 1.9
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Known digests and identifiers: hexadecimal digests of the usual lengths, UUIDs, dates and numbers with a unit or prefix.
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-][0-9A-Z-]*|[A-Za-z]{1,8}[-_/]?[0-9]+|[0-9+/_-]+[A-Za-z]{1,3})"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; matches that are too short use up their text and are dropped."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    if LONG_HEX.search(text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LENGTH]
    return sorted(found)


class Ratio:
    """Characters per token under a tiktoken vocabulary; made once for each worker."""

    made: dict[str, Ratio] = {}

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = tiktoken.Encoding("ratio", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @classmethod
    def of(cls, path: str) -> Ratio:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __call__(self, s: str) -> float:
        return len(s) / max(1, sum(len(self.tokens(s[i : i + CHUNK])) for i in range(0, len(s), CHUNK)))


def random_spans(text: str, taken: list[tuple[int, int, int]], ratio: Ratio, limit: float = RATIO) -> list[tuple[int, int, int]]:
    """Spans of random strings in what the spans in ``taken`` leave uncovered: whole runs, else those of their parts that are random."""
    found, at = [], 0

    def is_random(run: str) -> bool:
        return bool(LETTER.search(run)) and ratio(run) < (min(limit, WORD_RATIO) if WORD.fullmatch(run) else limit) and not KNOWN.fullmatch(run)

    # One look at each run; whether it has a letter is asked of the run, not of every place in it.
    for start, end in [*[(s, e) for s, _, e in sorted(taken)], (len(text), len(text))]:
        for m in RANDOM.finditer(text, at, max(at, start)):
            if is_random(m.group()):
                found.append((m.start(), 3, m.end()))
            elif LETTER.search(m.group()) and not KNOWN.fullmatch(m.group()):
                found += [(p.start(), 3, p.end()) for p in PART.finditer(text, m.start(), m.end()) if is_random(p.group())]
        at = max(at, end)
    return found


def find_spans(text: str | None, ratio: Ratio, limit: float = RATIO) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), both by start, then kind."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, ratio, limit))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each (merged) span replaced by [SECRET]."""
    out, at = [], 0
    for s, _, e in sorted(spans):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, limit: float = RATIO) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    * A null text counts as empty: no spans, the digest of the empty string. Empty tables give empty results.
    * Spans count code points. Equal starts are ordered assign, access, hex, random. Repeated rows are reported alike.
    * No shuffle, whole texts; columns other than doc_id and text are not read.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratio = Ratio.of(path)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, spans = find_spans(text, ratio, limit)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].values)
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {key}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask_secrets(docs: DataFrame, vocabulary: str | None = None, limit: float = RATIO) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by [SECRET]; every row stays, n_chars (if there) follows the text."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        ratio = Ratio.of(path)
        return pd.Series([None if t is None else mask(t, find_spans(t, ratio, limit)[1]) for t in texts], dtype=object)

    out = docs.withColumn("text", masked(docs["text"]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
