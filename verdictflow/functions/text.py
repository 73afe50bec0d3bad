"""Text, key and JSON functions as Catalyst columns; hashes that Spark lacks as Arrow-batched UDFs."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns of words and numbers, of masked log parts, and of identifiers.
TOKEN = r"[a-z]+|-?[0-9]+(?:\.[0-9]+)?"
NUMBER = r"[0-9]+(\.[0-9]+)?"
LOG_PARTS = r"0x[0-9a-fA-F]+|\b[0-9a-fA-F]{6,}\b|[0-9]+"
ANSI = "\x1b\\[[0-9;]*m"
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank, ends trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.translate(c, "_", " ")), F.lit(TOKEN), 0)


def mask_numbers(c: Column) -> Column:
    return F.regexp_replace(c, NUMBER, "#")


def log_template(c: Column) -> Column:
    return F.regexp_replace(c, LOG_PARTS, "<*>")


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, ANSI, "")


def cut(c: Column, n: int) -> Column:
    """At most ``n`` characters, with a line of dots after a cut."""
    t = F.trim(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("\n...")))


def clip(c: Column, n: int = 4000) -> Column:
    """Both ends of a long text."""
    half = n // 2
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(half)), F.lit("\n...\n"), F.right(c, F.lit(half))))


def first_sentence(c: Column, n: int = 300) -> Column:
    found = F.regexp_extract(c, r"^(.+?[.!?])(\s|$)", 1)
    return F.substring(F.when(found != "", found).otherwise(c), 1, n)


def english_strict(c: Column, language: Column | None = None) -> Column:
    ascii_only = F.substring(c, 1, 500).rlike(r"^[\x00-\x7F]*$")
    return ascii_only if language is None else ascii_only & F.coalesce(F.startswith(F.lower(language), F.lit("en")), F.lit(True))


def english_lenient(c: Column, language: Column | None = None) -> Column:
    letters = F.substring(c, 1, 200).rlike(r"^[\x00-\x7F\p{L}]*$")
    return letters if language is None else F.when(language.isNotNull(), F.startswith(F.lower(language), F.lit("en"))).otherwise(letters)


def remove_once(c: Column, part: Column) -> Column:
    """``c`` without the first occurrence of ``part``."""
    at = F.instr(c, part)
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), F.substr(c, at + F.length(part)))).otherwise(c)


def unmask(c: Column) -> Column:
    """The mask token cannot come from users' text."""
    return F.replace(c, F.lit("[MASK]"), F.lit(" "))


def uuids(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(UUID), 0)


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and no blanks, null if the text is not JSON (our own canonical form)."""
    return F.to_json(F.try_parse_json(c))


def canonical_state(c: Column, json: Column | None = None) -> Column:
    """Canonical JSON (``json``, where it is known) where the text is an object or list, else squeezed text, in lower case."""
    parsed = F.when(F.substring(F.ltrim(c), 1, 1).isin("{", "["), canonical_json(c) if json is None else json)
    return F.coalesce(F.lower(parsed), squeeze(c))


def question_key(state: Column, question: Column, json: Column | None = None) -> Column:
    return F.sha2(F.concat(canonical_state(state, json), F.lit("||"), squeeze(question)).cast("binary"), 256)


def hash_slot(key: Column) -> Column:
    """A key's place in [0, 1): the first 13 hexadecimal digits of its SHA-256, which a double holds exactly."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def hash_bucket(key: Column, n: int) -> Column:
    """SHA-256's first eight bytes modulo ``n``."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(n).cast("decimal(20,0)")).cast("int")


def pair_key(c: Column) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, 12)


@F.pandas_udf(StringType())
def exact_question_key(state: pd.Series, question: pd.Series) -> pd.Series:
    """Byte-exact 96-bit blake2b key over canonical JSON with the usual separators and ASCII escapes."""

    def key(s: str | None, q: str | None) -> str:
        try:
            s = json.dumps(json.loads(s or ""), sort_keys=True).lower()
        except ValueError:
            s = " ".join((s or "").split()).lower()
        return hashlib.blake2b(f"{s}||{' '.join((q or '').split()).lower()}".encode(), digest_size=12).hexdigest()

    return pd.Series([key(a, b) for a, b in zip(state, question, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def flat_english(state: pd.Series) -> pd.Series:
    """Nested JSON states in English: ``path: value`` parts, at most 4 levels, 40 parts, 10 list items and 2,000 characters."""

    def parts(x: object, path: str, depth: int) -> list[str]:
        if depth < 4 and isinstance(x, dict):
            return [p for k, v in x.items() for p in parts(v, f"{path}.{k}" if path else str(k), depth + 1)]
        if depth < 4 and isinstance(x, list):
            return [p for i, v in enumerate(x[:10]) for p in parts(v, f"{path}[{i}]", depth + 1)]
        return [f"{path}: {x}" if path else str(x)]

    def text(s: str | None) -> str | None:
        try:
            return "; ".join(parts(json.loads(s or ""), "", 0)[:40])[:2000]
        except ValueError:
            return s

    return pd.Series([text(s) for s in state], dtype=object)


def minutes(c: Column) -> Column:
    """Minutes since midnight of ``HH:MM``; null if it is not a time."""
    ok = c.rlike(r"^[0-2]?[0-9]:[0-5][0-9]$")
    return F.when(ok, F.split_part(c, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(c, F.lit(":"), F.lit(2)).cast("int"))


def clock(m: Column) -> Column:
    return F.format_string("%02d:%02d", F.pmod((m / 60).cast("int"), F.lit(24)), F.pmod(m, F.lit(60)))


def version(c: Column) -> Column:
    """Parts of a version as numbers; arrays compare part by part."""
    return F.transform(F.split(c, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
