"""Text canonicalisation as column expressions; an Arrow UDF only where Catalyst has no equivalent."""

from __future__ import annotations

import codecs
import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from emberlane.functions.prefilter import bounds

# --- fixed values -----------------------------------------------------------------------------------
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "i"}
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "α": "a", "β": "b"}
SCAN_HOMOGLYPHS = {"а": "a", "о": "o", "е": "e", "с": "c", "р": "p", "х": "x", "у": "y", "і": "i"}
ZERO_WIDTH = "[­​‌‍﻿⁠᠎  ‪-‮]"
SHELL_COMMANDS = (
    "cat", "ls", "rm", "cp", "mv", "chmod", "chown", "find", "grep", "awk", "sed", "python[23]?", "pip[23]?", "bash",
    "sh", "zsh", "fish", "curl", "wget", "nc", "netcat", "nmap", "tcpdump", "ss", "ps", "top", "kill", "sudo", "su",
    "exec", "export", "echo", "printf", "base64", "xxd", "od", "hexdump", "dd", "truncate", "shred", "tar", "gzip",
    "zip", "unzip", "openssl", "ssh", "scp", "sftp", "rsync", "git", "apt", "yum", "systemctl", "service", "cron",
    "env", "set", "export", "source", "eval",
)
ROT13_WORDS = ("vafgehpgvbaf", "vtaber", "sbetrg", "qvfertneq", "olcnff", "birreevqr")
MOJIBAKE_MARKS = ("Ã", "Â", "Ä", "Æ", "â€")
PLACEHOLDERS = (
    (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b", "<IP>"),
    (r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", "<IBAN>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b[0-9a-fA-F]{32,64}\b", "<HASH>"),
    (r"(/etc/(shadow|passwd|gshadow)|~/\.ssh/id_\w+|~/\.aws/credentials)", "<SENSITIVE_PATH>"),
)
# ----------------------------------------------------------------------------------------------------


def _translate(text: Column, table: dict[str, str]) -> Column:
    return F.translate(text, "".join(table), "".join(table.values()))


def normalize_leet(text: Column) -> Column:
    """Digits and signs to the letters they stand for, unless the text starts with a shell command."""
    return F.when(text.rlike(bounds(rf"(?i)^\s*(?:{'|'.join(SHELL_COMMANDS)})\b")), text).otherwise(_translate(text, LEET))


def normalize_homoglyphs(text: Column) -> Column:
    return _translate(text, HOMOGLYPHS)


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def remove_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, ZERO_WIDTH, "")


def placeholder_normalize(text: Column) -> Column:
    """Addresses, accounts, ids, hashes and sensitive paths to tokens, in this order."""
    for pattern, token in PLACEHOLDERS:
        text = F.regexp_replace(text, bounds(pattern), token)
    return text


def template_normalize(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z ]", "")


def ml_preprocess(text: Column) -> Column:
    text = F.regexp_replace(text, r"(\w+)\((.*?)\)", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[=\"',]", " "), r"\s+", " "))


_ROT13 = re.compile(r"\b(?:" + "|".join(ROT13_WORDS) + r")\b", re.IGNORECASE)
_BARE = str.maketrans({c: None for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Mn"})
_SCAN_MAP = str.maketrans(SCAN_HOMOGLYPHS | LEET)
_D_STROKE = str.maketrans("đĐ", "dD")


def _marks(text: str) -> int:
    return sum(map(text.count, MOJIBAKE_MARKS))


def repair_mojibake(text: str) -> str:
    """UTF-8 that was read as Latin-1 or as Windows-1252, at most twice over, read right; kept as it is if that doesn't help."""
    for _ in range(2):
        if not any(m in text for m in MOJIBAKE_MARKS[:4]):
            break
        readings = []
        for encoding in ("latin1", "cp1252"):
            for errors in ("strict", "ignore"):
                try:
                    readings.append(text.encode(encoding, errors).decode("utf-8", errors))
                except UnicodeError:
                    pass
        best = min(readings, key=lambda x: (_marks(x), -len(x)), default=text)
        if _marks(best) >= _marks(text):
            break
        text = best
    return text


def unrot(text: str) -> str:
    """Rot13 undone if one of the words that show it stands in the text by itself."""
    return codecs.decode(text, "rot_13") if _ROT13.search(text) else text


def _scan_form(text: str) -> str:
    text = unrot(unicodedata.normalize("NFKC", repair_mojibake(text)))
    text = re.sub(ZERO_WIDTH, "", text.translate(_SCAN_MAP)).translate(_D_STROKE)
    return unicodedata.normalize("NFD", text).translate(_BARE)


@F.pandas_udf(StringType())
def _scan_forms(text: pd.Series) -> pd.Series:
    return text.map(_scan_form, na_action="ignore")


def plain_ascii(text: Column) -> Column:
    """Whether a text is ASCII without a rot13 word: then no built-in is missing and it never leaves the JVM."""
    return (F.octet_length(text) == F.char_length(text)) & ~text.rlike(r"(?i)\b(?:" + "|".join(ROT13_WORDS) + r")\b")


def pre_normalise(text: Column) -> Column:
    """The form that rules are scanned on: mojibake, compatibility forms, rot13, look-alikes, zero width, leet and marks, in this order."""
    plain = plain_ascii(text)
    return F.when(plain, _translate(text, LEET)).otherwise(_scan_forms(F.when(~plain, text)))  # what stays is sent as null


def trigrams(text: Column) -> Column:
    """Distinct character 3-grams of the lower-case text, in one pass over it."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))."), F.lit(1)), F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 if both are empty. Each is computed once."""

    def of(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"]))
        union = F.size(x["a"]) + F.size(x["b"]) - both
        return F.when(union > 0, both / union).otherwise(F.lit(0.0))

    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), of), F.lit(0))


@F.pandas_udf(DoubleType())
def nearest(own: pd.Series, given: pd.Series) -> pd.Series:
    """The greatest :func:`jaccard` of a lower-case text's :func:`trigrams` and those of each of the given ones; 0 without any.

    Texts that neighbouring rows share are cut up once, and no trigram leaves the row.
    """
    grams = functools.lru_cache(8)(lambda t: frozenset(t[k : k + 3] for k in range(len(t) - 2)))

    def best(text: str | None, others) -> float:
        out = 0.0
        for g in map(grams, () if others is None else others):
            mine = grams(text or "")
            both = len(mine & g)
            union = len(mine) + len(g) - both
            out = max(out, both / union if union else 0.0)
        return out

    return pd.Series([best(a, b) for a, b in zip(own, given)], dtype="float64")


def shannon_entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c))) / n)
    counts = F.filter(counts, lambda p: p > 0)
    return F.when(n > 0, -F.aggregate(counts, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
