"""Ways to disguise an action. What is random elsewhere is drawn from a hash of a key, so that every engine draws alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------
LEET_FROM, LEET_TO = "aAeEiIoOsStT", "443311005577"
SHORT_LEET_FROM, SHORT_LEET_TO = "aeosi", "430$1"
ZERO_WIDTH_SHARE = 0.25
VARIABLES = (("data", "_a"), ("content", "_x"), ("payload", "_buf"), ("body", "_b"), ("file", "_f"), ("encoded", "_enc"), ("secrets", "_s"), ("text", "_t"), ("obj", "_o"), ("files", "_fs"), ("key", "_k"), ("result", "_r"))
LOOKALIKES_FROM, LOOKALIKES_TO = "aeocp", "аеоср"
QUOTED = r"""'([^']+)'|"([^"]+)\""""
QUOTED_6 = r"""'([^']{6,})'|"([^"]{6,})\""""
# ----------------------------------------------------------------------------------------------------


def pick(n: int, *key: Column) -> Column:
    """A number below ``n`` that depends on the key alone."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def base64_of(text: Column) -> Column:
    return F.regexp_replace(F.base64(text.cast("binary")), r"\s", "")


def _first_quoted(text: Column, pattern: str, made) -> Column:
    """The text with its first quoted string replaced by ``made(quote, inside)``; without one as it is."""
    whole = F.regexp_substr(text, F.lit(pattern))
    quote, inside = F.left(whole, F.lit(1)), F.substr(whole, F.lit(2), F.length(whole) - 2)
    at = F.instr(text, whole)
    return F.when(whole.isNull(), text).otherwise(F.concat(F.substr(text, F.lit(1), at - 1), made(quote, inside), F.substr(text, at + F.length(whole))))


def encoded(text: Column) -> Column:
    return _first_quoted(text, QUOTED, lambda q, s: F.concat(F.lit("b64decode("), q, base64_of(s), q, F.lit(")")))


def leet(text: Column) -> Column:
    return F.translate(text, LEET_FROM, LEET_TO)


def zero_width(text: Column, *key: Column) -> Column:
    """A zero-width space after about a quarter of the letters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    drawn = lambda c, i: c.rlike("[A-Za-z]") & (pick(100, *key, i) < int(100 * ZERO_WIDTH_SHARE))
    return F.array_join(F.transform(chars, lambda c, i: F.when(drawn(c, i), F.concat(c, F.lit("​"))).otherwise(c)), "")


def variable_names(text: Column, *key: Column) -> Column:
    """Names of variables that stand alone between brackets, commas and spaces as short ones."""
    for k, (name, short) in enumerate(VARIABLES):
        text = F.regexp_replace(text, F.lit(rf"(?<=[,()\s])({name})(?=[,)\s])"), F.concat(F.lit(short), pick(100, *key, F.lit(k)).cast("string")))
    return text


def split_string(text: Column, *key: Column) -> Column:
    """The first quoted string of six characters or more as a sum of two."""

    def made(q: Column, s: Column) -> Column:
        at = 2 + F.pmod(pick(1 << 30, *key), F.length(s) - 3)
        return F.concat(q, F.substr(s, F.lit(1), at.cast("int")), q, F.lit(" + "), q, F.substr(s, (at + 1).cast("int")), q)

    return _first_quoted(text, QUOTED_6, made)


def techniques(text: Column, *key: Column) -> list[Column]:
    """The five that are cycled, in order."""
    return [encoded(text), leet(text), zero_width(text, *key), variable_names(text, *key), split_string(text, *key)]


def variants(text: Column, *key: Column) -> list[Column]:
    """Four ways to make a variant: a zero-width space in a word, the last word encoded, the last word in leet, look-alike letters."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    at = F.pmod(pick(1 << 30, *key), F.greatest(n, F.lit(1)))
    broken = F.array_join(F.transform(words, lambda w, i: F.when(i == at, F.concat(F.left(w, F.lit(1)), F.lit("​"), F.substr(w, F.lit(2)))).otherwise(w)), " ")
    head, last = F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), " "), F.get(words, n - 1)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    alike = F.array_join(F.transform(chars, lambda c, i: F.when(pick(10, *key, i) < 3, F.translate(c, LOOKALIKES_FROM, LOOKALIKES_TO)).otherwise(c)), "")
    return [
        F.when(n < 2, text).otherwise(broken),
        F.when(n < 2, text).otherwise(F.concat(head, F.lit(" $(echo "), base64_of(last), F.lit(" | base64 -d)"))),
        F.when(n < 1, text).otherwise(F.trim(F.concat(head, F.lit(" "), F.translate(last, SHORT_LEET_FROM, SHORT_LEET_TO)))),
        alike,
    ]
