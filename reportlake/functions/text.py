"""String expressions with the white space and case rules of Unicode strings."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"  # with (?U)
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # the same, one by one


def let(x: Column, of) -> Column:
    """of(x) with x computed once, however often it is named there.

    The largest of one element is that element. `get` would do as well, but
    asks for the type of its array at every row, which walks through all of of.
    """
    return F.array_max(F.transform(F.array(x), of))


def swap(x: Column, chars: str, by: str) -> Column:
    """x with each of a few characters replaced; whether any is there is quicker to see than to replace it."""

    def of(y: Column) -> Column:
        out = y
        for c in chars:
            out = F.replace(out, F.lit(c), F.lit(by))
        return F.when(contains_any(y, chars), out).otherwise(y)

    return let(x, of)


def strip(x: Column) -> Column:
    """Without white space around it: each end is looked up in a list, a short one where all characters are ASCII."""
    return let(x, lambda y: F.when(F.octet_length(y) == F.length(y), F.btrim(y, F.lit(BLANKS[:10]))).otherwise(F.btrim(y, F.lit(BLANKS))))


def collapse(x: Column) -> Column:
    """Runs of white space as single blanks; those that are so are passed over."""
    return F.trim(F.regexp_replace(x, rf"(?U){SPACE}(?:(?<! ){SPACE}*|{SPACE}+)", " "))


def lines(x: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(F.split(x, r"[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]+"), strip), lambda s: s != "")


def sentences(x: Column) -> Column:
    return F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: s != "")


def flat_sentences(x: Column) -> Column:
    """Sentences of text without other white space than single blanks: a blank is quicker to find than what stands before it."""
    return F.filter(F.split(x, " (?<=[.!?] )"), lambda s: s != "")


def unit_token(u: Column) -> Column:
    """A unit for comparing: lower case without blanks, with a plain 3."""
    return F.replace(F.replace(F.lower(u), F.lit(" "), F.lit("")), F.lit("³"), F.lit("3"))


def unit_token_wide(u: Column) -> Column:
    """The same without any white space."""
    return unit_token(F.regexp_replace(u, rf"(?U){SPACE}+", ""))


def token(u: str) -> str:
    return u.lower().replace(" ", "").replace("³", "3")


@lru_cache(maxsize=1)
def accents() -> tuple[str, str]:
    """Characters whose decomposition without marks is one letter or digit, and that letter or digit."""
    pairs = {}
    for i in range(0x80, 0x10000):
        c = chr(i)
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(bare) == 1 and re.fullmatch("[a-z0-9]", bare):
            pairs[c] = bare
    return "".join(pairs), "".join(pairs.values())


def plain_words(s: Column) -> Column:
    """Lower case, without accents, other characters than letters and digits as single blanks."""
    other = "[^a-z0-9]"

    def bare(low: Column) -> Column:
        return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.regexp_replace(F.translate(low, *accents()), r"\p{Mn}", ""))

    return F.trim(F.regexp_replace(let(F.lower(strip(s)), bare), f"{other}(?:(?<! ){other}*|{other}+)", " "))


@lru_cache(maxsize=1)
def cases() -> dict[str, str]:
    """Letters that read the same without case, by what they fold to."""
    found: dict[str, str] = {}
    for i in range(0x10000):
        c = chr(i)
        if c.casefold() != c or c.upper() != c:
            found[c.casefold()] = found.get(c.casefold(), "") + c
    return found


def letter(c: str) -> str:
    """A pattern of one character in any case: a set to look up, which is quicker than a pattern's flag."""
    same = cases().get(c.casefold(), c)
    return re.escape(c) if same == c else f"[{same}]"


def any_case(s: str) -> str:
    return "".join(map(letter, s))


def alternatives(units: tuple[str, ...]) -> str:
    """A pattern of any of the units, in any case."""
    return "|".join(map(any_case, units)) if units else r"(?!x)x"


def first(values: Column, wanted) -> Column:
    """The first element for which wanted holds, else null."""
    return let(values, lambda v: F.get(F.filter(v, wanted), F.lit(0)))


def contains_any(x: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(x, F.lit(p))
    return out


def unfenced(x: Column) -> Column:
    """Without a code fence around it, with or without a language name."""
    return strip(F.regexp_replace(x, r"^\s*```(?:json)?|```\s*$", ""))
