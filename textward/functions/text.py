"""Text kernel as Column expressions: keys, tokens, stems, near-duplicate keys, quoting."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import constants as C

#: White space of Unicode as an explicit class body, the same in Java and RE2.
SPACES = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
TOKEN_SPLIT = "[" + SPACES + "".join("\\" + c if c in "()[]{}|^.?+" else c for c in C.SEPARATORS) + "]+"
#: What near_key deletes, and its white space, for Java alone: letters and spaces leave at the first tests.
_MARKS = r"[\P{L}&&[^ ]&&[^\p{N}_" + SPACES + "]]+"
_BLANKS = r"[\P{L}&&[" + SPACES + "]]+"


def _first(ch: str) -> str:
    for table in (C.FOLDED, C.LOOK_ALIKES, C.STAND_INS):
        if ch in table:
            return table[ch]
    return ch


@cache
def key_map() -> tuple[str, str]:
    """Two strings of equal length: characters, and the key letter that each stands for.

    The whole kernel works character by character, so it is one map: fold, lower,
    fold and lower again, then base letters of what is left. Characters that do
    not end as one of a-z or 0-9 are missing here and deleted by the caller.
    """
    src, dst = [], []
    for point in range(0x10000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        out = "".join(_first(c) for c in _first(chr(point)).lower()).lower()
        out = "".join(c for c in unicodedata.normalize("NFD", out) if not unicodedata.combining(c))
        out = "".join(c for c in out if c.isascii() and c.isalnum())
        if len(out) == 1 and out != chr(point):
            src.append(chr(point))
            dst.append(out)
    return "".join(src), "".join(dst)


def normalise(text: Column) -> Column:
    """Key of a word: letters folded, look-alikes and stand-ins read as letters, the rest dropped, repeats
    collapsed. Empty for null and for text without a letter. Plain Latin words take a shorter way to the same key."""
    src, dst = key_map()
    plain = F.regexp_replace(F.translate(text, src, dst), "[^a-z0-9]+", "")
    collapsed = lambda x: F.regexp_replace(x, r"(.)\1+", "$1")
    return (
        F.when(text.rlike(r"^[a-z]+\z") & ~text.rlike(r"(.)\1"), text)
        .when(text.rlike(r"^[A-Za-z]+\z"), collapsed(F.lower(text)))
        .when(text.rlike(r"\p{L}"), collapsed(plain))
        .otherwise(F.lit(""))
    )


@cache
def _gaps() -> str:
    """The characters of TOKEN_SPLIT but the space."""
    python = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", TOKEN_SPLIT)
    return "".join(c for c in map(chr, range(0x10000)) if c != " " and re.fullmatch(python, c))


@cache
def _letter_map() -> tuple[str, str]:
    """As key_map, of letters alone; and separators of tokens to spaces."""
    letters = [(a, b) for a, b in zip(*key_map()) if unicodedata.category(a)[0] == "L"]
    return "".join(a for a, _ in letters) + _gaps(), "".join(b for _, b in letters) + " " * len(_gaps())


def keys(text: Column) -> Column:
    """The keys of tokens(text), in order: normalise of each.

    Letters are mapped, repeats collapsed and separators made spaces over the whole text; a token that then is of
    letters alone is its key. Only the others (digits, stand-ins, foreign letters) are normalised one by one, which
    gives the same, since what was mapped stays as it is.
    """
    flat = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), *_letter_map()), r"([a-z])\1+", "$1")
    return F.transform(F.array_remove(F.split(flat, " "), ""), lambda k: F.when(k.rlike(r"^[a-z]+\z"), k).otherwise(normalise(k)))


def tokens(text: Column) -> Column:
    """Raw tokens in order; null text has none. Separators are made spaces first: splitting at one character takes no
    regular expression."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _gaps(), " " * len(_gaps())), " "), "")


def near_key(text: Column) -> Column:
    """Key that near-duplicate comments share: lower case, no marks, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), _MARKS, ""), _BLANKS, " "))


def _suffix_ends(key: Column) -> Column:
    """Whether key ends as some listed suffix does, by two letters."""
    return F.right(key, F.lit(2)).isin(sorted({s[-2:] for s in C.FALLBACK_SUFFIXES}))


def has_stem(key: Column) -> Column:
    """Whether stem gives one; also for use in lambdas."""
    return _suffix_ends(key) & key.rlike("^.{%d,}(?:%s)$" % (C.MIN_STEM, "|".join(C.FALLBACK_SUFFIXES)))


def stem(key: Column) -> Column:
    """key without its first listed suffix that leaves a stem; null if there is none."""
    out = F.regexp_extract(key, "^(.{%d,}?)(?:%s)$" % (C.MIN_STEM, "|".join(C.FALLBACK_SUFFIXES)), 1)
    # Most keys end like no suffix at all, which two letters tell.
    return F.nullif(F.when(_suffix_ends(key), out), F.lit(""))


def quote(value: Column) -> Column:
    """SQL string literal."""
    escaped = F.replace(F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.concat(F.lit("'"), escaped, F.lit("'"))


def unit(*parts: Column) -> Column:
    """A number from 0 to 1 decided by the parts: what takes the place of random draws."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def overlap(a: Column, b: Column) -> Column:
    """Distinct lower-case words that two texts share."""
    words = lambda x: F.array_distinct(F.split(F.lower(x), "[" + SPACES + "]+"))
    return F.size(F.array_remove(F.array_intersect(words(a), words(b)), ""))


def register(spark: SparkSession) -> None:
    """textward_key and textward_tokens for SQL text."""
    src, dst = (s.replace("\\", "\\\\").replace("'", "\\'") for s in key_map())
    split = TOKEN_SPLIT.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION textward_key(t STRING) RETURNS STRING RETURN CASE WHEN t RLIKE '\\\\p{L}' THEN "
        f"regexp_replace(regexp_replace(translate(t, '{src}', '{dst}'), '[^a-z0-9]+', ''), '(.)\\\\1+', '$1') ELSE '' END"
    )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION textward_tokens(t STRING) RETURNS ARRAY<STRING> RETURN array_remove(split(coalesce(t, ''), '{split}'), '')"
    )
