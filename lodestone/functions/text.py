"""Normalization of names and addresses as column expressions. Missing text is '' everywhere; null counts as ''."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.dictionaries import ADDRESS_ABBREVIATIONS, ADDRESS_PLACEHOLDERS, LEGAL_SUFFIXES, NAME_ABBREVIATIONS

#: A maximal run of word characters; equal to a run of \w in languages whose \w is Unicode-aware.
NOT_WORD = r"[^\p{L}\p{N}_]+"


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")


#: Latin and combining characters whose bare form is at most one character; those that change, and what they become.
_SIMPLE = [chr(i) for i in range(0x0250) if len(_bare(chr(i))) == 1] + [chr(i) for i in range(0x0300, 0x0370) if not _bare(chr(i))]
_CHANGED = [c for c in _SIMPLE if _bare(c) not in ("", c)] + [c for c in _SIMPLE if not _bare(c)]
_ODD = "".join(chr(i) for i in range(0x0250) if chr(i) not in set(_SIMPLE))


def _bare_column(x: Column) -> Column:
    def bare(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else _bare(x))

    return F.pandas_udf(bare, "string")(x)


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def strip_accents(x: Column) -> Column:
    """Compatibility decomposition without its non-spacing marks. Latin text stays in the JVM."""
    odd = "".join(f"\\x{{{ord(c):04X}}}" for c in _ODD)
    rest = F.regexp_replace(x, r"[\x00-\x7F]+", "")  # of ASCII nothing changes, and the class below takes long for each character
    latin = rest.rlike(rf"^[\x{{0000}}-\x{{024F}}\x{{0300}}-\x{{036F}}&&[^{odd}]]*$")
    plain = F.translate(x, "".join(_CHANGED), "".join(_bare(c) for c in _CHANGED))
    return F.when(rest == "", x).when(latin, plain).otherwise(_bare_column(F.when(~latin, x)))


#: ASCII characters that normalization takes for spaces.
_SPACES = {i: " " for i in range(128) if not (chr(i).isalnum() or chr(i) in "_-")}
_MARK = re.compile(r"[^\w\s-]")


def _plain(x: str) -> str:
    """normalize_text() of a text in lower case."""
    if not x.isascii():
        x = unicodedata.normalize("NFKD", x)
        for c in set(x):
            if c > "\x7f" and unicodedata.category(c) == "Mn":
                x = x.replace(c, "")
    x = x.replace("&", " and ")
    return " ".join((x.translate(_SPACES) if x.isascii() else _MARK.sub(" ", x)).split())


def _normalized(x: Column, words: dict[str, str] | None = None, drop: list[str] | None = None) -> Column:
    """normalize_text(), with whole tokens replaced once and some of what results dropped; one call for each Arrow batch, as
    regular expressions and lookups by token take the JVM many times as long."""
    skip = frozenset(drop or ())

    def one(text: str) -> str:
        text = _plain(text)
        return " ".join([t for t in (words.get(t, t) for t in text.split(" ")) if t not in skip]) if words else text

    def normalized(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.pandas_udf(normalized, "string")(F.lower(_text(x)))


def normalize_text(x: Column) -> Column:
    """Lower case, no accents, '&' as 'and', other marks but hyphens as spaces, single spaces."""
    return _normalized(x)


def expand_abbreviations(x: Column, words: dict[str, str]) -> Column:
    """Whole tokens replaced once."""
    table = F.create_map(*(F.lit(v) for kv in words.items() for v in kv))
    return F.array_join(F.transform(F.split(x, " "), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def normalize_name(x: Column) -> Column:
    return _normalized(x, NAME_ABBREVIATIONS)


def name_core(name_norm: Column) -> Column:
    """A normalized name without the legal forms at its end, as long as a word is left before them."""
    forms = "|".join(sorted(LEGAL_SUFFIXES, key=len, reverse=True))
    ends = reduce(Column.__or__, (F.endswith(name_norm, F.lit(f" {x}")) for x in LEGAL_SUFFIXES))  # most names end otherwise
    return F.when(ends, F.regexp_replace(name_norm, rf"(?: (?:{forms}))+$", "")).otherwise(name_norm)


def normalize_address(x: Column) -> Column:
    return _normalized(x, ADDRESS_ABBREVIATIONS, ADDRESS_PLACEHOLDERS)


def words(x: Column) -> Column:
    """Runs of word characters, in order."""
    return F.filter(F.split(x, NOT_WORD), lambda t: t != "")


def tokens(x: Column) -> Column:
    """Distinct space-separated tokens; none of ''."""
    return F.array_distinct(F.filter(F.split(_text(x), r"\s+"), lambda t: t != ""))


def postal_codes(address_norm: Column) -> Column:
    """All words of five or six digits, in order, with repeats."""
    return F.array_join(F.regexp_extract_all(address_norm, F.lit(r"(?<![\p{L}\p{N}_])\p{Nd}{5,6}(?![\p{L}\p{N}_])"), F.lit(0)), " ")


def house_number(address_norm: Column) -> Column:
    """The number that an address begins with, with the letters, digits and hyphens tied to it."""
    return F.regexp_extract(address_norm, r"^(\p{Nd}+[\p{L}\p{N}_-]*[\p{L}\p{N}_]|\p{Nd}+)", 1)


def address_numbers(address_norm: Column) -> Column:
    """All runs of digits, distinct and in lexicographic order."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(address_norm, F.lit(r"\p{Nd}+"), F.lit(0)))), " ")


def parse_id_list(x: Column) -> Column:
    """The ids of a comma-separated list, trimmed, without empty ones; none of null."""
    return F.filter(F.transform(F.split(_text(x), ","), lambda t: F.trim(t)), lambda t: t != "")


def format_id_list(ids: Column) -> Column:
    return F.array_join(ids, ",")
