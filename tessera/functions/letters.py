"""Words in coded letters to Unicode and to Latin letters, by longest match.

A coded word is cut into the longest codes that the table knows (a letter with its marks, a sign of two letters), each code is spelled by its
own rule, and what the table doesn't know stays as it is.  Rules may look at the code that follows (the last sigma of a word).
All of it is column expressions but for the composition of marks (`nfc`); `once_per_word` spells every distinct word once.
Nulls stay null; an empty text stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import drop_accents, nfc

#: The letters of Beta Code and what they stand for.
CODED, GREEK = "abgdezhqiklmncoprstufxyw", "αβγδεζηθικλμνξοπρστυφχψω"
#: Its marks in the order in which Unicode composes them, and the combining characters.
MARKS, COMBINING = ")(+/\\=|", "̓̔̈́̀͂ͅ"
#: Its punctuation.
SIGNS = (":'#", "·’ʹ")
#: Latin spelling of Greek letters without marks, the longer ones first.
ROMAN = (("γγ", "ng"), ("γκ", "nk"), ("γξ", "nx"), ("γχ", "nch"), ("θ", "th"), ("φ", "ph"), ("χ", "ch"), ("ψ", "ps"), ("ου", "ou"))
ROMAN_LETTERS = ("αβγδεζηικλμνξοπρσςτυω", "abgdeziiklmnxoprsstyo")


def codes(c: Column, pattern: str) -> Column:
    """The longest codes of a text in order, every other character alone."""
    return F.regexp_extract_all(c, F.lit(f"({pattern}|[\\s\\S])"), F.lit(1))


def beta_code(c: Column) -> Column:
    """Beta Code as composed Greek: "*" makes a capital and stands before its marks, marks may come in any order, an "s" is final at a word's end or
    as "s2", and within it otherwise or as "s1", "s3"."""
    marks = "[" + re.escape(MARKS) + "]*"
    parts = codes(c, rf"\*{marks}[{CODED}{CODED.upper()}]|[sS]{marks}[123]?|[{CODED}{CODED.upper()}]{marks}")
    places = "".join(map(str, range(len(MARKS))))

    def ordered(x: Column) -> Column:
        held = F.regexp_replace(x, r"[^" + re.escape(MARKS) + "]", "")
        return F.translate(F.array_join(F.array_sort(F.split(F.translate(held, MARKS, places), "")), ""), places, COMBINING)

    def spelled(x: Column, i: Column) -> Column:
        small = F.lower(F.regexp_replace(x, r"[^A-Za-z]", ""))
        letter = F.translate(small, CODED, GREEK)
        after = F.get(parts, i + 1)
        last = F.coalesce(~after.rlike(r"^\p{L}"), F.lit(True))
        sigma = F.when(F.endswith(x, F.lit("2")) | (~x.rlike("[13]$") & last), "ς").otherwise("σ")
        known = small.rlike(f"^[{CODED}]$")
        return (
            F.when(x == "*", "")
            .when(F.startswith(x, F.lit("*")), F.concat(F.upper(letter), ordered(x)))
            .when(small == "s", F.concat(sigma, ordered(x)))
            .when(known, F.concat(letter, ordered(x)))
            .otherwise(F.translate(x, *SIGNS))
        )

    return nfc(F.array_join(F.transform(parts, spelled), ""))


def longest_match(c: Column, table: tuple[tuple[str, str], ...], letters: tuple[str, str]) -> Column:
    """table: codes of several letters (or to several), letters: one for one."""
    by_length = sorted(table, key=lambda p: -len(p[0]))
    known = F.create_map(*[F.lit(x) for pair in table for x in pair])
    return F.array_join(F.transform(codes(c, "|".join(re.escape(k) for k, _ in by_length)), lambda x: F.coalesce(F.try_element_at(known, x), F.translate(x, *letters))), "")


def romanize(c: Column) -> Column:
    """Greek words in Latin letters, small and without marks."""
    return longest_match(drop_accents(F.lower(c)), ROMAN, ROMAN_LETTERS)


def once_per_word(df: DataFrame, col: str, spell: Callable[[Column], Column], out: str) -> DataFrame:
    """df with `out`: every distinct word is spelled once and joined back."""
    words = df.select(F.col(col).alias("__w")).filter("__w IS NOT NULL").distinct()
    made = words.select(F.col("__w").alias(col), spell(F.col("__w")).alias(out))
    return df.join(made, col, "left")
