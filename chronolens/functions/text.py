"""Tokens, labels and names as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token patterns, and the words too common to say anything, as required for equal counts.
ASCII_TOKEN = "[a-zA-Z_][a-zA-Z0-9_]{2,}"
CJK_TOKEN = "[一-鿿]{2,}"
STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might can shall
to of in for on with at by from as into through during before after and but or not no if then else when
up out so than too very just about it its this that these those he she they we you i me my your his her
our their what which who whom how all each every both few more most other some such only own same new
的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这
""".split()


def tokens(text: Column, longest: int = 50) -> Column:
    """Identifier-like words of three letters or more, then runs of two CJK characters or more.

    Stop words are compared in lower case, words keep their own; runs of CJK
    characters are compared too; ASCII words longer than ``longest`` are left out.
    Null gives an empty array.
    """
    plain = F.filter(F.regexp_extract_all(text, F.lit(ASCII_TOKEN), F.lit(0)), lambda w: ~F.lower(w).isin(STOP_WORDS) & (F.length(w) <= longest))
    cjk = F.filter(F.regexp_extract_all(text, F.lit(CJK_TOKEN), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))
    return F.coalesce(F.concat(plain, cjk), F.array().cast("array<string>"))


def plain_label(label: Column) -> Column:
    """A label for comparison: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]", "")


def character_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters of two texts; 0 if either is empty."""
    one, two = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.size(F.array_intersect(one, two)) / F.size(F.array_union(one, two)))


def same_activity(new: Column, known: Column) -> Column:
    """Whether two labels mean one activity: equal, one within the other, or mostly the same characters."""
    a, b = F.lower(F.trim(new)), F.lower(F.trim(known))
    inside = (F.length(a) >= 3) & (F.length(b) >= 3) & (a.contains(b) | b.contains(a))
    return (plain_label(new) == plain_label(known)) | inside | (character_jaccard(F.regexp_replace(a, r"\s", ""), F.regexp_replace(b, r"\s", "")) > 0.6)


def estimated_tokens(text: Column) -> Column:
    """A third of the characters, 1 at least; 0 for an empty text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 3))).cast("long")


def safe_name(name: Column, longest: int = 50) -> Column:
    """A name for files: unsafe characters become ``_``; long names end in a hash of the whole."""
    clean = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f\s]', "_")
    return F.when(F.length(clean) <= longest, clean).otherwise(F.concat(F.substring(clean, 1, longest - 9), F.lit("_"), F.substring(F.md5(name), 1, 8)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def readable_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB (powers of 1 024), one decimal from KB on."""
    at = lambda power, unit: F.format_string(f"%.1f {unit}", size / 1024.0**power)
    return F.when(size < 1024, F.format_string("%d B", size)).when(size < 1024**2, at(1, "KB")).when(size < 1024**3, at(2, "MB")).otherwise(at(3, "GB"))
