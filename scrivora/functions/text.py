"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Search methods by code.
METHODS = {2: "TF-IDF", 3: "SVD", 4: "Low-Rank SVD"}
DEFAULT_METHOD, DEFAULT_LIMIT = 2, 10
#: Ranks for which factors are built.
RANKS = (10, 25, 50)


def tokenize(text: Column) -> Column:
    """Runs of more than two ASCII letters or digits in lower case; every other character divides. Null gives none."""
    runs = F.split(F.coalesce(text, F.lit("")), "[^a-zA-Z0-9]+")
    return F.transform(F.filter(runs, lambda t: F.length(t) > 2), F.lower)


def tokenize_blanks(text: Column) -> Column:
    """Parts between white space in lower case, without signs other than letters at both ends; emptied parts are dropped."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+")
    bare = F.transform(parts, lambda t: F.regexp_replace(t, r"^[^\p{IsAlphabetic}]+|[^\p{IsAlphabetic}]+$", ""))
    return F.filter(bare, lambda t: t != "")


def title_and_text(title: Column, text: Column) -> Column:
    return F.concat_ws(" ", title, text)


def snippet(text: Column, size: int = 150) -> Column:
    """The first ``size`` characters, with dots if there are more; a placeholder for a missing text."""
    cut = F.concat(F.substring(text, 1, size), F.when(F.length(text) > size, "...").otherwise(""))
    return F.when(F.coalesce(text, F.lit("")) == "", "No content available").otherwise(cut)


def titled(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled Document"))


def fixed(value: Column, decimals: int = 4) -> Column:
    return F.format_string(f"%.{decimals}f", value)


def clock(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS; hours may have more digits."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def number_or_zero(text: Column, kind: str = "int") -> Column:
    return F.coalesce(text.try_cast(kind), F.lit(0).cast(kind))


def method_name(code: Column) -> Column:
    chain = F.lit("Unknown")
    for number, name in METHODS.items():
        chain = F.when(code == number, name).otherwise(chain)
    return chain


def rank_bucket(k: Column) -> Column:
    """The smallest built rank that holds ``k``, or the largest."""
    return F.when(k <= RANKS[0], RANKS[0]).when(k <= RANKS[1], RANKS[1]).otherwise(RANKS[2])


def index_name(k: Column) -> Column:
    return F.concat(F.lit("svd_k="), k.cast("string"))


def index_folder(k: int) -> str:
    """The folder of the factors of rank ``k``."""
    return f"svd_k={k}"
