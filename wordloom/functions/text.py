"""Tokenizers as Catalyst expressions.

A token is a run of letters and straight apostrophes in lower case. Markup is taken off on the index
side only: of links and images the visible text stays, tags become spaces, entities become spaces
(the apostrophe's an apostrophe); all other Markdown marks are no letters and separate anyway.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MIN_PREFIX = 3
#: (pattern, replacement) in the common part of Java's and RE2's syntax, in order.
MARKUP = [
    (r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " "),
    (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"</?[A-Za-z!][^>]*>", " "),
    (r"&#39;|&apos;", "'"),
    (r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z]+);", " "),
]


#: Each pattern matches only where one of these stands: other texts are left out of the search.
MARKS = ("<", "&", "](")


def strip_markup(c: Column) -> Column:
    has, out = reduce(or_, [F.contains(c, F.lit(m)) for m in MARKS]), c
    for pattern, to in MARKUP:
        out = F.regexp_replace(out, pattern, to)
    return F.when(has, out).otherwise(c)


def clean(c: Column) -> Column:
    """Every character that is neither alphabetic nor an apostrophe becomes a space."""
    return F.regexp_replace(c, r"[^\p{IsAlphabetic}']", " ")


#: Letters whose lower case is no letter throughout or depends on what is beside them, and two that are
#: newer than the letters of regular expressions.
LATE_CASE = ("İ", "Σ", "\ua7cb", "\ua7dc")


def tokens(c: Column) -> Column:
    """Tokens in order, with repeats; an empty array for null. Lower case first and one split give what
    cleaning first gives, save for LATE_CASE."""
    c = F.coalesce(c, F.lit(""))
    late = reduce(or_, [F.contains(c, F.lit(x)) for x in LATE_CASE])
    parts = F.when(late, F.split(F.lower(clean(c)), " +")).otherwise(F.split(F.lower(c), r"[^\p{IsAlphabetic}']+"))
    return F.array_remove(parts, "")


def index_tokens(c: Column) -> Column:
    return tokens(strip_markup(F.coalesce(c, F.lit(""))))


def without(terms: Column, stopwords: Iterable[str]) -> Column:
    """Distinct terms that are no stop words; an empty list of stop words leaves all."""
    words, each = list(stopwords), F.array_distinct(terms)
    return F.filter(each, lambda t: ~t.isin(words)) if words else each


def index_terms(parts: Iterable[Column], stopwords: Iterable[str]) -> Column:
    """The set of terms of several texts together."""
    return without(F.concat(*[index_tokens(p) for p in parts]), stopwords)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def prefix_key(term: Column) -> Column:
    """What a term and any query that it completes agree in."""
    return F.substring(term, 1, MIN_PREFIX)


def query_tokens(spark: SparkSession, query: str) -> list[str]:
    """tokens() of a literal query, by the very expression: what is a letter is decided in one place."""
    return spark.sql("select 1").select(tokens(F.lit(query))).first()[0]
