"""Tokens, shapes and word lists. Lengths are bytes and lower-casing is ASCII unless said otherwise."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a subject, short ones first; one list for prose, one for questions, one for duplicate reports.
PROSE_STOP = frozenset("with will when what were very this they then them that than such some same over onto only must most more make made like just into here have from each done does both been also would while which under those these there their other could after about should before through between because".split())
QUERY_STOP = frozenset("you why who was use two the set see run out our one off not new may its how has get for fix did can but bug are any and all add with when what used this then that than test such some seen same over only most more make made line into have from file each done does code call also would which where using tests raise other lines issue fixed files error could should raises raised errors called running".split())
GRAMMAR = frozenset("you why who was the out our off not may its how has had for did can but are any and all your with will when what were very this then that than such some same over only most more just it's into here have from even each done does both been also would while which where those these there their still other might every could being again after about should before because".split())


def ascii_lower(c: Column) -> Column:
    """A-Z lowered, all else as it is. ``lower`` does no more to ASCII, at less work than ``translate``."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def words(c: Column) -> Column:
    """Runs of Unicode letters, numbers and underscores."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_]+"), "")


def listed(c: Column, among: frozenset[str]) -> Column:
    return c.isin(*sorted(among))


def prose_words(c: Column) -> Column:
    """Words worth indexing, in order: 4 to 24 bytes, with an ASCII letter, lower-cased, no stop words."""
    low = F.transform(F.filter(words(c), lambda x: F.octet_length(x).between(4, 24) & x.rlike("[A-Za-z]")), ascii_lower)
    return F.filter(low, lambda x: ~listed(x, PROSE_STOP))


def indexed(c: Column) -> Column:
    """Of a list of lowered words, those that prose words can be: lowering keeps length and letters, so that words may be judged after it."""
    return F.filter(c, lambda x: F.octet_length(x).between(4, 24) & x.rlike("[a-z]") & ~listed(x, PROSE_STOP))


def query_words(c: Column, least: int = 4) -> Column:
    """Distinct lower-cased words of a question, at least so many bytes long, no stop words."""
    return F.array_distinct(F.filter(F.transform(words(c), ascii_lower), lambda x: (F.octet_length(x) >= least) & ~listed(x, QUERY_STOP)))


def symbol_runs(c: Column) -> Column:
    """Runs of letters, numbers, underscores and dots, of 3 bytes or more."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_.]+"), lambda x: F.octet_length(x) >= 3)


def runs_apart(runs: Column) -> Column:
    """Each run's parts between dots, then the run; 3 bytes or more. An escaped dot is split at without a pattern."""
    parts = F.transform(runs, lambda r: F.when(r.contains("."), F.concat(F.split(r, r"\."), F.array(r))).otherwise(F.array(r, r)))
    return F.filter(F.flatten(parts), lambda x: F.octet_length(x) >= 3)


def symbol_tokens(c: Column) -> Column:
    """Names a text may mention: its runs, first by parts, then whole."""
    return runs_apart(symbol_runs(c))


def symbol_names(c: Column) -> Column:
    """The distinct symbol tokens, in order; runs are made distinct before they are taken apart."""
    return F.array_distinct(runs_apart(F.array_distinct(symbol_runs(c))))


def identifier_shape(c: Column) -> Column:
    """How much a token looks copied from source: 3 for underscores or mixed case, 2 for capitals, else 0."""
    upper, lower = c.rlike(r"\p{Lu}"), c.rlike(r"\p{Ll}")
    return F.when(c.contains("_"), 3).when(upper & lower, 3).when(upper, 2).otherwise(0)


def report_words(c: Column) -> Column:
    """Lower-cased words of a report, numbers kept."""
    return F.transform(words(c), ascii_lower)


def report_text(c: Column) -> Column:
    """The report words joined by single blanks."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def runs(w: Column, n: int = 3) -> Column:
    """Every n neighbours, joined by blanks. Shifted copies are zipped, so that the array is made n times, not once an element."""
    out = w
    for i in range(2, n + 1):
        out = F.zip_with(out, F.slice(w, i, 1 << 30), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.filter(out, lambda x: x.isNotNull())


def shingles(w: Column, n: int = 3) -> Column:
    """Distinct runs of n neighbours."""
    return F.array_distinct(runs(w, n))


def content_words(w: Column) -> Column:
    """Distinct words of more than two bytes that aren't grammar."""
    return F.array_distinct(F.filter(w, lambda x: (F.octet_length(x) > 2) & ~listed(x, GRAMMAR)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))
