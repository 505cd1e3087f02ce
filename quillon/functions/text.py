"""Text functions on columns: normal forms, tokens, paths."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("title", "description", "acceptance_criteria", "design")
FIELD_LIMIT = 16_000

# Word lists of the token rules.
GENERIC_TOKENS = (
    "add architecture api apis application behavior build change code component configure create data design ensure feature flow "
    "handling implement implementation improve infrastructure issue lifecycle module native new path process project resource "
    "runtime platform provide refactor service support state system task test update use workflow"
).split()
FUNCTION_WORDS = "add and for from into the this using with".split()
WORKFLOW_TERMS = "cli command commands target task test tests".split()


def normalize_text(text: Column, limit: int = FIELD_LIMIT) -> Column:
    """LF line ends, no trailing white space on lines or around the text, cut to ``limit``."""
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    lines = F.regexp_replace(lines, r"(?U)[^\S\n]+(?=\n|\z)", "")
    return F.substring(F.regexp_replace(lines, r"(?U)\A\s+|\s+\z", ""), 1, limit)


def canonical_text(limit: int = FIELD_LIMIT) -> Column:
    """The record's sections under headings, its title twice; empty sections left out."""
    named = [("Title", "title"), ("Title emphasis", "title"), ("Description", "description"), ("Acceptance criteria", "acceptance_criteria"), ("Design", "design"), ("Notes", "notes")]
    parts = []
    for heading, name in named:
        own = normalize_text(F.col(name), limit)
        parts.append(F.when(own != "", F.concat(F.lit(f"{heading}:\n"), own)))
    return F.concat_ws("\n\n", *parts)


def split_camel(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2"))


def long_tokens(text: Column) -> Column:
    return F.regexp_extract_all(split_camel(text), F.lit("([a-z0-9][a-z0-9_-]{2,})"), 1)


def reciprocal_tokens(text: Column) -> Column:
    """Tokens in order, repeats kept, without the generic vocabulary."""
    return F.filter(long_tokens(text), lambda t: ~t.isin(GENERIC_TOKENS))


def sparse_title_tokens(title: Column) -> Column:
    return F.array_except(F.array_distinct(long_tokens(title)), F.array(*map(F.lit, FUNCTION_WORDS)))


def phrases(tokens: Column) -> Column:
    """Distinct pairs of neighbouring tokens."""
    return F.array_distinct(
        F.when(F.size(tokens) < 2, F.array().cast("array<string>")).otherwise(
            F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        )
    )


def _found(text: Column, pattern: str, ascii_pattern: str, normal: Callable[[str], str]) -> Column:
    """Matches of a word pattern in folded text.

    Spark has neither full case folding nor NFKC, so texts beyond ASCII, and only
    they, go through Python in Arrow batches.
    """

    @F.pandas_udf("array<string>")
    def beyond(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else re.findall(pattern, normal(t)))

    plain = F.coalesce(text, F.lit(""))
    other = plain.rlike("[^\\x00-\\x7F]")
    return F.coalesce(beyond(F.when(other, plain)), F.regexp_extract_all(F.lower(plain), F.lit(ascii_pattern), 0))


def word_tokens(text: Column) -> Column:
    """Words of letters, digits, apostrophes and hyphens, case folded; one empty word if none."""
    found = _found(text, r"[\w'-]+", r"[A-Za-z0-9_'-]+", str.casefold)
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def explain_tokens(text: Column, stop_words: tuple[str, ...]) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*stop_words)))


def plain_title(title: Column) -> Column:
    """Words of letters and digits after NFKC and case folding, joined by blanks."""
    return F.array_join(_found(title, r"[^\W_]+", "[A-Za-z0-9]+", lambda t: unicodedata.normalize("NFKC", t).casefold()), " ")


#: Fixed value: what a ticket's identifier looks like.
IDENTIFIER = r"\b[A-Z]{2,8}-?\d{2,5}\b"


def identifiers(text: Column) -> Column:
    """Identifiers of a text, in order, repeats kept."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), 0)


def identifier_score(a: Column, b: Column) -> Column:
    """1 for titles that are equal but for case, 0.9 for a common identifier, else 0."""
    return F.when(F.lower(a) == F.lower(b), 1.0).when(F.arrays_overlap(identifiers(a), identifiers(b)), 0.9).otherwise(0.0)


def markdown_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def relation_type(name: Column) -> Column:
    return F.translate(F.lower(name), "_ ", "--")


def module_of(path: Column) -> Column:
    """The first two folders of a path; null where it has fewer."""
    folders = F.filter(F.split(path, "/"), lambda p: p != "")
    depth = F.when(path.endswith("/"), F.size(folders)).otherwise(F.size(folders) - 1)
    return F.when(depth >= 2, F.array_join(F.slice(folders, 1, 2), "/"))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets; 0 where either is empty."""
    both = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)
