"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as Unicode has it, control separators included; a word is a maximal run of anything else.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[^\s\x1c-\x1f\x85\p{Z}]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null, empty and blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def words(text: Column) -> Column:
    """The words in order; the empty array for null, empty and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def match_form(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscore as one blank."""
    return squeeze(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "))


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens; ``untitled`` where none are left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "untitled").otherwise(s)


def title_case(text: Column) -> Column:
    """First letter of every run of letters in upper case, the others in lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000_000)))), "")


def estimated_pages(text: Column, chars: int = 2400) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.length(text) / F.lit(chars)))


def estimated_tokens(text: Column, chars: int = 4) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.length(text) / F.lit(chars)))


def strip_citations(text: Column) -> Column:
    """Without ``[p:<id>]`` marks that hold one id."""
    return F.regexp_replace(text, r"\[p:[a-f0-9-]+\]", "")


def strip_citation_lists(text: Column) -> Column:
    """Without ``[p:<id>]`` marks that hold one or more ids, and without the blanks before them."""
    return F.regexp_replace(text, r"\s*\[p:[a-f0-9-]+(?:,\s*p:[a-f0-9-]+)*\]", "")


def citations_to_links(text: Column, slug: Column) -> Column:
    """``[p:<id>]`` as a wiki link to the paragraph's anchor in the book's source file."""
    return F.regexp_replace(text, F.lit(r"\[p:([a-f0-9-]+)\]"), F.concat(F.lit("[["), slug, F.lit(r".source#^$1\|↗]]")))


def strip_code_fence(text: Column) -> Column:
    """Without fence lines, where the trimmed text begins with one."""
    t = F.trim(text)
    kept = F.filter(F.split(t, "\n"), lambda line: ~F.ltrim(line).startswith("```"))
    return F.when(t.startswith("```"), F.array_join(kept, "\n")).otherwise(text)
