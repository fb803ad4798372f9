"""Column expressions on Markdown and on the text of model responses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def grid_text(grid: Column) -> Column:
    """A table grid as lines of cells; ``[empty table]`` for null and empty grids."""
    rows = F.transform(grid, lambda r: F.array_join(r, " | ", ""))
    return F.when(F.coalesce(F.size(grid), F.lit(0)) <= 0, "[empty table]").otherwise(F.array_join(rows, "\n", ""))


def grid_markdown(grid: Column) -> Column:
    """A table grid as a Markdown table, the first row as its head; null for null and empty grids."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.element_at(grid, 1), lambda _: F.lit("---")), "|"), F.lit("|"))
    lines = F.concat(F.array(row(F.element_at(grid, 1)), rule), F.transform(F.slice(grid, 2, F.greatest(F.lit(0), F.size(grid) - 1)), row))
    return F.when(F.coalesce(F.size(grid), F.lit(0)) > 0, F.array_join(lines, "\n"))


def merge_overlap(text: Column, more: Column, least: int = 20, most: int = 300) -> Column:
    """``more`` after ``text``, the longest common stretch at the seam only once.

    Stretches of over ``least`` and up to ``most`` characters count; without
    one the parts are joined by a blank line. An empty side gives the other.
    """
    n = F.least(F.length(text), F.length(more), F.lit(most))
    size = F.array_max(F.filter(F.sequence(F.lit(least), F.greatest(F.lit(least), n)), lambda k: (k > least) & (k <= n) & (F.right(text, k) == F.left(more, k))))
    joined = F.when(size.isNotNull(), F.concat(text, F.substring(more, size + 1, F.length(more)))).otherwise(F.concat(F.rtrim(text), F.lit("\n\n"), F.ltrim(more)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, more).when(F.coalesce(F.length(more), F.lit(0)) == 0, text).otherwise(joined)


def html_blocks(md: Column) -> Column:
    """Markdown paragraphs as HTML without citations: emphasis, strong emphasis, headings of the second and third level as third; the first heading is left out."""
    from quire.functions.text import strip_citation_lists

    blocks = F.filter(F.transform(F.split(strip_citation_lists(md), "\n\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    heading = F.array_position(F.transform(blocks, lambda b: b.startswith("#")), True).cast("int")
    kept = F.filter(blocks, lambda b, i: i != heading - 1)

    def block(b: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(b, r"\*\*(.+?)\*\*", "<strong>$1</strong>"), r"\*(.+?)\*", "<em>$1</em>")
        head = F.regexp_extract(b, "^(###? )", 1)
        rest = F.substring(b, F.length(head) + 1, F.length(b))
        return F.when(head != "", F.concat(F.lit("<h3>"), rest, F.lit("</h3>"))).otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>")))

    return F.array_join(F.transform(kept, block), "\n")


def parse_json(response: Column, schema: str) -> Column:
    """A model's JSON answer as a struct, without code fences; null where it does not parse."""
    from quire.functions.text import strip_code_fence

    return F.from_json(strip_code_fence(response), schema)
