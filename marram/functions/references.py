"""Columns of references: contents, heading paths, section keys and orderings.

A hierarchy is array<struct<title, heading_level, heading_number, order>>, root first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marram.functions.text import empty_as_null, strip

TYPES = ("text", "image", "table", "recommendation", "statement", "metadata")


def _c(name: str) -> Column:
    return F.col(name)


def content() -> Column:
    """The text of a reference by its type."""
    blank = F.lit("")
    caption = F.when(F.coalesce(_c("caption"), blank) != "", F.concat(F.lit("caption: "), _c("caption"))).otherwise(blank)
    table = F.concat(caption, F.coalesce(_c("table_markdown"), blank))
    grade = F.when(F.coalesce(_c("grade"), blank) != "", F.concat(F.lit("\n("), _c("grade"), F.lit(")"))).otherwise(blank)
    titled = F.when(F.coalesce(_c("title"), blank) != "", F.concat(_c("title"), F.lit(": "))).otherwise(blank)
    return (
        F.when(_c("type") == "text", F.coalesce(_c("contained_text"), blank))
        .when(_c("type") == "image", F.concat(caption, F.coalesce(_c("describing_text"), blank)))
        .when(_c("type") == "table", F.when(table != "", table).otherwise(F.coalesce(_c("plain_text"), blank)))
        .when(_c("type") == "recommendation", F.concat(F.coalesce(_c("title"), F.lit("None")), F.lit(": "), F.coalesce(_c("content"), blank), grade))
        .when(_c("type") == "statement", F.concat(titled, F.coalesce(_c("content"), blank), grade))
        .when(_c("type") == "metadata", F.coalesce(_c("metadata_content"), blank))
    )


def ingest_content(skip_headings: bool = False) -> Column:
    """The text that is embedded, null if there is none."""
    metadata = _c("metadata_content")
    if skip_headings:
        metadata = F.when(~F.coalesce(_c("metadata_type"), F.lit("")).contains("Heading"), metadata)
    parts = (
        F.when(_c("type") == "text", _c("contained_text"))
        .when(_c("type") == "image", F.concat_ws(" ", "caption", "describing_text"))
        .when(_c("type") == "table", F.concat_ws(" ", "caption", "plain_text"))
        .when(_c("type").isin("recommendation", "statement"), F.concat_ws(" ", "title", "content"))
        .when(_c("type") == "metadata", metadata)
    )
    return empty_as_null(strip(parts))


def titles_path(h: Column, separator: str = " > ") -> Column:
    """Titles, root first, empty ones left out."""
    return F.array_join(F.filter(F.transform(h, lambda e: F.coalesce(e["title"], F.lit(""))), lambda t: t != ""), separator)


def numbered_path(h: Column, separator: str = " / ") -> Column:
    """"number title" by heading level, empty ones left out."""
    by_level = F.transform(F.array_sort(F.transform(h, lambda e: F.struct(e["heading_level"].alias("l"), e["heading_number"].alias("n"), e["title"].alias("t")))), lambda e: F.concat_ws(" ", empty_as_null(e["n"]), empty_as_null(e["t"])))
    return F.array_join(F.filter(by_level, lambda t: t != ""), separator)


def section_key(guideline: Column, h: Column) -> Column:
    """Key of a graph section: guideline and number|title|index of each level (P5)."""
    levels = F.transform(h, lambda e, i: F.concat_ws("|", F.coalesce(e["heading_number"], F.lit("")), F.coalesce(e["title"], F.lit("")), i.cast("string")))
    return F.concat_ws("::", guideline.cast("string"), F.array_join(levels, "/"))


def prefixes(h: Column) -> Column:
    """All ancestor paths of a hierarchy, root first, itself last (P5)."""
    return F.transform(h, lambda e, i: F.slice(h, F.lit(1), i + 1))


def node_id(group: Column, guideline: Column, path: Column) -> Column:
    """Id of a hierarchy node: 20 hex digits of the SHA-1 of group|guideline|level|number|title... (P5)."""
    parts = F.flatten(F.transform(path, lambda e: F.array(e["heading_level"].cast("string"), F.coalesce(e["heading_number"], F.lit("")), F.coalesce(e["title"], F.lit("")))))
    return F.substring(F.sha1(F.concat_ws("|", group.cast("string"), guideline.cast("string"), F.array_join(parts, "|"))), 1, 20)


def graph_order(h: Column, boxes: Column | None, reference: Column) -> list[Column]:
    """Orders of all levels, page, y, x, id; no box counts as 0."""
    box = F.get(boxes, F.lit(0)) if boxes is not None else None
    place = [F.coalesce(box["page"], F.lit(0)), F.coalesce(F.get(box["positions"], F.lit(1)), F.lit(0.0)), F.coalesce(F.get(box["positions"], F.lit(0)), F.lit(0.0))] if box is not None else []
    return [F.transform(h, lambda e: F.coalesce(e["order"], F.lit(0))), *place, reference]


def hierarchy_order(guideline: Column, h: Column, reference: Column) -> list[Column]:
    """Guideline, (level, order, number, title) of all levels, id."""
    return [guideline, F.transform(h, lambda e: F.struct(e["heading_level"].alias("l"), e["order"].alias("o"), F.coalesce(e["heading_number"], F.lit("")).alias("n"), F.coalesce(e["title"], F.lit("")).alias("t"))), reference]


def chunk_order(h: Column, boxes: Column, text: Column) -> list[Column]:
    """Orders, depth, page, y, x (no box last), text."""
    box, far = F.get(boxes, F.lit(0)), F.lit(1e9)
    return [F.transform(h, lambda e: F.coalesce(e["order"], F.lit(0))), F.size(h), F.coalesce(box["page"].cast("double"), far), F.coalesce(F.get(box["positions"], F.lit(1)), far), F.coalesce(F.get(box["positions"], F.lit(0)), far), text]


def resolve(path: str) -> Column:
    """A dotted path with list indices as a column."""
    first, *rest = path.split(".")
    out = F.col(first)
    for step in rest:
        out = F.get(out, F.lit(int(step))) if step.isdigit() else out[step]
    return out


def serialised(selectors: Sequence[dict], joiner: str = "\n", include_empty: bool = False) -> Column:
    """Selected properties joined: each selector has a path, and may have a label and max_chars."""
    parts = []
    for s in selectors:
        value = F.coalesce(resolve(s["path"]).cast("string"), F.lit(""))
        if s.get("max_chars"):
            value = F.substring(value, 1, s["max_chars"])
        shown = F.concat(F.lit(f"{s['label']}: "), value) if s.get("label") else value
        parts.append(shown if include_empty else F.when(value != "", shown))
    return F.concat_ws(joiner, *parts)


def listed(*columns: Column) -> Column:
    """Values and lists in one "; "-joined string, nulls left out."""
    return F.array_join(F.array_compact(F.concat(*columns)), "; ")
