"""Text functions on columns. White space is what ``\\s`` of Java's UNICODE_CHARACTER_CLASS-free
regexes matches (ASCII); words are runs of letters, digits and underscores of any script."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that have to match what the exchanged texts hold.
DASHES = r"[\x{2010}-\x{2015}\-_/]"
OTHER_THAN_METRIC = "[^0-9A-Za-zÄÖÜäöüß]+"
QUERY_TAG = r"(?is)<query>\s*(.*?)\s*</query>"
DOCUMENT_TAG = r"(?is)<document>\s*(.*?)\s*</document>"
BULLET = r"^\s*(?:[-*\x{2022}]+|[0-9]+[.)])\s*"
DECISION = r"(?i)\b(yes|no|ja|nein|true|false)\b"
FENCE = r"(?s)```(?:json)?\s*(.*?)```"
SENTENCE = r"(?dm)([^.!?]+(?:[.!?]+(?=\s|$)|$))"
PARAGRAPH_END = r"(?:\r?\n){2,}"


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(x, r"\s+", " "))


def empty_as_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def keyword_key(x: Column) -> Column:
    """Lower case, white space collapsed."""
    return collapse(F.lower(x))


def dash_key(x: Column) -> Column:
    """Lower case; dashes, underscores and slashes as spaces, trailing full stops gone."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), DASHES, " "), r"\.+$", "")


def term_key(x: Column) -> Column:
    """As dash_key, white space collapsed (P10)."""
    return collapse(F.regexp_replace(F.lower(x), DASHES, " "))


def metric_text(x: Column) -> Column:
    """Lower case, digits and German letters only, single spaces."""
    return strip(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), OTHER_THAN_METRIC, " "))


def metric_tokens(x: Column) -> Column:
    """Words of a metric text."""
    return F.filter(F.split(x, " "), lambda t: t != "")


def unit_count(x: Column) -> Column:
    """Characters other than white space."""
    return F.length(F.regexp_replace(x, r"\s", "")).cast("long")


def query_tokens(x: Column, least: int = 3) -> Column:
    """Distinct lower-case words of at least ``least`` characters, in order."""
    return F.array_distinct(all_tokens(x, least))


def all_tokens(x: Column, least: int = 1) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) >= least)


def word_count(x: Column) -> Column:
    """How many words all_tokens() gives."""
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"))


def shorten(x: Column, n: int) -> Column:
    """At most n characters, cut ones ending in an ellipsis; n <= 0 cuts nothing."""
    if n <= 0:
        return x
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, max(0, n - 3)), r"\s+$", ""), F.lit("...")))


def similarity_text(path: Column, content: Column, most: int = 4000) -> Column:
    """Heading path, blank line, content, cut to ``most`` characters."""
    return F.substring(F.concat_ws("\n\n", empty_as_null(path), empty_as_null(content)), 1, most)


def page_hint(x: Column) -> Column:
    """int(float(x)), or null."""
    return x.try_cast("double").try_cast("int")


def one_of(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def json_array(x: Column, schema: str) -> Column:
    """The array that a model's answer holds: inside a code fence, else from the first [ to the last ],
    else under one of the known keys of an object (P26)."""
    fenced = F.regexp_extract(x, FENCE, 1)
    body = F.when(fenced != "", fenced).otherwise(x)
    span = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
    found = F.from_json(F.when(span != "", span), schema)
    for key in ("items", "decisions", "results", "references"):
        found = F.coalesce(found, F.from_json(F.get_json_object(body, f"$.{key}"), schema))
    return found


def query_list(x: Column) -> Column:
    """Queries in a model's answer: a JSON array, <query> tags, or lines without bullets."""
    array = F.from_json(F.regexp_extract(x, r"(?s)(\[.*\])", 1), "array<string>")
    tags = F.regexp_extract_all(x, F.lit(QUERY_TAG), F.lit(1))
    lines = F.transform(F.split(x, r"\n"), lambda line: strip(F.regexp_replace(line, BULLET, "")))
    found = F.when(F.size(array) > 0, array).when(F.size(tags) > 0, tags).otherwise(lines)
    return F.filter(F.transform(found, strip), lambda q: q != "")


def documents_in(x: Column) -> Column:
    """Contents of <document> tags."""
    return F.regexp_extract_all(x, F.lit(DOCUMENT_TAG), F.lit(1))


def yes_no(x: Column) -> Column:
    """true, false or null from a model's yes or no."""
    word = F.lower(F.regexp_extract(x, DECISION, 1))
    return F.when(word.isin("yes", "ja", "true"), F.lit(True)).when(word.isin("no", "nein", "false"), F.lit(False))


def first_or(queries: Column, fallback: Column) -> Column:
    """The first query, or the fallback."""
    return F.coalesce(F.get(queries, F.lit(0)), fallback)


def history_block(turns: Column) -> Column:
    """<turn> elements of array<struct<role,text>>."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit('<turn role="'), t["role"], F.lit('">'), t["text"], F.lit("</turn>"))), "\n")


def previous_answer(output: Column, trace: Column) -> Column:
    """A turn's output, white space collapsed; where it is blank, the last response of an end in its
    trace, array<struct<component,response>> (P16)."""
    ends = F.filter(trace, lambda t: t["component"].startswith("end") & (F.coalesce(collapse(t["response"]), F.lit("")) != ""))
    return F.coalesce(empty_as_null(collapse(output)), collapse(F.try_element_at(ends, F.lit(-1))["response"]))


def page_label(pages: Column) -> Column:
    """Distinct pages, ascending, comma-separated."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(pages)), lambda p: p.cast("string")), ", ")


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def backed_ratio(backed: Column, overall: Column) -> Column:
    """Share of backed statements; null where there are none."""
    return F.when(overall > 0, F.coalesce(backed, F.lit(0)) / overall)


def boxes_json(x: Column) -> Column:
    """array<struct<page,positions>> from a JSON array or one object (P25); others null."""
    wrapped = F.when(F.ltrim(x).startswith("{"), F.concat(F.lit("["), x, F.lit("]"))).otherwise(x)
    boxes = F.from_json(wrapped, "array<struct<page:int,positions:array<double>>>")
    return F.when(F.forall(boxes, lambda b: (b["page"] >= 1) & (F.size(b["positions"]) == 4)), boxes)


def sentences(x: Column) -> Column:
    """Runs of characters up to . ! or ? before white space or a line's end; a run that an inner mark
    breaks off is lost, as the pattern asks for its end (X2)."""
    found = F.filter(F.transform(F.regexp_extract_all(x, F.lit(SENTENCE), F.lit(1)), strip), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(F.filter(F.array(strip(x)), lambda s: s != ""))


def paragraphs(x: Column) -> Column:
    """Pieces between two or more line ends."""
    return F.filter(F.transform(F.split(x, PARAGRAPH_END), strip), lambda p: p != "")
