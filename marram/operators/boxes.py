"""Bounding boxes on pages: text search over words, merging of rectangles.

Words come as a table pdf_words (guideline_id, page, x0, y0, x1, y1, text); no PDF is opened here.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions.ranking import positions
from marram.plans.scratch import stored

Rect = tuple[float, float, float, float]


@dataclass(frozen=True)
class Limits:
    """Tolerances in PDF points, and token limits. Fixed values."""

    min_width: float = 5.0
    min_area: float = 80.0
    thin_width: float = 10.0
    thin_height: float = 30.0
    same_line: float = 3.0
    line_gap: float = 8.0
    column: float = 2.0
    block_gap: float = 4.0
    block_overlap: float = 2.0
    min_tokens: int = 3
    token_gap: int = 250
    total_gap: int = 500
    joined: int = 3


LIMITS = Limits()
#: Sides of a rectangle; boxes of a page from which it is merged by itself.
SIDES, CROWDED = ("x0", "y0", "x1", "y1"), 64


def meaningful(rect: Rect, limits: Limits = LIMITS) -> bool:
    """Wide enough, large enough, and not a thin upright sliver."""
    width, height = rect[2] - rect[0], rect[3] - rect[1]
    return width >= limits.min_width and width * height >= limits.min_area and not (width <= limits.thin_width and height >= limits.thin_height)


def meaningful_column(x0: Column, y0: Column, x1: Column, y1: Column, limits: Limits = LIMITS) -> Column:
    width, height = x1 - x0, y1 - y0
    return (width >= limits.min_width) & (width * height >= limits.min_area) & ~((width <= limits.thin_width) & (height >= limits.thin_height))


def linked(a: np.ndarray, b: np.ndarray, limits: Limits = LIMITS) -> np.ndarray:
    """Whether boxes (x0, y0, x1, y1 in the last axis) of ``a`` and ``b`` are parts of one block: boxes that meet when both
    sides may be some points apart, on a line (middles level), or stacked (over each other, or with even edges)."""

    def meet(axis: int, reach: float) -> np.ndarray:
        return (a[..., axis] <= b[..., axis + 2] + reach) & (b[..., axis] <= a[..., axis + 2] + reach)

    level = np.abs((a[..., 1] + a[..., 3]) - (b[..., 1] + b[..., 3])) / 2 <= limits.same_line
    even = (np.abs(a - b)[..., [0, 2]] <= limits.column).all(axis=-1)
    line = level & meet(1, limits.same_line) & meet(0, limits.line_gap)
    return line | (meet(1, limits.block_gap) & (meet(0, limits.block_overlap) | even))


def _components(boxes: np.ndarray, limits: Limits) -> np.ndarray:
    """For each box (sorted by y0) the first of those that links join it to. A box only meets such earlier ones as reach down to it."""
    root = np.arange(len(boxes))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    open_ = np.zeros(0, dtype=np.int64)
    reach = max(limits.same_line, limits.block_gap)
    for i, box in enumerate(boxes):
        open_ = open_[boxes[open_, 3] + reach >= box[1]]
        for j in open_[linked(boxes[open_], box, limits)].tolist():
            low, high = sorted((top(i), top(j)))
            root[high] = low
        open_ = np.append(open_, i)
    return np.array([top(i) for i in range(len(boxes))], dtype=np.int64)


def merged(rects: list[Rect], limits: Limits = LIMITS) -> list[tuple[int, int, int, int]]:
    """Blocks of the meaningful ones of ``rects``, rounded, top to bottom (X12): what links join is replaced by its hull, until
    no two hulls are linked. The order of the rectangles plays no part."""
    boxes = np.array(sorted({tuple(map(float, r)) for r in rects if meaningful(r, limits)}, key=itemgetter(1, 0, 3, 2)), dtype=np.float64).reshape(-1, 4)
    while True:
        part = np.unique(_components(boxes, limits), return_inverse=True)[1]
        n = int(part.max(initial=-1)) + 1
        if n == len(boxes):
            return [tuple(int(round(v)) for v in box) for box in boxes.tolist()]
        hulls = np.tile([np.inf, np.inf, -np.inf, -np.inf], (n, 1))
        np.minimum.at(hulls[:, :2], part, boxes[:, :2])
        np.maximum.at(hulls[:, 2:], part, boxes[:, 2:])
        boxes = hulls[np.lexsort((hulls[:, 2], hulls[:, 3], hulls[:, 0], hulls[:, 1]))]


def merged_pages(page: np.ndarray, boxes: np.ndarray, limits: Limits = LIMITS) -> tuple[np.ndarray, np.ndarray]:
    """merged() of many pages at once: page numbers (a row's of ``boxes``) and the blocks of each page, from top to bottom. Boxes of a page are compared
    at one distance in reading order after the other; a page of more than ``CROWDED`` boxes is merged by itself."""
    width, height = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    keep = (width >= limits.min_width) & (width * height >= limits.min_area) & ~((width <= limits.thin_width) & (height >= limits.thin_height))
    rows = np.unique(np.column_stack([page[keep], boxes[keep][:, [1, 0, 3, 2]]]), axis=0)
    page, boxes = rows[:, 0].astype(np.int64), rows[:, [2, 1, 4, 3]]
    crowded = np.bincount(page, minlength=1)[page] > CROWDED if len(page) else np.zeros(0, dtype=bool)
    alone = [(p, merged([tuple(b) for b in boxes[page == p].tolist()], limits)) for p in np.unique(page[crowded])]
    page, boxes = page[~crowded], boxes[~crowded]
    while True:
        first, second = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for gap in range(1, int(np.bincount(page, minlength=1).max())):
            i = np.flatnonzero(page[:-gap] == page[gap:])
            i = i[linked(boxes[i], boxes[i + gap], limits)]
            first.append(i)
            second.append(i + gap)
        i, j = np.concatenate(first), np.concatenate(second)
        if not len(i):
            break
        root = np.arange(len(page))
        while True:
            low = np.minimum(root[i], root[j])
            before = root.copy()
            for at in (i, j, before[i], before[j]):
                np.minimum.at(root, at, low)
            root = root[root]
            if (root == before).all():
                break
        heads, part = np.unique(root, return_inverse=True)
        hulls = boxes[heads].copy()
        np.minimum.at(hulls[:, :2], part, boxes[:, :2])
        np.maximum.at(hulls[:, 2:], part, boxes[:, 2:])
        page = page[heads]
        order = np.lexsort((hulls[:, 2], hulls[:, 3], hulls[:, 0], hulls[:, 1], page))
        page, boxes = page[order], hulls[order]
    pages, blocks_ = [page, *(np.full(len(b), p) for p, b in alone)], [np.rint(boxes), *(np.array(b, dtype=np.float64).reshape(-1, 4) for _, b in alone)]
    return np.concatenate(pages), np.concatenate(blocks_).astype(np.int64)


def tokens(text: Column) -> Column:
    """Words in lower case, soft hyphens gone."""
    folded = F.regexp_replace(F.lower(F.regexp_replace(text, "\u00ad", "")), "ß", "ss")
    return F.filter(F.split(folded, r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def word_tokens(words: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """words (guideline_id, page, x0, y0, x1, y1, text) as tokens with their place in the guideline's reading
    order: guideline_id, pos, token, page, rect. With ``asked`` (guideline_id), of these guidelines only: a text is looked up in its own."""
    if asked is not None:
        words = words.join(stored(asked.select("guideline_id").distinct(), "asked-guidelines"), "guideline_id", "left_semi")
    each = words.select("guideline_id", "page", F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).alias("rect"), F.posexplode(tokens(F.col("text"))).alias("nth", "token"))
    return positions(each, "guideline_id", ["page", F.col("rect.y0"), F.col("rect.x0"), F.col("rect.x1"), "nth", "token"])


def exact_places(queries: DataFrame, tokens_: DataFrame) -> DataFrame:
    """text_id and the token places of every exact occurrence of a text.

    queries: guideline_id, text_id, i, n, token (the i-th of n), first_page, last_page. A token of a query at a
    place stands for an occurrence that begins i places before; one that all n tokens stand for is there.
    The rarest token of a query says where to look, so a frequent word is looked up at a few places only.
    """
    spread_ = tokens_.groupBy("guideline_id", "token").agg(F.count(F.lit(1)).alias("df"))
    rarest = queries.join(spread_, ["guideline_id", "token"]).groupBy("guideline_id", "text_id").agg(F.min_by(F.struct("token", "i"), F.struct("df", "i")).alias("r"))
    begins = rarest.select("guideline_id", "text_id", F.col("r.token").alias("token"), F.col("r.i").alias("i")).join(tokens_.select("guideline_id", "token", "pos"), ["guideline_id", "token"])
    begins = begins.select("guideline_id", "text_id", (F.col("pos") - F.col("i")).alias("begin"))
    wanted = begins.join(queries, ["guideline_id", "text_id"]).withColumn("pos", F.col("begin") + F.col("i"))
    found = wanted.join(tokens_, ["guideline_id", "pos", "token"]).where("page between first_page and last_page")
    whole = found.groupBy("guideline_id", "text_id", "begin").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n")).where("m = n").select("guideline_id", "text_id", "begin")
    return found.join(whole, ["guideline_id", "text_id", "begin"]).select("text_id", "page", "rect").distinct()


def spelled_places(tokens_: DataFrame, wanted: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """guideline_id, word, at, to, first_page, last_page: where a word of ``wanted`` (guideline_id, word) is a token or up to ``limits.joined`` tokens
    in a row (places at to to - 1). Runs of tokens are equi joins on places."""
    run = tokens_.select("guideline_id", F.col("pos").alias("at"), (F.col("pos") + 1).alias("to"), F.col("token").alias("word"), F.col("page").alias("first_page"), F.col("page").alias("last_page"))
    found = run
    for _ in range(limits.joined - 1):
        after = tokens_.select("guideline_id", F.col("pos").alias("to"), "token", "page")
        run = run.join(after, ["guideline_id", "to"]).select("guideline_id", "at", (F.col("to") + 1).alias("to"), F.concat("word", "token").alias("word"), "first_page", F.col("page").alias("last_page"))
        found = found.unionByName(run)
    return found.join(wanted.select("guideline_id", "word").distinct(), ["guideline_id", "word"], "left_semi")


def follow(places: pd.DataFrame, limits: Limits = LIMITS) -> list[tuple[int, int, list[int], list[int]]]:
    """Trails in the places (i, at, to, n) of one text's words: from each place of its first word to the next place of each further one, where that
    leaves out no more tokens than allowed. All trails take a step together. Returns begin, end, places and their ends."""
    n = int(places["n"].iloc[0])
    by_word = {i: (g["at"].to_numpy(), g["to"].to_numpy()) for i, g in places.sort_values("at").groupby("i")}
    if len(by_word) < n:
        return []
    begins, free = by_word[0]
    slack, trail, alive = np.full(len(begins), limits.total_gap), [(begins, free)], np.arange(len(begins))
    for i in range(1, n):
        at, to = by_word[i]
        k = np.searchsorted(at, free)
        near = np.minimum(k, len(at) - 1)
        ok = (k < len(at)) & (at[near] - free <= np.minimum(limits.token_gap, slack))
        alive, near, slack = alive[ok], near[ok], slack[ok] - (at[near] - free)[ok]
        trail = [(a[ok], b[ok]) for a, b in trail] + [(at[near], to[near])]
        free = to[near]
    ats, tos = (np.stack([t[j] for t in trail], axis=1) if len(alive) else np.zeros((0, n), dtype=np.int64) for j in (0, 1))
    return [(int(a[0]), int(b[-1]), a.tolist(), b.tolist()) for a, b in zip(ats, tos, strict=True)]


def gapped_places(asked: DataFrame, tokens_: DataFrame, limits: Limits = LIMITS, block: int = 4096) -> DataFrame:
    """text_id, page, rect of the tokens of texts that are followed with gaps.

    asked: guideline_id, text_id, query, first_page, last_page. Anchors are the places of a text's rarest word; a trail through one lies within
    its reach, 3 tokens a word and the gaps. Of the other words only places in blocks within reach of an anchor are fetched, by equi joins on
    (guideline, block, word), and they are chained in blocks of the begins: a task holds the matched places of one text in one block
    and as far as a trail can go beyond it. Trails that share tokens with an earlier one go, from the left.
    """
    kind = {name: t for name, t in asked.dtypes}
    words = asked.select("guideline_id", "text_id", "first_page", "last_page", F.size("query").alias("n"), F.posexplode("query").alias("i", "word"))
    places = stored(spelled_places(tokens_, words, limits).withColumn("block", F.expr(f"at div {block}L")), "spelled-places")
    df = places.groupBy("guideline_id", "word").agg(F.count(F.lit(1)).alias("df"))
    rarest = words.join(df, ["guideline_id", "word"], "left").groupBy("text_id", "guideline_id", "n").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "i")).alias("word"))
    span = F.col("n") * limits.joined + limits.total_gap
    anchors = rarest.join(places.select("guideline_id", "word", "at"), ["guideline_id", "word"])
    reach = F.explode(F.sequence(F.expr(f"greatest(0L, at - span) div {block}L"), F.expr(f"(at + span) div {block}L"))).alias("block")
    near = anchors.withColumn("span", span.cast("long")).select("guideline_id", "text_id", "span", reach).distinct()

    inside = F.col("first_page").alias("p0"), F.col("last_page").alias("p1")
    each = near.join(words.select("text_id", "n", "i", "word", *inside), "text_id").join(places, ["guideline_id", "block", "word"]).where("first_page >= p0 and last_page <= p1")
    # A place serves the begins of its own block and of those before it within reach.
    serves = F.explode(F.sequence(F.expr(f"greatest(0L, at - span) div {block}L"), F.col("block"))).alias("lot")
    dealt = stored(each.select("text_id", "n", "i", "at", "to", serves), "gap-places")
    whole = dealt.groupBy("text_id", "lot").agg(F.count_distinct("i").alias("m"), F.first("n").alias("n")).where("m = n").select("text_id", "lot")

    def trails(pdf: pd.DataFrame) -> pd.DataFrame:
        begin = int(pdf["lot"].iloc[0]) * block
        found = [(pdf["text_id"].iloc[0], *t) for t in follow(pdf, limits) if begin <= t[0] < begin + block]
        return pd.DataFrame(found, columns=["text_id", "begin", "end", "at", "to"])

    found = dealt.join(whole, ["text_id", "lot"], "left_semi").groupBy("text_id", "lot").applyInPandas(trails, f"text_id {kind['text_id']}, begin long, end long, at array<long>, to array<long>")
    found = stored(found, "trails")

    def lefts(pdf: pd.DataFrame) -> pd.DataFrame:
        free, keep = -1, []
        for begin, end in pdf.sort_values("begin")[["begin", "end"]].itertuples(index=False):
            if begin >= free:
                keep.append(begin)
                free = end
        return pd.DataFrame({"text_id": [pdf["text_id"].iloc[0]] * len(keep), "begin": keep})

    # Of whole trails only begin and end meet in one task.
    first = found.select("text_id", "begin", "end").groupBy("text_id").applyInPandas(lefts, f"text_id {kind['text_id']}, begin long")
    used = found.join(first, ["text_id", "begin"]).select("text_id", F.explode(F.arrays_zip("at", "to")).alias("p")).select("text_id", F.explode(F.expr("sequence(p.at, p.to - 1)")).alias("pos"))
    used = used.join(asked.select("text_id", "guideline_id"), "text_id")
    return used.join(tokens_.select("guideline_id", "pos", "page", "rect"), ["guideline_id", "pos"]).select("text_id", "page", "rect").distinct()


def found_places(texts: DataFrame, words: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """text_id, page, rect: the words' rectangles of every exact occurrence of a text; of a text without one that has ``min_tokens`` words
    or more, those of its occurrences with gaps (X11). texts: guideline_id, text_id (each once), text, first_page, last_page."""
    asked = texts.select("guideline_id", "text_id", tokens(F.col("text")).alias("query"), F.coalesce("first_page", F.lit(0)).alias("first_page"), F.coalesce("last_page", F.lit(2**30)).alias("last_page")).where("size(query) > 0")
    asked = stored(asked, "asked")
    tokens_ = stored(word_tokens(words, asked), "word-tokens")
    queries = asked.select("guideline_id", "text_id", "first_page", "last_page", F.size("query").alias("n"), F.posexplode("query").alias("i", "token"))
    exact = stored(exact_places(queries, tokens_), "exact-places")
    rest = asked.where(F.size("query") >= limits.min_tokens).join(exact.select("text_id").distinct(), "text_id", "left_anti")
    return exact.select("text_id", "page", "rect").unionByName(gapped_places(stored(rest, "not-exact"), tokens_, limits)).distinct()


def blocks(rects: DataFrame, keys: list[str], limits: Limits = LIMITS) -> DataFrame:
    """keys, x0, y0, x1, y1: the merged blocks of the rectangles (``rect``) of each page, where ``keys`` name a page (X12). A page is what one
    task holds."""

    def run(batches):
        for batch in batches:
            lists = batch.column(len(keys))
            each = lists.flatten()
            page = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            rect = np.column_stack([each.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in SIDES])
            page, found = merged_pages(page, rect, limits)
            own = [batch.column(k).take(pa.array(page)) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(found[:, c].astype(np.int32)) for c in range(4))], [*keys, *SIDES])

    pages = rects.where("rect is not null").groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(f"rect.{c}").alias(c) for c in SIDES])).alias("rects"))
    kinds = dict(pages.dtypes)
    return pages.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} int" for c in SIDES)]))


def locate(texts: DataFrame, words: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """texts (guideline_id, text_id, text, first_page, last_page) -> text_id, page, x0, y0, x1, y1: the blocks that the places of a text
    make on each page."""
    found = found_places(texts, words, limits).select("text_id", F.col("page").cast("int").alias("page"), "rect")
    return blocks(found, ["text_id", "page"], limits)


def by_page(boxes: DataFrame, key: str) -> DataFrame:
    """Boxes of each page of each ``key``."""
    return boxes.groupBy(key, "page").agg(F.sort_array(F.collect_list(F.struct("x0", "y0", "x1", "y1"))).alias("boxes"))
