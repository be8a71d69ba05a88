"""Declarative workflows compiled to one lazy plan.

A workflow is {"nodes": [{"component_id", "type", "parameters"}], "edges": [{"source", "target"}]}, as
in a JSON file. Every component is a function from a frame of queries to a frame of queries, one row
per query, keyed by query_id; compiling composes them, running is one action for all queries. Each
node writes its outputs into columns "<component_id>.<name>" as <component_id>__<name>.

Templates are column references {component.name} and text, or expressions of allowed functions:
nothing is evaluated in Python.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marram.functions.ranking import top_k
from marram.functions.text import collapse, documents_in, first_or, history_block, query_list, strip, yes_no
from marram.operators.keywords import requested, statistics, without_near_repeats
from marram.operators.rank import distinct_strings
from marram.plans.scratch import stored
from marram.sources.providers import answers

MAX_STEPS = 100
_SLOT = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)*)\}")
#: Functions that expressions may call. Fixed values.
ALLOWED = {"lower", "upper", "trim", "length", "size", "coalesce", "concat", "concat_ws", "substring", "abs", "round", "greatest", "least", "contains", "startswith", "endswith", "array_contains", "element_at", "if", "nullif", "isnull", "isnotnull"}
_CALL = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\s*\(")
_STRING = re.compile(r"'(?:[^'\\]|\\.)*'")


class WorkflowError(ValueError):
    """A workflow that can't be compiled."""


def slot(name: str) -> str:
    """Column of a reference: plain names stay, item.x is a field of a list's item, others are component outputs."""
    head, *rest = name.split(".")
    return name if not rest or head == "item" else "__".join([head, *rest])


def template(text: str) -> Column:
    """Text with {references} as a column."""
    parts, at = [], 0
    for m in _SLOT.finditer(text):
        parts += [F.lit(text[at : m.start()]), F.coalesce(F.col(slot(m[1])).cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def expression(text: str) -> Column:
    """A SQL expression over {references} that calls allowed functions only."""
    plain = _STRING.sub("''", text)
    calls = {c.lower() for c in _CALL.findall(plain)} - {"and", "or", "not", "in", "case", "when", "then", "else"}
    if not calls <= ALLOWED or re.search(r"\b(select|from|java_method|reflect)\b|;|--|/\*", plain, re.I):
        raise WorkflowError(f"not allowed in an expression: {sorted(calls - ALLOWED) or text}")
    return F.expr(_SLOT.sub(lambda m: "`" + slot(m[1]).replace(".", "`.`") + "`", text))


Component = Callable[["Node", DataFrame, "Context"], DataFrame]
_registry: dict[str, Component] = {}


def component(kind: str) -> Callable[[Component], Component]:
    """Register a component under "family" or "family/variant" (C2)."""

    def register(f: Component) -> Component:
        _registry[kind] = f
        return f

    return register


def registered() -> list[str]:
    return sorted(_registry)


@dataclass
class Node:
    component_id: str
    type: str
    parameters: dict = field(default_factory=dict)

    def out(self, name: str) -> str:
        return f"{self.component_id}__{name}"


@dataclass
class Context:
    """What components may use: tables by name and providers by name."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    providers: dict[str, Callable] = field(default_factory=dict)
    trace: list[str] = field(default_factory=list)
    #: Columns that each component added.
    changes: dict[str, list[str]] = field(default_factory=dict)
    #: With ``measure`` each component's rows are stored when it has run, and its seconds kept (C11).
    measure: bool = False
    seconds: dict[str, float] = field(default_factory=dict)
    #: With ``observe`` each component's rows, and the non-null values of what it added, are counted while the whole plan runs.
    observe: bool = False
    observed: dict[str, Observation] = field(default_factory=dict)
    #: With ``compare`` the differences that each component makes, by query and column, as lazy frames.
    compare: bool = False
    differences: dict[str, DataFrame] = field(default_factory=dict)
    #: Whether a provider was asked: its answers may vary, so what follows must not ask again.
    asked: bool = False

    def provider(self, name: str) -> Callable:
        self.asked = True
        return self.providers[name]


class Workflow:
    """A compiled workflow."""

    def __init__(self, config: dict) -> None:
        self.nodes = {n["component_id"]: Node(n["component_id"], n["type"], n.get("parameters") or {}) for n in config["nodes"]}
        self.next: dict[str, str] = {}
        self.branches: dict[str, list[str]] = {}
        for edge in config["edges"]:
            if edge["source"] not in self.nodes or edge["target"] not in self.nodes:
                raise WorkflowError(f"edge {edge} names an unknown node")
            if self.nodes[edge["source"]].type == "end":
                continue  # an end has no successor
            if self.nodes[edge["source"]].type == "decider":
                self.branches.setdefault(edge["source"], []).append(edge["target"])  # the first is the default
            else:
                self.next[edge["source"]] = edge["target"]  # the last edge wins (C3)
        starts = [n for n in self.nodes.values() if n.type == "start"]
        if len(starts) != 1:
            raise WorkflowError("a workflow has one start")
        for n in self.nodes.values():
            if n.type not in ("start", "end", "decider") and n.type not in _registry:
                raise WorkflowError(f"unknown component {n.type}")
        self.start = starts[0].component_id

    def run(self, queries: DataFrame, context: Context | None = None) -> DataFrame:
        """The end's rows for all ``queries`` (query_id, text, ...), lazily."""
        return self._from(self.start, queries, context or Context(), 0)

    def _from(self, at: str, rows: DataFrame, context: Context, steps: int) -> DataFrame:
        while True:
            if steps > MAX_STEPS:
                raise WorkflowError(f"more than {MAX_STEPS} steps: the workflow loops")
            steps += 1
            node, before, earlier, began = self.nodes[at], set(rows.columns), rows, time.perf_counter()
            context.trace.append(at)
            if node.type == "start":
                rows = start(node, rows)
            elif node.type == "end":
                return end(node, rows)
            elif node.type == "decider":
                return self._decide(node, rows, context, steps)
            else:
                rows = _registry[node.type](node, rows, context)
            context.changes[at] = [c for c in rows.columns if c not in before]
            if context.compare:
                context.differences[at] = differences(earlier, rows)
            if context.observe:
                context.observed[at] = Observation(f"component {at}")
                counts = [F.count(F.col(f"`{c}`")).alias(c) for c in context.changes[at]]
                rows = rows.observe(context.observed[at], F.count(F.lit(1)).alias("rows"), *counts)
            if context.measure:
                rows = stored(rows, "component")
                context.seconds[at] = time.perf_counter() - began
            if at not in self.next:
                raise WorkflowError(f"{at} has no successor")
            at = self.next[at]

    def _decide(self, node: Node, rows: DataFrame, context: Context, steps: int) -> DataFrame:
        """Each row follows the branch of its case (C4): a branch is a filter, their ends are united. Where a
        provider was asked before, its answers are stored first: each is asked once, and no row changes its branch."""
        cases = {str(k).strip().lower(): v for k, v in node.parameters.get("cases", {}).items()}
        default = node.parameters.get("default_case")
        fallback = cases.get(str(default).strip().lower()) if default is not None else (self.branches.get(node.component_id) or [None])[0]
        keyed = rows.withColumn(node.out("case"), F.lower(F.trim(template(node.parameters["value"]))))
        if context.asked:
            keyed = stored(keyed, "decider")
        known = F.col(node.out("case")).isin(list(cases)) if cases else F.lit(False)
        ends = [self._from(target, keyed.where(F.col(node.out("case")) == case), context, steps) for case, target in cases.items()]
        if fallback is not None:
            ends.append(self._from(fallback, keyed.where(~known | F.col(node.out("case")).isNull()), context, steps))
        if not ends:
            raise WorkflowError(f"{node.component_id} has no branch")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ends)


def differences(before: DataFrame, after: DataFrame, key: str = "query_id") -> DataFrame:
    """key, column, before, after (as JSON) of every value that is another one: of columns that only one side has, and of
    rows that only one side has (column null). Equality takes null and NaN as equal to themselves, in arrays and structs too. Only keys
    and what differs are shuffled on; neither side is stored. ``key`` is once in each frame."""
    columns = sorted({*before.columns, *after.columns} - {key})
    pack = lambda df: F.struct(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).alias(c) for c in columns], F.lit(True).alias("__there"))
    a, b = before.select(F.col(key).alias("_ka"), pack(before).alias("_a")), after.select(F.col(key).alias("_kb"), pack(after).alias("_b"))
    both = a.join(b, F.col("_ka").eqNullSafe(F.col("_kb")), "full")
    shown = lambda side, c, df: F.to_json(F.struct(F.col(f"{side}.`{c}`").alias("v")), {"ignoreNullFields": "false"}) if c in df.columns else F.lit(None).cast("string")

    def changed(c: str) -> Column:
        if c in before.columns and c in after.columns and before.schema[c].dataType == after.schema[c].dataType:
            same = F.col(f"_a.`{c}`").eqNullSafe(F.col(f"_b.`{c}`"))
        else:
            same = F.lit(c not in after.columns and c not in before.columns) | (F.col(f"_a.`{c}`").isNull() & F.col(f"_b.`{c}`").isNull())
        entry = F.struct(F.lit(c).alias("column"), F.get_json_object(shown("_a", c, before), "$.v").alias("before"), F.get_json_object(shown("_b", c, after), "$.v").alias("after"))
        return F.when(F.col("_a.__there") & F.col("_b.__there") & ~same, entry)

    whole = F.when(F.col("_a.__there").isNull() | F.col("_b.__there").isNull(), F.struct(F.lit(None).cast("string").alias("column"), F.when(F.col("_a.__there"), "row").alias("before"), F.when(F.col("_b.__there"), "row").alias("after")))
    found = F.array_compact(F.array(whole, *[changed(c) for c in columns]))
    return both.select(F.coalesce("_ka", "_kb").alias(key), F.explode(found).alias("d")).select(key, "d.*")


def start(node: Node, rows: DataFrame) -> DataFrame:
    """The query as the start's output, white space collapsed."""
    return rows.withColumn(node.out("query"), strip(F.regexp_replace("text", r"\s+", " ")))


def end(node: Node, rows: DataFrame) -> DataFrame:
    """query_id and the response, and with it the items, that the end's parameters name."""
    columns = [F.col("query_id"), (template(node.parameters["response"]) if "response" in node.parameters else F.lit(None).cast("string")).alias("response")]
    if "items" in node.parameters:
        columns.append(F.col(slot(node.parameters["items"].strip("{}"))).alias("items"))
    return rows.select(*columns)


@component("decision/expression")
def decide_expression(node: Node, rows: DataFrame, context: Context) -> DataFrame:
    """True or false label of an expression."""
    yes, no = node.parameters.get("labels", ["true", "false"])
    return rows.withColumn(node.out("label"), F.when(expression(node.parameters["expression"]), yes).otherwise(no))


@component("transform/template")
def apply_template(node: Node, rows: DataFrame, context: Context) -> DataFrame:
    return rows.withColumn(node.out("query"), template(node.parameters["template"]))


@component("transform/provider")
def ask_provider(node: Node, rows: DataFrame, context: Context) -> DataFrame:
    """A provider's answer to a prompt, and the queries in it (C12): rewriting, decomposition, HyDE."""
    ask = context.provider(node.parameters["provider"])
    out = rows.withColumn(node.out("answer"), answers(ask, template(node.parameters["prompt"])))
    most = node.parameters.get("max_queries")
    found = query_list(F.col(node.out("answer")))
    found = F.slice(found, 1, most) if most else found
    return out.withColumn(node.out("queries"), found).withColumn(node.out("query"), first_or(F.col(node.out("queries")), F.col("text")))


@component("decision/provider")
def ask_yes_no(node: Node, rows: DataFrame, context: Context) -> DataFrame:
    """Scope gate: a provider's yes or no (P29); neither counts as the default."""
    ask = context.provider(node.parameters["provider"])
    return rows.withColumn(node.out("label"), F.coalesce(yes_no(answers(ask, template(node.parameters["prompt"]))), F.lit(bool(node.parameters.get("default", True)))).cast("string"))


@component("transform/context")
def merge_context(node: Node, rows: DataFrame, context: Context) -> DataFrame:
    """The query after its last turns (column history: array<struct<role,text>>)."""
    last = int(node.parameters.get("turns", 3))
    turns = F.when(F.size("history") > last, F.slice("history", -last, last)).otherwise(F.col("history"))
    block = history_block(F.coalesce(turns, F.expr("cast(array() as array<struct<role:string,text:string>>)")))
    return rows.withColumn(node.out("query"), F.when(block != "", F.concat(block, F.lit("\n"), F.col("text"))).otherwise(F.col("text")))


@component("retrieve/table")
def retrieve(node: Node, rows: DataFrame, context: Context) -> DataFrame:
    """Hits of a search table (query_id, reference_id, score, rank) as an array, best first."""
    hits = context.tables[node.parameters["table"]]
    limit = int(node.parameters.get("limit", 5))
    lists = hits.where(F.col("rank") <= limit).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("reference_id").alias("id"), "score"))).alias(node.out("items")))
    return rows.join(lists, "query_id", "left")


@component("list/map")
def map_items(node: Node, rows: DataFrame, context: Context) -> DataFrame:
    """A child component over the items of a list, all at once (C6): items are exploded, the child
    runs on one frame, its output column is gathered in item order."""
    items, child = slot(node.parameters["items"].strip("{}")), node.parameters["child"]
    inner = Node(f"{node.component_id}_child", child["type"], child.get("parameters") or {})
    kept = rows.columns
    each = rows.select(*[F.col(f"`{c}`") for c in kept], F.posexplode_outer(F.col(items)).alias("_i", "item"))
    done = _registry[inner.type](inner, each, context)
    output = inner.out(node.parameters.get("output", "query"))
    gathered = done.where("_i is not null").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", F.col(output).alias("v")))), lambda x: x["v"]).alias(node.out("results")))
    return rows.join(gathered, "query_id", "left")


@component("transform/augment")
def augment(node: Node, rows: DataFrame, context: Context) -> DataFrame:
    """Queries in a provider's answer, before them the original one where ``include_original`` says so, each once
    whatever its case, at most ``max_queries``; without any the original one (C12)."""
    ask = context.provider(node.parameters["provider"])
    out = rows.withColumn(node.out("answer"), answers(ask, template(node.parameters["prompt"])))
    found = F.transform(query_list(F.col(node.out("answer"))), collapse)
    if node.parameters.get("include_original", True):
        found = F.concat(F.array(collapse(F.col("text"))), found)
    once = distinct_strings(found) if node.parameters.get("ignore_case", True) else F.array_distinct(F.filter(found, lambda q: q != ""))
    kept = F.slice(once, 1, int(node.parameters.get("max_queries", 5)))
    return out.withColumn(node.out("queries"), F.when(F.size(kept) > 0, kept).otherwise(F.array("text"))).withColumn(node.out("query"), F.get(node.out("queries"), F.lit(0)))


@component("transform/hyde")
def hypothetical(node: Node, rows: DataFrame, context: Context) -> DataFrame:
    """<document> texts of a provider's answer that are long enough and not too like one before them."""
    ask = context.provider(node.parameters["provider"])
    out = rows.withColumn(node.out("answer"), answers(ask, template(node.parameters["prompt"])))
    least, limit = int(node.parameters.get("min_chars", 20)), float(node.parameters.get("max_similarity", 0.9))
    texts = F.filter(F.transform(documents_in(F.col(node.out("answer"))), strip), lambda d: F.length(d) >= least)
    kept = without_near_repeats(texts, F.lit(limit))
    return out.withColumn(node.out("queries"), kept).withColumn(node.out("query"), first_or(F.col(node.out("queries")), F.col("text")))


@component("transform/keywords")
def keyword_queries(node: Node, rows: DataFrame, context: Context) -> DataFrame:
    """Keywords of the query and, where a table ``terminology`` (keyword, synonyms) is there, their synonyms."""
    n, most = int(node.parameters.get("max_n_gram_size", 3)), node.parameters.get("max_keywords")
    stop = frozenset(node.parameters.get("stop", ()))

    @F.pandas_udf("array<string>")
    def phrases(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [p for p, _ in statistics(t or "", n, requested(None, most), stop=stop)])

    out = rows.withColumn(node.out("keywords"), phrases(F.col("text")))
    found = F.col(node.out("keywords"))
    if "terminology" in context.tables:
        each = out.select("query_id", F.posexplode(node.out("keywords")).alias("i", "keyword")).join(context.tables["terminology"], "keyword", "left")
        terms = F.concat(F.array("keyword"), F.coalesce("synonyms", F.array().cast("array<string>")))
        lists = each.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", terms.alias("t")))).alias("_lists"))
        out, found = out.join(lists, "query_id", "left"), F.coalesce(distinct_strings(F.flatten(F.transform("_lists", lambda x: x["t"]))), F.array().cast("array<string>"))
    out = out.withColumn(node.out("queries"), found).drop("_lists")
    return out.withColumn(node.out("query"), F.coalesce(F.nullif(F.array_join(node.out("queries"), " "), F.lit("")), F.col("text")))


@component("expand/edges")
def expand_items(node: Node, rows: DataFrame, context: Context) -> DataFrame:
    """Items and, after them, what edges (src, dst, score) of a table lead to from them, best first, each id once."""
    items, limit = slot(node.parameters["items"].strip("{}")), int(node.parameters.get("limit", 10))
    edges = context.tables[node.parameters["table"]]
    near = rows.select("query_id", F.explode(F.col(items)["id"]).alias("src")).join(edges, "src").groupBy("query_id", "dst").agg(F.max("score").alias("score"))
    own = rows.select("query_id", F.explode(F.col(items)["id"]).alias("dst"))
    best = top_k(near.join(own, ["query_id", "dst"], "left_anti"), limit, [F.desc("score"), F.col("dst")], ["query_id"])
    lists = best.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]).alias("_near"))
    none = F.array().cast(f"array<{edges.schema['dst'].dataType.simpleString()}>")
    ids = F.concat(F.coalesce(F.col(items)["id"], none), F.coalesce("_near", none))
    return rows.join(lists, "query_id", "left").withColumn(node.out("ids"), ids).drop("_near")


@component("filter/score")
def filter_items(node: Node, rows: DataFrame, context: Context) -> DataFrame:
    """Items with at least a score (null passes), at most ``top``, in their order."""
    items, least = F.col(slot(node.parameters["items"].strip("{}"))), node.parameters.get("minimum")
    kept = items if least is None else F.filter(items, lambda x: x["score"].isNull() | (x["score"] >= float(least)))
    return rows.withColumn(node.out("items"), F.slice(kept, 1, int(node.parameters["top"])) if node.parameters.get("top") else kept)


@component("generate/provider")
def generate(node: Node, rows: DataFrame, context: Context) -> DataFrame:
    """A provider's response to a prompt, under settings of which later ones win (C14)."""
    ask, settings = context.provider(node.parameters["provider"]), with_settings(node.parameters.get("defaults", {}), node.parameters.get("settings"))
    return rows.withColumn(node.out("response"), answers(ask, template(node.parameters["prompt"]), **settings))


@component("merge/items")
def merge_items(node: Node, rows: DataFrame, context: Context) -> DataFrame:
    """Several lists of items as one, each id once, at most ``limit``."""
    lists = [F.coalesce(F.col(slot(i.strip("{}"))), F.slice(F.col(slot(i.strip("{}"))), 1, 0)) for i in node.parameters["inputs"]]
    flat = F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))
    if node.parameters.get("deduplicate", True):
        flat = F.aggregate(flat, F.slice(flat, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: y["id"] == x["id"]), acc).otherwise(F.concat(acc, F.array(x))))
    if node.parameters.get("limit"):
        flat = F.slice(flat, 1, int(node.parameters["limit"]))
    return rows.withColumn(node.out("items"), flat)


def with_settings(base: dict, *partial: dict | None) -> dict:
    """Settings with later ones over earlier ones, None leaving them (C14)."""
    out = dict(base)
    for p in partial:
        out |= {k: v for k, v in (p or {}).items() if v is not None}
    return out
