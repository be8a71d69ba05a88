from __future__ import annotations

import math

import pytest

from marram.operators import catalog
from marram.plans.workflow import Context, Workflow, component, differences
from marram.sources.providers import asked, batched

ASKING = {
    "nodes": [
        {"component_id": "s", "type": "start"},
        {"component_id": "a", "type": "transform/provider", "parameters": {"provider": "model", "prompt": "q: {s.query}"}},
        {"component_id": "g", "type": "generate/provider", "parameters": {"provider": "model", "prompt": "{a.query}", "settings": {"tail": "!"}}},
        {"component_id": "e", "type": "end", "parameters": {"response": "{g.response}"}},
    ],
    "edges": [{"source": "s", "target": "a"}, {"source": "a", "target": "g"}, {"source": "g", "target": "e"}],
}


def test_a_batched_provider_sees_lists():
    calls = []

    @batched
    def model(prompts, tail=""):
        calls.append(len(prompts))
        return [p.upper() + tail for p in prompts]

    assert asked(model, ["a", "b", "c"], {"tail": "!"}, most=2) == ["A!", "B!", "C!"] and calls == [2, 1]
    assert asked(str.upper, ["a", "b"]) == ["A", "B"] and asked(model, []) == []
    with pytest.raises(ValueError, match="1 answers to 2"):
        asked(batched(lambda prompts: prompts[:1]), ["a", "b"])


def test_workflows_ask_batched_providers(spark):
    @batched
    def model(prompts, tail=""):
        assert isinstance(prompts, list)
        return [f'["{p} {len(p)}"]' + tail for p in prompts]

    queries = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "query_id long, text string")
    single = Workflow(ASKING).run(queries, Context(providers={"model": lambda p, tail="": f'["{p} {len(p)}"]' + tail})).collect()
    assert sorted(Workflow(ASKING).run(queries, Context(providers={"model": model})).collect()) == sorted(single)


def test_embedding_goes_on_after_a_failed_batch(spark):
    @batched
    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("no bad texts")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, "de")], "id long, content string").coalesce(1)
    assert {r.id: (r.vector, r.error) for r in catalog.embedded(rows, embed).collect()} == {1: ([3.0], None), 2: (None, "no bad texts"), 3: ([2.0], None)}
    with pytest.raises(Exception, match="no bad texts"):
        catalog.embedded(rows, embed, go_on=False).collect()


def test_differences_by_value(spark):
    schema = "query_id long, x double, l array<double>, t string"
    a = spark.createDataFrame([(1, math.nan, [math.nan, 1.0], "same"), (2, 1.0, None, None), (3, 0.0, [], "gone"), (None, 1.0, [], "n")], schema)
    b = spark.createDataFrame([(1, math.nan, [math.nan, 1.0], "same"), (2, math.nan, [2.0], None), (4, 0.0, [], "new"), (None, 1.0, [], "m")], schema).selectExpr("*", "case when query_id = 2 then 'v' end as extra")
    got = sorted((str(r.query_id), str(r.column), r.before, r.after) for r in differences(a, b).collect())
    assert got == [("2", "extra", None, "v"), ("2", "l", None, "[2.0]"), ("2", "x", "1.0", "NaN"), ("3", "None", "row", None), ("4", "None", None, "row"), ("None", "t", "n", "m")]


def test_each_component_is_traced_without_storing(spark):
    @component("test/shorten")
    def shorten(node, rows, context):
        from pyspark.sql import functions as F

        return rows.withColumn("text", F.when(F.col("query_id") % 2 == 0, F.substring("text", 1, 3)).otherwise(F.col("text"))).where("query_id <> 5")

    config = {
        "nodes": [{"component_id": "s", "type": "start"}, {"component_id": "c", "type": "test/shorten"}, {"component_id": "t", "type": "transform/template", "parameters": {"template": "{text}?"}}, {"component_id": "e", "type": "end", "parameters": {"response": "{t.query}"}}],
        "edges": [{"source": "s", "target": "c"}, {"source": "c", "target": "t"}, {"source": "t", "target": "e"}],
    }
    context = Context(observe=True, compare=True)
    queries = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "query_id long, text string")
    assert len(Workflow(config).run(queries, context).collect()) == 5
    assert context.observed["s"].get == {"rows": 6, "s__query": 6} and context.observed["t"].get == {"rows": 5, "t__query": 5}
    changed = sorted((r.query_id, str(r.column), r.after) for r in context.differences["c"].collect())
    assert changed == [(0, "text", "tex"), (2, "text", "tex"), (4, "text", "tex"), (5, "None", None)]
    assert {r.column for r in context.differences["t"].collect()} == {"t__query"}
