from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marram.operators import boxes, evaluation, tables
from marram.plans.workflow import Context, Workflow, WorkflowError, expression, with_settings
from marram.sources import files, providers
from marram.streaming import sessions, worker


def test_retrieval_scores_of_equal_texts():
    assert evaluation.retrieval_scores(["abc def"], ["abc def"]) == (1.0, 1.0, 1.0)
    assert evaluation.retrieval_scores([], ["x"]) is None
    assert evaluation.retrieval_scores(["abc"], [])[1] == 0.0


def test_peel_keeps_the_text_of_its_turn():
    assert evaluation.peel(["aXb"], ["X"]) == (["X"], ["a", "b"], [])
    assert evaluation.peel(["X"], ["aXb"]) == (["X"], [], ["a", "b"])
    assert evaluation.peel(["one two"], ["two three"]) == (["two"], ["one "], [" three"])
    assert evaluation.peel(["axxb"], ["cxxd"]) == ([], ["axxb"], ["cxxd"])  # inside both: not counted
    # A second match replaces what the first left in front; both rests behind are worked on, the later one first.
    assert evaluation.peel(["aXbYc"], ["X", "Y"]) == (["X", "Y"], ["aXb", "c", "bYc"], [])
    assert evaluation.peel(["X", "Y"], ["aXbYc"]) == (["X", "Y"], [], ["a", "b", "c"])
    assert evaluation.peel(["three one"], ["one two", "nothree"]) == (["one", "three"], [" one"], [" two", "no"])
    assert evaluation.peel([" "], [" "]) == ([], [" "], [" "]) and evaluation.peel([], ["a"]) == ([], [], ["a"])


def test_retrieval_frame(spark):
    df = spark.createDataFrame([(1, ["Alpha, beta"], ["alpha beta!"]), (2, [], ["x"]), (3, None, None)], "id long, expected array<string>, actual array<string>")
    got = {r.id: (r.precision, r.f1) for r in evaluation.retrieval(df).collect()}
    assert got == {1: (1.0, 1.0), 2: (None, None), 3: (None, None)}


def test_lexical_counts_words_as_often_as_both_have_them(spark):
    df = spark.createDataFrame([(1, "a a b", "a c"), (2, "", "")], "id long, expected string, actual string")
    got = {r.id: (r.exact_match, r.token_f1, r.jaccard) for r in evaluation.lexical(df).collect()}
    assert got == {1: (0.0, 0.4, 0.333333), 2: (0.0, 0.0, 0.0)}


def test_claims(spark):
    tasks = spark.createDataFrame([(1, "open", None, None), (2, "open", "u1", None), (3, "claimed", None, "u9")], "task_id long, status string, assigned_to string, claimed_by string")
    claims = spark.createDataFrame([(1, "u2", 5), (1, "u1", 4), (2, "u2", 1), (3, "u2", 1)], "task_id long, user_id string, ts int")
    assert {r.task_id: (r.status, r.claimed_by) for r in evaluation.claim(tasks, claims).collect()} == {1: ("claimed", "u1"), 2: ("open", None), 3: ("claimed", "u9")}


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "q.csv"
    head = "Question,Question supercategory,Question subcategory,Correct Answer,Comment,Retrieval Text"
    path.write_text("﻿" + head + "\nQ1,simple,text,A,,\"one\ntwo\"\nQ1,simple,text,A,,three\n,simple,text,,,skip\nQ2,simple,text,,,\n", encoding="utf-8")
    rows = files.read_csv(spark, str(path))
    for c in files.QUESTION_COLUMNS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    got = files.questions(rows.coalesce(1).withColumn("line", F.monotonically_increasing_id()), "line").orderBy("run").collect()
    assert [(r.question, [s.retrieval_text for s in r.expected_retrieval]) for r in got] == [("Q1", ["one\ntwo", "three"]), ("Q2", [])]


def test_tables(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    changed = tables.upsert(table, spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), ["id"])
    assert {tuple(r) for r in changed.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    rest, gone = tables.delete(table, spark.createDataFrame([(2,)], "id long"), ["id"])
    assert (rest.count(), [r.id for r in gone.collect()]) == (1, [2])
    assert table.where(tables.contains("v", "A")).count() == 1 and table.where(tables.matches("v", "^[B]$")).count() == 1


def test_boxes_merge_to_a_fix_point():
    assert boxes.merged([(0, 0, 2, 2), (0, 0, 30, 10), (33, 1, 60, 11)]) == [(0, 0, 60, 11)]
    assert boxes.merged([(0, 0, 30, 10), (0, 12, 30, 22), (100, 0, 130, 10), (0, 40, 30, 50)]) == [(0, 0, 30, 22), (100, 0, 130, 10), (0, 40, 30, 50)]
    # The two outer ones belong together only once the middle one has joined the first.
    assert boxes.merged([(0, 0, 30, 10), (60, 2, 90, 12), (36, 1, 55, 11)]) == [(0, 0, 90, 12)]
    assert boxes.merged([(0, 0, 3, 100), (0, 0, 8, 40)]) == [] == boxes.merged([])


WORDS = "guideline_id string, page int, x0 double, y0 double, x1 double, y1 double, text string"


def test_texts_are_located_exactly_or_with_gaps(spark):
    line = [("Alpha", 1, 0, 0), ("be", 1, 35, 0), ("ta", 1, 70, 0), ("gamma", 1, 105, 0), ("delta", 2, 0, 0), ("Alpha", 3, 0, 0), ("FOOTNOTE", 3, 0, 15), ("beta", 3, 0, 50), ("gamma", 3, 35, 50), ("so\u00adlo", 4, 0, 0), ("solo", 4, 0, 300)]
    pdf = spark.createDataFrame([("g", page, float(x), float(y), x + 30.0, y + 10.0, w) for w, page, x, y in line] + [("h", 1, 0.0, 0.0, 30.0, 10.0, "solo")], WORDS)
    texts = [
        ("g", 1, "Alpha beta gamma delta", None, None),  # spelled by two tokens
        ("g", 2, "alpha FOOTNOTE beta", None, None),  # exact, over two lines
        ("g", 3, "alpha beta gamma", 3, 3),  # over a footnote
        ("g", 4, "missing words here", None, None),
        ("g", 5, "", None, None),
        ("g", 6, "solo", None, None),  # every occurrence
        ("g", 7, "alpha gamma", None, None),  # too short for gaps
        ("g", 8, "footnote beta", 1, 2),  # not on these pages
        ("x", 9, "solo", None, None),
        ("g", 10, None, None, None),
    ]
    df = spark.createDataFrame(texts, "guideline_id string, text_id long, text string, first_page int, last_page int")
    got = {}
    for r in boxes.locate(df, pdf).collect():
        got.setdefault(r.text_id, []).append((r.page, r.x0, r.y0, r.x1, r.y1))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(1, 0, 0, 135, 10), (2, 0, 0, 30, 10)],
        2: [(3, 0, 0, 30, 10), (3, 0, 15, 30, 25), (3, 0, 50, 30, 60)],
        3: [(3, 0, 0, 30, 10), (3, 0, 50, 65, 60)],
        6: [(4, 0, 0, 30, 10), (4, 0, 300, 30, 310)],
    }
    assert boxes.locate(df.limit(0), pdf).count() == 0


def trails_by_hand(source, query, limits):
    """From the left, word after word, each at its first place that is near enough."""

    def spelled(at, word):
        return next((end for end in range(at + 1, min(len(source), at + limits.joined) + 1) if "".join(source[at:end]) == word), None)

    found, start = [], 0
    while start < len(source):
        trail, left = [(start, spelled(start, query[0]))], limits.total_gap
        for word in query[1:] if trail[0][1] else []:
            free = trail[-1][1]
            at = next((k for k in range(free, min(len(source), free + min(limits.token_gap, left) + 1)) if spelled(k, word)), None)
            if at is None:
                break
            left -= at - free
            trail.append((at, spelled(at, word)))
        if trail[0][1] and len(trail) == len(query):
            found.append(trail)
            start = trail[-1][1]
        else:
            start += 1
    return found


def test_trails_leave_out_so_many_tokens_and_no_more():
    limits = boxes.Limits(token_gap=3, total_gap=4)
    source = "a x x b x x c a b c a x x x x b c a x b x x x c".split()
    assert trails_by_hand(source, ["a", "b", "c"], limits) == [[(0, 1), (3, 4), (6, 7)], [(7, 8), (8, 9), (9, 10)], [(17, 18), (19, 20), (23, 24)]]


def test_gaps_over_blocks_equal_following_by_hand(spark):
    import random

    rng = random.Random(8)
    limits = boxes.Limits(token_gap=4, total_gap=7)
    pool = ["a", "b", "c", "ab", "bc", "d", "e"] + [f"r{i}" for i in range(30)]
    source = {g: [rng.choice(pool) for _ in range(600)] for g in ("g", "h")}
    tokens = spark.createDataFrame([(g, p, t, p // 50, (float(p), 0.0, 1.0, 1.0)) for g, own in source.items() for p, t in enumerate(own)], "guideline_id string, pos long, token string, page int, rect struct<x0:double,y0:double,x1:double,y1:double>")
    asked, want = [], set()
    for i in range(120):
        g = rng.choice("gh")
        at = rng.randrange(0, 590)
        query = [t for t in source[g][at : at + rng.randrange(3, 10)] if rng.random() < 0.7] or ["a"]
        if rng.random() < 0.5 and len(query) > 2:
            query = query[:1] + ["".join(query[1:3])] + query[3:]
        if rng.random() < 0.3:
            query = [rng.choice("abc") for _ in range(3)]
        low, high = rng.choice([(0, 99), (2, 7)])
        asked.append((g, i, query, low, high))
        own = [(p, t) for p, t in enumerate(source[g]) if low <= p // 50 <= high]
        for trail in trails_by_hand([t for _, t in own], query, limits):
            want |= {(i, own[k][0]) for a, b in trail for k in range(a, b)}
    df = spark.createDataFrame(asked, "guideline_id string, text_id long, query array<string>, first_page int, last_page int")
    got = {(r.text_id, int(r.rect.x0)) for r in boxes.gapped_places(df, tokens, limits, block=32).collect()}
    assert got == want and len({i for i, _ in want}) > 60


def test_blocks_do_not_depend_on_the_order():
    import random

    rng = random.Random(2)
    for _ in range(40):
        rects = [(x := rng.randrange(0, 200), y := rng.randrange(0, 120), x + rng.randrange(1, 40), y + rng.randrange(1, 40)) for _ in range(rng.randrange(0, 25))]
        want = boxes.merged(rects)
        rng.shuffle(rects)
        assert boxes.merged(rects) == want
        import numpy as np

        hulls = np.array(want, dtype=float).reshape(-1, 4)
        assert not any(boxes.linked(hulls[i], hulls[j]) for i in range(len(hulls)) for j in range(i))
        assert all(any(h[0] <= r[0] and h[1] <= r[1] and h[2] >= r[2] and h[3] >= r[3] for h in want) for r in rects if boxes.meaningful(r))


BRANCH = {
    "nodes": [
        {"component_id": "s", "type": "start"},
        {"component_id": "d", "type": "decider", "parameters": {"value": "{kind}", "cases": {"True": "yes"}, "default_case": None}},
        {"component_id": "yes", "type": "end", "parameters": {"response": "Y{query_id}"}},
        {"component_id": "no", "type": "end", "parameters": {"response": "N{query_id}"}},
    ],
    "edges": [{"source": "s", "target": "d"}, {"source": "d", "target": "no"}],
}


def test_decider(spark):
    rows = spark.createDataFrame([(1, "t", "true"), (2, "t", "other"), (3, "t", None)], "query_id long, text string, kind string")
    assert {r.response for r in Workflow(BRANCH).run(rows).collect()} == {"Y1", "N2", "N3"}


def test_loops_and_errors(spark):
    rows = spark.createDataFrame([(1, "t")], "query_id long, text string")
    step = {"component_id": "a", "type": "transform/template", "parameters": {"template": "x"}}
    loop = {"nodes": [{"component_id": "s", "type": "start"}, step], "edges": [{"source": "s", "target": "a"}, {"source": "a", "target": "a"}]}
    with pytest.raises(WorkflowError):
        Workflow(loop).run(rows)
    with pytest.raises(WorkflowError):
        Workflow({"nodes": [step], "edges": []})
    with pytest.raises(WorkflowError):
        expression("java_method('x', 'y')")
    with pytest.raises(WorkflowError):
        expression("(select 1)")


def test_providers_in_a_workflow(spark):
    config = {
        "nodes": [
            {"component_id": "s", "type": "start"},
            {"component_id": "m", "type": "transform/context", "parameters": {"turns": 1}},
            {"component_id": "aug", "type": "transform/provider", "parameters": {"provider": "split", "prompt": "{text}", "max_queries": 2}},
            {"component_id": "gate", "type": "decision/provider", "parameters": {"provider": "yes", "prompt": "{aug.query}"}},
            {"component_id": "merge", "type": "merge/items", "parameters": {"inputs": ["{i1}", "{i2}"], "limit": 2}},
            {"component_id": "e", "type": "end", "parameters": {"response": "{aug.query}|{gate.label}|{m.query}", "items": "{merge.items}"}},
        ],
        "edges": [{"source": a, "target": b} for a, b in (("s", "m"), ("m", "aug"), ("aug", "gate"), ("gate", "merge"), ("merge", "e"))],
    }
    rows = spark.createDataFrame([(1, "a and b", [("user", "old"), ("assistant", "was")], [("x",)], [("x",), ("y",), ("z",)])], "query_id long, text string, history array<struct<role:string,text:string>>, i1 array<struct<id:string>>, i2 array<struct<id:string>>")
    out = Workflow(config).run(rows, Context(providers={"split": lambda p: "\n".join(f"- {x}" for x in p.split(" and ")), "yes": lambda p: "yes"})).first()
    assert out.response == 'a|true|<turn role="assistant">was</turn>\na and b' and [i.id for i in out["items"]] == ["x", "y"]
    assert with_settings({"t": 0.2, "n": 1}, {"t": None}, {"n": 2}) == {"t": 0.2, "n": 2}


def flow(*nodes):
    """A chain of nodes between a start and an end."""
    named = [{"component_id": "s", "type": "start"}, *nodes]
    return {"nodes": named, "edges": [{"source": a["component_id"], "target": b["component_id"]} for a, b in zip(named, named[1:], strict=False)]}


def node(name, kind, **parameters):
    return {"component_id": name, "type": kind, "parameters": parameters}


def test_hyde_documents_are_long_enough_and_unlike(spark):
    rows = spark.createDataFrame([(1, "q"), (2, "none")], "query_id long, text string")
    config = flow(node("h", "transform/hyde", provider="docs", prompt="{text}", min_chars=10, max_similarity=0.9), node("e", "end", response="{h.query}", items="{h.queries}"))
    text = "<document>A long hypothetical answer.</document><document>short</document><Document>A long hypothetical answer!</Document><document>Something quite different here</document>"
    got = {r.query_id: (r.response, r["items"]) for r in Workflow(config).run(rows, Context(providers={"docs": lambda p: text if p == "q" else ""})).collect()}
    assert got == {1: ("A long hypothetical answer.", ["A long hypothetical answer.", "Something quite different here"]), 2: ("none", [])}


def test_keyword_component_with_synonyms(spark):
    rows = spark.createDataFrame([(1, "Fracture treatment. Fracture healing."), (2, "")], "query_id long, text string")
    terms = spark.createDataFrame([("Fracture", ["break", "FRACTURE"])], "keyword string, synonyms array<string>")
    config = flow(node("k", "transform/keywords", max_n_gram_size=1), node("e", "end", response="{k.query}", items="{k.queries}"))
    got = {r.query_id: (r.response, r["items"]) for r in Workflow(config).run(rows, Context(tables={"terminology": terms})).collect()}
    assert got[2] == ("", []) and "break" in got[1][1] and sum(x.lower() == "fracture" for x in got[1][1]) == 1
    assert {x.lower() for x in got[1][1]} == {"fracture", "break", "treatment", "healing"}


def test_expansion_generation_and_trace(spark):
    rows = spark.createDataFrame([(1, "q", [("a", 1.0), ("b", 0.2), ("c", None)])], "query_id long, text string, found array<struct<id:string,score:double>>")
    edges = spark.createDataFrame([("a", "x", 0.9), ("c", "x", 0.8), ("a", "y", 0.95), ("c", "a", 1.0), ("b", "z", 1.0)], "src string, dst string, score double")
    config = flow(
        node("f", "filter/score", items="{found}", minimum=0.5),
        node("x", "expand/edges", items="{f.items}", table="edges", limit=5),
        node("g", "generate/provider", provider="say", prompt="{text}", defaults={"loud": True, "mark": "!"}, settings={"loud": None, "mark": "?"}),
        node("e", "end", response="{g.response}", items="{x.ids}"),
    )
    context = Context(tables={"edges": edges}, providers={"say": lambda p, loud, mark: (p.upper() if loud else p) + mark}, measure=True)
    out = Workflow(config).run(rows, context).first()
    assert out.response == "Q?" and list(out["items"]) == ["a", "c", "y", "x"]
    assert context.trace == ["s", "f", "x", "g", "e"] and context.changes["g"] == ["g__response"] and context.changes["x"] == ["x__ids"]
    assert set(context.seconds) == {"s", "f", "x", "g"} and all(v > 0 for v in context.seconds.values())


def test_a_provider_above_a_decider_is_asked_once(spark):
    """An answer that is another one each time: a row still takes exactly one branch, and its end has that answer."""
    import itertools

    counter = itertools.count()
    config = {
        "nodes": [node("s", "start"), node("p", "transform/augment", provider="n", prompt="{text}", include_original=False), node("d", "decider", value="{p.query}", cases={"odd": "odd"}), node("odd", "end", response="odd {p.query}"), node("other", "end", response="other {p.query}")],
        "edges": [{"source": "s", "target": "p"}, {"source": "p", "target": "d"}, {"source": "d", "target": "other"}],
    }
    rows = spark.createDataFrame([(i, "t") for i in range(40)], "query_id long, text string")
    got = Workflow(config).run(rows, Context(providers={"n": lambda p: "- odd" if next(counter) % 2 else "- even"})).collect()
    assert sorted(r.query_id for r in got) == list(range(40)) and {r.response for r in got} == {"odd odd", "other even"}


def test_submissions_that_are_refused(spark):
    tasks = spark.createDataFrame([(1, "open", None, None), (2, "completed", None, "u1"), (3, "claimed", None, "u2"), (4, "open", "u3", None)], "task_id long, status string, assigned_to string, claimed_by string")
    sent = spark.createDataFrame([(1, "u1", 5, 4, 1), (1, "u2", 6, 2, 2), (2, "u1", 1, 1, 1), (3, "u1", 1, 1, 1), (3, "u2", 2, 0, 1), (4, "u1", 1, 1, 1), (9, "u1", 1, 1, 1)], "task_id long, user_id string, ts int, fact_count_overall int, fact_count_backed int")
    done, refused = evaluation.submit(tasks, sent)
    assert {r.task_id: (r.status, r.claimed_by, r.factuality_ratio) for r in done.collect()} == {1: ("completed", "u1", 0.25), 2: ("completed", "u1", None), 3: ("completed", "u2", None), 4: ("open", None, None)}
    assert {(r.task_id, r.user_id): r.reason for r in refused.collect()} == {(1, "u2"): "completed", (2, "u1"): "completed", (3, "u1"): "claimed", (4, "u1"): "assigned"}


def test_previous_rows_and_running_sums_equal_windows(spark):
    import random

    from marram.functions.ranking import running_sum, with_previous

    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.randrange(3)) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, id int, v int")
    laid = with_previous(df, "g", ["id"], ["v"])
    got = {r.id: (r.pos, r.previous_v, r.total) for r in running_sum(laid, "g", "pos", "v", "total", block=16).collect()}
    want, last = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        n, before, total = last.get(g, (0, None, 0))
        want[i] = (n, before, total + v)
        last[g] = (n + 1, v, total + v)
    assert got == want
    marked = tables.runs(df, "g", ["id"], ["v"]).collect()
    assert len(marked) == len(rows) and all(r.run >= 1 for r in marked)


def test_a_failed_snapshot_leaves_the_old_one(spark, tmp_path):
    path = f"file://{tmp_path}/snapshot"
    files.save_snapshot(spark.range(5).toDF("id"), path)
    with pytest.raises(Exception):  # noqa: B017
        files.save_snapshot(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert spark.read.parquet(path).count() == 5
    files.save_snapshot(spark.read.parquet(path).where("id < 2"), path)  # read from while it is replaced
    assert spark.read.parquet(path).count() == 2


def test_collections_are_listed_found_and_dropped(spark):
    from marram.operators import catalog

    kept = catalog.Collection("Notes", {"content": "text", "tags": "text[]"}, {"content_vector": "cosine"})
    registry = catalog.registered(spark, [kept, catalog.Collection("Other", {}, {"v": "dot"})])
    assert sorted(r.name for r in registry.collect()) == ["Notes", "Other"] and catalog.collection(registry, "Notes") == kept
    assert catalog.collection(registry, "Notes").create(spark).columns == ["uuid", "content", "tags", "content_vector"]
    with pytest.raises(KeyError):
        catalog.collection(catalog.dropped(registry, "Notes"), "Notes")


def test_listing_and_columns(spark):
    df = spark.createDataFrame([(1, 3, "x"), (2, None, "y"), (3, 5, "z")], "id long, at int, v string")
    assert [r.id for r in tables.listing(df, "at", "id").collect()] == [3, 1, 2] and [r.id for r in tables.listing(df, "at", "id", newest_first=False, skip=1).collect()] == [3, 2]
    assert tables.columns_of(df, without=["at"]).columns == ["id", "v"]
    assert df.select(tables.capped(F.array("id", "at"), 1).alias("c")).first().c == [1]


def test_embedder(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string").select(providers.embed(F.col("t")).alias("v"))
    a, b = [r.v for r in df.collect()]
    assert sum(x * x for x in a) == pytest.approx(1.0) and sum(map(abs, b)) == 0


def test_worker(spark, tmp_path):
    runs = spark.createDataFrame([(1, "queued"), (2, "completed"), (3, "running")], "run_id long, status string")
    runs.write.parquet(f"file://{tmp_path}/in")
    worker.start(spark, f"file://{tmp_path}/in", runs.schema, lambda df, n: df.write.mode("append").parquet(f"file://{tmp_path}/out"), f"file://{tmp_path}/ck", every=None).awaitTermination()
    assert {r.run_id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {1, 3}


TURNS = "session_id string, seq int, role string, text string, ok boolean, at double"


def states_after(spark, base, parts, **options):
    """The last state of each session after a run of the stream for each part, over one checkpoint."""
    for part in parts:
        spark.createDataFrame(part, TURNS).write.mode("append").parquet(f"{base}/in")
        states = sessions.remember(spark.readStream.schema(TURNS).parquet(f"{base}/in"), **options)
        sessions.started(states, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    last = spark.read.parquet(f"{base}/out").groupBy("session_id").agg(F.max_by(F.struct("turns", "last_text", "expired"), "batch").alias("s"))
    return {r.session_id: tuple(r.s) for r in last.collect()}


def test_a_failed_turn_is_rolled_back_and_an_idle_session_begins_anew(spark, tmp_path):
    first = [("s", 1, "user", "hi", True, 0.0), ("s", 2, "assistant", "ho", True, 1.0), ("s", 3, "user", "again", True, 2.0), ("t", 1, "user", "only", True, 0.0)]
    second = [("s", 4, "assistant", "", False, 3.0), ("t", 2, "assistant", "late", True, 100.0), ("u", 1, "assistant", "", False, 0.0)]
    assert states_after(spark, f"file://{tmp_path}/a", [first, second], idle_s=50) == {"s": (2, "ho", 0), "t": (1, "late", 1), "u": (0, None, 0)}
    assert states_after(spark, f"file://{tmp_path}/b", [first + second], idle_s=50, keep=1) == {"s": (2, "ho", 0), "t": (1, "late", 1), "u": (0, None, 0)}


def test_sessions_leave_the_store_after_their_time(spark, tmp_path):
    import time

    def last_state(base, ttl_ms):
        spark.createDataFrame([("s", 1, "user", "hi", True, 0.0)], TURNS).write.mode("append").parquet(f"{base}/in")
        states = sessions.remember(spark.readStream.schema(TURNS).parquet(f"{base}/in"), ttl_ms=ttl_ms)
        query = sessions.started(states, f"{base}/out", f"{base}/checkpoint", every="1 second")
        try:
            for turns in (1, 2):
                if turns == 2:
                    spark.createDataFrame([("s", 2, "user", "there", True, 1.0)], TURNS).write.mode("append").parquet(f"{base}/in")
                until = time.time() + 60
                while time.time() < until:
                    time.sleep(2)
                    done = sum(p["numInputRows"] for p in query.recentProgress)
                    if done >= turns:
                        break
                time.sleep(3)
        finally:
            query.stop()
        rows = spark.read.parquet(f"{base}/out").where("last_text = 'there'").collect()
        return [(r.turns, r.last_text) for r in rows]

    assert last_state(f"file://{tmp_path}/long", 3_600_000) == [(2, "there")]
    assert last_state(f"file://{tmp_path}/short", 1) == [(1, "there")]


def test_collections_and_classes(spark):
    from marram.operators import catalog

    made = catalog.Collection("Refs", {"title": "text", "tags": "text[]", "n": "int"}, {"text": "cosine"})
    assert made.create(spark).columns == ["uuid", "title", "tags", "n", "text"]
    for name, properties, vectors in (("refs", {}, {"v": "dot"}), ("Refs", {"a": "nothing"}, {"v": "dot"}), ("Refs", {}, {}), ("Refs", {"v": "int"}, {"v": "dot"})):
        with pytest.raises(ValueError):
            catalog.Collection(name, properties, vectors)
    rows = spark.createDataFrame([("Simple", "recommendatoin"), ("complex", "multi-step reasoning"), ("negative", "table"), (None, "text")], "a string, b string")
    got = [r[0] for r in rows.select(catalog.classification(F.col("a"), F.col("b"))).collect()]
    assert [tuple(g) if g else None for g in got] == [("simple", "recommendation"), ("complex", "multi_step_reasoning"), None, None]
    judged = spark.createDataFrame([('ok {"similarity": 0.5, "reasoning": "r"}',), ("none",)], "x string").select(catalog.judge_score(F.col("x"))).collect()
    assert [tuple(j[0]) for j in judged] == [(0.5, "r", "ok"), (None, None, "unavailable")]


def test_chats(spark):
    from marram.operators import catalog

    chats = spark.createDataFrame([(1, "old")], "conv_id long, title string")
    assert catalog.renamed(chats, 1, "  new " + "x" * 200).first().title == ("new " + "x" * 200)[:120]
    log = spark.createDataFrame([], "conv_id long, turn int, question string, answer string")
    asked = spark.createDataFrame([(1, 0, "q"), (1, 2, "r")], "conv_id long, turn int, question string")
    out = catalog.ask(log, asked, spark.createDataFrame([(1, 0, "a")], "conv_id long, turn int, answer string"))
    assert {(r.turn, r.answer) for r in out.collect()} == {(0, "a"), (2, None)}
    nodes = spark.createDataFrame([("g", 1), ("h", 2)], "graph_name string, id long")
    assert catalog.without_graph(nodes, "g").count() == 1
