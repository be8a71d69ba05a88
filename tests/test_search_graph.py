from __future__ import annotations

import random

from pyspark.sql import functions as F

from marram.functions.ranking import positions
from marram.operators import graph, hierarchy, rank, search

HIERARCHY = "array<struct<title:string,heading_level:int,heading_number:string,order:int>>"


def refs_of(spark, rows):
    """rows: (reference_id, guideline, section number, order)."""
    data = [(i, "g", gl, [("Diagnostik", 1, "2", 10), ("", 2, s, o)], o) for i, gl, s, o in rows]
    return spark.createDataFrame(data, f"reference_id long, reference_group_id string, guideline_id string, hierarchy {HIERARCHY}, ord int")


def test_positions_equal_a_window(spark):
    random.seed(5)
    rows = [("hot" if random.random() < 0.6 else random.choice("abc"), random.randrange(50), i) for i in range(800)]
    df = spark.createDataFrame(rows, "grp string, k int, id int")
    want, seen = {}, {}
    for g, _, i in sorted(rows):
        want[i] = seen.get(g, 0)
        seen[g] = want[i] + 1
    assert {r.id: r.pos for r in positions(df, "grp", ["k", "id"]).collect()} == want


def test_similarity_edges_unit_case(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = {(r.src, r.dst) for r in search.similarity_edges(df, threshold=0.7, k=1).collect()}
    assert got == {(1, 2), (2, 1)}


def test_similarity_edges_know_no_label(spark, sf):
    import numpy as np

    from marram.plans import graph_queries, search_queries
    from marram.sources.views import vectors

    rows = vectors(spark, sf).collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    scores = np.round(x @ x.T / norm[:, None] / norm[None], 6)
    np.fill_diagonal(scores, -1)
    label = {r.vec_id: r.label for r in rows}
    for run, threshold in ((search_queries.similarity_edges, 0.2), (graph_queries._similarity, 0.3)):
        want = set()
        for i, r in enumerate(rows):
            best = sorted((-scores[i, j], o.vec_id) for j, o in enumerate(rows) if scores[i, j] >= threshold)[:8]
            want |= {(r.vec_id, dst) for _, dst in best}
        got = {(r.src, r.dst) for r in run(spark, sf).collect()}
        assert got == want and any(label[a] != label[b] for a, b in got)


def test_keywords_have_six_characters(spark, sf):
    import re
    from collections import Counter

    from marram.plans import graph_queries
    from marram.sources.views import keywords

    refs = spark.createDataFrame([(1, "Short words, sixsix and sevenn_ Sixsix"), (2, None), (3, "fives only here")], "reference_id long, text string")
    assert {(r.reference_id, r.keyword) for r in keywords(refs).collect()} == {(1, "sixsix"), (1, "sevenn_")}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    words = {r.doc_id: {w for w in re.split(r"\W+", (r.text or "").lower()) if len(w) >= 6} for r in rows}
    counts = {r.kind: r.n for r in graph_queries.graph_nodes_edges_summary(spark, sf).collect()}
    assert counts["keyword_edges"] == sum(map(len, words.values())) and counts["keywords"] == len(set().union(*words.values()))
    want = Counter()
    for s in rows:
        for r in rows if s.doc_id % 50 == 0 else []:
            shared = len(words[s.doc_id] & words[r.doc_id])
            if shared >= 2 and r.doc_id != s.doc_id:
                want[s.source, s.doc_id, r.doc_id, shared, round(shared / min(len(words[s.doc_id]), len(words[r.doc_id])), 6)] += 1
    assert Counter((r.query_id, r.seed_id, r.reference_id, r.shared, r.ratio) for r in graph_queries.graph_expand_keyword(spark, sf).collect()) == want


def test_keywords_are_counted_where_they_are_read(spark):
    """A reference's links are no rows of a shuffle, but for those of references with several rows, which are counted once."""
    lists = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (2, ["b", "c"]), (2, None), (None, ["a"]), (None, ["a", "d"]), (3, []), (4, None)], "reference_id long, keywords array<string>")
    assert [df.first().n for df in graph.keyword_counts(lists)] == [4, 6]
    once = lists.where("reference_id not in (2)")
    words, links = graph.keyword_counts(once)
    assert (words.first().n, links.first().n) == (2, 2) and "Generate" not in links._jdf.queryExecution().optimizedPlan().toString()
    assert [df.first().n for df in graph.keyword_counts(lists.where("false"))] == [0, 0]


def test_a_keyword_of_a_third_of_the_references(spark, monkeypatch):
    """It comes as a row for each block of references; pairs under the threshold are never rows."""
    rng = random.Random(4)
    words = {i: {f"k{rng.randrange(2000)}" for _ in range(5)} | ({"everywhere"} if i % 3 == 0 else set()) for i in range(1500)}
    links = spark.createDataFrame([(i, w) for i, own in words.items() for w in own], "reference_id long, keyword string")
    seeds = spark.createDataFrame([(i % 7, i) for i in range(0, 1500, 50)] + [(6, 0)], "query_id long, reference_id long")
    monkeypatch.setattr(graph, "REFERENCES", 128)
    monkeypatch.setattr(graph, "SEEDS", 8)
    lists = graph.shared_lists(seeds, links).collect()
    pairs = sum(len(words[s] & words[r]) for s in range(0, 1500, 50) for r in words)
    assert len(lists) < pairs / 3 and max(len(r.refs) for r in lists) <= 128 + 60
    for least, share in ((2, 0.8), (4, 0.3)):
        want = set()
        for q, s in [(i % 7, i) for i in range(0, 1500, 50)] + [(6, 0)]:
            for r in words:
                n, ratio = len(words[s] & words[r]), len(words[s] & words[r]) / min(len(words[s]), len(words[r]))
                if r != s and (n >= least or (n >= 2 and ratio >= share)):
                    want.add((q, s, r, n, round(ratio, 6)))
        assert {tuple(r) for r in graph.keyword_pairs(seeds, links, least, share).collect()} == want and want


def test_shared_keywords_are_not_shuffled_by_pairs(spark):
    """What the comparison shuffles are the references' sets; a bound on the first rows of a query leaves no more of them."""
    rng = random.Random(6)
    words = {i: {f"k{rng.randrange(30)}" for _ in range(8)} for i in range(600)}
    links = spark.createDataFrame([(i, w) for i, own in words.items() for w in own], "reference_id long, keyword string")
    seeds = spark.createDataFrame([(i % 2, i) for i in range(0, 600, 20)], "query_id long, reference_id long")
    all_ = graph.keyword_pairs(seeds, links, 2, 0.8)
    plan = all_._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionBy") + plan.count("Repartition ") <= 1 and "Aggregate" not in plan
    rows = sorted((r.query_id, r.reference_id, r.seed_id) for r in all_.collect())
    want = [x for q in (0, 1) for x in [r for r in rows if r[0] == q][:7]]
    some = sorted((r.query_id, r.reference_id, r.seed_id) for r in graph.keyword_pairs(seeds, links, 2, 0.8, first=7).collect())
    assert len(rows) > 5000 and len(some) <= 2 * 7 * 8 and set(want) <= set(some) <= set(rows)


def test_asked_keyword_sets_go_out_in_portions(spark, monkeypatch):
    words = {i: {f"k{i % 5}", f"k{i % 3 + 9}", f"k{i % 2 + 20}"} for i in range(90)}
    links = spark.createDataFrame([(i, w) for i, own in words.items() for w in own], "reference_id long, keyword string")
    seeds = spark.createDataFrame([("a" if i % 4 else None, i) for i in range(0, 90, 10)] + [("b", 500)], "query_id string, reference_id long")
    want = {("a" if s % 4 else None, s, r, len(words[s] & words[r])) for s in range(0, 90, 10) for r in words if r != s and len(words[s] & words[r]) >= 2}
    monkeypatch.setattr(graph, "PORTION", 100)
    assert {(r.query_id, r.seed_id, r.reference_id, r.shared) for r in graph.keyword_pairs(seeds, links, 2, 0.8).collect()} == want


def test_equally_far_rows_stay_few(spark):
    """Rows that are all equally far are not handed on by the pair, whatever batches they come in."""
    import numpy as np

    from marram.operators.vectorindex import Nearest

    base = spark.range(3000).select(((F.col("id") * 7919) % 3000).alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding")).repartition(3)
    queries = spark.createDataFrame([(i, [2.0, -1.0 - i]) for i in range(40)], "query_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.distance) for r in search.vector_top(base, queries, 3, "hamming").orderBy("query_id", "rank").collect()]
    assert got == [(q, v, 2.0) for q in range(40) for v in range(3)]
    best, rng = Nearest(2, 3), np.random.default_rng(1)
    x, ids = rng.integers(0, 3, (400, 2)).astype(float), rng.permutation(400)
    for at in range(0, 400, 70):
        best.look("manhattan", np.arange(2), x[:2], x[at : at + 70], ids[at : at + 70], ids[:2])
    for i in range(2):
        want = sorted((abs(x[j] - x[i]).sum(), ids[j]) for j in range(400) if j != i)[:3]
        assert list(zip(best.distances[i], best.ids[i], strict=True)) == want
    assert len(best.found(ids[:2])) == 6


def test_edges_of_some_sources_are_rows_of_all_edges(spark, sf, monkeypatch):
    from marram.sources.views import vectors

    rows = vectors(spark, sf)
    some = rows.where("vec_id % 7 = 0").select(F.col("vec_id").alias("reference_id"))
    all_ = {tuple(r) for r in search.similarity_edges(rows, threshold=0.2, k=8).collect()}
    assert {tuple(r) for r in search.edges_of(rows, some, threshold=0.2, k=8).collect()} == {e for e in all_ if e[0] % 7 == 0}
    # Few blocks of many rows: a row is shuffled once for each block of its own side and the other.
    monkeypatch.setattr(search, "SIDE", 2)
    monkeypatch.setattr(search, "CELLS", 3000)
    edges = search.similarity_edges(rows, threshold=0.2, k=8, block=16)
    assert {tuple(r) for r in edges.collect()} == all_


def test_pages_are_merged_many_at_a_time(monkeypatch):
    import numpy as np

    from marram.operators import boxes

    rng, pages = random.Random(1), []
    for p in range(300):
        places = [(rng.choice([0, 50, 100]) + rng.randrange(20), rng.randrange(30) * rng.choice([5, 12, 14.5])) for _ in range(rng.choice([0, 1, 2, 5, 12, 30]))]
        pages.append([(x, y, x + rng.choice([3, 30, 31.5, 60]), y + rng.choice([4, 10, 11])) for x, y in places])
    page, rects = np.array([i for i, b in enumerate(pages) for _ in b]), np.array([r for b in pages for r in b], dtype=float)
    want = [(i, b) for i, some in enumerate(pages) for b in sorted(boxes.merged(some))]
    calls, alone = [], boxes.merged
    monkeypatch.setattr(boxes, "merged", lambda *a: calls.append(1) or alone(*a))
    for crowded, most in ((64, 0), (20, 60)):
        monkeypatch.setattr(boxes, "CROWDED", crowded)
        found = boxes.merged_pages(page, rects)
        assert sorted((p, tuple(b)) for p, b in zip(found[0].tolist(), found[1].tolist(), strict=True)) == want and len(calls) <= most
    assert calls and len(boxes.merged_pages(page[:0], rects[:0])[0]) == 0


def test_only_words_of_asked_guidelines_are_numbered(spark):
    from marram.operators import boxes

    words = spark.createDataFrame([(g, 0, float(i), 0.0, float(i), 0.0, f"w{i}") for g in range(20) for i in range(5)], "guideline_id long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    asked = spark.createDataFrame([(7, 1), (7, 2), (99, 3)], "guideline_id long, text_id long")
    some = sorted((r.guideline_id, r.pos, r.token) for r in boxes.word_tokens(words, asked).collect())
    assert some == sorted((r.guideline_id, r.pos, r.token) for r in boxes.word_tokens(words).collect() if r.guideline_id == 7) and len(some) == 5


def test_capitals_are_those_of_sql(spark, tmp_path):
    import duckdb

    from marram.plans import domain_queries
    from marram.plans.registry import ORACLES

    texts = ["straße", "ſ ŉ ǰ ΐ", "ﬁne ᾳ ǆ", "ÿ µ ı İ", "  a  b ", "x"]
    turns = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(map(tuple, domain_queries.generated_answers(spark, f"file://{tmp_path}").collect())) == sorted(db.execute(ORACLES["generated_answers"]).fetchall())


def test_fusion_without_scores_uses_ranks(spark):
    hits = spark.createDataFrame([(1, 1, 1.0, 7, 1, 0.8), (1, 2, 0.5, 7, 1, None), (1, 2, 0.5, 8, 3, None)], "query_id long, subquery int, weight double, reference_id long, rank int, score double")
    assert {r.reference_id: r.score for r in search.fuse(hits, 10).collect()} == {7: 1.3, 8: 0.4}


def test_bm25_prefers_the_rare_word(spark):
    refs = spark.createDataFrame([(1, "common words here"), (2, "common rareword"), (3, None), (4, "common")], "reference_id long, text string")
    queries = spark.createDataFrame([(1, "common rareword"), (2, " "), (3, None)], "query_id long, text string")
    got = [(r.query_id, r.reference_id) for r in search.bm25_top(refs, queries, 2).orderBy("query_id", "rank").collect()]
    assert got[0] == (1, 2) and {q for q, _ in got} == {1}


def test_graph_reasons(spark):
    refs = positions(refs_of(spark, [(1, "a", "2.1", 0), (2, "a", "2.1", 1), (3, "a", "2.2", 2), (4, "b", "2.1", 0)]), "guideline_id", ["ord"])
    links = spark.createDataFrame([(1, "app"), (1, "preg"), (2, "app"), (2, "preg"), (2, "mri"), (4, "app")], "reference_id long, keyword string")
    seeds = spark.createDataFrame([(9, 1)], "query_id long, reference_id long")
    pairs = graph.keyword_pairs(seeds, links, least=4, share=0.8).collect()
    assert [(p.reference_id, p.shared, p.ratio) for p in pairs] == [(2, 2, 1.0)]  # by ratio, though fewer than 4
    assert [r.reference_id for r in graph.section_mates(seeds, refs).collect()] == [2]
    out = {r.reference_id: (r.score, r.reasons) for r in graph.expand(seeds, refs, links, None, depth=1).collect()}
    assert out == {1: (1.0, "seed"), 2: (0.55 + 0.45 + 1.0, "neighbor,section,keyword")}
    without = graph.expand(seeds, refs, links, None, depth=1, include_seeds=False).collect()
    assert [r.reference_id for r in without] == [2]


def test_neighbors_equal_a_walk(spark):
    refs = positions(refs_of(spark, [(i, "ab"[i % 2], "2", i) for i in range(20)]), "guideline_id", ["ord"])
    seeds = spark.createDataFrame([(1, 4), (1, 8), (1, 5)], "query_id long, reference_id long")
    got = {(r.reference_id, r.hops) for r in graph.neighbors(seeds, refs, 3).collect()}
    want = {(n, abs(n - s) // 2) for s in (4, 8, 5) for n in range(20) if n != s and n % 2 == s % 2 and abs(n - s) // 2 <= 3}
    assert got == want
    plan = graph.neighbors(seeds, refs, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hierarchy_promotion(spark):
    refs = refs_of(spark, [(1, "a", "2.1", 0), (2, "a", "2.1", 1), (3, "a", "2.1", 2), (4, "a", "2.1", 3), (5, "a", "2.2", 4)])
    seeds = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "query_id long, reference_id long, seed_rank int")
    up = {r.reference_id for r in hierarchy.promote(seeds, refs, 0.4).where("promoted").collect()}
    assert up == {1, 2, 3, 4, 5}
    assert {(r.reference_id, r.promoted) for r in hierarchy.promote(seeds, refs, 0.75).collect()} == {(1, False), (2, False)}
    level = {r.reference_id for r in hierarchy.expand(seeds, refs, "heading_level", heading_level=2).collect()}
    assert level == {1, 2, 3, 4}


def test_neighborhood_order(spark):
    refs = positions(refs_of(spark, [(12, "a", "2", 12), (10, "a", "2", 10), (11, "a", "2", 11)]), "guideline_id", ["ord"])
    seeds = spark.createDataFrame([(1, 11, 0)], "query_id long, reference_id long, seed_rank int")
    assert [r.reference_id for r in hierarchy.neighborhood(seeds, refs, 1).orderBy("place").collect()] == [11, 10, 12]


def test_filters(spark):
    items = spark.createDataFrame([(1, 0, 91.0, True, "r"), (1, 1, 42.0, True, "r"), (1, 2, None, True, "r"), (1, 3, 95.0, False, "r")], "query_id long, idx int, score double, kept boolean, reason string")
    got = {r.idx: (r.kept, r.place, r.reason) for r in rank.decide(items, minimum=40.0, top=2).collect()}
    assert got == {0: (True, 1, "r"), 1: (True, 2, "r"), 2: (False, None, "r Cut by top-k."), 3: (False, None, "r")}
    dup = spark.createDataFrame([(1, 0, 55.0, "A  b"), (1, 1, 91.0, "a b"), (1, 2, 72.0, "a B ")], "query_id long, idx int, score double, text string")
    assert [r.idx for r in rank.dedup(dup, F.col("text")).where("kept").collect()] == [1]
    assert [r.idx for r in rank.dedup(dup, F.col("text"), keep="first").where("kept").collect()] == [0]


def test_merge_unit_case(spark):
    rows = [(1, 0, [("a",)], "0.4"), (1, 1, [("a",), ("b",)], "0.6"), (1, 2, None, "x")]
    df = spark.createDataFrame(rows, "query_id long, seq int, items array<struct<id:string>>, latency string")
    row = rank.merge(df).first()
    assert (row.latency, row.received, [i.id for i in row["items"]]) == (1.0, 3, ["a", "b"])


def test_vector_top_handles_odd_rows(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.vec_id, r.distance) for r in search.vector_top(base, queries, 5).orderBy("rank").collect()] == [(1, 0.0), (2, 1.0)]


def test_top_k_is_cut_before_the_shuffle(spark):
    from marram.functions.ranking import top_k

    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    assert "WindowGroupLimit" in top_k(df, 2, [F.col("id")], ["g"])._jdf.queryExecution().executedPlan().toString()


def test_every_reason_of_an_expansion_counts(spark, monkeypatch):
    """Sections, shared keywords and similarities that come late by id or score are added up like the first, in however many portions they are asked for."""
    from collections import defaultdict

    rng = random.Random(8)
    words = {i: {f"k{rng.randrange(8 if i >= 300 else 16)}" for _ in range(rng.choice([2, 3, 6]))} for i in range(400)}
    refs = positions(refs_of(spark, [(i, "ab"[i % 2], f"2.{i % 3}", i) for i in words]), "guideline_id", ["ord"])
    links = spark.createDataFrame([(i, w) for i, own in words.items() for w in own], "reference_id long, keyword string")
    asked = [(i % 3, i) for i in range(0, 400, 10)]
    edges = [(s, (s * 7 + 3 * j) % 400, round(0.4 + rng.random() / 2, 6)) for _, s in asked for j in range(1, 30)]
    found = defaultdict(list)
    for q in range(3):
        own = [s for p, s in asked if p == q]
        near = {(s + 2 * o, abs(o)) for s in own for o in (-2, -1, 1, 2) if 0 <= s + 2 * o < 400}
        mates = {r for s in own for r in words if r != s and r % 6 == s % 6}
        shared = [(r, len(words[s] & words[r]), min(len(words[s]), len(words[r]))) for s in own for r in words if r != s]
        best = {d: max(x for s, e, x in edges if e == d and s in own and x >= 0.5) for d in {e for s, e, x in edges if s in own and x >= 0.5}}
        for reasons in ([(s, 0, 1.0) for s in own], [(r, 1, 0.7 - 0.15 * h) for r, h in near], [(r, 2, 0.45) for r in mates]):
            for r, kind, score in reasons:
                found[q, r].append((kind, score))
        for r, n, size in shared:
            if n >= 2:
                found[q, r].append((3, max(min(1.0, 0.25 * n), round(n / size, 6))))
        for r, score in best.items():
            found[q, r].append((4, score))
    want = []
    for q in range(3):
        rows = [(-round(sum(x for _, x in v), 6), -any(k == 0 for k, _ in v), min(v)[0], r, ",".join(graph.KINDS[k] for k, _ in sorted(v))) for (p, r), v in found.items() if p == q]
        want += [(q, r, -score, reasons, place) for place, (score, _, _, r, reasons) in enumerate(sorted(rows)[:12], 1)]
    assert max(r for _, r, *_ in want) >= 300 and max(reasons.count("keyword") for *_, reasons, _ in want) > 5
    seeds, similarity = spark.createDataFrame(asked, "query_id long, reference_id long"), spark.createDataFrame(edges, "src long, dst long, score double")
    for portion in (graph.PORTION, 1500):
        monkeypatch.setattr(graph, "PORTION", portion)
        assert sorted(map(tuple, graph.expand(seeds, refs, links, similarity, depth=2).collect())) == sorted(want)
    plan = graph.keyword_sums(seeds, links)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_millionths_are_those_of_the_sql():
    import duckdb
    import numpy as np

    rows = duckdb.connect().execute("SELECT a.i, b.i, round(a.i / b.i::DOUBLE, 6) FROM range(1, 700) a(i) JOIN range(1, 700) b(i) ON a.i <= b.i").fetchnumpy()
    a, b, want = rows.values()
    assert np.array_equal(graph.micro(a, b) / graph.MICRO, want)


def test_texts_are_cut_into_keywords_once(spark, sf):
    """Spark puts a filter on empty lists below an explode, which would cut every text into words again."""
    from marram.sources.views import keywords, references

    refs = spark.createDataFrame([(1, "sixsix a"), (2, None), (3, "")], "reference_id long, text string")
    assert [tuple(r) for r in keywords(refs).collect()] == [(1, "sixsix")]
    assert keywords(references(spark, sf))._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_shares_are_rounded_as_in_sql(spark):
    """41 / 640 lies just below the half in SQL's round, and at the half as a decimal."""
    links = spark.createDataFrame([(1, f"k{i}") for i in range(640)] + [(2, f"k{i}") for i in range(599, 1240)], "reference_id long, keyword string")
    seeds = spark.createDataFrame([(7, 1)], "query_id long, reference_id long")
    assert [tuple(r) for r in graph.keyword_pairs(seeds, links, 4, 0.4).collect()] == [(7, 1, 2, 41, 0.064062)]
    assert [tuple(r) for r in graph.keyword_pairs(seeds, links, 42, 0.0640625).collect()] == [(7, 1, 2, 41, 0.064062)]
    assert not graph.keyword_pairs(seeds, links, 42, 0.06406251).collect()


def test_equal_shares_lie_side_by_side(spark, tmp_path):
    """Rows of a seed come by shared and ratio, so that files hold a run and not a value for each row."""
    rng = random.Random(3)
    words = {i: {f"k{rng.randrange(60)}" for _ in range(rng.randrange(5, 40))} for i in range(2000)}
    links = spark.createDataFrame([(i, w) for i, own in words.items() for w in own], "reference_id long, keyword string")
    seeds = spark.createDataFrame([(i % 2, i) for i in range(0, 2000, 50)], "query_id long, reference_id long")
    pairs = graph.keyword_pairs(seeds, links, 2, 0.8).withColumn("part", F.spark_partition_id()).collect()
    values = [(r.part, r.seed_id, r.shared, r.ratio) for r in pairs]
    assert len(values) > 50_000 and sum(a != b for a, b in zip(values, values[1:], strict=False)) < len(values) / 3
    assert all(a[2] <= b[2] for a, b in zip(values, values[1:], strict=False) if a[:2] == b[:2])
