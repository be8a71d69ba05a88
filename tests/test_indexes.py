from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marram.operators import search
from marram.functions.text import query_tokens, word_count
from marram.operators.textindex import TextIndex, exploded, sized
from marram.operators.vectorindex import KINDS, VectorIndex, neighbour_graph
from marram.sources.views import references, text_queries, vector_queries, vectors


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 80)))) for i in range(600)] + [(1000, None), (1001, ""), (1002, "word1 " * 3000)]
    queries = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for i in range(30)] + [(90, None), (91, "nowhere"), (92, "word0 word0 word299")]
    return spark.createDataFrame(rows, "reference_id long, text string").repartition(6), spark.createDataFrame(queries, "query_id long, text string")


def rows(df):
    return sorted((r.query_id, r.rank, r.reference_id, r.score) for r in df.collect())


@pytest.mark.parametrize("probed", [0, 64])
def test_index_gives_the_rows_of_the_search_without_one(spark, texts, tmp_path, monkeypatch, probed):
    from marram.operators import textindex

    monkeypatch.setattr(textindex, "PROBED", probed)
    refs, queries = texts
    want = rows(search.bm25_top(refs, queries, 5))
    index = TextIndex(spark, f"file://{tmp_path}/a").append(refs)
    assert rows(index.top(queries, 5)) == want and len({q for q, *_ in want}) > 20
    report = index.report(queries.where("query_id < 5"), 1)
    assert report["blocks_of_words"] < report["blocks"] / 4 and report["folders"] < 64
    assert report["ranges_scored"] < report["ranges"] if probed == 0 else report["ranges_scored"] == report["ranges"]


def test_appended_segments_need_no_rebuild(spark, texts, tmp_path):
    refs, queries = texts
    index = TextIndex(spark, f"file://{tmp_path}/b")
    assert index.top(queries, 5).collect() == []
    for part in range(3):
        index.append(refs.where(f"reference_id % 3 = {part}"))
    assert rows(index.top(queries, 5)) == rows(search.bm25_top(refs, queries, 5))


def test_a_segment_without_its_sizes_is_not_read(spark, texts, tmp_path):
    refs, queries = texts
    index = TextIndex(spark, f"file://{tmp_path}/c").append(refs)
    want = rows(index.top(queries, 5))
    half = index.blocks().limit(5).withColumn("segment", F.lit("torn")).select("term", "segment", "range", "n", "most", "least", "postings", "folder")
    half.write.mode("append").partitionBy("folder").parquet(f"{index.path}/blocks")
    assert rows(index.top(queries, 5)) == want


def test_index_over_the_documents(spark, sf, tmp_path, monkeypatch):
    from marram.operators import textindex

    monkeypatch.setattr(textindex, "PROBED", 0)
    refs, queries = references(spark, sf), text_queries(spark, sf)
    index = TextIndex(spark, f"file://{tmp_path}/d").append(refs)
    assert rows(index.top(queries, 10)) == rows(search.bm25_top(refs, queries, 10))


def test_no_text_function_above_an_explode(texts):
    """What is above a Generate is computed for each word again."""
    refs, _ = texts
    words = exploded(sized(refs, F.col("text")))
    shown = words._jdf.queryExecution().optimizedPlan().toString()
    above, below = shown[: shown.index("Generate")], shown[shown.index("Generate") :]
    assert "regexp" not in above.lower() and "split" not in above.lower() and "regexp" in below.lower()
    # In one select the length is above the explode: this is what exploded() avoids.
    wrong = refs.select("reference_id", word_count(F.col("text")).alias("length"), F.explode(query_tokens(F.col("text"))).alias("term"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" in wrong[: wrong.index("Generate")].lower()


@pytest.mark.parametrize("kind", KINDS)
def test_balls_give_the_rows_of_the_search_through_all(spark, sf, kind, tmp_path):
    base, queries = vectors(spark, sf), vector_queries(spark, sf)
    index = VectorIndex.build(base, f"file://{tmp_path}/{kind}", balls=12)
    key = lambda df: sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in df.collect())
    assert key(index.top(queries, 10, kind)) == key(search.vector_top(base, queries, 10, kind))


def clustered(spark, n=3000, d=16, clusters=40):
    gen = np.random.default_rng(4)
    centres = gen.standard_normal((clusters, d)) * 4
    x = centres[np.arange(n) % clusters] + gen.standard_normal((n, d)) * 0.2
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("kind", ["cosine", "dot", "l2-squared", "manhattan"])
def test_balls_of_clustered_vectors_are_few(spark, kind, tmp_path):
    _, base = clustered(spark)
    queries = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = VectorIndex.build(base, f"file://{tmp_path}/few", balls=40)
    assert index.report(queries, 5, kind)["compared"] < (0.15 if kind != "dot" else 0.5)
    key = lambda df: sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in df.collect())
    assert key(index.top(queries, 5, kind)) == key(search.vector_top(base, queries, 5, kind))


def test_balls_hand_on_few_of_equally_far_rows(spark, tmp_path):
    """No two rows share an entry, so all are equally far by hamming: a task hands on k rows of a query, whatever balls and batches it reads."""
    base = spark.range(3000).select(((F.col("id") * 7919) % 3000).alias("vec_id"), F.array(F.col("id") + 1.0, F.col("id") + 0.5).alias("embedding"))
    ids = np.arange(40)
    q = np.array([[-1.0 - i, -0.25 - i] for i in ids])
    index = VectorIndex.build(base, f"file://{tmp_path}/far", balls=6)
    handed = index._look(ids, q, np.ones((len(q), len(index.centres)), dtype=bool), 3, "hamming")
    assert handed.count() <= handed.rdd.getNumPartitions() * len(q) * 3 < 3000 * len(q) / 10
    queries = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, q, strict=True)], "query_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.distance, r.rank) for r in index.top(queries, 3, "hamming").orderBy("query_id", "rank").collect()]
    assert got == [(i, v, 2.0, v + 1) for i in range(40) for v in range(3)]


def test_balls_of_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0]), (None, [0.0, 1.0]), (7, [])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0])], "query_id long, embedding array<double>")
    index = VectorIndex.build(base, f"file://{tmp_path}/odd", balls=2)
    for kind in KINDS:
        usable = base.where("vec_id is null or vec_id in (1, 2, 6)")
        want = sorted((r.query_id, r.rank, str(r.vec_id), r.distance) for r in search.vector_top(usable, queries.where("query_id < 3"), 9, kind).collect())
        assert sorted((r.query_id, r.rank, str(r.vec_id), r.distance) for r in index.top(queries, 9, kind).collect()) == want
    empty = VectorIndex.build(base.where("false"), f"file://{tmp_path}/empty")
    assert empty.top(queries, 3).collect() == []


def test_neighbour_graph_has_the_recall_it_was_asked_for(spark, tmp_path):
    base = vectors(spark, "/root/testdata/sf0.1")
    exact = {(r.src, r.dst): r.score for r in search.similarity_edges(base, threshold=0.2, k=8).collect()}
    index = VectorIndex.build(base, f"file://{tmp_path}/graph", balls=24)
    got = {(r.src, r.dst): r.score for r in neighbour_graph(index, k=8, threshold=0.2, target=0.97).collect()}
    assert len(got.keys() & exact.keys()) / len(exact) >= 0.95
    assert all(exact[e] == s for e, s in got.items() if e in exact)


def test_neighbour_graph_of_clusters_looks_into_few_balls(spark, tmp_path):
    from marram.operators.vectorindex import planned_probes

    x, base = clustered(spark, 1200, 16, 30)
    index = VectorIndex.build(base, f"file://{tmp_path}/clusters", balls=30)
    sample = base.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    probes, recall = planned_probes(index, sample, 8, 0.2, 0.97)
    assert probes <= 3 and recall >= 0.97
    norm = np.linalg.norm(x, axis=1)
    scores = np.round(x @ x.T / norm[:, None] / norm[None], 6)
    np.fill_diagonal(scores, -9)
    want = {(i, j) for i in range(len(x)) for j in sorted(range(len(x)), key=lambda j: (-scores[i, j], j))[:8]}
    got = {(r.src, r.dst) for r in neighbour_graph(index, k=8, threshold=0.2, block=16).collect()}
    assert len(got & want) / len(want) >= 0.95 and len(got) <= 8 * len(x)


def test_neighbour_graph_copies_a_vector_once_a_block(spark, tmp_path, monkeypatch):
    """However many balls a vector looks into; and with all of them the edges are the exact ones, those of copies in one large ball too."""
    from pyspark.sql.group import GroupedData

    from marram.operators import vectorindex

    x = np.vstack([np.random.default_rng(8).standard_normal((1200, 8)), np.ones((300, 8)), np.random.default_rng(9).standard_normal((100, 8)).astype(np.float32)])
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[7].tolist()), (None, x[0].tolist()), (9000, None), (9001, [0.0] * 8)], "vec_id long, embedding array<double>")
    index = VectorIndex.build(base, f"file://{tmp_path}/copies", balls=48)
    grouped, apply = [], GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, f, schema: grouped.append(self._df) or apply(self, f, schema))
    monkeypatch.setattr(vectorindex, "planned_probes", lambda *_: (len(index.centres), 1.0))
    got = neighbour_graph(index, k=5, threshold=0.2, block=200)
    assert grouped[0].count() <= 2 * 9 * 1603
    key = lambda df: sorted((r.src, r.dst, r.score) for r in df.collect())
    found = key(got)
    assert found == key(search.similarity_edges(base.where("vec_id is not null"), threshold=0.2, k=5)) and len(found) > 7000


def test_vectors_are_packed_without_loss():
    from marram.operators.vectorindex import packed, unpacked
    import pandas as pd

    x = np.array([[1.5, -2.0], [0.1, 1.0], [1e300, 0.0], [np.float64(np.float32(0.1)), 3.0]])
    rows = packed(x)
    assert [len(r) for r in rows] == [8, 16, 16, 8] and (unpacked(pd.Series(rows), 2) == x).all()


def test_blocks_are_made_where_texts_are_read(monkeypatch):
    """One row for each word of a run of documents, without a shuffle."""
    import pyarrow as pa

    from marram.operators import textindex

    monkeypatch.setattr(textindex, "RANGE", 1)
    batch = pa.RecordBatch.from_pydict({"reference_id": [5, 6, 7], "length": [3, 1, 2], "words": [["aa", "bb", "aa"], ["aa"], None], "at": [0, 1, 2]}, schema=pa.schema([("reference_id", pa.int64()), ("length", pa.int64()), ("words", pa.list_(pa.string())), ("at", pa.int64())]))
    found = [r for b in textindex.blocks_of([batch]) for r in b.to_pylist()]
    posting = lambda i, tf, length: {"reference_id": i, "tf": tf, "length": length}
    assert found == [
        {"term": "aa", "range": 0, "n": 2, "most": 2, "least": 1, "postings": [posting(5, 2, 3), posting(6, 1, 1)]},
        {"term": "bb", "range": 0, "n": 1, "most": 1, "least": 3, "postings": [posting(5, 1, 3)]},
    ]
