from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marram.functions import references as R
from marram.functions import text as X
from marram.functions import vectors as V
from marram.operators import chunking
from marram.operators.keywords import requested, statistics, union_and_overlap, without_near_repeats, without_subphrases

HIERARCHY = "array<struct<title:string,heading_level:int,heading_number:string,order:int>>"


def one(spark, expression, schema="x string", *rows):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(expression).collect()]


def test_normal_forms(spark):
    assert one(spark, X.keyword_key(F.col("x")), "x string", (" A  b\tC ",), (None,)) == ["a b c", None]
    assert one(spark, X.dash_key(F.col("x")), "x string", ("MRT‐Knie_a/b-c..",)) == ["mrt knie a b c"]
    assert one(spark, X.metric_text(F.col("x")), "x string", ("Größe: 3,5 cm!",), (None,)) == ["größe 3 5 cm", ""]
    assert one(spark, X.query_tokens(F.col("x")), "x string", ("Die MRT-die Öl ab",)) == [["die", "mrt"]]
    assert one(spark, X.shorten(F.col("x"), 8), "x string", ("abcd efgh ij",), ("short",)) == ["abcd...", "short"]


def test_page_hint_and_boxes(spark):
    assert one(spark, X.page_hint(F.col("x")), "x string", ("3.9",), ("x",), (None,)) == [3, None, None]
    found = one(spark, F.size(X.boxes_json(F.col("x"))), "x string", ('{"page":1,"positions":[1,2,3,4]}',), ('[{"page":1,"positions":[1,2,3,4]},{"page":2,"positions":[1,2,3,4]}]',), ('{"page":0,"positions":[1]}',))
    assert found[:2] == [1, 2] and found[2] in (None, -1)


def test_model_answers(spark):
    schema = "array<struct<index:int,keep:boolean>>"
    answers = ['```json\n[{"index":0,"keep":true}]\n```', 'So: [{"index":1,"keep":false}] ok', '{"decisions":[{"index":2,"keep":true}]}', "none"]
    got = one(spark, X.json_array(F.col("x"), schema), "x string", *[(a,) for a in answers])
    assert [g[0]["index"] if g else None for g in got] == [0, 1, 2, None]
    assert one(spark, X.query_list(F.col("x")), "x string", ('["a","b"]',), ("<query>a</query><QUERY> b </QUERY>",), ("- a\n2) b\n\n",)) == [["a", "b"]] * 3
    assert one(spark, X.documents_in(F.col("x")), "x string", ("<document>one</document> <document>\ntwo </document>",)) == [["one", "two"]]
    assert one(spark, X.yes_no(F.col("x")), "x string", ("Yes, because",), ("no",), ("?",)) == [True, False, None]


def test_previous_answer(spark):
    rows = [(" a  b ", None), (" ", [("end", "x"), ("end", " y "), ("filter", "z")]), (None, [])]
    df = spark.createDataFrame(rows, "o string, t array<struct<component:string,response:string>>")
    assert [r[0] for r in df.select(X.previous_answer(F.col("o"), F.col("t"))).collect()] == ["a b", "y", None]


def test_contents_by_type(spark):
    schema = "type string, contained_text string, caption string, describing_text string, plain_text string, table_markdown string, title string, content string, grade string, metadata_type string, metadata_content string"
    rows = [
        ("text", "t", *[None] * 9),
        ("image", None, "c", None, *[None] * 7),
        ("table", None, "", None, "p", "", *[None] * 5),
        ("recommendation", *[None] * 5, None, "do", "A", None, None),
        ("statement", *[None] * 5, "T", "is", None, None, None),
        ("metadata", *[None] * 8, "Heading", "h"),
    ]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.select(R.content()).collect()] == ["t", "caption: c", "p", "None: do\n(A)", "T: is", "h"]
    assert [r[0] for r in df.select(R.ingest_content(skip_headings=True)).collect()] == ["t", "c", "p", "do", "T is", None]


def test_paths(spark):
    h = [("Kapitel", 1, "1", 0), ("", 2, "", 1), ("Abschnitt", 2, "1.1", 2)]
    df = spark.createDataFrame([(h,)], f"h {HIERARCHY}")
    row = df.select(R.titles_path(F.col("h")), R.numbered_path(F.col("h")), F.size(R.prefixes(F.col("h")))).first()
    assert tuple(row) == ("Kapitel > Abschnitt", "1 Kapitel / 1.1 Abschnitt", 3)


def test_chunks_of_the_unit_cases(spark):
    assert chunking.fixed_pieces("abcdefghij", 5) == ["abcde", "fghij"]
    assert chunking.fixed_pieces("Alpha Beta Gamma", 12) == ["Alpha Beta", "Gamma"]
    assert chunking.fixed_pieces("", 5) == [""]
    refs = spark.createDataFrame([(1, "Eins. Zwei! Drei?"), (2, "Dose 3.5 mg. Zwei!"), (3, "")], "reference_id long, text string")
    got = {}
    for r in chunking.split(refs, "sentence").orderBy("reference_id", "chunk_index").collect():
        got.setdefault(r.reference_id, []).append(r.chunk)
    assert got == {1: ["Eins.", "Zwei!", "Drei?"], 2: ["5 mg.", "Zwei!"], 3: [""]}
    with pytest.raises(ValueError):
        chunking.split(refs, "fixed_characters")
    assert chunking.group_name("g", "sentence", None, ["g_sentence", "g_sentence_2"]) == "g_sentence_3"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c\n", max_size=60), st.integers(1, 12))
def test_fixed_pieces_keep_all_but_white_space(text, n):
    pieces = chunking.fixed_pieces(text, n)
    assert "".join("".join(p.split()) for p in pieces) == "".join(text.split())
    assert all(len(p) <= n for p in pieces) or pieces == [text]


def test_reindex_counts_siblings(spark):
    rows = [(i, [("K", 1, "1", 3), ("A", 2, "1.1", 10 + i)], None, "t") for i in (2, 0, 1)]
    df = spark.createDataFrame(rows, f"reference_id int, hierarchy {HIERARCHY}, bboxs array<struct<page:int,positions:array<double>>>, text string")
    got = {r.reference_id: (r.hierarchy[0].order, r.hierarchy[-1].order) for r in chunking.reindex(df).collect()}
    assert got == {0: (3, 0), 1: (3, 1), 2: (3, 2)}


def test_subphrases_and_sets(spark):
    phrases = ["zusammenhang mit weisheitszähne", "weisheitszähne vorkommen", "weisheitszähne", "zusammenhang", "vorkommen", "symptome"]
    df = spark.createDataFrame([(1, p) for p in phrases], "id int, phrase string")
    assert {r.phrase for r in without_subphrases(df).collect()} == {phrases[0], phrases[1], phrases[5]}
    row = spark.createDataFrame([(["b", "a"], ["c", "b"])], "a array<string>, b array<string>").select(*union_and_overlap(F.col("a"), F.col("b"))).first()
    assert list(row) == [["a", "b", "c"], ["b"]]
    docs = spark.createDataFrame([(["abcdefgh", "abcdefgx", "zzz"],)], "d array<string>")
    assert docs.select(without_near_repeats("d", F.lit(0.8))).first()[0] == ["abcdefgh", "zzz"]


def test_keyword_statistics():
    assert requested(None, None) == 15 and requested(None, 500) == 200
    found = statistics("Appendicitis in pregnancy. Acute appendicitis needs imaging. Imaging of appendicitis uses MRI.", stop=frozenset({"in", "of"}))
    assert found and "appendicitis" in " ".join(p.lower() for p, _ in found[:3])
    assert statistics("") == []


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.8, 0.6]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    first, second = df.select(V.cosine(a, b), V.euclidean(a, b), V.distance("manhattan", a, b), V.distance("hamming", a, b), V.unit(a)).collect()
    assert first[0] == pytest.approx(0.8) and first[1] == pytest.approx(0.4**0.5) and first[2] == pytest.approx(0.8) and first[3] == 2
    assert second[0] == 0 and list(second[4]) == [0.0, 0.0]
    assert spark.range(1).select(V.last_softmax(F.array(F.lit(0.0)))).first()[0] == 0.5


def test_extraction_equals_the_statistics_of_single_texts(spark):
    import random

    from marram.operators.keywords import extract, statistics

    rng = random.Random(6)
    pool = ["Therapie", "MRI", "low-dose", "patient's", "of", "in", "the", "CT", "12", "Leber", "leber", "Größe", "acute", "Acute", "kidney", "x", "ab", "ÉTÉ", "stage", "IV"]
    texts = [(i, " ".join(rng.choice(pool) + rng.choice(["", "", "", ",", ".", "!", " -", "\n"]) for _ in range(rng.randrange(0, 120)))) for i in range(40)]
    texts += [(100, None), (101, ""), (102, "... !!"), (103, "-'a-b-'c--d'e"), (104, "one"), (105, "a-" * 6000 + "a. End of it."), (7, texts[7][1])]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    for n, stop in ((3, frozenset()), (6, frozenset({"of", "in", "the"}))):
        want = sorted((i, k, p, round(s, 9)) for i, t in texts for k, (p, s) in enumerate(statistics(t or "", n, 15, 0.9, stop)))
        assert sorted((r.id, r.seq, r.phrase, round(r.score, 9)) for r in extract(df, n=n, stop=stop).collect()) == want
        assert len({i for i, *_ in want}) > 35


def test_extraction_over_the_documents(spark, sf):
    from marram.operators.keywords import statistics
    from marram.plans.text_queries import keyword_extraction

    want = {(r.doc_id, k): (p, round(s, 8)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for k, (p, s) in enumerate(statistics(r.text or "", 3, 15))}
    assert {(r.id, r.seq): (r.phrase, round(r.score, 8)) for r in keyword_extraction(spark, sf).collect()} == want


def test_extraction_shuffles_nothing(spark, monkeypatch):
    """A text's statistics need no other text; and texts without words have no phrase."""
    from marram.operators import keywords
    from marram.operators.keywords import extract, statistics

    texts = spark.createDataFrame([(i, None if i % 3 else "") for i in range(30)] + [(30, "Acute kidney. Chronic kidney, kidney")], "id long, text string").coalesce(1)
    monkeypatch.setattr(keywords, "TEXTS", 4)
    found = extract(texts)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.seq, r.phrase, round(r.score, 9)) for r in found.collect()) == [(30, k, p, round(s, 9)) for k, (p, s) in enumerate(statistics("Acute kidney. Chronic kidney, kidney", 3, 15))]


def test_words_are_ranked_where_their_texts_are_dealt(spark, sf, monkeypatch):
    """Texts are shuffled, by their id and as many as a task can count, and not their words; rows that repeat an id are one text."""
    from marram.operators import keywords
    from marram.plans.text_queries import keyword_rank

    plan = keyword_rank(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "Exchange" not in plan[: plan.index("Generate")]
    monkeypatch.setattr(keywords, "TEXT_BYTES", 3)
    texts = spark.createDataFrame([(1, "a-b c c"), (1, "c d"), (2, None), (None, "x y y")], "id long, text string")
    parts = keywords.dealt(texts)
    assert parts.rdd.getNumPartitions() == 5
    found = keywords.ranked(parts.select("id", F.explode(F.split("text", " ")).alias("phrase")))
    assert sorted((r.id or 0, r.place, r.phrase, r.frequency) for r in found.collect()) == [(0, 1, "y", 2), (0, 2, "x", 1), (1, 1, "c", 3), (1, 2, "a b", 1), (1, 3, "d", 1)]
