"""Source divergence, decontamination and whitening on hand-made tables, against SQL and brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from marram.llm import common, decontaminate, divergence, whitening
from marram.llm import queries as Q


def same_as_sql(base: str, name: str, df, tables: tuple[str, ...]) -> list:
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{base.removeprefix('file://')}/{t}.parquet/*.parquet'")
    found = con.execute(Q.ORACLES[name])
    names = [d[0] for d in found.description]
    want = Counter(tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall())
    rows = df.collect()
    assert sorted(names) == sorted(df.columns) and Counter(tuple(r) for r in rows) == want
    return rows


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(5)
    common = [f"w{chr(97 + i)}" for i in range(20)] + ["Größe", "ÉTÉ", "漢字", "x'y", "A1b"]
    rows = []
    for i in range(160):
        lang, source = rng.choice(["en", "en", "de", None, "xx"]), rng.choice(["hot", "hot", "b", "c", None, "dé"])
        own = [f"{source}{chr(97 + rng.randrange(3))}" for _ in range(6)]
        rows.append((i, " ".join(rng.choice(common + own) for _ in range(rng.randrange(0, 60))), lang, source))
    rows += [(900, None, "en", "b"), (901, "", "zz", "alone"), (902, "12 34", "zz", "other"), (None, "wa wb", "en", "b"), (None, "wa wb", "en", "b"), (903, "wa " * 30000, "en", "long")]
    base = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"{base}/documents.parquet")
    return base, rows


def test_op11_equals_its_sql(spark, corpus):
    base, rows = corpus
    df = Q.op11_source_divergence(spark, base)
    assert df.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    got = same_as_sql(base, "op11_source_divergence", df, ("documents",))
    assert {(r.source, r.item, r.value) for r in got if r.lang == "zz"} == {("alone", "other", 0), ("other", "alone", 0)}
    pairs = {(r.lang, r.source, r.item): r.value for r in got if r.part == "pair"}
    assert all(pairs[lang, b, a] == v for (lang, a, b), v in pairs.items())


def test_op11_equals_counting_by_hand(spark, corpus):
    _, rows = corpus
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in (t or "").translate(low)).split(" ")
    held, counts = defaultdict(set), defaultdict(Counter)
    for i, (_, text, lang, source) in enumerate(rows):
        counts[lang or "", source or ""].update(w for w in words(text) if w)
        for w in words(text):
            if w:
                held[lang or "", w].add(i)
    kept = {k for k, docs in held.items() if len(docs) >= 10}
    v = Counter(lang for lang, _ in kept)
    share = lambda lang, c, w: 1 + 10**9 * (c[w] + 2) // (sum(n for t, n in c.items() if (lang, t) in kept) + 2 * v[lang])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {(r.lang, r.source, r.item): r.value for r in divergence.divergence(df).where("part = 'pair'").collect()}
    for (lang, a, b), value in list(got.items())[::7]:
        want = 0
        for w in (w for known, w in kept if known == lang):
            p, q = share(lang, counts[lang, a], w), share(lang, counts[lang, b], w)
            want += (p - q) ** 2 // (p + q)
        assert value == want


def test_op11_in_portions_and_of_nothing(spark, corpus, monkeypatch):
    _, rows = corpus
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("item", Q.F.lit("clash")).withColumn("rank", Q.F.lit(1))
    whole = Counter(map(tuple, divergence.divergence(df).collect()))
    monkeypatch.setattr(divergence, "GROUPS", 3)
    monkeypatch.setattr(divergence, "HELD", 20)
    assert Counter(map(tuple, divergence.divergence(df).collect())) == whole
    assert divergence.divergence(df.where("false")).collect() == []


def brute_hits(docs, items, window=10):
    words = lambda t: "".join(c if ord(c) > 127 or c.isascii() and c.isalnum() else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")).split(" ")
    known = []
    for item, text in items:
        w = [x for x in words(text) if x]
        m = min(window, len(w))
        known += [(item, tuple(w[i : i + m])) for i in range(len(w) - m + 1) if m]
    out = []
    for doc, text in docs:
        w = [x for x in words(text) if x]
        hit, found = set(), set()
        places = defaultdict(list)
        for m in {len(x) for _, x in known}:
            for i in range(len(w) - m + 1):
                places[tuple(w[i : i + m])].append(i)
        for item, x in known:
            for i in places.get(x, ()):
                hit.update(range(i, i + len(x)))
                found.add(item)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0))
    return Counter(out)


@pytest.fixture(scope="module")
def bench_corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    line = lambda n, k=40: " ".join(f"t{rng.randrange(k)}" for _ in range(n))
    items = [(i, line(rng.randrange(10, 40))) for i in range(20)]
    items += [(30, line(4)), (31, "Einzig"), (32, ""), (33, None), (34, items[3][1]), (34, line(12)), (None, line(11)), (35, "same same same same same same same same same same same"), (36, line(9))]
    texts = {i: t for i, t in items if t}
    docs = []
    for i in range(120):
        parts = [line(rng.randrange(0, 30), 4000)]
        for _ in range(rng.randrange(0, 3)):
            words = texts[rng.choice(list(texts))].split()
            cut = rng.randrange(0, max(1, len(words) - 9))
            parts += [rng.choice([" ", ", ", "\n"]).join(words[cut : cut + rng.choice([9, 10, 11, 30])]).upper(), line(rng.randrange(0, 4))]
        docs.append((i, " . ".join(parts)))
    docs += [(500, None), (501, ""), (502, "einzig"), (503, "same " * 200), (504, items[0][1] + " " + items[0][1]), (504, items[1][1]), (504, items[1][1]), (None, items[2][1]), (505, line(30000, 5000) + " " + items[5][1])]
    docs += [(1000 + i, "x " + items[7][1]) for i in range(60)]
    base = f"file://{tmp_path_factory.mktemp('bench')}"
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, docs, items


def test_op12_equals_its_sql_and_brute_force(spark, bench_corpus):
    base, docs, items = bench_corpus
    df = Q.op12_decontamination(spark, base)
    assert df.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")]
    rows = same_as_sql(base, "op12_decontamination", df, ("documents", "benchmark"))
    assert Counter(tuple(r) for r in rows) == brute_hits(docs, items) and sum(r.contaminated for r in rows) > 100


def test_op12_without_broadcast_and_with_full_filters(spark, bench_corpus, monkeypatch):
    base, docs, items = bench_corpus
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(common, "LEAST_BITS", 64)
    monkeypatch.setattr(common, "MOST_BITS", 64)
    assert Counter(tuple(r) for r in Q.op12_decontamination(spark, base).collect()) == brute_hits(docs, items)


def test_op12_of_nothing(spark, bench_corpus):
    base, docs, _ = bench_corpus
    documents, items = Q.table(spark, base, "documents").withColumn("row", Q.F.lit(1)).withColumn("windows", Q.F.lit("x")), Q.table(spark, base, "benchmark")
    assert decontaminate.contamination(documents.where("false"), items).collect() == []
    none = decontaminate.contamination(documents, items.where("false")).collect()
    assert len(none) == len(docs) and all(r.n_hit == 0 and r["items"] == [] for r in none)


def test_winnowing_keeps_one_of_every_run():
    rng = np.random.default_rng(3)
    for n in (5, 6, 7, 300):
        hashes = rng.integers(0, 8, n, dtype=np.uint64)
        kept = decontaminate.winnow(hashes, 6)
        for i in range(n - 5):
            own = hashes[i : i + 6]
            assert i + 5 - int(np.argmin(own[::-1])) in kept
        assert len(kept) < n or n < 7


def test_clean_drops_what_is_hit(spark, bench_corpus):
    base, docs, items = bench_corpus
    left = {r.doc_id for r in decontaminate.clean(Q.table(spark, base, "documents"), Q.table(spark, base, "benchmark")).collect()}
    hit = {d for d, _, n, *_ in brute_hits(docs, items) if n}
    assert left == {d for d, _ in docs} - hit


VECTORS = "vec_id long, embedding array<float>, label int"


def test_op13_equals_numpy(spark, tmp_path):
    gen = np.random.default_rng(9)
    x = (gen.standard_normal((300, 70)) * np.linspace(0.2, 2, 70) + gen.standard_normal((300, 1))).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(400 + i, x[0].tolist(), None) for i in range(150)] + [(None, x[1].tolist(), 0), (5, x[2].tolist(), 0)]
    bad = [(800, None, 1), (801, [], 1), (802, [None] + [0.0] * 69, 1), (803, [float("nan")] * 70, 1), (804, [float("inf")] * 70, 1), (805, [1.0] * 3, 1)]
    spark.createDataFrame(rows + bad, VECTORS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = Q.op13_embedding_whitening(spark, f"file://{tmp_path}")
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = df.collect()
    whole = np.floor(1024 * np.array([v for _, v, _ in rows], dtype=np.float64)).astype(np.int64) + 100000
    n, sums = len(whole), whole.sum(axis=0)
    centred = whole - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter((i, sum(int(g) ** 2 for g in n * row - sums)) for (i, _, _), row in zip(rows, whole, strict=True))
    for k in range(8):
        want = {i: w for (i, _, _), w in zip(rows, centred @ vectors[:, k] / np.sqrt(values[k]), strict=True) if i not in (5, None)}
        mine = {r.vec_id: r.whitened for r in got if r.component == k + 1 and r.vec_id in want}
        sign = np.sign(mine[3] * want[3])
        assert all(abs(mine[i] - sign * want[i]) < 1e-8 for i in want)
        assert all(abs(r.explained - values[k] / values.sum()) < 1e-10 for r in got if r.component == k + 1)
    assert all(r.identity_error < 1e-9 for r in got)


def test_op13_deviations_beyond_32_bits(spark):
    rows = [(i, [float(2**17 * (i % 2)), float(i), 0.5]) for i in range(7)]
    whole = [[int(1024 * v) + 100000 for v in r[1]] for r in rows]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: sum((7 * x - s) ** 2 for x, s in zip(whole[i], sums, strict=True)) for i in range(7)} and max(got.values()) > 2**57


def test_op13_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make([(1, None, 1)])).collect() == []
    assert whitening.whiten(make([(i, [1.0, 2.0], 1) for i in range(5)])).collect() == []
    two = whitening.whiten(make([(0, [0.0, 1.0], 1), (1, [1.0, 1.0], 1)]).withColumn("component", Q.F.lit("clash"))).collect()
    assert sorted((r.vec_id, r.component, r.deviation, abs(round(r.whitened, 9)), r.explained) for r in two) == [(0, 1, 1024**2, 1.0, 1.0), (1, 1, 1024**2, 1.0, 1.0)]
