from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from marram.operators import keywords
from marram.sources.terminology import Reader, Terminology, answer_name


def concept(code, display, synonym):
    return {"code": code, "display": display, "designation": [{"language": "de-DE", "use": {"display": "Synonym"}, "value": synonym}]}


@pytest.fixture
def source(spark):
    spark.dataSource.register(Terminology)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.fixture
def folder(tmp_path):
    reader = Reader({"base": str(tmp_path), "count": "2"})
    known = {"liver": [concept(f"l{i}", f"Leber {i}", f"Hepar {i}") for i in range(5)], "none": [], "one": [concept("o", "Eins", "Einer")]}
    for term, all_ in known.items():
        for page in range(max(1, -(-len(all_) // 2))):
            body = {"expansion": {"total": len(all_), "contains": all_[2 * page : 2 * page + 2]}}
            (tmp_path / answer_name("expand", **reader.expansion(term, page))).write_text(json.dumps(body))
    (tmp_path / answer_name("expand", **reader.expansion("broken", 0))).write_text("no json")
    return tmp_path


def load(spark, folder, terms, **options):
    return spark.read.format("terminology").options(base=str(folder), terms=json.dumps(terms), count="2", **options).load()


def test_pages_are_followed(source, folder):
    got = load(source, folder, ["liver", "none", "one", "broken", "unknown", " ", None]).collect()
    assert sorted((r.term, r.page) for r in got) == [("broken", 0), ("liver", 0), ("liver", 1), ("liver", 2), ("none", 0), ("one", 0)]
    answers = load(source, folder, ["liver", "one", "none", "broken"]).where("page = 0").select("term", "json")
    found = keywords.terminology_answers(answers)
    names = {r.concept_id: r.synonyms for r in keywords.synonyms(found, "de").collect()}
    assert names == {"l0": ["Leber 0", "Hepar 0"], "o": ["Eins", "Einer"]}


def test_filters_are_taken_over(source, folder):
    terms = ["liver", "one", "none"]
    df = load(source, folder, terms).where(F.col("term").isin("one", "none", "other"))
    assert {r.term for r in df.collect()} == {"one", "none"}
    assert {r.term for r in load(source, folder, []).where("term = 'one'").collect()} == {"one"}
    assert load(source, folder, terms).where("term = 'absent'").collect() == []
    assert load(source, folder, terms, version="v1").where("version = 'v2'").collect() == []
    reader = Reader({"base": str(folder), "terms": json.dumps(terms)})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("term",), "one"), GreaterThan(("page",), 0)]))
    assert reader.terms == ["one"] and [type(f).__name__ for f in rest] == ["GreaterThan"]


def test_versions_and_their_fallback(source, tmp_path):
    file = tmp_path / answer_name("versions", url="http://snomed.info/sct")
    entries = [{"resource": {"version": "v2", "name": "N"}}, {"resource": {"version": " v1 ", "title": "T", "url": "u"}}, {"resource": {"version": "v2"}}, {"resource": {}}, {}]
    file.write_text(json.dumps({"entry": entries}))
    read = lambda: [tuple(r) for r in source.read.format("terminology").options(base=str(tmp_path), table="versions").load().collect()]
    assert read() == [("v2", "N", None, "CodeSystem"), ("v1", "T", "u", "CodeSystem")]
    file.write_text("{}")
    meta = tmp_path / answer_name("metadata")
    meta.write_text(json.dumps({"software": {"version": "9"}, "fhirVersion": "4.0.1", "implementation": {"description": "d"}}))
    assert read() == [("9", "Server software version", None, "metadata"), ("4.0.1", "FHIR version", None, "metadata")]
    meta.write_text(json.dumps({"implementation": {"description": "d"}}))
    assert read() == [("d", "Implementation description", None, "metadata")]
    meta.write_text("{}")
    assert read() == []


def test_a_server_is_asked_for_the_terms_of_a_filter_only(source):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            query = parse_qs(urlparse(self.path).query)
            asked.append((query["filter"][0], int(query["offset"][0]), self.headers["Accept-Language"]))
            body = json.dumps({"expansion": {"total": 3, "contains": [concept("c", "d", "s")]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = load(source, f"http://127.0.0.1:{server.server_port}", ["a", "b"], language="de").where("term = 'b'")
        assert sorted((r.term, r.page) for r in df.collect()) == [("b", 0), ("b", 1)]
    finally:
        server.shutdown()
    assert set(asked) == {("b", 0, "de"), ("b", 2, "de")}
