"""A terminology server as a data source (SRC9): value set expansions, page by page, and the versions it has.

    spark.dataSource.register(Terminology)
    spark.read.format("terminology").option("base", url).option("terms", json list).load()

``base`` is the server's address, or a folder that all executors see with one file per answer, named as ``answer_name`` says, for
servers whose answers were saved. ``table`` is "terms" (the default: term, version, page, json, one row an answer) or "versions" (version,
title, url, origin). Filters on ``term`` and ``version`` are taken over: only the terms asked for are fetched. Terms are dealt to as many
partitions as ``partitions`` says; a partition fetches one answer at a time and follows a term's pages until the expansion's
total is reached or a page is empty.

Defined cases: an answer that is not there gives no row; one that is no JSON is a row, as from_json makes nulls of it; without versions in the code system
those of the server's metadata are given; blank terms are not asked.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMAS = {"terms": "term string, version string, page int, json string", "versions": "version string, title string, url string, origin string"}
TIMEOUT_S, PAGE, MOST_PAGES = 60, 20, 10_000


def answer_name(kind: str, **parameters: object) -> str:
    """The file of a saved answer: its kind and a digest of the parameters in order of their names."""
    said = urlencode(sorted((k, str(v)) for k, v in parameters.items()))
    return f"{kind}-{hashlib.sha256(said.encode()).hexdigest()[:32]}.json"


class Terms(InputPartition):
    def __init__(self, terms: list[str]):
        super().__init__(0)
        self.terms = terms


class Terminology(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terminology"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "terms")]

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base, self.table = options["base"].rstrip("/"), options.get("table", "terms")
        self.terms = [t.strip() for t in json.loads(options.get("terms", "[]")) if t and t.strip()]
        self.version, self.language = options.get("version", ""), options.get("language", "de")
        self.value_set, self.page = options.get("valueset", "http://snomed.info/sct?fhir_vs"), int(options.get("count", PAGE))
        self.parts, self.headers = int(options.get("partitions", "8")), json.loads(options.get("headers", "{}"))
        self.impossible = False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of term and version are taken over; Spark looks after the rest."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is None or self.table != "terms" or f.attribute not in (("term",), ("version",)):
                yield f
            elif f.attribute == ("term",):
                # A term is asked for only where the options name it, or where they name none.
                self.terms = [t for t in self.terms if t in values] if self.terms else [v for v in values if v and v.strip()]
                self.impossible |= not self.terms
            elif isinstance(f, EqualTo) and not self.version:
                self.version = values[0]
            else:
                self.impossible |= self.version not in values

    def partitions(self) -> list[InputPartition]:
        terms = [] if self.impossible or self.table == "versions" else self.terms
        return [Terms(terms[i :: self.parts]) for i in range(max(1, min(self.parts, len(terms))))]

    def _fetch(self, kind: str, path: str, **parameters: object) -> str | None:
        if self.base.startswith(("http://", "https://")):
            asked = Request(f"{self.base}/{path}" + (f"?{urlencode(parameters)}" if parameters else ""), headers={"Accept": "application/fhir+json", "Accept-Language": self.language, **self.headers})
            with urlopen(asked, timeout=TIMEOUT_S) as answer:
                return answer.read().decode("utf-8")
        file = Path(self.base.removeprefix("file://")) / answer_name(kind, **parameters)
        return file.read_text(encoding="utf-8") if file.exists() else None

    def expansion(self, term: str, page: int) -> dict[str, object]:
        """Parameters of one page of a term's expansion."""
        out = {"url": self.value_set, "filter": term, "count": self.page, "offset": page * self.page, "includeDesignations": "true", "displayLanguage": self.language}
        return out | ({"system-version": self.version} if self.version else {})

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.table == "versions":
            yield from self._versions()
            return
        for term in partition.terms:
            for page in range(MOST_PAGES):
                answer = self._fetch("expand", "ValueSet/$expand", **self.expansion(term, page))
                if answer is None:
                    break
                yield term, self.version or None, page, answer
                try:
                    expansion = json.loads(answer).get("expansion") or {}
                except (ValueError, AttributeError):
                    break
                if not expansion.get("contains") or (page + 1) * self.page >= int(expansion.get("total") or 0):
                    break

    def _versions(self) -> Iterator[tuple]:
        clean = lambda x: (x or "").strip() or None
        try:
            bundle = json.loads(self._fetch("versions", "CodeSystem", url="http://snomed.info/sct") or "{}")
        except (OSError, ValueError):  # the metadata may still answer
            bundle = {}
        found: dict[str, tuple] = {}
        for entry in bundle.get("entry") or []:
            resource = entry.get("resource") or {}
            version = clean(resource.get("version"))
            if version:
                found.setdefault(version, (version, clean(resource.get("title") or resource.get("name")), clean(resource.get("url")), "CodeSystem"))
        if not found:
            metadata = json.loads(self._fetch("metadata", "metadata") or "{}")
            told = (("Server software version", (metadata.get("software") or {}).get("version")), ("FHIR version", metadata.get("fhirVersion")))
            named = [(clean(v), title, None, "metadata") for title, v in told if clean(v)]
            described = clean((metadata.get("implementation") or {}).get("description"))
            found = {str(i): row for i, row in enumerate(named or ([(described, "Implementation description", None, "metadata")] if described else []))}
        yield from found.values()
