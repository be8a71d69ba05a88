"""Collections, chats, runs and feedback as tables (SRC2, SRC3, SRC11, SRC14, SRC17, SRC18, S12, S13, E1, E5, E8, E9, P15)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marram.functions.ranking import positions
from marram.functions.references import hierarchy_order, ingest_content, numbered_path
from marram.sources.providers import asked

# Property types of a collection and the distances it may name.
PROPERTY_TYPES: dict[str, T.DataType] = {
    "text": T.StringType(), "int": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "date": T.TimestampType(), "uuid": T.StringType(), "blob": T.BinaryType(), "object": T.StringType(),
    "geocoordinates": T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())]),
    "phonenumber": T.StructType([T.StructField("input", T.StringType()), T.StructField("country", T.StringType())]),
}
DISTANCES = ("cosine", "dot", "l2-squared", "manhattan", "hamming")
# Classes of questions, their subclasses, and other spellings of them.
SUBCLASSES = {
    "simple": ("text", "recommendation", "table", "statement", "image"),
    "complex": ("multiple_guidelines", "multiple_sections_same_guideline", "synonym", "multi_step_reasoning"),
    "negative": ("outside_medicine", "outside_omfs", "outside_guidelines", "malformed", "patient_specific", "false_assumption"),
}
SPELLINGS = {
    "recommendatoin": "recommendation",
    "multiple sections": "multiple_sections_same_guideline",
    "multiple sections same guidleine": "multiple_sections_same_guideline",
    "same guideline multiple sections": "multiple_sections_same_guideline",
    "multi step resoning": "multi_step_reasoning",
    "muliiti step resoning": "multi_step_reasoning",
    "mal formed": "malformed",
}


@dataclass(frozen=True)
class Collection:
    """A vector collection: typed properties, named vectors with their distance."""

    name: str
    properties: dict[str, str]
    vectors: dict[str, str]

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Z][A-Za-z0-9_]*", self.name):
            raise ValueError("a collection's name begins with a capital letter")
        for kind in self.properties.values():
            if kind.removesuffix("[]") not in PROPERTY_TYPES:
                raise ValueError(f"unknown property type {kind}")
        if not self.vectors or any(d not in DISTANCES for d in self.vectors.values()):
            raise ValueError("a collection has named vectors with known distances")
        if set(self.properties) & set(self.vectors):
            raise ValueError("a property and a vector share a name")

    def schema(self) -> T.StructType:
        """uuid, the properties, and a column per named vector, so that unused vectors are pruned."""
        kinds = {n: T.ArrayType(PROPERTY_TYPES[k[:-2]]) if k.endswith("[]") else PROPERTY_TYPES[k] for n, k in self.properties.items()}
        fields = [T.StructField("uuid", T.StringType()), *(T.StructField(n, k) for n, k in kinds.items())]
        return T.StructType([*fields, *(T.StructField(n, T.ArrayType(T.FloatType())) for n in self.vectors)])

    def create(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema())


def registered(spark: SparkSession, collections: list[Collection]) -> DataFrame:
    """Collections as a table: name, properties, vectors (SRC14)."""
    rows = [(c.name, c.properties, c.vectors) for c in collections]
    return spark.createDataFrame(rows, "name string, properties map<string,string>, vectors map<string,string>")


def collection(registry: DataFrame, name: str) -> Collection:
    """One collection of a registry; an unknown name is an error."""
    found = registry.where(F.col("name") == name).limit(1).collect()
    if not found:
        raise KeyError(f"no collection {name}")
    return Collection(found[0]["name"], found[0]["properties"], found[0]["vectors"])


def dropped(registry: DataFrame, name: str) -> DataFrame:
    return registry.where(F.col("name") != name)


def mapped_fields(refs: DataFrame, guidelines: DataFrame) -> DataFrame:
    """reference_id and the five mapped properties (P3): reference_type, headers, guideline_title (register number and
    title), guideline_keywords (keywords, goal, patients and care area, what is null left out) and reference_keywords.

    refs: reference_id, guideline_id, type, hierarchy, keywords. guidelines: guideline_id, register_number, title,
    keywords, goal, patients, care_area."""
    lists = F.concat(F.coalesce("g_keywords", F.array().cast("array<string>")), F.array("goal", "patients", "care_area"))
    joined = refs.join(guidelines.withColumnRenamed("keywords", "g_keywords"), "guideline_id", "left")
    return joined.select(
        "reference_id", F.col("type").alias("reference_type"), numbered_path(F.col("hierarchy")).alias("headers"), F.trim(F.concat_ws(" ", "register_number", "title")).alias("guideline_title"),
        F.array_join(F.array_compact(lists), "; ").alias("guideline_keywords"), F.array_join(F.array_compact(F.coalesce("keywords", F.array().cast("array<string>"))), "; ").alias("reference_keywords"),
    )


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` and new rows, columns by name, missing ones null (SRC11)."""
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def by_id(table: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Point lookups in one join (SRC2)."""
    return wanted.join(table, column)


def ingest(refs: DataFrame, group: str = "guideline_id", skip_headings: bool = False) -> DataFrame:
    """Rows for a collection (S12): references with content, their index inside the guideline in hierarchy
    order (skipped ones don't count), content and headers."""
    kept = refs.withColumn("content", ingest_content(skip_headings)).where("content is not null")
    order = hierarchy_order(F.col(group), F.col("hierarchy"), F.col("reference_id"))[1:]
    return positions(kept, group, order, "chunk_index").select("reference_id", group, "chunk_index", "content", numbered_path(F.col("hierarchy")).alias("headers"))


def embedded(rows: DataFrame, embed: Callable, text: str = "content", go_on: bool = True) -> DataFrame:
    """rows with ``vector`` and ``error`` (S12): a row whose text the model fails on has no vector and says why;
    without ``go_on`` it fails the job. ``embed`` takes a text, or a list of texts where it is marked as batched."""

    def run(batches):
        for pdf in batches:
            values, vectors, errors = pdf[text].tolist(), [], []
            try:
                vectors = [[float(x) for x in v] for v in asked(embed, values)] if getattr(embed, "batched", False) else None
                errors = [None] * len(values)
            except Exception:  # one of the batch: which, is seen one by one
                if not go_on:
                    raise
                vectors = None
            if vectors is None:
                vectors, errors = [], []
                for value in values:
                    try:
                        vectors.append([float(x) for x in asked(embed, [value])[0]])
                        errors.append(None)
                    except Exception as failure:  # whatever a model raises
                        if not go_on:
                            raise
                        vectors.append(None)
                        errors.append(str(failure))
            yield pdf.assign(vector=vectors, error=errors)

    ddl = ", ".join(f"`{n}` {t}" for n, t in rows.drop("vector", "error").dtypes)
    return rows.drop("vector", "error").mapInPandas(run, f"{ddl}, vector array<double>, error string")


def objects(collection_rows: DataFrame, group: str, wanted: DataFrame) -> DataFrame:
    """Objects by guideline and index in it (S13); wanted: the group's column and chunk_index."""
    return wanted.join(collection_rows, [group, "chunk_index"])


def replace_group(collection: DataFrame, rows: DataFrame, group: str, value) -> DataFrame:
    """``collection`` with one group's objects replaced (delete and insert of S12)."""
    return collection.where(~F.col(group).eqNullSafe(F.lit(value))).unionByName(rows.where(F.col(group).eqNullSafe(F.lit(value))))


def classification(super_class: Column, sub_class: Column) -> Column:
    """struct(super_class, sub_class) in the known spelling, null if the pair isn't known."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[/_\-\s]+", " "))
    known = {s.replace("_", " "): s for subs in SUBCLASSES.values() for s in subs} | SPELLINGS
    spelled = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[key(sub_class)]
    whole = F.lower(F.trim(super_class))
    pair = F.concat_ws("/", whole, spelled)
    return F.when(spelled.isNotNull() & pair.isin([f"{c}/{s}" for c, subs in SUBCLASSES.items() for s in subs]), F.struct(whole.alias("super_class"), spelled.alias("sub_class")))


def create_run(questions: DataFrame, run_id: str, group: str | None = None) -> DataFrame:
    """Queued samples of a run from the questions of a group."""
    chosen = questions if group is None else questions.where(F.col("question_group_id") == group)
    return chosen.select(F.lit(run_id).alias("run_id"), "question_id", "question", "expected_answer", F.lit("queued").alias("status"), F.lit(None).cast("string").alias("answer"))


def rerun(samples: DataFrame, tasks: DataFrame, run_id) -> tuple[DataFrame, DataFrame]:
    """Samples of the run reset and queued, its tasks gone."""
    mine = F.col("run_id") == run_id
    reset = samples.withColumn("answer", F.when(mine, F.lit(None)).otherwise(F.col("answer"))).withColumn("status", F.when(mine, "queued").otherwise(F.col("status")))
    return reset, tasks.where(~mine)


def feedback(chats: DataFrame, given: DataFrame) -> DataFrame:
    """given (conv_id, turn, rating) with the question and answer that it is about (J19, E9); unknown turns are dropped."""
    asked = chats.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answered = chats.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return given.join(asked, ["conv_id", "turn"]).join(answered, ["conv_id", "turn"], "left")


def renamed(chats: DataFrame, conv_id, title: str) -> DataFrame:
    """A chat's title set: trimmed, at most 120 characters (SRC17)."""
    name = title.strip()[:120]
    if not name:
        raise ValueError("a title has a character")
    return chats.withColumn("title", F.when(F.col("conv_id") == conv_id, name).otherwise(F.col("title")))


def ask(interactions: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Interactions after a round (C17): the questions are there even where no answer came."""
    return append(interactions, questions.join(answers, ["conv_id", "turn"], "left"))


def without_graph(nodes_or_edges: DataFrame, graph_name: str) -> DataFrame:
    """A graph dropped whole: its partition (SRC18)."""
    return nodes_or_edges.where(F.col("graph_name") != graph_name)


def judge_score(answer: Column) -> Column:
    """struct(similarity, reasoning, status) from a judge's JSON answer, also inside other text (E5)."""
    parsed = F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), "similarity double, reasoning string")
    found = parsed["similarity"].isNotNull() | parsed["reasoning"].isNotNull()
    return F.struct(parsed["similarity"].alias("similarity"), parsed["reasoning"].alias("reasoning"), F.when(found, "ok").otherwise("unavailable").alias("status"))
