"""Queries over chats, runs, reviews, CSV exchange, metrics and workflows."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions.text import metric_text
from marram.operators import catalog, evaluation, rank, search, tables
from marram.plans.registry import WORDS, query
from marram.plans.search_queries import BM25
from marram.plans.workflow import Context, Workflow
from marram.sources.views import references, table, text_index, text_queries

LONG = "long"
STATUS = "CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'queued' ELSE 'completed' END"
SAMPLES = f"s AS (SELECT user_id AS run_id, event_id AS sample_id, CASE WHEN user_id % 3 = 0 AND event_id % 7 < 2 THEN 'completed' WHEN user_id % 3 = 1 AND event_id % 7 = 1 THEN 'completed' ELSE {STATUS} END AS status, ts, event_type FROM events)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.col("event_id") % 7
    run = F.col("user_id") % 3
    status = F.when((run == 0) & (left < 2), "completed").when((run == 1) & (left == 1), "completed").when(left == 0, "failed").when(left == 1, "queued").otherwise("completed")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sample_id"), status.alias("status"), "ts", "event_type")


TASKS = "t AS (SELECT event_id AS task_id, user_id AS run_id, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'claimed' ELSE 'open' END AS status, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'u' || event_id % 5 END AS assigned_to, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'u' || event_id % 4 END AS claimed_by FROM events)"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("event_type")).first()[0]
    claimed = F.col("event_type") == first
    user = lambda n: F.concat(F.lit("u"), (F.col("event_id") % n).cast("string"))
    return events.select(
        F.col("event_id").alias("task_id"), F.col("user_id").alias("run_id"), F.when(claimed, "claimed").otherwise("open").alias("status"), F.when(F.col("event_id") % 3 != 0, user(5)).alias("assigned_to"),
        F.when(claimed, user(4)).alias("claimed_by"),
    )


@query(
    f"""WITH {SAMPLES}, {TASKS}, o AS (SELECT run_id, count(*) AS open_tasks FROM t WHERE status = 'open' GROUP BY 1),
c AS (SELECT run_id, count(*) AS total, count(*) FILTER (status IN ('completed', 'failed')) AS done, count(*) FILTER (status = 'failed') AS failed FROM s GROUP BY 1)
SELECT run_id, total, done, failed, coalesce(open_tasks, 0) AS open_tasks, CASE WHEN done < total THEN 'running' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status FROM c LEFT JOIN o USING (run_id)"""
)
def run_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.run_status(_samples(spark, sf_dir), _tasks(spark, sf_dir))


@query(f"WITH {TASKS} SELECT task_id, status FROM t WHERE (status = 'claimed' AND claimed_by = 'u2') OR (status = 'open' AND (assigned_to IS NULL OR assigned_to = 'u2'))")
def review_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tasks(spark, sf_dir).where(evaluation.visible_to("u2")).select("task_id", "status")


CLAIMS = "cl AS (SELECT event_id AS task_id, 'u' || event_id % 5 AS user_id, ts FROM events UNION ALL SELECT event_id, 'u' || event_id % 3, ts - INTERVAL 1 MINUTE FROM events)"


@query(
    f"""WITH {TASKS}, {CLAIMS}, w AS (SELECT task_id, user_id, row_number() OVER (PARTITION BY task_id ORDER BY ts, user_id) AS r FROM cl JOIN t USING (task_id) WHERE status = 'open' AND (assigned_to IS NULL OR assigned_to = user_id))
SELECT t.task_id, CASE WHEN w.user_id IS NOT NULL THEN 'claimed' ELSE status END AS status, coalesce(w.user_id, claimed_by) AS claimed_by FROM t LEFT JOIN w ON w.task_id = t.task_id AND r = 1"""
)
def review_claim_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    claims = events.selectExpr("event_id as task_id", "concat('u', event_id % 5) as user_id", "ts").unionByName(events.selectExpr("event_id as task_id", "concat('u', event_id % 3) as user_id", "ts - interval 1 minute as ts"))
    return evaluation.claim(_tasks(spark, sf_dir), claims).select("task_id", "status", "claimed_by")


@query(
    f"""WITH {SAMPLES}, a AS (SELECT sample_id AS q, 'u' || sample_id % 5 AS user_id FROM s WHERE sample_id % 2 = 0 UNION ALL SELECT sample_id, 'u9' FROM s WHERE sample_id % 4 = 0)
SELECT run_id, sample_id, (SELECT min(user_id) FROM a WHERE q = sample_id) AS assigned_to FROM s"""
)
def review_task_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir).withColumn("question_id", F.col("sample_id"))
    user = F.concat(F.lit("u"), (F.col("sample_id") % 5).cast("string"))
    assigned = samples.where("sample_id % 2 = 0").select("question_id", user.alias("user_id"), F.lit(1).alias("seq")).unionByName(samples.where("sample_id % 4 = 0").select("question_id", F.lit("u9").alias("user_id"), F.lit(2).alias("seq")))
    return evaluation.review_tasks(samples, "mixed", assigned)


@query("WITH f AS (SELECT conv_id, turn FROM conversations WHERE length(text) % 5 = 0), n AS (SELECT conv_id, turn, count(*) AS c FROM f GROUP BY 1, 2) SELECT c.conv_id, c.turn, coalesce(n.c, 0) AS n_feedback FROM conversations c LEFT JOIN n USING (conv_id, turn)")
def feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    counts = turns.where("length(text) % 5 = 0").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("c"))
    return turns.join(counts, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("c", F.lit(0).cast(LONG)).alias("n_feedback"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def chat_history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.history(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query(
    r"""WITH p AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, lag(sha256(t)) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_sha, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_number FROM p WHERE t <> ''"""
)
def previous_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marram.functions.ranking import with_previous
    from marram.functions.text import collapse

    rows = table(spark, sf_dir, "conversations").withColumn("t", collapse(F.col("text"))).where("t <> ''").select("conv_id", "turn", F.sha2("t", 256).alias("sha"))
    return with_previous(rows, "conv_id", ["turn"], ["sha"]).select("conv_id", "turn", "previous_sha", (F.col("pos") + 1).alias("turn_number"))


ISLANDS = """e AS (SELECT event_id, user_id, event_type, value, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT e.*, sum(n) OVER (PARTITION BY user_id ORDER BY ev.ts, e.event_id)::BIGINT AS run FROM e JOIN (SELECT event_id, ts FROM events) ev USING (event_id))"""


@query(f"WITH {ISLANDS} SELECT user_id, run, event_type, count(*) AS n_rows, min(event_id) AS first_event FROM g GROUP BY 1, 2, 3")
def csv_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = tables.runs(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], ["event_type"])
    return marked.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_event"))


@query(
    """WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant')
SELECT 'c' || a.conv_id || '-' || a.turn AS "Question ID", CASE WHEN a.conv_id % 2 = 0 THEN 'even' ELSE '' END AS "Question group", coalesce(b.text, '') AS "Retrieval Text", a.text AS "Question" FROM a LEFT JOIN b USING (conv_id, turn)"""
)
def csv_export_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marram.sources.files import SNIPPET, export

    turns = table(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer_text"))
    blank = F.lit("")
    snippet = F.struct(*[(F.col("answer_text") if f.name == "retrieval_text" else blank).alias(f.name) for f in SNIPPET.fields])
    entries = turns.where("role = 'user'").join(answers, ["conv_id", "turn"], "left").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("question_id"), (F.col("conv_id") % 2).alias("question_group_id"), blank.alias("super_class"), blank.alias("sub_class"), F.col("text").alias("question"),
        blank.alias("answer"), blank.alias("note"), F.when(F.col("answer_text").isNotNull(), F.array(snippet)).alias("expected_retrieval"),
    )
    groups = spark.createDataFrame([(0, "even")], "group_id long, name string")
    return export(entries, groups).select("Question ID", "Question group", "Retrieval Text", "Question")


PAIRS = """a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant'),
pr AS (SELECT 'c' || a.conv_id || '-' || a.turn AS id, a.text AS expected, b.text AS actual FROM a JOIN b USING (conv_id, turn))"""
NORM = "regexp_replace(regexp_replace(lower({}), '[^0-9A-Za-zÄÖÜäöüß]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("actual"))
    return turns.where("role = 'user'").join(answers, ["conv_id", "turn"]).select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), F.col("text").alias("expected"), "actual")


@query(
    f"""WITH {PAIRS}, n AS (SELECT id, {NORM.format("expected")} AS e, {NORM.format("actual")} AS a FROM pr), k AS (SELECT *, list_filter(string_split(e, ' '), lambda x: x <> '') AS we, list_filter(string_split(a, ' '), lambda x: x <> '') AS wa FROM n),
o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(list_intersect(we, wa)), lambda w: least(len(list_filter(we, lambda x: x = w)), len(list_filter(wa, lambda x: x = w))))), 0)::DOUBLE AS shared,
 len(list_distinct(list_concat(we, wa))) AS u, len(list_distinct(list_intersect(we, wa))) AS i FROM k), p AS (SELECT *, CASE WHEN len(wa) > 0 THEN shared / len(wa) ELSE 0.0 END AS pr, CASE WHEN len(we) > 0 THEN shared / len(we) ELSE 0.0 END AS rc FROM o)
SELECT id, CASE WHEN e = a AND e <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6)::DOUBLE AS token_f1, round(CASE WHEN u > 0 THEN i / u::DOUBLE ELSE 0.0 END, 6)::DOUBLE AS jaccard FROM p"""
)
def lexical_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.lexical(_pairs(spark, sf_dir))


@query()
def sequence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select("id", metric_text(F.col("expected")).alias("e"), metric_text(F.col("actual")).alias("a"))
    return rows.select("id", evaluation.sequence_ratio("e", "a").alias("sequence_ratio"))


@query()
def retrieval_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = text_index(spark, sf_dir).top(text_queries(spark, sf_dir), 3)
    texts = references(spark, sf_dir).select("reference_id", "text")
    actual = hits.join(texts, "reference_id").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("actual"))
    samples = text_queries(spark, sf_dir).join(actual, "query_id", "left").select(F.col("query_id").alias("id"), F.array("text").alias("expected"), "actual")
    return evaluation.retrieval(samples)


@query("SELECT DISTINCT source AS guideline_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def guideline_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_semi").select(F.col("source").alias("guideline_id")).distinct()


@query("SELECT doc_id, source AS guideline_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def guideline_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("source").alias("guideline_id"))


@query("SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents UNION ALL SELECT -doc_id - 1, source, n_chars FROM documents WHERE doc_id % 10 = 1")
def table_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    changed = documents.where("doc_id % 10 = 0").withColumn("n_chars", F.col("n_chars") + 1)
    new = documents.where("doc_id % 10 = 1").withColumn("doc_id", -F.col("doc_id") - 1)
    return tables.upsert(documents, changed.unionByName(new), ["doc_id"])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def table_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    return tables.delete(table(spark, sf_dir, "documents").select("doc_id", "source"), doomed, ["doc_id"])[0]


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def evaluator_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("seen", F.struct("ts", "event_id"))
    return tables.newest(events, "user_id", "seen").select("user_id", "event_id", "event_type")


@query("WITH l AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, event_id, CASE WHEN p IS NOT NULL THEN round((epoch_us(ts) - epoch_us(p)) / 1e6, 3) END AS latency FROM l")
def event_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marram.functions.ranking import with_previous
    from marram.functions.text import seconds_between

    rows = with_previous(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], ["ts"])
    return rows.select("user_id", "event_id", F.round(seconds_between(F.col("previous_ts"), F.col("ts")), 3).alias("latency"))


MERGE = """m AS (SELECT source AS query_id, doc_id AS seq, [lang, source, lang] AS ids, CASE WHEN doc_id % 4 = 0 THEN 'n/a' ELSE (doc_id % 4)::VARCHAR END AS latency FROM documents),
fl AS (SELECT query_id, seq, i, ids[i] AS id FROM m, (SELECT unnest([1, 2, 3]) AS i)), ff AS (SELECT query_id, id, min({'s': seq, 'i': i}) AS f FROM fl GROUP BY 1, 2),
fs AS (SELECT query_id, array_to_string(list(id ORDER BY f), ',') AS ids FROM ff GROUP BY 1)"""


@query(f"WITH {MERGE} SELECT query_id, coalesce(sum(try_cast(latency AS DOUBLE)), 0) AS latency, count(*) * 3 AS received, any_value(fs.ids) AS ids FROM m JOIN fs USING (query_id) GROUP BY 1")
def merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    latency = F.when(F.col("doc_id") % 4 == 0, "n/a").otherwise((F.col("doc_id") % 4).cast("string"))
    items = F.array(*[F.struct(F.col(c).alias("id")) for c in ("lang", "source", "lang")])
    results = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("seq"), items.alias("items"), latency.alias("latency"))
    return rank.merge(results).select("query_id", F.coalesce("latency", F.lit(0.0)).alias("latency"), "received", F.array_join(F.transform("items", lambda x: x["id"]), ",").alias("ids"))


DECISION = {
    "nodes": [
        {"component_id": "start", "type": "start"},
        {"component_id": "size", "type": "decision/expression", "parameters": {"expression": "length({text}) >= 200", "labels": ["long", "short"]}},
        {"component_id": "which", "type": "decider", "parameters": {"value": "{size.label}", "cases": {"long": "tell", "short": "end_short"}}},
        {"component_id": "tell", "type": "transform/template", "parameters": {"template": "long {query_id}"}},
        {"component_id": "end_long", "type": "end", "parameters": {"response": "{tell.query}"}},
        {"component_id": "end_short", "type": "end", "parameters": {"response": "short {query_id}"}},
    ],
    "edges": [{"source": "start", "target": "size"}, {"source": "size", "target": "which"}, {"source": "tell", "target": "end_long"}],
}


@query("SELECT doc_id AS query_id, CASE WHEN length(text) >= 200 THEN 'long ' ELSE 'short ' END || doc_id AS response FROM documents")
def decision_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return Workflow(DECISION).run(rows)


LISTING = {
    "nodes": [
        {"component_id": "start", "type": "start"},
        {"component_id": "find", "type": "retrieve/table", "parameters": {"table": "hits", "limit": 4}},
        {"component_id": "each", "type": "list/map", "parameters": {"items": "{find.items}", "child": {"type": "transform/template", "parameters": {"template": "{query_id}:{item.id}"}}}},
        {"component_id": "end", "type": "end", "parameters": {"items": "{each.results}"}},
    ],
    "edges": [{"source": "start", "target": "find"}, {"source": "find", "target": "each"}, {"source": "each", "target": "end"}],
}


@query(f"WITH {BM25} SELECT item_id AS query_id, array_to_string(list(item_id || ':' || reference_id ORDER BY rank), ',') AS items FROM benchmark JOIN bt ON query_id = item_id WHERE rank <= 4 GROUP BY 1")
def list_explode_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = text_queries(spark, sf_dir)
    hits = text_index(spark, sf_dir).top(queries, 4)
    done = Workflow(LISTING).run(queries, Context(tables={"hits": hits}))
    return done.where("items is not null").select("query_id", F.array_join("items", ",").alias("items"))


@query(f"SELECT item_id AS query_id, len(list_distinct(list_filter({WORDS}, lambda x: length(x) >= 3))) AS n FROM benchmark")
def query_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marram.functions.text import query_tokens

    return text_queries(spark, sf_dir).select("query_id", F.size(query_tokens(F.col("text"))).cast(LONG).alias("n"))


@query()
def worker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open runs taken by the streaming worker from a folder of run rows, and what it wrote."""
    from marram.plans.scratch import scratch_path
    from marram.streaming import worker

    base = scratch_path(spark, "worker")
    samples = _samples(spark, sf_dir)
    samples.write.parquet(f"{base}/in")
    taken = worker.start(spark, f"{base}/in", samples.schema, lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{base}/out"), f"{base}/checkpoint", every=None)
    taken.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("run_id").agg(F.count(F.lit(1)).alias("taken"))


KINDS = "CASE event_id % 4 WHEN 0 THEN 'Simple' WHEN 1 THEN 'complex ' WHEN 2 THEN 'NEGATIVE' ELSE 'other' END AS c, CASE event_id % 5 WHEN 0 THEN 'Recommendatoin' WHEN 1 THEN 'multi-step  reasoning' WHEN 2 THEN 'Mal/formed' WHEN 3 THEN 'Table' ELSE 'unknown' END AS s"


@query(
    f"""WITH e AS (SELECT event_id, {KINDS} FROM events), n AS (SELECT event_id, lower(trim(c)) AS c, CASE s WHEN 'Recommendatoin' THEN 'recommendation' WHEN 'multi-step  reasoning' THEN 'multi_step_reasoning' WHEN 'Mal/formed' THEN 'malformed' WHEN 'Table' THEN 'table' END AS s FROM e)
SELECT event_id, CASE WHEN (c = 'simple' AND s IN ('recommendation', 'table')) OR (c = 'complex' AND s = 'multi_step_reasoning') OR (c = 'negative' AND s = 'malformed') THEN c || '/' || s END AS class FROM n"""
)
def classification_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id", KINDS.split(", CASE event_id % 5")[0], "CASE event_id % 5" + KINDS.split(", CASE event_id % 5")[1])
    found = rows.select("event_id", catalog.classification(F.col("c"), F.col("s")).alias("k"))
    return found.select("event_id", F.when(F.col("k").isNotNull(), F.concat_ws("/", "k.super_class", "k.sub_class")).alias("class"))


@query(
    """WITH g AS (SELECT 'c' || conv_id AS question_group_id, 'c' || conv_id || '-' || turn AS question_id, text AS question FROM conversations WHERE role = 'user')
SELECT 'run' AS run_id, question_id, 'queued' AS status, length(question) AS n_chars FROM g"""
)
def run_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    questions = turns.select(F.concat(F.lit("c"), F.col("conv_id")).alias("question_group_id"), F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("question_id"), F.col("text").alias("question"), F.lit("").alias("expected_answer"))
    return catalog.create_run(questions, "run").select("run_id", "question_id", "status", F.length("question").cast(LONG).alias("n_chars"))


@query(f"WITH {SAMPLES} SELECT run_id, sample_id, CASE WHEN run_id = 7 THEN 'queued' ELSE status END AS status, CASE WHEN run_id <> 7 THEN event_type END AS answer FROM s")
def run_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir).withColumnRenamed("event_type", "answer")
    return catalog.rerun(samples, _tasks(spark, sf_dir), 7)[0].select("run_id", "sample_id", "status", "answer")


@query(
    """WITH g AS (SELECT conv_id, turn, length(text) % 3 AS rating FROM conversations WHERE length(text) % 2 = 0), u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant')
SELECT g.conv_id, g.turn, rating, sha256(u.text) AS question_sha, sha256(a.text) AS answer_sha FROM g JOIN u USING (conv_id, turn) LEFT JOIN a USING (conv_id, turn)"""
)
def feedback_denormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations")
    given = chats.where("length(text) % 2 = 0").select("conv_id", "turn", (F.length("text") % 3).cast(LONG).alias("rating"))
    return catalog.feedback(chats, given).select("conv_id", "turn", "rating", F.sha2("question", 256).alias("question_sha"), F.sha2("answer", 256).alias("answer_sha"))


@query(
    """WITH r AS (SELECT doc_id AS reference_id, source AS guideline_id, lang, least(n_chars // 1000, 5) AS bucket, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content FROM documents),
k AS (SELECT * FROM r WHERE content <> '')
SELECT reference_id, guideline_id, row_number() OVER (PARTITION BY guideline_id ORDER BY lang, bucket, reference_id) - 1 AS chunk_index, sha256(content) AS content_sha, '1 ' || lang || ' / 1.' || bucket || ' B' || bucket AS headers FROM k"""
)
def vector_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    blank = {c: F.lit(None).cast("string") for c in ("caption", "describing_text", "plain_text", "title", "content", "metadata_type", "metadata_content")}
    rows = catalog.ingest(refs.withColumn("contained_text", F.col("text")).withColumns(blank).drop("content").withColumn("content", F.lit(None).cast("string")))
    return rows.select("reference_id", "guideline_id", "chunk_index", F.sha2("content", 256).alias("content_sha"), "headers")


@query("SELECT source AS guideline_id, lang AS reference_group_id, count(*) AS n_references, max(doc_id) AS newest, bool_or(n_chars > 5000) AS has_long FROM documents GROUP BY 1, 2")
def guideline_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("guideline_id"), F.col("lang").alias("reference_group_id"))
    return groups.agg(F.count(F.lit(1)).alias("n_references"), F.max("doc_id").alias("newest"), F.bool_or(F.col("n_chars") > 5000).alias("has_long"))


@query(f"WITH {SAMPLES} SELECT run_id, bool_or(status IN ('queued', 'running')) AS active, count(DISTINCT event_type) AS n_workflows FROM s GROUP BY 1")
def active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).groupBy("run_id").agg(F.bool_or(F.col("status").isin("queued", "running")).alias("active"), F.count_distinct("event_type").alias("n_workflows"))


@query(f"WITH {SAMPLES} SELECT DISTINCT event_type AS workflow_id FROM s WHERE event_type NOT IN (SELECT event_type FROM s WHERE run_id = 7 AND status = 'failed')")
def unknown_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    known = samples.where("run_id = 7 and status = 'failed'").select(F.col("event_type").alias("workflow_id")).distinct()
    return samples.select(F.col("event_type").alias("workflow_id")).distinct().join(known, "workflow_id", "left_anti")


ORACLE_STREAM = f"WITH {SAMPLES} SELECT run_id, count(*) AS taken FROM s WHERE status IN ('queued', 'running') GROUP BY 1"
