"""Queries over single references: scans, contents, paths, keys, chunks, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions import references as R
from marram.functions import text as X
from marram.operators import chunking, keywords, tables
from marram.plans.registry import KEYWORDS, REFS, SECTION, WORDS, query
from marram.sources.views import references, table

LONG = "long"


@query(f"WITH {REFS} SELECT reference_id, guideline_id, n_chars FROM refs WHERE reference_group_id = 'en' AND guideline_id = 'src3' AND n_chars >= 500")
def ref_scan_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    return tables.where_equal(refs, reference_group_id="en", guideline_id="src3", type=None).where("n_chars >= 500").select("reference_id", "guideline_id", "n_chars")


@query(
    """WITH g AS (SELECT source AS title, source || '-' || lang AS register_number, upper(source) || '/' || lang AS full_number, max(doc_id) AS id FROM documents GROUP BY 1, 2, 3),
keys AS (SELECT DISTINCT source AS key FROM documents UNION SELECT DISTINCT source || '-' || lang FROM documents UNION SELECT 'nothing'),
hit AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY id DESC) AS r FROM keys JOIN g ON key = title OR key = register_number OR key = full_number)
SELECT key, id FROM hit WHERE r = 1"""
)
def ref_resolve_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    numbered = documents.select(F.col("source").alias("title"), F.concat_ws("-", "source", "lang").alias("register_number"), F.concat_ws("/", F.upper("source"), "lang").alias("full_number"), "doc_id")
    guidelines = numbered.groupBy("title", "register_number", "full_number").agg(F.max("doc_id").alias("id"))
    keys = documents.select(F.col("source").alias("key")).unionByName(documents.select(F.concat_ws("-", "source", "lang").alias("key"))).distinct()
    return tables.resolve(keys, guidelines, ["title", "register_number", "full_number"], "id").select("key", "id")


VARIANTS = """CASE doc_id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 2 THEN 'table' WHEN 3 THEN 'recommendation' WHEN 4 THEN 'statement' ELSE 'metadata' END AS type,
 text AS contained_text, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS caption, text AS describing_text, '|' || lang || '|' AS plain_text, CASE WHEN doc_id % 12 = 2 THEN '' ELSE '| ' || text || ' |' END AS table_markdown,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS title, text AS content, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'A' END AS grade, CASE WHEN doc_id % 12 = 5 THEN 'Heading1' ELSE 'Note' END AS metadata_type, text AS metadata_content"""


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as references of all six types."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id as reference_id", *_split(VARIANTS))


def _split(sql: str) -> list[str]:
    """Select-list items of ``sql``: commas outside quotes and parentheses."""
    out, depth, quoted, last = [], 0, False, 0
    for i, c in enumerate(sql):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not quoted and not depth:
            out.append(sql[last:i])
            last = i + 1
    return [*out, sql[last:]]


@query(
    f"""WITH v AS (SELECT doc_id AS reference_id, {VARIANTS} FROM documents),
c AS (SELECT *, CASE WHEN coalesce(caption, '') <> '' THEN 'caption: ' || caption ELSE '' END AS cap, CASE WHEN coalesce(grade, '') <> '' THEN chr(10) || '(' || grade || ')' ELSE '' END AS g FROM v)
SELECT reference_id, type, sha256(CASE type WHEN 'text' THEN coalesce(contained_text, '') WHEN 'image' THEN cap || coalesce(describing_text, '')
 WHEN 'table' THEN CASE WHEN cap || coalesce(table_markdown, '') <> '' THEN cap || coalesce(table_markdown, '') ELSE coalesce(plain_text, '') END
 WHEN 'recommendation' THEN coalesce(title, 'None') || ': ' || coalesce(content, '') || g
 WHEN 'statement' THEN CASE WHEN coalesce(title, '') <> '' THEN title || ': ' ELSE '' END || coalesce(content, '') || g ELSE coalesce(metadata_content, '') END) AS content_sha FROM c"""
)
def content_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).select("reference_id", "type", F.sha2(R.content(), 256).alias("content_sha"))


@query(
    f"""WITH v AS (SELECT doc_id AS reference_id, {VARIANTS} FROM documents)
SELECT reference_id, sha256(nullif(regexp_replace(CASE type WHEN 'text' THEN contained_text WHEN 'image' THEN concat_ws(' ', caption, describing_text) WHEN 'table' THEN concat_ws(' ', caption, plain_text)
 WHEN 'metadata' THEN CASE WHEN metadata_type NOT LIKE '%Heading%' THEN metadata_content END ELSE concat_ws(' ', title, content) END, '^\\s+|\\s+$', '', 'g'), '')) AS ingest_sha FROM v"""
)
def ingest_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).select("reference_id", F.sha2(R.ingest_content(skip_headings=True), 256).alias("ingest_sha"))


@query(
    f"""WITH {REFS} SELECT reference_id, reference_group_id || ' > B' || bucket AS titles_path, reference_group_id || ' / B' || bucket AS filter_path,
 '1 ' || reference_group_id || ' / 1.' || bucket || ' B' || bucket AS numbered_path FROM refs"""
)
def heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("hierarchy")
    return references(spark, sf_dir).select("reference_id", R.titles_path(h).alias("titles_path"), R.titles_path(h, " / ").alias("filter_path"), R.numbered_path(h).alias("numbered_path"))


@query(
    f"""WITH {REFS}, p AS (SELECT reference_id, reference_group_id AS g, guideline_id AS s, bucket AS b, unnest([1, 2, 3]) AS depth FROM refs)
SELECT reference_id, depth::BIGINT AS depth, substr(sha1(g || '|' || s || '|1|1|' || g || CASE WHEN depth > 1 THEN '|2|1.' || b || '|B' || b ELSE '' END || CASE WHEN depth > 2 THEN '|3||' ELSE '' END), 1, 20) AS node,
 s || '::1|' || g || '|0' || CASE WHEN depth > 1 THEN '/1.' || b || '|B' || b || '|1' ELSE '' END || CASE WHEN depth > 2 THEN '/||2' ELSE '' END AS section FROM p"""
)
def ancestor_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = references(spark, sf_dir).select("reference_id", "reference_group_id", "guideline_id", F.explode(R.prefixes(F.col("hierarchy"))).alias("path"))
    node = R.node_id(F.col("reference_group_id"), F.col("guideline_id"), F.col("path"))
    return each.select("reference_id", F.size("path").cast(LONG).alias("depth"), node.alias("node"), R.section_key(F.col("guideline_id"), F.col("path")).alias("section"))


@query(f"WITH {REFS}, {KEYWORDS} SELECT reference_id, keyword FROM kw")
def keyword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marram.sources.views import keywords as of

    return of(references(spark, sf_dir))


@query(
    f"""SELECT doc_id AS reference_id, len(list_distinct(list_filter({WORDS}, lambda x: length(x) >= 3))) AS n_tokens,
 sha256(regexp_replace(regexp_replace(lower(text), '[^0-9A-Za-zÄÖÜäöüß]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS metric_sha, length(regexp_replace(text, '\\s', '', 'g')) AS units,
 sha256(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS key_sha,
 sha256(regexp_replace(regexp_replace(lower(text), '[\\x{{2010}}-\\x{{2015}}\\-_/]', ' ', 'g'), '\\.+$', '')) AS dash_sha FROM documents"""
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("reference_id"), F.size(X.query_tokens(t)).cast(LONG).alias("n_tokens"), F.sha2(X.metric_text(t), 256).alias("metric_sha"), X.unit_count(t).alias("units"), F.sha2(X.keyword_key(t), 256).alias("key_sha"),
        F.sha2(X.dash_key(t), 256).alias("dash_sha"),
    )


@query(
    f"""WITH {REFS} SELECT reference_id, sha256('Source: ' || guideline_id || chr(10) || 'Text: ' || substr(text, 1, 300) || chr(10) || 'B' || bucket) AS serialised,
 CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substr(text, 1, 77), '\\s+$', '') || '...' END AS preview, sha256(substr(reference_group_id || ' > B' || bucket || chr(10) || chr(10) || text, 1, 4000)) AS similarity FROM refs"""
)
def serialize_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    selectors = [{"path": "guideline_id", "label": "Source"}, {"path": "text", "label": "Text", "max_chars": 300}, {"path": "hierarchy.1.title"}]
    similarity = X.similarity_text(R.titles_path(F.col("hierarchy")), F.col("text"))
    return references(spark, sf_dir).select("reference_id", F.sha2(R.serialised(selectors), 256).alias("serialised"), X.shorten(F.col("text"), 80).alias("preview"), F.sha2(similarity, 256).alias("similarity"))


@query(
    """WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS rest, 0 AS i, NULL::VARCHAR AS chunk FROM documents
UNION ALL SELECT doc_id, CASE WHEN length(rest) <= 400 THEN '' ELSE regexp_replace(substr(rest, cut + 1), '^\\s+', '') END, i + 1, CASE WHEN length(rest) <= 400 THEN rest ELSE regexp_replace(substr(rest, 1, cut), '\\s+$', '') END
FROM (SELECT *, CASE WHEN regexp_matches(substr(rest, 401, 1), '\\s') THEN 400 WHEN strpos(reverse(substr(rest, 1, 400)), ' ') IN (0, 400) THEN 400 ELSE 400 - strpos(reverse(substr(rest, 1, 400)), ' ') END AS cut FROM t) WHERE rest <> '')
SELECT doc_id AS reference_id, (i - 1)::BIGINT AS chunk_index, sha256(chunk) AS chunk_sha FROM t WHERE i > 0"""
)
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.split(references(spark, sf_dir), "fixed_characters", 400)
    return chunks.select("reference_id", F.col("chunk_index").cast(LONG).alias("chunk_index"), F.sha2("chunk", 256).alias("chunk_sha"))


@query(
    """WITH t AS (SELECT doc_id, regexp_replace(text, '([.!?])\\n', '\\1' || chr(10) || chr(10), 'g') AS text FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '(?:\\r?\\n){2,}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM t)
SELECT doc_id AS reference_id, (i - 1)::BIGINT AS chunk_index, sha256(parts[i]) AS chunk_sha FROM p, LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i)"""
)
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"([.!?])\n", "$1\n\n"))
    return chunking.split(refs, "paragraph").select("reference_id", F.col("chunk_index").cast(LONG).alias("chunk_index"), F.sha2("chunk", 256).alias("chunk_sha"))


# A mark ends a sentence before white space or the end; of what another mark breaks off only whole lines stay.
SENTENCES = r"""WITH m AS (SELECT doc_id, coalesce(text, '') AS t, string_split(regexp_replace(coalesce(text, ''), '([.!?]+)(\s|$)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS pieces FROM documents),
p AS (SELECT doc_id, t, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM m),
s AS (SELECT doc_id, i, list_transform(regexp_extract_all(piece, '[^.!?]+[.!?]*'), lambda x: x) AS segs FROM p),
e AS (SELECT doc_id, i, unnest(segs) AS seg, generate_subscripts(segs, 1) AS j, len(segs) AS k FROM s),
c AS (SELECT doc_id, i, j, regexp_replace(CASE WHEN j = k THEN seg ELSE regexp_extract(seg, '(?s)^(.*)\n', 1) END, '^\s+|\s+$', '', 'g') AS chunk FROM e),
f AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS chunk_index FROM c WHERE chunk <> '')
SELECT doc_id AS reference_id, chunk_index, chunk FROM f
UNION ALL SELECT doc_id, 0, CASE WHEN regexp_replace(t, '^\s+|\s+$', '', 'g') <> '' THEN regexp_replace(t, '^\s+|\s+$', '', 'g') ELSE t END FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = m.doc_id)"""


@query(SENTENCES)
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split(references(spark, sf_dir), "sentence").select("reference_id", F.col("chunk_index").cast(LONG).alias("chunk_index"), "chunk")


@query(
    f"""WITH {REFS}, n AS (SELECT reference_id, bucket, row_number() OVER (PARTITION BY reference_group_id, bucket ORDER BY reference_id) - 1 AS new_order, reference_group_id FROM refs)
SELECT reference_id, new_order AS last_order FROM n"""
)
def chunk_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = F.lit(None).cast("array<struct<page:int,positions:array<double>>>")
    done = chunking.reindex(references(spark, sf_dir).withColumn("bboxs", boxes))
    return done.select("reference_id", F.element_at("hierarchy", -1)["order"].cast(LONG).alias("last_order"))


@query(f"WITH {REFS} SELECT reference_id, row_number() OVER (PARTITION BY guideline_id ORDER BY reference_id) - 1 AS chunk_index FROM refs WHERE n_chars >= 200")
def ingest_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marram.functions.ranking import positions

    kept = references(spark, sf_dir).where("n_chars >= 200").select("reference_id", "guideline_id")
    return positions(kept, "guideline_id", ["reference_id"], "chunk_index").select("reference_id", "chunk_index")


@query(
    f"""WITH w AS (SELECT doc_id AS id, unnest({WORDS}) AS phrase FROM documents), c AS (SELECT id, phrase, count(*) AS frequency FROM w WHERE length(phrase) >= 6 GROUP BY 1, 2)
SELECT id, phrase, frequency, row_number() OVER (PARTITION BY id ORDER BY frequency DESC, length(phrase) DESC, phrase) AS place FROM c"""
)
def keyword_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = keywords.dealt(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return keywords.ranked(texts.select("id", F.explode(X.all_tokens(F.col("text"), 6)).alias("phrase"))).withColumn("place", F.col("place").cast(LONG))


@query(
    f"""WITH b AS (SELECT item_id AS id, {WORDS} AS w FROM benchmark), n AS (SELECT id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM b),
p AS (SELECT DISTINCT id, w[i] AS phrase FROM n WHERE length(w[i]) >= 3 UNION SELECT DISTINCT id, w[i] || ' ' || w[i + 1] FROM n WHERE i % 3 = 0 AND length(w[i]) >= 3 AND length(w[i + 1]) >= 3)
SELECT id, phrase FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.id = a.id AND length(b.phrase) > length(a.phrase) AND (' ' || b.phrase || ' ') LIKE ('% ' || a.phrase || ' %')
 AND len(string_split(b.phrase, ' ')) > len(string_split(a.phrase, ' ')))"""
)
def suppress_subphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), X.all_tokens(F.col("text"), 0).alias("w")).withColumn("i", F.explode(F.expr("sequence(1, greatest(size(w) - 2, 1))"))).where("i <= size(w) - 2")
    at = words.select("id", "i", F.expr("w[i - 1]").alias("a"), F.expr("w[i]").alias("b")).where("length(a) >= 3")
    phrases = at.select("id", F.col("a").alias("phrase")).unionByName(at.where("i % 3 = 0 and length(b) >= 3").select("id", F.concat_ws(" ", "a", "b").alias("phrase"))).distinct()
    return keywords.without_subphrases(phrases)


@query(
    f"""WITH t AS (SELECT doc_id, list_distinct(list_filter({WORDS}, lambda x: length(x) >= 10)) AS a, list_distinct(list_filter({WORDS}, lambda x: length(x) % 2 = 0 AND length(x) >= 8)) AS b FROM documents)
SELECT doc_id AS reference_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS all_of, array_to_string(list_sort(list_intersect(a, b)), ',') AS both_of FROM t"""
)
def keyword_union_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = X.all_tokens(F.col("text"))
    a, b = F.array_distinct(F.filter(words, lambda w: F.length(w) >= 10)), F.array_distinct(F.filter(words, lambda w: (F.length(w) % 2 == 0) & (F.length(w) >= 8)))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("reference_id"), a.alias("a"), b.alias("b"))
    union, overlap = keywords.union_and_overlap(F.col("a"), F.col("b"))
    return rows.select("reference_id", F.array_join(union, ",").alias("all_of"), F.array_join(overlap, ",").alias("both_of"))


@query()
def keyword_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.extract(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(
    """WITH e AS (SELECT event_id, '[{"id": ' || event_id || ', "keep": ' || CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END || '}]' AS body FROM events),
a AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN body WHEN 1 THEN 'Sure: ' || body || ' done' ELSE 'no answer' END AS answer FROM e)
SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_id END AS id, CASE WHEN event_id % 3 < 2 THEN event_id % 3 = 0 END AS keep FROM a"""
)
def llm_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('[{"id": '), F.col("event_id").cast("string"), F.lit(', "keep": '), F.when(F.col("event_id") % 3 == 0, "true").otherwise("false"), F.lit("}]"))
    kind = F.col("event_id") % 3
    answer = F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Sure: "), body, F.lit(" done"))).otherwise("no answer")
    found = table(spark, sf_dir, "events").select("event_id", F.get(X.json_array(answer, "array<struct<id:bigint,keep:boolean>>"), F.lit(0)).alias("d"))
    return found.select("event_id", "d.id", "d.keep")


@query(
    """SELECT page_id, len(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1)) AS n_paragraphs, len(string_split(url, '/')) AS url_parts, try_cast(regexp_extract(url, '([0-9]+)', 1) AS BIGINT) AS first_number FROM pages"""
)
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    paragraphs = F.regexp_extract_all("html", F.lit("(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    number = F.regexp_extract("url", "([0-9]+)", 1).try_cast("bigint")
    return table(spark, sf_dir, "pages").select("page_id", F.size(paragraphs).cast(LONG).alias("n_paragraphs"), F.size(F.split("url", "/")).cast(LONG).alias("url_parts"), number.alias("first_number"))


@query(f"WITH {REFS} SELECT DISTINCT guideline_id, {SECTION} AS section_key FROM refs")
def leaf_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(spark, sf_dir).select("guideline_id", R.section_key(F.col("guideline_id"), F.col("hierarchy")).alias("section_key")).distinct()
