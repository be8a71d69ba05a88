"""Queries over single operators: parsing of answers, keywords, collections, listings, runs and sessions."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions import text as X
from marram.operators import boxes, catalog, chunking, evaluation, keywords, rank, tables
from marram.operators.search import rounded
from marram.plans.registry import REFS, WORDS, query
from marram.plans.scratch import scratch_path
from marram.plans.search_queries import BM25
from marram.plans.workflow import Context, Workflow
from marram.sources import files
from marram.sources.providers import batched
from marram.sources.versions import VersionedTable
from marram.sources.views import references, table, text_index, text_queries

LONG = "long"


@query(
    r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '[\x{2010}-\x{2015}\-_/]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS term FROM pages"
)
def term_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.term_key(F.col("url")).alias("term"))


@query("SELECT doc_id, sha256(coalesce(CASE WHEN doc_id % 3 = 0 THEN nullif(text, '') END, CASE WHEN doc_id % 2 = 0 THEN source END, lang, '')) AS found FROM documents")
def retrieval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    properties = F.create_map(F.lit("recommendation_content"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(""), F.lit("caption"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(evaluation.retrieval_text(F.when(F.col("doc_id") % 3 == 0, F.col("text")), properties), 256).alias("found"))


@query("SELECT event_id, trunc(try_cast(h AS DOUBLE))::INT AS page FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '3' WHEN 1 THEN value::VARCHAR WHEN 2 THEN '-2.5' WHEN 3 THEN 'p. 7' WHEN 4 THEN ' 12 ' END AS h FROM events)")
def page_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    hint = F.when(k == 0, "3").when(k == 1, F.col("value").cast("string")).when(k == 2, "-2.5").when(k == 3, "p. 7").when(k == 4, " 12 ")
    return table(spark, sf_dir, "events").select("event_id", X.page_hint(hint).alias("page"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS n, CASE l_linenumber % 4 WHEN 0 THEN l_orderkey % 50 + 1 WHEN 1 THEN 3 END AS page, CASE WHEN l_linenumber % 4 IN (0, 1) THEN l_linenumber::DOUBLE END AS bottom FROM lineitem")
def box_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object, an array of two, one with too few positions, and no JSON."""
    box = lambda page: F.concat(F.lit('{"page": '), page, F.lit(', "positions": [1, 2, 3.5, '), F.col("l_linenumber").cast("string"), F.lit("]}"))
    k = F.col("l_linenumber") % 4
    text = F.when(k == 0, box((F.col("l_orderkey") % 50 + 1).cast("string"))).when(k == 1, F.concat(F.lit("["), box(F.lit("3")), F.lit(", "), box(F.lit("9")), F.lit("]"))).when(k == 2, '[{"page": 2, "positions": [1, 2]}]').otherwise("none")
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.boxes_json(text).alias("b"))
    first = F.get("b", F.lit(0))
    return found.select("l_orderkey", "l_linenumber", F.when(F.col("b").isNotNull(), F.size("b")).alias("n"), first["page"].cast(LONG).alias("page"), F.get(first["positions"], F.lit(3)).alias("bottom"))


ANSWER = "CASE doc_id % 3 WHEN 0 THEN 'Here: [\"' || source || '\", \"q2\"]' WHEN 1 THEN '<query> ' || lang || ' </query> and <QUERY>' || source || '</QUERY>' ELSE '- ' || source || chr(10) || '2. ' || lang || chr(10) || chr(10) || '* last' END"


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || ',q2' WHEN 1 THEN lang || ',' || source ELSE source || ',' || lang || ',last' END AS queries FROM documents")
def answer_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries in a model's answers: JSON, tags, bullets."""
    answers = table(spark, sf_dir, "documents").select("doc_id", F.expr(ANSWER.replace("chr(10)", "'\\n'")).alias("answer"))
    return answers.select("doc_id", F.array_join(X.query_list(F.col("answer")), ",").alias("queries"))


@query("SELECT doc_id, lang || '|' || source AS documents, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS decision FROM documents")
def answer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """<document> texts and yes or no in a model's answers."""
    k = F.col("doc_id") % 4
    said = F.when(k == 0, "Yes, it is.").when(k == 1, "I say: NEIN").when(k == 2, "true").otherwise("perhaps")
    tagged = F.concat(F.lit("<document>\n"), F.col("lang"), F.lit("\n</document> text <Document>"), F.col("source"), F.lit("</Document>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.documents_in(tagged), "|").alias("documents"), X.yes_no(said).alias("decision"))


@query("""SELECT conv_id, sha256(array_to_string(list('<turn role="' || role || '">' || text || '</turn>' ORDER BY turn), chr(10))) AS block FROM conversations GROUP BY 1""")
def history_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", F.sha2(X.history_block(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))), 256).alias("block"))


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_suppkey % 7))), ', ') AS pages, round(CASE WHEN sum(l_linenumber % 4) > 0 THEN count(*) FILTER (l_quantity > 25) / sum(l_linenumber % 4) END, 6) AS ratio FROM lineitem GROUP BY 1")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of page lists, and ratios of backed statements."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey") % 7).alias("p"), F.count_if(F.col("l_quantity") > 25).alias("backed"), F.sum(F.col("l_linenumber") % 4).alias("overall"))
    return per.select("l_orderkey", X.page_label(F.col("p")).alias("pages"), rounded(X.backed_ratio(F.col("backed"), F.col("overall"))).alias("ratio"))


@query(r"SELECT page_id, regexp_matches(url, '(?i)PAGE|[0-9]{2}$') AS matched, contains(lower(html), 'span.') AS literal, contains(lower(url), 'http') OR contains(lower(html), 'nav') AS picked FROM pages")
def text_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive pattern, literal substring, and a picker over two fields."""
    return table(spark, sf_dir, "pages").select("page_id", tables.matches("url", "PAGE|[0-9]{2}$").alias("matched"), tables.contains("html", "SPAN.").alias("literal"), (tables.contains("url", "HTTP") | tables.contains("html", "Nav")).alias("picked"))


@query(
    f"""WITH w AS (SELECT item_id AS id, unnest({WORDS}) AS phrase FROM benchmark), c AS (SELECT id, phrase, count(*) AS frequency FROM w WHERE length(phrase) >= 3 AND phrase NOT IN ('the', 'and') GROUP BY 1, 2)
SELECT id, phrase, frequency, row_number() OVER (PARTITION BY id ORDER BY frequency DESC, length(phrase) DESC, phrase) AS place FROM c"""
)
def keyword_rank_without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = keywords.dealt(text_queries(spark, sf_dir).withColumnRenamed("query_id", "id"))
    return keywords.ranked(texts.select("id", F.explode(X.all_tokens(F.col("text"), 3)).alias("phrase")), ["the", "and"]).withColumn("place", F.col("place").cast(LONG))


@query(
    f"""WITH {REFS}, a AS (SELECT reference_id AS id, ['Zeta-Term.', guideline_id, upper(guideline_id), reference_group_id, 'noise'] AS l FROM refs), u AS (SELECT id, unnest(l) AS p FROM a),
n AS (SELECT id, regexp_replace(regexp_replace(lower(p), '[-_/]', ' ', 'g'), '\\.+$', '') AS phrase FROM u), c AS (SELECT id, phrase, count(*) AS frequency FROM n WHERE phrase NOT IN ('noise', '') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY frequency DESC, length(phrase) DESC, phrase) AS place FROM c) SELECT * FROM r WHERE place <= 2"""
)
def llm_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords in model answers: normalised, noise out, ranked, capped."""
    answer = F.concat(F.lit('```json\n["Zeta-Term.", "'), F.col("guideline_id"), F.lit('", "'), F.upper("guideline_id"), F.lit('", "'), F.col("reference_group_id"), F.lit('", "noise"]\n```'))
    answers = references(spark, sf_dir).select(F.col("reference_id").alias("id"), answer.alias("answer"))
    return keywords.from_answers(answers, ["noise"], 2).withColumn("place", F.col("place").cast(LONG))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A terminology of guideline names in two languages; in the first every third has no synonyms."""
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("term")).distinct().withColumn("k", F.length("term") + F.ascii(F.substring("term", -1, 1)))
    de = names.select("term", F.lit("de").alias("language"), F.when(F.col("k") % 3 != 0, F.array(F.concat("term", F.lit("-de")), F.upper("term"))).otherwise(F.array().cast("array<string>")).alias("synonyms"))
    en = names.where("k % 2 = 0").select("term", F.lit("en").alias("language"), F.array(F.concat("term", F.lit("-en"))).alias("synonyms"))
    return de.unionByName(en)


TERMS = "names AS (SELECT DISTINCT source AS term, length(source) + ascii(right(source, 1)) AS k FROM documents)"
SYNONYMS = "CASE WHEN k % 3 <> 0 THEN [term || '-de', upper(term)] WHEN k % 2 = 0 THEN [term || '-en'] ELSE CAST([] AS VARCHAR[]) END"


@query(f"WITH {TERMS} SELECT doc_id AS id, source AS keyword, array_to_string({SYNONYMS}, ',') AS synonyms FROM documents JOIN names ON term = source")
def terminology_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms in a language, or else in the fallback language."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("keyword"))
    return keywords.expanded(rows, _terms(spark, sf_dir), "de", "en").select("id", "keyword", F.array_join("synonyms", ",").alias("synonyms"))


@query(
    f"""WITH {TERMS}, r AS (SELECT doc_id AS reference_id, source, lang, text, k, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE [lang, upper(source)] END AS found FROM documents JOIN names ON term = source)
SELECT reference_id, found IS NULL OR regexp_replace(coalesce(text, ''), '\\s', '', 'g') = '' AS skipped, CASE WHEN found IS NULL OR regexp_replace(coalesce(text, ''), '\\s', '', 'g') = '' THEN source ELSE source || ',' || lang END AS keywords FROM r"""
)
def keyword_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found keywords after a reference's own, each once whatever its case; references without any are skipped."""
    docs = table(spark, sf_dir, "documents")
    refs = docs.select(F.col("doc_id").alias("reference_id"), F.col("text").alias("content"), F.array("source").alias("keywords"))
    found = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("reference_id"), F.array("lang", F.upper("source")).alias("keywords"))
    return keywords.enriched(refs, found).select("reference_id", "skipped", F.array_join("keywords", ",").alias("keywords"))


@query(
    """WITH t AS (SELECT DISTINCT source AS term, upper(source) AS display FROM documents), k AS (SELECT doc_id AS id, [source, lang, source || '-' || lang] AS l FROM documents),
u AS (SELECT id, i - 1 AS seq, l[i] AS keyword FROM k, (SELECT unnest([1, 2, 3]) AS i))
SELECT id, seq, keyword, display AS canonical_form, CASE WHEN display IS NOT NULL THEN 'c-' || term END AS concept_id FROM u LEFT JOIN t ON term = keyword"""
)
def medical_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords in model answers with end marks and repeats, and their canonical forms."""
    docs = table(spark, sf_dir, "documents")
    answer = F.concat(F.lit('["'), F.col("source"), F.lit('.", "'), F.col("lang"), F.lit('", "'), F.col("source"), F.lit("-"), F.col("lang"), F.lit(';:", "  ", "'), F.upper("source"), F.lit('"]'))
    terms = docs.select(F.col("source").alias("term"), F.upper("source").alias("display"), F.concat(F.lit("c-"), F.col("source")).alias("concept_id")).distinct()
    found = keywords.medical(docs.select(F.col("doc_id").alias("id"), answer.alias("answer")), terms, 3)
    return found.select("id", F.col("seq").cast(LONG).alias("seq"), "keyword", "canonical_form", "concept_id")


@query("SELECT page_id, 'c' || page_id AS concept_id, url || ',' || CASE WHEN page_id % 2 = 0 THEN 'Syn ' || page_id ELSE '' END AS synonyms FROM pages WHERE page_id % 7 <> 0")
def terminology_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a terminology server, and the synonyms in them: the display first, of the language only."""
    id_ = F.col("page_id").cast("string")
    part = lambda lang, use, value: F.concat(F.lit(f'{{"language": "{lang}", "use": {{"display": "{use}"}}, "value": "'), value, F.lit('"}'))
    designations = F.concat_ws(", ", part("de-DE", "Synonym", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Syn "), id_)).otherwise(F.col("url"))), part("en", "Synonym", F.lit("other")), part("de", "Fully specified name", F.lit("full")))
    json = F.when(F.col("page_id") % 7 == 0, '{"expansion": {"total": 0}}').otherwise(F.concat(F.lit('{"expansion": {"contains": [{"code": "c'), id_, F.lit('", "display": "'), F.col("url"), F.lit('", "designation": ['), designations, F.lit("]}]}}")))
    found = keywords.terminology_answers(table(spark, sf_dir, "pages").select(F.col("page_id").alias("term"), json.alias("json")))
    names = keywords.synonyms(found, "de").select("concept_id", "synonyms")
    joined = found.select(F.col("term").alias("page_id"), "concept_id").join(names, "concept_id")
    return joined.select("page_id", "concept_id", F.concat(F.get("synonyms", F.lit(0)), F.lit(","), F.coalesce(F.get("synonyms", F.lit(1)), F.lit(""))).alias("synonyms"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ',' || source ELSE source || ',x,' || lang END AS keywords FROM documents")
def keyword_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings each once whatever their case; new keywords in place of old ones, or after them."""
    new, old = F.array("lang", F.lit(" "), F.upper("lang"), "source"), F.array("source", F.lit("x"))
    replaced, added = keywords.merged(old, new, True), keywords.merged(old, new, False)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.when(F.col("doc_id") % 2 == 0, replaced).otherwise(added), ",").alias("keywords"))


PARAGRAPHS = r"list_filter(list_transform(string_split_regex(t, '\n{2,}'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"
CUT = rf"d AS (SELECT doc_id, source, regexp_replace(text, '([.!?])\n', E'\\1\n\n', 'g') AS t FROM documents), p AS (SELECT doc_id, source, CASE WHEN len({PARAGRAPHS}) > 0 THEN {PARAGRAPHS} ELSE [coalesce(t, '')] END AS parts FROM d)"


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split(references(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"([.!?])\n", "$1\n\n")), "paragraph")


@query(f"WITH {CUT} SELECT count(*) AS source, sum(len(parts))::BIGINT AS created, count(*) FILTER (len(parts) > 1) AS chunked FROM p")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.counts(_cut(spark, sf_dir))


@query(
    f"""WITH {CUT}, t AS (SELECT p.doc_id, unnest(parts) AS c, generate_subscripts(parts, 1) - 1 AS i FROM p JOIN d USING (doc_id) WHERE p.doc_id % 4 <> 0 AND regexp_replace(coalesce(t, ''), '\\s', '', 'g') <> '')
SELECT doc_id AS source_reference_id, doc_id || ':' || i AS reference_id, 'copy' AS reference_group_id, sha256(c) AS content_sha FROM t
UNION ALL SELECT doc_id, doc_id || ':0', 'copy', sha256(t) FROM d WHERE doc_id % 4 = 0"""
)
def chunk_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunked copy of a group: texts are split, tables are copied."""
    refs = references(spark, sf_dir).select("reference_id", "guideline_id", "reference_group_id", F.when(F.col("reference_id") % 4 == 0, "table").otherwise("text").alias("type"), F.regexp_replace("text", r"([.!?])\n", "$1\n\n").alias("contained_text"))
    return chunking.chunked_copy(refs, "copy", "paragraph").select("source_reference_id", "reference_id", "reference_group_id", F.sha2("contained_text", 256).alias("content_sha"))


@query("SELECT doc_id AS reference_id, CASE WHEN source = (SELECT min(source) FROM documents) THEN 'new' ELSE 'old' END AS version FROM documents WHERE source <> (SELECT min(source) FROM documents) OR doc_id % 2 = 0")
def chunk_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One guideline's chunks replaced by new ones, of which there are fewer."""
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("reference_id"), F.col("source").alias("guideline_id"), F.lit("old").alias("version"))
    name = old.agg(F.min("guideline_id")).first()[0]
    return chunking.refresh(old, old.where("reference_id % 2 = 0").withColumn("version", F.lit("new")), name).select("reference_id", "version")


@query("SELECT l_orderkey AS k, l_linenumber AS page, l_quantity >= 5 AND l_quantity * (l_partkey % 60) >= 80 AND NOT (l_quantity <= 10 AND l_partkey % 60 >= 30) AS kept FROM lineitem")
def meaningful_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("page"), boxes.meaningful_column(zero, zero, F.col("l_quantity").cast("double"), (F.col("l_partkey") % 60).cast("double")).alias("kept"))


@query("SELECT l_orderkey AS k, l_suppkey % 5 AS page, count(*) AS n, array_to_string(list(l_linenumber || '/' || l_partkey ORDER BY l_linenumber, l_partkey), ',') AS boxes FROM lineitem GROUP BY 1, 2")
def boxes_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 5).alias("page"), F.col("l_linenumber").alias("x0"), F.col("l_partkey").alias("y0"), F.lit(1).alias("x1"), F.lit(1).alias("y1"))
    found = boxes.by_page(rows, "k")
    return found.select("k", "page", F.size("boxes").cast(LONG).alias("n"), F.array_join(F.transform("boxes", lambda b: F.concat_ws("/", b["x0"].cast("string"), b["y0"].cast("string"))), ",").alias("boxes"))


#: A guideline's first words as its pages' words: word i of the first ten stands at (40 i, 0), the others on lines of ten.
PAGES = r"""d AS (SELECT doc_id, list_filter(string_split_regex(lower(replace(text, 'ß', 'ss')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM d),
q AS (SELECT doc_id, w[4:6] AS q FROM d WHERE doc_id % 50 = 0 AND len(w) >= 6),
hit AS (SELECT q.doc_id, a.pos FROM q JOIN t a ON a.doc_id = q.doc_id AND a.token = q[1] JOIN t b ON b.doc_id = q.doc_id AND b.pos = a.pos + 1 AND b.token = q[2] JOIN t c ON c.doc_id = q.doc_id AND c.pos = a.pos + 2 AND c.token = q[3])"""


def _page_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents that a text is looked up in, which is its own, as lists of words (guideline_id, w), and these words on pages of a hundred."""
    docs = table(spark, sf_dir, "documents").where("text is not null and doc_id % 50 = 0").select(F.col("doc_id").alias("guideline_id"), boxes.tokens(F.col("text")).alias("w"))
    words = docs.select("guideline_id", F.posexplode("w").alias("pos", "text"))
    place = F.col("pos").cast("double")
    return docs, words.select("guideline_id", F.expr("int(pos div 100)").alias("page"), place.alias("x0"), F.expr("double(pos div 10)").alias("y0"), place.alias("x1"), F.lit(0.0).alias("y1"), "text")


@query(f"WITH {PAGES} SELECT DISTINCT doc_id AS text_id, (pos + i) // 100 AS page, (pos + i) AS place FROM hit, (SELECT unnest([0, 1, 2]) AS i)")
def exact_text_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words 4 to 6 of every fiftieth document, looked up among all words: each occurrence, as the places of its words."""
    docs, words = _page_words(spark, sf_dir)
    asked = docs.where("guideline_id % 50 = 0 and size(w) >= 6").select("guideline_id", F.col("guideline_id").alias("text_id"), F.lit(0).alias("first_page"), F.lit(2**30).alias("last_page"), F.lit(3).alias("n"), F.posexplode(F.slice("w", 4, 3)).alias("i", "token"))
    found = boxes.exact_places(asked, boxes.word_tokens(words, asked))
    return found.select("text_id", F.col("page").cast(LONG).alias("page"), F.col("rect.x0").cast(LONG).alias("place"))


@query(
    f"""WITH RECURSIVE {PAGES}, g AS MATERIALIZED (SELECT doc_id, [w[4], w[5], w[7], w[10]] AS q FROM d WHERE doc_id % 50 = 0 AND len(w) >= 10),
one AS MATERIALIZED (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM d WHERE doc_id % 50 = 0 AND len(w) >= 10),
two AS MATERIALIZED (SELECT a.doc_id, a.pos, a.token || b.token AS token FROM one a JOIN one b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1),
sp AS MATERIALIZED (SELECT doc_id, pos AS bg, pos + 1 AS upto, token FROM one UNION ALL SELECT doc_id, pos, pos + 2, token FROM two
  UNION ALL SELECT a.doc_id, a.pos, a.pos + 3, a.token || c.token FROM two a JOIN one c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2),
row4 AS (SELECT doc_id, pos, [token, lead(token, 1) OVER w, lead(token, 2) OVER w, lead(token, 3) OVER w] AS four FROM one WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
exact AS MATERIALIZED (SELECT r.doc_id, pos AS first FROM row4 r JOIN g ON g.doc_id = r.doc_id AND four = g.q),
steps(doc_id, i, first, free, slack, path) AS (SELECT g.doc_id, 1, bg, upto, 500, [[bg, upto]] FROM g JOIN sp ON g.doc_id = sp.doc_id AND token = g.q[1]
  UNION ALL SELECT s.doc_id, s.i + 1, s.first, arg_min(p.upto, p.bg), s.slack - (min(p.bg) - s.free), list_append(s.path, [min(p.bg), arg_min(p.upto, p.bg)])
  FROM steps s JOIN g ON g.doc_id = s.doc_id JOIN sp p ON p.doc_id = s.doc_id AND p.token = g.q[s.i + 1] AND p.bg >= s.free AND p.bg <= s.free + least(250, s.slack) WHERE s.i < 4 GROUP BY s.doc_id, s.i, s.first, s.free, s.slack, s.path),
whole AS MATERIALIZED (SELECT doc_id, first, free, path FROM steps WHERE i = 4 AND doc_id NOT IN (SELECT doc_id FROM exact)),
kept(doc_id, first) AS (SELECT doc_id, min(first) FROM whole GROUP BY 1 UNION ALL SELECT k.doc_id, min(o.first) FROM kept k JOIN whole m ON m.doc_id = k.doc_id AND m.first = k.first JOIN whole o ON o.doc_id = k.doc_id AND o.first >= m.free GROUP BY k.doc_id, k.first),
used AS (SELECT doc_id, unnest(path) AS p FROM whole JOIN kept USING (doc_id, first))
SELECT DISTINCT doc_id AS text_id, place // 100 AS page, place FROM (SELECT doc_id, unnest(range(p[1], p[2])) AS place FROM used UNION ALL SELECT doc_id, first + i FROM exact, (SELECT unnest([0, 1, 2, 3]) AS i))"""
)
def gapped_text_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words 4, 5, 7 and 10 of every fiftieth document as a text, looked up among all words, with gaps where it doesn't stand as it is."""
    docs, words = _page_words(spark, sf_dir)
    some = F.concat_ws(" ", *[F.get("w", F.lit(i)) for i in (3, 4, 6, 9)])
    none = F.lit(None).cast("int")
    asked = docs.where("guideline_id % 50 = 0 and size(w) >= 10").select("guideline_id", F.col("guideline_id").alias("text_id"), some.alias("text"), none.alias("first_page"), none.alias("last_page"))
    found = boxes.found_places(asked, words)
    return found.select("text_id", F.col("page").cast(LONG).alias("page"), F.col("rect.x0").cast(LONG).alias("place"))


MERGING = {
    "nodes": [
        {"component_id": "start", "type": "start"},
        {"component_id": "a", "type": "retrieve/table", "parameters": {"table": "hits", "limit": 3}},
        {"component_id": "b", "type": "retrieve/table", "parameters": {"table": "hits", "limit": 5}},
        {"component_id": "both", "type": "merge/items", "parameters": {"inputs": ["{b.items}", "{a.items}"], "limit": 4}},
        {"component_id": "end", "type": "end", "parameters": {"items": "{both.items}"}},
    ],
    # Of two edges from one node the last one wins.
    "edges": [{"source": "start", "target": "end"}, {"source": "start", "target": "a"}, {"source": "a", "target": "b"}, {"source": "b", "target": "both"}, {"source": "both", "target": "end"}],
}


@query(f"WITH {BM25} SELECT query_id, array_to_string(list(reference_id ORDER BY rank), ',') AS items FROM bt WHERE rank <= 4 GROUP BY 1")
def workflow_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marram.operators import search

    queries = text_queries(spark, sf_dir)
    done = Workflow(MERGING).run(queries, Context(tables={"hits": text_index(spark, sf_dir).top(queries, 5)}))
    return done.where("items is not null").select("query_id", F.array_join(F.transform("items", lambda x: x["id"].cast("string")), ",").alias("items"))


AUGMENTING = {
    "nodes": [
        {"component_id": "start", "type": "start"},
        {"component_id": "more", "type": "transform/augment", "parameters": {"provider": "split", "prompt": "{prompt}", "max_queries": 3}},
        {"component_id": "which", "type": "decider", "parameters": {"value": "{more.query}", "cases": {"none": "empty"}, "default_case": None}},
        {"component_id": "some", "type": "end", "parameters": {"items": "{more.queries}"}},
        {"component_id": "empty", "type": "end", "parameters": {"items": "{more.queries}"}},
    ],
    "edges": [{"source": "start", "target": "more"}, {"source": "more", "target": "which"}, {"source": "which", "target": "some"}],
}


@query("SELECT doc_id AS query_id, CASE WHEN doc_id % 2 = 0 THEN source || ',' || source || ' b' ELSE source || ',' || lang || ',c' END AS items FROM documents")
def workflow_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query, then a provider's queries, each once whatever its case, at most three; asked once though a decider follows."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("text"), F.concat_ws("|", "source", F.when(F.col("doc_id") % 2 == 1, F.col("lang"))).alias("prompt"))

    def split(prompt: str) -> str:
        name, _, lang = prompt.partition("|")
        return f'["{lang}", "c", "d"]' if lang else f"- {name.upper()}\n- {name}  b"

    return Workflow(AUGMENTING).run(rows, Context(providers={"split": split})).select("query_id", F.array_join("items", ",").alias("items"))


@query(
    """WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, sha256(q.text) AS question_sha, sha256(a.text) AS answer_sha FROM q LEFT JOIN a USING (conv_id, turn)"""
)
def chat_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds appended to a chat table: questions are there even where no answer came."""
    turns = table(spark, sf_dir, "conversations")
    questions = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    old = questions.join(answers, ["conv_id", "turn"], "left").where("conv_id % 2 = 0")
    done = catalog.ask(old, questions.where("conv_id % 2 <> 0"), answers)
    return done.select("conv_id", "turn", F.sha2("question", 256).alias("question_sha"), F.sha2("answer", 256).alias("answer_sha"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN round(value, 2) WHEN 1 THEN NULL END AS similarity, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_type END AS reasoning, CASE WHEN event_id % 3 = 2 THEN 'unavailable' ELSE 'ok' END AS status FROM events")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's JSON inside other text, without a score, and without JSON."""
    k = F.col("event_id") % 3
    reason = F.concat(F.lit('"reasoning": "'), F.col("event_type"), F.lit('"}'))
    answer = F.when(k == 0, F.concat(F.lit('Sure: {"similarity": '), F.round("value", 2).cast("string"), F.lit(", "), reason, F.lit(" ok"))).when(k == 1, F.concat(F.lit("{"), reason)).otherwise("no JSON")
    return table(spark, sf_dir, "events").select("event_id", catalog.judge_score(answer).alias("j")).select("event_id", "j.*")


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 100 = 0) ON o_custkey = c_custkey UNION ALL SELECT -c_custkey, NULL, c_nationkey FROM customer WHERE c_custkey % 97 = 0")
def lookup_and_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups as a join, and rows appended by column name."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    wanted = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.col("o_custkey").alias("c_custkey")).distinct()
    found = catalog.by_id(customers, "c_custkey", wanted).select(*customers.columns)
    return catalog.append(found, customers.where("c_custkey % 97 = 0").select("c_nationkey", (-F.col("c_custkey")).alias("c_custkey")))


@query("SELECT conv_id, CASE WHEN conv_id = (SELECT min(conv_id) FROM conversations) THEN 'New title' ELSE 'old' END AS title FROM conversations WHERE turn = (SELECT min(turn) FROM conversations) AND conv_id % 10 <> 3")
def chats_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat renamed, and a graph's rows dropped whole."""
    turns = table(spark, sf_dir, "conversations")
    first = turns.agg(F.min("turn"), F.min("conv_id")).first()
    chats = turns.where(F.col("turn") == first[0]).select("conv_id", F.lit("old").alias("title"), (F.col("conv_id") % 10).cast("string").alias("graph_name"))
    return catalog.without_graph(catalog.renamed(chats, first[1], "  New title "), "3").drop("graph_name")


@query("""SELECT doc_id, coalesce(text, '') AS text, lang FROM documents""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes and line ends through a CSV file and a stored snapshot that replaces an older one."""
    base = scratch_path(spark, "csv")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/csv")
    back = files.read_csv(spark, f"{base}/csv").select(F.col("doc_id").cast(LONG).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    files.save_snapshot(rows.limit(1), f"{base}/table")
    files.save_snapshot(back, f"{base}/table")
    return spark.read.parquet(f"{base}/table")


@query("SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) AS present, length(trim(o_orderpriority)) >= 6 AS long_enough, CASE WHEN o_orderkey % 5 < 3 THEN ['a', 'b', 'c'][o_orderkey % 5 + 1] END AS item FROM orders WHERE o_orderstatus IS NOT NULL AND trim(o_orderstatus) <> ''")
def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields, an index that may be out of range, a least length, and whether a key is there."""
    orders = tables.required(table(spark, sf_dir, "orders"), "o_orderstatus")
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    item = tables.item_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("o_orderkey") % 5).cast("int"))
    return tables.present(orders, known, "o_custkey").select("o_orderkey", "present", tables.long_enough("o_orderpriority", 6).alias("long_enough"), item.alias("item"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey OFFSET 10 LIMIT 25")
def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a listing, newest first: a top-k report."""
    orders = tables.columns_of(table(spark, sf_dir, "orders"), keep=["o_orderkey", "o_orderdate"])
    return tables.listing(orders, "o_orderdate", "o_orderkey", skip=10, limit=25)


@query(f"WITH {REFS} SELECT reference_id, row_number() OVER (PARTITION BY guideline_id ORDER BY bucket, reference_id) AS place FROM refs")
def reading_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of references in a reader: by the orders of their hierarchy, then page, then title."""
    from marram.functions.ranking import positions

    refs = references(spark, sf_dir).drop("text")
    page = F.when(F.col("reference_id") % 2 == 0, F.col("reference_id"))
    placed = positions(refs, "guideline_id", tables.reading_order(F.col("guideline_id"), page), "place")
    return placed.select("reference_id", (F.col("place") + 1).alias("place"))


@query(
    """WITH t AS (SELECT doc_id AS reference_id, source, coalesce(regexp_extract(text, '[A-Za-zÀ-ÿ]+'), '') AS title FROM documents)
SELECT reference_id, row_number() OVER (PARTITION BY source ORDER BY title COLLATE de, reference_id) AS place FROM t"""
)
def titles_in_locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of references by their titles (here a text's first word) as a German reader expects them: umlauts beside their letters,
    capitals after small letters."""
    from marram.functions.ranking import positions

    refs = references(spark, sf_dir).select("reference_id", "guideline_id", F.coalesce(F.regexp_extract("text", "[A-Za-zÀ-ÿ]+", 0), F.lit("")).alias("title"))
    placed = positions(refs, "guideline_id", [tables.locale_key(F.col("title"), "de"), F.col("reference_id")], "place")
    return placed.select("reference_id", (F.col("place") + 1).alias("place"))


@query(
    f"""WITH {REFS}, n AS (SELECT reference_group_id AS g, guideline_id AS d, bucket, reference_id, unnest([1, 2, 3]) AS l FROM refs),
k AS (SELECT substr(sha1(g || '|' || d || '|1|1|' || g || CASE WHEN l > 1 THEN '|2|1.' || bucket || '|B' || bucket ELSE '' END || CASE WHEN l > 2 THEN '|3||' ELSE '' END), 1, 20) AS node, bucket, reference_id FROM n)
SELECT node, reference_id, row_number() OVER (PARTITION BY node ORDER BY bucket, reference_id) - 1 AS place FROM k"""
)
def hierarchy_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marram.operators import hierarchy

    return hierarchy.descendants(references(spark, sf_dir).drop("text"))


@query(
    """WITH q AS (SELECT doc_id AS query_id, CASE doc_id % 3 WHEN 0 THEN [{'t': ' ', 'w': 2.0}, {'t': source, 'w': NULL}, {'t': ' ' || lang, 'w': 0.5}] WHEN 1 THEN [{'t': '', 'w': 1.0}] ELSE [] END AS l, source FROM documents),
k AS (SELECT query_id, source, list_filter(l, lambda x: trim(x.t) <> '') AS l FROM q)
SELECT query_id, i AS subquery, trim(l[i].t) AS text, coalesce(l[i].w, 1.0)::DOUBLE AS weight FROM k, LATERAL (SELECT unnest(generate_series(1, len(l))) AS i) UNION ALL SELECT query_id, 1, source, 1.0 FROM k WHERE len(l) = 0"""
)
def subquery_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank queries are skipped; where none is left the default is asked."""
    from marram.operators import search

    one = lambda text, weight: F.struct(text.alias("text"), weight.cast("double").alias("weight"))
    k, none = F.col("doc_id") % 3, F.lit(None)
    lists = F.when(k == 0, F.array(one(F.lit(" "), F.lit(2.0)), one(F.col("source"), none), one(F.concat(F.lit(" "), F.col("lang")), F.lit(0.5)))).when(k == 1, F.array(one(F.lit(""), F.lit(1.0)))).otherwise(F.array().cast("array<struct<text:string,weight:double>>"))
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("default"), lists.alias("queries"))
    return search.subqueries(asked).withColumn("subquery", F.col("subquery").cast(LONG))


@query(
    """WITH g AS (SELECT DISTINCT source, length(source) % 2 AS k FROM documents)
SELECT doc_id AS reference_id, 'text' AS reference_type, '1 ' || lang || ' / 1.' || least(n_chars // 1000, 5) || ' B' || least(n_chars // 1000, 5) AS headers, 'R-' || source || ' Title ' || source AS guideline_title,
 CASE WHEN k = 0 THEN 'kw; goal ' || source ELSE 'kw; ' || source || '; adults' END AS guideline_keywords, lang || '; x' AS reference_keywords FROM documents JOIN g USING (source)"""
)
def mapped_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir).drop("text").withColumn("keywords", F.array("reference_group_id", F.lit(None), F.lit("x")))
    names = refs.select("guideline_id").distinct()
    even = F.length("guideline_id") % 2 == 0
    guidelines = names.select(
        "guideline_id", F.concat(F.lit("R-"), F.col("guideline_id")).alias("register_number"), F.concat(F.lit("Title "), F.col("guideline_id")).alias("title"), F.array(F.lit("kw"), F.when(~even, F.col("guideline_id"))).alias("keywords"),
        F.when(even, F.concat(F.lit("goal "), F.col("guideline_id"))).alias("goal"), F.when(~even, "adults").alias("patients"), F.lit(None).cast("string").alias("care_area"),
    )
    return catalog.mapped_fields(refs, guidelines)


@query("SELECT doc_id, CASE WHEN length(source || lang) % 2 = 0 THEN length(source || lang)::DOUBLE END AS first, CASE WHEN length(source || lang) % 2 <> 0 THEN 'odd ' || lang END AS error FROM documents")
def vectors_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that fails on some texts: the others get their vectors."""

    def model(text: str) -> list[float]:
        if len(text) % 2:
            raise ValueError(f"odd {text[-2:]}")
        return [len(text), 1]

    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", "lang").alias("content"))
    return catalog.embedded(rows, model).select("doc_id", F.get("vector", F.lit(0)).alias("first"), "error")


@query(f"WITH {REFS}, p AS (SELECT reference_id, guideline_id, row_number() OVER (PARTITION BY guideline_id ORDER BY bucket, reference_id) - 1 AS chunk_index FROM refs) SELECT guideline_id, chunk_index, reference_id FROM p WHERE chunk_index IN (0, 7, 40)")
def objects_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marram.sources.views import placed

    rows = placed(references(spark, sf_dir).select("reference_id", "guideline_id", "bucket")).withColumnRenamed("pos", "chunk_index")
    wanted = rows.select("guideline_id").distinct().withColumn("chunk_index", F.explode(F.array(*[F.lit(k).cast(LONG) for k in (0, 7, 40)])))
    return catalog.objects(rows, "guideline_id", wanted).select("guideline_id", "chunk_index", "reference_id")


TAKEN = "CASE WHEN event_id % 4 = 0 THEN 'completed' WHEN event_id % 4 = 1 THEN 'claimed' ELSE 'open' END AS status, CASE WHEN event_id % 4 = 1 THEN 'u' || event_id % 3 END AS claimed_by, CASE WHEN event_id % 5 = 0 THEN 'u' || event_id % 2 END AS assigned_to"


@query(
    f"""WITH t AS (SELECT event_id AS task_id, {TAKEN} FROM events), s AS (SELECT event_id AS task_id, 'u' || k AS user_id, 10 - k AS ts, event_id % 3 AS overall, CASE WHEN event_id % 2 = 0 THEN 1 END AS backed FROM events, (SELECT unnest([0, 1]) AS k)),
ok AS (SELECT s.*, row_number() OVER (PARTITION BY task_id ORDER BY ts) AS n FROM s JOIN t USING (task_id) WHERE status <> 'completed' AND (claimed_by IS NULL OR claimed_by = user_id) AND (assigned_to IS NULL OR assigned_to = user_id))
SELECT task_id, CASE WHEN o.user_id IS NOT NULL THEN 'completed' ELSE status END AS status, coalesce(o.user_id, claimed_by) AS claimed_by, round(CASE WHEN overall > 0 THEN coalesce(backed, 0) / overall END, 6) AS ratio FROM t LEFT JOIN (SELECT * FROM ok WHERE n = 1) o USING (task_id)"""
)
def review_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two submissions for each task: the first that its state lets in completes it."""
    events = table(spark, sf_dir, "events")
    work = events.selectExpr("event_id as task_id", *TAKEN.split(", CASE")[:1], *[f"CASE{x}" for x in TAKEN.split(", CASE")[1:]])
    sent = events.select(F.col("event_id").alias("task_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    sent = sent.select("task_id", F.concat(F.lit("u"), F.col("k")).alias("user_id"), (10 - F.col("k")).alias("ts"), (F.col("task_id") % 3).alias("fact_count_overall"), F.when(F.col("task_id") % 2 == 0, 1).alias("fact_count_backed"))
    return evaluation.submit(work, sent)[0].select("task_id", "status", "claimed_by", F.col("factuality_ratio").alias("ratio"))


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    runs = events.groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("created_at")).withColumn("status", F.when(F.col("run_id") % 3 == 0, "completed").when(F.col("run_id") % 3 == 1, "running").otherwise("queued"))
    status = F.when(F.col("event_id") % 5 == 0, "completed").when(F.col("event_id") % 5 == 1, "failed").otherwise("queued")
    return runs, events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sample_id"), F.col("event_type").alias("question"), F.lit(None).cast("string").alias("answer"), status.alias("status"))


@query(
    """WITH e AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'queued' END AS s, user_id % 3 <> 0 AND event_id % 5 > 1 AS due, event_type = (SELECT min(event_type) FROM events) AS bad FROM events)
SELECT user_id AS run_id, event_id AS sample_id, CASE WHEN due AND NOT bad THEN upper(event_type) END AS answer, CASE WHEN NOT due THEN s WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN due AND bad THEN 'refused' END AS error FROM e"""
)
def run_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open runs' samples answered by a provider that fails on some; terminal samples stay."""
    runs, samples = _evaluated(spark, sf_dir)
    worst = samples.agg(F.min("question")).first()[0]

    def ask(question: str) -> str:
        if question == worst:
            raise ValueError("refused")
        return question.upper()

    return evaluation.process(runs, samples, ask).select("run_id", "sample_id", "answer", "status", "error")


@query("WITH r AS (SELECT user_id AS run_id, min(ts) AS created_at FROM events GROUP BY 1) SELECT run_id, row_number() OVER (ORDER BY created_at, run_id) - 1 AS place FROM r WHERE run_id % 3 <> 0")
def run_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.waiting(_evaluated(spark, sf_dir)[0]).select("run_id", "place")


@query(
    """WITH p AS (SELECT user_id AS id, min(event_type) AS t FROM events GROUP BY 1), w AS (SELECT id, t, id % 4 + 1 AS n FROM p)
SELECT id, 1.0::DOUBLE AS precision, round(length(t) / (length(t) + n * 2.0), 6) AS recall, CASE WHEN id % 2 = 0 THEN 0.0::DOUBLE END AS exact_match,
 CASE WHEN id % 2 = 0 THEN round(2.0 / (2 + n), 6) END AS token_f1, CASE WHEN id % 2 = 0 THEN 0.5::DOUBLE END AS jaccard, CASE WHEN id % 2 = 0 THEN round(2.0 * length(t) / (2 * length(t) + 3 * n), 6) END AS sequence_ratio FROM w"""
)
def sample_metric_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of samples whose texts differ: an answer that lacks one to four repeats of a word behind its first, and found text that
    lacks the same; retrieval for all, answers' metrics where an answer is expected."""
    per = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.min("event_type").alias("t"))
    longer = F.concat("t", F.expr("repeat(' qq', cast(id % 4 + 1 as int))"))
    samples = per.select("id", F.when(F.col("id") % 2 == 0, longer).otherwise(" ").alias("expected_answer"), F.upper("t").alias("answer"), F.array(longer).alias("expected"), F.array("t").alias("actual"))
    found = evaluation.sample_metrics(samples)
    return found.select("id", "precision", "recall", "exact_match", "token_f1", "jaccard", "sequence_ratio")


@query(
    """WITH t AS (SELECT conv_id, turn, role, text, conv_id % 3 = 0 AND turn = 1 AND role = 'assistant' AS failed, turn * 60 + CASE WHEN conv_id % 5 = 0 AND turn >= 2 THEN 7200 ELSE 0 END AS said FROM conversations),
w AS (SELECT *, lead(failed) OVER c AS next_failed, coalesce(said - lag(said) OVER c > 3600, false) AS cut FROM t WINDOW c AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, sum(cut::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS session FROM w),
k AS (SELECT *, NOT failed AND NOT (role = 'user' AND coalesce(next_failed, false)) AS held FROM s), l AS (SELECT conv_id, max(session) AS session FROM k GROUP BY 1)
SELECT 's' || l.conv_id AS session_id, coalesce(n, 0)::INT AS turns, last_role, sha256(last_text) AS last_sha, l.session::INT AS expired
FROM l LEFT JOIN (SELECT conv_id, session, count(*) AS n, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_text FROM k WHERE held GROUP BY 1, 2) h ON h.conv_id = l.conv_id AND h.session = l.session"""
)
def session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a stream in two runs over one checkpoint, each session's history as keyed state; the state after the last batch. In every third conversation the
    first answer fails, which takes its question back; in every fifth the third turn comes after two hours, when the session has expired."""
    from marram.streaming import sessions

    base = scratch_path(spark, "sessions")
    turn, conv = F.col("turn"), F.col("conv_id")
    failed = (conv % 3 == 0) & (turn == 1) & (F.col("role") == "assistant")
    at = turn * 60 + F.when((conv % 5 == 0) & (turn >= 2), 7200).otherwise(0)
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("s"), conv).alias("session_id"), turn.alias("seq"), "role", "text", (~failed).alias("ok"), at.cast("double").alias("at"))
    for part in (turns.where("seq < 2"), turns.where("seq >= 2")):
        part.write.mode("append").parquet(f"{base}/in")
        states = sessions.remember(spark.readStream.schema(turns.schema).parquet(f"{base}/in"), idle_s=3600)
        sessions.started(states, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    last = spark.read.parquet(f"{base}/out").groupBy("session_id").agg(F.max_by(F.struct("turns", "last_role", "last_text", "expired"), "batch").alias("s"))
    return last.select("session_id", "s.turns", "s.last_role", F.sha2("s.last_text", 256).alias("last_sha"), "s.expired")


@query("SELECT doc_id AS query_id, CASE WHEN n_chars >= 500 THEN 'kept' ELSE 'none' END AS result FROM documents")
def score_filter_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter component over lists of items."""
    config = {
        "nodes": [{"component_id": "s", "type": "start"}, {"component_id": "f", "type": "filter/score", "parameters": {"items": "{items}", "minimum": 500, "top": 1}}, {"component_id": "e", "type": "end", "parameters": {"items": "{f.items}"}}],
        "edges": [{"source": "s", "target": "f"}, {"source": "f", "target": "e"}],
    }
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text", F.array(F.struct(F.lit("kept").alias("id"), F.col("n_chars").cast("double").alias("score"))).alias("items"))
    return Workflow(config).run(rows).select("query_id", F.coalesce(F.get("items", F.lit(0))["id"], F.lit("none")).alias("result"))


@query("SELECT source AS query_id, array_to_string(list(DISTINCT lang ORDER BY lang), ',') AS strings, count(DISTINCT lower(lang)) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def distinct_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of a group each once whatever their case: groups of bounded kinds are gathered as sets first."""
    sets = table(spark, sf_dir, "documents").where("lang is not null").groupBy(F.col("source").alias("query_id")).agg(F.array_sort(F.collect_set("lang")).alias("l"))
    found = rank.distinct_strings(F.concat("l", F.transform("l", F.upper)))
    return sets.select("query_id", F.array_join(found, ",").alias("strings"), F.size(found).cast(LONG).alias("n"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 AND o_orderstatus = 'O' THEN 'claimed' WHEN o_orderkey % 7 = 0 THEN o_orderstatus ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 7 = 0 AND o_orderstatus = 'O' THEN 'ann' END AS claimed_by
FROM orders WHERE o_orderkey % 11 <> 0"""
)
def versioned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a versioned table: a user claims every seventh where it is open, a second one comes too late, every eleventh is deleted."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("claimed_by"))
    stored_ = VersionedTable(spark, scratch_path(spark, "versions")).create(orders, ["o_orderkey"], buckets=8)
    mine = orders.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("claimed").alias("status"))
    for user in ("ann", "bob"):
        stored_.upsert(mine.withColumn("claimed_by", F.lit(user)), when="old.status = 'O'")
    stored_.delete(orders.where("o_orderkey % 11 = 0").select("o_orderkey"))
    return stored_.read()


@query(
    """WITH b AS (SELECT l_orderkey, (l_linenumber % 2) * 100 + CASE WHEN l_quantity % 5 = 0 THEN 300 ELSE 0 END AS x, l_linenumber // 2 AS line FROM lineitem),
u AS (SELECT DISTINCT l_orderkey, x, line FROM b), i AS (SELECT *, line - row_number() OVER (PARTITION BY l_orderkey, x ORDER BY line) AS island FROM u)
SELECT l_orderkey, x::INT AS x0, (min(line) * 12)::INT AS y0, (x + 30)::INT AS x1, (max(line) * 12 + 10)::INT AS y1 FROM i GROUP BY l_orderkey, x, island"""
)
def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as boxes in two columns, some far to the right: lines under each other in one column are a block."""
    x = (F.col("l_linenumber") % 2) * 100 + F.when(F.col("l_quantity") % 5 == 0, 300).otherwise(0)
    y = F.expr("l_linenumber div 2") * 12
    rect = F.struct(*[c.cast("double").alias(n) for c, n in ((x, "x0"), (y, "y0"), (x + 30, "x1"), (y + 10, "y1"))])
    return boxes.blocks(table(spark, sf_dir, "lineitem").select("l_orderkey", rect.alias("rect")), ["l_orderkey"])


GENERATING = {
    "nodes": [
        {"component_id": "s", "type": "start"},
        {"component_id": "g", "type": "generate/provider", "parameters": {"provider": "model", "prompt": "q: {s.query}", "defaults": {"tail": "."}, "settings": {"tail": "!"}}},
        {"component_id": "e", "type": "end", "parameters": {"response": "{g.response}"}},
    ],
    "edges": [{"source": "s", "target": "g"}, {"source": "g", "target": "e"}],
}


@batched
def _shouting(prompts: list[str], tail: str = "") -> list[str]:
    """Stands in for a generator: the first characters of each prompt in capitals."""
    return ["".join(map(capital, p[:12])) + tail for p in prompts]


def capital(letter: str) -> str:
    """A letter's one capital, as SQL has it: where Python writes several letters, the sharp s has its own capital, others their title case or none."""
    large, title = letter.upper(), letter.title()
    return large if len(large) == 1 else "ẞ" if letter == "ß" else title if len(title) == 1 else letter


@query("SELECT conv_id * 1000 + turn AS query_id, upper(left('q: ' || trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 12)) || '!' AS response FROM conversations WHERE role = 'user'")
def generated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workflow that ends in a generator with settings, of which later ones win; the provider is asked in batches."""
    users = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return Workflow(GENERATING).run(users, Context(providers={"model": _shouting})).select("query_id", "response")
