"""The queries opN_<name>: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.llm import decontaminate, divergence, embeddings, flac, licenses, lines, minhash, packing, pieces, quality, secrets, tokens, whitening
from marram.llm.common import scratch_path

QUERIES: dict = {}
ORACLES: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the box keeps a public tokenizer; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the chunks of lines that stand elsewhere, and what was taken out."""
    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "chunks_removed", "lines_removed", "words_removed")


@_query
def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit-packed shards of all texts, written and read back."""
    path = scratch_path(spark, "shards")
    tokens.write(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return tokens.documents(tokens.read(spark, path))


@_query
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links inside a label at cosine 0.98."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


# Reachability over all links: SQL that is plain, and quick on small tables only.
ORACLES["op3_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
able AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.n * b.n) >= 0.98),
reach(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT dst, root FROM reach JOIN links ON src = node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY 1), counts AS (SELECT src, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(c.n, 0) AS n_links, root AS component_id, root = vec_id AS kept FROM v LEFT JOIN roots ON node = vec_id LEFT JOIN counts c ON src = vec_id
"""


@_query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence identifiers and licenses of every text."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licenses", "unmatched")]
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), *joined)


ORACLES["op4_license_scan"] = licenses.oracle()


@_query
def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of all texts, written and read back as a media column, decoded into PCM blocks, which are written and
    read back for the digests. Four portions, as streams take about as much disk as the input."""
    return flac.digests(flac.transcode(table(spark, sf_dir, "documents"), scratch_path(spark, "pcm"), portions=4))


@_query
def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded texts."""
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@_query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 4 is not 2; scores all. The metadata is n_chars."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 4) == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    scored = quality.score(documents, quality.train(documents, labels, metadata=["n_chars"]), metadata=["n_chars"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen buckets, batches of 16384 tokens of the byte-level vocabulary."""
    sized = tokens.lengths(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packing.pack(sized, budget=16384, buckets=16, length="n_tokens")


@_query
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, Jaccard 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


ORACLES["op9_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS src, b.doc_id AS dst, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT src, dst FROM pairs WHERE 100 * c >= 85 * (m + n - c)),
reach(node, root) AS (SELECT doc_id, doc_id FROM sets UNION SELECT dst, root FROM reach JOIN links ON src = node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, root AS component_id, root = doc_id AS kept FROM sets JOIN roots ON node = doc_id
"""


@_query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that sees half of the documents first and then all, of which it scans what is new; the
    findings are joined back to every document."""
    documents, path = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "ledger")
    secrets.Ledger(spark, path).update(documents.where("pmod(xxhash64(doc_id), 2) = 0"))
    found = secrets.scan(documents, path)
    counts = [secrets.count(F.col("found"), rule).alias(f"n_{rule.kind}") for rule in secrets.BASE]
    base = F.sha2(secrets.digest(F.col("found"), secrets.BASE), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, secrets.digest(F.col("found"), secrets.RULES).alias("spans"))


def _secret_sql() -> str:
    """The spans of all rules by the lengths of what lies between matches."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    parts, spans = [], []
    for k, r in enumerate(secrets.RULES):
        parts.append(f"string_split_regex(t, {quote(r.pattern)}) AS gaps{k}, regexp_extract_all(t, {quote(r.pattern)}) AS hits{k}, regexp_extract_all(t, {quote(r.pattern)}, {r.group}) AS cores{k}")
        before = lambda n: f"coalesce(list_sum(list_transform(gaps{k}[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits{k}[1:{n}], lambda h: length(h))), 0)"  # noqa: E731, B023
        one = f"{{'a': ({before('i - 1')})::BIGINT, 'k': {k}, 'b': ({before('i')})::BIGINT, 'kind': {quote(r.kind)}}}"
        spans.append(f"list_transform(list_filter(range(1, len(hits{k}) + 1), lambda i: length(cores{k}[i]) >= {r.least}), lambda i: {one})")
    joined = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda s: s.kind || ':' || s.a || ':' || s.b), ','), '')"
    counts = ", ".join(f"len(list_filter(f, lambda s: s.k = {k})) AS n_{r.kind}" for k, r in enumerate(secrets.BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, {", ".join(parts)} FROM d),
f AS (SELECT doc_id, list_sort({" || ".join(spans)}) AS f FROM p)
SELECT doc_id, {counts}, sha256({joined(f"list_filter(f, lambda s: s.k < {len(secrets.BASE)})")}) AS base_sha256, {joined("f")} AS spans FROM f"""


ORACLES["op10_secret_scan"] = _secret_sql()


@_query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all pairs of sources of a language, and the terms that mark each source."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = divergence.oracle()


@_query
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside windows of ten words of benchmark items."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op12_decontamination"] = decontaminate.oracle()


@_query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight components of all vectors."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
