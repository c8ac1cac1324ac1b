"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bytenet, html, jaccard, langid, lines, packing, perplexity, sentencepiece, urls
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with merge-dropout of every text, decoded again and compared; the ids as number and checksum."""
    path = tokenizer_path("piece_bpe_32k.model")
    both = sentencepiece.decode(sentencepiece.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every row whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 100 = 0"), k=10).select("query_id", "rank", "vec_id", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, log perplexity and verdict of every document."""
    rules = perplexity.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), with_text=False)
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line makes redundant."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines_dropped")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, rule and verdict of every url."""
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = bytenet.classify(docs, bytenet.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", bytenet.held_out(0, 5).alias("held_out"), "score", "predicted")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    held_out = bytenet.held_out(2, 4)
    found = langid.identify(docs, langid.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of all documents."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_nearest,
        op3_quality_rules,
        op4_line_dedup,
        op5_url_filter,
        op6_quality_classifier,
        op7_language,
        op8_html_text,
        op9_jaccard_join,
        op10_packing,
    )
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAREST_SQL = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT DISTINCT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 100 = 0),
d AS (SELECT query_id, vec_id, sqrt(list_reduce(list_transform(list_zip(qe, e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score FROM q JOIN v ON vec_id <> query_id AND len(e) = len(qe))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10"""
JACCARD_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
sizes AS (SELECT doc_id, len(s) AS n FROM sets), grams AS (SELECT doc_id, hash(unnest(s)) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * same >= 75 * (x.n + y.n - same)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM sizes UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.doc_id)
SELECT doc_id, n AS n_shingles, min(c) AS component_id FROM reach JOIN sizes USING (doc_id) GROUP BY ALL"""
LINES_SQL = r"""WITH lines AS (SELECT doc_id, p, line, string_split(norm, ' ') AS w, norm FROM (SELECT doc_id, p, line, trim(regexp_replace(regexp_replace(lower(line), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), '[ \t\v\f\r]+', ' ', 'g')) AS norm
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents))),
kinds AS (SELECT norm, w, len(w) AS n, min((doc_id, p)) AS first FROM lines WHERE norm <> '' GROUP BY ALL),
cuts AS (SELECT norm, n, first, unnest(range(1, n + 1)) AS i, w FROM kinds WHERE n >= 5), v AS (SELECT norm, n, first, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS rest FROM cuts),
near AS (SELECT a.norm FROM v a JOIN v b USING (n, i, rest) WHERE b.first < a.first UNION SELECT a.norm FROM v a JOIN kinds b ON a.rest = b.norm AND b.n >= 5 WHERE b.first < a.first UNION SELECT b.norm FROM v a JOIN kinds b ON a.rest = b.norm AND b.n >= 5 WHERE a.first < b.first),
fate AS (SELECT doc_id, p, line, l.norm <> '' AND (l.norm IN (SELECT norm FROM near) OR (doc_id, p) > k.first) AS gone FROM lines l LEFT JOIN kinds k ON k.norm = l.norm)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text, coalesce(t.gone, 0) AS n_lines_dropped FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) FILTER (NOT coalesce(gone, false)) AS text, count(*) FILTER (coalesce(gone, false)) AS gone FROM fate GROUP BY ALL) t USING (doc_id)"""

#: The other operators are tested against brute force, round trips or held-out accuracy in tests/llm.
SQL = {"op2_nearest": NEAREST_SQL, "op4_line_dedup": LINES_SQL, "op5_url_filter": urls.sql(), "op9_jaccard_join": JACCARD_SQL}
