"""Named queries over the tables, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pagewright.functions import predicates as P
from pagewright.functions import text as X
from pagewright.functions.sql import token_estimate
from pagewright.operators import chunking, evaluation, images, lexical, parsing, retrieval, statistics, tables, vectors
from pagewright.plans import answering
from pagewright.plans.lineage import materialize, shared_folder
from pagewright.providers import ExtractiveAnswerer
from pagewright.schemas import CHUNK_TYPES
from pagewright.sources import store
from pagewright.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- pieces of SQL -------------------------------------------------------------------------------

#: Unicode whitespace for an engine whose \s is ASCII, and what its \w and \d would be in Unicode.
S = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WCHAR = r"[\p{L}\p{N}\p{M}\p{Pc}]"
NOT_W = r"[^\p{L}\p{N}\p{M}\p{Pc}]"


def sql_words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{S}+'), lambda w: w <> '')"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{S}+|{S}+$', '', 'g')"


def sql_parts(text: str, parts: list[str]) -> str:
    pattern = "|".join(re.escape(p).replace("'", "''") for p in sorted(set(parts), key=len))
    return f"regexp_matches(lower({text}), '{pattern}')"


def sql_normalize(text: str) -> str:
    steps = [(rf"\n{S}*\n", ""), (rf"({WCHAR})-\n([a-zа-я])", r"\1\2"), (r"\n+", " "), (r"([A-Za-zА-Яа-я])(\p{Nd})", r"\1 \2"), (r"(\p{Nd})([A-Za-zА-Яа-я])", r"\1 \2"), (r"([a-zа-я])([A-ZА-Я])", r"\1 \2"), (r"[ \t]+", " "), (rf"^{S}+|{S}+$", "")]
    for pattern, put in steps:
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return f"replace({text}, '', chr(10) || chr(10))"


def sql_looks_like_table(text: str) -> str:
    return f"{sql_parts(text, ['table', 'табл'])} OR contains({text}, '|') OR regexp_matches({text}, '[^\\t\\n\\x0B\\f\\r ] {{2,}}[^\\t\\n\\x0B\\f\\r ]+(?: [^\\t\\n\\x0B\\f\\r ]+)* {{2,}}[^\\t\\n\\x0B\\f\\r ]') OR (length(regexp_replace({text}, '[^0-9]', '', 'g')) >= 12 AND length(regexp_replace({text}, '[^0-9]', '', 'g')) >= 0.05 * length({text}))"


SQL_TYPE = r"coalesce(nullif(regexp_replace(lower(trim(type)), '[\s-]+', '_', 'g'), ''), 'text')"
SQL_TIME = "try_cast(metadata.ingest_ts AS timestamptz)"
SQL_LATEST = f"""latest AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY {SQL_TIME} DESC NULLS LAST, content DESC NULLS LAST, doc_id DESC NULLS LAST) AS n FROM chunks) WHERE n = 1)"""
SQL_GOOD = f"""{SQL_LATEST}, good AS (SELECT * FROM latest WHERE metadata.processing_status = 'success' AND regexp_matches(content, '[^\\t\\n\\x0B\\f\\r \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]'))"""
SQL_SEARCH_TEXT = f"""CASE WHEN {SQL_TYPE} = 'table' THEN CASE WHEN starts_with(trim(regexp_replace(replace(lower(content), '|', ' '), '{S}+', ' ', 'g'), ' '), 'table ') THEN trim(regexp_replace(replace(lower(content), '|', ' '), '{S}+', ' ', 'g'), ' ')
 ELSE 'table ' || trim(regexp_replace(replace(lower(content), '|', ' '), '{S}+', ' ', 'g'), ' ') END
 WHEN {SQL_TYPE} IN ('image_ocr', 'image_caption') AND metadata.image_type IS NOT NULL THEN lower(metadata.image_type) || ' ' || lower(content) ELSE lower(content) END"""
SQL_IS_TABLE = f"({sql_parts('question', P.TABLE_PARTS)} OR (regexp_matches(question, '[\\d%]') AND {sql_parts('question', P.METRIC_PARTS)}))"
SQL_IS_IMAGE = sql_parts("question", P.IMAGE_PARTS)


def latest(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks, one row per chunk_id, with the type in one spelling."""
    return statistics.latest_rows(table(spark, sf, "chunks")).withColumn("type", statistics.plain_type(F.col("type")))


def good(spark: SparkSession, sf: str) -> DataFrame:
    return latest(spark, sf).where(P.indexable(F.col("content"), F.col("metadata.processing_status")))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of the data set whose id is divisible by 20: the stated query set of searches."""
    return table(spark, sf, "dataset").where("entry_id % 20 = 0 and question is not null").select(F.col("entry_id").alias("query_id"), "question").distinct()


SQL_ASKED = "asked AS (SELECT DISTINCT entry_id AS query_id, question FROM dataset WHERE entry_id % 20 = 0 AND question IS NOT NULL)"

# --- retrieval -----------------------------------------------------------------------------------


@query(f"""WITH {SQL_GOOD}, texts AS (SELECT chunk_id, {SQL_SEARCH_TEXT} AS t FROM good), words AS (SELECT chunk_id, {sql_words('t')} AS w FROM texts),
tok AS (SELECT chunk_id, len(w) AS length, unnest(w) AS term FROM words), tf AS (SELECT term, chunk_id, count(*) AS tf, any_value(length) AS length FROM tok GROUP BY ALL),
st AS (SELECT count(*)::double AS n, avg(len(w)) AS mean_length FROM words), df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df), {SQL_ASKED},
q AS (SELECT query_id, unnest(list_concat(list_concat(CASE WHEN {SQL_IS_IMAGE} THEN ['image'] ELSE []::varchar[] END, CASE WHEN {SQL_IS_TABLE} THEN ['table'] ELSE []::varchar[] END), {sql_words('lower(question)')})) AS term FROM asked),
s AS (SELECT query_id, chunk_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) AS raw FROM q JOIN idf USING (term) JOIN tf USING (term), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, round(least(raw / 10, 1.0), 4) AS score, rank FROM r WHERE rank <= 12 AND raw > 0""")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    texts = good(spark, sf).select("chunk_id", lexical.search_text(F.col("content"), F.col("type"), F.col("metadata.image_type")).alias("text"))
    questions = asked(spark, sf).select("query_id", lexical.query_tokens(F.col("question")).alias("tokens"))
    return lexical.bm25_top_k(questions, lexical.build_index(texts), 12).select("query_id", F.col("id").alias("chunk_id"), F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


SQL_UNIT = "list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[])))"
SQL_DENSE = f"""u AS (SELECT vec_id, label, {SQL_UNIT} AS v FROM embeddings), ds AS (SELECT q.vec_id AS query_id, x.vec_id, x.label, list_dot_product(q.v, x.v) AS score FROM u q, u x WHERE q.vec_id % 20 = 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM ds)"""


@query(f"WITH {SQL_DENSE} SELECT query_id, vec_id, round(score, 4) AS score, rank FROM dense WHERE rank <= 12")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    hits = vectors.top_k(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e, 12, "query_id", "vec_id", "embedding")
    return hits.select("query_id", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _label_type(label: str) -> F.Column:
    return F.when(F.col(label) <= 5, "text").when(F.col(label) <= 7, "table").when(F.col(label) == 8, "image_ocr").otherwise("image_caption")


SQL_LABEL = "CASE WHEN label <= 5 THEN 'text' WHEN label <= 7 THEN 'table' WHEN label = 8 THEN 'image_ocr' ELSE 'image_caption' END"


def _dense_and_near(spark: SparkSession, sf: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Dense hits, and hits of a second ranking: by the first half of the dimensions."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    kind = e.select(F.col("vec_id").alias("chunk_id"), _label_type("label").alias("type"))
    dense = vectors.top_k(q, e, 2 * k, "query_id", "vec_id", "embedding").withColumnRenamed("vec_id", "chunk_id").join(kind, "chunk_id")
    half = lambda rows: rows.withColumn("embedding", F.slice("embedding", 1, 32))
    near = vectors.top_k(half(q), half(e), k, "query_id", "vec_id", "embedding").withColumnRenamed("vec_id", "chunk_id").join(kind, "chunk_id")
    return dense, near.select("query_id", "chunk_id", "type", (1.0 / (F.col("rank") + 1)).alias("score"), "rank")


@query(f"""WITH {SQL_DENSE}, d AS (SELECT query_id, vec_id, label, score, rank FROM dense WHERE rank <= 24),
h AS (SELECT vec_id, label, list_transform(embedding[1:32], lambda x: x::double / sqrt(list_dot_product(embedding[1:32]::double[], embedding[1:32]::double[]))) AS v FROM embeddings),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, x.vec_id, x.label, list_dot_product(q.v, x.v) AS score FROM h q, h x WHERE q.vec_id % 20 = 0)),
l AS (SELECT query_id, vec_id, label, 1.0::double / (rank + 1) AS score, rank FROM n WHERE rank <= 12),
m AS (SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.vec_id, l.vec_id) AS chunk_id, coalesce(d.label, l.label) AS label,
 CASE WHEN d.score IS NOT NULL AND l.score IS NOT NULL THEN (d.score + l.score) / 2 WHEN d.score IS NOT NULL THEN d.score ELSE l.score * 0.5::double END AS score, coalesce(d.rank, l.rank + 1000000) AS ord
 FROM d FULL JOIN l ON d.query_id = l.query_id AND d.vec_id = l.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord, chunk_id) AS n FROM m)
SELECT query_id, n, chunk_id, {SQL_LABEL} AS type, round(score, 4) AS score FROM r WHERE n <= 12""")
def hybrid_merge(spark: SparkSession, sf: str) -> DataFrame:
    dense, near = _dense_and_near(spark, sf, 12)
    return retrieval.first_k(retrieval.merge_hybrid(dense, near), 12).select("query_id", F.col("n").cast("bigint").alias("n"), "chunk_id", "type", F.round("score", 4).alias("score"))


@query(f"""WITH {SQL_ASKED}, a AS (SELECT query_id, question, {SQL_IS_TABLE} AS is_table, {SQL_IS_IMAGE} AS is_image,
 regexp_extract(question, '(?i)phrase includes{S}+["“«]([^"”»]{{3,120}})["”»]', 1) AS named,
 list_extract(list_sort(list_transform(regexp_extract_all(question, '["“«]([^"“”«»]{{3,120}})["”»]', 1), lambda s, i: {{'n': -length(s), 'i': i, 's': s}})), 1).s AS longest FROM asked),
b AS (SELECT *, nullif(trim(CASE WHEN named <> '' THEN named ELSE longest END), '') AS anchor FROM a)
SELECT query_id, question, is_table, is_image, anchor, CASE WHEN is_image THEN 'image_ocr,image_caption' WHEN is_table THEN 'table' WHEN anchor IS NOT NULL THEN 'text' ELSE '' END AS preferred FROM b""")
def query_intent(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.intent(asked(spark, sf)).withColumn("preferred", F.array_join("preferred", ","))


def anchored(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that quote a piece of the text chunks whose id, as a number, is divisible by 20."""
    number = F.conv(F.substring(F.md5("chunk_id"), 1, 8), 16, 10).cast("bigint")
    rows = good(spark, sf).where((F.col("type") == "text") & (number % 20 == 0)).withColumn("anchor", F.trim(F.substring("content", 5, 24)))
    rows = rows.where((F.length("anchor") >= 4) & ~F.col("anchor").rlike("[\"“”«»\n]"))
    return rows.select(F.col("chunk_id").alias("query_id"), F.concat(F.lit('Which passage has a phrase includes "'), F.col("anchor"), F.lit('"?')).alias("question"))


@query(f"""WITH {SQL_GOOD}, a AS (SELECT chunk_id AS query_id, trim(substr(content, 5, 24), ' ') AS anchor FROM good WHERE {SQL_TYPE} = 'text' AND ('0x' || substr(md5(chunk_id), 1, 8))::bigint % 20 = 0)
SELECT query_id, chunk_id, {SQL_TYPE} AS type, round(length(anchor)::double / greatest(length(content), 1) + CASE WHEN {SQL_TYPE} = 'text' THEN 0.02 ELSE 0.04 END + CASE WHEN {SQL_TYPE} = 'text' THEN 0.20 ELSE 0 END, 4)::double AS score
FROM a, good WHERE length(anchor) >= 4 AND NOT regexp_matches(anchor, '["“”«»\n]') AND contains(lower(content), lower(anchor))""")
def anchor_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieval.intent(anchored(spark, sf)).withColumn("preferred", F.array(F.lit("text")))
    return retrieval.anchor_candidates(rows, good(spark, sf)).select("query_id", "chunk_id", "type", F.round("score", 4).alias("score"))


@query()
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """The whole search for every question: embedded chunks, lexical index, merge, top-ups and guaranteed types."""
    metadata = F.struct("metadata.processing_status", "metadata.image_type").alias("metadata")
    chunks = materialize(good(spark, sf).select("chunk_id", "doc_id", "page", "type", "content", metadata), "good-chunks")
    questions = table(spark, sf, "dataset").where("question is not null").select(F.col("entry_id").alias("query_id"), "question").distinct()
    hits = answering.retrieve(questions, chunks, answering.embed_chunks(chunks), 12)
    return hits.select("query_id", F.col("n").cast("bigint").alias("n"), "chunk_id", "type", F.round("score", 4).alias("score"))


@query()
def answered_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of the offline stand-in from lexically retrieved context."""
    chunks = materialize(good(spark, sf), "good-chunks")
    texts = chunks.select("chunk_id", lexical.search_text(F.col("content"), F.col("type"), F.col("metadata.image_type")).alias("text"))
    questions = asked(spark, sf)
    hits = lexical.bm25_top_k(questions.select("query_id", lexical.query_tokens(F.col("question")).alias("tokens")), lexical.build_index(texts), 5).withColumnRenamed("id", "chunk_id").join(chunks.select("chunk_id", "type"), "chunk_id").withColumnRenamed("rank", "n")
    return answering.answer(questions, hits, chunks, ExtractiveAnswerer()).select("query_id", "question", "answer", F.size("sources").alias("n_sources"), "has_answer_pred")


# --- vector table --------------------------------------------------------------------------------


@query(f"""SELECT vec_id, round(CASE WHEN vec_id % 10 = 0 THEN {SQL_UNIT}[64] ELSE embedding[1]::double END, 4) AS first_value FROM embeddings""")
def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    new = e.where("vec_id % 10 = 0").withColumn("embedding", F.reverse("embedding"))
    return vectors.upsert(e, new, "vec_id", "embedding").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 4).alias("first_value"))


@query("SELECT vec_id, label FROM embeddings WHERE label <> 3")
def vector_delete(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vectors.delete(e, e.where("label = 3").select("vec_id"), "vec_id").select("vec_id", "label")


# --- text ----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, coalesce(len({sql_words('text')}), 0)::int AS words, floor(len({sql_words('text')}) * 1.3::double)::int AS tokens FROM documents")
def word_token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"), token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) / length(text)::double ELSE 0 END, 4) AS ratio FROM documents")
def alnum_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(X.alnum_ratio(F.col("text")), 4).alias("ratio"))


@query(f"SELECT doc_id, length(n)::int AS chars, md5(n) AS hash FROM (SELECT doc_id, {sql_normalize('text')} AS n FROM documents)")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumn("n", X.normalize_text(F.col("text"))).select("doc_id", F.length("n").alias("chars"), F.md5("n").alias("hash"))


@query(f"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split_regex({sql_normalize('text')}, '\\n{S}*\\n'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS bs FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (i - 1)::int AS block_no, md5(bs[i]) AS hash FROM b, unnest(range(1, len(bs) + 1)) t(i)""")
def split_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.split_blocks(F.col("text"))).alias("block_no", "b")).select("doc_id", "block_no", F.md5("b").alias("hash"))


@query(f"""WITH w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents), s AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 38, 1), 215)) AS s FROM w WHERE len(w) > 0)
SELECT doc_id, ((s - 1) // 215)::int AS window_no, md5(array_to_string(w[s:s + 252], ' ')) AS hash FROM s""")
def long_text_windows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(chunking.word_windows(F.col("text"))).alias("window_no", "t")).select("doc_id", "window_no", F.md5("t").alias("hash"))


def sql_fold(name: str, units: str, most: int, kept: str) -> str:
    """Recursive tables ``{name}_f`` and ``{name}``: greedy packing of ``units`` (id, joiner, i, t, w, n) within 330; ``kept`` is how many words of the last unit are carried over."""
    return f"""{name}_f AS (SELECT id, i, w, n > {most} AS over, 1 AS piece, CASE WHEN n > {most} THEN 0 ELSE n END AS total, 0 AS carried FROM {units} WHERE i = 1
 UNION ALL SELECT u.id, u.i, u.w, u.n > {most}, piece + CASE WHEN u.n > {most} OR f.over OR f.total + u.n > 330 THEN 1 ELSE 0 END, CASE WHEN u.n > {most} THEN 0 WHEN f.over THEN u.n WHEN f.total + u.n > 330 THEN floor(({kept} + u.w) * 1.3::double)::bigint ELSE f.total + u.n END,
  CASE WHEN u.n > {most} OR f.over OR f.total + u.n <= 330 THEN 0 ELSE {kept} END FROM {name}_f f JOIN {units} u ON u.id = f.id AND u.i = f.i + 1),
{name}_l AS (SELECT f.id, min(f.i) AS first_i, any_value(u.joiner) AS joiner, list(CASE WHEN carried > 0 THEN CASE WHEN carried < b.w THEN array_to_string({sql_words('b.t')}[-carried:], ' ') ELSE b.t END || u.joiner ELSE '' END || u.t ORDER BY f.i) AS parts FROM {name}_f f JOIN {units} u ON u.id = f.id AND u.i = f.i LEFT JOIN {units} b ON b.id = f.id AND b.i = f.i - 1 WHERE NOT f.over GROUP BY f.id, f.piece),
{name} AS (SELECT id, first_i, CASE WHEN joiner = ' ' THEN array_to_string(parts, ' ') WHEN joiner = chr(10) THEN array_to_string(parts, chr(10)) ELSE array_to_string(parts, chr(10) || chr(10)) END AS piece FROM {name}_l)"""


SQL_COUNTED = f"len({sql_words('t')}) AS w, floor(len({sql_words('t')}) * 1.3::double)::bigint AS n"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, text, string_split_regex(text, '\\n{S}*\\n') AS ps FROM documents WHERE regexp_matches(text, '[^\\t\\n\\x0B\\f\\r \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]')),
m AS (SELECT *, len(ps) = 1 AND floor(len({sql_words('text')}) * 1.3::double) > 400 AS lines FROM d),
x AS (SELECT doc_id, lines, list_filter(list_transform(CASE WHEN lines THEN string_split(text, chr(10)) ELSE ps END, lambda x: {sql_strip('x')}), lambda x: x <> '') AS us FROM m),
pu AS (SELECT id, joiner, i, t, {SQL_COUNTED} FROM (SELECT doc_id AS id, CASE WHEN lines THEN chr(10) ELSE chr(10) || chr(10) END AS joiner, i, us[i] AS t FROM x, unnest(range(1, len(us) + 1)) r(i))),
{sql_fold('para', 'pu', 400, 'least(38, f.w)')},
big AS (SELECT id AS doc_id, i AS first_i, t, string_split(regexp_replace(t, '([.!?]){S}+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM pu WHERE n > 400),
sx AS (SELECT doc_id, first_i, list_filter(list_transform(CASE WHEN len(ss) = 1 THEN string_split(t, chr(10)) ELSE ss END, lambda x: {sql_strip('x')}), lambda x: x <> '') AS us FROM big),
su AS (SELECT id, joiner, i, t, {SQL_COUNTED} FROM (SELECT doc_id || '|' || first_i AS id, ' ' AS joiner, i, us[i] AS t FROM sx, unnest(range(1, len(us) + 1)) r(i))),
{sql_fold('sent', 'su', 330, 'f.w')},
wx AS (SELECT id, i, {sql_words('t')} AS ws FROM su WHERE n > 330),
cut AS (SELECT id AS doc_id, first_i AS a, 0 AS b, 0 AS c, piece FROM para UNION ALL SELECT split_part(id, '|', 1)::bigint, split_part(id, '|', 2)::bigint, first_i, 0, piece FROM sent
 UNION ALL SELECT split_part(id, '|', 1)::bigint, split_part(id, '|', 2)::bigint, i, c, array_to_string(ws[c:c + 252], ' ') FROM (SELECT *, unnest(generate_series(1, greatest(len(ws) - 38, 1), 215)) AS c FROM wx)),
n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY a, b, c) - 1)::int AS piece_idx FROM cut)
SELECT doc_id, doc_id || '_p1_t' || piece_idx AS chunk_id, piece_idx, length(piece)::int AS chars, md5(piece) AS hash FROM n""")
def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    """The greedy fold over every document, with names."""
    docs = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("elem_idx"), F.col("text").alias("content"))
    return chunking.name_pieces(chunking.chunk_texts(docs)).select("doc_id", "chunk_id", "piece_idx", F.length("content").alias("chars"), F.md5("content").alias("hash"))


@query(f"SELECT doc_id, {sql_looks_like_table('text')} AS is_table FROM documents")
def looks_like_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", P.looks_like_table(F.col("text")).alias("is_table"))


@query(f"""SELECT entry_id, CASE WHEN NOT regexp_matches(expected_answer, '{P.REFUSED_CAPTION.replace("'", "''").replace("(?i)", "(?i)")}') THEN expected_answer END AS caption,
 {sql_parts('expected_answer', [P.NO_ANSWER_PHRASE.lower(), *P.NO_ANSWER_PARTS])} AS no_answer FROM (SELECT DISTINCT entry_id, expected_answer FROM dataset)""")
def refusal_filter(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("expected_answer")
    return table(spark, sf, "dataset").select("entry_id", "expected_answer").distinct().select("entry_id", P.usable_caption(a).alias("caption"), P.no_answer(a).alias("no_answer"))


@query(f"""WITH a AS (SELECT DISTINCT entry_id, expected_answer AS e, lower({sql_strip('expected_answer')}) AS c FROM dataset)
SELECT entry_id, e IS NULL OR NOT regexp_matches(e, '[^\\t\\n\\x0B\\f\\r \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]') OR c = 'unreadable' OR (starts_with(c, 'unreadable') AND length(c) < 120)
 OR (length(c) < 12 AND NOT regexp_matches(c, '[0-9]') AND len({sql_words('c')}) <= 2) AS low FROM a""")
def low_info_caption(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "dataset").select("entry_id", "expected_answer").distinct().select("entry_id", P.low_information_caption(F.col("expected_answer")).alias("low"))


@query(f"""WITH {SQL_LATEST}, c AS (SELECT chunk_id, content, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^step [12]|^rules')) AS ls FROM latest WHERE {SQL_TYPE} = 'image_caption' AND content IS NOT NULL)
SELECT chunk_id, CASE WHEN len(ls) > 0 THEN array_to_string(ls, chr(10)) ELSE content END AS caption FROM c""")
def caption_clean(spark: SparkSession, sf: str) -> DataFrame:
    return latest(spark, sf).where("type = 'image_caption' and content is not null").select("chunk_id", images.clean_caption(F.col("content")).alias("caption"))


@query("""SELECT event_id, regexp_replace('key sk-' || md5(event_id::varchar) || ' ' || props, 'sk-(?:proj-)?[A-Za-z0-9_\\-]{10,}', 'sk-***', 'g') AS safe, printf('%d:%02d', floor(greatest(value, 0))::bigint // 60, floor(greatest(value, 0))::bigint % 60) AS label,
 replace(replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM events""")
def labels_and_redaction(spark: SparkSession, sf: str) -> DataFrame:
    secret = F.concat(F.lit("key sk-"), F.md5(F.col("event_id").cast("string")), F.lit(" "), F.col("props"))
    return table(spark, sf, "events").select("event_id", X.redact_secrets(secret).alias("safe"), X.duration_label(F.col("value")).alias("label"), X.html_escape(F.col("props")).alias("html"))


# --- recognition and images ----------------------------------------------------------------------

SQL_OCR = f"""o AS (SELECT DISTINCT chunk_id, metadata.ocr_confidence AS conf, length(content) AS chars, len({sql_words('content')}) AS words, CASE WHEN length(content) > 0 THEN length(regexp_replace(content, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(content)::double ELSE 0 END AS alpha
 FROM chunks WHERE metadata.ocr_confidence IS NOT NULL AND content IS NOT NULL)"""


def recognized(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("metadata.ocr_confidence is not null and content is not null")
    t = F.col("content")
    return c.select("chunk_id", F.col("metadata.ocr_confidence").alias("conf"), F.length(t).alias("chars"), X.word_count(t).alias("words"), X.alnum_ratio(t).alias("alpha")).distinct()


@query(f"""WITH {SQL_OCR} SELECT chunk_id, conf < 60 OR chars < 50 OR words < 10 OR alpha < 0.4 AS failed, chars < 30 OR words < 5 OR alpha < 0.2 AS catastrophic, chars >= 120 AND words >= 30 AND alpha >= 0.45 AS strong, chars = 0 AND words = 0 AS blank,
 nullif(concat_ws('; ', CASE WHEN conf < 60 THEN 'confidence=' || printf('%.1f', round(conf, 1)) || '<60' END, CASE WHEN chars < 50 THEN 'chars=' || chars || '<50' END, CASE WHEN words < 10 THEN 'tokens=' || words || '<10' END, CASE WHEN alpha < 0.4 THEN 'alpha_ratio=' || printf('%.2f', round(alpha, 2)) || '<0.4' END), '') AS reason FROM o""")
def ocr_quality(spark: SparkSession, sf: str) -> DataFrame:
    conf, chars, words, alpha = (F.col(c) for c in ("conf", "chars", "words", "alpha"))
    return recognized(spark, sf).select("chunk_id", P.ocr_failed(conf, chars, words, alpha).alias("failed"), P.ocr_catastrophic(chars, words, alpha).alias("catastrophic"), P.ocr_strong(chars, words, alpha).alias("strong"), P.ocr_blank(chars, words).alias("blank"), X.failure_reason(conf, chars, words, alpha).alias("reason"))


@query(f"""WITH {SQL_OCR}, t AS (SELECT chunk_id, min(metadata.image_type) AS image_type, min(page) AS page FROM chunks GROUP BY chunk_id), r AS (SELECT o.*, image_type, page % 7 = 0 AS low, least(words / 20.0, 8.0)::double AS entropy, least(chars / 30.0, 80.0)::double AS dev FROM o JOIN t USING (chunk_id) WHERE image_type IS NOT NULL),
h AS (SELECT *, chars < 30 OR words < 5 OR alpha < 0.2 AS hopeless, conf < 60 OR chars < 50 OR words < 10 OR alpha < 0.4 AS failed, chars = 0 AND words = 0 AND entropy <= 0.5 AND dev <= 5 AS empty_, image_type IN ('text_scan', 'table_scan') AS scan FROM r),
s AS (SELECT chunk_id, image_type, CASE WHEN low AND hopeless THEN 'low-info catastrophic OCR' WHEN scan AND NOT (failed AND hopeless) THEN 'OCR sufficient' WHEN empty_ THEN 'blank/uniform' WHEN NOT scan AND low THEN 'low-info' END AS skip_reason FROM h)
SELECT chunk_id, image_type, skip_reason, skip_reason IS NULL AS needs_vision FROM s""")
def image_route(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "chunks").groupBy("chunk_id").agg(F.min("metadata.image_type").alias("image_type"), F.min("page").alias("page"))
    rows = recognized(spark, sf).join(t.where("image_type is not null"), "chunk_id")
    rows = rows.select("chunk_id", "image_type", (F.col("page") % 7 == 0).alias("low_info"), F.col("conf").alias("confidence"), F.col("chars").alias("char_count"), F.col("words").alias("word_count"), F.col("alpha").alias("alpha_ratio"), F.least(F.col("words") / 20.0, F.lit(8.0)).alias("entropy"), F.least(F.col("chars") / 30.0, F.lit(80.0)).alias("deviation"))
    return images.route(rows).select("chunk_id", "image_type", "skip_reason", "needs_vision")


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, trunc(x::double * 400 + 128)::int))) AS p FROM embeddings),
e AS (SELECT vec_id, c, r, p[r * 8 + c + 1] AS v, CASE WHEN c > 0 THEN p[r * 8 + c] END AS l, CASE WHEN r > 0 THEN p[r * 8 + c - 7] END AS u FROM p, unnest(range(8)) x(c), unnest(range(8)) y(r)),
k AS (SELECT vec_id, c, r, v, coalesce(abs(v - l), 0) AS dx, coalesce(abs(v - u), 0) AS dy FROM e),
-- Pixels inside the border by cell: an edge to the left is eight pixels high, one upwards eight wide; the outer row and column of the image do not count.
s AS (SELECT vec_id, sum(CASE WHEN dx > 30 AND dy > 30 THEN hh + ww - 1 WHEN dx > 30 THEN hh WHEN dy > 30 THEN ww ELSE 0 END) / 3844.0::double AS edges FROM (SELECT *, CASE WHEN r IN (0, 7) THEN 7 ELSE 8 END AS hh, CASE WHEN c IN (0, 7) THEN 7 ELSE 8 END AS ww FROM k) GROUP BY vec_id),
q AS (SELECT vec_id, (SELECT 1) AS one, count(DISTINCT v) / 256.0::double AS d, stddev_pop(v) / 255 AS c FROM k GROUP BY vec_id),
lines AS (SELECT vec_id, sum(CASE WHEN n > 3844 / 64.0 * 0.3 THEN 1 ELSE 0 END) / 128.0::double AS n FROM (SELECT vec_id, 'r' AS way, r AS at, sum(CASE WHEN dy > 50 THEN CASE WHEN c IN (0, 7) THEN 7 ELSE 8 END ELSE 0 END) AS n FROM k GROUP BY ALL UNION ALL SELECT vec_id, 'c', c, sum(CASE WHEN dx > 50 THEN CASE WHEN r IN (0, 7) THEN 7 ELSE 8 END ELSE 0 END) FROM k GROUP BY ALL) GROUP BY vec_id)
SELECT vec_id, CASE WHEN d < 0.08 AND edges < 0.15 AND c > 0.3 THEN 'text_scan' WHEN d < 0.12 AND edges >= 0.15 AND edges < 0.30 AND n > 0.1 THEN 'table_scan' WHEN d >= 0.35 THEN 'photo' WHEN d >= 0.08 AND d < 0.40 AND edges >= 0.25 THEN 'diagram' ELSE 'chart' END AS image_type,
 round(edges, 4) AS edge_ratio, round(n, 4) AS line_density, round(d, 4) AS diversity, round(c, 4) AS contrast FROM q JOIN s USING (vec_id) JOIN lines USING (vec_id)""")
def image_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Features and class of gray images made from the vectors: eight rows of eight pixels, each drawn eightfold."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), (x.cast("double") * 400 + 128).cast("int")))).alias("p"))
    hexed = F.array_join(F.transform("p", lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), 8)), "")
    rows = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.repeat(F.substring(hexed, r * 128 + 1, F.lit(128)), 8)), "")
    pixels = F.unhex(rows)
    f = e.withColumn("f", images.raw_gray_features(F.lit(64), F.lit(64), pixels))
    return f.select("vec_id", images.image_class(F.col("f")).alias("image_type"), *(F.round(F.col("f")[c], 4).alias(c) for c in ("edge_ratio", "line_density", "diversity", "contrast")))


# --- tables --------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT l_orderkey, '| line | part | quantity |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || CASE WHEN l_quantity > 5 THEN '' ELSE l_partkey::varchar END || ' | ' || CASE WHEN l_quantity > 40 THEN '' ELSE l_quantity::bigint::varchar END || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_quantity) AS md,
 count(*) + 1 AS n, sum((l_quantity > 5)::int + (l_quantity > 40)::int) AS empty FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, md5(md) AS hash, length(md)::int AS chars FROM g WHERE n >= 2 AND empty <= 0.7 * 3 * n""")
def table_markdown(spark: SparkSession, sf: str) -> DataFrame:
    row = F.struct("l_linenumber", "l_partkey", "l_quantity")
    grouped = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("rs"))  # at most a few lines an order
    cells = F.concat(F.array(F.array(F.lit("line"), F.lit("part"), F.lit("quantity"))), F.transform("rs", lambda r: F.array(r["l_linenumber"].cast("string"), F.when(r["l_quantity"] > 5, "").otherwise(r["l_partkey"].cast("string")), F.when(r["l_quantity"] > 40, "").otherwise(r["l_quantity"].cast("bigint").cast("string")))))
    grids = grouped.withColumn("cells", cells).where(tables.grid_ok(F.col("cells"))).withColumn("md", tables.grid_to_markdown(F.col("cells")))
    return grids.select("l_orderkey", F.md5("md").alias("hash"), F.length("md").alias("chars"))


@query(f"""WITH {SQL_LATEST}, t AS (SELECT doc_id, page, chunk_id, trim(regexp_replace(lower(content), '{S}+', ' ', 'g'), ' ') AS norm FROM latest WHERE {SQL_TYPE} = 'table' AND content IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, md5(norm) ORDER BY chunk_id) AS k FROM t WHERE norm <> '') SELECT doc_id, page, chunk_id FROM n WHERE k = 1""")
def table_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest(spark, sf).where("type = 'table' and content is not null").withColumn("elem_idx", F.col("chunk_id"))
    return tables.distinct_tables(rows).select("doc_id", "page", "chunk_id")


@query(f"""WITH {SQL_GOOD}, c AS (SELECT doc_id, page, chunk_id, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) <= 200 AND regexp_matches(lower(x), 'table|табл'))[1] AS cap FROM good WHERE {SQL_TYPE} = 'text'),
p AS (SELECT doc_id, page, arg_min(cap, chunk_id) AS cap FROM c WHERE cap IS NOT NULL GROUP BY ALL)
SELECT g.chunk_id, md5(CASE WHEN cap IS NOT NULL AND NOT contains(content, cap) THEN cap || chr(10) || content ELSE content END) AS hash FROM good g LEFT JOIN p USING (doc_id, page) WHERE {SQL_TYPE} = 'table'""")
def table_captions(spark: SparkSession, sf: str) -> DataFrame:
    rows = good(spark, sf).withColumn("elem_idx", F.col("chunk_id"))
    captions = tables.page_captions(rows.where("type = 'text'"))
    return tables.attach_captions(rows.where("type = 'table'").select("doc_id", "page", "chunk_id", "content"), captions).select("chunk_id", F.md5("content").alias("hash"))


@query(f"""WITH RECURSIVE {SQL_GOOD}, l AS (SELECT chunk_id, content, string_split({sql_strip('content')}, chr(10)) AS ls FROM good WHERE {SQL_TYPE} = 'table'),
h AS (SELECT *, NOT regexp_matches(substr(ls[1], 1, 20), '\\p{{Nd}}') AS h1, coalesce(NOT regexp_matches(substr(ls[2], 1, 20), '\\p{{Nd}}'), false) AS h2 FROM l WHERE length(content) // 4 > 200),
b AS (SELECT chunk_id, CASE WHEN h1 AND h2 THEN ls[1] || chr(10) || ls[2] WHEN h2 THEN ls[2] ELSE ls[1] END AS head, list_concat(CASE WHEN h2 AND NOT h1 THEN [ls[1]] WHEN h1 AND NOT h2 OR NOT h1 AND NOT h2 THEN ls[2:2] ELSE []::varchar[] END, ls[3:]) AS body FROM h),
u AS (SELECT chunk_id, length(head) // 4 AS hn, i, body[i] AS line, length(body[i]) // 4 AS n FROM b, unnest(range(1, len(body) + 1)) r(i)),
f AS (SELECT chunk_id, i, 0 AS piece_no, hn + n AS total FROM u WHERE i = 1 UNION ALL SELECT u.chunk_id, u.i, f.piece_no + CASE WHEN f.total + u.n > 200 THEN 1 ELSE 0 END, CASE WHEN f.total + u.n > 200 THEN u.hn ELSE f.total END + u.n FROM f JOIN u ON u.chunk_id = f.chunk_id AND u.i = f.i + 1),
p AS (SELECT chunk_id, piece_no, head || chr(10) || string_agg(line, chr(10) ORDER BY i) AS piece FROM f JOIN u USING (chunk_id, i) JOIN b USING (chunk_id) GROUP BY chunk_id, piece_no, head
 UNION ALL SELECT chunk_id, 0, content FROM l WHERE length(content) // 4 <= 200 UNION ALL SELECT chunk_id, 0, head FROM b WHERE len(body) = 0)
SELECT chunk_id, piece_no::int AS piece_no, length(piece)::int AS chars, md5(piece) AS hash FROM p""")
def table_split(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all markdown tables with the header repeated."""
    rows = good(spark, sf).where("type = 'table'")
    return rows.select("chunk_id", F.posexplode(tables.split_table(F.col("content"), 200)).alias("piece_no", "piece")).select("chunk_id", "piece_no", F.length("piece").alias("chars"), F.md5("piece").alias("hash"))


# --- documents, links, pages ---------------------------------------------------------------------


@query(f"""WITH {SQL_LATEST}, l AS (SELECT doc_id, chunk_id, page, {SQL_TYPE} AS kind FROM latest)
SELECT chunk_id, CASE WHEN kind IN ('text', 'table') THEN lag(chunk_id) OVER w END AS prev_chunk_id, CASE WHEN kind IN ('text', 'table') THEN lead(chunk_id) OVER w END AS next_chunk_id FROM l WINDOW w AS (PARTITION BY doc_id, kind IN ('text', 'table') ORDER BY page, chunk_id)""")
def chunk_links(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.link_chunks(latest(spark, sf).select("doc_id", "chunk_id", "page", "type"), ["page", "chunk_id"]).select("chunk_id", "prev_chunk_id", "next_chunk_id")


@query(f"""WITH {SQL_LATEST}, p AS (SELECT doc_id, page, sum(coalesce(length({sql_strip('content')}), 0)) AS chars FROM latest WHERE {SQL_TYPE} = 'text' GROUP BY ALL), d AS (SELECT doc_id, sum(chars)::bigint AS chars, count_if(chars >= 200) AS full_pages, max(page) AS pages FROM p GROUP BY doc_id)
SELECT doc_id, chars, full_pages, pages, round(full_pages / greatest(coalesce(pages, 1), 1)::double, 4) AS coverage, full_pages / greatest(coalesce(pages, 1), 1)::double >= 0.6 AND chars >= 1500 AS accepted FROM d""")
def page_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.page_coverage(latest(spark, sf).where("type = 'text'")).select("doc_id", "chars", "full_pages", "pages", "coverage", "accepted")


@query(f"""WITH {SQL_GOOD} SELECT doc_id, page, md5(string_agg(content, chr(10) ORDER BY chunk_id)) AS hash FROM good WHERE {SQL_TYPE} = 'text' GROUP BY ALL""")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.page_texts(good(spark, sf).withColumn("elem_idx", F.col("chunk_id"))).select("doc_id", "page", F.md5("content").alias("hash"))


@query(f"""WITH {SQL_LATEST} SELECT chunk_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, CASE {SQL_TYPE} WHEN 'text' THEN 0 WHEN 'table' THEN 1 ELSE 2 END, chunk_id) - 1)::int AS seq FROM latest""")
def element_order(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.ordered_elements(latest(spark, sf).select("doc_id", "chunk_id", "page", "type", F.col("chunk_id").alias("elem_idx"))).select("chunk_id", "seq")


@query("""WITH e AS (SELECT DISTINCT ts, doc_id, page, element_type, error FROM error_log) SELECT doc_id, ts, element_type, error, coalesce(last_value(page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ts, element_type, error, page NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS page FROM e""")
def carried_pages(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "error_log").select("ts", "doc_id", "page", "element_type", "error").distinct()
    rows = e.withColumn("elem_idx", F.row_number().over(W.partitionBy("doc_id").orderBy("ts", "element_type", "error", "page")))
    return parsing.carried_pages(rows).select("doc_id", "ts", "element_type", "error", "page")


@query("SELECT DISTINCT doc_id, substr(md5(filepath), 1, 12) AS path_id, regexp_extract(filename, '^(.*?)(?:\\.[^.]*)?$', 1) AS stem FROM registry WHERE doc_id IS NOT NULL")
def document_ids(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "registry").where("doc_id is not null")
    return r.select("doc_id", parsing.document_id(F.col("filepath"), F.lit(""), "path").alias("path_id"), parsing.document_id(F.col("filename"), F.lit(""), "stem").alias("stem")).distinct()


# --- counts --------------------------------------------------------------------------------------


@query(f"""WITH {SQL_LATEST} SELECT doc_id, {', '.join(f"count_if({SQL_TYPE} = '{t}') AS {t}" for t in CHUNK_TYPES)} FROM latest GROUP BY doc_id""")
def chunk_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.type_counts(latest(spark, sf))


@query(f"""WITH {SQL_LATEST}, k AS (SELECT doc_id, {SQL_TYPE} AS kind, metadata AS m, regexp_extract(chunk_id, '_i(\\d+)_', 1) AS img FROM latest),
a AS (SELECT doc_id, count(DISTINCT CASE WHEN kind IN ('image_ocr', 'image_caption') THEN img END) AS images, count_if(kind = 'image_ocr' AND m.ocr_failed) AS f, count_if(kind = 'image_caption' AND m.vision_used) AS v, count_if(kind IN ('image_ocr', 'image_caption') AND m.processing_status = 'failed') AS x FROM k GROUP BY doc_id)
SELECT doc_id, images, round(coalesce(f / nullif(images, 0)::double, 0), 4) AS ocr_failure_rate, round(coalesce(v / nullif(images, 0)::double, 0), 4) AS vision_rate, round(coalesce(x / nullif(images, 0)::double, 0), 4) AS failed_rate FROM a""")
def image_rates(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.image_rates(latest(spark, sf))


@query(f"""WITH {SQL_LATEST}, k AS (SELECT doc_id, {SQL_TYPE} AS kind, metadata AS m FROM latest) SELECT count(DISTINCT coalesce(doc_id, '')) AS documents, count(*) AS chunks, {', '.join(f"count_if(kind = '{t}') AS {t}" for t in CHUNK_TYPES)}, count_if(m.ocr_failed) AS ocr_failed, count_if(m.vision_used) AS vision_used,
 round(coalesce(100.0::double * count_if(m.ocr_failed) / nullif(count_if(kind IN ('image_ocr', 'image_caption')), 0), 0), 2) AS ocr_failed_pct, round(coalesce(100.0::double * count_if(m.vision_used) / nullif(count_if(kind IN ('image_ocr', 'image_caption')), 0), 0), 2) AS vision_pct FROM k""")
def document_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.document_statistics(latest(spark, sf))


@query("SELECT event_type, count(*) AS calls, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def stage_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.stage_percentiles(table(spark, sf, "events"), "event_type", "value")


@query("""SELECT count(*) AS rows, sum(('0x' || substr(md5(concat_ws(chr(31), coalesce(doc_id::varchar, chr(30)), coalesce(text, chr(30)))), 1, 12))::bigint)::varchar AS fingerprint FROM documents""")
def content_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.content_fingerprint(table(spark, sf, "documents"), "doc_id", "text")


@query(f"""WITH {SQL_GOOD}, k AS (SELECT DISTINCT md5('offline:' || content) AS key FROM good) SELECT key FROM k WHERE substr(key, 1, 1) <> '0'""")
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    keyed = good(spark, sf).select(store.cache_key("offline", F.col("content")).alias("key"))
    return store.cache_misses(keyed, keyed.where("key like '0%'").distinct(), "key")


@query("SELECT doc_id, count(*) AS errors, count(traceback) AS with_traceback, min(ts) AS first_ts FROM (SELECT DISTINCT * FROM error_log) GROUP BY doc_id")
def error_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "error_log").distinct().groupBy("doc_id").agg(F.count("*").alias("errors"), F.count("traceback").alias("with_traceback"), F.min("ts").alias("first_ts"))


@query("SELECT DISTINCT e.doc_id, r.doc_id IS NOT NULL AS registered FROM error_log e LEFT JOIN (SELECT DISTINCT doc_id FROM registry WHERE NOT parse_failed AND ingest_ts IS NOT NULL) r USING (doc_id)")
def registered_documents(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "registry").where("not parse_failed and ingest_ts is not null").select("doc_id").distinct().withColumn("registered", F.lit(True))
    return table(spark, sf, "error_log").select("doc_id").distinct().join(known, "doc_id", "left").select("doc_id", F.coalesce("registered", F.lit(False)).alias("registered"))


@query(f"""WITH {SQL_LATEST} SELECT chunk_id FROM latest WHERE doc_id <> '5eedc0ffee01' OR doc_id IS NULL""")
def without_document(spark: SparkSession, sf: str) -> DataFrame:
    return store.without_document(latest(spark, sf), "5eedc0ffee01").select("chunk_id")


@query(f"""WITH {SQL_LATEST} SELECT chunk_id FROM latest WHERE chunk_id NOT IN (SELECT chunk_id FROM latest WHERE doc_id = '5eedc0ffee01')""")
def vectors_without_document(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest(spark, sf)
    return store.vectors_without_document(rows.select("chunk_id"), rows, "5eedc0ffee01")


@query(f"""WITH {SQL_LATEST} SELECT DISTINCT metadata.image_hash AS image_hash FROM latest WHERE doc_id = '5eedc0ffee01' AND metadata.image_hash IS NOT NULL""")
def image_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return store.image_hashes(latest(spark, sf), "5eedc0ffee01")


@query(f"""WITH {SQL_LATEST}, i AS (SELECT doc_id, chunk_id, page, metadata.image_hash AS image_hash FROM latest WHERE metadata.image_hash IS NOT NULL) SELECT chunk_id, min(page) OVER (PARTITION BY doc_id, image_hash) AS first_index FROM i""")
def once_per_document(spark: SparkSession, sf: str) -> DataFrame:
    """The page on which each image of a document comes first."""
    rows = latest(spark, sf).where("metadata.image_hash is not null").select("doc_id", "chunk_id", F.col("page").alias("image_index"), F.col("metadata.image_hash").alias("image_hash"))
    return images.once_per_document(rows).select("chunk_id", "first_index")


@query(f"""WITH {SQL_GOOD}, p AS (SELECT doc_id, page, bool_or({sql_looks_like_table('content')}) AS hit FROM good WHERE {SQL_TYPE} = 'text' GROUP BY ALL) SELECT doc_id, page FROM p QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY doc_id)""")
def candidate_pages(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.candidate_pages(good(spark, sf).where("type = 'text'"), P.looks_like_table(F.col("content")))


@query(f"""SELECT doc_id, md5(array_to_string(w[greatest(len(w) - 37, 1):], ' ')) AS hash FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents WHERE text IS NOT NULL)""")
def overlap_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(chunking.overlap_text(F.col("text"))).alias("hash"))


# --- questions and judgments ---------------------------------------------------------------------

SQL_JUDGED = """j AS (SELECT DISTINCT entry_id, question, expected_answer, slice, (entry_id % 11) / 10.0::double AS faithfulness, (entry_id % 7) / 6.0::double AS relevancy, (entry_id % 5) / 4.0::double AS context_precision, (entry_id % 3) / 2.0::double AS context_recall,
 CASE WHEN slice = 'no-answer' AND entry_id % 4 > 0 THEN entry_id % 3 = 0 END AS no_answer_correct, CASE WHEN entry_id % 17 = 0 THEN 'Error: timeout' ELSE '' END AS notes FROM dataset)"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("entry_id")
    return table(spark, sf, "dataset").select("entry_id", "question", "expected_answer", "slice").distinct().select(
        "*", ((i % 11) / 10.0).alias("faithfulness"), ((i % 7) / 6.0).alias("relevancy"), ((i % 5) / 4.0).alias("context_precision"), ((i % 3) / 2.0).alias("context_recall"),
        F.when((F.col("slice") == "no-answer") & (i % 4 > 0), i % 3 == 0).alias("no_answer_correct"), F.when(i % 17 == 0, "Error: timeout").otherwise("").alias("notes"),
    )


@query(f"""WITH {SQL_JUDGED}, g AS (SELECT *, CASE WHEN slice IN ('table', 'image', 'no-answer') THEN slice ELSE 'overall' END AS s FROM j WHERE NOT contains(lower(notes), 'error')),
a AS (SELECT s, grouping(s) AS all_rows, count(*) AS count, avg(faithfulness) AS f, avg(relevancy) AS r, avg(context_precision) AS p, avg(context_recall) AS c, count_if(no_answer_correct) AS yes, count_if(NOT no_answer_correct) AS no FROM g GROUP BY GROUPING SETS ((s), ()))
SELECT CASE WHEN all_rows = 1 THEN 'overall' ELSE s END AS slice, CASE WHEN all_rows = 1 THEN 'all' ELSE 'slice' END AS scope, count, round(f, 3) AS faithfulness, round(r, 3) AS relevancy, round(p, 3) AS context_precision, round(c, 3) AS context_recall,
 round(CASE WHEN all_rows = 0 AND s = 'no-answer' THEN yes / nullif(yes + no, 0)::double END, 3) AS no_answer_accuracy, round(CASE WHEN all_rows = 0 AND s = 'no-answer' THEN no / nullif(yes + no, 0)::double END, 3) AS false_positive_rate FROM a""")
def slice_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.slice_metrics(judged(spark, sf))


@query(f"""WITH {SQL_JUDGED}, s AS (SELECT *, unnest(['low_faithfulness', 'no_answer_failure']) AS section FROM j), n AS (SELECT section, entry_id, row_number() OVER (PARTITION BY section ORDER BY entry_id) AS n FROM s WHERE (section = 'low_faithfulness' AND faithfulness < 0.5) OR (section = 'no_answer_failure' AND no_answer_correct = false))
SELECT section, entry_id, n FROM n WHERE n <= 3""")
def report_examples(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.report_examples(judged(spark, sf), "entry_id").select("section", "entry_id", F.col("n").cast("bigint").alias("n"))


@query("""WITH e AS (SELECT question, arg_max({'a': expected_answer, 's': slice}, entry_id) AS e FROM dataset GROUP BY question) SELECT p.query_id, p.question, e.e.a AS expected_answer, coalesce(e.e.s, 'overall') AS slice FROM (SELECT DISTINCT entry_id AS query_id, question FROM dataset WHERE entry_id % 20 = 0 AND question IS NOT NULL) p LEFT JOIN e USING (question)""")
def expected_answers(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.with_expected(asked(spark, sf), table(spark, sf, "dataset"))


@query(f"""WITH {SQL_GOOD}, a AS (SELECT DISTINCT entry_id, doc_id, trim(expected_answer, ' ') AS e FROM dataset WHERE doc_id IS NOT NULL AND has_answer AND expected_answer IS NOT NULL),
h AS (SELECT entry_id, length(e) > 0 AND contains(lower(content), lower(e)) AS verbatim, len(list_filter(string_split_regex(lower(e), '{NOT_W}+'), lambda t: length(t) > 3 AND contains(lower(content), t))) >= 2 AS two FROM a JOIN good g USING (doc_id))
SELECT entry_id, count_if(verbatim) AS strict, count_if(verbatim OR two) AS loose FROM h GROUP BY entry_id""")
def answer_in_content(spark: SparkSession, sf: str) -> DataFrame:
    """Answers against all chunks of their document."""
    a = table(spark, sf, "dataset").where("doc_id is not null and has_answer and expected_answer is not null").select("entry_id", "doc_id", F.col("expected_answer").alias("answer"))
    return evaluation.answers_in_contents(a, good(spark, sf))


@query(f"""WITH {SQL_LATEST} SELECT chunk_id FROM latest WHERE metadata.processing_status = 'success' AND {SQL_TYPE} = 'text' AND NOT contains(lower(content), 'unreadable') AND length({sql_strip('content')}) >= 200
 AND length({sql_strip('content')}) - length(replace({sql_strip('content')}, '|', '')) <= 0.01 * length({sql_strip('content')})""")
def clean_text_filter(spark: SparkSession, sf: str) -> DataFrame:
    return latest(spark, sf).where(P.clean_text(F.col("content"), F.col("metadata.processing_status"), F.col("type"))).select("chunk_id")


@query()
def anchored_questions(spark: SparkSession, sf: str) -> DataFrame:
    """A question set that asks for spans by their anchors."""
    return evaluation.anchored_questions(latest(spark, sf), 200)


@query()
def question_set(spark: SparkSession, sf: str) -> DataFrame:
    """A whole question set: anchored text and image questions, and unanswerable ones."""
    rows = materialize(latest(spark, sf), "latest-chunks")
    return evaluation.anchored_questions(rows, 100).unionByName(evaluation.image_questions(rows, 50)).unionByName(evaluation.unanswerable_questions(rows, 10))


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id::varchar), doc_id LIMIT 100")
def deterministic_sample(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.seeded_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT t.slice, coalesce(n, 0) AS n, target, coalesce(n, 0) < 0.8 * target AS short FROM (VALUES ('image', 3000), ('no-answer', 20), ('overall', 100), ('table', 100)) t(slice, target) LEFT JOIN (SELECT slice, count(*) AS n FROM dataset GROUP BY slice) d ON t.slice = d.slice")
def slice_shortfall(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.slice_shortfall(table(spark, sf, "dataset"), {"overall": 100, "table": 100, "image": 3000, "no-answer": 20})


@query(f"""WITH {SQL_GOOD}, p AS (SELECT chunk_id, doc_id, page, {SQL_TYPE} AS kind, content, {sql_words('content')} AS w, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS n FROM good), c AS (SELECT * FROM p WHERE n <= 3)
SELECT doc_id, md5(string_agg('[' || concat_ws('|', doc_id, page, chunk_id, kind) || ']' || chr(10) || content || chr(10), chr(10) || '---' || chr(10) ORDER BY n)) AS context_hash, string_agg(array_to_string(w[1:20], ' ') || CASE WHEN len(w) > 20 THEN '...' ELSE '' END, ' / ' ORDER BY n) AS previews FROM c GROUP BY doc_id""")
def context_build(spark: SparkSession, sf: str) -> DataFrame:
    rows = good(spark, sf)
    hits = rows.select(F.col("doc_id").alias("query_id"), "chunk_id", "type", F.lit(1.0).alias("score"), F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_id")).alias("n")).where("n <= 3")
    refs = answering.source_refs(hits, rows)
    return refs.select(F.col("query_id").alias("doc_id"), F.md5("context").alias("context_hash"), F.array_join(F.transform("sources", lambda s: s["preview"]), " / ").alias("previews"))


@query(f"""WITH {SQL_GOOD}, t AS (SELECT chunk_id, {SQL_TYPE} AS kind, content, trim(regexp_replace(replace(content, '|', ' '), '{S}+', ' ', 'g'), ' ') AS flat, metadata.image_type AS it FROM good)
SELECT chunk_id, md5(CASE WHEN kind = 'table' AND NOT contains(content, flat) THEN content || chr(10) || chr(10) || flat WHEN kind IN ('image_ocr', 'image_caption') THEN 'image ' || coalesce(it, kind) || ': ' || content ELSE content END) AS hash FROM t""")
def embedding_texts(spark: SparkSession, sf: str) -> DataFrame:
    return good(spark, sf).select("chunk_id", F.md5(answering.embedding_text(F.col("content"), F.col("type"), F.col("metadata.image_type"))).alias("hash"))


@query("""WITH d AS (SELECT DISTINCT entry_id, question, slice FROM dataset) SELECT entry_id, slice FROM d QUALIFY slice <> 'image' OR row_number() OVER (PARTITION BY slice, question ORDER BY entry_id) = 1""")
def distinct_questions(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.distinct_questions(table(spark, sf, "dataset").select("entry_id", "question", "slice").distinct(), "entry_id").select("entry_id", "slice")


# --- streams -------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS calls, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def timing_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Daily windows over the events as a stream, run until all that is there is done."""
    schema = table(spark, sf, "events").schema
    # A stream reads folders and patterns; the pattern fits the one table, be it a file or a folder.
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("calls"), F.avg("value").alias("mean"))
    name = f"timing_{uuid.uuid4().hex}"
    q = grouped.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "calls", F.round("mean", 4).alias("mean"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

