"""Queries over chunking and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta import constants as K
from attesta.operators import chunking as J
from attesta.operators import retrieval as R
from attesta.plans import bindings as B
from attesta.plans.registry import query
from attesta.session import materialize
from attesta.sources.scans import load_table


def marked_up(spark, sf):
    """Documents as markdown: a line of up to 4 words is a heading of level 2, up to 8 words of
    level 3, anything longer a paragraph."""
    def mark(line):
        words = J.token_count(line)
        return (F.when(words == 0, "").when(words <= 4, F.concat(F.lit("## "), line))
                .when(words <= 8, F.concat(F.lit("### "), line)).otherwise(line))
    return load_table(spark, sf, "documents").select(
        "doc_id", "source", "lang",
        F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("markdown"))


_WORDS = r"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"

SECTIONS_SQL = rf"""lines AS (SELECT doc_id, line, i, {_WORDS.format(x="line")} AS n FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
typed AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN n <= 4 THEN 2 WHEN n <= 8 THEN 3 ELSE 0 END AS level
  FROM lines),
placed AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER w AS sec,
  last_value(CASE WHEN level = 2 THEN {_STRIP.format(x="line")} END IGNORE NULLS) OVER w AS h2
  FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
sections AS (SELECT doc_id, CAST(sec AS INTEGER) AS sec, max(level) AS level,
  CASE max(level) WHEN 2 THEN [max(h2)] WHEN 3 THEN list_filter([max(h2),
    max(CASE WHEN level = 3 THEN {_STRIP.format(x="line")} END)], lambda x: x IS NOT NULL)
    ELSE [] END AS path,
  {_STRIP.format(x="coalesce(string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY i), '')")}
    AS content FROM placed GROUP BY 1, 2
  HAVING max(level) > 0 OR trim(string_agg(line, '')) <> '')"""


@query("sections", f"""WITH {SECTIONS_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id
  ORDER BY sec) - 1 AS INTEGER) AS pos, array_to_string(path, ' > ') AS path, content FROM sections""")
def sections(spark, sf):
    return marked_up(spark, sf).select("doc_id", F.posexplode(J.sections(F.col("markdown"))).alias(
        "pos", "s")).select("doc_id", "pos", F.array_join("s.path", " > ").alias("path"),
                            F.col("s.content").alias("content"))


_SPLIT_SQL = f"""paras AS (SELECT doc_id, sec, para, row_number() OVER (PARTITION BY doc_id, sec
    ORDER BY i) AS i, {_WORDS.format(x="para")} AS n FROM (SELECT doc_id, sec,
      unnest(regexp_split_to_array(content, '\\n+')) AS para,
      generate_subscripts(regexp_split_to_array(content, '\\n+'), 1) AS i
    FROM sections WHERE {_WORDS.format(x="content")} > {K.SPLIT_TOKENS}) WHERE trim(para) <> ''),
pack AS (SELECT doc_id, sec, para, i, n AS size, 0 AS part FROM paras WHERE i = 1 UNION ALL
  SELECT p.doc_id, p.sec, p.para, p.i,
    CASE WHEN k.size = 0 OR k.size + p.n <= {K.SPLIT_TOKENS} THEN k.size + p.n ELSE p.n END,
    CASE WHEN k.size = 0 OR k.size + p.n <= {K.SPLIT_TOKENS} THEN k.part ELSE k.part + 1 END
  FROM pack k JOIN paras p ON p.doc_id = k.doc_id AND p.sec = k.sec AND p.i = k.i + 1),
split AS (SELECT s.doc_id, s.sec, part, any_value(path) AS path,
    string_agg(para, chr(10) || chr(10) ORDER BY i) AS content
  FROM pack JOIN sections s ON s.doc_id = pack.doc_id AND s.sec = pack.sec GROUP BY 1, 2, 3
  UNION ALL SELECT doc_id, sec, 0, path, content FROM sections
  WHERE {_WORDS.format(x="content")} <= {K.SPLIT_TOKENS}),
parts AS (SELECT doc_id, path, content, {_WORDS.format(x="content")} AS n,
  row_number() OVER (PARTITION BY doc_id ORDER BY sec, part) - 1 AS pos FROM split)"""


@query("split_large", f"""WITH RECURSIVE {SECTIONS_SQL}, {_SPLIT_SQL}
SELECT doc_id, CAST(pos AS INTEGER) AS pos, array_to_string(path, ' > ') AS path, content,
  CAST(n AS INTEGER) AS token_count FROM parts""")
def split_large(spark, sf):
    parts = J.split_large(J.sections(F.col("markdown")))
    return marked_up(spark, sf).select("doc_id", F.posexplode(parts).alias("pos", "s")).select(
        "doc_id", "pos", F.array_join("s.path", " > ").alias("path"),
        F.col("s.content").alias("content"), J.token_count(F.col("s.content")).alias("token_count"))


_CHUNKS_SQL = f"""{SECTIONS_SQL}, {_SPLIT_SQL}, walk AS (
  SELECT doc_id, pos, path, path AS head, content, n AS size, 0 AS chunk_no FROM parts WHERE pos = 0
  UNION ALL SELECT p.doc_id, p.pos, p.path, CASE WHEN joins THEN head ELSE p.path END, p.content,
    CASE WHEN joins THEN size + p.n ELSE p.n END,
    CASE WHEN joins THEN chunk_no ELSE chunk_no + 1 END
  FROM (SELECT w.*, q.pos AS next_pos, w.size < {K.MERGE_TOKENS} AND
      array_to_string(w.head[:greatest(len(w.head) - 1, 0)], '|') =
      array_to_string(q.path[:greatest(len(q.path) - 1, 0)], '|') AS joins
    FROM walk w JOIN parts q ON q.doc_id = w.doc_id AND q.pos = w.pos + 1) w
  JOIN parts p ON p.doc_id = w.doc_id AND p.pos = w.next_pos),
chunks AS (SELECT doc_id, chunk_no, arg_min(path, pos) AS path,
  string_agg(content, chr(10) || chr(10) ORDER BY pos) AS content, sum(n) AS token_count
  FROM (SELECT w.*, p.n FROM walk w JOIN parts p ON p.doc_id = w.doc_id AND p.pos = w.pos)
  GROUP BY 1, 2)"""


def chunks(spark, sf):
    return J.chunk(marked_up(spark, sf))


@query("chunk_documents", f"""WITH RECURSIVE {_CHUNKS_SQL} SELECT doc_id, chunk_no,
  array_to_string(path, ' > ') AS path, content, CAST(token_count AS INTEGER) AS token_count
FROM chunks""")
def chunk_documents(spark, sf):
    return chunks(spark, sf).select("doc_id", "chunk_no", F.array_join("path", " > ").alias("path"),
                                    "content", "token_count")


@query("chunk_pages", f"""SELECT page_id, len(regexp_extract_all(html, '<h1>')) > 0 AS has_heading
FROM pages""")
def chunk_pages(spark, sf):
    """A page keeps its level-1 heading inside its first chunk."""
    md = B.pages(spark, sf).select("page_id", J.markdown_of_html(F.col("html")).alias("markdown"))
    return J.chunk(md).groupBy("page_id").agg(F.max(F.regexp(
        "content", F.lit(r"(?m)^# "))).alias("has_heading"))


_EDITION = "CASE WHEN lang = 'en' THEN '2013 Revised' END"


@query("context_header", f"""WITH RECURSIVE {_CHUNKS_SQL} SELECT c.doc_id, chunk_no,
  source || ' · Doc ' || c.doc_id || coalesce(' (' || {_EDITION} || ')', '') ||
  CASE WHEN len(path) > 0 THEN ' · ' || array_to_string(path, ' › ') ELSE '' END AS header
FROM chunks c JOIN documents d ON d.doc_id = c.doc_id""")
def context_header(spark, sf):
    title = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    edition = F.when(F.col("lang") == "en", "2013 Revised")
    return chunks(spark, sf).select("doc_id", "chunk_no", J.context_header(
        F.col("source"), title, edition, F.col("path")).alias("header"))


@query("new_chunks", f"""WITH RECURSIVE {_CHUNKS_SQL}, keyed AS (
  SELECT d.source AS entity_id, sha256(content) AS content_hash, d.doc_id IN (
    SELECT doc_id FROM labels) AS stored FROM chunks c JOIN documents d ON d.doc_id = c.doc_id)
SELECT DISTINCT entity_id, content_hash FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM keyed s
  WHERE s.stored AND s.entity_id = k.entity_id AND s.content_hash = k.content_hash)""")
def new_chunks(spark, sf):
    rows = materialize(chunks(spark, sf).select(
        "doc_id", F.lit("document").alias("entity_type"), F.col("source").alias("entity_id"),
        "content_hash"), "chunk-keys")
    stored = rows.join(load_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return J.new_chunks(rows, stored).select("entity_id", "content_hash")


@query("inherit_confidence", f"""WITH RECURSIVE {_CHUNKS_SQL} SELECT c.doc_id AS entity_id, chunk_no,
  CASE quality WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
FROM chunks c JOIN labels l ON l.doc_id = c.doc_id""")
def inherit_confidence(spark, sf):
    docs = load_table(spark, sf, "labels").select(
        F.col("doc_id").alias("entity_id"),
        F.when(F.col("quality") == 1, "medium").otherwise("low").alias("confidence"),
        F.lit(None).cast("timestamp").alias("last_verified_at"))
    rows = chunks(spark, sf).select(F.col("doc_id").alias("entity_id"), "chunk_no")
    return J.inherit(rows, docs).select("entity_id", "chunk_no", "confidence")


# --- lexical arm -------------------------------------------------------------------------

def _lexical_sql(queries: str, content: str) -> str:
    """`queries` selects (query_id, text), `content` selects (chunk_id, content)."""
    def words(x):
        return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"""q AS ({queries}), c AS (SELECT chunk_id, {words("content")} AS w FROM ({content})),
t AS (SELECT DISTINCT query_id, unnest({words("text")}) AS term FROM q),
need AS (SELECT query_id, count(*) AS needed FROM t GROUP BY 1),
tf AS (SELECT chunk_id, len(w) AS len, term, count(*) AS tf FROM (SELECT chunk_id, w,
  unnest(w) AS term FROM c) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM c),
hit AS (SELECT t.query_id, tf.chunk_id, count(*) AS found, round(sum(
    ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K.BM25_K1 + 1} /
    (tf + {K.BM25_K1} * (1 - {K.BM25_B} + {K.BM25_B} * len / avg_len))), 6) AS score
  FROM t JOIN tf ON tf.term = t.term JOIN df ON df.term = t.term, n GROUP BY 1, 2),
lexical AS (SELECT h.query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY h.query_id
    ORDER BY score DESC, chunk_id) AS INTEGER) AS lex_rank
  FROM hit h JOIN need ON need.query_id = h.query_id WHERE found = needed
  QUALIFY lex_rank <= {K.ARM_DEPTH})"""


_PASSAGES = "SELECT item_id AS query_id, text FROM benchmark"
_DOCS = "SELECT doc_id AS chunk_id, text AS content FROM documents"


def _passages(spark, sf):
    return load_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark, sf):
    return load_table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


@query("lexical_search", f"WITH {_lexical_sql(_PASSAGES, _DOCS)} SELECT * FROM lexical")
def lexical_search(spark, sf):
    return R.lexical_topk(_passages(spark, sf), _docs(spark, sf))


_ANNOUNCE_SQL = "WITH " + B.PAGE_TEXTS_SQL + ", " + _lexical_sql(
    "SELECT page_id AS query_id, heading AS text FROM page_texts",
    "SELECT page_id AS chunk_id, heading || ' ' || caption AS content FROM page_texts") + \
    " SELECT query_id, chunk_id AS ref, score, lex_rank FROM lexical"


@query("search_announcements", _ANNOUNCE_SQL)
def search_announcements(spark, sf):
    texts = B.page_texts(spark, sf)
    queries = texts.select(F.col("page_id").alias("query_id"), F.col("heading").alias("text"))
    rows = texts.select(F.col("page_id").alias("ref"), F.col("heading").alias("title"),
                        F.col("caption").alias("summary"))
    return R.search_announcements(queries, rows)


# --- vector arm --------------------------------------------------------------------------

def _topics(spark, sf):
    """The mean vector of each label is its query."""
    e = load_table(spark, sf, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(F.col("label").alias("query_id")).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))


def _vectors(spark, sf):
    return load_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


_VECTOR_SQL = f"""parts AS (SELECT label, i, avg(x) AS x FROM (SELECT label,
    unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings) GROUP BY 1, 2),
topics AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM parts GROUP BY 1),
vector_hits AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(v,
    CAST(embedding AS DOUBLE[])), 6) AS score FROM topics, embeddings),
vectors AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)
  AS INTEGER) AS vec_rank FROM vector_hits QUALIFY vec_rank <= {K.ARM_DEPTH})"""


@query("vector_search", f"WITH {_VECTOR_SQL} SELECT * FROM vectors")
def vector_search(spark, sf):
    return R.vector_topk(_topics(spark, sf), _vectors(spark, sf))


# Passage i asks with vector i; a vector and the document of the same number are one chunk.
_HYBRID_SQL = f"""asked AS (SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS v
  FROM benchmark JOIN embeddings ON vec_id = item_id),
vector_hits AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(v,
    CAST(embedding AS DOUBLE[])), 6) AS score FROM asked, embeddings),
vectors AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)
  AS INTEGER) AS vec_rank FROM vector_hits QUALIFY vec_rank <= {K.ARM_DEPTH}),
{_lexical_sql(_PASSAGES, _DOCS)},
cand AS (SELECT query_id, chunk_id FROM vectors UNION SELECT query_id, chunk_id FROM lexical),
fused AS (SELECT c.query_id, c.chunk_id, v.vec_rank, l.lex_rank,
    round(coalesce(1.0 / ({K.RRF_K} + v.vec_rank), 0) + coalesce(1.0 / ({K.RRF_K} + l.lex_rank), 0), 9)
      AS rrf_score
  FROM cand c LEFT JOIN vectors v ON v.query_id = c.query_id AND v.chunk_id = c.chunk_id
  LEFT JOIN lexical l ON l.query_id = c.query_id AND l.chunk_id = c.chunk_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id)
  AS INTEGER) AS place FROM fused QUALIFY place <= 20)"""


def hybrid(spark, sf):
    passages = _passages(spark, sf)
    asked = passages.join(_vectors(spark, sf), F.col("query_id") == F.col("chunk_id")).select(
        "query_id", "vector")
    lex = R.lexical_topk(passages, _docs(spark, sf))
    return R.rrf(lex, R.vector_topk(asked, _vectors(spark, sf)), 20)


@query("rank_fusion", f"WITH {_HYBRID_SQL} SELECT * FROM ranked")
def rank_fusion(spark, sf):
    return hybrid(spark, sf)


# Site and least confidence count inside both arms, statistics of the words included.
_FILTERED_SQL = f"""asked AS (SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS v
  FROM benchmark JOIN embeddings ON vec_id = item_id),
allowed AS (SELECT d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id
  WHERE lang = 'en' AND quality = 1),
vector_hits AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(v,
    CAST(embedding AS DOUBLE[])), 6) AS score FROM asked, embeddings
  WHERE vec_id IN (SELECT doc_id FROM allowed)),
vectors AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)
  AS INTEGER) AS vec_rank FROM vector_hits QUALIFY vec_rank <= {K.ARM_DEPTH}),
{_lexical_sql(_PASSAGES, _DOCS + " WHERE doc_id IN (SELECT doc_id FROM allowed)")},
cand AS (SELECT query_id, chunk_id FROM vectors UNION SELECT query_id, chunk_id FROM lexical)
SELECT * FROM (SELECT c.query_id, c.chunk_id, v.vec_rank, l.lex_rank, round(
    coalesce(1.0 / ({K.RRF_K} + v.vec_rank), 0) + coalesce(1.0 / ({K.RRF_K} + l.lex_rank), 0), 9)
      AS rrf_score, CAST(row_number() OVER (PARTITION BY c.query_id ORDER BY round(
    coalesce(1.0 / ({K.RRF_K} + v.vec_rank), 0) + coalesce(1.0 / ({K.RRF_K} + l.lex_rank), 0), 9)
      DESC, c.chunk_id) AS INTEGER) AS place
  FROM cand c LEFT JOIN vectors v ON v.query_id = c.query_id AND v.chunk_id = c.chunk_id
  LEFT JOIN lexical l ON l.query_id = c.query_id AND l.chunk_id = c.chunk_id) WHERE place <= 20"""


@query("filtered_search", f"WITH {_FILTERED_SQL}")
def filtered_search(spark, sf):
    passages, vectors = _passages(spark, sf), _vectors(spark, sf)
    queries = passages.join(vectors.withColumnRenamed("chunk_id", "query_id"), "query_id", "left")
    levels = load_table(spark, sf, "labels").select(
        F.col("doc_id").alias("chunk_id"),
        F.when(F.col("quality") == 1, "medium").otherwise("low").alias("confidence"))
    docs = load_table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"),
        F.col("lang").alias("site")).join(levels, "chunk_id")
    return R.hybrid_search(queries, docs, vectors, 20, site="en", confidence="medium")


@query("evidence_rows", f"""WITH {_HYBRID_SQL} SELECT r.query_id, r.chunk_id, place, lex_rank, vec_rank,
  d.text AS content, d.source AS source_url FROM ranked r JOIN documents d ON d.doc_id = r.chunk_id""")
def evidence_rows(spark, sf):
    docs = load_table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"),
        F.col("source").alias("source_url"), F.lit("medium").alias("confidence"),
        F.lit(None).cast("timestamp").alias("last_verified_at"),
        F.array("lang").alias("path"))
    return R.evidence(hybrid(spark, sf), docs).select(
        "query_id", "chunk_id", "place", "lex_rank", "vec_rank", "content", "source_url")


@query("retrieval_eval", f"""WITH {_VECTOR_SQL}, hits AS (SELECT v.query_id, min(vec_rank) AS first_hit
  FROM vectors v JOIN embeddings e ON e.vec_id = v.chunk_id AND e.label = v.query_id GROUP BY 1)
SELECT count(*) AS questions, round(avg(CASE WHEN first_hit <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall,
  round(avg(coalesce(1.0 / first_hit, 0)), 6) AS mrr
FROM (SELECT DISTINCT label FROM embeddings) a LEFT JOIN hits ON query_id = label""")
def retrieval_eval(spark, sf):
    gold = load_table(spark, sf, "embeddings").select(
        F.col("label").alias("query_id"), F.col("vec_id").alias("chunk_id"))
    results = R.vector_topk(_topics(spark, sf), _vectors(spark, sf)).withColumnRenamed(
        "vec_rank", "place")
    return R.retrieval_eval(results, gold).select(
        "questions", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query("contamination", f"""WITH {_HYBRID_SQL} SELECT count(*) AS questions,
  round(avg(CASE WHEN lang <> 'en' THEN 1.0 ELSE 0.0 END), 6) AS contamination
FROM ranked r JOIN documents d ON d.doc_id = r.chunk_id WHERE place = 1""")
def contamination(spark, sf):
    placed = hybrid(spark, sf).join(load_table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("lang").alias("site")), "chunk_id")
    asked = _passages(spark, sf).select("query_id", F.lit("en").alias("site"))
    return R.contamination(placed, asked).withColumn("contamination", F.round("contamination", 6))
