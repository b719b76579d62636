"""Lexical and vector search arms, rank fusion, evidence rows and retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions import text as X
from attesta.operators import grid
from attesta.operators.freshness import min_confidence
from attesta.session import materialize

# Queries and vectors per matrix product: one product stays small.
SLICE = 1024


def top_k(scored: DataFrame, k: int, out: str) -> DataFrame:
    """Best k rows per query by score, ties by chunk id. Spark prunes each task to k rows per
    query before the shuffle."""
    place = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn(out, place).filter(F.col(out) <= k)


def lexical_topk(queries: DataFrame, chunks: DataFrame, k: int = K.ARM_DEPTH,
                 content: str = "content") -> DataFrame:
    """Chunks that hold every term of a query, by BM25: (query_id, chunk_id, score, lex_rank).

    `queries`: (query_id, text); `chunks`: (chunk_id, content). Filters on chunks belong before
    this call, so they narrow the scan.

    Only postings of query terms are built. They are counted per (chunk, term), written once, and
    gathered per chunk (a chunk holds at most the words of all queries). Blocks of chunks then
    meet blocks of queries in a grid of cells: inside a cell a query intersects its postings from
    the shortest on and keeps k rows. A word that
    stands in every chunk is therefore as many pieces as there are blocks of chunks, and no row
    of a shuffle is ever keyed by a word that queries share.

    Equal query texts are answered once. The vocabulary is written out, so its size is known where
    Spark decides whether to broadcast it; a large one is joined by shuffle.
    """
    asked = queries.select("query_id", F.unhex(F.md5("text")).alias("_text_id"), "text")
    terms = asked.select("_text_id", "text").dropDuplicates(["_text_id"]).select(
        "_text_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    # The empty word, which no text holds, stands once in every row: its postings count the rows
    # and carry their lengths, so the texts are cut into words once.
    vocabulary = materialize(
        terms.select("term").distinct().withColumn("tid", F.monotonically_increasing_id())
        .union(queries.sparkSession.range(1).select(F.lit(""), F.lit(-1).cast("long"))),
        "vocabulary")
    words = chunks.select("chunk_id", X.tokens(F.col(content)).alias("_words"))
    counted = materialize(
        words.select("chunk_id", F.size("_words").alias("len"),
                     F.explode(F.array_append(F.coalesce("_words", F.array().cast("array<string>")),
                                              "")).alias("term"))
        .join(vocabulary, "term").groupBy("chunk_id", "tid")
        .agg(F.count(F.lit(1)).alias("tf"), F.max("len").alias("len"), F.sum("len").alias("all"),
             F.count("len").alias("known")),
        "postings")
    stats = counted.filter("tid < 0").agg(F.sum("tf").alias("n"),
                                          (F.sum("all") / F.sum("known")).alias("avg_len"))
    postings = counted.filter("tid >= 0")
    n = stats.select("n").scalar()
    df = postings.groupBy("tid").agg(F.count(F.lit(1)).alias("df")).select(
        "tid", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    # A query with a word that no chunk has is left out: its words are fewer than it needs.
    wanted = (terms.join(vocabulary, "term").join(df, "tid", "left").groupBy("_text_id")
              .agg(F.collect_list(F.struct("tid", "idf")).alias("_terms"),
                   F.count_if(F.col("idf").isNull()).alias("_lost"))
              .filter(F.col("_lost") == 0)
              .select("_text_id", "_terms.tid", "_terms.idf"))
    norm = K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * F.max("len") / stats.select("avg_len").scalar())
    held = (postings.groupBy("chunk_id")
            .agg(F.collect_list(F.struct("tid", "tf")).alias("_terms"), norm.alias("norm"))
            .select("chunk_id", "norm", "_terms.tid", "_terms.tf"))
    found = grid.meet(wanted, held, _ranked_by_words(k),
                      f"query_id binary, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, "
                      "score double")
    best = top_k(found, k, "lex_rank").withColumnRenamed("query_id", "_text_id")
    return asked.select("query_id", "_text_id").join(best, "_text_id").drop("_text_id")


def _ranked_by_words(k: int) -> grid.Kernel:
    """The k best chunks of a block per query that hold all of its words."""

    def rank(asked: pa.Table, chunks: pa.Table) -> Iterator[pa.RecordBatch]:
        chunks = chunks.sort_by("chunk_id")  # a smaller place is a smaller id
        lists = chunks.column("tid").combine_chunks()
        tid = lists.flatten().to_numpy()
        place = pc.list_parent_indices(lists).to_numpy()
        tf = chunks.column("tf").combine_chunks().flatten().to_numpy().astype("float64")
        gain = tf * (K.BM25_K1 + 1) / (tf + chunks.column("norm").to_numpy()[place])
        order = np.lexsort((place, tid))
        place, gain = place[order], gain[order]
        known, begins = np.unique(tid[order], return_index=True)
        ends = np.append(begins[1:], len(order))

        lists = asked.column("tid").combine_chunks()
        words, idfs = lists.flatten().to_numpy(), asked.column("idf").combine_chunks().flatten()
        idfs = idfs.to_numpy()
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        here = known[at] == words
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        queries, places, scores = [], [], []
        for q in np.flatnonzero(np.logical_and.reduceat(here, bounds[:-1])):
            mine = slice(bounds[q], bounds[q + 1])
            terms = at[mine]
            first = np.argsort(ends[terms] - begins[terms], kind="stable")
            docs = place[begins[terms[first[0]]]:ends[terms[first[0]]]]
            score = np.zeros(len(docs))
            for t, idf in zip(terms[first], idfs[mine][first]):
                piece = place[begins[t]:ends[t]]
                spot = np.minimum(np.searchsorted(piece, docs), len(piece) - 1)
                both = piece[spot] == docs
                docs, score = docs[both], score[both] + idf * gain[begins[t]:ends[t]][spot[both]]
                if not len(docs):
                    break
            # Rounded before ranking, so the order does not hang on the order of a float sum.
            score = np.round(score, 6)
            best = np.lexsort((docs, -score))[:k]
            queries.append(np.full(len(best), q))
            places.append(docs[best])
            scores.append(score[best])
        if queries:
            ids = (asked.column("_text_id"), chunks.column("chunk_id"))
            taken = [c.combine_chunks().take(pa.array(np.concatenate(x)))
                     for c, x in zip(ids, (queries, places))]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(np.concatenate(scores))],
                                             names=["query_id", "chunk_id", "score"])

    return rank


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return _unit(values.reshape(len(flat), -1))


def _keep_best(best, places: np.ndarray, scores: np.ndarray, k: int):
    """Best k per query so far: highest score first, ties by place."""
    places = np.broadcast_to(places, scores.shape)
    if best is not None:
        places = np.concatenate([best[0], places], axis=1)
        scores = np.concatenate([best[1], scores], axis=1)
    order = np.lexsort((places, -scores), axis=1)[:, :k]
    return np.take_along_axis(places, order, axis=1), np.take_along_axis(scores, order, axis=1)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = K.ARM_DEPTH) -> DataFrame:
    """Exact cosine search: (query_id, chunk_id, score, vec_rank).

    `queries`: (query_id, vector); `vectors`: (chunk_id, vector), filtered beforehand; vectors of
    one length. Blocks of queries and blocks of vectors are rows that meet in a grid of cells; a
    cell is matrix products and keeps k rows per query, so the shuffle carries cells x queries x k
    rows, never query-vector pairs. The driver sees neither side, and the plan does not change
    with the number of queries.
    """
    schema = (f"query_id {queries.schema['query_id'].dataType.simpleString()}, "
              f"chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double")

    def search(asked: pa.Table, chunks: pa.Table) -> Iterator[pa.RecordBatch]:
        by_id = chunks.sort_by("chunk_id")  # a smaller place is a smaller id
        ids, matrix = by_id.column("chunk_id").combine_chunks(), _matrix(by_id.column("vector"))
        unit_queries = _matrix(asked.column("vector"))
        for begin in range(0, len(unit_queries), SLICE):
            some, best = unit_queries[begin:begin + SLICE], None
            for at in range(0, len(matrix), SLICE):
                piece = matrix[at:at + SLICE]
                # Rounded, as ranks are decided on it.
                best = _keep_best(best, np.arange(at, at + len(piece)),
                                  np.round(some @ piece.T, 6), k)
            places, scores = best
            repeated = np.repeat(np.arange(begin, begin + len(some)), scores.shape[1])
            yield pa.RecordBatch.from_arrays(
                [asked.column("query_id").combine_chunks().take(pa.array(repeated)),
                 ids.take(pa.array(places.ravel())), pa.array(scores.ravel())],
                names=["query_id", "chunk_id", "score"])

    usable = F.col("vector").isNotNull()
    found = grid.meet(queries.filter(usable).select("query_id", "vector"),
                      vectors.filter(usable).select("chunk_id", "vector"), search, schema)
    return top_k(found, k, "vec_rank")


def hybrid_search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, limit: int,
                  site: str | None = None, confidence: str | None = None,
                  k: int = K.ARM_DEPTH) -> DataFrame:
    """Both arms and their fusion, with the filters inside both: (query_id, chunk_id, lex_rank,
    vec_rank, rrf_score, place).

    `queries`: (query_id, text, vector), where a null text or vector leaves that arm out;
    `chunks`: (chunk_id, content, site, confidence); `vectors`: (chunk_id, vector). Only chunks of
    the site and with at least the given confidence are ranked, counted and averaged, so a hit
    that is filtered out never takes the place of one that is not.
    """
    allowed = chunks
    if site is not None:
        allowed = allowed.filter(F.col("site") == site)
    if confidence is not None:
        allowed = min_confidence(allowed, confidence)
    lex = lexical_topk(queries.filter(F.col("text").isNotNull()).select("query_id", "text"),
                       allowed, k)
    vec = vector_topk(queries.select("query_id", "vector"),
                      vectors.join(allowed.select("chunk_id"), "chunk_id", "left_semi"), k)
    return rrf(lex, vec, limit)


def rrf(lex: DataFrame, vec: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion over the union of both candidate lists."""
    both = lex.select("query_id", "chunk_id", "lex_rank",
                      F.lit(None).cast("int").alias("vec_rank")).unionByName(
        vec.select("query_id", "chunk_id", F.lit(None).cast("int").alias("lex_rank"),
                   "vec_rank"))
    fused = both.groupBy("query_id", "chunk_id").agg(
        F.max("lex_rank").alias("lex_rank"), F.max("vec_rank").alias("vec_rank"))

    def share(rank: str):
        return F.coalesce(1.0 / (K.RRF_K + F.col(rank)), F.lit(0.0))

    scored = fused.withColumn("score", F.round(share("lex_rank") + share("vec_rank"), 9))
    return top_k(scored, limit, "place").withColumnRenamed("score", "rrf_score")


def evidence(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence rows, never an answer: content, where it is from, dates and both ranks.

    Driven from the candidates; the chunk table is only looked up."""
    wanted = ["chunk_id", "content", "path", "source_url", "last_verified_at", "confidence"]
    return fused.join(chunks.select(*[c for c in wanted if c in chunks.columns]), "chunk_id")


def retrieval_eval(results: DataFrame, gold: DataFrame, at: int = 5) -> DataFrame:
    """Share of questions answered within the first `at` results, and mean reciprocal rank.

    `results`: (query_id, chunk_id, place); `gold`: (query_id, chunk_id), every question has a
    row. A question never hit counts zero in both.
    """
    hits = results.join(gold, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(
        F.min("place").alias("first_hit"))
    asked = gold.select("query_id").distinct().join(hits, "query_id", "left")
    return asked.agg(
        F.count(F.lit(1)).alias("questions"),
        F.avg(F.coalesce((F.col("first_hit") <= at).cast("double"), F.lit(0.0))).alias("recall"),
        F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))).alias("mrr"))


def contamination(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Share of questions whose top hit belongs to another site.

    `results`: (query_id, place, site); `queries`: (query_id, site)."""
    asked = queries.select("query_id", F.col("site").alias("asked_site"))
    return results.filter(F.col("place") == 1).join(asked, "query_id").agg(
        F.count(F.lit(1)).alias("questions"),
        F.avg((F.col("site") != F.col("asked_site")).cast("double")).alias("contamination"))


def search_announcements(queries: DataFrame, announcements: DataFrame, k: int = K.ARM_DEPTH
                         ) -> DataFrame:
    """Lexical search over title and summary together."""
    both = announcements.select(F.col("ref").alias("chunk_id"), F.concat_ws(
        " ", "title", F.coalesce("summary", F.lit(""))).alias("content"))
    return lexical_topk(queries, both, k).withColumnRenamed("chunk_id", "ref")
