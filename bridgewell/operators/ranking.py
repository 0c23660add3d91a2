"""Rankers over candidate lists and their metrics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .lists import FLOOR, Lists, bm25_of, joined_words, scored, unfold
from .postings import Best, Postings
from .storage import saved


def bm25(pairs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """query_id, cand_id, the columns named in carry, score. pairs: query_id, query_text, cand_id, cand_text and those; a candidate stands once in a
    query. The candidates of a query are its corpus; a term's negative idf becomes FLOOR times the mean idf of the corpus."""
    # A query's rows are folded into one, so that they are shuffled once and no row for each word is made.
    slim = pairs.select("query_id", joined_words(F.col("query_text")).alias("query_words"), F.struct("cand_id", *carry, joined_words(F.col("cand_text")).alias("words")).alias("_c"))
    lists = Lists(slim.groupBy("query_id").agg(F.first("query_words", ignorenulls=True).alias("query_words"), F.collect_list("_c").alias("cands")))
    return unfold(scored(lists, {"score": bm25_of}, carry))


MOST_TERMS, MOST_QUERIES, BLOCK = 1 << 17, 4096, 4096  # about so many terms and queries are sent to every task; documents of a posting block


def bm25_corpus(queries: DataFrame, docs: DataFrame, k: int, most_queries: int = MOST_QUERIES, block: int = BLOCK) -> DataFrame:
    """query_id, doc_id, score (rounded), rank: the k best documents of the whole corpus with a score above 0 or a term of the query, ties to the smaller doc_id. queries:
    query_id, query_text; docs: doc_id, text.

    Of all terms only the number of documents is shuffled, summed in each task first. Documents are scored where they lie, in posting blocks of the asked terms; a task keeps the k best
    of each query, which tell it what further blocks must reach. Larger query sets are searched in several runs. Null and empty texts are documents without terms; queries
    of one id are one query with the terms of all.
    """
    spark, id_kind = queries.sparkSession, queries.schema["query_id"].dataType.simpleString()
    words = docs.select("doc_id", F.coalesce(tokens(F.lower("text")), F.array().cast("array<string>")).alias("w"))
    n_docs, average = words.agg(F.count("*"), F.avg(F.size("w"))).first()
    schema = f"query_id {id_kind}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    asked = queries.select("query_id", F.explode(tokens(F.lower("query_text"))).alias("term"))
    size = asked.agg(F.count_distinct("query_id").alias("q"), F.approx_count_distinct("term").alias("t")).first()
    runs = max(1, -(-size.q // most_queries), -(-size.t // MOST_TERMS))
    if not n_docs or not average:
        return top(spark.createDataFrame([], schema), "query_id", "doc_id", k)
    df = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.select("term", (F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    raw = raw if runs == 1 else saved(raw)
    out = None
    for run in range(runs):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(runs)) == run).groupBy("query_id", "term").agg(F.count("*").alias("times")).collect()  # MOST_TERMS and MOST_QUERIES, about
        terms = spark.createDataFrame([(t,) for t in sorted({r.term for r in own})], "term string")
        marked = raw.join(F.broadcast(terms.withColumn("own", F.lit(True))), "term", "left")
        mean, known = marked.agg(F.avg("idf"), F.collect_list(F.when(F.col("own"), F.struct("term", "idf")))).first()  # asked terms alone are listed
        idf = {r.term: r.idf if r.idf >= 0 else FLOOR * mean for r in known}
        code = {t: n for n, t in enumerate(idf)}
        weight: dict = {}
        for r in own:
            if r.term in idf:
                weight.setdefault(r.query_id, []).append((code[r.term], r.times * idf[r.term]))
        found = words.mapInArrow(_searched(spark.sparkContext.broadcast((list(code), weight)), k, average, block), schema)
        out = found if out is None else out.unionByName(found)
    return top(out, "query_id", "doc_id", k)


def _searched(sent, k: int, average: float, block: int):
    """The k best of each query among a task's documents."""

    def run(batches):
        terms, queries = sent.value
        values, best = pa.array(terms, pa.string()), {q: Best(k) for q in queries}
        held, kind = [], None

        def search() -> None:
            ids, sizes, doc, code, at = [], [], [], [], 0
            for b in held:
                w = b["w"]
                n = pc.list_value_length(w).to_numpy()
                where = pc.index_in(w.flatten(), value_set=values)
                hit = np.flatnonzero(where.is_valid().to_numpy(zero_copy_only=False))
                doc.append(np.repeat(np.arange(len(b)), n)[hit] + at)
                code.append(where.fill_null(0).to_numpy()[hit])
                sizes.append(n)
                ids += b["doc_id"].to_pylist()
                at += len(b)
            p = Postings(np.concatenate(sizes), np.concatenate(doc), np.concatenate(code), average)
            for q, own in queries.items():
                found, score = p.search([c for c, _ in own], [w for _, w in own], best[q].floor)
                if len(found):
                    best[q].add(score, found, ids)

        for b in batches:
            kind = b.schema.field("doc_id").type
            for lo in range(0, len(b), block):
                held.append(b.slice(lo, block))
                if sum(map(len, held)) >= block:
                    search()
                    held.clear()
        if held:
            search()
        rows = [(q, i, -s) for q, x in best.items() for s, _, i in x.rows]
        if rows:
            q, i, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i, kind), pa.array(s, pa.float64())], ["query_id", "doc_id", "score"])

    return run


def top(scores: DataFrame, query: str, cand: str, k: int | None = None) -> DataFrame:
    """With the rank by falling score, ties to the smaller candidate; the first k if given."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.asc(cand))))
    return out if k is None else out.where(F.col("rank") <= k)


def category_bonus(score: Column, best: Column, equal: Column, weight: float = 0.3) -> Column:
    """A share 1 - weight of the score, plus weight times the query's best score where the category is equal; a best score that is not positive counts as 1."""
    return (1 - weight) * score + weight * F.when(equal, F.when(best > 0, best).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))


def with_category_bonus(scores: DataFrame, equal: Column, weight: float = 0.3) -> DataFrame:
    """The score with category_bonus(), by rows."""
    return scores.withColumn("score", category_bonus(F.col("score"), F.max("score").over(Window.partitionBy("query_id")), equal, weight))


def hybrid_score(bm25: Column, best: Column, cosine: Column, attributes: Column, same: Column) -> Column:
    """best: the query's best bm25; same: 0 or 1."""
    return 0.2 * bm25 / (best + 1e-6) + 0.3 * cosine + 0.3 * attributes + 0.2 * same


def hybrid(parts: DataFrame) -> DataFrame:
    """parts: query_id, cand_id, bm25, cosine, attributes, same (0 or 1)."""
    return parts.withColumn("score", hybrid_score(F.col("bm25"), F.max("bm25").over(Window.partitionBy("query_id")), F.col("cosine"), F.col("attributes"), F.col("same")))


def labelled_ranks(scores: DataFrame) -> DataFrame:
    """query_id, rank of the candidate with label 1, null without one. scores: query_id, cand_id, label, score."""
    return top(scores, "query_id", "cand_id").groupBy("query_id").agg(F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("rank"))


def true_ranks(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, rank of the candidate with label 1; null where it is missing."""
    hit = ranked.join(labels.where("label = 1").select("query_id", "cand_id"), ["query_id", "cand_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return labels.select("query_id").distinct().join(hit, "query_id", "left")


def metrics(ranks: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """One row: hr_at_k, ndcg_at_k, n_queries."""
    hit = F.col("rank") <= k
    return ranks.agg(
        F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), digits).alias("hr_at_k"),
        F.round(F.avg(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)), digits).alias("ndcg_at_k"), F.count("*").alias("n_queries"))


def pair_loss(pairs: DataFrame, pos: str = "pos", neg: str = "neg") -> DataFrame:
    """One row: the mean of -log sigmoid(pos - neg)."""
    return pairs.agg(F.round(F.avg(F.log1p(F.exp(F.col(neg) - F.col(pos)))), 6).alias("loss"))


def margin_loss(pairs: DataFrame, margin: float, pos: str = "pos", neg: str = "neg") -> DataFrame:
    return pairs.agg(F.round(F.avg(F.greatest(F.lit(0.0), F.lit(margin) - (F.col(pos) - F.col(neg)))), 6).alias("loss"))
