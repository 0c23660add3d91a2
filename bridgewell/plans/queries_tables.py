"""Queries of joins, aggregations, windows, samples, set operations, and the table pipelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import keys as K
from ..operators import quality as A
from ..operators import sampling as W
from . import pipelines as L
from .queries_text import CLEAN, PART_RULES, SPECS_SQL, STD, _case, paragraphs_sql
from .roles import BENCH, INTERACTIONS, ITEMS, LOCAL, PAIRS, PURCHASES, TEXTS, bench, draw_sql, interactions, items, local, pairs, purchases, query, quota, table, texts

# Joins


@query("j1_positive_pairs", f"WITH {ITEMS}, {PAIRS} SELECT query_id, true_id, category, 1 AS label FROM pairs")
def _(spark, d):
    i = items(spark, d)
    a = i.where("domain = 'amazon'").select(F.col("item_id").alias("query_id"), "category", F.col("asin").alias("query_key"))
    b = i.where("domain = 'vn'").select(F.col("item_id").alias("true_id"), F.col("asin").alias("item_key"))
    return K.positives(a, b, "query_key", "item_key").select("query_id", "true_id", "category", "label")


@query("j2_same_category_pairs", "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_custkey <> s.s_suppkey")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return K.same_key_pairs(c, s, "nation", "c_custkey").where("c_custkey <> s_suppkey").select("c_custkey", "s_suppkey")


@query("j4_inner", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("j5_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return K.known(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


FRONTIER = """done AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 0),
f AS (SELECT c_mktsegment AS source, c.*, done.k FROM customer c LEFT JOIN done ON c_nationkey = k)"""


@query("j6_frontier", f"WITH {FRONTIER} SELECT source, count(*) AS n_rows, count(k) AS n_removed, count(*) - count(k) AS n_left FROM f GROUP BY source")
def _(spark, d):
    done = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("c_nationkey"))
    return K.frontier(table(spark, d, "customer").withColumnRenamed("c_mktsegment", "source"), done, "c_nationkey", "source")


@query("j7_conflicts", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority")
    return K.unknown(o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority = '5-LOW'"), "o_custkey").select("o_custkey").dropDuplicates(["o_custkey"])


@query("j9_override", "SELECT d.doc_id, coalesce('q' || l.quality, d.source) AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    new = table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"))
    return K.override(table(spark, d, "documents").select("doc_id", "source"), new, "doc_id", "source")


@query("j10_enrich", "SELECT o_custkey, c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_name")
def _(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return g.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("o_custkey", "c_name", "n")


@query("j11_lookup", "SELECT b.vec_id, a.label AS other FROM embeddings b JOIN embeddings a ON a.vec_id = b.vec_id // 2")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.expr("vec_id div 2").alias("k")).join(e.select(F.col("vec_id").alias("k"), F.col("label").alias("other")), "k").select("vec_id", "other")


@query("j12_shared_keys", "SELECT count(*) AS n_shared FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def _(spark, d):
    return K.shared_keys(table(spark, d, "customer").withColumnRenamed("c_nationkey", "k"), table(spark, d, "supplier").withColumnRenamed("s_nationkey", "k"), "k")


# Aggregations

BLANK = "CAST(sum(CASE WHEN coalesce({0}, '') = '' THEN 1 ELSE 0 END) AS BIGINT)"


@query("a1_interaction_report", f"""WITH {INTERACTIONS} SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT product_id) AS n_items,
  {BLANK.format('user_id')} AS blank_users, {BLANK.format('product_id')} AS blank_items, min(rating) AS min_rating, max(rating) AS max_rating, round(avg(rating), 6) AS avg_rating FROM inter""")
def _(spark, d):
    return A.interaction_report(interactions(spark, d))


@query("a2_item_report", f"WITH {TEXTS} SELECT count(*) AS n_rows, count(DISTINCT product_id) AS n_items, {BLANK.format('full_text')} AS blank_texts, round(avg(length(full_text)), 6) AS avg_length FROM texts")
def _(spark, d):
    return A.item_report(texts(spark, d))


@query("a3_rating_histogram", "SELECT l_quantity AS rating, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1")
def _(spark, d):
    return A.counts_by(table(spark, d, "lineitem").withColumnRenamed("l_quantity", "rating"), "rating").orderBy("rating")


@query("a4_count_per_domain", f"WITH {INTERACTIONS} SELECT domain, count(*) AS n FROM inter GROUP BY domain")
def _(spark, d):
    return A.counts_by(interactions(spark, d), "domain")


@query("a5_grouped_candidates", f"{BENCH} SELECT query_id, string_agg(cand_id || ':' || label, ',' ORDER BY cand_id) AS candidates FROM bench GROUP BY query_id")
def _(spark, d):
    g = bench(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("cand_id", "label"))).alias("c"))
    return g.select("query_id", F.array_join(F.transform("c", lambda x: F.concat(x["cand_id"].cast("string"), F.lit(":"), x["label"].cast("string"))), ",").alias("candidates"))


@query("a6_wide_grouping", "SELECT conv_id, string_agg(role, ',' ORDER BY turn, role, text) AS roles, string_agg(length(text)::VARCHAR, ',' ORDER BY turn, role, text) AS lengths, count(*) AS n FROM conversations GROUP BY conv_id")
def _(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("c"), F.count("*").alias("n"))
    return g.select("conv_id", F.array_join(F.transform("c", lambda x: x["role"]), ",").alias("roles"), F.array_join(F.transform("c", lambda x: F.length(x["text"]).cast("string")), ",").alias("lengths"), "n")


@query("a7_joined_categories", "SELECT p_name AS name, string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) AS category FROM part GROUP BY p_name")
def _(spark, d):
    return A.join_sorted_set(table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("category")), "name", "category")


@query("a8_duplicates", "SELECT count(*) AS n_rows, count(DISTINCT text) AS n_texts, count(*) - count(DISTINCT text) AS n_removed FROM documents")
def _(spark, d):
    by = table(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_texts"), (F.sum("n") - F.count("*")).alias("n_removed"))


@query("a9_distinct_queries", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
def _(spark, d):
    return table(spark, d, "orders").agg(F.countDistinct("o_custkey").alias("n"))


@query("a11_items_per_category", "SELECT p_type AS category, count(*) AS n, md5(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey)) AS ids FROM part GROUP BY p_type")
def _(spark, d):
    g = table(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("p_partkey")).alias("l"))
    return g.select("category", "n", F.md5(F.array_join(F.transform("l", lambda x: x.cast("string")), ",")).alias("ids"))


@query("a12_active_users", f"WITH {INTERACTIONS} SELECT user_id, count(*) AS n FROM inter GROUP BY user_id HAVING count(*) > 1")
def _(spark, d):
    return A.counts_by(interactions(spark, d), "user_id").where("n > 1")


@query("a13_price_by_rating", """SELECT l_quantity AS rating, min(l_extendedprice) AS least, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS q3, max(l_extendedprice) AS largest, count(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, d):
    return A.distribution_by(table(spark, d, "lineitem").withColumnRenamed("l_quantity", "rating"), "rating", "l_extendedprice")


@query("a14_length_histogram", """SELECT CASE WHEN n < 0 THEN 0 WHEN n >= 512 THEN 101 ELSE 1 + CAST(floor(n * 100 / 512.0) AS BIGINT) END AS bin, count(*) AS n
  FROM (SELECT len(string_split(text, ' ')) AS n FROM documents) GROUP BY 1""")
def _(spark, d):
    return A.histogram(table(spark, d, "documents").select(T.word_count(F.col("text")).alias("w")), F.col("w"), 0.0, 512.0, 100)


# Windows, negatives, splits


@query("w1_capped", f"WITH {ITEMS}, {LOCAL} SELECT item_id, category FROM placed WHERE rank < 50")
def _(spark, d):
    return W.cap_per_group(local(spark, d), "category", "item_id", 50)


@query("w2_same_category", f"""WITH {ITEMS}, {PAIRS}, {LOCAL},
n AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY md5('42|' || query_id || '|' || item_id), item_id) AS n FROM pairs JOIN local USING (category) WHERE item_id <> true_id)
SELECT query_id, item_id FROM n WHERE n <= 99""")
def _(spark, d):
    return W.same_category_negatives(pairs(spark, d), local(spark, d))


@query("w3_any_category", f"""WITH {ITEMS}, {PAIRS}, {LOCAL}, t AS (SELECT count(*) AS total FROM local),
runs AS (SELECT query_id, true_id, pairs.category AS qc, i, ({draw_sql('42a', 'total', 'query_id')} + i) % total AS place FROM pairs, t, range(0, 100) r(i) WHERE i <= least(99, total - 1)),
n AS (SELECT query_id, item_id, qc = category AS is_hard, row_number() OVER (PARTITION BY query_id ORDER BY i) AS n FROM runs JOIN placed USING (place) WHERE item_id <> true_id)
SELECT query_id, item_id, is_hard FROM n WHERE n <= 99""")
def _(spark, d):
    return W.any_negatives(pairs(spark, d), local(spark, d))


@query("w4_labelled", f"{BENCH} SELECT query_id, cand_id, label FROM bench")
def _(spark, d):
    return bench(spark, d).select("query_id", "cand_id", "label")


@query("w5_quota", f"{BENCH} SELECT query_id, item_id, is_hard FROM taken")
def _(spark, d):
    return quota(spark, d)


@query("w6_shuffled", f"{BENCH} SELECT query_id, cand_id, row_number() OVER (PARTITION BY query_id ORDER BY md5('42|' || query_id || '|' || cand_id), cand_id) AS position FROM bench")
def _(spark, d):
    return bench(spark, d).select("query_id", "cand_id", "position")


@query("w7_one_truth", "SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def _(spark, d):
    return K.one_per_key(table(spark, d, "part"), ["p_name"], [F.col("p_partkey")]).select("p_name", "p_partkey")


@query("w8_triplets", f"""WITH {ITEMS}, {LOCAL}, a AS (SELECT p.*, s.size, s.start, s.total FROM placed p JOIN sizes s USING (category) WHERE size > 1 AND total > size),
b AS (SELECT item_id AS anchor_id, start + (rank + 1 + {draw_sql('42p', 'size - 1', 'item_id')}) % size AS pp, (start + size + {draw_sql('42q', 'total - size', 'item_id')}) % total AS qq FROM a)
SELECT anchor_id, p.item_id AS positive_id, q.item_id AS negative_id FROM b JOIN placed p ON p.place = pp JOIN placed q ON q.place = qq""")
def _(spark, d):
    return W.triplets(local(spark, d))


EDGES = f"""{INTERACTIONS}, e AS (SELECT DISTINCT user_id, product_id FROM inter WHERE user_id IS NOT NULL AND product_id IS NOT NULL),
u AS (SELECT user_id, row_number() OVER (ORDER BY substr(md5(user_id), 1, 2), user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM e)),
p AS (SELECT product_id, row_number() OVER (ORDER BY substr(md5(product_id), 1, 2), product_id) - 1 AS item_idx FROM (SELECT DISTINCT product_id FROM e)),
edges AS (SELECT user_idx, item_idx FROM e JOIN u USING (user_id) JOIN p USING (product_id))"""


def edges(spark, d):
    from ..operators.graph import bipartite

    i = interactions(spark, d)
    return bipartite(i, i)


@query("w10_random_negatives", f"WITH {EDGES} SELECT user_idx, item_idx, {draw_sql('42', '(SELECT max(item_idx) + 1 FROM edges)', 'user_idx', 'item_idx')} AS neg_idx FROM edges")
def _(spark, d):
    return W.random_items(edges(spark, d))


@query("w11_split", f"WITH {EDGES} SELECT user_idx, item_idx, CASE WHEN {draw_sql('42', '100', 'user_idx', 'item_idx')} < 90 THEN 'train' ELSE 'test' END AS part FROM edges")
def _(spark, d):
    return W.split(edges(spark, d), 90, "user_idx", "item_idx")


LOO = f"""{EDGES}, us AS (SELECT user_idx, row_number() OVER (ORDER BY md5('42|' || user_idx), user_idx) AS n FROM (SELECT user_idx FROM edges GROUP BY 1 HAVING count(*) > 1)),
hid AS (SELECT user_idx, item_idx, CASE WHEN us.n % 2 = 1 THEN 'val' ELSE 'test' END AS part,
  row_number() OVER (PARTITION BY user_idx ORDER BY md5('42e|' || user_idx || '|' || item_idx), item_idx) AS k FROM edges JOIN us USING (user_idx) WHERE us.n <= 500),
loo AS (SELECT e.user_idx, e.item_idx, coalesce(h.part, 'train') AS part FROM edges e LEFT JOIN (SELECT * FROM hid WHERE k = 1) h USING (user_idx, item_idx))"""


@query("w12_leave_one_out", f"WITH {LOO} SELECT user_idx, item_idx, part FROM loo")
def _(spark, d):
    return W.leave_one_out(edges(spark, d))


@query("w13_train_sample", f"WITH {LOO}, t AS (SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY md5('7|' || user_idx || '|' || item_idx), item_idx) AS n FROM loo WHERE part = 'train') SELECT user_idx, item_idx FROM t WHERE n = 1 ORDER BY md5('7|' || user_idx), user_idx LIMIT 500")
def _(spark, d):
    train = W.leave_one_out(edges(spark, d)).where("part = 'train'")
    one = K.one_per_key(train, ["user_idx"], [W.order_key(7, F.col("user_idx"), F.col("item_idx")), F.col("item_idx")])
    return one.orderBy(W.order_key(7, F.col("user_idx")), "user_idx").limit(500).select("user_idx", "item_idx")


@query("w14_random_position", f"""{BENCH}, f AS (SELECT query_id, cand_id, row_number() OVER (PARTITION BY query_id ORDER BY cand_id) - 1 AS n FROM bench WHERE label = 0)
SELECT query_id, cand_id FROM f WHERE n = {draw_sql('14', '99', 'query_id')}""")
def _(spark, d):
    w = Window.partitionBy("query_id").orderBy("cand_id")
    f = bench(spark, d).where("label = 0").withColumn("n", F.row_number().over(w) - 1)
    return f.where(F.col("n") == W.draw(14, F.lit(99), F.col("query_id"))).select("query_id", "cand_id")


# Sorts, limits, samples


@query("o1_global_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("o2_first_per_domain", f"WITH {TEXTS} SELECT product_id, domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY product_id) AS n FROM texts) WHERE n <= 100")
def _(spark, d):
    w = Window.partitionBy("domain").orderBy("product_id")
    return texts(spark, d).select("product_id", "domain").withColumn("n", F.row_number().over(w)).where("n <= 100").drop("n")


@query("o3_sample", f"SELECT event_id FROM events WHERE {draw_sql('42', '100', 'event_id')} < 2")
def _(spark, d):
    return table(spark, d, "events").where(W.draw(42, F.lit(100), F.col("event_id")) < 2).select("event_id")


@query("o5_dense_ids", "SELECT p_name AS name, row_number() OVER (ORDER BY substr(md5(p_name), 1, 2), p_name) - 1 AS idx FROM (SELECT DISTINCT p_name FROM part)")
def _(spark, d):
    return K.dense_ids(table(spark, d, "part").select(F.col("p_name").alias("name")), "name")


# Set operations and deduplication


@query("u1_dedup", f"""WITH {INTERACTIONS} SELECT user_id, product_id, rating, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY rating DESC, ts, event_id) AS n FROM inter) WHERE n = 1""")
def _(spark, d):
    return K.one_per_key(interactions(spark, d), ["user_id", "product_id"], [F.desc("rating"), F.col("ts"), F.col("event_id")]).select("user_id", "product_id", "rating", "ts")


@query("u2_newest", f"""WITH {INTERACTIONS} SELECT user_id, product_id, rating, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY ts DESC, event_id) AS n FROM inter) WHERE n = 1""")
def _(spark, d):
    return K.newest(interactions(spark, d), ["user_id", "product_id"], "ts", F.col("event_id")).select("user_id", "product_id", "rating", "ts")


@query("u3_union", "SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def _(spark, d):
    return K.union_all([table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), table(spark, d, "supplier").select(F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("k"))])


@query("u4_union_missing", "SELECT c_custkey AS k, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, NULL FROM supplier")
def _(spark, d):
    return K.union_all([table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))], missing=True)


@query("u5_merge_lists", "SELECT k, count(*) - 1 AS dropped FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def _(spark, d):
    both = K.union_all([table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))])
    return both.groupBy("k").agg((F.count("*") - 1).alias("dropped"))


@query("u6_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


# Pipelines over tables


@query("q1_interactions", f"""WITH {PURCHASES}, {INTERACTIONS}, b AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(product_id AS VARCHAR) AS product_id, rating, 'amazon' AS domain, l_orderkey * 10 + l_linenumber AS tie FROM purchases
  UNION ALL SELECT {STD('user_id')}, {STD('product_id')}, rating, 'vn', event_id FROM inter)
SELECT user_id, product_id, rating, domain FROM (SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY rating DESC, domain, tie) AS n FROM b WHERE user_id <> '' AND product_id <> '') WHERE n = 1""")
def _(spark, d):
    a = purchases(spark, d).withColumn("tie", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return L.interactions([(a, "amazon"), (interactions(spark, d).withColumn("tie", F.col("event_id")), "vn")], "tie")


@query("q2_item_nodes", f"""WITH {ITEMS}, t AS (SELECT CAST(doc_id AS VARCHAR) AS product_id, {CLEAN('text')} AS full_text, {_case('text', T.CATEGORY_RULES)} AS category, CASE WHEN lang = 'en' THEN 'amazon' ELSE 'vn' END AS domain FROM documents)
SELECT product_id, domain, category, length(full_text) AS n_chars, md5(full_text) AS text_md5 FROM t WHERE full_text <> ''""")
def _(spark, d):
    nodes = L.item_nodes(table(spark, d, "documents"), {"product_id": (("doc_id",), "string"), "name": (("title",), "string"), "description": (("text",), "string"), "lang": (("lang",), "string")}, F.when(F.col("lang") == "en", "amazon").otherwise("vn"))
    return nodes.select("product_id", "domain", "category", F.length("full_text").cast("long").alias("n_chars"), F.md5("full_text").alias("text_md5"))


@query("q2_structured_items", f"WITH {ITEMS} SELECT item_id, domain, {_case('name', PART_RULES)} AS kind, {SPECS_SQL} AS specs FROM items")
def _(spark, d):
    return items(spark, d).select("item_id", "domain", T.category_of(F.col("name"), PART_RULES).alias("kind"), T.map_text(T.parse_specs(F.col("raw_specs"))).alias("specs"))


@query("q3_latest_interactions", f"""WITH {PURCHASES} SELECT user_id, product_id, rating, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY ts DESC, l_orderkey, l_linenumber) AS n FROM purchases) WHERE n = 1""")
def _(spark, d):
    return L.latest_interactions(purchases(spark, d), F.col("l_orderkey"), F.col("l_linenumber")).select("user_id", "product_id", "rating", "ts")


@query("q4_item_texts", "SELECT name, text FROM (SELECT p_name AS name, concat_ws(' | ', p_name, p_brand, p_type) AS text, row_number() OVER (PARTITION BY p_name ORDER BY concat_ws(' | ', p_name, p_brand, p_type)) AS n FROM part) WHERE n = 1")
def _(spark, d):
    return L.item_texts(table(spark, d, "part"), "p_name", ["p_name", "p_brand", "p_type"]).select(F.col("key").alias("name"), "text")


@query("q5_catalog_union", """WITH u AS (SELECT p_partkey AS k, p_name AS title, NULL AS size FROM part UNION ALL SELECT p_partkey, NULL, p_size FROM part WHERE p_size > 5),
o AS (SELECT k, max(title) AS title, max(size) AS size FROM u GROUP BY k) SELECT k, title, CAST(size AS DOUBLE) AS size FROM o WHERE k IN (SELECT l_partkey FROM lineitem)""")
def _(spark, d):
    p = table(spark, d, "part")
    return L.catalog_union([p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("title")), p.where("p_size > 5").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("size"))], table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), "k")


def _listed(cte: str, rows: str) -> str:
    """A row for each query: how many candidates, how many true ones, and their ids in seeded order."""
    return f"""{cte} SELECT query_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, md5(string_agg(CAST(cand_id AS VARCHAR), ',' ORDER BY md5('42|' || query_id || '|' || cand_id), cand_id)) AS candidates FROM {rows} GROUP BY query_id"""


def listed(lists):
    label = F.aggregate(F.transform("cands", lambda x: x["label"].cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    text = F.array_join(F.transform("cands", lambda x: x["cand_id"].cast("string")), ",")
    return lists.select("query_id", F.size("cands").cast("long").alias("n"), label.alias("positives"), F.md5(text).alias("candidates"))


TRUE = "SELECT query_id, true_id AS cand_id, 1 AS label FROM pairs WHERE query_id IN (SELECT query_id FROM taken_) UNION ALL SELECT query_id, item_id, 0 FROM taken_"


@query("q6_eval_dataset", _listed(BENCH, "bench"))
def _(spark, d):
    return listed(L.eval_lists(pairs(spark, d), local(spark, d), "quota"))


@query("q6_eval_same_category", _listed(f"""WITH {ITEMS}, {PAIRS}, {LOCAL},
n AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY md5('42|' || query_id || '|' || item_id), item_id) AS n FROM pairs JOIN local USING (category) WHERE item_id <> true_id),
taken_ AS MATERIALIZED (SELECT query_id, item_id FROM n WHERE n <= 99), listed AS ({TRUE})""", "listed"))
def _(spark, d):
    return listed(L.eval_lists(pairs(spark, d), local(spark, d), "same_category"))


@query("q6_eval_any", _listed(f"""WITH {ITEMS}, {PAIRS}, {LOCAL}, t AS (SELECT count(*) AS total FROM local),
runs AS (SELECT query_id, true_id, i, ({draw_sql('42a', 'total', 'query_id')} + i) % total AS place FROM pairs, t, range(0, 100) r(i) WHERE i <= least(99, total - 1)),
n AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY i) AS n FROM runs JOIN placed USING (place) WHERE item_id <> true_id),
taken_ AS MATERIALIZED (SELECT query_id, item_id FROM n WHERE n <= 99), listed AS ({TRUE})""", "listed"))
def _(spark, d):
    return listed(L.eval_lists(pairs(spark, d), local(spark, d), "any"))


def _cells(section: str, cte: str, columns: list[str]) -> str:
    return f"SELECT '{section}' AS section, unnest([{', '.join(repr(c) for c in columns)}]) AS name, unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in columns)}]) AS value FROM {cte}"


COUNTS = "SELECT '{0}', CAST({1} AS VARCHAR), CAST(count(*) AS DOUBLE) FROM {2} GROUP BY {1}"


@query("q7_validate", f"""WITH {PURCHASES}, p AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(product_id AS VARCHAR) AS product_id, CAST(rating AS DOUBLE) AS rating, CASE WHEN l_linenumber % 2 = 0 THEN 'amazon' ELSE 'vn' END AS domain FROM purchases),
r AS (SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT product_id) AS n_items, {BLANK.format('user_id')} AS blank_users, {BLANK.format('product_id')} AS blank_items,
  min(rating) AS min_rating, max(rating) AS max_rating, round(avg(rating), 6) AS avg_rating FROM p)
{_cells('all', 'r', ['n_rows', 'n_users', 'n_items', 'blank_users', 'blank_items', 'min_rating', 'max_rating', 'avg_rating'])} UNION ALL {COUNTS.format('domain', 'domain', 'p')} UNION ALL {COUNTS.format('rating', 'rating', 'p')}""")
def _(spark, d):
    p = purchases(spark, d).select(F.col("user_id").cast("string").alias("user_id"), F.col("product_id").cast("string").alias("product_id"), F.col("rating").cast("double").alias("rating"), F.when(F.col("l_linenumber") % 2 == 0, "amazon").otherwise("vn").alias("domain"))
    return L.validate(p, "interactions")


@query("q7_validate_items", f"""WITH {TEXTS}, r AS (SELECT count(*) AS n_rows, count(DISTINCT product_id) AS n_items, {BLANK.format('full_text')} AS blank_texts, round(avg(length(full_text)), 6) AS avg_length FROM texts)
{_cells('all', 'r', ['n_rows', 'n_items', 'blank_texts', 'avg_length'])} UNION ALL {COUNTS.format('domain', 'domain', 'texts')}""")
def _(spark, d):
    return L.validate(texts(spark, d), "items")


@query("q10_crawl_merge", "SELECT p.p_partkey, coalesce(c.category, p.p_type) AS category FROM part p LEFT JOIN (SELECT p_name, string_agg(DISTINCT p_brand, ' | ' ORDER BY p_brand) AS category FROM part WHERE p_size > 25 GROUP BY p_name) c USING (p_name)")
def _(spark, d):
    p = table(spark, d, "part")
    trails = p.where("p_size > 25").select(F.col("p_name").alias("key"), F.col("p_brand").alias("category"))
    return L.crawl_merge(p.select("p_partkey", F.col("p_name").alias("key"), F.col("p_type").alias("category")), trails, "p_partkey").select("p_partkey", "category")


FRONTIERS = """WITH done AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), every AS (SELECT 'orders' AS source, o_custkey AS k FROM orders UNION ALL SELECT 'customers', c_custkey FROM customer)"""


def frontiers(spark, d):
    o = table(spark, d, "orders")
    return L.crawl_frontier({"orders": o.select(F.col("o_custkey").alias("k")), "customers": table(spark, d, "customer").select(F.col("c_custkey").alias("k"))}, o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), "k")


@query("q11_crawl_frontier", f"{FRONTIERS} SELECT DISTINCT k FROM every WHERE k NOT IN (SELECT k FROM done)")
def _(spark, d):
    return frontiers(spark, d)[0]


@query("q11_crawl_counts", f"{FRONTIERS} SELECT source, count(*) AS n_rows, count(done.k) AS n_removed, count(*) - count(done.k) AS n_left FROM every LEFT JOIN done USING (k) GROUP BY source")
def _(spark, d):
    return frontiers(spark, d)[1]


@query("q12_eda_report", """WITH i AS (SELECT p_partkey AS item_id, CASE WHEN p_size % 7 > 0 THEN p_name END AS title, p_name || ' ' || p_brand || ' ' || p_type AS details,
  CASE WHEN p_partkey % 5 > 0 THEN TRY_CAST(replace(format('{:,.2f}', p_retailprice), ',', '') AS DOUBLE) END AS price FROM part),
w AS (SELECT len(string_split(details, ' ')) AS n FROM i),
x AS (SELECT CAST(l_quantity AS DOUBLE) AS rating, price FROM lineitem JOIN i ON item_id = l_partkey WHERE price < 1500),
b AS (SELECT CAST(rating AS VARCHAR) AS name, min(price) AS least, round(quantile_cont(price, 0.25), 6) AS q1, round(quantile_cont(price, 0.5), 6) AS median, round(quantile_cont(price, 0.75), 6) AS q3, max(price) AS largest, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY rating)
SELECT 'words' AS section, CAST(CASE WHEN n >= 6 THEN 101 ELSE 1 + CAST(floor(n * 100 / 6.0) AS BIGINT) END AS VARCHAR) AS name, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY 2
UNION ALL SELECT 'long', 'all', CAST(count(*) FILTER (n > 6) AS DOUBLE) FROM w
UNION ALL SELECT 'both', 'all', CAST(count(*) AS DOUBLE) FROM (SELECT * FROM i WHERE title IS NOT NULL AND details IS NOT NULL ORDER BY item_id LIMIT 1000)
UNION ALL SELECT 'price ' || k, name, value FROM (SELECT name, unnest(['least', 'q1', 'median', 'q3', 'largest', 'n']) AS k, unnest([least, q1, median, q3, largest, n]) AS value FROM b)""")
def _(spark, d):
    p = table(spark, d, "part")
    items_ = p.select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_size") % 7 > 0, F.col("p_name")).alias("title"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("details"),
        F.concat(F.lit("from $"), F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(F.format_number("p_retailprice", 2))).alias("price"))
    reviews = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("rating"))
    return L.eda_report(items_, reviews, 6, 1500.0, 1000)


@query("q13_page_extract", f"""SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, len({paragraphs_sql('html')}) AS n_texts
  FROM pages WHERE NOT (lower(url) LIKE '%captcha%' OR html LIKE '%automated access%')""")
def _(spark, d):
    return L.page_extract(table(spark, d, "pages")).select("page_id", "title", F.size("texts").cast("long").alias("n_texts"))
