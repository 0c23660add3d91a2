"""Pipelines composed of the operators: files or tables in, canonical tables out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import text as T
from ..functions import vectors as V
from ..operators import graph as G
from ..operators import keys as K
from ..operators import lists as C
from ..operators import quality as A
from ..operators import ranking as R
from ..operators import retrieval as N
from ..operators import sampling as W


def interactions(sources: Sequence[tuple[DataFrame, str]], tie: str) -> DataFrame:
    """user_id, product_id, rating, domain of all sources: standardised keys, no empty ones, one row for each pair (the best rating first)."""
    rows = [df.select(T.standardize(F.col("user_id")).alias("user_id"), T.standardize(F.col("product_id")).alias("product_id"), F.coalesce(F.col("rating").try_cast("double"), F.lit(0.0)).alias("rating"), F.lit(domain).alias("domain"), F.col(tie).alias("_tie")) for df, domain in sources]
    good = K.with_keys(K.union_all(rows), "user_id", "product_id")
    return K.one_per_key(good, ["user_id", "product_id"], [F.desc("rating"), F.col("domain"), F.col("_tie")]).drop("_tie")


def item_nodes(df: DataFrame, fields: Mapping[str, tuple[Sequence[str], str]], domain: Column) -> DataFrame:
    """product_id, full_text (cleaned name and description), category (of the raw text), domain: one row for each product, none without text.

    fields: where product_id, name, description and what `domain` needs are found.
    """
    mapped = K.map_fields(df, fields).withColumn("_raw", F.concat_ws(" ", "name", "description"))
    nodes = mapped.select("product_id", T.clean_text(F.col("_raw")).alias("full_text"), T.category_of(F.col("_raw")).alias("category"), domain.alias("domain"))
    # A filter on the cleaned text would be pushed below the projection and clean each text twice; inside the aggregate it is cleaned once.
    least = F.min(F.when(F.col("full_text") != "", F.struct("full_text", "category", "domain"))).alias("n")
    return K.with_keys(nodes, "product_id").groupBy("product_id").agg(least).where("n is not null").select("product_id", "n.full_text", "n.category", "n.domain")


def latest_interactions(df: DataFrame, *tie: Column) -> DataFrame:
    return K.newest(df.dropna(subset=["user_id", "product_id"]), ["user_id", "product_id"], "ts", *tie)


def item_texts(df: DataFrame, key: str, parts: Sequence[str], sep: str = " | ") -> DataFrame:
    """key and text: the parts joined, one row for each key."""
    rows = df.select(F.col(key).alias("key"), F.concat_ws(sep, *parts).alias("text")).dropna(subset=["key"])
    return K.one_per_key(rows, ["key"], [F.col("text")])


def catalog_union(parts: Sequence[DataFrame], used: DataFrame, key: str) -> DataFrame:
    """The parts by name, one row for each key with the largest known values, of keys that are used."""
    every = K.union_all(parts, missing=True).dropna(subset=[key])
    one = every.groupBy(key).agg(*[F.max(c).alias(c) for c in every.columns if c != key])
    return K.known(one, used, key)


def crawl_merge(rows: DataFrame, trails: DataFrame, tie: str) -> DataFrame:
    """rows (key, category) with the categories that the trails give their keys."""
    return K.override(rows, A.join_sorted_set(trails, "key", "category"), "key", "category")


def crawl_frontier(lists: Mapping[str, DataFrame], done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Keys of all lists that are not done, each once; and for each list its rows, those removed and those left."""
    rows = K.union_all([df.select(F.lit(name).alias("source"), key) for name, df in lists.items()])
    return K.unknown(rows, done, key).select(key).dropDuplicates([key]), K.frontier(rows, done, key, "source")


STRATEGIES = ("same_category", "any", "quota")


def eval_lists(pairs: DataFrame, items: DataFrame, strategy: str = "quota", seed: int = 42) -> DataFrame:
    """query_id, cands (cand_id, label) in seeded order: the true item of each pair (query_id, true_id, category; each query once) and its negatives from items (item_id, category), by
    the strategy: 99 of the query's category, 99 of any, or 70 of the category and 29 of others."""
    if strategy == "same_category":
        return W.benchmark_lists(W.same_category_lists(pairs, items, seed=seed), "items", seed=seed)
    if strategy == "any":
        return W.benchmark_lists(W.any_lists(pairs, items, seed=seed), "items", seed=seed)
    if strategy == "quota":
        return W.benchmark_lists(W.quota_lists(pairs, items, seed=seed), "hard", "easy", seed=seed)
    raise ValueError(f"strategy is one of {STRATEGIES}")


def eval_dataset(pairs: DataFrame, items: DataFrame, strategy: str = "quota", seed: int = 42) -> DataFrame:
    """query_id, cand_id, label, position (from 1): the rows of eval_lists()."""
    rows = eval_lists(pairs, items, strategy, seed).select("query_id", F.posexplode("cands").alias("position", "_c"))
    return rows.select("query_id", "_c.cand_id", "_c.label", (F.col("position") + 1).alias("position"))


def _long(report: DataFrame, section: str, name: Column | None = None) -> DataFrame:
    """section, name, value of a report: of one row its columns, else a row for each name with its count n."""
    if name is not None:
        return report.select(F.lit(section).alias("section"), name.cast("string").alias("name"), F.col("n").cast("double").alias("value"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in report.columns])).alias("c")
    return report.select(cells).select(F.lit(section).alias("section"), "c.name", "c.value")


def validate(df: DataFrame, kind: str) -> DataFrame:
    """section, name, value: what a table of interactions or items holds. 'all': rows, users, items, blanks, ratings or lengths; 'domain' and, of
    interactions, 'rating': rows of each value.

    The table is read once: its rows are counted by each of some columns side by side (grouping sets, summed in each task first), and every figure is made of those counts.
    """
    if kind not in ("interactions", "items"):
        raise ValueError("kind is interactions or items")
    if kind == "interactions":
        slim = df.select(F.col("user_id").cast("string").alias("user_id"), F.col("product_id").cast("string").alias("product_id"), F.col("rating").cast("double").alias("rating"), "domain")
        distinct, blank, spread = {"user_id": "n_users", "product_id": "n_items"}, {"user_id": "blank_users", "product_id": "blank_items"}, {"rating": ("min_rating", "max_rating", "avg_rating")}
    else:
        slim = df.select(F.col("product_id").cast("string").alias("product_id"), F.length("full_text").alias("length"), "domain")
        distinct, blank, spread = {"product_id": "n_items"}, {"length": "blank_texts"}, {"length": (None, None, "avg_length")}
    by = [c for c in slim.columns if c != "domain"] + ["domain"]
    counts = slim.groupingSets([[c] for c in by], *by).agg(F.grouping_id().alias("_set"), F.count("*").alias("_n"))
    cell = lambda section, name, x, w=F.lit(1.0): F.struct(F.lit(section).alias("section"), name.cast("string").alias("name"), x.cast("double").alias("x"), w.cast("double").alias("w"))

    def cells(c: str) -> Column:
        """What the counts by one column tell."""
        out, n = [], F.col("_n")
        if c in ("domain", "rating"):
            out.append(cell(c, F.col(c), n))
        if c == "domain":
            out.append(cell("all", F.lit("n_rows"), n))
        if c in distinct:
            out.append(cell("all", F.lit(distinct[c]), F.col(c).isNotNull().cast("int")))
        if c in blank:
            out.append(cell("all", F.lit(blank[c]), F.when(F.col(c).isNull() | (F.col(c) == (0 if c == "length" else "")), n).otherwise(0)))
        for name in spread.get(c, ()):
            if name:
                out.append(cell("all", F.lit(name), F.col(c), F.when(F.col(c).isNotNull(), n)))
        return F.array(*out)

    one_of = lambda k: (1 << len(by)) - 1 - (1 << (len(by) - 1 - k))
    told = F.lit(None)
    for k, c in enumerate(by):
        told = F.when(F.col("_set") == one_of(k), cells(c)).otherwise(told)
    names = [*dict.fromkeys(["n_rows", *distinct.values(), *blank.values()])]
    least = df.sparkSession.range(1).select(F.explode(F.array(*[cell("all", F.lit(n), F.lit(0)) for n in names], *[cell("all", F.lit(n), F.lit(None), F.lit(None)) for x in spread.values() for n in x if n])).alias("c"))
    both = counts.select(F.explode(told).alias("c")).unionByName(least).select("c.*").groupBy("section", "name").agg(
        F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"), (F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mean"))
    in_all, starts = F.col("section") == "all", lambda p: F.col("name").startswith(p)
    value = F.when(in_all & starts("min_"), F.col("lo")).when(in_all & starts("max_"), F.col("hi")).when(in_all & starts("avg_"), F.round("mean", 6)).otherwise(F.col("s"))
    return both.select("section", "name", value.alias("value"))


def as_lists(ev: DataFrame | C.Lists, *features: str) -> C.Lists:
    """Evaluation rows (query_id, cand_id, label, and query_ and cand_ text, category, specs, v) as lists with these features (of texts, the words); lists stay."""
    if isinstance(ev, C.Lists):
        return ev
    named = {"words" if f == "text" else f: f for f in features}
    side = lambda p, f: C.joined_words(F.col(f"{p}_text")) if f == "text" else F.col(f"{p}_{f}")
    slim = ev.select("query_id", "cand_id", "label", *[side(p, f).alias(f"{p}_{n}") for n, f in named.items() for p in ("query", "cand")])
    cand = F.struct("cand_id", "label", *[F.col(f"cand_{n}").alias(n) for n in named])
    return C.Lists(slim.groupBy("query_id").agg(*[F.first(f"query_{n}", ignorenulls=True).alias(f"query_{n}") for n in named], F.collect_list(cand).alias("cands")))


def _prepared(lists: C.Lists, **made) -> C.Lists:
    """The lists with more fields of the candidates, made of each one."""
    fields = [f for f in lists.rows.schema["cands"].dataType.elementType.names if f not in ("category", "specs")]
    kept = [c for c in lists.rows.columns if c not in ("cands", "query_category", "query_specs")]
    cands = F.transform("cands", lambda x: F.struct(*[x[f].alias(f) for f in fields], *[make(x).alias(name) for name, make in made.items()]))
    return C.Lists(lists.rows.select(*kept, cands.alias("cands")), lists.vectors)


def _same_category(x: Column) -> Column:
    return F.col("query_category") == x["category"]


def _rounded(x: Column, name: str) -> Column:
    return F.round(x[name], 6)


def bm25_lists(ev: DataFrame | C.Lists) -> DataFrame:
    """query_id, scored: BM25 among a query's candidates, with a bonus for the query's category."""
    return C.scored(as_lists(ev, "text", "category"), {"score": C.bonus_of}, ["label"])


def embedding_lists(ev: DataFrame | C.Lists) -> DataFrame:
    got = C.scored(as_lists(ev, "v"), {"cosine": C.cosine_of}, ["label"])
    return C.with_score(got, lambda x: _rounded(x, "cosine"))


def two_tower_lists(ev: DataFrame | C.Lists, weights: dict) -> DataFrame:
    return N.two_tower_lists(as_lists(ev, "v"), weights)


def graph_lists(ev: DataFrame | C.Lists) -> DataFrame | C.Lists:
    """query_id, node, v: each query and its candidates. Of lists the same in one row a query: query_id and nodes (node, v)."""
    if isinstance(ev, C.Lists):
        nodes = F.concat(F.array(F.struct(F.col("query_id").cast("long").alias("node"), F.col("query_v").alias("v"))), F.transform("cands", lambda x: F.struct(x["cand_id"].cast("long").alias("node"), x["v"].alias("v"))))
        return C.Lists(ev.rows.select("query_id", nodes.alias("cands")), ev.vectors)
    own, cand = F.struct(F.col("query_id").alias("node"), F.col("query_v").alias("v")), F.struct(F.col("cand_id").alias("node"), F.col("cand_v").alias("v"))
    return ev.select("query_id", F.explode(F.when(F.col("label") == 1, F.array(own, cand)).otherwise(F.array(cand))).alias("n")).select("query_id", "n.node", "n.v")


def graph_scored(ev: DataFrame | C.Lists) -> DataFrame:
    got = C.scored(as_lists(ev, "v"), {"product": G.convolved_products}, ["label"])
    known = got.select("query_id", F.filter("scored", lambda x: x["product"].isNotNull()).alias("scored"))
    return C.with_score(known, lambda x: _rounded(x, "product"))


def hybrid_parts(ev: DataFrame | C.Lists) -> DataFrame:
    """query_id, scored: cand_id, label, bm25, cosine, hybrid."""
    made = {"same": lambda x: _same_category(x).cast("int"), "attributes": lambda x: T.attribute_match(F.col("query_specs"), x["specs"])}
    got = C.scored(_prepared(as_lists(ev, "text", "category", "specs", "v"), **made), {"bm25": C.bm25_of, "cosine": C.cosine_of}, ["label", "same", "attributes"])
    exact = got.withColumn("scored", F.transform("scored", lambda x: x.withField("bm25", _rounded(x, "bm25")).withField("cosine", _rounded(x, "cosine"))))
    best = F.array_max(F.transform("scored", lambda x: x["bm25"]))
    part = lambda x, b: R.hybrid_score(x["bm25"], b, x["cosine"], x["attributes"], x["same"])
    listed = lambda b: F.transform("scored", lambda x: F.struct(*[x[c].alias(c) for c in ("cand_id", "label", "bm25", "cosine")], part(x, b).alias("hybrid")))
    return exact.select("query_id", C.let(best, listed).alias("scored"))


def hybrid_lists(ev: DataFrame | C.Lists) -> DataFrame:
    return C.with_score(hybrid_parts(ev), lambda x: x["hybrid"])


#: Rankers by name; those of a catalogue of baselines by number too. Each takes evaluation rows or lists and gives query_id, scored (cand_id, label, score).
RANKERS = {"bm25": bm25_lists, "embedding": embedding_lists, "two_towers": two_tower_lists, "graph": graph_scored, "hybrid": hybrid_lists}
NUMBERS = {1: "bm25", 2: "embedding", 3: "two_towers", 4: "graph", 5: "hybrid"}


def scores(ev: DataFrame | C.Lists, ranker: str | int, **parameters) -> DataFrame:
    """query_id, cand_id, label, score of a ranker."""
    return C.unfold(RANKERS[NUMBERS.get(ranker, ranker)](ev, **parameters))


def evaluate(ev: DataFrame | C.Lists, ranker: str | int, k: int = 10, complete: int | None = None, **parameters) -> DataFrame:
    """One row: model, hr_at_k, ndcg_at_k, n_queries of a ranker over evaluation rows (query_id, cand_id, label, and query_ and cand_ text, category, specs,
    v) or lists. complete: only queries with exactly so many candidates. parameters: the ranker's own, such as the weights of two_towers."""
    name = NUMBERS.get(ranker, ranker)
    if name not in RANKERS:
        raise ValueError(f"ranker is one of {[*RANKERS, *NUMBERS]}")
    got = C.with_score(RANKERS[name](ev, **parameters), lambda x: F.round(x["score"], 8))
    if complete is not None:
        got = got.where(F.size("scored") == complete)
    return R.metrics(C.ranks(got), k).select(F.lit(name).alias("model"), "hr_at_k", "ndcg_at_k", "n_queries")


def recommend(users: DataFrame, items: DataFrame, seen: DataFrame, k: int = 10, fetched: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """user_id, item_id, score, rank: the k best items by inner product that a user has not seen, of the `fetched` best. users and items: key and
    vector; seen: user_id, item_id."""
    got = N.exact_top(items, users, fetched, key=key, vector=vector).select(F.col("query_id").alias("user_id"), "item_id", F.round("score", 9).alias("score"))
    return N.without_seen(got, seen, k)


def eda_report(items: DataFrame, reviews: DataFrame, most_words: int = 512, most_price: float = 2000.0, first: int = 10_000) -> DataFrame:
    """section, name, value: what plots of a catalogue show. items: item_id, title, details, price (text); reviews: item_id, rating.

    'words' and 'long': a histogram of the words of the details, and those over most_words; 'both': items with title and details among the first ones
    by id; 'price least' to 'price largest': distribution of the prices below most_price, of reviewed items, by rating.
    """
    n = T.word_count(F.col("details"))
    words = A.histogram(items, n, 0.0, float(most_words), 100)
    long = items.agg(F.count_if(n > most_words).alias("n")).select(F.lit("all").alias("bin"), "n")
    both = items.where("title is not null and details is not null").orderBy("item_id").limit(first).agg(F.count("*").alias("n")).select(F.lit("all").alias("bin"), "n")
    priced = items.select("item_id", T.price_number(F.col("price")).alias("price")).where(F.col("price").isNotNull() & (F.col("price") < most_price))
    box = A.distribution_by(reviews.join(priced, "item_id"), "rating", "price")
    cells = F.explode(F.array(*[F.struct(F.lit(f"price {c}").alias("section"), F.col(c).cast("double").alias("value")) for c in ("least", "q1", "median", "q3", "largest", "n")])).alias("c")
    prices = box.select(F.col("rating").cast("double").cast("string").alias("name"), cells).select("c.section", "name", "c.value")
    return K.union_all([_long(words, "words", F.col("bin")), _long(long, "long", F.col("bin")), _long(both, "both", F.col("bin")), prices])


def page_extract(pages: DataFrame) -> DataFrame:
    """page_id, title, texts, trail, specs, images of pages that are not blocked."""
    ok = pages.where(~P.blocked(F.col("url"), F.col("html")))
    return ok.select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), P.texts_of(F.col("html"), "p").alias("texts"), P.breadcrumb(F.col("html")).alias("trail"), P.spec_table(F.col("html")).alias("specs"), P.images(F.col("html")).alias("images"))
