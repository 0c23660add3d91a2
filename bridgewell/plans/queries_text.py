"""Queries of sources, projections, page fields and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import text as T
from ..functions import vectors as V
from ..operators import keys as K
from .roles import INTERACTIONS, ITEMS, TEXTS, interactions, items, query, table, texts

S = "[ \\t\\n\\r\\f]"
STD = lambda c: f"lower(trim(regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' '))"
CLEAN = lambda c: STD(f"regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]*>', ' ', 'g'), '[^a-zA-Z0-9 \\t\\n\\r\\f.,!?{T.KEPT_LETTERS}]', ' ', 'g')")


@query("s8_parquet_columns", "SELECT doc_id, lang, source FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source")


@query("s16_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in ("orders", "part", "events", "documents")))
def _(spark, d):
    return K.union_all([table(spark, d, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("name"), "n_rows") for t in ("orders", "part", "events", "documents")])


@query("s17_field_mapping", "SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS title, CAST(NULL AS VARCHAR) AS breadcrumb, CAST(c_acctbal AS DOUBLE) AS rating FROM customer")
def _(spark, d):
    return K.map_fields(table(spark, d, "customer"), {"user_id": (("userId", "c_custkey"), "string"), "title": (("c_name", "c_custkey"), "string"), "breadcrumb": (("breadcrumb",), "string"), "rating": (("c_acctbal",), "double")})


@query("p1_standardize", f"SELECT doc_id, {STD('text')} AS t FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.standardize(F.col("text")).alias("t"))


@query("p2_clean_text", f"SELECT doc_id, {CLEAN('text')} AS t FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("t"))


@query("p2_clean_html", f"SELECT page_id, {CLEAN('html')} AS t FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_text(F.col("html")).alias("t"))


@query("p3_join_lists", "SELECT conv_id, string_agg(coalesce(text, ''), '. ' ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("l"))
    return c.select("conv_id", F.concat_ws(". ", F.transform("l", lambda x: x["text"])).alias("t"))


@query("p4_list_text", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_brand WHEN p_partkey % 3 = 1 THEN p_name ELSE '' END AS t FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("['"), "p_name", F.lit("', '"), "p_brand", F.lit("']"))).when(k % 3 == 1, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.list_text(raw).alias("t"))


@query("p5_full_text", "SELECT p_partkey, replace(concat_ws(' ', p_name, p_brand, p_type), chr(10), ' ') AS t FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.one_line(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("t"))


@query("p6_combined_text", "SELECT p_partkey, concat_ws(' | ', p_name, CASE WHEN p_size > 10 THEN p_brand END, p_type) AS t FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" | ", "p_name", F.when(F.col("p_size") > 10, F.col("p_brand")), "p_type").alias("t"))


def _case(text: str, rules, default: str = "other") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({text}), '{'|'.join(words)}') THEN '{name}'" for name, words in rules) + f" ELSE '{default}' END"


PART_RULES = (("ring", ("ring", "bolt")), ("gear", ("gear", "rod")), ("plate", ("plate",)), ("gadget", ("widget", "gizmo")))


@query("p7_category", f"SELECT doc_id, {_case('text', T.CATEGORY_RULES)} AS category FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.category_of(F.col("text")).alias("category"))


@query("p7_category_rules", f"SELECT p_partkey, {_case('p_name', PART_RULES)} AS category FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.category_of(F.col("p_name"), PART_RULES).alias("category"))


@query("p8_item_category", f"SELECT doc_id, {_case('text', T.ITEM_CATEGORY_RULES)} AS category FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.category_of(F.col("text"), T.ITEM_CATEGORY_RULES).alias("category"))


@query("p9_domain_tag", "SELECT c_custkey, 'vn' AS domain FROM customer UNION ALL SELECT s_suppkey, 'amazon' FROM supplier")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.lit("vn").alias("domain")).unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit("amazon").alias("domain")))


@query("p10_rating", "SELECT event_id, CAST(round(coalesce(TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE CAST(value AS VARCHAR) END AS FLOAT), CAST(0 AS FLOAT)), 2) AS DOUBLE) AS rating FROM events")
def _(spark, d):
    raw = F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", F.round(T.rating_or_zero(raw), 2).cast("double").alias("rating"))


SPECS_SQL = "'brand=' || brand || ';ram=' || ram || ';type=' || type"


@query("p11_parse_specs", f"WITH {ITEMS} SELECT item_id, {SPECS_SQL} AS specs FROM items")
def _(spark, d):
    return items(spark, d).select("item_id", T.map_text(T.parse_specs(F.col("raw_specs"))).alias("specs"))


@query("p12_json_specs", "SELECT event_id, 'k=' || json_extract_string(props, '$.k') AS specs FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", T.map_text(T.json_specs(F.col("props"))).alias("specs"))


@query("p13_map_to_json", """SELECT p_partkey, '{"brand":"' || p_brand || '","type":"' || p_type || '"}' AS j FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.to_json(F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type")).alias("j"))


@query("p14_word_count", "SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n"))


@query("p15_length", "SELECT doc_id, length(text) AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"))


@query("p16_price", "SELECT p_partkey, TRY_CAST(nullif(regexp_extract(replace('from $' || CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE format('{:,.2f}', p_retailprice) END, ',', ''), '([0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE) AS price FROM part")
def _(spark, d):
    text = F.concat(F.lit("from $"), F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(F.format_number("p_retailprice", 2)))
    return table(spark, d, "part").select("p_partkey", T.price_number(text).alias("price"))


@query("p17_key_fallback", f"WITH {ITEMS} SELECT item_id, coalesce(CASE WHEN item_id % 3 > 0 THEN asin END, 'P' || item_id) AS asin FROM items")
def _(spark, d):
    return items(spark, d).select("item_id", F.coalesce(F.when(F.col("item_id") % 3 > 0, F.col("asin")), F.concat(F.lit("P"), F.col("item_id").cast("string"))).alias("asin"))


@query("p18_drop_column", "SELECT * EXCLUDE (embedding) FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").drop("embedding")


@query("p19_epoch", f"WITH {INTERACTIONS} SELECT event_id, ts FROM inter")
def _(spark, d):
    return interactions(spark, d).select("event_id", "ts")


@query("p20_tokens", "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> ''), '|') AS t FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), "|").alias("t"))


@query("p21_text_embedding")
def _(spark, d):
    from ..operators import encoder

    docs = table(spark, d, "documents")
    return encoder.encode(docs, encoder.fit(docs), "doc_id").select("doc_id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query("p22_embed_distinct", """WITH words AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS w FROM documents),
terms AS (SELECT w FROM words GROUP BY w HAVING count(*) > 1 ORDER BY count(*) DESC, w LIMIT 32768), known AS (SELECT DISTINCT doc_id FROM words SEMI JOIN terms USING (w))
SELECT doc_id, CASE WHEN known.doc_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS norm FROM documents LEFT JOIN known USING (doc_id)""")
def _(spark, d):
    from ..operators import encoder

    docs = table(spark, d, "documents")
    return encoder.encode_once(docs, encoder.fit(docs), "doc_id").select("doc_id", F.round(V.norm(F.col("v")), 6).alias("norm"))


@query("p23_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))))), 6) AS total FROM embeddings")
def _(spark, d):
    unit = V.normalise(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("p24_dot_cosine", """WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_dot_product(x, y), 6) AS dot, round(list_cosine_similarity(x, y), 6) AS cosine FROM p""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return e.join(b, "vec_id").select("vec_id", F.round(V.dot(F.col("embedding"), F.col("y")), 6).alias("dot"), F.round(V.cosine(F.col("embedding"), F.col("y")), 6).alias("cosine"))


# Pages: the ids of product pages stand in for addresses, since the table's own have none.
PAGES = """pg AS (SELECT *, CASE WHEN page_id % 4 > 0 THEN '/x/dp/' || upper(substr(md5(CAST(page_id AS VARCHAR)), 1, 10)) || '/ref=sr_' || page_id ELSE url END AS href FROM pages)"""


def _pages(spark, d):
    made = F.concat(F.lit("/x/dp/"), F.upper(F.substring(F.md5(F.col("page_id").cast("string")), 1, 10)), F.lit("/ref=sr_"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").withColumn("href", F.when(F.col("page_id") % 4 > 0, made).otherwise(F.col("url")))


@query("x1_product_id", f"WITH {PAGES} SELECT page_id, coalesce(nullif(regexp_extract(href, '/dp/([A-Z0-9]{{10}})', 1), ''), 'Unknown') AS asin FROM pg")
def _(spark, d):
    return _pages(spark, d).select("page_id", P.product_id(F.col("href")).alias("asin"))


@query("x2_parent_id", f"""WITH {PAGES} SELECT page_id, coalesce(nullif(regexp_extract(html || CASE WHEN page_id % 3 = 0 THEN '"parentAsin":"B' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '"' ELSE '' END, '"parentAsin":"([A-Z0-9]{{10}})"', 1), ''), 'own') AS parent FROM pg""")
def _(spark, d):
    extra = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('"parentAsin":"B'), F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit('"'))).otherwise("")
    return _pages(spark, d).select("page_id", P.parent_id(F.concat("html", extra), F.lit("own")).alias("parent"))


@query("x3_canonical_url", f"WITH {PAGES} SELECT page_id, CASE WHEN href LIKE '/%' THEN 'https://shop.example' ELSE '' END || string_split(href, '/ref=')[1] AS url FROM pg")
def _(spark, d):
    return _pages(spark, d).select("page_id", P.canonical_url(F.col("href"), "https://shop.example").alias("url"))


@query("x4_high_resolution", "SELECT page_id, regexp_replace(url || '/i._AC_UL320_.jpg', '\\._AC_.*_\\.', '.', 'g') AS image, regexp_replace(url || '/i._SX38_.jpg', '\\._[A-Z0-9, ]+_\\.', '.', 'g') AS other FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", P.high_resolution(F.concat("url", F.lit("/i._AC_UL320_.jpg"))).alias("image"), P.high_resolution(F.concat("url", F.lit("/i._SX38_.jpg")), "\\._[A-Z0-9, ]+_\\.").alias("other"))


CRUMBS = "list_filter(list_transform(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query("x5_breadcrumb", f"SELECT page_id, 'Home' || CASE WHEN len({CRUMBS}) > 0 THEN '›' || array_to_string({CRUMBS}, '›') ELSE '' END AS trail FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", P.trail(F.array(F.lit("Home")), P.breadcrumb(F.col("html"))).alias("trail"))


def _tidy(x: str) -> str:
    return f"trim(regexp_replace(replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '\u200e', ''), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')"


@query("x6_spec_table", f"""WITH h AS (SELECT page_id, html || '<tr><th> RAM\u200e </th><td>' || page_id || ' GB </td></tr><tr><th>Customer Reviews</th><td>4</td></tr>' AS html FROM pages),
r AS (SELECT page_id, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<tr[^>]*>(.*?)</tr>', 1) AS l FROM h)),
c AS (SELECT page_id, i, {_tidy("regexp_extract(r, '(?s)<th[^>]*>(.*?)</th>', 1)")} AS k, {_tidy("regexp_extract(r, '(?s)<td[^>]*>(.*?)</td>', 1)")} AS v FROM r),
o AS (SELECT page_id, k, max_by(v, i) AS v FROM c WHERE k <> '' AND v <> '' AND NOT contains(k, 'Customer Reviews') GROUP BY 1, 2)
SELECT page_id, string_agg(k || '=' || v, ';' ORDER BY k) AS specs FROM o GROUP BY 1""")
def _(spark, d):
    rows = F.concat(F.lit("<tr><th> RAM‎ </th><td>"), F.col("page_id").cast("string"), F.lit(" GB </td></tr><tr><th>Customer Reviews</th><td>4</td></tr>"))
    return table(spark, d, "pages").select("page_id", T.map_text(P.spec_table(F.concat("html", rows))).alias("specs"))


@query("x7_first_number", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 9 = 0 THEN 'none' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS rating FROM events")
def _(spark, d):
    text = F.concat(F.when(F.col("event_id") % 9 == 0, "none").otherwise(F.col("value").cast("string")), F.lit(" out of 5 stars"))
    return table(spark, d, "events").select("event_id", P.first_number(text).alias("rating"))


@query("x8_digits", "SELECT page_id, nullif(regexp_replace(url, '[^0-9]', '', 'g'), '') AS n FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", P.digits(F.col("url")).alias("n"))


@query("x9_first_integer", "SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(replace(url, ',', ''), '([0-9]+)', 1), '') AS BIGINT), 0) AS n FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", P.first_integer(F.col("url")).alias("n"))


@query("x10_first_present", "SELECT page_id, coalesce(nullif(regexp_extract(html, '<h2>([^<]*)', 1), ''), nullif(regexp_extract(html, '<h1>([^<]*)', 1), ''), nullif(regexp_extract(html, '<title>([^<]*)', 1), '')) AS title FROM pages")
def _(spark, d):
    tag = lambda t: F.regexp_extract("html", f"<{t}>([^<]*)", 1)
    return table(spark, d, "pages").select("page_id", P.first_present(tag("h2"), tag("h1"), tag("title")).alias("title"))


# The pages have no galleries and no reviews: a script, thumbnails or neither, and two cards, are added to each.
@query("x11_images", """WITH p AS (SELECT page_id, html || CASE page_id % 3 WHEN 0 THEN '<script>''colorImages'': { ''initial'': [{"thumb":"t","large":"l","variant":"V' || page_id || '","hiRes":null}]},</script>'
  WHEN 1 THEN '<div id="altImages"><ul><li><img alt="" src="https://x/' || page_id || '._SR38,50_.jpg"></li><li><img src="b.png"/></li></ul></div>' ELSE '' END AS h FROM pages), q AS (SELECT page_id,
  from_json(nullif(regexp_extract(h, '(?s)''colorImages'':\\s*\\{.*?''initial'':\\s*(\\[.*?\\])\\}', 1), ''), '[{"thumb":"VARCHAR","large":"VARCHAR","variant":"VARCHAR","hiRes":"VARCHAR"}]') AS script,
  regexp_extract_all(regexp_extract(h, '(?s)id="altImages"(.*?)</ul>', 1), '(?s)<img[^>]*\\ssrc="([^"]*)"', 1) AS shown FROM p)
SELECT page_id, CASE WHEN len(script) > 0 THEN array_to_string(list_transform(script, lambda i: concat_ws(',', i.thumb, i.large, i.variant, i.hiRes)), '|')
  ELSE array_to_string(list_transform(shown, lambda x: concat_ws(',', x, regexp_replace(x, '\\._[A-Z0-9, ]+_\\.', '.', 'g'), 'MAIN', regexp_replace(x, '\\._[A-Z0-9, ]+_\\.', '.', 'g'))), '|') END AS images FROM q""")
def _(spark, d):
    number = F.col("page_id").cast("string")
    script = F.concat(F.lit("""<script>'colorImages': { 'initial': [{"thumb":"t","large":"l","variant":"V"""), number, F.lit("""","hiRes":null}]},</script>"""))
    strip = F.concat(F.lit('<div id="altImages"><ul><li><img alt="" src="https://x/'), number, F.lit('._SR38,50_.jpg"></li><li><img src="b.png"/></li></ul></div>'))
    added = F.when(F.col("page_id") % 3 == 0, script).when(F.col("page_id") % 3 == 1, strip).otherwise("")
    shown = F.transform(P.images(F.concat("html", added)), lambda i: F.concat_ws(",", i["thumb"], i["large"], i["variant"], i["hiRes"]))
    return table(spark, d, "pages").select("page_id", F.array_join(shown, "|").alias("images"))


def paragraphs_sql(html: str) -> str:
    """The texts of p elements, as pages.texts_of finds them."""
    cut = f"list_transform(string_split_regex({html}, '(?s)<p(?:\\s[^>]*)?>')[2:], lambda x: regexp_replace(x, '(?s)</?(?:p|{P.BLOCKS})[\\s>/].*$', ''))"
    return f"list_filter(list_transform({cut}, lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<[^>]*>', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')), lambda x: x <> '')"


@query("x12_texts", f"SELECT page_id, array_to_string({paragraphs_sql('html')}, '|') AS t FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(P.texts_of(F.col("html"), "p"), "|").alias("t"))


CARD_PICK = """nullif(trim(regexp_extract(card, '(?:class|data-hook)="{}"[^>]*>([^<]*)', 1), ' '), '')"""


@query("x13_reviews", f"""WITH {PAGES}, h AS (SELECT page_id, coalesce(nullif(regexp_extract(href, '/dp/([A-Z0-9]{{10}})', 1), ''), 'Unknown') AS asin,
  html || '<li class="x" data-hook="review" id="r"><i class="rating" title="r">4.0 out of 5</i><b class="title">T</b><span data-hook="body">' || replace(string_split(url, '/')[-1], '<', '') || '</span><a href="/profile/U' || page_id || '/x"><span class="a-profile-name">N ' || page_id || '</span></a><i class="votes">1,024 people</i><i data-hook="review-date">Reviewed on day ' || page_id % 28 || '</i><i class="avp-badge"></i></li><li data-hook="review"></li>' AS html FROM pg),
c AS (SELECT page_id, asin, unnest(regexp_extract_all(html, '(?s)<li[^>]*data-hook="review"[^>]*>(.*?)</li>', 1)) AS card FROM h)
SELECT page_id, asin, asin AS parent_asin, 'pages' AS main_category, coalesce(TRY_CAST(string_split({CARD_PICK.format('rating')}, ' ')[1] AS DOUBLE), 0.0) AS rating, coalesce({CARD_PICK.format('title')}, '') AS title,
  {CARD_PICK.format('body')} AS text, coalesce(nullif(regexp_extract(card, '/profile/([^/"]+)', 1), ''), 'Anonymous') AS user_id, {CARD_PICK.format('a-profile-name')} AS user_name, {CARD_PICK.format('review-date')} AS timestamp_raw,
  coalesce(TRY_CAST(nullif(regexp_extract(replace({CARD_PICK.format('votes')}, ',', ''), '([0-9]+)', 1), '') AS BIGINT), 0) AS helpful_vote, contains(card, 'avp-badge') AS verified_purchase, 0 AS n_images FROM c""")
def _(spark, d):
    number = F.col("page_id").cast("string")
    card = F.concat(
        F.lit('<li class="x" data-hook="review" id="r"><i class="rating" title="r">4.0 out of 5</i><b class="title">T</b><span data-hook="body">'), F.regexp_replace(F.substring_index("url", "/", -1), "<", ""),
        F.lit('</span><a href="/profile/U'), number, F.lit('/x"><span class="a-profile-name">N '), number, F.lit('</span></a><i class="votes">1,024 people</i><i data-hook="review-date">Reviewed on day '),
        (F.col("page_id") % 28).cast("string"), F.lit('</i><i class="avp-badge"></i></li><li data-hook="review"></li>'))
    found = P.reviews(_pages(spark, d).select("page_id", F.col("href").alias("url"), F.concat("html", card).alias("html")), F.lit("pages"))
    return found.select("*", F.size("images").alias("n_images")).drop("images")


@query("x14_not_blocked", "SELECT page_id FROM pages WHERE NOT (lower(url) LIKE '%captcha%' OR html LIKE '%automated access%' OR url LIKE '%.net%')")
def _(spark, d):
    return table(spark, d, "pages").where(~P.blocked(F.col("url"), F.col("html")) & ~F.col("url").contains(".net")).select("page_id")


@query("x15_variant_ids", "SELECT page_id, unnest(list_distinct(regexp_extract_all(upper(html), '>([A-Z0-9]{10})[ <]', 1))) AS asin FROM pages")
def _(spark, d):
    # Letter by letter, as in the SQL: Spark's upper makes two letters of some, and so ids of words of nine characters.
    upper = F.translate("html", "abcdefghijklmnopqrstuvwxyz\u0131\u017f", "ABCDEFGHIJKLMNOPQRSTUVWXYZIS")
    marked = F.regexp_replace(upper, ">([A-Z0-9]{10})(?=[ <])", ' data-asin="$1"')
    return table(spark, d, "pages").select("page_id", F.explode(P.variant_ids(marked)).alias("asin"))


@query("x16_list_json", f"""SELECT page_id, '[' || coalesce(array_to_string(list_transform({CRUMBS}, lambda x: '"' || x || '"'), ','), '') || ']' AS j FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.to_json(P.breadcrumb(F.col("html"))).alias("j"))


@query("f1_nonempty_keys", f"WITH {INTERACTIONS} SELECT event_id, user_id, product_id FROM inter WHERE coalesce(user_id, '') <> '' AND coalesce(product_id, '') <> ''")
def _(spark, d):
    return K.with_keys(interactions(spark, d), "user_id", "product_id").select("event_id", "user_id", "product_id")


@query("f2_drop_null_keys", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").dropna(subset=["quality"]).select("doc_id", "quality")


@query("f3_domain", f"WITH {TEXTS} SELECT product_id FROM texts WHERE domain = 'amazon'")
def _(spark, d):
    return texts(spark, d).where(F.col("domain") == "amazon").select("product_id")


@query("f4_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL AND o_totalprice < 2000")
def _(spark, d):
    return table(spark, d, "orders").where(F.col("o_totalprice").isNotNull() & (F.col("o_totalprice") < 2000)).select("o_orderkey", "o_totalprice")


@query("f5_both_present", "SELECT page_id FROM pages WHERE url IS NOT NULL AND html IS NOT NULL")
def _(spark, d):
    return table(spark, d, "pages").where(F.col("url").isNotNull() & F.col("html").isNotNull()).select("page_id")


@query("f6_membership", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def _(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("f8_patterns", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'ring|gear') AND contains(p_brand, '#1')")
def _(spark, d):
    return table(spark, d, "part").where(F.col("p_name").rlike("ring|gear") & F.col("p_brand").contains("#1")).select("p_partkey")
