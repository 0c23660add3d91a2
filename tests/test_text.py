import pytest
from pyspark.sql import functions as F

from bridgewell.functions import pages as P
from bridgewell.functions import text as T
from bridgewell.functions import vectors as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize(("value", "wanted"), [(None, ""), ("  Foo \t Bar ", "foo bar"), ("", "")])
def test_standardize(spark, value, wanted):
    assert one(spark, value, T.standardize) == wanted


def test_clean_text_is_idempotent(spark):
    f = lambda c: T.clean_text(c)
    assert one(spark, "<b>Máy</b> i7-12700H* {x}", f) == "máy i7 12700h x"
    assert one(spark, "<b>Máy</b> i7-12700H* {x}", lambda c: T.clean_text(T.clean_text(c))) == "máy i7 12700h x"
    assert one(spark, None, f) == ""


@pytest.mark.parametrize(("value", "wanted"), [("['a','b']", "a b"), ("plain", "plain"), (None, "")])
def test_list_text(spark, value, wanted):
    assert one(spark, value, T.list_text) == wanted


@pytest.mark.parametrize(("value", "wanted"), [("Laptop iPhone dock", "laptop"), ("PCIe", "desktop"), ("", "other"), (None, "other")])
def test_category(spark, value, wanted):
    assert one(spark, value, T.category_of) == wanted


def test_whole_words(spark):
    assert one(spark, "PCIe card", lambda c: T.category_of(c, whole_word=True)) == "other"
    assert one(spark, "a PC case", lambda c: T.category_of(c, whole_word=True)) == "desktop"


def test_parse_specs(spark):
    got = one(spark, ["RAM:: 16GB ", "CPU::i7::x", "bad", "ram::8GB"], T.parse_specs, "array<string>")
    assert got == {"ram": "8gb", "cpu": "i7::x"}
    assert one(spark, None, T.parse_specs, "array<string>") == {}
    assert one(spark, "['A::1']", T.parse_specs_text) == {"a": "1"}
    assert one(spark, {"A": "B", "a": "C"}, T.lower_map, "map<string,string>") in ({"a": "b"}, {"a": "c"})


def test_json_specs_reads_the_raw_column(spark):
    assert one(spark, '{"a": "b"}', T.json_specs) == {"a": "b"}
    assert one(spark, "a b", T.json_specs) is None


@pytest.mark.parametrize(("value", "wanted"), [("", 1), ("a  b", 3), (None, None)])
def test_word_count(spark, value, wanted):
    assert one(spark, value, T.word_count) == wanted


@pytest.mark.parametrize(("value", "wanted", "literal"), [("$1,299.00", 1299.0, 1.0), ("from 15", 15.0, 15.0), ("", None, None)])
def test_price(spark, value, wanted, literal):
    assert one(spark, value, T.price_number) == wanted
    assert one(spark, value, lambda c: T.price_number(c, strip_commas=False)) == literal


def test_rating(spark):
    assert one(spark, "bad", T.rating_or_zero) == 0.0
    assert one(spark, "4.5", T.rating_or_zero) == 4.5


def test_attribute_match(spark):
    df = spark.createDataFrame([({"ram": "8", "brand": "x"}, {"ram": "8", "brand": "y"}), ({"a": "1"}, {"b": "1"}), (None, {"b": "1"})], "q map<string,string>, c map<string,string>")
    assert [r[0] for r in df.select(T.attribute_match(F.col("q"), F.col("c"))).collect()] == [0.5, 0.0, 0.0]


def test_page_fields(spark):
    assert one(spark, "https://h/x/dp/B0ABCDEFGH/ref=sr_1", P.product_id) == "B0ABCDEFGH"
    assert one(spark, "https://h/x", P.product_id) == "Unknown"
    assert one(spark, "/x/dp/B0ABCDEFGH/ref=sr_1", lambda c: P.canonical_url(c, "https://h")) == "https://h/x/dp/B0ABCDEFGH"
    html = "<tr><th>RAM</th><td> 16 GB </td></tr><tr><th>Customer Reviews</th><td>4.5</td></tr>"
    assert one(spark, html, P.spec_table) == {"RAM": "16 GB"}
    assert one(spark, "4.5 out of 5 stars", P.first_number) == 4.5
    assert one(spark, "none", P.first_number) is None
    assert one(spark, "1,234 ratings", P.digits) == "1234"
    assert one(spark, "1,024 people found this helpful", P.first_integer) == 1024
    assert one(spark, "nobody", P.first_integer) == 0
    assert one(spark, "a._AC_UL320_.jpg", P.high_resolution) == "a.jpg"


def test_images_and_reviews(spark):
    html = """<script>'colorImages': { 'initial': [{"thumb":"t","large":"l","variant":"MAIN","hiRes":null}]},</script>"""
    assert one(spark, html, P.images)[0].variant == "MAIN"
    card = '<li data-hook="review"><i class="rating">4.0 out of 5</i><b class="title">T</b><a href="/profile/U1/x"></a><i class="votes">1,024 people</i></li>'
    r = P.reviews(spark.createDataFrame([(1, "/dp/B0ABCDEFGH", card + card)], "page_id int, url string, html string")).collect()
    assert len(r) == 2 and r[0].user_id == "U1" and r[0].helpful_vote == 1024 and not r[0].verified_purchase


def test_pages_with_attributes_and_inner_tags(spark):
    strip = '<div id="altImages" class="a"><ul><li><img alt="" src="x/a._SR38,50_.jpg"></li><li><img src=""><img  src="b.png"/></li></ul></div><img src="other.jpg">'
    assert [(i.thumb, i.large, i.variant, i.hiRes) for i in one(spark, strip, P.images)] == [("x/a._SR38,50_.jpg", "x/a.jpg", "MAIN", "x/a.jpg"), ("b.png", "b.png", "MAIN", "b.png")]
    broken = "<script>'colorImages': { 'initial': []},</script>" + strip
    assert len(one(spark, broken, P.images)) == 2 and one(spark, "<p>none</p>", P.images) == []
    html = '<p class="a b">One <b>two</b>\n three</p><pre>no</pre><p><i></i> </p><p>four<p id=x>five<br>six<div>not</div></p><P>no</P><param><p>se<!-- c -->ven</article>no'
    assert one(spark, html, lambda c: P.texts_of(c, "p")) == ["One two three", "four", "fivesix", "seven"]
    card = '<li id="k" data-hook="review" class="r"><span class="a-profile-name" x="y">Ann</span><a href="/profile/U2/x"></a><i class="rating" title="t">2.5 out of 5</i><b data-hook="title">Ti</b><span data-hook="review-date">May 1</span><span class="body" lang="en">Text</span><i class="avp-badge"></i></li>'
    pages = spark.createDataFrame([(1, "/dp/B0ABCDEFGH", f"<ul>{card}<li>no</li>" + '<li data-hook="review"></li></ul>')], "page_id int, url string, html string")
    a, b = sorted(P.reviews(pages, F.lit("Phones")).collect(), key=lambda r: r.user_name is None)
    assert a.asDict() == {"page_id": 1, "asin": "B0ABCDEFGH", "parent_asin": "B0ABCDEFGH", "main_category": "Phones", "rating": 2.5, "title": "Ti", "text": "Text", "user_id": "U2", "user_name": "Ann",
        "timestamp_raw": "May 1", "helpful_vote": 0, "verified_purchase": True, "images": []}
    assert (b.user_id, b.user_name, b.timestamp_raw, b.rating, b.title, b.text, b.verified_purchase) == ("Anonymous", None, None, 0.0, "", None, False)


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], V.normalise, "array<float>") == pytest.approx([0.6, 0.8])
    assert one(spark, [0.0, 0.0], V.normalise, "array<float>") == [0.0, 0.0]
    assert one(spark, [1.0, 2.0], lambda c: V.cosine(c, c), "array<float>") == pytest.approx(1.0)


def test_variant_ids_of_letters_that_grow_in_upper_case(spark, tmp_path):
    from bridgewell.plans.registry import QUERIES

    html = "<a>einachßpf</a><a>abcdefghi1</a><b>straſe1234 x</b>"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.asin for r in QUERIES["x15_variant_ids"](spark, str(tmp_path)).collect()) == ["ABCDEFGHI1", "STRASE1234"]
