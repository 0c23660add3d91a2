"""Column functions that read fields off product pages and their addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID = "[A-Z0-9]{10}"  # fixed form of a product id


def product_id(url: Column) -> Column:
    found = F.regexp_extract(url, f"/dp/({ID})", 1)
    return F.when(found == "", F.lit("Unknown")).otherwise(F.coalesce(found, F.lit("Unknown")))


def parent_id(html: Column, own: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(html, f'"parentAsin":"({ID})"', 1), F.lit("")), own)


def canonical_url(href: Column, host: str) -> Column:
    """Up to the referrer part; a path gets the host."""
    cut = F.substring_index(href, "/ref=", 1)
    return F.when(cut.startswith("/"), F.concat(F.lit(host), cut)).otherwise(cut)


def high_resolution(url: Column, pattern: str = "\\._AC_.*_\\.") -> Column:
    """An image address without its size part."""
    return F.regexp_replace(url, pattern, ".")


def breadcrumb(html: Column, link: str = '<a href="[^"]*">([^<]*)</a>') -> Column:
    """The texts of matching links, in order, blank ones left out."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(link), 1), lambda x: F.trim(x)), lambda x: x != "")


def trail(base: Column, found: Column, sep: str = "›") -> Column:
    """Base list, then found ones, as one text; null if both are empty."""
    every = F.concat(F.coalesce(base, F.array().cast("array<string>")), F.coalesce(found, F.array().cast("array<string>")))
    return F.when(F.size(every) > 0, F.array_join(every, sep))


def spec_table(html: Column) -> Column:
    """Rows of heading and cell as a map; white space squeezed, direction marks and the review row left out, the last of equal keys kept."""
    from .text import _last_wins

    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), "‎", ""), "[ \\t\\n\\r\\f]+", " "))
    rows = F.regexp_extract_all(html, F.lit("(?s)<tr[^>]*>(.*?)</tr>"), 1)
    pairs = F.transform(rows, lambda r: F.struct(
        tidy(F.regexp_extract(r, "(?s)<th[^>]*>(.*?)</th>", 1)).alias("k"), tidy(F.regexp_extract(r, "(?s)<td[^>]*>(.*?)</td>", 1)).alias("v")))
    return _last_wins(F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != "") & ~p["k"].contains("Customer Reviews")))


def first_number(text: Column) -> Column:
    """The number before the first space, null if it is none."""
    return F.substring_index(text, " ", 1).try_cast("double")


def digits(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit(""))


def first_integer(text: Column) -> Column:
    """The first whole number, commas dropped; 0 without one."""
    return F.coalesce(F.regexp_extract(F.regexp_replace(text, ",", ""), "([0-9]+)", 1).try_cast("long"), F.lit(0).cast("long"))


def first_present(*found: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in found])


SIZE_MARK = "\\._[A-Z0-9, ]+_\\."  # of a thumbnail's address: a fixed value


def images(html: Column) -> Column:
    """The gallery that a page's script holds, else its thumbnails' (each with the address without size marks as large one): array of struct(thumb,
    large, variant, hiRes), empty without either."""
    text = F.regexp_extract(html, "(?s)'colorImages':\\s*\\{.*?'initial':\\s*(\\[.*?\\])\\}", 1)
    script = F.from_json(text, "array<struct<thumb:string,large:string,variant:string,hiRes:string>>")
    strip = F.regexp_extract(html, '(?s)id="altImages"(.*?)</ul>', 1)
    found = F.filter(F.regexp_extract_all(strip, F.lit('(?s)<img[^>]*\\ssrc="([^"]*)"'), 1), lambda x: x != "")
    shown = F.transform(found, lambda x: F.struct(x.alias("thumb"), high_resolution(x, SIZE_MARK).alias("large"), F.lit("MAIN").alias("variant"), high_resolution(x, SIZE_MARK).alias("hiRes")))
    return F.when(F.size(F.coalesce(script, F.array())) > 0, script).otherwise(F.coalesce(shown, F.array()))


#: Tags that end a paragraph whose own end is missing.
BLOCKS = "p|div|article|section|main|aside|header|footer|nav|ul|ol|li|table|form|blockquote|pre|hr|h[1-6]|body|html"


def texts_of(html: Column, tag: str) -> Column:
    """The texts of a tag's elements, with or without attributes, inner tags dropped and white space folded, blank ones left out. An element ends with its tag, with the next one
    or with a block around it."""
    rest = F.split(html, f"(?s)<{tag}(?:\\s[^>]*)?>")
    inner = F.transform(F.slice(rest, F.lit(2), F.size(rest)), lambda x: F.regexp_replace(x, f"(?s)</?(?:{tag}|{BLOCKS})[\\s>/].*$", ""))
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "(?s)<[^>]*>", ""), "[ \\t\\n\\r\\f]+", " "))
    return F.filter(F.transform(inner, plain), lambda x: x != "")


def blocked(url: Column, html: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit(""))).contains("captcha") | F.coalesce(html, F.lit("")).contains("automated access")


def variant_ids(html: Column, attribute: str = "data-asin") -> Column:
    """Product ids of an attribute, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(f'{attribute}="({ID})"'), 1))


def reviews(pages: DataFrame, main_category: Column | None = None) -> DataFrame:
    """page_id and a flat record of twelve fields for each review card of a page's html. main_category: of the page's product, null if not given. Attributes of the tags
    may stand in any number; the images of a review are not read."""
    card = F.explode(F.regexp_extract_all("html", F.lit('(?s)<li[^>]*data-hook="review"[^>]*>(.*?)</li>'), 1))
    pick = lambda name: F.nullif(F.trim(F.regexp_extract("card", f'(?:class|data-hook)="{name}"[^>]*>([^<]*)', 1)), F.lit(""))
    category = (F.lit(None) if main_category is None else main_category).cast("string")
    cards = pages.select("page_id", product_id(F.col("url")).alias("asin"), category.alias("main_category"), card.alias("card"))
    return cards.select(
        "page_id", "asin", F.col("asin").alias("parent_asin"), "main_category",
        F.coalesce(first_number(pick("rating")), F.lit(0.0)).alias("rating"),
        F.coalesce(pick("title"), F.lit("")).alias("title"),
        pick("body").alias("text"),
        F.coalesce(F.nullif(F.regexp_extract("card", "/profile/([^/\"]+)", 1), F.lit("")), F.lit("Anonymous")).alias("user_id"),
        pick("a-profile-name").alias("user_name"),
        pick("review-date").alias("timestamp_raw"),
        first_integer(pick("votes")).alias("helpful_vote"),
        F.col("card").contains("avp-badge").alias("verified_purchase"),
        F.array().cast("array<string>").alias("images"))
