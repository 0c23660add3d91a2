"""Column functions over text: cleaning, categories, attribute maps, numbers in prose."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\r\\f]"

# The letters that cleaning keeps, the ordered category keywords, the attributes compared by rankers.
KEPT_LETTERS = (
    "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
    "ÀÁẠẢÃÂẦẤẬẨẪĂẰẮẶẲẴÈÉẸẺẼÊỀẾỆỂỄÌÍỊỈĨÒÓỌỎÕÔỒỐỘỔỖƠỜỚỢỞỠÙÚỤỦŨƯỪỨỰỬỮỲÝỴỶỸĐ"
)
CATEGORY_RULES = (
    ("laptop", ("laptop", "macbook", "máy tính xách tay")),
    ("smartphone", ("điện thoại", "smartphone", "iphone", "dtdd")),
    ("television", ("tivi", "tv", "television")),
    ("headphone", ("tai nghe", "headphone", "earphone", "airpods")),
    ("monitor", ("màn hình", "monitor")),
    ("desktop", ("để bàn", "desktop", "pc", "máy tính bộ")),
    ("tablet", ("tablet", "máy tính bảng", "ipad")),
)
ITEM_CATEGORY_RULES = (
    ("laptop", ("laptop", "máy tính xách tay")),
    ("cpu", ("cpu", "processor", "vi xử lý", "core i", "ryzen")),
    ("monitor", ("monitor", "màn hình")),
    ("smartphone", ("phone", "điện thoại", "smartphone")),
    ("headphone", ("headphone", "tai nghe")),
)
COMPARED_ATTRIBUTES = ("công nghệ cpu", "chip xử lý", "ram", "ổ cứng", "brand", "thương hiệu")

Rules = Sequence[tuple[str, Sequence[str]]]


def _squeeze(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, SPACE + "+", " ")))


def standardize(c: Column) -> Column:
    """Null to '', runs of white space to one space, trimmed, lower case."""
    return _squeeze(F.coalesce(c.cast("string"), F.lit("")))


def clean_text(c: Column) -> Column:
    """Tags and characters other than letters, digits, white space and .,!? to spaces; then as standardize. White space and
    what is cut become one space in the same pass."""
    plain = F.coalesce(c.cast("string"), F.lit(""))
    plain = F.when(plain.contains("<"), F.regexp_replace(plain, "<[^>]*>", " ")).otherwise(plain)
    # the letters are looked at last: a long class is slow, and most characters are settled before it
    return F.lower(F.trim(F.regexp_replace(plain, f"(?:{SPACE}|[^a-zA-Z0-9 \\t\\n\\r\\f.,!?](?<![{KEPT_LETTERS}]))+", " ")))


def list_text(c: Column) -> Column:
    """A list written as text to its items, parted by spaces; other text stays, null gives ''."""
    items = F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})
    read = F.array_join(F.transform(items, lambda x: F.coalesce(x, F.lit("None"))), " ")
    return F.when(c.isNull(), F.lit("")).when(c.startswith("[") & items.isNotNull(), read).otherwise(c)


def one_line(*parts: Column) -> Column:
    """The parts joined by spaces, line breaks to spaces; nulls are skipped."""
    return F.translate(F.concat_ws(" ", *parts), "\n", " ")


def category_of(text: Column, rules: Rules = CATEGORY_RULES, default: str = "other", whole_word: bool = False) -> Column:
    """The first category of which a keyword stands in the lower-cased text."""
    def first_hit(low: Column) -> Column:
        hit = lambda w: low.rlike(f"(?<![\\p{{L}}\\p{{N}}]){w}(?![\\p{{L}}\\p{{N}}])") if whole_word else low.contains(w)
        rows = [F.when(reduce(or_, [hit(w) for w in words]), F.lit(name)) for name, words in rules]
        return F.coalesce(*rows, F.lit(default))

    return F.transform(F.array(F.coalesce(F.lower(text), F.lit(""))), first_hit)[0]  # lower-cased once, not for each keyword


def rating_or_zero(c: Column) -> Column:
    """A number as a float, 0 where there is none."""
    return F.coalesce(c.try_cast("float"), F.lit(0).cast("float"))


def _last_wins(pairs: Column) -> Column:
    """An array of struct(k, v) to a map; of equal keys the last value stands."""
    seen = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i")))
    last = F.filter(seen, lambda p: ~F.exists(seen, lambda o: (o["k"] == p["k"]) & (o["i"] > p["i"])))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def parse_specs(items: Column) -> Column:
    """An array of `key::value` texts to a map; both trimmed and lower case, items without `::` left out. Null gives an empty map."""
    pairs = F.transform(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.contains("::")), lambda x: F.struct(
        F.lower(F.trim(F.substring_index(x, "::", 1))).alias("k"), F.lower(F.trim(F.substr(x, F.locate("::", x) + 2))).alias("v")))
    return _last_wins(pairs)


def parse_specs_text(c: Column) -> Column:
    """As parse_specs, of a list written as text."""
    return parse_specs(F.when(c.startswith("["), F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})))


def lower_map(c: Column) -> Column:
    """A map with keys and values in lower case."""
    return _last_wins(F.transform(F.map_entries(c), lambda e: F.struct(F.lower(e["key"]).alias("k"), F.lower(e["value"]).alias("v"))))


def json_specs(c: Column) -> Column:
    """A JSON object as a map, null for other text. Give it the raw column: cleaning removes braces."""
    return F.when(c.startswith("{"), F.from_json(c, "map<string,string>"))


def map_text(c: Column) -> Column:
    """A map as `key=value` texts in order of the keys, parted by ';'."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def word_count(c: Column) -> Column:
    """Parts between single spaces, empty ones included; null for null."""
    return F.when(c.isNotNull(), F.size(F.split(c, " ")).cast("long"))


def tokens(c: Column) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(c, SPACE + "+"), lambda x: x != "")


def price_number(c: Column, strip_commas: bool = True) -> Column:
    """The first number of a price text, null without one."""
    plain = F.regexp_replace(c, ",", "") if strip_commas else c
    return F.regexp_extract(plain, "([0-9]+\\.?[0-9]*)", 1).try_cast("double")


def attribute_match(q: Column, c: Column, keys: Sequence[str] = COMPARED_ATTRIBUTES) -> Column:
    """Of the keys that both maps hold, the share with equal values; 0 if there are none."""
    names = F.array(*[F.lit(k) for k in keys])
    both = F.filter(names, lambda k: F.map_contains_key(q, k) & F.map_contains_key(c, k))
    equal = F.filter(both, lambda k: F.element_at(q, k) == F.element_at(c, k))
    return F.coalesce(F.greatest(F.size(equal), F.lit(0)) / F.greatest(F.size(both), F.lit(1)), F.lit(0.0))
