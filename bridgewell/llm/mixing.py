"""Mixing sources to target weights by hierarchical budgeting.

Leaves are paths of a tree (domain, language, source). A token budget flows from the root by the weights of the
children. A leaf can give at most its tokens times the allowed epochs; what it falls short of goes to its siblings by weight,
and only what they cannot take goes to the siblings of the parent, and so on. Each leaf then gives the first
documents of a seeded endless sequence: epoch after epoch, each in an order of its own, until its budget is used.

The budgets of up to 100,000 leaves are worked out at once and sent to all tasks. Sources may be hosts, whose number grows
with the data: beyond, Spark works budgets out level by level and joins leaves by their path, with leaves and parents of many rows split. Selection sums tokens by leaf and order bucket first, so that only the bucket in which a leaf's budget ends is
ordered row by row: a leaf with a third of all rows is never put in one place. What comes out is a row for each leaf, up to which
place of its order rows are taken; every row's own place is a hash, so the rows themselves are judged where they lie.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import saved

MOST_SENT = 100_000
PATH = ("domain", "lang", "source")
WORD = r"[^ \t\n\x0B\f\r]+"

Weights = Mapping[tuple[str, ...], float]


def share(amount: float, weights: Sequence[float], capacity: Sequence[float]) -> list[float]:
    """The amount split by weight, nobody over its capacity; shortages go to the others by weight."""
    got, open_ = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0 and capacity[i] > 0]
    while open_ and amount > 1e-9:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if capacity[i] - got[i] <= amount * weights[i] / total}
        if not full:
            for i in open_:
                got[i] += amount * weights[i] / total
            break
        amount -= sum(capacity[i] - got[i] for i in full)
        for i in full:
            got[i] = capacity[i]
        open_ = [i for i in open_ if i not in full]
    return got


def budgets(available: Mapping[tuple[str, ...], int], budget: float, weights: Weights, epochs: float) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf. weights: of nodes by their path from the root; a node that is not named weighs 1."""

    def spread(amount: float, level: int, under: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
        if level == depth:
            return {under[0]: int(amount + 1e-6)}
        inside: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
        for leaf in under:
            inside.setdefault(leaf[: level + 1], []).append(leaf)
        got = share(amount, [weights.get(c, 1.0) for c in inside], [sum(available[x] for x in leaves) * epochs for leaves in inside.values()])
        return {k: v for leaves, a in zip(inside.values(), got, strict=True) for k, v in spread(a, level + 1, leaves).items()}

    if not available:
        return {}
    depth = len(next(iter(available)))
    return spread(min(budget, sum(available.values()) * epochs), 0, sorted(available))


def _met(rows: DataFrame, nodes: DataFrame, keys: list[str], cut: int | None, how: str = "inner") -> DataFrame:
    """rows with the columns of their node (keys, _fan and others). cut: None for nodes that are few enough to be sent everywhere; else nodes that over so many
    rows meet (_fan), at most 1,000 of them, are copied and their rows dealt over the copies, so that no node's rows meet in one task."""
    if cut is None:
        return rows.join(F.broadcast(nodes), keys, how)
    parts = nodes.where(F.col("_fan") > cut).select(*keys, F.ceil(F.col("_fan") / cut).cast("int").alias("_parts"))
    many = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(parts), keys, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), many).cast("int")).drop("_parts")
    copied = nodes.join(F.broadcast(parts), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), many - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_part"], how).drop("_part")


def _cut(rows: int) -> int:
    return max(1, rows // 1000)


def _lines(nodes: DataFrame, keys: list[str], cut: int | None) -> DataFrame:
    """keys, _fan, _line: a parent's budget is used up when each child gets its weight times _line, or its room if that is less. A null line: all get their room.

    Children fill up in the order of room by weight. That order is cut into cells of 4 %, summed apart; the line lies in the first cell that is not full whole, and only its
    children are ordered, equal ones as one."""
    ratio = F.col("_room") / F.col("_weight")
    open_ = nodes.where("_weight > 0 and _room > 0").withColumn("_ratio", ratio).withColumn("_cell", F.floor(F.log2(ratio) * 16))
    sums = (F.sum("_room").alias("_room"), F.sum("_weight").alias("_weight"))
    cells = open_.groupBy(*keys, "_fan", "_amount", "_cell").agg(*sums, F.max("_ratio").alias("_most"))
    first, upto = Window.unboundedPreceding, Window.partitionBy(*keys)
    left = F.coalesce(F.sum("_room").over(upto.orderBy("_cell").rowsBetween(first, -1)), F.lit(0))
    above = F.coalesce(F.sum("_weight").over(upto.orderBy(F.desc("_cell")).rowsBetween(first, -1)), F.lit(0.0))
    placed = cells.withColumn("_left", F.col("_amount") - left).withColumn("_above", above)
    short = F.col("_room") + F.col("_most") * F.col("_above") > F.col("_left")
    # _beyond: the line if rounding finds all of the cell full after all
    beyond = F.when(F.col("_above") > 0, (F.col("_left") - F.col("_room")) / F.col("_above"))
    edges = placed.groupBy(*keys, "_fan").agg(F.min(F.when(short, F.struct("_cell", "_left", "_above", beyond.alias("_beyond")))).alias("_edge"))
    inside = _met(open_.drop("_fan"), edges, keys, cut).where("_cell = _edge._cell").groupBy(*keys, "_edge", "_ratio").agg(*sums)
    below = F.coalesce(F.sum("_room").over(upto.orderBy("_ratio").rowsBetween(first, -1)), F.lit(0))
    still = F.sum("_weight").over(upto.orderBy(F.desc("_ratio")).rowsBetween(first, 0))
    ranked = inside.withColumn("_left", F.col("_edge._left") - below).withColumn("_still", still + F.col("_edge._above"))
    found = ranked.where("_ratio * _still > _left").groupBy(*keys).agg(F.min(F.struct("_ratio", (F.col("_left") / F.col("_still")).alias("_line"))).alias("_at"))
    return edges.join(found, keys, "left").select(*keys, "_fan", F.coalesce("_at._line", "_edge._beyond").alias("_line"))


def budgets_by_level(leaves: DataFrame, levels: list[str], fraction: float, weights: Weights, epochs: int, most_sent: int = MOST_SENT) -> DataFrame:
    """What budgets() gives, for trees of any size: leaves (levels, _sum tokens and _n rows) with _given, the tokens of each one's budget; fraction is of all tokens.
    One pass a level, from the root down; no leaf goes through the driver."""
    spark = leaves.sparkSession
    count, total = leaves.agg(F.count("*"), F.coalesce(F.sum("_sum"), F.lit(0))).first()
    cut = None if count <= most_sent else _cut(count)
    leaves, keys = leaves.withColumn("_root", F.lit("")), ["_root"]
    at = spark.range(1).select(F.lit("").alias("_root"), F.lit(float(min(fraction * total, total * epochs))).alias("_amount"), F.lit(count).alias("_fan"))
    for i, level in enumerate(levels):
        own = [*keys, level]
        nodes = leaves.groupBy(*own).agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"), (F.sum("_sum") * epochs).alias("_room"), F.count("*").alias("_under"))
        named = [(*path, float(w)) for path, w in weights.items() if len(path) == i + 1]
        if named:  # as many as the configuration names
            nodes = nodes.join(spark.createDataFrame(named, ", ".join(f"{k} string" for k in own[1:]) + ", _weight double"), own[1:], "left")
        nodes = nodes.withColumn("_weight", F.coalesce("_weight", F.lit(1.0)) if named else F.lit(1.0))
        nodes = saved(_met(nodes, at.drop("_sum", "_n"), keys, cut))
        given = F.when((F.col("_weight") <= 0) | (F.col("_room") <= 0), 0.0).when(F.col("_line").isNull(), F.col("_room")).otherwise(F.least("_room", F.col("_line") * F.col("_weight")))
        shared = _met(nodes.drop("_fan", "_amount"), _lines(nodes, keys, cut), keys, cut, "left")
        at = saved(shared.select(*own, "_sum", "_n", given.cast("double").alias("_amount"), F.col("_under").alias("_fan")))
        keys = own
    return at.select(*levels, "_sum", "_n", F.floor(F.col("_amount") + 1e-6).cast("long").alias("_given"))


def _levels(path: Mapping[str, Column]) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit("")).alias(f"_level{i}") for i, c in enumerate(path.values())]


def _marked(rows: DataFrame, leaves: DataFrame, levels: list[str], seed: int, cut: int | None) -> DataFrame:
    """rows (_id, _key, levels) with their leaf's columns, their place in its order and their bucket."""
    return _met(rows, leaves, levels, cut).drop("_fan").withColumn("_order", F.xxhash64(F.lit(seed), "_whole", "_id", "_key")).withColumn(
        "_bucket", F.pmod(F.shiftrightunsigned("_order", 1), F.col("_buckets")))


def _ends(rows: DataFrame, levels: list[str], weights: Weights, fraction: float, epochs: int, seed: int, per_bucket: int | None, most_sent: int) -> tuple[DataFrame, int | None]:
    """A row for each leaf: _whole (epochs that all its rows are taken in), _buckets, _full (the last bucket taken whole in the
    next epoch), _edge (the bucket in which its budget ends), _last (the last place taken there) and _fan (its rows); and how _met() joins it."""
    totals = rows.groupBy(*levels).agg(F.sum("_tokens").alias("_sum"), F.count("*").alias("_n"))
    few, cut = totals.limit(most_sent + 1).collect(), None
    if len(few) <= most_sent:
        available = {tuple(r[k] for k in levels): r["_sum"] for r in few}
        found = budgets(available, fraction * sum(available.values()), weights, epochs)
        given = rows.sparkSession.createDataFrame([(*r, found[tuple(r[k] for k in levels)]) for r in few], ", ".join(f"{k} string" for k in levels) + ", _sum long, _n long, _given long")
    else:
        totals = saved(totals)
        cut = _cut(totals.agg(F.sum("_n")).first()[0])
        given = budgets_by_level(totals, levels, fraction, weights, epochs, most_sent)
    within = F.lit(per_bucket) if per_bucket else F.floor(F.sqrt("_n"))
    plan = given.select(*levels, F.expr("_given div _sum").alias("_whole"), (F.col("_given") % F.col("_sum")).alias("_rest"), F.greatest(F.lit(1), F.floor(F.col("_n") / within)).alias("_buckets"), F.col("_n").alias("_fan"))
    # Each epoch has an order of its own; whole epochs take all rows, so that only the last order matters.
    placed = _marked(rows, plan, levels, seed, cut)
    sums = placed.groupBy(*levels, "_bucket", "_rest").agg(F.sum("_tokens").alias("_sum"))
    upto = Window.partitionBy(*levels).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    over = F.col("_upto") > F.col("_rest")
    edges = sums.withColumn("_upto", F.sum("_sum").over(upto)).groupBy(*levels).agg(
        F.max(F.when(~over, F.col("_bucket"))).alias("_full"), F.min(F.when(over, F.struct("_bucket", (F.col("_upto") - F.col("_sum")).alias("_before")))).alias("_at"))
    edges = saved(plan.drop("_rest").join(edges, levels, "left").select(*plan.drop("_rest").columns, "_full", F.col("_at._bucket").alias("_edge"), F.col("_at._before").alias("_before")))
    run = Window.partitionBy(*levels).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    at = _met(placed.drop("_whole", "_buckets"), edges.select(*levels, "_fan", "_edge", "_before"), levels, cut)
    inside = at.where(F.col("_bucket") == F.col("_edge")).groupBy(*levels, "_rest", "_before", F.struct("_order", "_id", "_key").alias("_place")).agg(F.sum("_tokens").alias("_sum"))
    last = inside.withColumn("_upto", F.col("_before") + F.sum("_sum").over(run)).where("_upto <= _rest").groupBy(*levels).agg(F.max("_place").alias("_last"))
    return saved(edges.drop("_before").join(last, levels, "left")), cut


def _copies() -> Column:
    into = F.when(F.col("_bucket") == F.col("_edge"), F.struct("_order", "_id", "_key") <= F.col("_last")).otherwise(F.col("_bucket") <= F.col("_full"))
    return (F.col("_whole") + F.coalesce(into, F.lit(False)).cast("int")).cast("int")


def _rows(docs: DataFrame, path: Mapping[str, Column]) -> DataFrame:
    """A few numbers for each document with tokens: the texts are read once."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_tokens")
    return saved(docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), *_levels(path), tokens).where("_tokens > 0"))


def mix(docs: DataFrame, path: Mapping[str, Column], weights: Weights, fraction: float, epochs: int = 4, seed: int = 42, per_bucket: int | None = None,
        most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id, the path columns, tokens (long) and copies (int >= 1) of every chosen document.

    path: the name and value of each level, from the root down; null levels count as ''. fraction: the budget, in
    tokens of the whole input. A document is taken in an epoch while the leaf's tokens up to and with it do not pass the
    budget; the order is a hash of the epoch, doc_id and text, and its ties go to the smaller doc_id, null first. Documents without tokens, null texts among
    them, belong to no budget and are not chosen. Repeated ids are documents of their own; rows of one id and text count each and are chosen or left together.
    No rows give no rows. epochs: the most times that a leaf is gone through. per_bucket: rows ordered at once, by default the root of a leaf's rows.
    most_sent: leaves that still go through the driver and to all tasks; it changes the plan alone. A level must not be called doc_id, tokens or copies: ValueError.
    """
    if taken := {"doc_id", "tokens", "copies"} & set(path):
        raise ValueError(f"names of the result cannot be levels: {sorted(taken)}")
    rows, levels = _rows(docs, path), [f"_level{i}" for i in range(len(path))]
    ends, cut = _ends(rows, levels, weights, fraction, epochs, seed, per_bucket, most_sent)
    chosen = _marked(rows, ends, levels, seed, cut).withColumn("_copies", _copies()).where("_copies > 0")
    return chosen.select(F.col("_id").alias("doc_id"), *[F.col(x).alias(k) for x, k in zip(levels, path, strict=True)], F.col("_tokens").alias("tokens"), F.col("_copies").alias("copies"))


def domain_of(source: Column) -> Column:
    """A stand-in for a catalogue of sources: four domains by the number in the source's name; 'other' without one."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int")
    return F.coalesce(F.concat(F.lit("domain"), F.pmod(number, F.lit(4)).cast("string")), F.lit("other"))


def standard_path() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


#: Target weights: of domains, then of languages within each domain; sources of a language weigh alike.
WEIGHTS: dict[tuple[str, ...], float] = {("domain0",): 4.0, ("domain1",): 3.0, ("domain2",): 2.0, ("domain3",): 1.0} | {
    (f"domain{d}", lang): w for d in range(4) for lang, w in (("en", 6.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))}
FRACTION = 0.7


def mixed(docs: DataFrame, weights: Weights = WEIGHTS, fraction: float = FRACTION, epochs: int = 4, seed: int = 42, most_sent: int = MOST_SENT) -> DataFrame:
    """The rows of docs that mix() chooses, with their columns, whatever these are called; a row chosen k times stands k times. Rows with a null or
    repeated doc_id are judged each by its own id and text. Documents are not shuffled unless there are more than most_sent leaves."""
    path = standard_path()
    levels = [f"_level{i}" for i in range(len(path))]
    ends, cut = _ends(_rows(docs, path), levels, weights, fraction, epochs, seed, None, most_sent)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), *_levels(path)).where(F.col("_row.text").rlike(WORD))
    return _marked(whole, ends, levels, seed, cut).select("_row", F.explode(F.sequence(F.lit(1), _copies())).alias("_copy"), _copies().alias("_copies")).where("_copies > 0").select("_row.*")
