"""Mixing sources to target weights: budgets down a tree, then a seeded prefix of each leaf.

The tree's levels are columns, such as domain, language and source. A node can take its
documents' tokens times the epochs allowed. A budget is shared among children by weight;
what a child cannot take goes to its siblings, again by weight, and only what all siblings
together cannot take is left to the level above. All of it is integer arithmetic.

A leaf's budget is read off its epochs: passes over its documents, each in an order of its own
seed. Full passes take every document; of the last pass the leaf takes the longest prefix
whose tokens fit. The prefix ends inside one bucket of that order, found from sums, so
that no task orders a whole leaf. Only SQL functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import WORD, fresh, stored
from nearfield.session import broadcast_if_small

Weights = Mapping[str, Mapping[str, int]]
_WIDE = "decimal(38,0)"


def token_count(text: str | Column) -> Column:
    """Words of a text; of null none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _weight(level: str, weights: Weights) -> Column:
    """A node's weight: what its level names for it, or for ``*``, else 1."""
    named = weights.get(level, {})
    found = F.lit(int(named.get("*", 1)))
    for value, weight in named.items():
        if value != "*":
            found = F.when(F.col(level) == value, int(weight)).otherwise(found)
    return found.cast("bigint")


def _shared(nodes: DataFrame, parents: Sequence[str], level: str) -> DataFrame:
    """``nodes`` (cap, weight, budget of the parent) with their own budget in place of it."""
    family = Window.partitionBy(*(parents or [F.lit(0)]))
    # Products of weights and tokens pass 64 bits at some 10^13 tokens.
    cap, weight, budget = (F.col(c).cast(_WIDE) for c in ("cap", "weight", "budget"))
    ratio = F.when(F.col("weight") > 0, F.col("cap").cast("decimal(19,0)") / F.col("weight").cast("decimal(18,0)"))
    order = family.orderBy(ratio.asc_nulls_last(), level)
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(_WIDE)
    rest = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing)).cast(_WIDE)
    fits = cap * rest <= (budget - before).cast(_WIDE) * weight
    full = (F.col("cap") == 0) | (F.col("weight") > 0) & fits
    marked = nodes.withColumn("full", full)
    taken = F.sum(F.when(F.col("full"), cap).otherwise(0)).over(family)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(weight)).over(family)
    summed = marked.withColumn("taken", taken.cast(_WIDE)).withColumn("open_weight", open_weight.cast(_WIDE))
    part = F.expr(f"cast(cast(budget - taken as {_WIDE}) * cast(weight as {_WIDE}) as {_WIDE}) div open_weight")
    own = F.when(F.col("full"), F.col("cap")).when(F.col("open_weight") == 0, 0).otherwise(part)
    return summed.withColumn("budget", own.cast("bigint")).drop("full", "taken", "open_weight")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Weights, budget: int, max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens, docs) with the budget of each: top down, a level at a time.

    Levels have strings, never null; weights are below 10^18. One family of children is ordered in a task; the tree
    has a row for each leaf, not for each document.
    """
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    above: DataFrame | None = None
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, weights))
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(int(budget)).cast("bigint"))
        else:
            nodes = nodes.join(above, path[:-1])
        above = _shared(nodes, path[:-1], level).select(*path, "budget")
    return leaves.join(above, list(levels))


def _place(seed: int, epoch: Column, id_col: str) -> Column:
    """Where a document comes in an epoch: 32 hex digits."""
    doc = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc))


def _bucket(place: str, buckets: str) -> Column:
    """The bucket of a place; buckets part the places in order."""
    return F.expr(f"cast(conv(substr({place}, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296")


def mix(
    docs: DataFrame, levels: Sequence[str], weights: Weights, budget_share: float = 1.0, max_epochs: int = 2,
    seed: int = 1, id_col: str = "doc_id", text_col: str = "text", epochs_col: str = "epochs",
) -> DataFrame:
    """The documents that the mixture takes, with how many epochs take each.

    The budget is ``budget_share`` of all documents' tokens. ``weights`` gives integer weights
    for each level's values; ``*`` stands for values not named. A null level value counts as
    the empty string; a null text has no tokens and goes with the prefix it lies in; rows that
    repeat an id lie at one place and are taken together, as are rows without an id; an empty
    table gives no rows. A column named like the epochs is replaced; text is never shuffled.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() == epochs_col.lower()))
    keys = [fresh(docs, f"level{i}") for i in range(len(levels))]
    place = fresh(docs, "place")
    read = docs.withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in zip(keys, levels)})
    named = {k: weights.get(c, {}) for k, c in zip(keys, levels)}
    narrow = stored(read.select(*keys, F.col(id_col).alias("id"), token_count(text_col).alias("tokens")))
    leaves = stored(narrow.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets = leaf_budgets(leaves, keys, named, int(total * budget_share), max_epochs)
    passes = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("bigint")
    plan = stored(
        budgets.withColumn("passes", passes)
        .withColumn("left", F.col("budget") - F.col("passes") * F.col("tokens"))
        .withColumn("buckets", F.ceil(F.sqrt("docs")).cast("bigint"))
        .select(*keys, "passes", "left", "buckets")
    )
    placed = (
        narrow.join(broadcast_if_small(plan), keys)
        .withColumn("place", _place(seed, F.col("passes"), "id"))
        .withColumn("bucket", _bucket("place", "buckets"))
    )
    sums = placed.groupBy(*keys, "bucket", "left").agg(F.sum("tokens").alias("n"))
    # A leaf has as many buckets as the root of its documents.
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    beyond = sums.withColumn("sum", F.sum("n").over(upto)).where(F.col("sum") > F.col("left"))
    ends = stored(
        beyond.groupBy(*keys).agg(
            F.min("bucket").alias("last_bucket"), F.min(F.struct("bucket", F.col("sum") - F.col("n")))["col2"].alias("before")
        )
    )
    last = placed.join(broadcast_if_small(ends), keys).where(F.col("bucket") == F.col("last_bucket"))
    # Rows of one place, such as all without an id, are one before they are ordered.
    inside = last.groupBy(*keys, "place", "before", "left").agg(F.sum("tokens").alias("tokens"))
    running = F.sum("tokens").over(Window.partitionBy(*keys).orderBy("place"))
    fits = inside.withColumn("sum", F.col("before") + running).where(F.col("sum") <= F.col("left"))
    cuts = fits.groupBy(*keys).agg(F.max("place").alias("last_place"))
    opens = (F.col("left") > 0) | (F.col("passes") == 0)
    decided = plan.join(ends, keys, "left").join(cuts, keys, "left").withColumn("opened", opens)
    names = [fresh(docs, c) for c in ("passes", "buckets", "last_bucket", "last_place", "opened")]
    passes, buckets, last_bucket, last_place, opened = names
    decided = stored(decided.select(*keys, "passes", "buckets", "last_bucket", "last_place", "opened").toDF(*keys, *names))
    marked = read.join(broadcast_if_small(decided), keys).withColumn(place, _place(seed, F.col(passes), id_col))
    bucket = _bucket(place, buckets)
    in_last = (bucket == F.col(last_bucket)) & (F.col(place) <= F.col(last_place))
    in_prefix = F.col(last_bucket).isNull() | (bucket < F.col(last_bucket)) | F.coalesce(in_last, F.lit(False))
    # A budget of just so many passes opens no further one.
    epochs = F.col(passes) + F.when(F.col(opened) & in_prefix, 1).otherwise(0)
    return marked.select(*(F.col(f"`{c}`") for c in docs.columns), epochs.cast("int").alias(epochs_col)).where(F.col(epochs_col) > 0)
