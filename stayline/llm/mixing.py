"""Mixing sources to target weights, by hierarchical budgets.

A tree of domain, language and source carries weights. The token budget flows down from
the root: at each node it is poured over the children in proportion to their weights, no
child getting more than its subtree can supply (its tokens times the epochs allowed). What
a short child cannot use goes to its siblings by weight; only when all of them are full
does the rest stay with the parent, whose own siblings then get it, because the parent's
supply is the sum of its children's. Amounts are whole tokens; what rounding leaves goes
to the first children by order of fullness and name.

A leaf reads its documents in epochs, each ordered by a seeded hash. It takes whole epochs
as long as its budget lasts, and of the next one the prefix of whole documents that comes
nearest to what is left: the document that crosses the budget is taken if that leaves the
smaller error. So a leaf misses its budget by at most half the tokens of that document
(of rows with one id, all of them). The prefix ends at one hash value, found from sums per slice of the hash range,
so no leaf is ever sorted as a whole and a document needs only its leaf's limit.

Defined results: null texts have no tokens, a null language or source is named
``(none)``; rows with one id in one leaf share their place in the order and are taken
together; an empty table, or a budget of zero, selects nothing but documents without
tokens at the start of a leaf's order. Input columns are carried in ``row``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from stayline.llm.common import WORD, as_row, keep

LEVELS = ("domain", "lang", "source")
NONE = "(none)"
#: Hex digits of a hash that name its slice.
_SLICE = 3


def weight_of(name: Column, weights: Mapping[str, int], default: int = 1) -> Column:
    """The weight of a node by its name."""
    value = F.lit(default)
    for key, weight in weights.items():
        value = F.when(name == key, F.lit(weight)).otherwise(value)
    return value.cast("long")


def pour(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``nodes`` with ``given``: the part of the parent's ``budget`` that each gets.

    Needs ``supply``, ``weight`` (whole, above zero) and ``budget``. Nodes are taken by
    ascending supply per weight: those that a fair share would overfill come first and
    are filled, the others share what is left.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    fullness = F.col("supply").cast("double") / F.col("weight").cast("double")
    siblings = Window.partitionBy(*parents, F.lit(0)) if parents else Window.partitionBy(F.lit(0))
    order = siblings.orderBy(fullness, name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    seen = nodes.withColumns({
        "used": F.coalesce(F.sum("supply").over(before), F.lit(0)).cast("long"),
        "open": F.sum("weight").over(after),
    })
    left = wide("budget") - wide("used")
    full = seen.withColumn("full", wide("supply") * wide("open") <= left * wide("weight"))
    # What the first open node sees is what all open nodes share.
    shared = full.withColumns({
        "rest": F.max(F.when(~F.col("full"), F.col("budget") - F.col("used"))).over(siblings),
        "open": F.max(F.when(~F.col("full"), F.col("open"))).over(siblings),
    })
    share = F.floor(wide("rest") * wide("weight") / wide("open")).cast("long")
    shared = shared.withColumn("given", F.when(F.col("full"), F.col("supply")).otherwise(share))
    spare = F.col("rest") - F.sum(F.when(~F.col("full"), F.col("given"))).over(siblings)
    place = F.sum(F.when(~F.col("full"), F.lit(1)).otherwise(F.lit(0))).over(order)
    return shared.withColumns({"spare": spare, "place": place}).withColumn(
        "given", F.col("given") + F.when(~F.col("full") & (F.col("place") <= F.col("spare")), F.lit(1)).otherwise(F.lit(0))
    ).drop("used", "open", "full", "rest", "spare", "place")


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], epochs: int, share: tuple[int, int]) -> DataFrame:
    """Leaves (the level columns and ``tokens``) with their ``given`` tokens.

    ``share`` is the part of all tokens to select, as a fraction of whole numbers.
    """
    supplied = keep(leaves.withColumn("supply", F.col("tokens") * epochs), "leaves")
    total = supplied.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * share[0] / share[1]).cast("long").alias("t")).first()["t"]
    above: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[:depth + 1])
        nodes = supplied.groupBy(*keys).agg(
            F.sum("supply").cast("long").alias("supply"), F.sum("tokens").cast("long").alias("tokens")
        ).withColumn("weight", weight_of(F.col(level), weights.get(level, {})))
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(total).cast("long"))
        else:
            nodes = nodes.join(above.select(*keys[:-1], F.col("given").alias("budget")), keys[:-1])
        above = keep(pour(nodes, keys[:-1], level).drop("budget", "weight"), "budgets")
    return above


def _place(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _limits(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``plan`` with ``limit``: the last place in the order that the open epoch takes."""
    keys = list(LEVELS)
    placed = rows.join(plan.where("rest > 0").select(*keys, "whole", "rest"), keys).withColumn(
        "place", _place(seed, F.col("whole"), F.col("id"))
    ).withColumn("slice", F.substring("place", 1, _SLICE))
    slices = placed.groupBy(*keys, "rest", "slice").agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = slices.withColumn("end", F.sum("tokens").over(upto)).where("end > rest")
    cut = keep(ends.groupBy(*keys, "rest").agg(F.min_by(
        F.struct("slice", (F.col("end") - F.col("tokens")).alias("before")), "slice").alias("s")
    ).select(*keys, "rest", "s.*"), "cuts")
    inside = placed.join(cut.withColumnRenamed("rest", "r"), [*keys, "slice"]).groupBy(
        *keys, "slice", "rest", "before", "place").agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy(*keys, "slice").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    fits = inside.withColumn("end", F.col("before") + F.sum("tokens").over(upto)).where(
        "end <= rest OR (end - tokens < rest AND 2 * end - tokens < 2 * rest)")
    last = fits.groupBy(*keys).agg(F.max("place").alias("last"))
    limits = cut.join(last, keys, "left").select(*keys, F.coalesce("last", "slice").alias("limit"))
    return plan.join(limits, keys, "left")


def mixed(
    docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], share: tuple[int, int],
    epochs: int, seed: int, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None,
) -> DataFrame:
    """``row`` (see ``as_row``) of each selected document, its ``domain``, and ``copies``, the
    epochs that select it."""
    keys = {
        "domain": F.coalesce(domain, F.lit(NONE)), "lang": F.coalesce(F.col("lang"), F.lit(NONE)),
        "source": F.coalesce(F.col("source"), F.lit(NONE)),
    }
    tokens = F.coalesce(F.size(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    rows = keep(docs.select(
        *[c.alias(k) for k, c in keys.items()], F.col(f"`{doc_id}`").alias("id"), tokens.alias("n_tokens")
    ), "tokens")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    given = budgets(leaves, weights, epochs, share)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("given") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    plan = keep(given.withColumn("whole", whole).withColumn("rest", F.col("given") - F.col("whole") * F.col("tokens")), "plan")
    limited = keep(_limits(rows, plan, seed), "limits")
    marks = limited.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(LEVELS)], F.col("whole").alias("_whole"), F.col("limit").alias("_limit")
    )
    named = docs.select(
        as_row(docs, carry), F.col(f"`{doc_id}`").alias("id"), *[c.alias(f"_d{i}") for i, c in enumerate(keys.values())])
    joined = named.join(marks, [F.col(f"_d{i}") == F.col(f"_k{i}") for i in range(3)])
    more = F.coalesce(_place(seed, F.col("_whole"), F.col("id")) <= F.col("_limit"), F.lit(False)).cast("long")
    return joined.select("row", F.col("_d0").alias("domain"), (F.col("_whole") + more).alias("copies")).where("copies > 0")
