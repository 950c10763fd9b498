"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The leaves of the tree are (domain, lang, source). A budget of tokens flows from the root to
the domains, then the languages, then the sources, in proportion to their weights. A node can
take at most ``max_epochs`` passes over its tokens; what it cannot take goes to its siblings
first, and since a parent never gets more than its children can take, a shortage reaches the
ancestors' siblings only when all siblings are full. Inside a leaf every epoch has an order of
its own, drawn from the seed, and the leaf gets the prefix of that token stream which its
budget pays for (a document that begins within the budget is included).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.session import one, small_side

WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"
BUCKET_DIGITS = 3  # 4096 slices of a leaf's order


def words_of(text: str = "text") -> Column:
    """Words between white space; null and empty texts have none."""
    return F.coalesce(F.expr(f"regexp_count({text}, '{WORD}')"), F.lit(0)).cast("bigint")


def domain_of(source: str = "source") -> Column:
    """Domain of a source: sources are dealt into four groups by the digest of their name."""
    digit = F.substring(F.md5(F.coalesce(F.col(source), F.lit(""))), 1, 1)
    return F.concat(F.lit("d"), F.translate(digit, "0123456789abcdef", "0000111122223333"))


def weight_of(level: str, weights: Mapping[str, float] | None) -> Column:
    """Configured weight of a node by its name, 0 or more; 1 for nodes that are not named."""
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        if not value >= 0:
            raise ValueError(f"weight of {name!r} in {level}: {value}")
        weight = F.when(F.col(level) == name, F.lit(float(value))).otherwise(weight)
    return weight


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split ``budget`` of each parent over its children by ``weight``, none above ``room``.

    Children in the order of room / weight fill up first: with the budget left and the weight
    left before a child, it is full when its fair share reaches its room. Exact, without
    iterating; adds ``grant``.
    """
    ratio = (F.col("room") / F.col("weight")).alias("ratio")
    key = parent or [F.lit(0)]
    order = Window.partitionBy(*key).orderBy("ratio", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    filled = (
        nodes.select("*", ratio)
        .withColumn("room_before", F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        .withColumn(
            "weight_left",
            F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        )
        .withColumn(
            "full", (F.col("budget") - F.col("room_before")) * F.col("weight")
            >= F.col("room") * F.col("weight_left")
        )
        # the full ones are a prefix; the first that is not sets the rate of all the others
        .withColumn(
            "broke",
            F.max(F.when(~F.col("full"), 1).otherwise(0)).over(
                order.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .withColumn(
            "at",
            F.min(
                F.when(F.col("broke") == 1, F.struct("ratio", name, "room_before", "weight_left"))
            ).over(whole),
        )
    )
    rate = (F.col("budget") - F.col("at.room_before")) / F.col("at.weight_left")
    return filled.withColumn(
        "grant",
        F.when(F.col("broke") == 0, F.col("room")).otherwise(
            F.least(F.col("room"), rate * F.col("weight"))
        ),
    ).drop("ratio", "room_before", "weight_left", "full", "broke", "at")


def leaf_budgets(
    leaves: DataFrame,
    fraction: float,
    max_epochs: int,
    weights: Mapping[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """Tokens granted to each leaf of ``leaves(domain, lang, source, tokens)``; leaves under a
    weight of 0 get no row, and what they cannot take goes to the others."""
    weights = weights or {}
    base = leaves.filter("tokens > 0").withColumn(
        "room", F.col("tokens").cast("double") * max_epochs
    )
    path = ["domain", "lang", "source"]
    total = one(base, F.coalesce(F.sum("tokens"), F.lit(0)).cast("double") * fraction)
    for name in path:
        base = base.filter(weight_of(name, weights.get(name)) > 0)
    granted: DataFrame | None = None
    for depth in range(1, len(path) + 1):
        keys, parent, name = path[:depth], path[: depth - 1], path[depth - 1]
        nodes = base.groupBy(*keys).agg(F.sum("room").alias("room"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", weight_of(name, weights.get(name)))
        if granted is None:
            nodes = nodes.withColumn("budget", total)
        else:
            nodes = nodes.join(
                granted.select(*parent, F.col("grant").alias("budget")), parent
            )
        granted = share_out(nodes, parent, name)
    return granted.select(*path, "tokens", F.floor("grant").cast("bigint").alias("budget"))


def mix_sources(
    docs: DataFrame,
    fraction: float = 0.9,
    max_epochs: int = 4,
    seed: int = 42,
    weights: Mapping[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """Selected passes over documents: the columns of ``docs`` and ``domain``, ``tokens``,
    ``epoch`` (from 0).

    ``fraction`` of all tokens is the budget of the root. A weight of 0 excludes a domain,
    language or source. Null ``lang`` or ``source`` is a
    value of its own, written as an empty name. A text without words costs nothing and is
    taken in every epoch that its leaf enters, but never in a leaf without any tokens.
    Repeated rows are documents of their own; equal rows share their place in the order and
    are taken together. Needs ``doc_id``, ``text``, ``lang``, ``source``; any other column is
    carried along, except that the three added names replace columns of that name.

    A leaf may hold most of the rows: its order is cut into 4096 slices, the slices' sums
    show where the budget ends, and rows are ordered only inside that one slice.
    """
    own = docs.drop("domain", "tokens", "epoch")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    leaf = ["domain", "__lang", "__source"]
    sized = own.select(
        "*",
        domain_of().alias("domain"),
        words_of().alias("tokens"),
        F.coalesce("lang", F.lit("")).alias("__lang"),
        F.coalesce("source", F.lit("")).alias("__source"),
    )
    sizes = sized.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"))
    budgets = (
        leaf_budgets(
            sizes.select("domain", F.col("__lang").alias("lang"), F.col("__source").alias("source"), "tokens"),
            fraction, max_epochs, weights,
        )
        .select(
            F.col("domain"), F.col("lang").alias("__lang"), F.col("source").alias("__source"),
            F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("__full"),
            (F.col("budget") % F.col("tokens")).alias("__rest"),
        )
    )
    # The last epoch of a leaf is the only one that is cut: epoch number = full passes.
    keyed = sized.join(small_side(budgets, "budgets"), leaf).withColumn(
        "__order", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__full").cast("string"), key))
    ).withColumn("__slice", F.substring("__order", 1, BUCKET_DIGITS))
    running = Window.partitionBy(*leaf).orderBy("__slice")
    slices = (
        keyed.groupBy(*leaf, "__slice", "__rest")
        .agg(F.sum("tokens").alias("__sum"))
        .withColumn("__upto", F.sum("__sum").over(running))
        .withColumn("__before", F.col("__upto") - F.col("__sum"))
    )
    cut = slices.filter("__before < __rest and __upto >= __rest").select(
        *leaf, F.col("__slice").alias("__cut"), "__before"
    )
    marked = keyed.join(small_side(cut, "cuts"), leaf, "left")
    # Inside the cut slice the tokens before each row; those rows are one in 4096 of a leaf.
    inside = Window.partitionBy(*leaf).orderBy("__order").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    edge = (
        marked.filter("__slice = __cut")
        .groupBy(*leaf, "__order", "__before", "__rest")
        .agg(F.sum("tokens").alias("__own"))
        .withColumn("__upto", F.sum("__own").over(inside))
        .withColumn("__start", F.col("__before") + F.col("__upto") - F.col("__own"))
        .filter("__start < __rest")
        .groupBy(*leaf)
        .agg(F.max("__order").alias("__last"))
    )
    passes = marked.join(small_side(edge, "edges"), leaf, "left").withColumn(
        "__passes",
        F.col("__full")
        + F.when((F.col("__rest") > 0) & (F.col("__order") <= F.col("__last")), 1).otherwise(0),
    )
    taken = passes.filter("__passes > 0").select(
        *own.columns, "domain", "tokens",
        F.explode(F.sequence(F.lit(0), F.col("__passes") - 1)).alias("epoch"),
    )
    return taken
