"""Mixing sources to target weights: whole documents are taken so that the words of every source meet a budget.

Every source takes each of its documents ``floor(target / size)`` times and fills what is left of the
budget by subset sum over exact lengths. Only counts per length meet: an even share of each length is taken
first, the remaining budget is then filled by bounded-knapsack dynamic programming over the lengths that
still have documents. Which documents of a length are taken is decided by a seeded hash: hash buckets are
counted, whole buckets are in or out, and only the one bucket on the border is ranked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stopwise.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words
MOST = 2.0  # times a source's own words
SEED = 42
# Words that the dynamic programme fills at most; beyond it, longest lengths first. Its table has this
# many bits per length.
KNAPSACK_WORDS = 1 << 16


def sizes(docs: DataFrame, size: Column | None = None, key: str = "long") -> DataFrame:
    counted = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(
        F.col("doc_id").cast(key).alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (counted if size is None else size.cast("long")).alias("size"),
    )


def targets(by_source: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source``, ``source_size``, ``target`` (double) out of ``source``, ``source_size``.

    A source's target is ``min(most * size, level * weight)`` with one level for all, so that the targets
    add up to ``share`` of all words: what capped sources cannot take is shared out by weight. Sources are
    capped in the order of ``most * size / weight``; the level is fixed by the first that stays below it.
    The windows run over one row per source.
    """
    one = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = by_source.withColumn("weight", F.get(cycle, place % len(weights)))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    ahead = one.orderBy(F.col("cap") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))
    light = F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0))
    level = (F.sum("source_size").over(one) * share - capped) / light
    levelled = ranked.withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    first = F.min_by("level", F.when(fits, F.struct(F.col("cap") / F.col("weight"), "source"))).over(one)
    least = F.least(F.col("cap"), F.coalesce(first, F.lit(float("inf"))) * F.col("weight"))
    return levelled.select("source", "source_size", least.alias("target"))


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum is the largest possible not above ``budget``.

    Reachable sums are the bits of one integer. A count is split into powers of two, so a length costs
    the logarithm of its count. The masks before each part are kept to walk back.
    """
    parts, masks, reach = [], [], 1
    full = (1 << (budget + 1)) - 1
    for k, (length, count) in enumerate(zip(lengths, counts)):
        count, unit = min(count, budget // length if length else 0), 1
        while count > 0:
            many = min(unit, count)
            parts.append((k, many))
            masks.append(reach)
            reach |= (reach << (many * length)) & full
            count, unit = count - many, unit * 2
        if reach >> budget & 1:
            break
    left, taken = reach.bit_length() - 1, [0] * len(lengths)
    for (k, many), mask in zip(reversed(parts), reversed(masks)):
        if not mask >> left & 1:
            left -= many * lengths[k]
            taken[k] += many
    return taken


def fill(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """Documents per length whose words come as near to ``budget`` from below as the lengths allow.

    An even share of each length first, then longest first down to ``KNAPSACK_WORDS``, then the dynamic
    programme over the rest.
    """
    total = sum(x * n for x, n in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    taken = [n * budget // total for n in counts]
    left = budget - sum(x * n for x, n in zip(lengths, taken))
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if lengths[k] and left > KNAPSACK_WORDS:
            more = min(counts[k] - taken[k], -(-(left - KNAPSACK_WORDS) // lengths[k]), left // lengths[k])
            taken[k] += more
            left -= more * lengths[k]
    rest = [n - t for n, t in zip(counts, taken)]
    return [t + m for t, m in zip(taken, knapsack(lengths, rest, min(left, KNAPSACK_WORDS)))]


def _filled(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size", ignore_index=True)
    lengths, counts = group["size"].tolist(), group["n"].tolist()
    total = int(group["source_size"].iloc[0])
    target = float(group["target"].iloc[0])
    epochs = int(target // total) if total else 0
    extra = fill(lengths, counts, int(target) - epochs * total) if total else [0] * len(lengths)
    return pd.DataFrame(
        {"source": group["source"], "size": group["size"], "epochs": epochs, "extra": extra}
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
    size: Column | None = None,
    key: str = "long",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, epochs, taken`` for every row of ``docs``.

    ``taken`` is the number of words the mix takes of the document: ``size`` times its repetitions, so
    never above ``most`` (at least 1, whole) times ``size``. A source's words stay at most a shortest remaining document below
    its target. Null or empty texts have size 0 and nothing taken; null sources are one source, after all
    others; a table without words takes nothing; repeated rows are documents of their own, which the hash
    treats alike, so rows equal in id and size on the border are ranked arbitrarily but in the same number.
    Same rows and seed, same mix. ``key`` is the type of ``doc_id``.
    """
    sized = staged(sizes(docs, size, key), "sizes")
    by_length = staged(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    by_source = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = staged(targets(by_source, weights, share, most), "targets")
    null_safe = lambda a, b: a["source"].eqNullSafe(b["source"])
    quota = by_length.join(goal, null_safe(by_length, goal)).drop(goal["source"])
    quota = staged(
        quota.groupBy("source").applyInPandas(_filled, "source string, size long, epochs int, extra long"),
        "quota",
    )
    # share of each length: buckets of the seeded hash, as many as the square root of its documents
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    of_length = by_length.withColumn("buckets", F.ceil(F.sqrt("n")).cast("long"))
    of_length = of_length.join(
        quota.withColumnsRenamed({"source": "s", "size": "z"}),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")),
    ).drop("s", "z")
    of_length = of_length.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    lookup = staged(of_length, "lookup").withColumnsRenamed({"source": "s", "size": "z"})
    placed = sized.join(lookup, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    placed = staged(placed.withColumn("u", u).withColumn("bucket", F.floor(u * F.col("buckets"))), "placed")
    part = placed.filter((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    counted = part.groupBy("source", "size", "bucket", "extra").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("source", "size").orderBy("bucket")
    counted = counted.withColumn("before", F.sum("m").over(upto) - F.col("m"))
    border = counted.filter((F.col("before") < F.col("extra")) & (F.col("before") + F.col("m") > F.col("extra")))
    border = staged(border.select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("edge"), "before"
    ), "border")
    whole = counted.filter(F.col("before") + F.col("m") == F.col("extra")).select(
        F.col("source").alias("s"), F.col("size").alias("z"), (F.col("bucket") + 1).alias("edge"), F.lit(None).cast("long").alias("before")
    )
    edges = border.unionByName(staged(whole, "whole"))
    joined = placed.join(edges, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").drop("s", "z")
    on_edge = F.col("before").isNotNull() & (F.col("bucket") == F.col("edge"))
    inner = (
        F.when(F.col("extra") >= F.col("n"), True)
        .when(F.col("extra") <= 0, False)
        .otherwise(F.col("bucket") < F.col("edge"))
    )
    sure = joined.filter(~on_edge).withColumn("chosen", inner)
    ranked = Window.partitionBy("source", "size", "bucket").orderBy("u", "doc_id")
    unsure = joined.filter(on_edge).withColumn(
        "chosen", F.row_number().over(ranked) + F.col("before") <= F.col("extra")
    )
    taken = F.col("size") * (F.col("epochs") + F.col("chosen").cast("int"))
    return sure.unionByName(unsure).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", taken.cast("long").alias("taken")
    )
