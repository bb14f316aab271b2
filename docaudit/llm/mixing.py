"""Mixing sources to target weights by subset-sum budget fitting.

A source's budget is met from its documents' exact lengths: documents are
counted by (source, length); whole repeats go to every document, the bulk of
the rest to each length in proportion, and a bounded-knapsack dynamic programme
over the length counts fits what remains of the budget.  The documents of a
length that get one more take are the first in a seeded order.

Only the counts by length of one source meet in one task: at most as many rows
as the longest document has words.

Defined results: a null text has size 0; sizes of 0 take nothing.  Null is a
source of its own.  Rows that repeat an id are documents of their own.  An
empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.common import join_classes, skew_safe_rank, word_count
from docaudit.session import cut_lineage

#: No document is taken more often than this.
REPEATS = 3
#: Words of a budget that the dynamic programme fits; proportional and greedy takes serve the rest.
FIT = 1 << 14


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(src, source_size, target) by source: shares of the whole by weight, none above REPEATS times its source.

    The excess of capped sources goes to the others by weight.  With sources in
    order of cap / weight, the level L of the uncapped ones solves
    sum(min(weight x L, cap)) = total: one running sum over one row a source.
    """
    by = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("src")) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("w", w).withColumn("cap", REPEATS * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "src")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = (
        by.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left_w", F.sum("w").over(everything) - F.sum("w").over(order) + F.col("w"))
        .withColumn("capped", F.sum("cap").over(order) - F.col("cap"))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("left_w"))
        # the first source in order whose cap is above its share fixes the level
        .withColumn("above", F.col("cap") >= F.col("level") * F.col("w"))
    )
    level = F.min(F.when(F.col("above"), F.struct(F.col("cap") / F.col("w"), "src", "level"))).over(everything)
    return by.withColumn("_l", level["level"]).select(
        "src", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("_l") * F.col("w"), F.col("cap").cast("double"))).alias("target")
    )


def nearest_sum(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """How many items of each length to take so that their sum is as near to ``goal`` as can be.

    Bounded knapsack: an item stands for 1, 2, 4, ... takes of a length, reached
    sums are the bits of one integer, and each sum remembers the first item that
    reached it, so going back from the best sum gives the takes.
    """
    takes = np.zeros(len(lengths), np.int64)
    most = 2 * goal  # the empty choice is off by goal, so no better one is beyond
    if goal <= 0:
        return takes
    full = (1 << (most + 1)) - 1
    reached, first = 1, {}
    items: list[tuple[int, int]] = []
    for k in np.argsort(lengths)[::-1].tolist():
        size, left, step = int(lengths[k]), int(min(counts[k], most // lengths[k])), 1
        while left > 0 and goal not in first:
            n = min(step, left)
            left, step = left - n, step * 2
            new = (reached << (size * n)) & full & ~reached
            if not new:
                continue
            bits = np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes((most + 8) // 8, "little"), np.uint8), bitorder="little"))
            items.append((k, n))
            first.update(dict.fromkeys(bits.tolist(), len(items) - 1))
            reached |= new
        if goal in first:
            break
    best = min([0, *first], key=lambda s: (abs(s - goal), s))
    while best:
        k, n = items[first[best]]
        takes[k] += n
        best -= n * int(lengths[k])
    return takes


def fit(lengths: np.ndarray, counts: np.ndarray, target: float, fit_words: int = FIT) -> tuple[int, np.ndarray]:
    """(whole repeats of every document, extra takes by length) whose words come nearest to ``target``."""
    have = int((lengths * counts).sum())
    if not have:
        return 0, np.zeros(len(lengths), np.int64)
    goal = round(target)
    repeats = min(REPEATS, goal // have)
    rest = goal - repeats * have
    if repeats == REPEATS or rest <= 0:
        return repeats, np.zeros(len(lengths), np.int64)
    # the bulk in proportion, floors only; then long lengths first; the programme fits the end
    bulk = max(0, rest - fit_words)
    extra = (counts.astype(object) * bulk // have).astype(np.int64)
    rest -= int((extra * lengths).sum())
    for k in np.argsort(lengths)[::-1].tolist():
        if rest <= fit_words:
            break
        n = min(int(counts[k] - extra[k]), (rest - fit_words) // int(lengths[k]))
        extra[k] += n
        rest -= n * int(lengths[k])
    return repeats, extra + nearest_sum(lengths, counts - extra, rest)


def mix_sources(df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) for every row; ``taken`` counts words, repeats included."""
    src = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))  # null sorts last
    sizes = cut_lineage(df.select(F.col(id_col).alias("id"), src.alias("src"), word_count(F.col(text_col)).alias("size")), "sizes")
    goals = cut_lineage(targets(sizes, weights), "targets")

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        lengths, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        repeats, extra = fit(lengths, counts, float(group["target"].iloc[0]))
        return pd.DataFrame({"src": group["src"], "size": lengths, "source_size": group["source_size"], "target": group["target"], "n": counts, "repeats": repeats, "extra": extra})

    takes = (
        sizes.groupBy("src", "size")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(goals, "src")
        .groupBy("src")
        .applyInPandas(_zero_aside(plan), "src string, size long, source_size long, target double, n long, repeats long, extra long")
    )
    ranked = cut_lineage(skew_safe_rank(sizes, ["src", "size"], ["id"], "_rank", seed), "ranked")
    return join_classes(ranked, cut_lineage(takes, "takes"), ["src", "size"], "n", "inner").select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("repeats") + (F.col("_rank") < F.col("extra")).cast("long"))).alias("taken"),
    )


def _zero_aside(plan):
    """Lengths of 0 take nothing and stay out of the sums."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        some = group[group["size"] > 0]
        none = group[group["size"] == 0]
        parts = [plan(some)] if len(some) else []
        if len(none):
            parts.append(none[["src", "size", "source_size", "target", "n"]].assign(repeats=0, extra=0))
        return pd.concat(parts, ignore_index=True)

    return run


def take_mix(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``df`` as often as ``mixed`` takes them (0 to REPEATS times), its columns unchanged; rows that share an id are taken alike."""
    times = (
        mixed.where("taken > 0")
        .groupBy(F.col(id_col).alias("__mix_id"))
        .agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("__mix_times"))
    )
    rows = df.join(times, F.col(id_col).eqNullSafe(F.col("__mix_id")))
    copies = F.explode(F.sequence(F.lit(1), F.col("__mix_times"))).alias("__mix_copy")
    return rows.select(*[df[c] for c in df.columns], copies).select(*df.columns)
