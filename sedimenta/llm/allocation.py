"""Draw a sample in which categories have given shares.

Quotas go down a tree of categories of any depth. What a leaf cannot supply passes first to
its siblings, the leaves of the same parent; what these cannot take goes up a level, to its
cousins, and so on to the root, in proportion to spare supply. Within a leaf rows are drawn
by the dense rank of a permutation, the md5 of seed and row id: the same rows whatever the
partitioning. Only the table of targets, of which each row is one leaf, passes through a
single task. The permutation is cut into ranges whose counts are summed first, so that only
rows of the one range in which a quota ends are ranked; a leaf that holds a third of all rows
needs no task of that size.

Defined results: labels are compared by label_key, others belong to no leaf; null labels
belong to no leaf; an empty target table gives an empty sample and report; where all
supply together is smaller than the sample, the whole supply is drawn. Targets without a
label are left out; null shares and rows count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from math import floor

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.keys import label_key

SEED = "42"
#: Levels of the tree, the root left out.
LEVELS = ("category", "severity")
#: Ranges into which the permutation is cut: the first three hexadecimal digits.
_RANGE = "substr(perm, 1, 3)"
_REPORT = "target double, supply bigint, quota bigint, unmet bigint, from_siblings bigint, from_cousins bigint"


@dataclass
class Leaf:
    path: tuple[str, ...]
    target: float
    least: int
    supply: int
    quota: int = 0
    from_siblings: int = 0
    from_cousins: int = 0

    @property
    def unmet(self) -> int:
        return max(0, self.quota - self.supply)

    @property
    def spare(self) -> int:
        return max(0, self.supply - self.quota) - self.from_siblings - self.from_cousins


def dealt(amount: int, weights: list[int]) -> list[int]:
    """amount in whole parts, in proportion to weights; sums are rounded, not parts."""
    out, upto, total = [], 0, sum(weights)
    for w in weights:
        before = amount * upto // total if total else 0
        upto += w
        out.append(amount * upto // total - before if total else 0)
    return out


def allocate(leaves: list[Leaf], shares: list[float], n: int) -> None:
    """Quotas of a sample of n rows, and what leaves take over from others. Whole parts of the
    shares, or the least rows if more; what is left of n goes to the largest remainders, what
    is too much is taken from what leaves have beyond their least."""
    order = sorted(range(len(leaves)), key=lambda i: leaves[i].path)
    leaves[:], shares = [leaves[i] for i in order], [shares[i] for i in order]
    for leaf, share in zip(leaves, shares, strict=True):
        leaf.quota = max(leaf.least, floor(share * n))
    left = n - sum(x.quota for x in leaves)
    if left >= 0:
        each, more = divmod(left, len(leaves))
        remainders = sorted(range(len(leaves)), key=lambda i: (-(shares[i] * n - floor(shares[i] * n)), leaves[i].path))
        for place, i in enumerate(remainders):
            leaves[i].quota += each + (place < more)
    else:
        slack = [x.quota - x.least for x in leaves]
        for leaf, less in zip(leaves, dealt(min(-left, sum(slack)), slack), strict=True):
            leaf.quota -= less
    owed = {x.path: x.unmet for x in leaves}
    depth = len(leaves[0].path)
    for level in reversed(range(depth)):  # what a subtree owes is met inside it, or goes up
        up: dict[tuple[str, ...], int] = {}
        for parent, members in groupby(leaves, key=lambda x: x.path[:level]):
            group = list(members)
            due = sum(v for k, v in owed.items() if k[:level] == parent)
            met = min(due, sum(x.spare for x in group))
            for leaf, more in zip(group, dealt(met, [x.spare for x in group]), strict=True):
                if level == depth - 1:
                    leaf.from_siblings += more
                else:
                    leaf.from_cousins += more
            up[parent] = due - met
        owed = up


def labelled(rows: DataFrame, targets: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """rows with the leaf they belong to, spelt as in targets; rows of no leaf are left out."""
    keys = [f"__k{i}" for i in range(len(levels))]
    t = F.broadcast(targets.select(*[F.col(c).alias(f"__t{i}") for i, c in enumerate(levels)], *[label_key(F.col(c)).alias(k) for c, k in zip(levels, keys, strict=True)]))  # a row a leaf
    r = rows.select(*[c for c in rows.columns if c not in levels], *[label_key(F.col(c)).alias(k) for c, k in zip(levels, keys, strict=True)])
    return r.join(t, keys).drop(*keys).withColumnsRenamed({f"__t{i}": c for i, c in enumerate(levels)})


def supplied(rows: DataFrame, targets: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """targets with the rows that each leaf has."""
    have = labelled(rows.select(*levels), targets, levels).groupBy(*levels).agg(F.count("*").alias("supply"))
    return targets.join(have, list(levels), "left").withColumn("supply", F.coalesce("supply", F.lit(0).cast("bigint")))


def quotas(supply: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The report: for each leaf target, supply, quota, what of it is unmet, and what it takes
    over from siblings and cousins."""
    named = list(levels)

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        t, columns = pd.concat(parts), [*named, *(x.split()[0] for x in _REPORT.split(", "))]
        n = int(t["sample_rows"].max())
        leaves = [Leaf(tuple(r[c] for c in named), max(float(r["min_rows"]), r["target_share"] * n), int(r["min_rows"]), int(r["supply"])) for r in t.to_dict("records")]
        allocate(leaves, t["target_share"].tolist(), n)
        yield pd.DataFrame([(*x.path, x.target, x.supply, x.quota, x.unmet, x.from_siblings, x.from_cousins) for x in leaves], columns=columns)

    needed = supply.select(*named, "target_share", "min_rows", "sample_rows", "supply").dropna(subset=named).fillna(0, ["target_share", "min_rows", "sample_rows"])
    return needed.repartition(1).mapInPandas(plan, ", ".join(f"{c} string" for c in named) + ", " + _REPORT)  # a row a leaf


def unmet_targets(report: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Leaves of a report whose supply is smaller than their target."""
    return report.filter("supply < target").select(*levels)


def draw(rows: DataFrame, plan: DataFrame, row_id: str, seed: str = SEED, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(levels.., row_id) of the rows drawn. rows carry labels spelt as in plan."""
    plan = plan.select(*levels, F.least("supply", F.col("quota") - F.col("unmet") + F.col("from_siblings") + F.col("from_cousins")).alias("take"))
    r = rows.select(*levels, row_id, F.md5(F.concat(F.lit(seed + "|"), F.col(row_id).cast("string"))).alias("perm")).withColumn("cut", F.expr(_RANGE))
    counts = r.groupBy(*levels, "cut").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*levels).orderBy("cut"))
    # where a quota ends: ranges before that are taken whole
    cuts = counts.withColumn("upto", upto).join(plan, list(levels)).withColumn("before", F.col("upto") - F.col("n")).filter(F.col("before") < F.col("take"))
    r = r.join(cuts.select(*levels, "cut", (F.col("upto") <= F.col("take")).alias("whole"), (F.col("take") - F.col("before")).alias("left")), [*levels, "cut"])
    whole = r.filter("whole").select(*levels, row_id)
    w = Window.partitionBy(*levels).orderBy("perm", row_id)
    edge = r.filter("not whole").withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= F.col("left")).select(*levels, row_id)
    return whole.unionByName(edge)


def proportional_sample(rows: DataFrame, targets: DataFrame, row_id: str, levels: tuple[str, ...] = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(sample, report)."""
    report = quotas(supplied(rows, targets, levels), levels)
    return draw(labelled(rows, targets, levels), report, row_id, levels=levels), report
