"""Fill containers of fixed capacity with documents.

Documents are routed by size to tiers of a container's window: more than a half, a quarter,
an eighth of it, and the rest. Tiers are packed one after the other, the longest first: a
container of a tier is filled with documents of the tier as well as they go together, then the
gap that is left with documents of the shorter tiers, at each step the one document or the two
that fill it best. What a shorter tier gave to gaps isn't there when its turn comes. All this
is decided on the histogram of sizes, of which there are at most as many as the capacity has
units, so packing takes the same time for any number of documents: its result are patterns of
sizes with the number of containers filled alike. Documents are then numbered within their
size in parallel and looked up in the patterns. Numbering is done by parts of a size, so a
size that a third of all documents share is no single task. Containers in order of tier and
tokens are dealt to step groups forth and back, which gives each the same mix of windows and
nearly the same tokens.

Defined results: documents with null or empty text, or of size 0, are in no container; one
larger than the capacity is split into full pieces and a rest, no other is split; repeated
rows are documents of their own; an empty table needs no containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.session import cut

#: Tiers of a window: the share of the capacity above which a size belongs to each.
TIERS = (1 / 2, 1 / 4, 1 / 8, 0.0)
#: Containers in a step group.
STEP = 64
#: Rows of a size that one task numbers, about.
PART_ROWS = 200_000
#: Capacities at most; each is a task of its own.
CAPACITIES = 1000


def tier_of(size: int, capacity: int) -> int:
    return next(i for i, share in enumerate(TIERS) if size > share * capacity)


class Stock:
    """Sizes that are left, with their numbers. Which ones are there is an integer with a bit
    for each size, and one with the bits the other way round: all pairs of a sum show at once
    where the two, one of them shifted, agree."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left, self.capacity = dict(counts), capacity
        self.there = sum(1 << s for s in counts)
        self.back = sum(1 << (capacity - s) for s in counts)

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.there &= ~(1 << size)
            self.back &= ~(1 << (self.capacity - size))

    def best(self, room: int, used: dict[int, int]) -> tuple[int, ...]:
        """The size, or the two, that fill a room best; sizes are used up by `used`."""
        there, back = self.there, self.back
        for s, n in used.items():
            if self.left.get(s, 0) == n:
                there &= ~(1 << s)
                back &= ~(1 << (self.capacity - s))
        single = (there & ((1 << (room + 1)) - 1)).bit_length() - 1
        if single <= 0:
            return ()
        for total in range(room, single, -1):
            pairs = there & (back >> (self.capacity - total))
            if not total % 2 and pairs >> (total // 2) & 1 and self.left[total // 2] - used.get(total // 2, 0) < 2:
                pairs &= ~(1 << (total // 2))
            if pairs:
                a = pairs.bit_length() - 1
                return (a, total - a)
        return (single,)


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...], int]]:
    """[(tier, ((size, times), ...), containers), ...]: how containers are filled, by tier."""
    routed: list[dict[int, int]] = [{} for _ in TIERS]
    for size, n in counts.items():
        if n > 0:
            routed[tier_of(size, capacity)][size] = n
    out = []
    shorter = Stock({s: n for t in routed for s, n in t.items()}, capacity)
    for tier in range(len(TIERS)):
        own = Stock({s: n for s, n in shorter.left.items() if tier_of(s, capacity) == tier}, capacity)
        for s, n in own.left.items():
            shorter.take(s, n)
        while own.left:
            items: dict[int, int] = {}
            room = capacity
            for stock in (own, shorter):  # the tier first, then what fills its gap
                used: dict[int, int] = {}
                first = (max(own.left),) if stock is own else ()
                while sizes := first or stock.best(room, used):
                    first = ()
                    for s in sizes:
                        used[s] = used.get(s, 0) + 1
                        room -= s
                items.update(used)
            times = min((own if s in own.left else shorter).left[s] // n for s, n in items.items())
            out.append((tier, tuple(sorted(items.items(), reverse=True)), times))
            for s, n in items.items():
                (own if s in own.left else shorter).take(s, n * times)
    return out


def pieces_of(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, capacity, doc_id, piece_no, size): documents for each capacity, those
    larger than it in pieces."""
    tasks = capacities.filter("capacity_tokens > 0").select("capacity_id", "capacity_tokens").take(CAPACITIES + 1)
    if len(tasks) > CAPACITIES:
        raise ValueError(f"more than {CAPACITIES} capacities")
    each = F.array(*[F.struct(F.lit(r[0]).cast("int").alias("capacity_id"), F.lit(r[1]).cast("bigint").alias("capacity")) for r in tasks]).cast("array<struct<capacity_id:int,capacity:bigint>>")
    d = sizes.filter("n_tokens > 0").select("doc_id", "n_tokens", F.explode(each).alias("c")).select("doc_id", "n_tokens", "c.*")
    n = F.ceil(F.col("n_tokens") / F.col("capacity"))
    d = d.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    size = F.least("capacity", F.col("n_tokens") - F.col("piece_no") * F.col("capacity"))
    return d.select("capacity_id", "capacity", "doc_id", F.col("piece_no").cast("int").alias("piece_no"), size.alias("size"))


def group_of(container: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Step groups of containers in order, dealt forth and back."""
    turn, at = container // groups, container % groups
    return np.where(turn % 2 == 0, at, groups - 1 - at)


def plan_slots(hist: list[tuple[int, int, int, int]]) -> dict[str, np.ndarray]:
    """Slots in containers, ordered by capacity and size, as arrays; hist: (capacity_id,
    capacity, size, documents)."""
    slots: list[tuple[int, int, int, int, int, int, int]] = []
    groups: dict[int, int] = {}
    by: dict[int, tuple[int, dict[int, int]]] = {}
    for cid, cap, size, n in hist:
        by.setdefault(cid, (cap, {}))[1][size] = n
    for cid, (cap, counts) in by.items():
        base = 0
        patterns = sorted(pack_histogram(counts, cap), key=lambda p: (p[0], -sum(s * n for s, n in p[1]), p[1]))
        for tier, items, times in patterns:
            for size, n in items:
                slots.append((cid, size, base, times, n, tier, n * times))
            base += times
        groups[cid] = max(1, -(-base // STEP))
    slots.sort()
    columns = np.array(slots, np.int64).reshape(-1, 7).T
    starts = np.concatenate(([0], np.cumsum(columns[6])))[:-1] if len(slots) else np.zeros(0, np.int64)
    first: dict[tuple[int, int], int] = {}
    for (cid, size, *_), at in zip(slots, starts.tolist(), strict=True):
        first.setdefault((cid, size), at)
    return {"base": columns[2], "times": columns[3], "tier": columns[5], "starts": starts, "first": first, "groups": groups}


def pack(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, container_id, step_group, tier, doc_id, piece_no, n_tokens) of every
    piece. sizes: (doc_id, n_tokens)."""
    pieces = cut(pieces_of(sizes, capacities))
    spark = pieces.sparkSession
    # at most capacity rows for each capacity
    hist = [tuple(r) for r in pieces.groupBy("capacity_id", "capacity", "size").agg(F.count("*").alias("n")).collect()]
    parts = max(8, sum(r[3] for r in hist) // PART_ROWS)
    p = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts)))
    counts = p.groupBy("capacity_id", "size", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("capacity_id", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("capacity_id", "size", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("capacity_id", "size", "part").orderBy("doc_id", "piece_no")) - 1
    ranked = p.withColumn("own", own).join(before, ["capacity_id", "size", "part"]).select("capacity_id", "doc_id", "piece_no", "size", (F.col("before") + F.col("own")).alias("rank"))
    shared = spark.sparkContext.broadcast(plan_slots(hist))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            cid, size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("capacity_id", "size", "rank"))
            pairs, inverse = np.unique(np.stack([cid, size]), axis=1, return_inverse=True)
            first = np.array([s["first"][(int(a), int(b))] for a, b in pairs.T], np.int64)
            at = (first[inverse.reshape(-1)] if len(first) else np.zeros(0, np.int64)) + rank
            k = np.searchsorted(s["starts"], at, "right") - 1
            container = s["base"][k] + (at - s["starts"][k]) % s["times"][k]
            groups = np.array([s["groups"][int(c)] for c in cid], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(container), pa.array(group_of(container, groups) if len(groups) else groups), pa.array(s["tier"][k].astype(np.int32)), batch.column(1), batch.column(2), batch.column(3)],
                ["capacity_id", "container_id", "step_group", "tier", "doc_id", "piece_no", "n_tokens"],
            )

    return ranked.mapInArrow(place, "capacity_id int, container_id long, step_group long, tier int, doc_id long, piece_no int, n_tokens long")


def report(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """For each capacity: containers, tokens, room left, and the fewest containers that any
    packing needs."""
    used = placed.groupBy("capacity_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    r = used.join(F.broadcast(capacities), "capacity_id")  # a row for each task
    return r.select("capacity_id", "containers", "tokens", (F.col("containers") * F.col("capacity_tokens") - F.col("tokens")).alias("room_left"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"))
