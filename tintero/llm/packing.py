"""Filling containers of fixed capacity by minimum bin slack (problem 7).

Items are counted by length.  For each container the largest remaining item is laid in; then a subset-sum over the
remaining lengths, with one bit per reachable fill, finds the fullest feasible combination, which is taken out, as
often as the counts allow.  Items above the capacity are split into full containers and one rest; nothing else is.

Items are packed in shards of bounded size, drawn by a hash of id, size and the copy's number, so the packing depends on
the items alone, no task sees an unbounded group and each shard wastes at most about its last container.  A shard of one
budget holds ``SHARD_CONTAINERS`` containers' worth of tokens and ``SHARD_ITEMS`` items on average, at most.

Defined cases: items without tokens get no container (null) and take no space; equal lengths are interchangeable, and
ids decide which goes where; null sizes count as 0; repeated ids are items of their own; a capacity below 1 is refused.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SHARD_CONTAINERS = 1_000
SHARD_ITEMS = 5_000
MOST_TASKS = 10_000


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of lengths (with how many of each) that fills ``capacity`` best and holds the largest length."""
    lengths = sorted((x for x in counts if counts[x] and x <= capacity), reverse=True)
    first = lengths[0]
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    goal = 1 << room
    for x in lengths:
        n = min(counts[x] - (x == first), room // x if x else 0)
        k = 1
        while n > 0 and not reach & goal:  # n copies as groups of 1, 2, 4, ...
            take = min(k, n)
            steps.append((x, take, reach))
            reach |= (reach << (x * take)) & mask
            n -= take
            k *= 2
        if reach & goal:
            break
    fill = reach.bit_length() - 1
    chosen: Counter[int] = Counter({first: 1})
    for x, take, before in reversed(steps):
        if not before >> fill & 1:
            chosen[x] += take
            fill -= x * take
    return dict(chosen)


def pack(sizes: list[int], capacity: int) -> list[list[tuple[int, int]]]:
    """Containers as lists of (item's place, tokens); items above the capacity come in parts."""
    if capacity < 1:
        raise ValueError("a container must hold at least one token")
    containers: list[list[tuple[int, int]]] = []
    places: dict[int, list[int]] = defaultdict(list)
    for k, size in enumerate(sizes):
        while size > capacity:
            containers.append([(k, capacity)])
            size -= capacity
        if size > 0:
            places[size].append(k)
    for at in places.values():
        at.reverse()
    counts = {x: len(at) for x, at in places.items()}
    while counts:
        chosen = fullest(counts, capacity)
        for _ in range(min(counts[x] // n for x, n in chosen.items())):
            containers.append([(places[x].pop(), x) for x, n in chosen.items() for _ in range(n)])
        for x in chosen:
            if places[x]:
                counts[x] = len(places[x])
            else:
                del counts[x]
    return containers


_RESULT = "budget_id int, shard int, container int, id long, part int, n_tokens long"


def _pack_shard(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
    budget, shard = int(key[0]), int(key[1])
    items = items.sort_values(["n_tokens", "id", "unnamed"], kind="stable")
    ids = [None if none else i for i, none in zip(items["id"].to_list(), items["unnamed"].to_list(), strict=True)]
    capacity = int(items["capacity"].iloc[0])
    parts: Counter[int] = Counter()
    rows = []
    for c, content in enumerate(pack(items["n_tokens"].to_list(), capacity)):
        for k, n in content:
            rows.append((budget, shard, c, ids[k], parts[k], n))
            parts[k] += 1
    return pd.DataFrame(rows, columns=["budget_id", "shard", "container", "id", "part", "n_tokens"]).astype({"id": "Int64"})


def containers(items: DataFrame, budgets: DataFrame, id_col: str, size_col: str, shard_containers: int = SHARD_CONTAINERS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(budget_id, shard, container, id, part, n_tokens): where every part of every item lies, for each budget.

    ``budgets`` (budget_id, capacity_tokens) is a dimension of a few rows; its size is checked.
    """
    wanted = [(int(r[0]), int(r[1])) for r in budgets.select("budget_id", "capacity_tokens").limit(1001).collect()]
    if len(wanted) > 1000:
        raise ValueError("too many budgets to lay out at once")
    sized = materialize(items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("n_tokens")))
    total, filled = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count_if(F.col("n_tokens") > 0)).first()
    shards = {b: max(1, round(total / c / shard_containers), round(filled / shard_items)) for b, c in wanted}
    plan = F.array(*[F.struct(F.lit(b).alias("budget_id"), F.lit(c).alias("capacity"), F.lit(shards[b]).alias("shards")) for b, c in wanted])
    copies = sized.where("n_tokens > 0").groupBy("id", "n_tokens").agg(F.count(F.lit(1)).alias("m"))
    copies = copies.select("id", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("copy"))
    each = copies.select("id", "n_tokens", "copy", F.explode(plan).alias("p")).select("id", "n_tokens", "copy", "p.*")
    full = each.withColumn("shard", F.pmod(F.xxhash64("id", "n_tokens", "copy"), F.col("shards")).cast("int")).drop("copy", "shards")
    full = full.withColumn("unnamed", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(0)))  # pandas would make the ids floats
    full = full.repartition(min(MOST_TASKS, sum(shards.values())), "budget_id", "shard")
    packed = full.groupBy("budget_id", "shard").applyInPandas(_pack_shard, _RESULT)
    empty = sized.where("n_tokens <= 0").select("id", "n_tokens", F.explode(plan).alias("p")).select("p.budget_id", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("int").alias("container"), "id", F.lit(0).alias("part"), "n_tokens")
    return packed.unionByName(empty)


def fill_summary(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, capacity_tokens, items, tokens, containers, least_containers, unused_share) of a packing.

    ``least_containers`` is the number no packing can go below; a budget without any container has no unused share.
    """
    boxes = packed.where("container IS NOT NULL").groupBy("budget_id", "shard", "container").agg(F.sum("n_tokens").alias("tokens"), F.count_if(F.col("part") == 0).alias("items"))
    sums = boxes.groupBy("budget_id").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("containers"))
    cap, tokens, n = F.col("capacity_tokens"), F.coalesce("tokens", F.lit(0)), F.coalesce("containers", F.lit(0))
    return budgets.select("budget_id", "capacity_tokens").join(sums, "budget_id", "left").select(
        "budget_id", "capacity_tokens", F.coalesce("items", F.lit(0)).alias("items"), tokens.alias("tokens"), n.alias("containers"), F.ceil(tokens / cap).alias("least_containers"), F.when(n > 0, 1 - tokens / (n * cap)).alias("unused_share")
    )
