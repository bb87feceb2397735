"""Sharding: label propagation under quotas, then exact fill.

Documents of equal text are linked. All members of a group have the same
neighbours, so a group's row says how many of its members lie in each shard,
and a round joins these rows with the shards' quotas instead of listing pairs:
a group's members go to the shard where most of them already lie, as far as
that shard's quota reaches. Documents without links fill the shards at the end
to counts that differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.tables import ranked, saved, text_key

SHARDS = 24
ROUNDS = 12


def _unit(*cols: Column | str) -> Column:
    """A number in [0, 1) drawn by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, n: a + n)


def _loads(state: DataFrame, shards: int) -> list[int]:
    row = state.agg(*[F.sum(F.element_at("counts", s + 1)) for s in range(shards)]).first()
    return [n or 0 for n in row]


def propagate(nodes: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(group, counts): members by shard of each group of two or more of ``nodes`` (group, label).

    A round: each group's goal is the shard with most of its members among
    those whose quota still holds a quarter of the others (crumbs attract no one); members in shards with as many or fewer wish to go
    there. A shard grants wishes with the chance quota / wishes: to whole groups
    by hash where they fit, else to that share of a group's members. It ends
    when no one wishes to move, or after ``rounds``.
    """
    spark = nodes.sparkSession
    quota = -(-nodes.count() // shards)
    counted = nodes.groupBy("group").agg(F.array(*[F.count_if(F.col("label") == s) for s in range(shards)]).alias("counts"))
    # written with the counts: a sum inside the functions below would be taken anew for every shard
    state = saved(counted.withColumn("members", _total(F.col("counts"))).where("members > 1"))
    for turn in range(rounds):
        load = _loads(state, shards)
        room = F.array(*[F.lit(max(0, quota - n)).cast("long") for n in load])
        best = F.array_max(F.transform("counts", lambda n, i: F.struct(
            (F.element_at(room, i + 1) * 4 >= F.col("members") - n).alias("open"), n.alias("n"),
            F.xxhash64("group", i, F.lit(turn)).alias("tie"), i.alias("label"))))
        wish = state.withColumn("best", best).where("best.open").select(
            "group", "members", "counts", F.col("best.label").alias("to"),
            F.transform("counts", lambda n, i: F.when((i != F.col("best.label")) & (n <= F.col("best.n")), n)
                        .otherwise(F.lit(0).cast("long"))).alias("leave"))
        asked = {r["to"]: r["n"] for r in wish.groupBy("to").agg(F.sum(_total(F.col("leave"))).alias("n")).collect() if r["n"]}
        if not asked:
            break
        # a row a shard
        quotas = spark.createDataFrame([(s, max(0, quota - load[s]), min(1.0, max(0, quota - load[s]) / n))
                                        for s, n in asked.items()], "to int, room long, chance double")
        granted = (wish.where(_total(F.col("leave")) > 0).join(F.broadcast(quotas), "to")
                   .withColumn("whole", F.col("members") <= F.col("room"))
                   .withColumn("share", F.when(~F.col("whole"), F.col("chance"))
                               .when(_unit("group", F.lit(turn)) < F.col("chance"), 1.0).otherwise(0.0))
                   .withColumn("gone", F.transform("leave", lambda n: F.floor(n * F.col("share"))))
                   .select(F.col("group").alias("__group"), F.zip_with(
                       F.zip_with("counts", "gone", lambda n, g: n - g), F.sequence(F.lit(0), F.lit(shards - 1)),
                       lambda n, i: n + F.when(i == F.col("to"), _total(F.col("gone"))).otherwise(0)).alias("now")))
        state = saved(state.join(granted, state["group"] == granted["__group"], "left")
                      .select("group", "members", F.coalesce("now", "counts").alias("counts")))
    return state


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, and the columns ``keep``), law ``rows``.

    Adds size (UTF-8 bytes + 8), text_crc32, law, shard, slot (0, 1, .. within
    the shard) and grown_shard (null under this law). Shard counts differ by
    one at most; equal texts share a shard unless it is full. A null text
    counts as an empty one; null ids and repeated rows are rows as others;
    other columns are not read; an empty table gives an empty table.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = saved(docs.select("doc_id", *keep, (F.octet_length(raw) + 8).cast("long").alias("size"),
                             F.crc32(raw).alias("text_crc32"), text_key().alias("group")))
    total = rows.count()
    exact = [total // shards + (s < total % shards) for s in range(shards)]
    placed = ranked(rows, "group", "doc_id", *keep, name="__r")
    # by rank, so that repeated rows too start apart and gather only where there is room
    state = propagate(placed.select("group", F.pmod(F.xxhash64("__r"), F.lit(shards)).alias("label")), shards, rounds)
    load = _loads(state, shards)
    # a member's place among its group decides which of the group's shards it has
    first = placed.groupBy("group").agg(F.min("__r").alias("__first"))
    groups = state.join(first, "group").select(F.col("group").alias("__group"), "__first", "counts")
    upto = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: _total(F.slice("counts", 1, k)))
    inside = F.col("__r") - F.col("__first")
    label = F.size(F.filter(upto, lambda end: end <= inside))
    labelled = (placed.join(groups, placed["group"] == groups["__group"], "left")
                .select("doc_id", *keep, "size", "text_crc32", "group", "__r",
                        F.when(F.col("__group").isNotNull(), label).otherwise(shards).alias("__label")))
    # equal texts stand together within a shard; whoever is beyond its exact count, and all
    # documents without links, fill what is left of the others
    order = ranked(labelled, "__label", "__r", name="__pos")
    kept = [min(n, e) for n, e in zip(load, exact)]
    starts, spare, bounds, seen_load, seen_spare, seen_free = [], [], [], 0, 0, 0
    for s in range(shards):
        starts.append(seen_load)
        spare.append(seen_spare)
        seen_load += load[s]
        seen_spare += load[s] - kept[s]
        seen_free += exact[s] - kept[s]
        bounds.append(seen_free)
    starts.append(seen_load)
    spare.append(seen_spare)

    def at(values: list[int], index: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)).cast("array<long>"), index + 1)

    place = F.col("__pos") - at(starts, F.col("__label"))
    over = place - at([*kept, 0], F.col("__label"))  # 0, 1, .. for those who give way
    queue = at(spare, F.col("__label")) + over
    refuge = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b <= F.col("__queue")))
    return (order.withColumn("__place", place).withColumn("__over", over).withColumn("__queue", queue)
            .withColumn("shard", F.when(F.col("__over") < 0, F.col("__label")).otherwise(refuge).cast("int"))
            .withColumn("slot", F.when(F.col("__over") < 0, F.col("__place")).otherwise(
                at(kept, F.col("shard")) + F.col("__queue") - at([0, *bounds[:-1]], F.col("shard"))))
            .select("doc_id", *keep, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))
