"""Sharding by balanced label propagation.

Documents that share a hub (here: equal texts) are linked.  Every document
starts in the shard its id hashes to, and a hub's members are counted per
shard.  Hubs move whole.  In a round every hub wishes for a shard that has
room for all of it: its largest one, in later rounds or where none of its
shards has room a shard drawn by room.  Wishes are summed per shard, size
class and lot (a hash of the hub), and lots that fit the room are granted,
large classes first; when none fits, the largest hubs are granted one by
one.  Rounds end when no wish is left: then fewer hubs than shards remain,
each larger than any room.  These, and before all others the hubs larger
than a shard, are dealt by rank over as few shards as the room allows.

Quotas are exact: counts differ by one at most.  All documents are
range-sorted once by (shard, linked first, hub); what stands beyond a
shard's quota (unlinked documents first) fills the shards that have places
left, found by arithmetic on the place; linked documents never do.

Defined results
---------------
* null text: size 1, equal to the empty text.
* rows without an id and repeated rows are dealt like others, each to a
  place of its own.
* an empty table gives an empty result; other columns are ignored; with
  fewer documents than shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import class_offsets, empty_if_null, with_position, write_table

LOTS = 64
ONE_BY_ONE = 4096  # hubs that the driver grants at a time when no lot fits


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (index + 1).cast("int"))


def _spread(n: int, room: list[int]) -> list[tuple[int, int]]:
    """``(shard, rows)`` for a hub of ``n`` rows, largest rooms first, the
    rest in the smallest room that holds it; takes the room."""
    parts = []
    while n:
        fit = [s for s, r in enumerate(room) if r >= n]
        s = min(fit, key=lambda k: room[k]) if fit else max(range(len(room)), key=lambda k: room[k])
        take = min(n, room[s])
        room[s] -= take
        n -= take
        parts.append((s, take))
    return parts


def _wish(room: list[int], step: int) -> Column:
    """The shard that a hub asks for, null when none has room for it."""
    rooms = F.array(*[F.lit(r).cast("long") for r in room])
    liked = F.get(F.filter("members", lambda m: F.get(rooms, m["shard"]) >= F.col("n")), F.lit(0))["shard"]
    fits = F.transform(rooms, lambda r: F.when(r >= F.col("n"), r).otherwise(0))
    total = F.aggregate(fits, F.lit(0).cast("long"), lambda a, r: a + r)
    # The first shard at which the running room exceeds a hash of the hub.
    start = F.struct(
        F.pmod(F.xxhash64("hub", F.lit(step)), F.greatest(total, F.lit(1))).alias("left"),
        F.lit(-1).alias("at"), F.lit(0).alias("k"))
    drawn = F.aggregate(fits, start, lambda a, r: F.struct(
        (a["left"] - r).alias("left"),
        F.when((a["at"] < 0) & (a["left"] < r), a["k"]).otherwise(a["at"]).alias("at"),
        (a["k"] + 1).alias("k")), lambda a: a["at"])
    drawn = F.when(total > 0, drawn)
    return F.coalesce(liked, drawn) if step < 2 else drawn


def settle(hubs: DataFrame, quotas: list[int]) -> tuple[DataFrame, list[tuple]]:
    """``hubs``: a written table of ``hub, n, members``.  The ``hub, shard``
    of those that stay whole, and ``(hub, parts)`` of the others (fewer than
    twice the shards)."""
    spark = hubs.sparkSession
    room, most = list(quotas), max(quotas)
    large = hubs.where(F.col("n") > most).orderBy(F.desc("n"), "hub").collect()
    split = [(r["hub"], _spread(r["n"], room)) for r in large]
    rest, step = hubs.where(F.col("n") <= most), 0
    whole = spark.createDataFrame([], "hub binary, shard int")
    while True:
        wishes = write_table(
            rest.select(
                "hub", "n", "members", _wish(room, step).alias("to"), F.floor(F.log2("n")).cast("int").alias("class"),
                F.pmod(F.xxhash64("hub", F.lit(-1 - step)), F.lit(LOTS)).cast("int").alias("lot")), "shard-wishes")
        asking = wishes.where("to IS NOT NULL")
        asked = asking.groupBy("to", "class", "lot").agg(F.sum("n").alias("n")).collect()
        if not asked:
            break
        granted = []
        for r in sorted(asked, key=lambda r: (r["to"], -r["class"], r["lot"])):
            if r["n"] <= room[r["to"]]:
                room[r["to"]] -= r["n"]
                granted.append((r["to"], r["class"], r["lot"]))
        if granted:
            lots = F.broadcast(spark.createDataFrame(granted, "to int, class int, lot int"))
            moved = asking.join(lots, ["to", "class", "lot"]).select("hub", F.col("to").alias("shard"))
            rest = wishes.join(lots, ["to", "class", "lot"], "left_anti")
        else:
            given = []
            for r in asking.orderBy(F.desc("n"), "hub").limit(ONE_BY_ONE).select("hub", "n", "to").collect():
                s = r["to"] if room[r["to"]] >= r["n"] else max(range(len(room)), key=lambda k: room[k])
                if room[s] >= r["n"]:
                    room[s] -= r["n"]
                    given.append((r["hub"], s))
            moved = spark.createDataFrame(given, "hub binary, shard int")
            rest = wishes.join(F.broadcast(moved), "hub", "left_anti")
        whole = whole.unionByName(moved)
        step += 1
    left = wishes.orderBy(F.desc("n"), "hub").select("hub", "n").collect()
    return whole, split + [(r["hub"], _spread(r["n"], room)) for r in left]


def _dealt_by_rank(nodes: DataFrame, split: list[tuple]) -> DataFrame:
    """``row, shard`` of the split hubs' documents."""
    spark = nodes.sparkSession
    keys = F.broadcast(spark.createDataFrame([(h, k) for k, (h, _) in enumerate(split)], "hub binary, k int"))
    placed = with_position(nodes.join(keys, "hub").select("k", "row"), ["k", "row"], "shard-split")
    base, seen = [], {}
    for k, part, lowest, n in class_offsets(placed, "k"):
        ends, end = [], 0
        for _, take in split[k][1]:
            end += take
            ends.append(end)
        base.append((k, part, seen.get(k, 0) - lowest, ends, [s for s, _ in split[k][1]]))
        seen[k] = seen.get(k, 0) + n
    base = F.broadcast(spark.createDataFrame(base, "k int, _part int, base long, ends array<long>, to array<int>"))
    rank = F.col("_idx") + F.col("base")
    return placed.join(base, ["k", "_part"]).select(
        "row", F.get("to", F.size(F.filter("ends", lambda e: e <= rank))).alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size`` (UTF-8 bytes plus one),
    ``text_crc32, law`` (``rows``), ``shard, slot, grown_shard`` (null under
    this law) and ``hub`` (hex hash of the text)."""
    text = empty_if_null(F.col(text_col))
    nodes = write_table(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("hub"))
        .withColumn("row", F.monotonically_increasing_id()), "shard-nodes")
    total = nodes.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]

    first = F.pmod(F.xxhash64("doc_id", "hub"), F.lit(shards)).cast("int")
    # At most one row per hub and shard; the largest shard first.
    tally = nodes.groupBy("hub", first.alias("shard")).agg(F.count(F.lit(1)).alias("c"))
    members = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("less"), "shard")))
    hubs = write_table(
        tally.groupBy("hub").agg(F.sum("c").alias("n"), members.alias("members")).where("n > 1"), "shard-hubs")
    whole, split = settle(hubs, quotas)
    linked = nodes.join(write_table(whole, "shard-whole"), "hub").select("row", "shard")
    if split:
        linked = linked.unionByName(_dealt_by_rank(nodes, split))
    linked = write_table(linked, "shard-state")

    dealt = nodes.join(linked.select("row", F.col("shard").alias("moved")), "row", "left").select(
        "doc_id", "size", "text_crc32", "hub", "row",
        F.coalesce("moved", first).alias("home"), F.col("moved").isNull().alias("alone"))
    placed = with_position(dealt, ["home", "alone", "hub", "row"], "shard-placed")

    spark = docs.sparkSession
    offsets, count = [], [0] * shards
    for home, part, lowest, n in class_offsets(placed, "home"):
        offsets.append((home, part, count[home] - lowest))
        count[home] += n
    kept = [min(c, q) for c, q in zip(count, quotas)]
    over, place, over_from, place_from, place_to = 0, 0, [], [], []
    for s in range(shards):
        over_from.append(over)
        over += count[s] - kept[s]
        place_from.append(place)
        place += quotas[s] - kept[s]
        place_to.append(place)

    # At most (shards + ranges) rows.
    base = F.broadcast(spark.createDataFrame(offsets, "home int, _part int, base long"))
    rank = F.col("_idx") + F.col("base")
    spare = F.col("rank") - _pick(quotas, F.col("home")) + _pick(over_from, F.col("home"))
    ends = F.array(*[F.lit(e).cast("long") for e in place_to])
    other = F.size(F.filter(ends, lambda e: e <= F.col("spare")))
    stays = F.col("rank") < _pick(quotas, F.col("home"))
    return (
        placed.join(base, ["home", "_part"])
        .withColumn("rank", rank).withColumn("spare", spare)
        .withColumn("shard", F.when(stays, F.col("home")).otherwise(other).cast("int"))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            F.when(stays, F.col("rank"))
            .otherwise(_pick(kept, F.col("shard")) + F.col("spare") - _pick(place_from, F.col("shard")))
            .cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), F.lower(F.hex("hub")).alias("hub"))
    )
