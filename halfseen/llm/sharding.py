"""Shards of equal row counts that keep linked documents together: balanced label propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halfseen.llm.common import gapless_rank, handover, join_back, numbered, query, table

SHARDS, ROUNDS = 40, 30
PER_LEVEL = 50_000             # requests for one shard that a task orders at a time


def pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (index + 1).cast("int"))


def loads(blocks: DataFrame, shards: int) -> list[int]:
    """Documents per shard; one row per shard comes to the driver."""
    held = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [held.get(s, 0) for s in range(shards)]


def propose(blocks: DataFrame, free: list[int], capacity: int) -> DataFrame:
    """(key, shard, n, target): documents of a group that would rather be where more of their neighbours are.

    A group's homes are its largest blocks in shards with room, as many as its open
    documents fill; the other blocks ask for one of them in turn, if it is larger.
    """
    open_ = F.when(pick(free, F.col("shard")) > 0, F.col("n")).otherwise(F.lit(0))
    group = Window.partitionBy("key")
    order = [F.col("n").desc(), F.xxhash64("key", "shard")]
    b = blocks.withColumn("room", open_).withColumn("homes", F.greatest(F.ceil(F.sum("room").over(group) / capacity), F.lit(1)))
    b = b.withColumn("rank", F.when(F.col("room") > 0, F.row_number().over(
        Window.partitionBy("key", F.col("room") > 0).orderBy(*order)) - 1))
    b = b.withColumn("home", F.col("rank") < F.col("homes"))
    home = F.sort_array(F.collect_list(F.when(F.col("home"), F.struct("rank", "shard", "n"))).over(group))      # at most one per shard
    b = b.withColumn("all_homes", home).where("size(all_homes) > 0 and not coalesce(home, false)")
    want = F.element_at("all_homes", (F.pmod(F.xxhash64("key", "shard"), F.size("all_homes")) + 1).cast("int"))
    return b.select("key", "shard", "n", want.alias("to")).where("to.n >= n").select("key", "shard", "n", F.col("to.shard").alias("target"))


def accept(requests: DataFrame, free: list[int]) -> DataFrame:
    """(key, shard, target, m): how many of each request fit the target's quota, small requests first.

    The order within a target is cut into levels of bounded size; a level starts at the sum
    of the levels before it.
    """
    fine = max(1, -(-requests.count() // PER_LEVEL))
    r = requests.withColumn("level", F.floor(F.log2("n")) * fine + F.pmod(F.xxhash64("key", "shard"), F.lit(fine)))
    levels = r.groupBy(F.col("target").alias("t"), F.col("level").alias("l")).agg(F.sum("n").alias("sum"))
    ahead = Window.partitionBy("t").orderBy("l").rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select("t", "l", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("target", "level").orderBy("n", "key", "shard").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    r = r.join(levels, (F.col("target") == F.col("t")) & (F.col("level") == F.col("l")))
    left = pick(free, F.col("target")) - F.col("before") - F.col("within")
    return r.select("key", "shard", "target", F.least(F.col("n"), F.greatest(left, F.lit(0))).alias("m")).where("m > 0")


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: shard counts differ by one at most. Documents with equal texts are linked.
    Linked documents start spread evenly and, round by round, ask to move to the shard
    that holds most of their neighbours; a shard takes as many as its quota leaves room
    for, so a group larger than a shard fills several. The neighbours of a document are
    its whole group, so the state is one row per group and shard with a count, joined and
    aggregated each round, never pairs. Rounds end when nothing moves or after `rounds`
    (counts are even at any time; more rounds only cut fewer links). Documents without
    links then fill every shard to its quota. Slots are gapless per shard.

    Null text counts as empty; empty texts are linked with each other. Null ids and
    repeated rows are placed like others; of equal rows it does not matter which goes
    where. Other columns are not read; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = numbered(docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + 16).cast("long").alias("size"),
                                F.crc32(body).alias("text_crc32"), F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("key")))
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    groups = handover(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    linked = join_back(rows.select("row_no", "key"), groups, "key", "c").select("row_no", "key")
    blocks = handover(gapless_rank(linked, [], [F.col("row_no")], "r").groupBy("key", (F.col("r") % shards).cast("int").alias("shard"))
                      .agg(F.count(F.lit(1)).alias("n")))
    for _ in range(rounds):
        free = [q - n for q, n in zip(quota, loads(blocks, shards))]
        requests = handover(propose(blocks, free, max(quota[0], 1)))
        moved = handover(accept(requests, free))
        if moved.isEmpty():
            break
        changes = (blocks.unionByName(moved.select("key", "shard", (-F.col("m")).alias("n")))
                   .unionByName(moved.select("key", F.col("target").alias("shard"), F.col("m").alias("n"))))
        blocks = handover(changes.groupBy("key", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    places = blocks.groupBy(F.col("key").alias("k")).agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("at"),
                                                          F.sum("n").alias("c")).withColumnRenamed("k", "key")  # one per shard at most
    hot = places.where("c > 100000")                # groups of so many rows are broadcast; there are at most total / 100,000
    cold = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(places.where("c <= 100000"), "key", "left")
    placed = handover(cold.unionByName(rows.join(F.broadcast(hot), "key")).drop("c"))
    lone = gapless_rank(placed.where("at is null").drop("at"), [], [F.col("row_no")], "r")
    need, ends = [q - n for q, n in zip(quota, loads(blocks, shards))], []
    for n in need:
        ends.append((ends[-1] if ends else 0) + n)
    lone = lone.withColumn("shard", F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("r"))))
    whole = placed.where("size(at) = 1").withColumn("shard", F.col("at")[0]["shard"])
    torn = gapless_rank(placed.where("size(at) > 1"), ["key"], [F.col("row_no")], "r")
    step = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("end"), F.lit(-1).alias("shard")), lambda acc, x: F.when(
        (acc["shard"] < 0) & (F.col("r") < acc["end"] + x["n"]), F.struct(acc["end"].alias("end"), x["shard"].alias("shard"))).otherwise(
        F.struct((acc["end"] + x["n"]).alias("end"), acc["shard"].alias("shard"))))
    torn = torn.withColumn("shard", step["shard"])
    cols = ["id", "size", "text_crc32", "shard", "row_no"]
    done = handover(lone.select(*cols).unionByName(whole.select(*cols)).unionByName(torn.select(*cols)))
    return gapless_rank(done, ["shard"], [F.col("row_no")], "slot").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op6_balanced_shards")
def op6_balanced_shards(spark, d):
    return balanced_shards(table(spark, d, "documents"))
