"""Sharding by balanced label propagation.

Documents with equal texts are linked.  Every document starts in the shard that a hash of its id names; in each round
linked documents move to the shard that holds most of their neighbours, as far as the shards' quotas allow: a move is
let through where another goes the opposite way or the shard it goes to has room.  When that shard is full, they move
to the one that holds most of them among those with room.  A move always joins a smaller cell to a larger one, so cut
links become fewer each round, and rounds go on until they don't.  Documents without a link then fill
what the quotas leave, which makes the counts exact.

Neighbours of one text that are in the same shard are alike, so the rounds work on cells (text, shard, number): a text
that a third of all documents share is at most as many rows as there are shards.  Law: ``rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh
from .ranks import ranked

def unit_hash(*cols: Column) -> Column:
    """0 to 1, from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def _chain(cases: list[tuple[Column, Column]], default: Column) -> Column:
    out = default
    for when, value in reversed(cases):
        out = F.when(when, value).otherwise(out)
    return out


def propagate(cells: DataFrame, quota: list[int]) -> DataFrame:
    """Cells (g, shard, n) after the rounds, each a join of the cells with their text's fullest shard: of all, or (when
    that makes no more progress) of those with room."""
    shards = range(len(quota))
    cells = fresh(cells)
    only_room, idle, joined, r = False, 0, 0, 0
    asked: set[int] = set()
    closed: set[int] = set()  # have room for less than a round's moves can be rounded to
    while idle < 2:
        totals = {row["shard"]: row for row in cells.groupBy("shard").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("joined")).collect()}
        load = {s: totals[s]["n"] if s in totals else 0 for s in shards}
        if (now := sum(row["joined"] for row in totals.values())) > joined:
            idle, joined = 0, now
        elif only_room and asked:
            closed |= asked
        elif r:
            idle, only_room = idle + 1, not only_room
        r += 1
        targets = [s for s in shards if load[s] < quota[s] and s not in closed] if only_room else [*shards]
        # ties go by a hash, so that equal cells don't all wish for one shard
        rank = F.struct("n", F.xxhash64("g", "shard").alias("o"))
        best = cells.where(F.col("shard").isin(targets)).groupBy("g").agg(F.max(F.struct(rank.alias("rank"), F.col("shard").alias("to"))).alias("best")).select("g", "best.rank", "best.to")
        to = F.when(rank < F.col("rank"), F.col("to")).otherwise(F.col("shard"))
        wished = fresh(cells.join(best, "g", "left").select("g", "shard", "n", to.alias("to")))
        wish = {(row["shard"], row["to"]): row["n"] for row in wished.where("shard <> to").groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}  # shards squared at most
        asked = {b for _, b in wish}
        ratio = {}
        for (a, b), n in wish.items():
            room = max(0, quota[b] - load[b])
            wanted = sum(m for (_, c), m in wish.items() if c == b)
            ratio[a, b] = min(1.0, (min(n, wish.get((b, a), 0)) + room * n / wanted) / n)
        if max(ratio.values(), default=0) == 0:
            continue
        share = _chain([((F.col("shard") == a) & (F.col("to") == b), F.lit(x)) for (a, b), x in sorted(ratio.items())], F.lit(0.0))
        moved = F.least("n", F.floor(F.col("n") * share + F.when(share * F.col("n") < 1, unit_hash(F.col("g"), F.col("shard"), F.lit(r)) * share * F.col("n")).otherwise(0.0)))
        after = wished.withColumn("_m", moved).select("g", F.explode(F.array(F.struct("shard", (F.col("n") - F.col("_m")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("_m").alias("n")))).alias("x"))
        cells = fresh(after.where("x.n > 0").groupBy("g", F.col("x.shard").alias("shard")).agg(F.sum("x.n").alias("n")))
    return cells


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per input row, counts of the shards at most
    one apart.

    A null text has size 1 and the checksum of nothing and is linked with nothing; equal texts, empty ones too, are
    linked.  Repeated rows and null ids are documents like any other.  An empty table gives no rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = durable(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.when(F.col("text").isNotNull(), F.md5(F.col("text").cast("binary"))).alias("g")))
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    order = ["doc_id", "size", "text_crc32"]

    first = F.pmod(F.xxhash64("doc_id", "g"), F.lit(shards)).cast("int")
    groups = base.where(F.col("g").isNotNull()).groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    counted = base.groupBy("g", first.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    cells = propagate(counted.join(groups, "g"), quota)

    # of each linked text, the documents in order take its cells' shards
    cumulated = cells.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("_cells"))
    linked = ranked(base.join(groups, "g", "left_semi"), ["g"], order, total, "_r", extra=cumulated)
    step = lambda a, x: F.struct((a["left"] - x["n"]).alias("left"), F.when((a["left"] >= 0) & (a["left"] < x["n"]), x["shard"]).otherwise(a["shard"]).alias("shard"))
    placed = durable(linked.select(*order, F.aggregate("_cells", F.struct(F.col("_r").alias("left"), F.lit(None).cast("int").alias("shard")), step, lambda a: a["shard"]).alias("shard")))

    # what is over a quota (rounding of the start) joins the documents without a link; both fill what is left
    over = ranked(placed, ["shard"], order, total, "_p")
    within = _chain([(F.col("shard") == s, F.lit(q)) for s, q in enumerate(quota)], F.lit(0))
    over = over.withColumn("_fits", F.col("_p") < within)
    kept = over.where("_fits").select(*order, "shard")
    full = dict.fromkeys(range(shards), 0) | {r["shard"]: min(r["n"], quota[r["shard"]]) for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    single = base.join(groups, "g", "left_anti").select(*order).unionByName(over.where(~F.col("_fits")).select(*order))
    filled, cases = 0, []
    for s in range(shards):
        filled += quota[s] - full[s]
        cases.append((F.col("_f") < filled, F.lit(s)))
    filler = ranked(single, [], order, total, "_f").select(*order, _chain(cases, F.lit(shards - 1)).alias("shard"))

    every = ranked(kept.unionByName(filler), ["shard"], order, total, "slot")
    return every.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
