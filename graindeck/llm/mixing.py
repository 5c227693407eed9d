"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source whose target is r times its size takes every document floor(r) times and one copy more with probability
p = r - floor(r). Those fractions are rounded together: two documents trade expected words (size times p) at random,
neither gaining on average, until one's p is 0 or 1, so the words a source takes stay what they were. Documents are dealt
to blocks of about BLOCK by a hash; a fold over each block leaves at most one fractional document, and those residuals
are folded again, BLOCK at a time, until each source has one, which a last draw rounds. A source therefore takes its
target to within one document's words.

Draws are hashes of the seed and the documents' ids, so reruns agree. Nulls: a null text has size 0; a null source is a
source of its own, last in order; a null id takes its text's hash. Documents of size 0 take no copy of words: copies 0.
Repeated rows are rounded one by one. An empty table gives an empty result. Columns of the input with the names of the
results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, let, table, written

BLOCK = 128
WEIGHTS = (5, 2, 1)
OUT = ("size", "source_size", "target", "copies", "taken")
STATE = "i int, has boolean, at int, h bigint, p double, s double, done array<struct<i:int,up:int>>"


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each source: its size, rank, documents and target. Targets are a water level times the weights, capped."""
    by = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("_source")))
    by = by.withColumn("_rank", rank).withColumn("_w", F.array(*map(F.lit, map(float, weights)))[(F.col("_rank") - 1) % len(weights)])
    cap, all_rows = most * F.col("source_size"), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_full", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("_full", cap / F.col("_w"))
    left = share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    level = left / (F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    by = by.withColumn("_level", level)
    reached = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_rank", "_level"))).over(all_rows)["_level"]
    return by.select("_source", "_rank", "_docs", "source_size", F.least(cap, F.coalesce(reached, F.lit(0.0)) * F.col("_w")).alias("target"))


def drawn(seed: int, *keys: Column) -> Column:
    """A uniform number in [0, 1) from hashed keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)


def folded(items: Column, seed: int) -> Column:
    """items: array of structs with h, s and p. A struct: done (position and 0 or 1), and the one left over (has, at, h, p, s)."""
    start = F.from_json(F.lit('{"i":0,"has":false,"at":0,"h":0,"p":0.0,"s":0.0,"done":[]}'), STATE)

    def state(i, has, at, h, p, s, done) -> Column:
        return F.struct(i.alias("i"), has.alias("has"), at.alias("at"), h.alias("h"), p.alias("p"), s.alias("s"), done.alias("done"))

    def one(i, up) -> Column:
        return F.array(F.struct(i.alias("i"), up.cast("int").alias("up")))

    def step(acc, x) -> Column:
        i, nxt = acc.i, acc.i + 1

        def trade(m) -> Column:
            r_done = F.when(m.to_x, m.a <= m.room_x).otherwise(m.room_r <= m.b)
            x_done = F.when(m.to_x, m.room_x <= m.a).otherwise(m.b <= m.room_r)
            mine = F.when(r_done, one(acc.at, ~m.to_x)).otherwise(F.expr("cast(array() as array<struct<i:int,up:int>>)"))
            theirs = F.when(x_done, one(i, m.to_x)).otherwise(F.expr("cast(array() as array<struct<i:int,up:int>>)"))
            x_p = F.when(m.to_x, m.b + m.a).otherwise(m.b - m.room_r) / x.s
            r_p = F.when(m.to_x, m.a - m.room_x).otherwise(m.a + m.b) / acc.s
            return state(nxt, ~(r_done & x_done), F.when(r_done, i).otherwise(acc.at), F.when(r_done, x.h).otherwise(acc.h), F.when(r_done, x_p).otherwise(r_p), F.when(r_done, x.s).otherwise(acc.s), F.concat(acc.done, mine, theirs))

        a, b = acc.s * acc.p, x.s * x.p
        moves = F.struct(a.alias("a"), b.alias("b"), (acc.s - a).alias("room_r"), (x.s - b).alias("room_x"))
        moves = let(moves, lambda m: F.struct(m.a.alias("a"), m.b.alias("b"), m.room_r.alias("room_r"), m.room_x.alias("room_x"), (drawn(seed, acc.h, x.h) * (F.least(m.a, m.room_x) + F.least(m.room_r, m.b)) < F.least(m.room_r, m.b)).alias("to_x")))
        return (
            F.when((x.p <= 0) | (x.s <= 0), state(nxt, acc.has, acc.at, acc.h, acc.p, acc.s, F.concat(acc.done, one(i, F.lit(0)))))
            .when(~acc.has, state(nxt, F.lit(True), i, x.h, x.p, x.s, acc.done))
            .otherwise(let(moves, trade))
        )

    return F.aggregate(items, start, step)


def mix(df: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, text: str = "text", source: str = "source", key: str = "doc_id", block: int = BLOCK, columns: list[str] | None = None) -> DataFrame:
    """The columns of df (all, or those named) with size, source_size, target, copies and taken (copies times size)."""
    kept = [c for c in columns or df.columns if c not in OUT]
    sized = df.select(F.struct(*kept).alias("_row"), F.col(source).alias("_source"), F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long").alias("_size"), F.when(F.col(key).isNotNull(), F.xxhash64(F.lit(seed), key)).otherwise(F.xxhash64(F.lit(seed), text)).alias("_h"))
    targets = written(source_targets(sized.select("_source", "_size"), weights, share, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.ceil(F.col("_docs") / block)
    joined = sized.join(targets, sized["_source"].eqNullSafe(targets["_source"])).select("_row", "_rank", "_size", "_h", "source_size", "target", ratio.alias("_r"), F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), blocks).alias("_block"))
    most_docs = targets.agg(F.max("_docs")).first()[0] or 0

    def in_blocks(rows: DataFrame, *carried: str) -> DataFrame:
        item = F.struct(F.col("_h").alias("h"), F.col("_s").alias("s"), F.col("_p").alias("p"), *carried)
        # the key is a hash, so that a join's partitioning by source isn't taken for one by block
        return rows.groupBy(F.xxhash64("_rank", "_block").alias("_key"), F.col("_rank").alias("_rank_"), F.col("_block").alias("_block_")).agg(F.sort_array(F.collect_list(item)).alias("items")).withColumn("fold", folded(F.col("items"), seed))

    first = joined.withColumns({"_s": F.col("_size").cast("double"), "_p": F.when(F.col("_size") > 0, F.col("_r") - F.floor("_r")).otherwise(0.0)})
    levels, n = [], most_docs
    rows = first.select("_rank", "_block", "_h", "_s", "_p")
    while True:
        n = -(-n // block)
        left = in_blocks(rows).where("fold.has").select("_rank_", "_block_", "fold.at", "fold.h", "fold.p", "fold.s")
        level = written(left, "residuals")
        levels.append(level)
        if n <= 1:
            break
        rows = level.select(F.col("_rank_").alias("_rank"), F.floor(F.col("_block_") / block).alias("_block"), F.col("h").alias("_h"), F.col("s").alias("_s"), F.col("p").alias("_p"), F.col("_block_").alias("_child"))
    # downwards: what the level above decides for each block's residual
    decided = levels[-1].select("_rank_", "_block_", (drawn(seed, F.lit("last"), F.col("h")) < F.col("p")).cast("int").alias("up"))
    for below in reversed(levels[:-1]):
        rows = below.select(F.col("_rank_").alias("_rank"), F.floor(F.col("_block_") / block).alias("_block"), F.col("h").alias("_h"), F.col("s").alias("_s"), F.col("p").alias("_p"), F.col("_block_").alias("_child"))
        up = in_blocks(rows, "_child").join(decided, ["_rank_", "_block_"], "left")
        decided = settled(up).select("_rank_", F.col("item._child").alias("_block_"), "up")
    rounded = settled(in_blocks(first, "_row", "_size", "source_size", "target", "_r").join(decided, ["_rank_", "_block_"], "left"))
    copies = F.when(F.col("item._size") > 0, F.floor("item._r").cast("int") + F.col("up")).otherwise(0)
    out = rounded.select(*(F.col(f"item._row.{c}").alias(c) for c in kept), F.col("item._size").alias("size"), F.col("item.source_size"), F.col("item.target"), copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def settled(up: DataFrame) -> DataFrame:
    """One row for each item of a block, with 0 or 1; the block's residual takes what was decided above."""
    last = F.when(F.col("fold.has"), F.array(F.struct(F.col("fold.at").alias("i"), F.coalesce("up", F.lit(0)).alias("up")))).otherwise(F.expr("cast(array() as array<struct<i:int,up:int>>)"))
    return up.select("_rank_", F.explode(F.arrays_zip(F.col("items").alias("item"), F.sort_array(F.concat("fold.done", last)).alias("d"))).alias("z")).select("_rank_", F.col("z.item").alias("item"), F.col("z.d.up").alias("up"))


def op2(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), columns=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies")
