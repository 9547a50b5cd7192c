"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The documents of a source are laid out in shards of some hundred blocks, in seeded order; a shard is cut into blocks of
the same number of words. Blocks go to sources by the highest quotients target / (2 k + 1), then the
same way to the shards of a source. A shard gives all its blocks as often as its quota allows, and of
the rest a run of blocks that begins at a seeded block. As the order is seeded, the run is a random choice, and
only the two documents at its ends are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantseek.llm.scratch import Scratch, named

WEIGHTS = (3, 1, 2)  # by rank of the source, repeating
SHARE = 1.5  # of all words
MOST = 2.0  # times its size that a source gives
BLOCK = 1000  # words of a block at most; fewer if a source has fewer than SHARD_BLOCKS such blocks
SHARD_BLOCKS = 200
BATCH = 4096  # shards that are apportioned together

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size) with weight and target. Sources rank by code point, null last.

    A target is ``min(most * size, weight * level)`` for the one level at which targets add up to the share
    of all words: what is left when the excess over the limits is shared out again until none is above.
    One row for each source passes through; nothing else.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))).cast("int") + 1))
    limit = F.col("source_size") * F.lit(float(most))
    whole = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        free = limit > F.col("weight") * F.lit(level)
        got = ranked.agg(F.sum(F.when(~free, limit).otherwise(0.0)).alias("full"), F.sum(F.when(free, F.col("weight")).otherwise(0)).alias("free")).first()
        if not got["free"]:
            break
        risen = (whole - got["full"]) / got["free"]
        if risen <= level:
            break
        level = risen
    return ranked.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def apportion(rows: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """(group, key, seats): Sainte-Lague by highest quotients within each group; ties go to the smaller key.

    With n keys, V votes and Q seats the last quotient lies between V / (Q + n) and V / (Q - n), so seats below
    ``votes * (Q - n) / V`` are certain and seats above ``votes * (Q + n) / V`` impossible. Only the few between are ranked.
    """
    whole = Window.partitionBy(*group)
    v, n = F.col(votes).cast("double"), F.count("*").over(whole)
    per_vote = F.when(F.sum(v).over(whole) > 0, F.lit(1.0) / F.sum(v).over(whole)).otherwise(0.0)
    sure = F.floor(v * F.greatest(F.col(seats) - n, F.lit(0)) * per_vote + 0.5)
    top = F.floor(v * (F.col(seats) + n) * per_vote + 0.5) + 1
    bounds = rows.select(*group, key, F.col(seats).alias("_seats"), v.alias("_v"), sure.alias("_sure"), F.greatest(top, sure).alias("_top"))
    bounds = bounds.withColumn("_left", F.col("_seats") - F.sum("_sure").over(whole))
    open_seats = bounds.withColumn("_k", F.explode_outer(F.when(F.col("_top") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_top") - 1))))
    place = F.row_number().over(whole.orderBy(F.desc(F.col("_v") / (2 * F.col("_k") + 1)), key, "_k"))
    won = (F.col("_k").isNotNull() & (F.col("_v") > 0) & (place <= F.col("_left"))).cast("long")
    return (open_seats.withColumn("_won", won).groupBy(*group, key)
            .agg((F.first("_sure") + F.sum("_won")).cast("long").alias("seats")))


def mix_sources(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
                block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, copies, spans.

    ``taken`` words are ``copies`` times the whole document and the words ``spans`` (from, to; counted from 0) once
    more. Null and blank texts have size 0 and give nothing; a null source is a source of its own. Rows without
    an id are laid out like others, in the order of a hash of their text. An id that comes twice gives two rows. The
    same rows and seed give the same mix, whatever the partitions. An empty table gives no rows.
    """
    return _laid_out(docs, seed, weights, share, most, block, id_col, text_col, source_col).withColumnsRenamed({"id": id_col, "source": source_col})


def _laid_out(docs: DataFrame, seed: int, weights: tuple[int, ...], share: float, most: float, block: int, id_col: str, text_col: str,
              source_col: str, carry: bool = False) -> DataFrame:
    """``mix_sources`` under the names id and source. With ``carry`` only rows of a size, each with its row of ``docs`` as ``row``.

    A row's words are laid out beside its own text; no join by id, which may be null or come twice, has to find it again.
    """
    scratch = Scratch(docs.sparkSession)
    facts = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie")]
    sized = scratch.write(docs.select(*facts))
    rows = docs.select(*facts, F.struct(*map(named, docs.columns)).alias("row")) if carry else sized
    sources = scratch.write(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
                            .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))))
    totals = sources.where("source_size > 0").agg(F.min("source_size").alias("least"), F.sum("target").alias("target")).first()
    width = max(1, min(block, int(totals["least"] or 0) // SHARD_BLOCKS))
    total = round((totals["target"] or 0.0) / width)

    quota = apportion(sources.withColumn("_all", F.lit(0)).withColumn("_q", F.lit(total)), ["_all"], "rank", "target", "_q")
    shards_of = F.greatest(F.floor(F.col("source_size") / (width * SHARD_BLOCKS)), F.lit(1))
    sources = sources.join(quota.select("rank", "seats"), "rank").withColumn("shards", shards_of)
    few = F.broadcast(sources.select("source", "rank", "source_size", "target", "shards")) if sources.count() <= 10_000 else sources.select("source", "rank", "source_size", "target", "shards")

    def seeded(seed: int) -> Column:
        return F.when(F.col("id").isNull(), F.xxhash64(F.lit(seed), "tie")).otherwise(F.xxhash64(F.lit(seed), "id"))

    def place(rows: DataFrame) -> DataFrame:
        return (rows.join(few, rows["source"].eqNullSafe(few["source"])).drop(few["source"])
                .withColumn("shard", F.pmod(seeded(seed + 1), F.col("shards"))))
    placed = place(rows)

    shards = scratch.write(place(sized).where("size > 0").groupBy("rank", "shard").agg(F.sum("size").alias("shard_size")).withColumn("batch", F.floor(F.col("shard") / BATCH)))
    batches = shards.groupBy("rank", "batch").agg(F.sum("shard_size").alias("batch_size")).join(sources.select("rank", F.col("seats").alias("_q")), "rank")
    by_batch = apportion(batches, ["rank"], "batch", "batch_size", "_q").withColumnRenamed("seats", "_q")
    quotas = apportion(shards.join(by_batch, ["rank", "batch"]), ["rank", "batch"], "shard", "shard_size", "_q")
    blocks = F.ceil(F.col("shard_size") / width)
    quotas = shards.join(quotas, ["rank", "batch", "shard"]).select(
        "rank", "shard", "shard_size", blocks.alias("blocks"), F.least(F.col("seats"), F.floor(blocks * F.lit(most))).alias("quota"))
    quotas = quotas.select(
        "rank", "shard", "shard_size", F.floor(F.col("quota") / F.col("blocks")).alias("copies"), F.pmod("quota", "blocks").alias("rest"),
        "blocks", F.pmod(F.xxhash64(F.lit(seed + 2), "rank", "shard"), "blocks").alias("first"))
    run = F.col("first") + F.col("rest")  # blocks first .. run - 1, from block 0 again after the last
    quotas = quotas.select(
        "rank", "shard", "copies", (F.col("first") * width).alias("from1"),
        F.when(F.col("rest") > 0, F.least(run * width, F.col("shard_size"))).otherwise(F.col("first") * width).alias("to1"),
        F.greatest((run - F.col("blocks")) * width, F.lit(0)).alias("to2"))

    line = Window.partitionBy("rank", "shard").orderBy(seeded(seed), "id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.where("size > 0").withColumn("end", F.sum("size").over(line)).withColumn("begin", F.col("end") - F.col("size"))
    laid = laid.join(quotas, ["rank", "shard"])

    def part(a: Column, b: Column) -> Column:
        return F.struct(F.greatest(a, F.col("begin")).alias("from"), F.least(b, F.col("end")).alias("to"))
    spans = F.filter(F.array(part(F.lit(0).cast("long"), F.col("to2")), part(F.col("from1"), F.col("to1"))), lambda s: s["to"] > s["from"])
    spans = F.transform(spans, lambda s: F.struct((s["from"] - F.col("begin")).alias("from"), (s["to"] - F.col("begin")).alias("to")))
    laid = laid.withColumn("spans", spans)
    extra = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["to"] - s["from"])
    out = laid.select("id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + extra).cast("long").alias("taken"),
                      F.col("copies").cast("long").alias("copies"), "spans", *(["row"] if carry else []))
    if carry:
        return out
    empty = placed.where("size = 0").select("id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"),
                                            F.lit(0).cast("long").alias("copies"),
                                            F.array().cast("array<struct<from:bigint,to:bigint>>").alias("spans"))
    return out.unionByName(empty)


def mixed_documents(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
                    block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy taken, then one whose text is the words of the spans, if any.

    Every row of ``docs`` gives the words that ``mix_sources`` takes of it, with or without an id of its own.
    """
    plan = _laid_out(docs, seed, weights, share, most, block, id_col, text_col, source_col, carry=True).where("taken > 0")
    plan = plan.select("row", F.explode(F.concat(
        F.array_repeat(F.lit(None).cast("array<struct<from:bigint,to:bigint>>"), F.col("copies").cast("int")),
        F.when(F.size("spans") > 0, F.array("spans")).otherwise(F.array().cast("array<array<struct<from:bigint,to:bigint>>>")))).alias("__spans"))
    words = F.regexp_extract_all(F.col("row")[text_col], F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice(words, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), " ")
    mixed = F.when(F.col("__spans").isNull(), F.col("row")[text_col]).otherwise(cut)
    return plan.select(*(mixed.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
