"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source's documents stand in a queue in shuffled order (the digest of a seed and the id). A document leaves the queue at
its virtual finish time: the words its source has sent up to and including it, divided by the source's target. Further
rounds of the queue follow while the target asks for repeats. All departures of all sources, in the order of their virtual
finish times, are the mix; it ends where the budget is spent, inside a document if need be.

Nothing is gathered by source: running sums are taken in two steps, over slices of the shuffled order (a hot source has
4,096 of them) and then inside each slice. The point where the mix ends is looked for in a histogram of finish times and
then in the one slice that holds it.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null id shuffles as the empty text.
Repeated rows count each. Rows of equal id and size are interchangeable. Documents of size 0 are returned with 0 words
taken. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchfloor.llm.common import checkpointed, named

WORD = r"[^\x20\x09-\x0D]+"
SLICE_DIGITS = 3  # hexadecimal digits of the shuffle key that name a slice
TIME_SLICES = 4096  # slices of a unit of virtual time


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    rows = named(docs, doc_id=id_col, text=text_col, source=source_col)
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return rows.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """One row per source: size, weight and target. The shares of capped sources are poured over the rest until the level
    fits: sources are filled in the order of cap / weight, and the level is the highest that respects every cap."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    filled = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    level = (share * F.col("total") - filled) / F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    return (
        sources.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
        .select(
            "source",
            "source_size",
            "weight",
            F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")).alias("target"),
        )
    )


def queued(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document with the words its source has sent when it leaves the queue for the first time (``sent``)."""
    part = F.substring("key", 1, SLICE_DIGITS)
    rows = sizes.withColumn("part", part)
    slices = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    order = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("part_size").over(order), F.lit(0)))
    slices = slices.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("part_source"), F.col("part").alias("part_name"), "before", "source_size", "target"
    )
    inside = W.partitionBy("source", "part").orderBy("key", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    running = rows.withColumn("within", F.sum("size").over(inside))
    matches = F.col("source").eqNullSafe(F.col("part_source")) & (F.col("part") == F.col("part_name"))
    return running.join(slices, matches).select(
        "doc_id", "size", "source_size", "target", "key", "row", (F.col("before") + F.col("within")).alias("sent")
    )


def finish_time(turn: int) -> Column:
    return F.when(F.col("target") > 0, (F.col("sent") + turn * F.col("source_size")) / F.col("target"))


def departures(queue: DataFrame, repeats: int) -> DataFrame:
    """One row for each time a document may leave its queue."""
    turns = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), finish_time(t).alias("time")) for t in range(repeats)]))
    rows = queue.filter("size > 0 AND target > 0").select("size", "key", "row", turns.alias("d")).select("size", "key", "row", "d.*")
    return rows.withColumn("part", F.floor(F.col("time") * TIME_SLICES))


def end_of_mix(queue: DataFrame, budget: int, repeats: int) -> tuple | None:
    """(time, turn, key, row, words) of the first departure that the budget does not pay in full; ``words`` is what is
    left for it. None if the budget pays for all. Two single rows come to the driver."""
    rows = departures(queue, repeats)
    parts = rows.groupBy("part").agg(F.sum("size").alias("part_size"))
    upto = F.sum("part_size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    last = parts.withColumn("upto", upto).filter(F.col("upto") > budget).orderBy("part").first()
    if last is None:
        return None
    left = budget - (last.upto - last.part_size)
    order = W.partitionBy("part").orderBy("time", "turn", "key", "row").rowsBetween(W.unboundedPreceding, 0)
    there = rows.filter(F.col("part") == last.part).withColumn("upto", F.sum("size").over(order))
    cut = there.filter(F.col("upto") > left).orderBy("time", "turn", "key", "row").first()
    return cut.time, cut.turn, cut.key, cut.row, left - (cut.upto - cut["size"])


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "mix-1:",
) -> DataFrame:
    """doc_id, size, source_size, target, taken, row for each document.

    Sources in code-point order, nulls last, take the weights in turn. The budget is ``share`` times the words of all
    documents; no source is asked for more than ``repeats`` times its words.
    """
    sizes = checkpointed(sized(docs, id_col, text_col, source_col, seed))
    queue = checkpointed(queued(sizes, source_targets(sizes, weights, share, repeats)))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cut = end_of_mix(queue, int(share * total), repeats)
    if cut is None:
        taken = F.when(F.col("target") > 0, F.col("size") * repeats).otherwise(0)
    else:
        time, turn, key, row, words = cut
        end = F.struct(F.lit(time), F.lit(turn), F.lit(key), F.lit(row).cast("long"))
        taken = F.lit(0).cast("long")
        for t in range(repeats):
            mine = F.struct(finish_time(t), F.lit(t), F.col("key"), F.col("row"))
            one = F.when(finish_time(t).isNull(), 0).when(mine < end, F.col("size")).when(mine == end, F.lit(words)).otherwise(0)
            taken = taken + one
    return queue.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "row")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row for each whole copy taken. The one document in which the
    budget ends gives its first words, with single spaces between them. Documents of which nothing is taken go.

    Decisions return to their documents by id and size, and by their place among rows that share both where there are any.
    """
    taken = mix_sources(docs, id_col, text_col, source_col, **options)
    part = taken.select(F.col("doc_id").alias("taken_id"), F.col("size").alias("taken_size"), "taken", "row")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("words"),
    )
    same = F.col("id").eqNullSafe(F.col("taken_id")) & (F.col("words") == F.col("taken_size"))
    if not part.groupBy("taken_id", "taken_size").count().filter("count > 1").isEmpty():
        part = part.withColumn("nth_taken", F.row_number().over(W.partitionBy("taken_id", "taken_size").orderBy(F.desc("taken"), "row")))
        rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("id", "words").orderBy("text")))
        same &= F.col("nth") == F.col("nth_taken")
    part = part.filter("taken > 0")
    rest = F.expr("taken % words")
    lengths = F.concat(F.expr("array_repeat(words, CAST(taken DIV words AS INT))"), F.when(rest > 0, F.array(rest)).otherwise(F.expr("array()")))
    rows = rows.join(part, same).withColumn("n", F.explode(lengths))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    head = F.when(F.col("n") < F.col("words"), F.array_join(F.slice(split, 1, F.col("n").cast("int")), " ")).otherwise(F.col("text"))
    return rows.select(*[head.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])
