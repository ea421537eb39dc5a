"""Edges of the knowledge base followed further than one step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfloor.session import rewritten


def chain_ends(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(source, end, steps, cyclic): where the chain of edges from each source ends, and how long it is.

    An end has no edge of its own. Pointer doubling: in every round each row jumps as far as the row that it points at already
    has, so chains of any length take as many rounds as their length has binary digits. Rows that still move after more
    rounds than there are sources to visit lead into a circle: ``cyclic``, without end or steps. A source with several edges
    follows the one with the smallest target; null edges are none.
    """
    kind = edges.schema[source].dataType
    rows = edges.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(source).alias("source")).agg(
        F.min(F.col(target).cast(kind)).alias("at")
    )
    rows = rewritten(rows.withColumn("steps", F.lit(1).cast("bigint")), "chains")
    most = max(1, rows.count())
    done = None
    for _ in range(most.bit_length() + 1):
        ahead = rows if done is None else rows.unionByName(done)
        ahead = ahead.select(F.col("source").alias("_at"), F.col("at").alias("_next"), F.col("steps").alias("_more"))
        joined = rewritten(rows.join(ahead, F.col("at") == F.col("_at"), "left"), "chains")
        ended = joined.filter("_at IS NULL").select("source", "at", "steps")
        done = ended if done is None else done.unionByName(ended)
        rows = joined.filter("_at IS NOT NULL").select("source", F.col("_next").alias("at"), (F.col("steps") + F.col("_more")).alias("steps"))
        if rows.isEmpty():
            break
    nothing = F.lit(None)
    return done.select(F.col("source"), F.col("at").alias("end"), "steps", F.lit(False).alias("cyclic")).unionByName(
        rows.select("source", nothing.cast(kind).alias("end"), nothing.cast("bigint").alias("steps"), F.lit(True).alias("cyclic"))
    )


def paths(edges: DataFrame, relationships: Sequence[str], start: DataFrame | None = None) -> DataFrame:
    """(start, end, path) over one edge of each of ``relationships`` in turn, such as group -> software -> technique.

    ``edges`` is (relationship, source_ref, target_ref), with repeats counted once; a path never meets an object twice.
    ``start`` (a column ``ref``) restricts where paths begin.
    """
    known = edges.select("relationship", "source_ref", "target_ref").filter("source_ref IS NOT NULL AND target_ref IS NOT NULL").distinct()
    found = None
    for name in relationships:
        step = known.filter(F.col("relationship") == name).select(F.col("source_ref").alias("_from"), F.col("target_ref").alias("_to"))
        if found is None:
            begin = step if start is None else step.join(start.select(F.col("ref").alias("_from")).distinct(), "_from", "left_semi")
            found = begin.filter("_from <> _to").select(F.col("_from").alias("start"), F.col("_to").alias("end"), F.array("_from", "_to").alias("path"))
            continue
        found = found.join(step, F.col("end") == F.col("_from")).filter(~F.array_contains("path", F.col("_to"))).select(
            "start", F.col("_to").alias("end"), F.concat("path", F.array("_to")).alias("path")
        )
    if found is None:
        raise ValueError("a path needs at least one relationship")
    return found
