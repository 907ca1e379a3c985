"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are served in a shuffled order (by a hash of the id). A document's virtual finish time is the
words of its source served up to its end, divided by the source's target; a second and third pass go on where the first
ended. What is served is sorted by virtual finish time over all sources, words are added up in that order, and the mix
ends where the budget does. Targets add up to the budget, so that is virtual time 1; the document that a source is
serving just then is cut there. So each source gets its target to the word, and no document is taken more than
`max_repeats` times. In finish order, sources interleave at their weights.

Nothing is ordered in one task. A source is cut into blocks of the hash's range and the mix into slots of virtual time:
sums (one row per block, one per slot) are added up, and rows are ordered inside their block and slot. Words are
counted once; all further steps read the written sizes.

Defined cases: null and empty texts have no words and are not taken; a null source is a source, the last; rows with one
id are documents of their own, ordered by size and a hash of the text. A budget of nothing takes nothing. Columns beside
id, text and source may have any type and name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames
from .components import stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Documents ordered in one group, on average.
BLOCK = 5_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0,
            max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target, budget). Weights repeat over the sources in order (null last).

    Targets are min(cap, level * weight): the level at which they add up to the budget. Sources reach their caps in the
    order of cap / weight, so the level follows from running sums in that order.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = (sizes.withColumn("weight", F.element_at(table, (F.row_number().over(every) - 1) % len(weights) + 1))
         .withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size")))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    s = (s.withColumn("full", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(whole)))
    level = (F.col("budget") - F.col("full")) / F.col("open")
    s = s.withColumn("level", F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), level.alias("level")))).over(whole)["level"])
    return s.select("source", "source_size", "weight",
                    F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"),
                    F.floor(F.col("budget") + 1e-6).alias("budget"))


def _documents(docs: DataFrame, doc_id: str, text: str, source: str) -> list[Column]:
    """What tells documents apart: id, source, size, and a hash of the text."""
    words_of = F.col(f"`{text}`")
    return [F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").alias("source"), words(words_of).alias("size"),
            F.xxhash64(words_of).alias("mark")]


def _served(sizes: DataFrame, weights: Sequence[float], share: float, max_repeats: int, block: int) -> DataFrame:
    """One row per document and pass that begins before the budget ends, and one for each document that none does.

    begin: words of its source served before; words: those served to it until the budget ends; finish: the virtual time
    at their end. (source, block, place) is the document.
    """
    blocks = frames.pieces(sizes.count(), block)
    d = sizes.withColumn("block", F.shiftright(F.col("turn") * blocks, 31))
    sums = d.groupBy("source", "block").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    goal = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats)
    goal = goal.withColumnRenamed("source", "g").drop("weight")
    order = Window.partitionBy("source", "block").orderBy("turn", "id", "size", "mark")
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("inside", F.coalesce(inside, F.lit(0))).withColumn("place", F.row_number().over(order))
    d = (d.join(sums, d["source"].eqNullSafe(sums["s"]) & (d["block"] == sums["b"]))
         .join(goal, d["source"].eqNullSafe(goal["g"])).withColumn("start", F.col("before") + F.col("inside")))
    d = d.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    d = d.withColumn("begin", F.col("pass") * F.col("source_size") + F.col("start"))
    d = d.withColumn("words", F.greatest(F.least(F.floor(F.col("target") + 1e-6) - F.col("begin"), F.col("size")), F.lit(0)))
    d = d.where((F.col("words") > 0) | (F.col("pass") == 0))
    # A document that is not served has no finish time; it is kept apart, in slots by its block.
    finish = F.when(F.col("words") > 0, (F.col("begin") + F.col("words")) / F.col("target"))
    return d.withColumn("finish", finish).select(
        "id", "source", "size", "mark", "source_size", "target", "budget", "start", "block", "place", "pass", "words", "finish",
        F.when(F.col("words") > 0, F.least(F.floor(F.col("finish") * blocks), F.lit(blocks))).otherwise(blocks + 1 + F.col("block")).alias("slot"))


def queue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_repeats: int = MAX_REPEATS,
          seed: int = 42, block: int = BLOCK) -> DataFrame:
    """The mix as a list, range-partitioned and sorted by virtual finish time: one row per document and pass, with
    position (words of the mix before it) and taken (words the mix takes). Documents that are not taken come last."""
    sizes = docs.select(*_documents(docs, doc_id, text, source))
    # 31 bits of the hash: the order of service; its leading part: the block.
    sizes = stored(sizes.withColumn("turn", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id")), 33)), "sizes")
    served = stored(_served(sizes, weights, share, max_repeats, block), "served")
    sums = served.groupBy("slot").agg(F.sum("words").alias("words"))
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("slot", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("slot").orderBy("finish", "source", "id", "block", "place", "pass")
    inside = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ordered = served.join(sums, "slot").repartitionByRange("slot").withColumn("inside", inside)
    position = F.col("before") + F.col("inside")
    taken = F.greatest(F.least("words", F.col("budget") - position), F.lit(0)).cast("long")
    return ordered.withColumn("position", position).withColumn("taken", taken).drop("before", "inside", "words", "budget")


def schedule(docs: DataFrame, *args, **settings) -> DataFrame:
    """One row per document, from its rows in the queue (same arguments): id, source, size, source_size, target, start
    (its source's words before it in a pass) and taken (words over all passes)."""
    document = ["source", "block", "place", "id", "size", "source_size", "target", "start"]
    plan = queue(docs, *args, **settings).groupBy(*document).agg(F.sum("taken").alias("taken"))
    return plan.select("id", "source", "size", "source_size", "target", "start", "taken")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mixed corpus: one row per document and pass that is taken, all columns of `docs`, the text cut to the words
    taken, in the order of virtual finish times (range-partitioned and sorted)."""
    one = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text, source)]
    # Rows that share id, source and text are interchangeable in the plan: number them on both sides.
    key = ["id", "source", "size", "mark"]
    same = Window.partitionBy(*key)
    rows = docs.select(one, F.to_json(F.struct(F.lit(0).alias("none"), *rest)).alias("_rest"), *_documents(docs, doc_id, text, source))
    rows = rows.select("_row", *[F.col(k).alias(f"_{k}") for k in key], F.row_number().over(same.orderBy("_rest")).alias("_n"))
    plan = queue(docs, doc_id, text, source, **settings).where("taken > 0")
    plan = plan.select(*key, "position", "taken", F.dense_rank().over(same.orderBy("place")).alias("n"))
    equal = [rows[f"_{k}"].eqNullSafe(plan[k]) for k in (*key, "n")]
    taken = rows.join(plan, equal).select("_row", "size", "taken", "position")
    cut = F.when(F.col("taken") == F.col("size"), F.col("_row")[text]).otherwise(
        F.array_join(F.slice(F.regexp_extract_all(F.col("_row")[text], F.lit(f"({WORD})")), F.lit(1), F.col("taken").cast("int")), " "))
    taken = taken.repartitionByRange("position").sortWithinPartitions("position")
    return taken.select(*[cut.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return schedule(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
