"""Mixing sources to target weights.

Sizes are aggregated by source; a source's repetition rate is target / size,
and each document is taken floor(rate) times and, with the fraction as its
probability, once more, by a hash of its id, seeded. Reruns therefore agree.

Draws that are independent can miss the target by the size of a few long
documents. So a source's documents are classed by size (to four bits) and, from
the longest class down, the classes' extra copies are the steps of the rounded
running total of fraction * documents; within a class the documents of the
least hashes get them. The hash below which a class takes its documents is
found by one sort of narrow rows. What a source takes then misses its target by
about half of its longest document at most, and every document of a class has
the same chance.

Targets share the total by weight. A target stops at ``most`` times its
source's size; the excess is shared again among the others by weight until
none is above. In the limit every open target is weight * level, so the loop
only raises that one level; each round is one aggregate over the sources.

Defined cases: a null or empty text has size 0; a very long text is a document
like others; a null source is a source, after all others; a source of size 0
has target 0 and its documents are taken 0 times; a null doc_id is hashed as
such; rows of one source that repeat a doc_id and a size class are taken alike;
an empty table gives no rows; further columns pass through ``mixed`` whatever
their names, and are dropped by ``mixing_plan``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, stored

SEED = 20_24


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, weight, target, rate for every source of sized(source, size)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    order = [F.col("source").isNull(), F.encode(F.col("source"), "UTF-8")]  # UTF-8 bytes sort as code points do
    ranked = numbered(totals, *order)
    sources = stored(ranked.select("source", "source_size", cycle[(F.col("rank") % len(weights)).cast("int")].alias("weight")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    goal, level = share * total, 0.0
    while goal:
        stopped = F.col("weight") * level >= most * F.col("source_size")
        held, open_ = sources.agg(F.sum(F.when(stopped, most * F.col("source_size")).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))).first()
        raised = (goal - held) / open_ if open_ else level
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("weight") * level, most * F.col("source_size").cast("double"))
    return sources.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0))


def size_class(size: str = "size"):
    """The size with its four leading bits only."""
    spare = F.greatest(F.length(F.bin(F.col(size))) - 4, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", F.col(size), spare), spare)


def drawn(seed: int):
    """52 bits of a hash of the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def sized_documents(docs: DataFrame, seed: int) -> DataFrame:
    sized = docs.select("doc_id", "source", word_count().alias("size"))
    return sized.select("doc_id", "source", "size", size_class().alias("class"), drawn(seed).alias("draw"))


def extra_copies(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source_, class_, rate, source_size, target, and ``below``: documents of the class with a draw up to it get one more copy."""
    groups = sized.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"))
    rated = groups.join(targets.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy(F.desc("class")))  # some hundred classes in a source at most
    part = F.col("rate") - F.floor("rate")
    extra = F.floor(F.col("upto") * part + 0.5) - F.floor((F.col("upto") - F.col("n")) * part + 0.5)
    rated = stored(rated.withColumn("upto", upto).select("source_", F.col("class").alias("class_"), "rate", "source_size", "target", extra.cast("long").alias("extra")))
    order = [F.col("source").isNull(), F.col("source"), F.desc("class"), F.col("draw")]
    ranked = numbered(sized.select("source", "class", "draw"), *order)
    starts = ranked.groupBy("source", "class").agg(F.min("rank").alias("start"))
    same = F.col("source").eqNullSafe(F.col("source_")) & (F.col("class") == F.col("class_"))
    wanted = rated.where("extra > 0").join(starts, same).select("source_", "class_", (F.col("start") + F.col("extra") - 1).alias("rank"))
    below = ranked.select("rank", "draw").join(wanted, "rank").select(F.col("source_").alias("s"), F.col("class_").alias("c"), F.col("draw").alias("below"))
    return rated.join(below, F.col("source_").eqNullSafe(F.col("s")) & (F.col("class_") == F.col("c")), "left").drop("s", "c", "extra")


def copies():
    """floor(rate), and one more where the class's bound takes the draw."""
    return (F.floor("rate") + F.coalesce((F.col("draw") <= F.col("below")).cast("long"), F.lit(0))).cast("long")


def mixing_plan(docs: DataFrame, weights=(1, 2, 3), share: float = 1.0, most: float = 3.0, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of every document."""
    sized = stored(sized_documents(docs, seed))
    classes = stored(extra_copies(sized, source_targets(sized, tuple(weights), share, most)))
    joined = sized.join(classes, F.col("source").eqNullSafe(F.col("source_")) & (F.col("class") == F.col("class_")))
    return joined.select("doc_id", "source", "size", "source_size", "target", "rate", copies().alias("copies"), (copies() * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights=(1, 2, 3), share: float = 1.0, most: float = 3.0, seed: int = SEED) -> DataFrame:
    """The documents themselves, each as often as it is taken, with their own columns."""
    sized = stored(sized_documents(docs, seed))
    classes = stored(extra_copies(sized, source_targets(sized, tuple(weights), share, most)))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", drawn(seed).alias("draw"), word_count().alias("size")).withColumn("class", size_class())
    joined = packed.join(classes, F.col("source").eqNullSafe(F.col("source_")) & (F.col("class") == F.col("class_")))
    return joined.where(copies() > 0).select(F.explode(F.array_repeat("row", copies().cast("int"))).alias("row")).select("row.*")
