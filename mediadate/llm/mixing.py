"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. A document's expected number of copies is its source's target
over its source's size, times its own weight, at most ``most``. The whole copies are certain. The
rest is an inclusion chance p < 1, and Pareto order sampling ranks documents by

    Q = (u / (1 - u)) / (p / (1 - p)),     u uniform, from a hash of seed and doc_id,

and takes the lowest ranks of a source until its words are filled. The sample has a fixed size,
here in words; the document that would overshoot is passed over, and the gap is filled from the
ranks after it that still fit (``rounds`` times at most, ended below ``closeness``).

Ranks are numbers below 2**30. Sums per block of 2**10 ranks (combined before the shuffle) give the
block in which a source is filled, and only rows of that block are ordered one by one. A round
leaves one limit per source, so that the sample is a condition on each row, without moving rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediadate.llm.common import WORD, join_lookup, settle

RANKS, BLOCK_BITS = 1 << 30, 10


def share_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Targets by weight: ``share`` of all sizes, none above ``most`` times its source's size.

    ``sources`` has ``size`` and ``weight``. What a full source cannot take goes to the others by
    weight, until none is above: the level (words per weight) only rises, and every step that
    changes it fills at least one more source. The driver holds the level alone.
    """
    limit = F.col("size") * most
    wanted = share * (sources.agg(F.sum("size")).first()[0] or 0)
    level, known = 0.0, -1
    while True:
        full = (F.col("weight") * level >= limit) | (F.col("weight") == 0)
        sums = sources.agg(
            F.sum(F.when(full & (F.col("weight") > 0), limit).otherwise(0.0)).alias("filled"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(full.cast("long")).alias("count"),
        ).first()
        if not sums["weight"] or sums["count"] == known:
            break
        level, known = (wanted - sums["filled"]) / sums["weight"], sums["count"]
    return sources.withColumn("target", F.least(F.col("weight") * level, limit).cast("double"))


def document_levels(rows: DataFrame, most: float) -> DataFrame:
    """Per source the factor of document weights at which the expected words meet the target."""
    first = rows.groupBy("source").agg(
        F.first("target").alias("target"), F.sum(F.col("size") * F.col("weight")).alias("open")
    )
    level = F.when(F.col("open") > 0, F.col("target") / F.col("open")).otherwise(0.0)
    levels = settle(first.select("source", "target", level.alias("level")))
    while True:
        full = F.col("weight") * F.col("level") >= most
        sums = join_lookup(rows.drop("target"), levels, ["source"], "doc_id").groupBy("source").agg(
            F.first("target").alias("target"),
            F.first("level").alias("level"),
            F.sum(F.when(full, F.col("size") * most).otherwise(0.0)).alias("filled"),
            F.sum(F.when(full, 0.0).otherwise(F.col("size") * F.col("weight"))).alias("open"),
        )
        raised = F.when(F.col("open") > 0, (F.col("target") - F.col("filled")) / F.col("open")).otherwise(F.col("level"))
        levels_next = settle(sums.select("source", "target", "level", F.greatest("level", raised).alias("next")))
        moved = levels_next.where(F.col("next") > F.col("level") * (1 + 1e-12)).limit(1).count()
        levels = levels_next.select("source", "target", F.col("next").alias("level"))
        if not moved:
            return levels.select("source", "level")


def _uniform(seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def _rank(chance: Column, seed: int) -> Column:
    """The Pareto rank as a number below 2**30, by the logarithm of the odds."""
    u = _uniform(seed)
    odds = F.log(u / (1 - u)) - F.log(chance / (1 - chance))
    return F.greatest(F.lit(0), F.least(F.lit(RANKS - 1), F.floor((odds + 40.0) / 80.0 * RANKS))).cast("long")


def _position() -> Column:
    return F.struct("rank", "doc_id", "size")


def _taken(limits: Column) -> Column:
    """True if one of the rounds takes the row: it fits the gap and comes no later than the last."""
    return F.coalesce(
        F.exists(limits, lambda x: (F.col("size") <= x["gap"]) & (_position() <= x["last"])), F.lit(False)
    )


def _next_limit(open_rows: DataFrame) -> DataFrame:
    """Per source the last row, by rank, up to which the rows that fit stay within the gap, and their words.

    ``open_rows``: source, gap, rank, doc_id, size. Rows alike in all of these go together.
    """
    rows = open_rows.where(F.col("size") <= F.col("gap")).withColumn("block", F.shiftright("rank", BLOCK_BITS))
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
    blocks = blocks.withColumn("large", F.shiftright("block", BLOCK_BITS))
    larges = blocks.groupBy("source", "large").agg(F.sum("words").alias("words"))

    def before(keys, order):
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("words").over(window), F.lit(0))

    larges = larges.withColumn("outer", before(["source"], "large")).drop("words")
    blocks = blocks.withColumn("inner", before(["source", "large"], "block")).join(larges, ["source", "large"])
    start = F.col("inner") + F.col("outer")
    crossing = (
        blocks.where(start + F.col("words") > F.col("gap"))
        .groupBy("source")
        .agg(F.min(F.struct("block", start.alias("start"))).alias("edge"))
        .select("source", "edge.block", "edge.start")
    )
    crossing = settle(crossing)
    met = join_lookup(rows, crossing.withColumnRenamed("block", "edge"), ["source"], "doc_id", "left")
    inside = met.where(F.col("block") == F.col("edge"))
    running = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rangeBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_upto", F.col("start") + F.sum("size").over(running)).where("_upto <= gap")
    ahead = met.where(F.col("edge").isNull() | (F.col("block") < F.col("edge")))
    columns = ["source", "gap", "size", _position().alias("last")]
    parts = ahead.select(*columns).unionByName(inside.select(*columns))
    limit = F.struct(F.first("gap").alias("gap"), F.max("last").alias("last"))
    return parts.groupBy("source").agg(limit.alias("limit"), F.sum("size").alias("words"))


def _sized(docs: DataFrame, weight_column: str | None, carry: bool = False) -> DataFrame:
    """doc_id, source (never null), size in words and weight; with ``carry`` the row itself as ``_row``."""
    own = F.greatest(F.coalesce(F.col(weight_column).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_column else F.lit(1.0)
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        own.alias("weight"),
        *([F.struct(*(docs[name] for name in docs.columns)).alias("_row")] if carry else []),
    )


def _ranked(rows: DataFrame, targets: DataFrame, levels: DataFrame | None, most: int, seed: int) -> DataFrame:
    """Rows with source_size, target, ``sure`` copies, the ``chance`` of one more and their rank."""
    rows = join_lookup(rows, targets, ["source"], "doc_id")
    if levels is not None:
        rows = join_lookup(rows, levels, ["source"], "doc_id")
        expected = F.least(F.col("weight") * F.col("level"), F.lit(float(most)))
    else:
        ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        expected = F.least(ratio, F.lit(float(most)))
    # a chance below a billionth is rounding of a whole number
    whole = F.floor(expected + 1e-9)
    chance = F.greatest(expected - whole, F.lit(0.0))
    rows = rows.withColumn("sure", whole.cast("int")).withColumn("chance", F.when(chance > 1e-9, chance))
    return rows.withColumn("rank", _rank(F.col("chance"), seed)).drop("weight", "level")


def _with_copies(ranked: DataFrame, limits: DataFrame) -> DataFrame:
    met = join_lookup(ranked, limits, ["source"], "doc_id", "left")
    none = F.col("chance").isNull() | (F.col("size") == 0)
    return met.withColumn("copies", F.col("sure") + F.when(none, 0).otherwise(_taken(F.col("limits")).cast("int")))


def plan_mix(
    docs: DataFrame, weights: DataFrame, share: float = 1.5, most: int = 2, weight_column: str | None = None,
    seed: int = 17, rounds: int = 6, closeness: float = 0.001, carry: bool = False,
) -> DataFrame:
    """Rows as ``_sized`` gives them, with source_size, target and ``copies``.

    All sums are over narrow rows. What they lead to (targets, levels, limits) has a row per source,
    so whole rows get their copies in one pass, without a shuffle while sources can be broadcast.
    """
    rows = settle(_sized(docs, weight_column))
    keyed = weights.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source"), F.col("weight").cast("double")
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    sources = settle(sizes.join(keyed, "source", "left").fillna(0.0, ["weight"]))
    targets = settle(
        share_targets(sources, share, most).select("source", F.col("size").alias("source_size"), "target")
    )
    levels = document_levels(join_lookup(rows, targets, ["source"], "doc_id"), most) if weight_column else None
    ranked = settle(_ranked(rows, targets, levels, most, seed))
    limits = _fill(ranked, rounds, closeness)
    if carry:
        ranked = _ranked(_sized(docs, weight_column, carry=True), targets, levels, most, seed)
    return _with_copies(ranked, limits)


def mix_documents(docs: DataFrame, weights: DataFrame, share: float = 1.5, most: int = 2, **options) -> DataFrame:
    """Copies of every document in the mix: doc_id, source, size, source_size, target, copies, taken.

    ``weights`` has ``source`` and ``weight`` (null is a source of its own; sources that it lacks
    weigh 0). Size: words of the text, none for null. ``weight_column`` names document weights
    (null or negative: 0); without it documents of a source are alike. A document without words
    can be in the mix with any number of copies and takes none. Rows with equal doc_id and size are
    drawn alike; very long texts weigh all their words. Reruns agree: nothing depends on the order or the place of rows. ``options`` are
    those of ``plan_mix``.
    """
    return plan_mix(docs, weights, share, most, **options).select(
        "doc_id",
        F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)).alias("source"),
        "size",
        "source_size",
        "target",
        F.col("copies").cast("int").alias("copies"),
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def _fill(rows: DataFrame, rounds: int, closeness: float) -> DataFrame:
    """Per source the limits of the rounds, from narrow ranked rows."""
    drawn = rows.where(F.col("chance").isNotNull() & (F.col("size") > 0))
    gaps = rows.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("size") * F.col("sure"))).alias("gap"), F.first("target").alias("target")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    none = F.array().cast(f"array<struct<gap:double,last:struct<rank:bigint,doc_id:{kind},size:bigint>>>")
    state = settle(gaps.withColumn("limits", none))
    for _ in range(rounds):
        met = join_lookup(drawn.drop("target"), state, ["source"], "doc_id")
        reached = _next_limit(met.where(~_taken(F.col("limits"))).select("source", "gap", "rank", "doc_id", "size"))
        moved = F.col("limit").isNotNull()
        limits = F.when(moved, F.array_append("limits", F.col("limit"))).otherwise(F.col("limits"))
        gap = F.col("gap") - F.coalesce("words", F.lit(0))
        joined = state.drop("moved").join(reached, "source", "left")
        state = settle(joined.select("source", gap.alias("gap"), "target", limits.alias("limits"), moved.alias("moved")))
        if state.where(F.col("moved") & (F.col("gap") > closeness * F.col("target"))).limit(1).count() == 0:
            break
    return state.select("source", "limits")


def repeat_documents(docs: DataFrame, weights: DataFrame, share: float = 1.5, most: int = 2, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it."""
    planned = plan_mix(docs, weights, share, most, carry=True, **options).where("copies > 0")
    return planned.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")
