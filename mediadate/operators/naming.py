"""Collision-free names: ``name.ext``, then ``name (1).ext``, ``name (2).ext`` and so on."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediadate.functions import paths
from mediadate.operators.lineage import discard_tables, settle_table
from mediadate.operators.ordering import BLOCK_BITS, running_total
from mediadate.operators.skew import spread_join

# How a numbered name is written, and how many numbers may follow each other.
NUMBERED_STEM = r"(?s)^(.+) \(([1-9]\d{0,17})\)\z"
NUMBER_TAIL = r"(?s)^.+?((?: \([1-9]\d{0,17}\))*)\z"

NAME = ["folder", "name"]
PARENT = ["folder", "parent"]


def numbered(name: Column, number: Column) -> Column:
    """Name with a number before its suffix."""
    return F.concat(paths.stem(name), F.lit(" ("), number.cast("string"), F.lit(")"), paths.suffix(name))


def _tail(name: Column) -> Column:
    return F.regexp_extract(paths.stem(name), NUMBER_TAIL, 1)


def _maybe_numbered(name: Column) -> Column:
    """Cheap test that spares plain names the patterns."""
    return name.contains(" (")


def family(name: Column) -> Column:
    """Name without any numbers before its suffix; only names of one family can collide."""
    stem = paths.stem(name)
    bare = F.concat(F.left(stem, F.length(stem) - F.length(_tail(name))), paths.suffix(name))
    return F.when(_maybe_numbered(name), bare).otherwise(name)


def _with_parent(names: DataFrame) -> DataFrame:
    """Add the name a numbered name is a variant of, its number, and how many numbers it has."""
    name, maybe = F.col("name"), _maybe_numbered(F.col("name"))
    split = names.withColumn("_stem", F.when(maybe, paths.stem(name)))
    split = split.withColumn("_base", F.regexp_extract("_stem", NUMBERED_STEM, 1))
    is_variant = F.coalesce(F.col("_base") != "", F.lit(False))
    return split.withColumns(
        {
            "parent": F.when(is_variant, F.concat(F.col("_base"), paths.suffix(name))),
            "number": F.when(is_variant, F.regexp_extract("_stem", NUMBERED_STEM, 2)).try_cast("long"),
            "depth": F.when(maybe, F.regexp_count(_tail(name), F.lit(r"\("))).otherwise(0),
        }
    ).drop("_stem", "_base")


def _passed_over(rows: DataFrame, block_bits: int) -> DataFrame:
    """Decide ``skipped`` for the variants of overflowing names, as columns of numbers, not one by one.

    Overflowing requests take the lowest free number, so the lowest free number only grows. A number
    asked for by name is passed over when that request came first: when the overflow seen by then
    (``earlier``) plus the numbers passed over below it has not reached the number. All are counted as
    passed over, then each is decided against the count below it, until no answer changes; then the
    rule holds for every number, and from the lowest one up that leaves one answer. A turn is a running
    total in blocks of numbers; as a rule few turns are needed, at most one for each number of a name.
    """
    decided = settle_table(rows.withColumn("passes", F.lit(1)))
    while True:
        counted = running_total(decided, PARENT, "number", "passes", "below", block_bits)
        passes = F.col("exists") | (F.col("earlier") + F.col("below") < F.col("number"))
        turned = settle_table(counted.withColumn("next", passes.cast("int")))
        discard_tables(decided)
        decided = turned.drop("passes", "below").withColumnRenamed("next", "passes")
        decided.place = turned.place
        if turned.filter("next <> passes").isEmpty():
            return decided.withColumn("skipped", F.col("passes") == 1).drop("passes")


def _settle_families(contested: DataFrame, block_bits: int) -> DataFrame:
    """Decide for the names of families, plain names first, then by how many numbers they end in.

    Result: folder, name, ``keeps`` (the first request keeps its name) and ``skipped``. The levels are
    a loop of jobs, as deep as names have numbers; a level only looks at names of the one above that
    overflow.
    """
    deepest = contested.agg(F.max("depth")).first()[0]
    above, done = None, []
    for depth in range((deepest or 0) + 1):
        here = contested.filter(F.col("depth") == depth).withColumn("skipped", F.lit(True))
        if above is not None and not above.isEmpty():
            here = here.withColumn("_parent", F.concat_ws("/", *PARENT))
            met = spread_join(here, above, "_parent", "number", "left").drop("_parent")
            met = settle_table(met.withColumn("_overflows", F.col("parent_first").isNotNull()))
            served = F.when(F.col("parent_first") < F.col("first_id"), F.col("parent_keeps")).otherwise(0)
            competing = met.filter("_overflows").withColumn("earlier", F.col("earlier") - served).drop("skipped")
            rest = met.filter("not _overflows").select(*here.drop("_parent").columns)
            here = rest.unionByName(_passed_over(competing, block_bits).select(*rest.columns))
        keeps = F.col("skipped") & ~F.col("exists") & (F.col("n") > 0)
        here = settle_table(here.withColumn("keeps", keeps.cast("int")))
        done.append(here.select(*NAME, "keeps", "skipped"))
        above = here.filter("has_variants and n > keeps").select(
            F.concat_ws("/", *NAME).alias("_parent"), F.col("first_id").alias("parent_first"), F.col("keeps").alias("parent_keeps")
        )
    return functools.reduce(DataFrame.unionByName, done)


def unique_destination(
    requests: DataFrame, existing: DataFrame | None = None, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """Add ``dest_name`` to requests ``(id, folder, name, ...)`` served in ``id`` order.

    A request gets its name if that is free, else its name with the lowest free number. ``existing``
    holds the ``(folder, name)`` pairs already taken. The outcome equals serving the requests one by
    one, yet a name asked for by a third of all rows is spread over many tasks: requests are counted
    per block of ids and numbered inside their block. Numbered variants that somebody asked for by name
    are decided from running totals, too (:func:`_passed_over`).

    ``requests`` is computed once for its three naming columns, which go to the checkpoint folder
    along with narrow tables derived from them, and once more only to add its other columns.
    """
    asked = settle_table(requests.select("id", *NAME))
    blocked = asked.withColumn("block", F.shiftright(F.col("id"), block_bits))
    nodes = settle_table(_nodes(asked, existing))
    blocks = blocked.groupBy(*NAME, "block").agg(F.count(F.lit(1)).alias("n"))
    blocks = settle_table(blocks.join(nodes.filter("n > 0").select(*NAME), NAME, "left_semi"))
    settled = settle_table(_settled(nodes, blocked, blocks, block_bits))
    discard_tables(nodes)

    # Numbers passed over, placed by how many free numbers lie below them.
    gaps = settled.filter("parent is not null and skipped").select(
        "folder", F.col("parent").alias("name"), "number", F.lit(1).alias("one")
    )
    overflowing = settled.filter("n > keeps").select(*NAME, "keeps")
    gaps = gaps.join(overflowing.select(*NAME), NAME, "left_semi")
    if gaps.isEmpty():
        named = _numbered_requests(blocked, blocks, overflowing, None, block_bits)
    else:
        gaps = running_total(gaps, NAME, "number", "one", "below", block_bits)
        gaps = settle_table(gaps.select(*NAME, (F.col("number") - F.col("below") - 1).alias("free_below")))
        named = _numbered_requests(blocked, blocks, overflowing, gaps, block_bits)
    if set(requests.columns) == {"id", *NAME}:
        return named
    return requests.join(named.select("id", "dest_name"), "id")


def _nodes(asked: DataFrame, existing: DataFrame | None) -> DataFrame:
    """The names that matter: those of families in which some name is asked for twice or taken."""
    names = asked.groupBy(*NAME).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.lit(False).alias("exists")
    )
    if existing is not None:
        taken = existing.select(*NAME).distinct().selectExpr(
            *NAME, "0L as n", "cast(null as long) as first_id", "true as exists"
        )
        both = names.unionByName(taken).groupBy(*NAME)
        names = both.agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("exists").alias("exists"))
    names = names.withColumn("family", family(F.col("name")))
    crowded = names.filter("n > 1 or (exists and n > 0)").select("folder", "family").distinct()
    return _with_parent(names.join(crowded, ["folder", "family"], "left_semi"))


def _settled(nodes: DataFrame, asked: DataFrame, blocks: DataFrame, block_bits: int) -> DataFrame:
    """Add whether a name's first request keeps it, and whether its parent's overflow skips it."""
    asked_variants = nodes.filter("parent is not null and not exists")
    columns = [*NAME, "parent", "number", "n", "keeps", "skipped"]
    simple = nodes.withColumns({"keeps": (~F.col("exists") & (F.col("n") > 0)).cast("int"), "skipped": F.lit(True)})
    if asked_variants.isEmpty():
        return simple.select(*columns)

    # Only where a variant was asked for by name can overflow and such requests compete.
    points = asked_variants.selectExpr("folder", "parent as name", "first_id as id", "0 as one", "name as variant")
    wanted = blocks.join(points.select(*NAME).distinct(), NAME, "left_semi").select(*NAME, "block")
    wanted = asked.join(wanted, [*NAME, "block"], "left_semi")
    wanted = settle_table(wanted.selectExpr(*NAME, "id", "1 as one", "cast(null as string) as variant"))
    counted = running_total(wanted.unionByName(points), NAME, "id", "one", "earlier", block_bits)
    counted = counted.filter("variant is not null").selectExpr("folder", "variant as name", "earlier")

    families = asked_variants.select("folder", "family").distinct()
    parents = nodes.filter("parent is not null").selectExpr("folder", "parent as name", "true as has_variants").distinct()
    contested = nodes.join(families, ["folder", "family"], "left_semi")
    contested = contested.join(parents, NAME, "left").join(counted, NAME, "left")
    contested = contested.withColumns(
        {"has_variants": F.coalesce("has_variants", F.lit(False)), "earlier": F.coalesce("earlier", F.lit(0)),
         "number": F.coalesce("number", F.lit(0)), "first_id": F.coalesce("first_id", F.lit(0)),
         "parent": F.coalesce("parent", F.lit(""))}
    )
    group = ["folder", "family"]
    decided = _settle_families(settle_table(contested), block_bits)
    decided = nodes.drop("family").join(decided, NAME).select(*columns)
    return decided.unionByName(simple.join(families, group, "left_anti").select(*columns))


def _numbered_requests(
    requests: DataFrame, blocks: DataFrame, overflowing: DataFrame, gaps: DataFrame | None, block_bits: int
) -> DataFrame:
    """Number the requests of names that overflow, block by block, and step over the gaps."""
    starts = running_total(blocks.join(overflowing, NAME, "left_semi"), NAME, "block", "n", "before", block_bits)
    starts = starts.select(*NAME, "block", "before").join(overflowing, NAME)

    ranked = requests.join(starts, [*NAME, "block"], "left")
    row = F.row_number().over(Window.partitionBy(*NAME, "block").orderBy("id"))
    place = F.when(F.col("before").isNotNull(), F.col("before") + row - F.col("keeps"))
    ranked = ranked.withColumn("_place", place).drop("block", "before", "keeps")

    number = F.col("_place")
    if gaps is not None:
        # The i-th overflow steps over every gap with fewer than i free numbers below it.
        marks = gaps.selectExpr(*NAME, "free_below * 2 + 1 as mark", "1 as one", "cast(null as long) as id")
        moved = ranked.filter("_place > 0").join(gaps.select(*NAME).distinct(), NAME, "left_semi")
        moved = settle_table(moved.selectExpr(*NAME, "_place * 2 as mark", "0 as one", "id"))
        moved = running_total(moved.unionByName(marks), NAME, "mark", "one", "passed", block_bits)
        moved = moved.filter("id is not null").select("id", "passed")
        ranked = ranked.join(moved, "id", "left")
        number = number + F.coalesce(F.col("passed"), F.lit(0))
    named = F.when(F.col("_place") > 0, numbered(F.col("name"), number)).otherwise(F.col("name"))
    return ranked.withColumn("dest_name", named).drop("_place", "passed")
