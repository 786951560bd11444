"""Gaps and islands of places along a line, for keys of any size.

Places of a key that lie at most a reach apart, one after the other, are an island; nothing within that reach crosses from one to the
next. No task sorts more than a stretch of a key: stretches are cut at fixed widths, see what lies just before them, and only
stretches without any beginning of an island ask those before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.sources.scratch import settle

#: A stretch is so many reaches wide.
REACHES_A_STRETCH = 1024
#: Keys with no more places are one island.
PLACES_TOGETHER = 2000


def islands(places: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """places (keys, at long, ...) with island: the first place of the island."""
    width = REACHES_A_STRETCH * (reach + 1)
    stretch = lambda x: F.expr(f"({x}) div {width} - CAST(({x}) % {width} < 0 AS INT)")
    home = places.withColumn("_home", stretch("at"))
    seen = home.withColumn("_stretch", F.explode(F.array_distinct(F.array(F.col("_home"), stretch(f"at + {reach}")))))
    along = Window.partitionBy(*keys, "_stretch").orderBy("at")
    own = F.col("_home") == F.col("_stretch")
    before = F.lag("at").over(along)
    begins = own & (before.isNull() | (F.col("at") - before > reach))
    marked = seen.withColumn("_begin", F.when(begins, F.col("at"))).withColumn("_first", F.max("_begin").over(along)).where(own).drop("_begin", "_home")
    placed = settle(marked, "island_places")
    stretches = placed.groupBy(*keys, "_stretch").agg(F.max("_first").alias("_last"))
    through = stretches.where("_last is null")
    leading = stretches.where("_last is not null").join(through.select(*keys, (F.col("_stretch") - 1).alias("_stretch")), [*keys, "_stretch"], "left_semi")
    upto = Window.partitionBy(*keys).orderBy("_stretch")
    carried = through.unionByName(leading).withColumn("_last", F.last("_last", ignorenulls=True).over(upto))
    # a stretch's last beginning, wherever it lies, is what the next one asks for
    asked = stretches.where("_last is not null").unionByName(carried.join(through.select(*keys, "_stretch"), [*keys, "_stretch"], "left_semi"))
    waiting = placed.where("_first is null").join(asked.withColumn("_stretch", F.col("_stretch") + 1), [*keys, "_stretch"]).withColumn("island", F.col("_last")).drop("_last")
    known = placed.where("_first is not null").withColumn("island", F.col("_first"))
    return known.unionByName(waiting).drop("_first", "_stretch")


def dealt(places: DataFrame, keys: list[str], reach: int | None) -> DataFrame:
    """places with island, by which they may be dealt to tasks: keys of many places by islands, others, and all if no reach bounds
    what may cross, as a whole. places is read more than once: a written table."""
    whole = F.lit(0).cast("long")
    if reach is None:
        return places.withColumn("island", whole)
    sizes = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= PLACES_TOGETHER:
        return places.withColumn("island", whole)
    many = settle(sizes.where(F.col("_n") > PLACES_TOGETHER).drop("_n"), "island_keys")
    few = places.join(many, keys, "left_anti").withColumn("island", whole)
    return few.unionByName(islands(places.join(many, keys, "left_semi"), keys, reach))


def all_known(names: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).isNotNull() for k in names])
