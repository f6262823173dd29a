"""Least-loaded assignment: each user gets a number of items, the items with the lowest loads first, never their own and none twice.

What one user after another would take fills the loads like water. The level is
computed from a histogram of the loads, not by handing out items in turn: an
item takes what it lacks to the level, at most one place for each user but its
author; what is left raises some items by one more. The places of all items lie
in one row, and place p goes to user number (p + d) mod users. Neighbouring
places of an item have different users, and a user gets equally many places. A
place excludes one offset d, the one that would give it to the item's author;
users are numbered in some ways (multiples of one numbering, in which their items
lie as well), and an offset that no place excludes is taken.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.errors import SpecError
from plumbline.plans.ranking import numbered, running_total
from plumbline.plans.storage import checkpointed

#: Numberings of the users that are tried together.
NUMBERINGS = 24


def water_level(loads: DataFrame, places: int, most: int) -> tuple[int, int]:
    """(level, rest): items of a lower load rise to the level, each by ``most`` at the most, and ``rest`` of those that could rise further by one.

    ``loads``: load, n. The places that a level needs are a sum of broken lines,
    which bend where an item begins to rise and where it is full.
    """
    bends = loads.select(F.explode(F.array(F.struct(F.col("load").alias("v"), F.col("n").alias("slope")), F.struct((F.col("load") + most).alias("v"), (-F.col("n")).alias("slope")))).alias("b"))
    bends = bends.groupBy(F.col("b.v").alias("v")).agg(F.sum("b.slope").alias("slope"))
    order = [F.col("v")]
    sums = running_total(running_total(bends, order, F.col("slope"), "rising"), order, F.col("slope") * F.col("v"), "weight")
    reached = sums.withColumn("needed", F.col("v") * F.col("rising") - F.col("weight")).where(F.col("needed") <= places)
    row = reached.agg(F.max_by(F.struct("v", "rising", "needed"), "v").alias("r")).first().r
    if row is None or (row.rising == 0 and row.needed < places):
        raise SpecError(f"there are not {places} places to give away")
    if row.rising == 0:
        return row.v, 0
    return row.v + (places - row.needed) // row.rising, (places - row.needed) % row.rising


def _multipliers(users: int) -> list[int]:
    return [g for g in (users - 1, *range(1, 40 * NUMBERINGS)) if gcd(g, users) == 1][:NUMBERINGS] if users > 1 else [1]


def assign(users: DataFrame, items: DataFrame, each: int, user: str = "user", item: str = "item", author: str = "author", load: str = "load") -> DataFrame:
    """user, item: ``each`` items for every user.

    ``users``: one row a user; ``items``: one row an item with its author (null
    for none) and the load it has (null counts as 0). Nobody gets their own item
    or one twice, and the loads after it are as even as they can be. Fails where
    places or an arrangement are missing, as for a single user with an own item.
    """
    people = checkpointed(numbered(users.select(F.col(user).alias("user")).distinct(), [F.xxhash64("user"), F.col("user")], "number").withColumn("number", F.col("number") - 1))
    count = people.count()
    if count == 0 or each == 0:
        return users.sparkSession.createDataFrame([], f"user {dict(users.dtypes)[user]}, item {dict(items.dtypes)[item]}")
    rows = items.select(F.col(item).alias("item"), F.col(author).alias("author"), F.coalesce(F.col(load), F.lit(0)).cast("long").alias("load"))
    rows = rows.join(people.select(F.col("user").alias("author"), F.col("number").alias("own")), "author", "left")
    full = F.lit(count) - F.col("own").isNotNull().cast("long")
    level, rest = water_level(rows.groupBy("load").agg(F.count("*").alias("n")), count * each, max(count - 1, 1))
    rows = rows.withColumn("takes", F.least(F.lit(max(count - 1, 1)), full, F.greatest(F.lit(0), F.lit(level) - F.col("load"))))
    could = (F.col("load") <= level) & (F.lit(level) - F.col("load") < max(count - 1, 1))
    order = [F.xxhash64("item"), F.col("item")]
    rows = running_total(rows, order, could.cast("long"), "place")
    rows = rows.withColumn("takes", F.col("takes") + (could & (F.col("place") <= rest)).cast("long")).where("takes > 0")
    rows = running_total(rows, [F.col("own").asc_nulls_last(), *order], F.col("takes"), "end")
    places = checkpointed(rows.select("item", "own", F.explode(F.sequence(F.col("end") - F.col("takes"), F.col("end") - 1)).alias("p")))
    factors = _multipliers(count)
    tried = F.explode(F.array(*(F.struct(F.lit(g).cast("long").alias("g"), F.pmod(F.col("own") * g - F.col("p"), F.lit(count)).alias("d")) for g in factors))).alias("x")
    excluded = places.where("own is not null").select(tried).select("x.g", "x.d").distinct()
    offsets = places.sparkSession.range(count).select(F.explode(F.array(*(F.lit(g).cast("long") for g in factors))).alias("g"), F.col("id").alias("d"))
    free = offsets.join(excluded, ["g", "d"], "left_anti").agg(F.min(F.struct("g", "d")).alias("f")).first().f
    if free is None:
        raise SpecError("no arrangement keeps all users from their own items")
    inverse = pow(free.g, -1, count) if count > 1 else 0
    dealt = places.select("item", F.pmod(F.pmod(F.col("p") + free.d, F.lit(count)) * inverse, F.lit(count)).alias("number"))
    return dealt.join(people, "number").select("user", "item")
