"""Boundaries: which polygons, boxes and circles hold each point, and series by boundary.

Boundaries are a table: ``boundary`` (a name), ``rings`` (closed or open rings of
points x, y; rings inside others are holes, by even and odd crossings) and
``circle`` (x, y and a radius r in metres), one of the two null. They are covered
by coarse cells: one without an edge inside is wholly in or out, one with edges
has the edges of the boundary in its row of cells, by fine rows if they are many.
Points meet the cover by an equi-join on their coarse cell, and only in a cell
with edges are they tested, against the edges of the row: a ray crosses no
others. No point is compared with a boundary that is not near, and none is repeated.
Boundaries with equal rings are tested as one, and with a cover that is not small
points at one place as one, so that tests grow with different places and shapes;
only the names in the result grow with points times boundaries that hold them.

Coordinates are degrees on a plane: shapes do not reach over the antimeridian.
A point on a border is inside if it lies at the lower or left one.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import SpecError
from plumbline.functions.scalars import haversine_km
from plumbline.operators.analytics import date_histogram
from plumbline.plans.storage import checkpointed, small_or_shuffled

#: Fine rows of a coarse cell, and the edges that a coarse row of a boundary may have before it is split into them.
FINE, FEW_EDGES = 16, 24
#: Names and edges of a cover that is broadcast; places of a cell, or points at a place, that meet its boundaries in one task.
BROADCAST_EDGES, PART_POINTS = 50_000, 20_000
SCHEMA = "boundary string, rings array<array<struct<x:double,y:double>>>, circle struct<x:double,y:double,r:double>"
METRES_A_DEGREE = 111_195.0


def box(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The rings of a box."""
    corners = [(west, south), (east, south), (east, north), (west, north)]
    return F.array(F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners)))


def parse_boundaries(text: str, kind: str) -> list[tuple]:
    """Rows of ``SCHEMA`` of shapes separated by bars, each with an optional ``name:``; unnamed ones are numbered.

    ``bboxes`` are lon,lat,lon,lat, ``bcircles`` lon,lat,radius in metres,
    ``bpolys`` closed rings lon,lat,lon,lat,...
    """
    out: list[tuple] = []
    for i, part in enumerate(text.split("|")):
        name, _, numbers = part.rpartition(":")
        try:
            v = [float(x) for x in numbers.split(",")]
        except ValueError as e:
            raise SpecError(f"shape {i + 1} is not a list of numbers: {part!r}") from e
        name = name.strip() or f"boundary{i + 1}"
        if kind == "bboxes":
            if len(v) != 4 or v[0] > v[2] or v[1] > v[3]:
                raise SpecError(f"shape {i + 1} is not a box: {part!r}")
            out.append((name, [[(v[0], v[1]), (v[2], v[1]), (v[2], v[3]), (v[0], v[3])]], None))
        elif kind == "bcircles":
            if len(v) != 3 or v[2] <= 0:
                raise SpecError(f"shape {i + 1} is not a circle: {part!r}")
            out.append((name, None, tuple(v)))
        elif kind == "bpolys":
            if len(v) < 8 or len(v) % 2 or v[:2] != v[-2:]:
                raise SpecError(f"shape {i + 1} is not a closed ring: {part!r}")
            out.append((name, [list(zip(v[::2], v[1::2], strict=True))], None))
        else:
            raise SpecError(f"no kind of boundary: {kind!r}")
    if len({x[0] for x in out}) < len(out):
        raise SpecError("names of boundaries repeat")
    return out


def boundary_table(spark: SparkSession, text: str, kind: str) -> DataFrame:
    return spark.createDataFrame(parse_boundaries(text, kind), SCHEMA)


def _alike(shapes: DataFrame) -> DataFrame:
    """boundary, rings, names: polygons with equal rings once, by the first of their names. Rows of one name are one polygon."""
    whole = shapes.where("rings is not null and boundary is not null").groupBy("boundary").agg(F.flatten(F.sort_array(F.collect_list("rings"))).alias("rings"))
    return whole.groupBy("rings").agg(F.collect_list("boundary").alias("names")).select(F.array_min("names").alias("boundary"), "rings", "names")


def _edges(shapes: DataFrame) -> DataFrame:
    """boundary, x1, y1, x2, y2: a ring's edges, the one that closes it included."""
    ring = shapes.where("rings is not null").select("boundary", F.explode("rings").alias("ring")).where(F.size("ring") > 2)
    ends = F.arrays_zip(F.col("ring").alias("a"), F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)).alias("b"))
    return ring.select("boundary", F.explode(ends).alias("e")).select("boundary", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")).where("x1 <> x2 or y1 <> y2")


def _at(column: Column, size: float) -> Column:
    return F.floor(column / F.lit(size)).cast("long")


def _cell(column: Column, size: float) -> Column:
    """The coarse cell, as the one that holds the fine cell."""
    return F.floor(_at(column, size / FINE) / F.lit(FINE)).cast("long")


def _fine_place(column: Column, size: float) -> Column:
    """The place of a fine cell in its coarse one."""
    return F.pmod(_at(column, size / FINE), F.lit(FINE)).cast("int")


def _row_edges(edges: DataFrame, size: float) -> DataFrame:
    """Each edge in each row of coarse cells that it touches: the cells it may touch there, and where it crosses the row's middle line."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.select("*", F.explode(F.sequence(_cell(low, size), _cell(high, size))).alias("row"))
    slope = (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))

    def x_at(y: Column) -> Column:
        return F.col("x1") + (y - F.col("y1")) * slope

    bottom, top = (F.greatest(low, F.least(high, (F.col("row") + k) * F.lit(size))) for k in (0, 1))
    flat = F.col("y1") == F.col("y2")
    slack = size * 1e-9
    left = F.when(flat, F.least("x1", "x2")).otherwise(F.least(x_at(bottom), x_at(top))) - slack
    right = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(x_at(bottom), x_at(top))) + slack
    middle = (F.col("row") + 0.5) * F.lit(size)
    crosses = (middle < F.col("y1")) != (middle < F.col("y2"))
    return rows.select("boundary", "row", "x1", "y1", "x2", "y2", _cell(left, size).alias("first"), _cell(right, size).alias("last"), F.when(crosses, x_at(middle)).alias("cross"))


def _by_fine_row(edges: Column, row: Column, size: float) -> Column:
    """The edges of a coarse row in one list, or if they are many in a list for each of its fine rows."""
    fine = size / FINE

    def touching(k: Column) -> Column:
        at = row * FINE + k
        return F.filter(edges, lambda e: (_at(F.least(e["y1"], e["y2"]), fine) <= at) & (_at(F.greatest(e["y1"], e["y2"]), fine) >= at))

    return F.when(F.size(edges) > FEW_EDGES, F.transform(F.sequence(F.lit(0), F.lit(FINE - 1)), touching)).otherwise(F.array(edges))


def cover(shapes: DataFrame, cell: float) -> DataFrame:
    """cx, cy, inside, tested, circles: the boundaries of each covered coarse cell of ``cell`` degrees.

    ``inside`` names those that hold the whole cell; ``tested`` has structs of
    the names of boundaries with equal rings and their edges (one list, or one for
    each fine row), ``circles`` of boundary and circle. A boundary takes part once
    in each of its coarse rows, so that the cover grows with the cells on borders,
    not with areas in fine cells.
    """
    alike = checkpointed(_alike(shapes))
    rows = _row_edges(_edges(alike), cell)
    edge = F.struct("x1", "y1", "x2", "y2")
    made = rows.groupBy("boundary", "row").agg(
        F.flatten(F.collect_set(F.sequence("first", "last"))).alias("border"),
        F.collect_list(F.when(F.col("y1") != F.col("y2"), edge)).alias("edges"),
        F.sort_array(F.collect_list("cross")).alias("at"),
    )
    # cells strictly between an odd crossing of the row's middle line and the next, without an edge in them
    gaps = F.transform(F.sequence(F.lit(1), F.size("at") - 1, F.lit(2)), lambda i: F.struct((_cell(F.element_at("at", i), cell) + 1).alias("a"), (_cell(F.element_at("at", i + 1), cell) - 1).alias("b")))
    within = F.flatten(F.transform(F.filter(gaps, lambda g: g["a"] <= g["b"]), lambda g: F.sequence(g["a"], g["b"])))
    empty = F.array().cast("array<bigint>")
    made = made.select("boundary", "row", F.array_distinct("border").alias("border"), _by_fine_row(F.col("edges"), F.col("row"), cell).alias("edges"), F.when(F.size("at") > 1, within).otherwise(empty).alias("within"))
    made = made.join(alike.select("boundary", "names").hint("merge"), "boundary")
    border = made.select(F.col("row").alias("cy"), F.explode("border").alias("cx"), F.lit(None).cast("array<string>").alias("inside"), F.struct("names", "edges").alias("tested"))
    inside = made.select(F.col("row").alias("cy"), F.explode(F.array_except("within", "border")).alias("cx"), F.col("names").alias("inside"), F.lit(None).alias("tested"))
    polygons = border.unionByName(inside).withColumn("circle", F.lit(None).cast("struct<boundary:string,circle:struct<x:double,y:double,r:double>>"))
    high = F.col("circle.r") / METRES_A_DEGREE * 1.001
    furthest = F.least(F.lit(89.9), F.abs("circle.y") + high)
    wide = F.least(F.lit(360.0), high / F.cos(F.radians(furthest)))
    spans = [F.sequence(_cell(F.col(f"circle.{c}") - by, cell), _cell(F.col(f"circle.{c}") + by, cell)) for c, by in (("x", wide), ("y", high))]
    circles = shapes.where("circle is not null").select("boundary", "circle", F.explode(spans[0]).alias("cx"), spans[1].alias("rows")).select("boundary", "circle", "cx", F.explode("rows").alias("cy"))
    circles = circles.select("cy", "cx", F.lit(None).cast("array<string>").alias("inside"), F.lit(None).alias("tested"), F.struct("boundary", "circle").alias("circle"))
    # collect_list leaves nulls out
    return polygons.unionByName(circles).groupBy("cx", "cy").agg(F.flatten(F.collect_list("inside")).alias("inside"), F.collect_list("tested").alias("tested"), F.collect_list("circle").alias("circles"))


def _odd(edges: Column, x: Column, y: Column) -> Column:
    """Whether a ray from a point crosses an odd number of edges."""

    def crossed(n: Column, e: Column) -> Column:
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        return n + (((y < e["y1"]) != (y < e["y2"])) & (x < at)).cast("int")

    return F.aggregate(edges, F.lit(0), crossed) % 2 == 1


def _dealt_join(rows: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """Rows with the columns of their key's one row in ``table``, if any, joined by sorting.

    ``counts`` has each key's rows as ``_n``; those of a key with more than
    ``PART_POINTS`` are dealt to as many tasks as it takes.
    """
    crowded = checkpointed(counts.select(*keys, F.ceil(F.col("_n") / PART_POINTS).cast("int").alias("_parts")).where("_parts > 1"))
    crowded = small_or_shuffled(crowded, crowded.count())
    parts = F.coalesce("_parts", F.lit(1))
    simple = [c for c, t in rows.dtypes if not t.startswith("map")]
    rows = rows.join(crowded, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*simple), parts).cast("int")).drop("_parts")
    table = table.join(crowded, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return rows.join(table.hint("merge"), [*keys, "_part"], "left").drop("_part")


def with_boundaries(points: DataFrame, shapes: DataFrame, lon: str, lat: str, cell: float = 1.0, name: str = "boundaries", joined: str | None = None) -> DataFrame:
    """Add the sorted names of the boundaries that hold each point; none for a point without a place.

    One row a point throughout. ``cell`` is the side of a coarse cell in degrees,
    about that of a usual boundary. With ``joined`` the names are one text,
    separated by it, else an array. A cover of at most ``BROADCAST_EDGES`` names
    and edges, counted, is broadcast. With a larger one each place is tested
    once, by a join with the cover by sorting, and its points then get the names
    of their place by another; the places of a cell, or the points of a place,
    that are more than ``PART_POINTS`` are dealt to as many tasks as it takes.
    """
    cells = checkpointed(cover(shapes, cell))
    entries = F.size("inside") + F.size("circles") + F.aggregate("tested", F.lit(0), lambda n, one: n + F.size(one["names"]) + F.size(F.flatten(one["edges"])))
    small = (cells.agg(F.sum(entries.cast("long")).alias("n")).first().n or 0) <= BROADCAST_EDGES
    cells = cells.select(F.col("cx").alias("_x"), F.col("cy").alias("_y"), "inside", "tested", "circles")
    x, y = F.col("_lon"), F.col("_lat")
    tested = F.filter("tested", lambda one: _odd(F.element_at(one["edges"], F.when(F.size(one["edges"]) > 1, F.col("_fine") + 1).otherwise(1)), x, y))
    near = F.filter("circles", lambda one: haversine_km(y, x, one["circle"]["y"], one["circle"]["x"]) * 1000 <= one["circle"]["r"])
    held = F.concat("inside", F.flatten(F.transform(tested, lambda one: one["names"])), F.transform(near, lambda one: one["boundary"]))
    names = F.sort_array(F.array_distinct(held))
    none = F.array().cast("array<string>") if joined is None else F.lit("")
    names = names if joined is None else F.array_join(names, joined)
    found = points.withColumns({"_lon": F.col(lon).cast("double"), "_lat": F.col(lat).cast("double")})
    at = {"_x": _cell(x, cell), "_y": _cell(y, cell), "_fine": _fine_place(y, cell)}
    if small:
        found = found.withColumns(at).join(F.broadcast(cells), ["_x", "_y"], "left").withColumn("_names", names)
    else:
        places = checkpointed(found.where("_lon is not null and _lat is not null").groupBy("_lon", "_lat").agg(F.count("*").alias("_n")))
        near_cell = places.drop("_n").withColumns(at)
        placed = _dealt_join(near_cell, cells, ["_x", "_y"], near_cell.groupBy("_x", "_y").agg(F.count("*").alias("_n")))
        found = _dealt_join(found, placed.select("_lon", "_lat", names.alias("_names")), ["_lon", "_lat"], places)
    return found.select(*points.columns, F.coalesce("_names", none).alias(name))


def series_by_boundary(points: DataFrame, shapes: DataFrame, lon: str, lat: str, ts: str, width_ms: int, cell: float = 1.0, remainder: str = "remainder", aggs: list[Any] | None = None) -> DataFrame:
    """group, bucket, n (and ``aggs``): a series for each boundary with points and one for the points in none."""
    placed = with_boundaries(points, shapes, lon, lat, cell, "_in")
    rows = placed.withColumn("group", F.explode_outer(F.when(F.size("_in") > 0, F.col("_in")))).withColumn("group", F.coalesce("group", F.lit(remainder)))
    return date_histogram(rows, ts, width_ms, aggs, groups=["group"])
