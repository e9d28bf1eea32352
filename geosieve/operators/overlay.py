"""Union of polygons of any shape per group (dissolve), from rows of edges.

No row or task holds a shape or a group. Corners are rounded to a multiple of ``precision`` and then counted in whole
units, so every test below is exact integer arithmetic:

1. Edges are turned so that the inside is on their left; copies are summed to one edge with a weight.
2. Noding: edges meet in grid cells; each is cut where another crosses or touches it. If a crossing had to be rounded,
   the pieces are noded again, until none moves.
3. Coverage: how many polygons lie on the two sides of a piece. Edges that cross the lower line of a row of cells,
   summed from the left, give the coverage at each cell's corner; from there to a piece only edges of the cell count.
4. Pieces with polygons on just one side are the border of the union. At a node each piece is followed by the next one
   clockwise, so the inside of a ring hangs together; a hole that touches its shell in one point is part of that ring.
5. Rings are told apart and put in order by pointer jumping: in each round a piece takes over what the piece known
   farthest ahead knows, so rings of any length need as many rounds as their length has binary digits.

Rows without a usable polygon take no part, NULL group keys are a group of their own, empty layers have no rings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geosieve.layer import Layer, once
from geosieve.sizing import settle

PRECISION = 0.001
SCALE = 4  # units of a rounded coordinate: grid lines and midpoints then never meet a corner
LONGEST = 1 << 28  # of an edge in rounded coordinates: products of two lengths fit 64 bits
ROUNDS = 16
JUMPS = 3  # doublings between two tables
GROUP = "_group"
ENDS = ("ax", "ay", "bx", "by")

c = F.col


def _side(edge: str, x: Column, y: Column) -> Column:
    """Positive where (x, y) is left of the edge, 0 on its line."""
    ax, ay, bx, by = (c(f"{edge}{n}") for n in ENDS)
    return (bx - ax) * (y - ay) - (by - ay) * (x - ax)


def _forward(rows: DataFrame) -> DataFrame:
    """Each edge from its lesser end to the other; weight: polygons on its left less those on its right, not 0."""
    back = (c("ax") > c("bx")) | ((c("ax") == c("bx")) & (c("ay") > c("by")))
    turned = {n: F.when(back, c(o)).otherwise(c(n)) for n, o in zip(ENDS, ("bx", "by", "ax", "ay"))}
    rows = rows.where((c("ax") != c("bx")) | (c("ay") != c("by")))
    rows = rows.select(GROUP, *[v.alias(n) for n, v in turned.items()],
                       F.when(back, -c("weight")).otherwise(c("weight")).alias("weight"))
    return rows.groupBy(GROUP, *ENDS).agg(F.sum("weight").alias("weight")).where("weight <> 0")


def polygon_edges(layer: Layer, by: Sequence[str], precision: float = PRECISION) -> DataFrame:
    """(group, ax, ay, bx, by, weight) of all polygons, in units of ``precision`` / 4."""
    shape = layer.geometry.shape()
    rows = layer.df.where(layer.geometry.present() & shape["type"].endswith("POLYGON")).select(
        F.struct(*[c(x) for x in by]).alias(GROUP), F.explode(shape["parts"]).alias("part"))
    rows = rows.select(GROUP, F.posexplode("part").alias("nth", "ring"))
    unit = lambda v: (F.round(v / precision) * SCALE).cast("long")
    ring = F.transform("ring", lambda p: F.struct(unit(p["x"]).alias("x"), unit(p["y"]).alias("y")))
    edge = F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda p, q: F.struct(
        p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))
    rows = rows.where(F.size("ring") > 3).select(GROUP, "nth", F.explode(F.array(ring)).alias("ring"))
    rows = rows.select(GROUP, "nth", F.explode(F.array(edge)).alias("edges"), c("ring")[0].alias("o"))
    double_area = F.aggregate("edges", F.lit(0.0), lambda s, e: s + (
        (e["ax"] - c("o")["x"]).cast("double") * (e["by"] - c("o")["y"])
        - (e["bx"] - c("o")["x"]).cast("double") * (e["ay"] - c("o")["y"])))
    inside_left = (double_area > 0) == (c("nth") == 0)
    rows = rows.select(GROUP, F.when(inside_left, 1).otherwise(-1).cast("long").alias("weight"), F.explode("edges").alias("e"))
    rows = rows.select(GROUP, "e.*", "weight")
    long = (F.abs(c("bx") - c("ax")) > LONGEST * SCALE) | (F.abs(c("by") - c("ay")) > LONGEST * SCALE)
    checked = F.when(long, F.raise_error(F.lit("an edge is too long for this precision")).cast("long"))
    return _forward(rows.withColumn("weight", F.coalesce(checked, "weight")))


def cell_size(edges: DataFrame) -> int:
    """A power of 2 about twice the mean extent of the edges, in their units."""
    mean = edges.agg(F.avg(F.greatest(F.abs(c("bx") - c("ax")), F.abs(c("by") - c("ay"))))).first()[0]
    return 1 << max(3, int(2 * (mean or 1)).bit_length())


def _cell(v: Column, size: int) -> Column:
    """Cell k reaches from line ``k * size - 1`` to the next."""
    return F.floor((v + 1) / size).cast("long")


def _line(k: Column, size: int) -> Column:
    return k * size - 1


def _in_cells(edges: DataFrame, size: int) -> DataFrame:
    """A row per edge and cell it may touch."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = edges.select("*", F.explode(F.sequence(_cell(low, size), _cell(high, size))).alias("cy"))
    slope = (c("bx") - c("ax")) / F.nullif((c("by") - c("ay")).cast("double"), F.lit(0.0))  # level: null

    def at(y: Column) -> Column:
        return c("ax") + (F.greatest(low, F.least(high, y)) - c("ay")) * slope

    rows = once(rows, "x", F.struct(at(_line(c("cy"), size)).alias("p"), at(_line(c("cy") + 1, size)).alias("q")))
    first = F.greatest(F.coalesce(F.floor(F.least("x.p", "x.q")) - 2, "ax").cast("long"), "ax")
    last = F.least(F.coalesce(F.ceil(F.greatest("x.p", "x.q")) + 2, "bx").cast("long"), "bx")
    return rows.select("*", F.explode(F.sequence(_cell(first, size), _cell(F.greatest(first, last), size))).alias("cx")).drop("x")


def _named(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(GROUP, "cx", "cy", *[c(n).alias(f"{prefix}{n}") for n in (*ENDS, "weight")])


def _cuts(edges: DataFrame, size: int) -> DataFrame:
    """(group, edge, x, y, rounded): points inside an edge where another one crosses or touches it."""
    cells = _in_cells(edges, size)
    one, two = _named(cells, "e"), _named(cells, "f")
    ends = [F.struct(*[c(f"{p}{n}") for n in ENDS]) for p in "ef"]
    meet = [F.least(c("eay"), c("eby")) <= F.greatest(c("fay"), c("fby")),
            F.least(c("fay"), c("fby")) <= F.greatest(c("eay"), c("eby")),
            c("eax") <= c("fbx"), c("fax") <= c("ebx"), ends[0] != ends[1]]
    pairs = one.join(two, [GROUP, "cx", "cy"])
    for test in meet:
        pairs = pairs.where(test)
    ea, eb = _side("f", c("eax"), c("eay")), _side("f", c("ebx"), c("eby"))
    fa, fb = _side("e", c("fax"), c("fay")), _side("e", c("fbx"), c("fby"))
    pairs = once(pairs, "s", F.struct(ea.alias("ea"), eb.alias("eb"), fa.alias("fa"), fb.alias("fb"))).select("*", "s.*")
    # a line that leaves both ends of the other on one side does not meet it
    apart = (F.signum("ea") * F.signum("eb") > 0) | (F.signum("fa") * F.signum("fb") > 0)
    pairs = pairs.where(~apart)
    share = c("ea").cast("double") / F.nullif(c("ea") - c("eb"), F.lit(0))
    crossing = [(F.round((c(f"ea{n}") + share * (c(f"eb{n}") - c(f"ea{n}"))) / SCALE) * SCALE).cast("long") for n in "xy"]
    crosses = (F.signum("ea") * F.signum("eb") < 0) & (F.signum("fa") * F.signum("fb") < 0)

    def point(x: Column, y: Column, rounded: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), rounded.alias("rounded"))

    def on_edge(x: Column, y: Column) -> Column:
        low, high = F.least("eay", "eby"), F.greatest("eay", "eby")
        return x.between(c("eax"), c("ebx")) & y.between(low, high)

    fax, fay, fbx, fby = (c(f"f{n}") for n in ENDS)
    off = (_side("e", *crossing) != 0) | (_side("f", *crossing) != 0)
    found = F.array(F.when(crosses, point(*crossing, off)),
                    F.when((c("fa") == 0) & on_edge(fax, fay), point(fax, fay, F.lit(False))),
                    F.when((c("fb") == 0) & on_edge(fbx, fby), point(fbx, fby, F.lit(False))))
    cuts = pairs.select(GROUP, *[c(f"e{n}").alias(n) for n in ENDS], c("eweight").alias("weight"), F.explode(found).alias("p"))
    cuts = cuts.where("p IS NOT NULL").select(GROUP, *ENDS, "weight", "p.*")
    inside = ((c("x") != c("ax")) | (c("y") != c("ay"))) & ((c("x") != c("bx")) | (c("y") != c("by")))
    return cuts.where(inside | c("rounded")).groupBy(GROUP, *ENDS, "weight", "x", "y").agg(F.max("rounded").alias("rounded"))


def _pieces(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """The edges cut at their points, each a row per stretch between neighbouring points."""
    ends = edges.select(GROUP, *ENDS, "weight", F.explode(F.array(
        F.struct(c("ax").alias("x"), c("ay").alias("y")), F.struct(c("bx").alias("x"), c("by").alias("y")))).alias("p"))
    points = ends.select(GROUP, *ENDS, "weight", "p.*").union(cuts.drop("rounded"))
    along = Window.partitionBy(GROUP, *ENDS).orderBy("x", c("y") * F.signum(c("by") - c("ay")))
    rows = points.select(GROUP, "weight", c("x").alias("px"), c("y").alias("py"), F.lead("x").over(along).alias("qx"),
                         F.lead("y").over(along).alias("qy")).where("qx IS NOT NULL")
    return _forward(rows.select(GROUP, c("px").alias("ax"), c("py").alias("ay"), c("qx").alias("bx"), c("qy").alias("by"),
                                "weight"))


def noded(edges: DataFrame, size: int, rounds: int = ROUNDS) -> DataFrame:
    """The edges cut into pieces that meet at their ends only."""
    for _ in range(rounds):
        cuts = settle(_cuts(edges, size))
        edges = settle(_pieces(edges, cuts))
        if not cuts.agg(F.max("rounded")).first()[0]:
            return edges
    raise ValueError(f"edges still cross after {rounds} rounds: take a finer precision")


def _corner_coverage(pieces: DataFrame, size: int) -> DataFrame:
    """(group, cx, cy, base): coverage at the lower left corner of each cell that holds the middle of a piece."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    first, last = _cell(low, size) + 1, _cell(high, size)
    rows = pieces.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("cy"))
    rows = rows.withColumn("line", _line(c("cy"), size))
    near = _cell(F.floor(c("ax") + (c("line") - c("ay")) * ((c("bx") - c("ax")) / F.nullif((c("by") - c("ay")).cast("double"), F.lit(0.0)))), size)
    rising = c("by") > c("ay")

    def beyond(k: Column) -> Column:
        """The edge meets the row's line left of cell line k."""
        side = _side("", _line(k, size), c("line"))
        return F.when(rising, side < 0).otherwise(side > 0)

    exact = F.when(beyond(c("near")), c("near") - 1).when(~beyond(c("near") + 1), c("near") + 1).otherwise(c("near"))
    crossings = rows.withColumn("near", near).select(
        GROUP, "cy", exact.alias("cx"), F.when(rising, -c("weight")).otherwise(c("weight")).alias("step"))
    cells = _middles(pieces, size).select(GROUP, "cy", "cx", F.lit(0).cast("long").alias("step"), F.lit(True).alias("asked"))
    cells = crossings.withColumn("asked", F.lit(False)).union(cells).groupBy(GROUP, "cy", "cx").agg(
        F.sum("step").alias("step"), F.max("asked").alias("asked"))
    left = Window.partitionBy(GROUP, "cy").orderBy("cx").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("step").over(left), F.lit(0)))
    return cells.where("asked").select(GROUP, "cx", "cy", "base")


def _middles(pieces: DataFrame, size: int) -> DataFrame:
    rows = pieces.withColumns({"mx": ((c("ax") + c("bx")) / 2).cast("long"), "my": ((c("ay") + c("by")) / 2).cast("long")})
    return rows.withColumns({"cx": _cell(c("mx"), size), "cy": _cell(c("my"), size)})


def covered(pieces: DataFrame, size: int) -> DataFrame:
    """The pieces with ``left`` and ``right``: how many polygons lie on either side."""
    middles = _middles(pieces, size)
    near = _named(_in_cells(pieces, size), "f")
    x0, y0, mx, my = _line(c("cx"), size), _line(c("cy"), size), c("mx"), c("my")
    rising, falling = c("fby") > c("fay"), c("fby") < c("fay")
    start = _side("f", x0, y0)
    # up the cell's left line to the height of the middle, then to the right; levels count as just above themselves
    up = (c("fax") < x0) & (x0 < c("fbx")) & ((start < 0) | ((start == 0) & falling)) & (_side("f", x0, my) >= 0)
    level = (c("fay") <= my) != (c("fby") <= my)
    right = level & F.when(rising, (_side("f", mx, my) < 0) & (_side("f", x0, my) >= 0)).otherwise(
        (_side("f", mx, my) > 0) & (_side("f", x0, my) < 0))
    step = F.when(up, c("fweight")).otherwise(0) + F.when(right, F.when(rising, -c("fweight")).otherwise(c("fweight"))).otherwise(0)
    steps = middles.join(near, [GROUP, "cx", "cy"]).select(GROUP, *ENDS, "weight", step.alias("step"))
    base = middles.join(_corner_coverage(pieces, size), [GROUP, "cx", "cy"]).select(
        GROUP, *ENDS, "weight", c("base").alias("step"))
    sums = steps.union(base).groupBy(GROUP, *ENDS, "weight").agg(F.sum("step").alias("lower"))
    # what is summed is the coverage on the side of lesser x; of a level piece, that above it
    drop = c("by") < c("ay")
    return sums.select(GROUP, *ENDS, F.when(drop, c("lower") + c("weight")).otherwise(c("lower")).alias("left"),
                       F.when(drop, c("lower")).otherwise(c("lower") - c("weight")).alias("right"))


def dissolve_edges(layer: Layer, by: Sequence[str], precision: float = PRECISION, cell: int | None = None) -> DataFrame:
    """(group, ax, ay, bx, by): the border of the union of each group's polygons, the inside on the left."""
    edges = settle(polygon_edges(layer, by, precision))
    size = cell or cell_size(edges)
    sides = covered(noded(edges, size), size).where((c("left") > 0) != (c("right") > 0))
    turned = {n: F.when(c("left") > 0, c(n)).otherwise(c(o)) for n, o in zip(ENDS, ("bx", "by", "ax", "ay"))}
    return sides.select(GROUP, *[v.alias(n) for n, v in turned.items()])


def followed(edges: DataFrame) -> DataFrame:
    """The directed edges with an ``id`` and the id that comes ``next`` in their ring."""
    edges = settle(edges.withColumn("id", F.monotonically_increasing_id()))
    away = F.atan2((c("by") - c("ay")).cast("double"), (c("bx") - c("ax")).cast("double"))
    back = F.atan2((c("ay") - c("by")).cast("double"), (c("ax") - c("bx")).cast("double"))
    rays = edges.select(GROUP, c("ax").alias("x"), c("ay").alias("y"), "id", away.alias("angle"), F.lit(True).alias("out")).union(
        edges.select(GROUP, c("bx").alias("x"), c("by").alias("y"), "id", back.alias("angle"), F.lit(False).alias("out")))
    # borders that arrive and leave alternate around a node
    node = Window.partitionBy(GROUP, "x", "y").orderBy(c("angle").desc(), "out")
    after = F.coalesce(F.lead("id").over(node), F.first("id").over(node))
    links = rays.withColumn("next", after).where("NOT out").select("id", "next")
    return edges.join(links, "id")


def traced(edges: DataFrame) -> DataFrame:
    """The edges with ``ring`` (the least id in it) and ``place`` (0 for that edge, then along the ring).

    Each edge knows the least id among so many edges from it on, how many steps ahead that is, and which edge comes
    after these; a join with that edge's knowledge doubles it. Once nobody learns of a lesser id, the rings are covered.
    """
    edges = settle(followed(edges))
    ahead = edges.select("id", "next", c("id").alias("ring"), F.lit(0).cast("long").alias("left"), F.lit(1).cast("long").alias("span"))
    while True:
        wider = ahead.withColumn("was", c("ring"))
        for _ in range(JUMPS):
            far = wider.select(c("id").alias("next"), c("next").alias("far"), c("ring").alias("theirs"), c("left").alias("more"))
            lesser = c("theirs") < c("ring")
            wider = wider.join(far, "next").select(
                "id", c("far").alias("next"), F.when(lesser, c("theirs")).otherwise(c("ring")).alias("ring"),
                F.when(lesser, c("span") + c("more")).otherwise(c("left")).alias("left"), (c("span") * 2).alias("span"), "was")
        wider = settle(wider)
        ahead = wider.drop("was")
        if wider.where("was <> ring").isEmpty():
            break
    sizes = ahead.groupBy("ring").agg(F.count("*").alias("n"))
    places = ahead.join(sizes, "ring").select("id", "ring", F.pmod(c("n") - c("left"), c("n")).alias("place"))
    return edges.drop("next").join(places, "id").drop("id")


def dissolve(layer: Layer, by: Sequence[str], precision: float = PRECISION, cell: int | None = None) -> DataFrame:
    """The rings of the union of each group's polygons as rows: (by..., ring, place, x, y, hole).

    Corners where the border does not bend are left out. A ring closes from its last place to its first.
    """
    edges = traced(dissolve_edges(layer, by, precision, cell))
    turn = c("ax").cast("double") * c("by") - c("bx").cast("double") * c("ay")
    kinds = edges.groupBy("ring").agg((F.sum(turn) < 0).alias("hole"), F.max("place").alias("top"),
                                      F.max_by(F.struct("ax", "ay"), "place").alias("end"))
    # the edge before the first one of a ring is its last one
    order = Window.partitionBy("ring", "bucket").orderBy("place")
    rows = edges.join(kinds, "ring").withColumn("bucket", F.floor(c("place") / RING_ROWS))
    seams = rows.where(F.pmod(c("place") + 1, F.lit(RING_ROWS)) == 0).select(
        "ring", (c("bucket") + 1).alias("bucket"), F.struct("ax", "ay").alias("seam"))
    rows = rows.join(seams, ["ring", "bucket"], "left").withColumn("before", F.coalesce(
        F.lag(F.struct("ax", "ay")).over(order), F.when(c("place") == 0, c("end")).otherwise(c("seam"))))
    bend = (c("ax") - c("before.ax")) * (c("by") - c("ay")) - (c("ay") - c("before.ay")) * (c("bx") - c("ax"))
    units = SCALE / precision
    return rows.where(bend != 0).select(*[c(GROUP)[x].alias(x) for x in by], "ring", "place", (c("ax") / units).alias("x"),
                                        (c("ay") / units).alias("y"), "hole")


RING_ROWS = 1 << 16  # a ring is put in order in stretches of so many edges


def dissolve_measures(rings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: area, perimeter, and the numbers of shells, holes and corners of ``dissolve`` rows."""
    bucket = F.floor(c("place") / RING_ROWS)
    keys = [*by, "ring", "_bucket"]
    order = Window.partitionBy("ring", "_bucket").orderBy("place")
    rows = rings.withColumn("_bucket", bucket)
    firsts = rows.groupBy("ring", "_bucket").agg(F.min_by(F.struct("x", "y"), "place").alias("_first"))
    after = Window.partitionBy("ring").orderBy("_bucket")
    firsts = firsts.withColumn("_seam", F.coalesce(F.lead("_first").over(after), F.first("_first").over(after))).drop("_first")
    rows = rows.join(firsts, ["ring", "_bucket"]).withColumn("_to", F.coalesce(F.lead(F.struct("x", "y")).over(order), "_seam"))
    per_ring = rows.groupBy(*keys[:-1]).agg(
        F.sum((c("x") * c("_to.y") - c("_to.x") * c("y")) / 2).alias("area"),
        F.sum(F.hypot(c("_to.x") - c("x"), c("_to.y") - c("y"))).alias("perimeter"),
        F.max(c("hole").cast("int")).cast("long").alias("hole"), F.count("*").alias("corners"))
    return per_ring.groupBy(*by).agg(
        F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"), F.sum(1 - c("hole")).alias("n_shells"),
        F.sum("hole").alias("n_holes"), F.sum("corners").alias("n_corners"))
