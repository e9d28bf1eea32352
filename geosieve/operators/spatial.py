"""Spatial semi-joins, pairs, proximity and disjoint filters.

How a pair is found. Every row has a level: the power of 4 that its longest side fits in. A pair meets
at the higher of its two levels, on a grid whose cells are a fraction of that power. A target is keyed by
the one cell of its lower left corner; a source lists the cells in which the corner of a matching target
may lie, a bounded number of them whatever its size. So the join is a plain equi-join on cells that
Catalyst broadcasts or shuffles, targets are never multiplied, and a pair is found exactly once. The
exact predicate is part of the join condition and stops at the first hit in a semi-join.

For point targets the cells of a polygon know whether they are crossed by its border: inner cells need no
test, outer cells are dropped, and crossed cells keep only the edges that matter to them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geosieve.functions import geometry as geo
from geosieve.functions import predicates as pr
from geosieve.functions.crs import HALF_WORLD, METRIC, is_geographic, mercator_reach, metre_bounds_sql, metre_gap_sql, reproject
from geosieve.functions.relate import flat_edges, flat_relation, relation_holds
from geosieve.layer import Layer, PointColumns, once
from geosieve.sizing import (BROADCAST_BYTES, BROADCAST_ROWS, HOT_SAMPLE_ROWS, SAMPLE_ONE_IN, checkpoint_dir, hot_keys,
                             salt_sides, settle, sized_join)

BASE = 4
LOWEST_LEVEL = -10
HIGHEST_LEVEL = 15  # of a stream's targets: a thousand million units
SLACK = 1 + 1e-9
TILE_BYTES = 96
SMALL_SOURCE_ROWS = 100
DENSE = 4  # sources in a cell, from which on it is worth leaving out those that others cover there
MAX_STRETCHES = 256  # of an edge of a long line
PIECE = "_piece"  # box of a stretch of a line
METRES, REACH = "_metres", "_reach"  # of a source row: its radius on the ellipsoid, and what holds it in 3857
FROM, SHIFT = "_from", "_shift"  # its place, and how far round the world this copy of it was moved

Radius = float | int | str | Column | None


@dataclass(frozen=True)
class Grid:
    """How finely one level is cut, and how many levels below it are matched on it too."""

    per_side: int
    span: int


# a broadcast source may be cut finer than one that has to be shuffled cell by cell
BROADCAST_GRID = {"point": Grid(8, 3), "wide": Grid(4, 3)}
SHUFFLE_GRID = {"point": Grid(4, 2), "wide": Grid(2, 2)}


@dataclass(frozen=True)
class JoinPlan:
    """What a spatial join needs to know about the sizes of its sides."""

    source_levels: tuple[int, ...]
    target_levels: tuple[int, ...]
    per_side: int
    strategy: str
    source_rows: int = 0
    tiles: int = 0
    hot: tuple[tuple[int, int, int, int], ...] = ()  # (level, x, y, salts) of crowded cells, at most 512
    extent: tuple[float, float, float, float] | None = None  # of the grown source boxes, when the plan was made
    sides: tuple[tuple[int, float, float], ...] = ()  # (level, widest, highest) of the targets, when the plan was made
    current: bool = False  # the source is as it was then, so the extent may prune
    thinned: tuple[DataFrame, ...] = field(default=(), compare=False, repr=False)  # per source level: see ``_thinned``

    @property
    def levels(self) -> tuple[int, ...]:
        if not self.source_levels:
            return ()
        lowest = min(self.source_levels)
        return tuple(sorted(set(self.source_levels) | {lv for lv in self.target_levels if lv > lowest}))

    def grouped(self, level: str, side: str) -> str:
        """SQL for the level a row is matched on: the lowest one of its side that is not below its own."""
        steps = self.source_levels if side == "source" else self.target_levels
        if not steps:
            return level
        # a plan made before the data grew still places every row
        return "CASE " + " ".join(f"WHEN {level} <= {s} THEN {s}" for s in steps) + f" ELSE {level} END"

    def hot_cells(self, spark: SparkSession, level: int | None = None) -> DataFrame | None:
        rows = [h for h in self.hot if level in (None, h[0])]
        return spark.createDataFrame(rows, "_lv int, _scx long, _scy long, _salts int") if rows else None

    def target_cells(self) -> str:
        """SQL array of structs: the cell of a target on each level it may meet a source on."""
        cells = [f"named_struct('lv', {lv}, 'cx', floor(_tx0 / {self.cell(lv)!r}D), 'cy', "
                 f"floor(_ty0 / {self.cell(lv)!r}D))" for lv in self.levels]
        if len(cells) == 1:
            return f"array({cells[0]})"
        return f"filter(array({', '.join(cells)}), c -> c.lv = _tlvl OR (c.lv > _tlvl AND c.lv IN {self._listed()}))"

    def _listed(self) -> str:
        return f"({', '.join(str(lv) for lv in self.source_levels)})"

    def joins(self, level: int) -> str:
        """SQL: the target may meet a source on this level; on those without sources only as the larger one."""
        return f"_tlvl {'<=' if level in self.source_levels else '='} {level}"

    def reach(self, level: int) -> tuple[float, float]:
        """Longest sides, across and up, of the targets that are matched on ``level``."""
        if self.sides:
            found = [(x, y) for lv, x, y in self.sides if lv <= level]
            return max((x for x, _ in found), default=0.0) * SLACK, max((y for _, y in found), default=0.0) * SLACK
        side = max((float(BASE) ** lv for lv in self.target_levels if lv <= level), default=0.0) * SLACK
        return side, side

    def cell(self, level: int) -> float:
        return float(BASE) ** level / self.per_side

    def crowded(self) -> bool:
        """A cell of the largest sources lies in several ones on average."""
        if self.extent is None or not self.source_levels:
            return False
        left, low, right, high = self.extent
        side = self.cell(max(self.source_levels))
        cells = ((right - left) / side + 1) * ((high - low) / side + 1)
        return self.tiles >= DENSE * cells


def group_levels(levels: dict[int, int], span: int, absorb: float = 0.0) -> dict[int, int]:
    """Each level with the level it is matched on: runs of ``span`` levels, from the top.

    ``levels`` counts the rows of each. The level below a run joins it when it holds at most the share
    ``absorb`` of all rows: a join less is worth a few more candidates.
    """
    groups: dict[int, int] = {}
    total, top = sum(levels.values()), None
    for level in sorted(levels, reverse=True):
        few = top is not None and level == top - span and levels[level] <= absorb * total
        if top is None or (level <= top - span and not few):
            top = level
        groups[level] = top
    return groups


# --- sides -----------------------------------------------------------------------------------------


def level_of(side: str) -> str:
    log4 = f"greatest(ceil(ln({side}) / 1.3862943611198906D), {LOWEST_LEVEL})"
    return f"cast(if({side} <= 0, {LOWEST_LEVEL}, {log4}) AS int)"


def as_points(layer: Layer, mode: str = "point_on_surface") -> Layer:
    """The layer with one point per row: ``point_on_surface`` or ``centroid``."""
    if isinstance(layer.geometry, PointColumns):
        return layer
    pick = {"point_on_surface": geo.point_on_surface, "centroid": geo.centroid}[mode]
    p = pick(layer.geometry.shape())
    df = once(layer.df, "_p", p).withColumns({"_px": F.col("_p")["x"], "_py": F.col("_p")["y"]}).drop("_p")
    return Layer(df, layer.pk, PointColumns("_px", "_py"), layer.crs, layer.name)


def _working(layer: Layer, points: str | None, metric: bool) -> Layer:
    """A copy of the layer whose geometry may be replaced; the original columns stay as they are."""
    if points:
        layer = as_points(layer, points)
    if metric and is_geographic(layer.crs):
        spare = {c: f"_m_{c}" for c in layer.geometry.columns}
        df = layer.df.withColumns({new: F.col(old) for old, new in spare.items()})
        g = type(layer.geometry)(*spare.values())
        layer = reproject(Layer(df, layer.pk, g, layer.crs, layer.name), METRIC)
    return layer


def _radius(radius: Radius) -> Column:
    if radius is None:
        return F.lit(0.0)
    if isinstance(radius, Column):
        return radius.cast("double")
    return F.col(radius).cast("double") if isinstance(radius, str) else F.lit(float(radius))


def _boxes(layer: Layer) -> tuple[DataFrame, Column, tuple[Column, ...]]:
    """The rows, the test for a geometry, and the bounding box; shapes are taken apart once per row."""
    g = layer.geometry
    if g.kind != "shape":
        return layer.df, g.present(), tuple(c.cast("double") for c in g.bbox())
    if PIECE in layer.df.columns:  # of shapes with a geometry only
        return layer.df, F.lit(True), tuple(F.col(f"{PIECE}.{n}") for n in ("x0", "y0", "x1", "y1"))
    name = f"`{g.name}`"
    v = f"flatten(flatten({name}.parts))"
    info = F.expr(
        f"named_struct('x0', array_min({v}.x), 'y0', array_min({v}.y), 'x1', array_max({v}.x), 'y1', array_max({v}.y), "
        f"'edges', {geo.edges_sql(name)}, 'ends', {geo.line_ends_sql(name)})")
    box = tuple(F.col(f"_info.{n}") for n in ("x0", "y0", "x1", "y1"))
    present = F.expr(" AND ".join(f"coalesce(_info.{n} - _info.{n} = 0, false)" for n in ("x0", "y0", "x1", "y1")))
    return once(layer.df, "_info", info), present, box


def _cut_lines(target: Layer, source: Layer, plan: JoinPlan) -> Layer | None:
    """The layer with each line once per stretch of an edge that is about as long as a source, and the stretch's box.

    A common point lies in some stretch, so only sources near the line are looked at, not all in its bounding box. The
    exact test still takes the whole shape. Polygons stay in one piece.
    """
    if target.geometry.kind != "shape" or plan.extent is None:
        return None
    left, low, right, high = plan.extent
    mean = _source_side(source, None, False).agg(F.expr("avg(greatest(_sx1 - _sx0, _sy1 - _sy0))")).first()[0]
    step = max(mean, (right - left) / MAX_STRETCHES, (high - low) / MAX_STRETCHES)
    if step <= 0:
        return None
    df, present, box = _boxes(target)
    n = f"greatest(least(ceil(greatest(abs(e.x2 - e.x1), abs(e.y2 - e.y1)) / {step!r}D), {MAX_STRETCHES}), 1)"

    def side(c: str, pick: str, sign: str) -> str:
        ends = [f"e.{c}1 + (e.{c}2 - e.{c}1) * ({i}) / {n}" for i in ("i", "i + 1")]
        return f"{pick}({', '.join(ends)}) {sign} 1e-12D * greatest(abs(e.{c}1), abs(e.{c}2))"

    stretch = (f"named_struct('x0', {side('x', 'least', '-')}, 'y0', {side('y', 'least', '-')}, "
               f"'x1', {side('x', 'greatest', '+')}, 'y1', {side('y', 'greatest', '+')})")
    lines = f"flatten(transform(_info.edges, e -> transform(sequence(0L, {n} - 1L), i -> {stretch})))"
    whole = "array(named_struct('x0', _info.x0, 'y0', _info.y0, 'x1', _info.x1, 'y1', _info.y1))"
    pieces = f"explode(if(`{target.geometry.name}`.type LIKE '%LINESTRING', {lines}, {whole})) AS {PIECE}"
    return target.with_df(df.where(present).selectExpr("*", pieces))


def _source_side(source: Layer, radius: Radius, keep_shape: bool, plan: JoinPlan | None = None) -> DataFrame:
    df, present, box = _boxes(source)
    columns = [F.col(k).alias(f"_s_{k}") for k in source.pk]
    columns += [c.alias(n) for n, c in zip(("_sx0", "_sy0", "_sx1", "_sy1"), box)]
    columns.append(_radius(radius).alias("_sr"))
    columns += [F.col(METRES), F.col(FROM), F.col(SHIFT)] if METRES in source.df.columns else []
    if source.geometry.kind == "shape" and not keep_shape:
        columns += [F.col(f"`{source.geometry.name}`.type").alias("_stype"), F.col("_info.edges").alias("_sedges"),
                    F.col("_info.ends").alias("_sends")]
    if keep_shape:
        columns.append(source.geometry.shape().alias("_sgeom"))
    # a NULL radius is a NULL buffer: no match
    df = df.where(present).select(*columns).where("_sr IS NOT NULL")
    edges = [f"{geo.edges_sql('_sgeom')} AS _sgedges"] if keep_shape else []
    df = df.selectExpr("*", f"greatest(_sr, 0D) * {SLACK!r}D AS _spad", *edges)
    level = level_of("(greatest(_sx1 - _sx0, _sy1 - _sy0) + 2 * _spad)")
    return df.selectExpr("*", f"{plan.grouped(level, 'source') if plan else level} AS _slvl")


def _near_extent(target: Layer, plan: JoinPlan) -> Layer:
    """Only targets whose box meets the source's: plain comparisons of the columns, which the scan can prune by."""
    if plan.extent is None or target.geometry.kind == "shape":
        return target
    x0, y0, x1, y1 = target.geometry.bbox()
    left, low, right, high = plan.extent
    return target.where((x0 <= right) & (x1 >= left) & (y0 <= high) & (y1 >= low))


def _target_side(target: Layer, keep_shape: bool, plan: JoinPlan | None = None) -> DataFrame:
    df, present, box = _boxes(target)
    columns = dict(zip(("_tx0", "_ty0", "_tx1", "_ty1"), box))
    if keep_shape:
        columns["_tgeom"] = target.geometry.shape()
    df = df.where(present).withColumns(columns)
    if target.geometry.kind == "point":
        return df.withColumn("_tlvl", F.lit(LOWEST_LEVEL))
    level = level_of("greatest(_tx1 - _tx0, _ty1 - _ty0)")
    return df.withColumn("_tlvl", F.expr(plan.grouped(level, "target") if plan else level))


def plan_join(target: Layer, source: Layer, radius: Radius = None, strategy: str = "auto",
              one_in: int = SAMPLE_ONE_IN, floor: int = HOT_SAMPLE_ROWS, names=()) -> JoinPlan:
    """Measure both sides: one aggregate over the source, and one over targets that are not points.

    With ``names``, the plan is for a filter by these predicates only: where sources crowd, cells keep but those that decide
    something there (``_thinned``), and what is left is measured again.

    Each returns one row per level. A stream's targets are not measured but matched on a fixed ladder of levels. The source is broadcast only when its number of tiles and their bytes
    are known to be small. Otherwise a sample of the targets tells which cells are crowded (see
    ``hot_keys``); those are salted.
    """
    side = _source_side(source, radius, False)
    wide = target.geometry.kind != "point"
    grid_kind = "wide" if wide else "point"
    target_found: dict[int, int] = {}
    longest: dict[int, tuple[float, float]] = {}
    if wide and not target.df.isStreaming:
        measured = _target_side(target, False).groupBy("_tlvl").agg(
            F.count("*"), F.expr("max(_tx1 - _tx0)"), F.expr("max(_ty1 - _ty0)")).collect()
        target_found, longest = {r[0]: r[1] for r in measured}, {r[0]: (r[2], r[3]) for r in measured}
    edges = "size(_sedges)" if source.geometry.kind == "shape" else "0"

    def cells(grid: Grid, up: int) -> str:
        # cells a row lists when it is matched ``up`` levels above its own, targets' reach included
        scale = f"{float(grid.per_side)!r}D / pow({float(BASE)!r}D, _slvl + {up})"
        more = grid.per_side + 2 if wide else 2
        x, y = (f"(floor((_s{c}1 - _s{c}0 + 2 * _spad) * {scale}) + {more})" for c in "xy")
        return f"({x} * {y})"

    sums = [F.count("*").alias("n"), F.expr(f"sum({edges})").alias("edges")]
    for name, grid in (("b", BROADCAST_GRID[grid_kind]), ("s", SHUFFLE_GRID[grid_kind])):
        for up in range(grid.span + (name == "b")):
            sums.append(F.expr(f"sum({cells(grid, up)})").alias(f"{name}{up}"))
            if edges != "0":
                sums.append(F.expr(f"sum({cells(grid, up)} * {edges})").alias(f"{name}{up}_edges"))
    sums += [F.expr(f"{f}(_s{c} {sign} _spad)").alias(f"e_{c}") for f, c, sign in (
        ("min", "x0", "-"), ("min", "y0", "-"), ("max", "x1", "+"), ("max", "y1", "+"))]
    found = {r["_slvl"]: r.asDict() for r in side.groupBy("_slvl").agg(*sums).collect()}
    if wide and target.df.isStreaming:
        # what a stream will bring is not known: every size from the smallest source up has a level it is matched on
        target_found = dict.fromkeys(range(min(found, default=HIGHEST_LEVEL), HIGHEST_LEVEL + 1), 0)
    extent = tuple(f(r[f"e_{c}"] for r in found.values()) for f, c in (
        (min, "x0"), (min, "y0"), (max, "x1"), (max, "y1"))) if found else None

    def layout(name: str, grid: Grid) -> tuple[JoinPlan, int]:
        counts = {lv: target_found.get(lv, 0) + (found[lv]["n"] if lv in found else 0)
                  for lv in {*found, *target_found}}
        groups = group_levels(counts, grid.span, 1 / 16 if name == "b" else 0)
        source_levels = tuple(sorted({groups[lv] for lv in found}))
        target_levels = tuple(sorted({groups[lv] for lv in target_found}))
        tiles = size = 0
        for level, r in found.items():
            up = groups[level] - level
            higher = sum(lv > groups[level] for lv in target_levels) * (grid.per_side + 3) ** 2
            tiles += r[f"{name}{up}"] + r["n"] * higher
            size += 32 * (r.get(f"{name}{up}_edges", 0) + r["edges"] * higher)
        n = sum(r["n"] for r in found.values())
        plan = JoinPlan(source_levels, target_levels, grid.per_side, "broadcast" if name == "b" else "shuffle", n, tiles,
                        extent=extent, sides=tuple((groups[lv], *size) for lv, size in sorted(longest.items())))
        return plan, size + tiles * TILE_BYTES

    plan, size = layout("b", BROADCAST_GRID[grid_kind])
    if strategy == "broadcast" or (strategy == "auto" and plan.tiles <= BROADCAST_ROWS and size <= BROADCAST_BYTES):
        return plan
    # without a shared folder the parts of it would be worked out again and again
    if strategy == "auto" and _can_thin(names, target, source, radius) and plan.crowded() and checkpoint_dir(side.sparkSession):
        tiles = _thinned(source, radius, plan)
        n, edges = (sum(x) for x in zip(*(t.agg(F.count("*"), F.expr(
            "coalesce(sum(size(_sedges)), 0)" if source.geometry.kind == "shape" else "0L")).first() for t in tiles)))
        if n <= BROADCAST_ROWS and n * TILE_BYTES + 32 * edges <= BROADCAST_BYTES:
            return replace(plan, tiles=n, thinned=tiles)
    plan, size = layout("s", SHUFFLE_GRID[grid_kind])
    if strategy == "auto" and plan.tiles <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return replace(plan, strategy="broadcast")  # too much when cut finely, but not otherwise
    if target.df.isStreaming or not plan.levels:
        return plan  # a stream cannot be sampled; adaptive execution is left to split its batches
    keyed = _target_side(target, False, plan).selectExpr(
        *[f"`{k}`" for k in target.pk], f"explode({plan.target_cells()}) AS _c")
    keyed = keyed.selectExpr("*", "_c.lv AS _lv", "_c.cx AS _scx", "_c.cy AS _scy")
    crowded = hot_keys(keyed, ["_lv", "_scx", "_scy"], target.pk, one_in, floor).collect()
    return replace(plan, hot=tuple(tuple(r) for r in crowded))


def _corner(names, radius: Radius) -> tuple[bool, bool]:
    """Whether the predicates put a target's lower left corner inside the source, and not beyond the source's own."""
    grown = _is_plain(radius) or (isinstance(radius, (int, float)) and radius > 0)
    names = set(names)
    return names <= {"within", "coveredby", "equals"}, grown and names <= {"contains", "covers", "equals"}


def _tiles(side: DataFrame, plan: JoinPlan, level: int, shape_cells: bool, names=("intersects",), radius: Radius = None
           ) -> DataFrame:
    """The cells of one level in which the corner of a matching target may lie."""
    cell = f"{plan.cell(level)!r}D"
    own = f"_slvl <= {level}" if level in plan.target_levels else f"_slvl = {level}"
    inside, before = (False, False) if shape_cells else _corner(names, radius)
    reach = (0.0, 0.0) if inside else plan.reach(level)

    def cells(c: str, reach: float) -> str:
        # differences are rounded by far less than this
        slack = f"1e-12D * greatest(abs(_s{c}0), abs(_s{c}1))"
        first = f"floor((_s{c}0 - _spad - {reach!r}D - {slack}) / {cell})"
        return f"sequence({first}, floor((_s{c}{0 if before else 1} + _spad + {slack}) / {cell}))"

    listed = (f"explode(flatten(transform({cells('x', reach[0])}, cx -> transform({cells('y', reach[1])}, "
              f"cy -> named_struct('cx', cx, 'cy', cy)))))")
    kept = [c for c in side.columns if c not in ("_scx", "_scy")]
    tiles = side.where(own).selectExpr("*", f"{listed} AS _cell")
    tiles = tiles.selectExpr(*[f"`{c}`" for c in kept], "_cell.cx AS _scx", "_cell.cy AS _scy")
    return _classify_cells(tiles, cell) if shape_cells else tiles


def _spread(source: DataFrame, plan: JoinPlan, s: Layer) -> DataFrame:
    """A small source is often one file, thus one task; its cells are worth working out in parallel."""
    if plan.strategy != "broadcast":
        return source
    spark = source.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return source.repartition(n, *[f"_s_{k}" for k in s.pk])


def _placed(tiles: DataFrame, plan: JoinPlan) -> DataFrame:
    """Catalyst does not see how many cells a row lists, so the measured size decides for it."""
    return F.broadcast(tiles) if plan.strategy == "broadcast" else tiles.hint("merge")


def _can_thin(names, target: Layer, source: Layer, radius: Radius) -> bool:
    """Points match by standing in a source, so in a cell a source may stand for all that it covers there."""
    names, kind = set(names), source.geometry.kind
    if not names or target.geometry.kind != "point":
        return False
    if kind == "box":
        return _is_plain(radius) and names <= {"intersects", "dwithin", "coveredby"}
    return kind == "shape" and names <= {"intersects", "dwithin", "coveredby", "within"}


def _thinned(source: Layer, radius: Radius, plan: JoinPlan) -> tuple[DataFrame, ...]:
    """The tiles of each level without those that others cover in their cell: no point in it is lost or gained.

    A cell that lies in one source keeps that one alone. Boxes are cut down to their cells, and there one within another
    is left out wherever they share a corner. How many are left depends on the border of what the sources cover
    together, not on their number. The result is written, as it is measured before it is joined.
    """
    side = _source_side(source, radius, False, plan)
    side = settle(side.drop(*[c for c in side.columns if c.startswith("_s_")]).distinct())
    keys, thinned = ["_scx", "_scy"], []
    for level in plan.source_levels:
        cell = f"{plan.cell(level)!r}D"
        if source.geometry.kind == "shape":
            full, rest = _covered_cells(side, plan, level)
        else:
            rest = _outermost(_tiles(side, plan, level, False), cell)
            whole = f"_sx0 = _scx * {cell} AND _sy0 = _scy * {cell} AND _sx1 = (_scx + 1) * {cell} AND _sy1 = (_scy + 1) * {cell}"
            rest = settle(rest.selectExpr("*", "0D AS _sr", "0D AS _spad", f"{level} AS _slvl"))
            full = rest.where(whole)
            rest = rest.join(full.select(*keys), keys, "left_anti")
        thinned.append(settle(full.unionByName(rest)))
    return tuple(thinned)


def _covered_cells(side: DataFrame, plan: JoinPlan, level: int) -> tuple[DataFrame, DataFrame]:
    """One tile of each cell that a shape covers, and the tiles of the other cells.

    Looking at a shape's edges is dear. Some of the shapes cover most cells that any covers, so these are looked at first,
    and all others only in cells that are left.
    """
    keys, cell, full = ["_scx", "_scy"], f"{plan.cell(level)!r}D", None
    box = "_sx0 <= _scx * {0} AND _sy0 <= _scy * {0} AND _sx1 >= (_scx + 1) * {0} AND _sy1 >= (_scy + 1) * {0}".format(cell)

    def left(tiles: DataFrame) -> DataFrame:
        return tiles if full is None else tiles.join(full.select(*keys), keys, "left_anti")

    for one_in in (16, 4, 1):
        some = side.where(F.pmod(F.xxhash64("_sedges"), F.lit(one_in)) == 0)
        found = _classify_cells(left(_tiles(some, plan, level, False).where(box)), cell).where("_sfull")
        found = settle(found.dropDuplicates(keys))
        full = found if full is None else full.unionByName(found)
    return full, _classify_cells(left(_tiles(side, plan, level, False)), cell)


def _outermost(tiles: DataFrame, cell: str) -> DataFrame:
    """Boxes cut down to their cells, without those that lie in another with a corner in common."""
    keys, box = ["_scx", "_scy"], ("_sx0", "_sy0", "_sx1", "_sy1")
    # cells are powers of two, so their borders are exact
    cut = [f"{pick}({c}, {n} * {cell}) AS {c}" for c, pick, n in zip(box, ("greatest",) * 2 + ("least",) * 2, (
        "_scx", "_scy", "(_scx + 1)", "(_scy + 1)"))]
    boxes = tiles.selectExpr(*keys, *cut).where("_sx0 <= _sx1 AND _sy0 <= _sy1")
    boxes = boxes.groupBy(*keys, *box[:3]).agg(F.max(box[3]).alias(box[3]))
    for x, y in ((0, 1), (0, 3), (2, 1), (2, 3)):
        # of boxes with this corner, by their width: those that are higher than all wider ones
        far_x, far_y = box[2 - x], box[4 - y]
        order = [F.col(far_x).desc() if x == 0 else F.col(far_x).asc(), F.col(far_y).desc() if y == 1 else F.col(far_y).asc()]
        before = Window.partitionBy(*keys, box[x], box[y]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        best = (F.max if y == 1 else F.min)(far_y).over(before)
        boxes = boxes.withColumn("_best", best)
        higher = F.col(far_y) > F.col("_best") if y == 1 else F.col(far_y) < F.col("_best")
        boxes = boxes.where(F.col("_best").isNull() | higher).drop("_best")
    return boxes


def _classify_cells(tiles: DataFrame, cell: str) -> DataFrame:
    """Keeps the cells a shape covers or crosses, with the edges that matter to each."""
    x0, y0, reach = f"(_scx * {cell})", f"(_scy * {cell})", f"(abs(_sr) * {SLACK!r}D)"
    # edges a ray to the right of a point of the cell can cross, or that are within reach of the cell
    relevant = (f"filter(_sedges, e -> greatest(e.y1, e.y2) + {reach} >= {y0} AND "
                f"least(e.y1, e.y2) - {reach} <= {y0} + {cell} AND greatest(e.x1, e.x2) + {reach} >= {x0})")
    middle = pr.odd_crossings(f"({x0} + {cell} / 2)", f"({y0} + {cell} / 2)", "_near")
    state = (f"named_struct('crossed', exists(_near, e -> least(e.x1, e.x2) - {reach} <= {x0} + {cell}), "
             f"'inner', _stype LIKE '%POLYGON' AND {middle})")
    kept = [f"`{c}`" for c in tiles.columns if c != "_sedges"]
    tiles = once(tiles, "_near", F.expr(relevant))
    tiles = once(tiles, "_state", F.expr(state)).where("_state.crossed OR _state.inner")
    return tiles.selectExpr(*kept, "NOT _state.crossed AS _sfull",
                            "if(_state.crossed, _near, filter(_near, e -> false)) AS _sedges")


# --- exact test ------------------------------------------------------------------------------------


def _is_plain(radius: Radius) -> bool:
    return radius is None or (isinstance(radius, (int, float)) and radius == 0)


def needs_relation(names, target: Layer, source: Layer, radius: Radius) -> bool:
    """The predicate needs the full relation of two shapes, which only the Arrow kernel gives."""
    kinds = {target.geometry.kind, source.geometry.kind}
    return _is_plain(radius) and "shape" in kinds and "point" not in kinds and set(names) - {
        "intersects", "disjoint", "dwithin"} != set()


TARGET_BOX, SOURCE_BOX = ("_tx0", "_ty0", "_tx1", "_ty1"), ("_sx0", "_sy0", "_sx1", "_sy1")
TARGET_POINT, SOURCE_POINT = ("_tx0", "_ty0") * 2, ("_sx0", "_sy0") * 2


def _exact(names, target: Layer, source: Layer, radius: Radius) -> str:
    """SQL of the predicate for a candidate pair."""
    names = ["intersects" if n == "dwithin" else n for n in names]
    tk, sk = target.geometry.kind, source.geometry.kind
    if _is_plain(radius):
        return _plain(names, tk, sk)
    if METRES in source.df.columns:
        gap = metre_gap_sql(*TARGET_POINT[:2], *SOURCE_POINT[:2])
        box = f"{pr.box_gap_sq(*_sides_sql(tk, sk))} <= _sr * _sr"
        # a circle that holds a pole holds a position from both sides of longitude 180; the nearer copy counts
        half, ahead = f"{HALF_WORLD!r}D", f"({TARGET_POINT[0]} - {FROM})"
        copy = f"CASE WHEN {ahead} > {half} THEN 2 * {half} WHEN {ahead} < -{half} THEN -2 * {half} ELSE 0D END"
        box = f"{box} AND (_sr < {half} OR {SHIFT} = {copy})"
        surely, never = metre_bounds_sql(*TARGET_POINT[:2], *SOURCE_POINT[:2], METRES)
        near, nearer = (f"({box} AND CASE WHEN {surely} THEN true WHEN {never} THEN false ELSE {gap} {sign} {METRES} END)"
                        for sign in ("<=", "<"))
        return pr.pick(names, {"intersects": near, "coveredby": near, "within": nearer,
                               "touches": f"({near} AND NOT {nearer})", "disjoint": f"(NOT {near})"})
    if isinstance(radius, (int, float)):
        return (_buffered if radius > 0 else _eroded)(names, tk, sk)
    eroded = _eroded(names, tk, sk) if tk == "point" and sk != "point" or (tk, sk) == ("box", "box") else pr.NEVER
    return (f"CASE WHEN _sr > 0 THEN {_buffered(names, tk, sk)} WHEN _sr < 0 THEN {eroded} "
            f"ELSE {_plain(names, tk, sk)} END")


def _sides_sql(tk: str, sk: str):
    return (TARGET_POINT if tk == "point" else TARGET_BOX), (SOURCE_POINT if sk == "point" else SOURCE_BOX)


def _plain(names, tk: str, sk: str) -> str:
    t, s = _sides_sql(tk, sk)
    if (tk, sk) == ("point", "shape"):
        return pr.point_shape(names, *t[:2], "_stype", "_sedges", "_sends", "_sfull")
    if (tk, sk) == ("shape", "point"):
        return pr.point_shape([pr.MIRROR.get(n, n) for n in names], *s[:2], "_tgeom.type", "_info.edges", "_info.ends")
    if "shape" in (tk, sk):
        edges = "_info.edges" if tk == "shape" else geo.edges_sql("_tgeom")
        return geo.shapes_meet_sql("_tgeom", "_sgeom", edges, "_sgedges")
    table = {("point", "point"): pr.point_point, ("point", "box"): pr.point_box, ("box", "point"): pr.box_point,
             ("box", "box"): pr.box_box}
    return table[tk, sk](names, t, s)


def _buffered(names, tk: str, sk: str) -> str:
    """Target against the source grown by the radius, with exact distances."""
    t, s = _sides_sql(tk, sk)
    reach_sq = "_sr * _sr"
    if tk != "point":
        if tk == "box" and sk in ("box", "point") and not set(names) & {"overlaps", "crosses"}:
            gap, far = pr.box_gap_sq(t, s), pr.box_reach_sq(t, s)
            near, nearer = f"({gap} <= {reach_sq})", f"({gap} < {reach_sq})"
            grown = (f"({s[0]} - _sr)", f"({s[1]} - _sr)", f"({s[2]} + _sr)", f"({s[3]} + _sr)")
            covers = pr.bbox_covers(t, grown)
            # far is seldom needed: if no side juts out by 0.7 radii no corner is out of reach, and one beyond it decides too
            juts = [f"{b} - {a}" for a, b in ((t[0], s[0]), (s[2], t[2]), (t[1], s[1]), (s[3], t[3]))]
            sure, may = (" AND ".join(f"{j} <= {limit}" for j in juts) for limit in ("0.7D * _sr", "_spad"))
            # its corners are rounded, so a grown box equals no box
            return pr.pick(names, {
                "intersects": near, "disjoint": f"(NOT {near})", "touches": f"({near} AND NOT {nearer})",
                "coveredby": f"({may} AND (({sure}) OR {far} <= {reach_sq}))",
                "within": f"({may} AND (({sure}) OR ({far} <= {reach_sq} AND {nearer})))",
                "covers": covers, "contains": covers})
        if set(names) - {"intersects"}:
            raise ValueError("a radius with lines or polygons works with intersects only, with boxes not with overlaps and crosses")
        if "shape" in (tk, sk):
            return f"({geo.distance_sql('_tgeom', '_sgeom')} <= _sr)"
        return f"({pr.box_gap_sq(t, s)} <= {reach_sq})"
    if sk == "shape":
        x, y = t[:2]
        inside = f"(_sfull OR (_stype LIKE '%POLYGON' AND {pr.odd_crossings(x, y, '_sedges')}))"
        near = f"({inside} OR {pr.near_any_edge(x, y, '_sedges', reach_sq)})"
        nearer = f"({inside} OR {pr.near_any_edge(x, y, '_sedges', reach_sq, strict=True)})"
    else:
        gap = pr.box_gap_sq(t, s)
        near, nearer = f"({gap} <= {reach_sq})", f"({gap} < {reach_sq})"
    return pr.pick(names, {"intersects": near, "coveredby": near, "within": nearer,
                           "touches": f"({near} AND NOT {nearer})", "disjoint": f"(NOT {near})"})


def _eroded(names, tk: str, sk: str) -> str:
    """Points or boxes against the polygon shrunk by the radius; a polygon that vanishes matches nothing."""
    if (tk, sk) == ("box", "box"):
        r, s = "abs(_sr)", SOURCE_BOX
        left = f"({s[2]} - {s[0]} > 2 * {r} AND {s[3]} - {s[1]} > 2 * {r})"
        shrunk = (f"({s[0]} + {r})", f"({s[1]} + {r})", f"({s[2]} - {r})", f"({s[3]} - {r})")
        others = tuple(n for n in names if n != "disjoint")
        met = f"({left} AND {pr.box_box(others, TARGET_BOX, shrunk)})"
        apart = f"(NOT ({left} AND {pr.bbox_overlap(TARGET_BOX, shrunk)}))"
        return pr.any_of(([met] if others else []) + ([apart] if "disjoint" in names else []))
    if tk != "point":
        raise ValueError("a negative radius works with points, or with boxes on both sides")
    (x, y), r = TARGET_POINT[:2], "abs(_sr)"
    if sk == "box":
        left = f"(_sx1 - _sx0 > 2 * {r} AND _sy1 - _sy0 > 2 * {r})"
        shrunk = (f"(_sx0 + {r})", f"(_sy0 + {r})", f"(_sx1 - {r})", f"(_sy1 - {r})")
        covered = f"({left} AND {pr.point_box(['intersects'], TARGET_POINT, shrunk)})"
        inside = f"({left} AND {pr.point_box(['within'], TARGET_POINT, shrunk)})"
    elif sk == "shape":
        within = f"(_sfull OR (_stype LIKE '%POLYGON' AND {pr.odd_crossings(x, y, '_sedges')}))"
        covered = f"({within} AND NOT {pr.near_any_edge(x, y, '_sedges', 'pow(_sr, 2)', strict=True)})"
        inside = f"({within} AND NOT {pr.near_any_edge(x, y, '_sedges', 'pow(_sr, 2)')})"
    else:
        return pr.NEVER
    return pr.pick(names, {"intersects": covered, "coveredby": covered, "within": inside,
                           "touches": f"({covered} AND NOT {inside})", "disjoint": f"(NOT {covered})"})


def _candidate(t: Layer, s: Layer, radius: Radius, names=()) -> str:
    """Boxes of the pair overlap, the source's grown by its radius."""
    grown = isinstance(radius, (int, float)) and radius > 0 and (t.geometry.kind, s.geometry.kind) == ("box", "box")
    if grown and names and set(names) <= {"within", "coveredby"}:
        return "true"  # the exact test begins with a stricter one
    if _is_plain(radius) and "shape" not in (t.geometry.kind, s.geometry.kind):
        return "true"  # the closed forms are no dearer than this test
    return pr.bbox_overlap(TARGET_BOX, ("(_sx0 - _spad)", "(_sy0 - _spad)", "(_sx1 + _spad)", "(_sy1 + _spad)"))


def _boxes_allow(names) -> str:
    """What the bounding boxes of a pair must satisfy for one of the predicates to be possible."""
    covers, covered = pr.bbox_covers(TARGET_BOX, SOURCE_BOX), pr.bbox_covers(SOURCE_BOX, TARGET_BOX)
    table = {"contains": covers, "covers": covers, "within": covered, "coveredby": covered,
             "equals": f"({covers} AND {covered})"}
    return pr.any_of(table.get(n, "true") for n in names)


# --- operators -------------------------------------------------------------------------------------


def _sides(target: Layer, source: Layer, use_centroids, point_mode, metric) -> tuple[Layer, Layer]:
    if use_centroids not in (None, False, "target", "source", "both"):
        raise ValueError("use_centroids is None, 'target', 'source' or 'both'")
    on = lambda side: point_mode if use_centroids in (side, "both") else None
    if not metric and target.crs != source.crs:
        source = reproject(source, target.crs)
    return _working(target, on("target"), metric), _working(source, on("source"), metric)


def _geodesic(t: Layer, s: Layer, radius: Radius) -> tuple[Layer, Layer, str]:
    """Sides and radius for metres on the ellipsoid: sources whose circle passes longitude 180 come twice."""
    if {t.geometry.kind, s.geometry.kind} != {"point"} or {t.crs, s.crs} != {METRIC}:
        raise ValueError("metric='geodesic' measures between points of geographic layers; see use_centroids")
    if isinstance(radius, (int, float)) and radius < 0 or radius is None:
        raise ValueError("metric='geodesic' needs a radius of 0 or more")
    g = s.geometry
    df = s.df.withColumn(METRES, F.greatest(_radius(radius), F.lit(0.0)))
    df = df.withColumn(REACH, mercator_reach(F.col(g.y), F.col(METRES)))
    x, reach, world = F.col(g.x), F.col(REACH), F.lit(2 * HALF_WORLD)
    shifts = F.array_compact(F.array(F.lit(0.0), F.when(x + reach > HALF_WORLD, -world), F.when(x - reach < -HALF_WORLD, world)))
    df = df.withColumns({SHIFT: F.explode(shifts), FROM: x}).withColumn(g.x, x + F.col(SHIFT))
    return t, s.with_df(df), REACH


def spatial_filter(target: Layer, source: Layer, predicates=("intersects",), radius: Radius = None,
                   use_centroids: str | None = None, mode: str = "any", metric: bool | str = False,
                   point_mode: str = "point_on_surface", plan: JoinPlan | None = None,
                   strategy: str = "auto") -> DataFrame:
    """Target rows that stand in one of the relations to some source row, each once.

    ``radius`` is a number or a column of the source (positive: within that distance; negative: the
    source is shrunk first), in units of the target's CRS, in metres of Web Mercator with ``metric``, or, between points,
    in metres on the ellipsoid with ``metric="geodesic"`` (up to some 500 km, across longitude 180 too). For ``disjoint``,
    ``mode="any"`` asks for one disjoint source row and ``mode="all"`` for all of them; of sources that vanish when
    shrunk, "any" finds none and "all" is true. Rows without a
    geometry never match, and no predicate means no rows. With a ``plan`` no job is run.
    """
    names = pr.check_predicates(predicates)
    if mode not in ("any", "all"):
        raise ValueError("mode is 'any' or 'all'")
    if not names:
        return target.df.where(F.lit(False))
    t, s = _sides(target, source, use_centroids, point_mode, metric)
    if metric == "geodesic":
        if "disjoint" in names and mode == "any":
            raise ValueError("metric='geodesic' knows disjoint with mode 'all' only")
        t, s, radius = _geodesic(t, s, radius)
    columns = target.df.columns
    if "disjoint" in names:
        others = tuple(n for n in names if n != "disjoint")
        plan = plan or plan_join(t, s, radius, strategy, names=("intersects",) if mode == "all" and not others else ())
        meeting = _meeting_all(t, s, radius, plan) if mode == "any" else None
        apart = _disjoint(t, s, radius, plan, meeting)
        if not others:
            return apart.select(*columns)
        # every other relation needs a common point, so no row is both apart from all and near
        near = spatial_filter(t, s, others, radius, plan=plan, strategy=strategy)
        if meeting is not None:
            near = sized_join(near, meeting, target.pk, "left_semi", target.pk)
        return apart.select(*columns).union(near.select(*columns))
    plan = _passed(plan) or plan_join(t, s, radius, strategy, names=names)
    if not plan.source_levels:
        return target.df.where(F.lit(False))
    if needs_relation(names, t, s, radius):
        if t.df.isStreaming:
            raise ValueError("a stream of lines or polygons works with intersects, dwithin and disjoint only")
        keys = _pairs(t, s, names, radius, plan, carry=False).select(*target.pk).distinct()
        return sized_join(target.df, keys, target.pk, "left_semi", target.pk)
    return _matching(t, s, names, radius, plan, found=True).select(*columns)


def _passed(plan: JoinPlan | None) -> JoinPlan | None:
    """A plan that is passed in may be older than its sides; then no measured extent or length leaves anything out."""
    return replace(plan, extent=None, sides=()) if plan and not plan.current else plan


def plan_filter(target: Layer, source: Layer, radius: Radius = None) -> JoinPlan:
    """The plan of a ``spatial_filter`` with these layers, for use with it or with parts of the target.

    It prunes the target's scan by the source's extent, so it holds only while the source stays as it is.
    """
    t, s = _sides(target, source, None, "point_on_surface", False)
    return replace(plan_join(t, s, radius), current=True)


def _matching(t: Layer, s: Layer, names, radius: Radius, plan: JoinPlan, found: bool) -> DataFrame:
    """Targets with (or, for ``found=False``, without) a matching source.

    A join on several levels that has to shuffle sends keys and geometries only; whole rows are exchanged once, to meet
    the keys that were found.
    """
    if len(plan.levels) > 1 and plan.strategy == "shuffle" and not t.df.isStreaming:
        slim = t.with_df(t.df.select(*dict.fromkeys([*t.pk, *t.geometry.columns])))
        cut = _cut_lines(slim, s, plan) if plan.sides and _is_plain(radius) and set(names) <= {"intersects", "dwithin"} else None
        if cut is not None:
            keys = _pairs(cut, s, names, radius, plan_join(cut, s, radius, "shuffle"), "left_semi")
        else:
            keys = _pairs(slim, s, names, radius, plan, "left_semi")
        keys = keys.select(*t.pk).distinct()
        rows = (_near_extent(t, plan) if found else t).df.where(t.geometry.present())
        return sized_join(rows, keys, t.pk, "left_semi" if found else "left_anti", t.pk)
    keep_shape = "shape" in (t.geometry.kind, s.geometry.kind) and t.geometry.kind != "point"
    shape_cells = t.geometry.kind == "point" and s.geometry.kind == "shape"
    source = _source_side(s, radius, keep_shape, plan)
    if shape_cells:
        source = _spread(source, plan, s)
    if plan.strategy == "shuffle":
        # copies of a source decide nothing anew
        source = source.drop(*[c for c in source.columns if c.startswith("_s_")]).distinct()
    targets = _target_side(_near_extent(t, plan) if found else t, keep_shape, plan)
    test = f"{_candidate(t, s, radius)} AND {_exact(names, t, s, radius)}"
    frames, hits = {}, []
    for i, own in enumerate(plan.source_levels):
        # a target meets the sources of a level on one level, so every size of targets is served by the same join
        met = [lv for lv in plan.levels if lv == own or (lv > own and lv in plan.target_levels)]
        lv, x, y, salt = f"_tlv{i}", f"_tcx{i}", f"_tcy{i}", f"_tsalt{i}"
        cell = f"CASE {lv} " + " ".join(f"WHEN {at} THEN {plan.cell(at)!r}D" for at in met) + " END"
        targets = targets.withColumn(lv, F.expr(f"greatest(_tlvl, {own})"))
        # rows of a size the plan does not know have no cell; their second key spreads them
        apart = f"xxhash64({', '.join(f'`{k}`' for k in t.pk)})"
        targets = targets.withColumns({
            x: F.expr(f"floor(_tx0 / {cell})"), y: F.expr(f"coalesce(floor(_ty0 / {cell}), {apart})")})
        if plan.thinned:
            tiles = plan.thinned[i].withColumn("_lv", F.lit(own))
        else:
            mine = source.where(f"_slvl = {own}")
            tiles = reduce(DataFrame.unionByName, [
                _tiles(mine, plan, at, shape_cells, names, radius).withColumn("_lv", F.lit(at)) for at in met])
        match = f"_lv = {lv} AND _scx = {x} AND _scy = {y}"
        hot = plan.hot_cells(t.df.sparkSession)
        if hot is not None:
            renamed = targets.withColumnsRenamed({lv: "_lv", x: "_scx", y: "_scy"})
            salted, tiles = salt_sides(renamed, tiles, ["_lv", "_scx", "_scy"], t.pk, hot)
            targets = salted.withColumnsRenamed({"_lv": lv, "_scx": x, "_scy": y, "_salt": salt})
            match += f" AND _salt = {salt}"
        tiles = _placed(tiles, plan)
        if len(plan.source_levels) == 1:
            return targets.join(tiles, F.expr(f"{match} AND {test}"), "left_semi" if found else "left_anti")
        frames[f"tiles{i}"] = tiles
        hits.append(f"EXISTS (SELECT 1 FROM {{tiles{i}}} WHERE {match} AND {test})")
    # several levels of sources: one EXISTS each, so that a target is still read once and never multiplied
    hit = " OR ".join(hits)
    spark = t.df.sparkSession
    return spark.sql(f"SELECT * FROM {{targets}} WHERE {'' if found else 'NOT '}({hit})", targets=targets, **frames)


def _pairs(t: Layer, s: Layer, names, radius: Radius, plan: JoinPlan, how: str = "inner",
           carry: bool = True) -> DataFrame:
    """All matching pairs, with the target's columns and the source's key as ``_s_<key>``.

    Without ``carry``, pairs that go through the kernel may lose all columns but the keys. With ``left_semi`` only the target's columns, once for each level it has a match on: a target is done with at its
    first match there.
    """
    related = needs_relation(names, t, s, radius)
    keep_shape = "shape" in (t.geometry.kind, s.geometry.kind) and t.geometry.kind != "point"
    shape_cells = t.geometry.kind == "point" and s.geometry.kind == "shape"
    source, targets = _source_side(s, radius, keep_shape, plan), _target_side(_near_extent(t, plan), keep_shape, plan)
    if how == "left_semi":
        # copies of a source decide nothing anew
        source = source.drop(*[c for c in source.columns if c.startswith("_s_")]).distinct()
    elif shape_cells:
        source = _spread(source, plan, s)
    if related:
        source = source.withColumns({"_skind": F.col("_sgeom.type"), "_sedges": flat_edges(F.col("_sgeom"))}).drop("_sgeom")
        targets = targets.withColumns({"_tkind": F.col("_tgeom.type"), "_tedges": flat_edges(F.col("_tgeom"))}).drop("_tgeom")
    levels = plan.levels
    targets = targets.selectExpr("*", f"explode({plan.target_cells()}) AS _c")
    targets = targets.selectExpr("*", "_c.lv AS _lv", "_c.cx AS _scx", "_c.cy AS _scy").drop("_c")
    tiles = reduce(DataFrame.unionByName, [
        _tiles(source, plan, lv, shape_cells, names, radius).withColumn("_lv", F.lit(lv)) for lv in levels])
    keys = ["_lv", "_scx", "_scy"]
    hot = plan.hot_cells(t.df.sparkSession)
    if hot is not None:
        targets, tiles = salt_sides(targets, tiles, keys, t.pk, hot)
        keys = [*keys, "_salt"]
    tests = [_candidate(t, s, radius, names)]
    if t.geometry.kind != "point" and len(levels) > 1:
        tests.append("greatest(_tlvl, _slvl) = _lv")
    if how == "left_semi":
        targets = targets.withColumnsRenamed({k: f"_t{k}" for k in keys})
        tests += [f"{k} = _t{k}" for k in keys] + [_exact(names, t, s, radius)]
        return targets.join(_placed(tiles, plan), F.expr(" AND ".join(tests)), how)
    joined = targets.join(_placed(tiles, plan), keys, how).where(" AND ".join(tests))
    if related:
        joined = joined.where(_boxes_allow(names))
        if not carry:
            joined = joined.select(*t.pk, *[f"_s_{k}" for k in s.pk], "_tkind", "_tedges", "_skind", "_sedges")
        # the kernel is the dear part, and candidates are uneven: spread them first
        n = int(t.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        joined = joined.repartition(n, *t.pk, *[f"_s_{k}" for k in s.pk])
        sides = (F.col(c) for c in ("_tkind", "_tedges", "_skind", "_sedges"))
        return once(joined, "_relation", flat_relation(*sides)).where(
            reduce(lambda a, b: a | b, [relation_holds(n, F.col("_relation")) for n in names]))
    return joined.where(_exact(names, t, s, radius))


def _unique(layer: Layer) -> bool:
    return layer.df.groupBy(*layer.pk).count().where("count > 1").isEmpty()


def spatial_pairs(target: Layer, source: Layer, predicates=("intersects",), radius: Radius = None,
                  metric: bool | str = False, plan: JoinPlan | None = None, strategy: str = "auto") -> DataFrame:
    """Matching pairs as keys, ``t_<key>`` and ``s_<key>``; each pair once.

    What is to be worked out for a pair may be carried as a part of the keys; then it needs no further join.
    """
    names = pr.check_predicates(predicates)
    if "disjoint" in names:
        raise ValueError("disjoint pairs are nearly all pairs; use spatial_filter with mode 'any' or 'all'")
    t, s = _sides(target, source, None, "point_on_surface", metric)
    if metric == "geodesic":
        t, s, radius = _geodesic(t, s, radius)
    plan = _passed(plan) or plan_join(t, s, radius, strategy)
    out = [F.col(k).alias(f"t_{k}") for k in target.pk] + [F.col(f"_s_{k}").alias(f"s_{k}") for k in source.pk]
    if not names or not plan.source_levels:
        types = source.df.select(*source.pk).dtypes
        empty = target.df.where(F.lit(False))
        return empty.withColumns({f"_s_{k}": F.lit(None).cast(t) for k, t in types}).select(*out)
    pairs = _pairs(t, s, names, radius, plan, carry=False).select(*out)
    # keys that occur once make pairs that do; the pairs may be far more than the rows
    return pairs if metric != "geodesic" or _unique(target) and _unique(source) else pairs.distinct()


def spatial_join(target: Layer, source: Layer, predicates=("intersects",), radius: Radius = None,
                 plan: JoinPlan | None = None, strategy: str = "auto") -> DataFrame:
    """Inner join: the target's columns and the source's key as ``s_<key>``, one row per matching pair."""
    names = pr.check_predicates(predicates)
    t, s = _sides(target, source, None, "point_on_surface", False)
    plan = _passed(plan) or plan_join(t, s, radius, strategy)
    out = [F.col(c) for c in target.df.columns] + [F.col(f"_s_{k}").alias(f"s_{k}") for k in source.pk]
    if not names or not plan.source_levels:
        types = source.df.select(*source.pk).dtypes
        return target.df.where(F.lit(False)).withColumns(
            {f"_s_{k}": F.lit(None).cast(t) for k, t in types}).select(*out)
    return _pairs(t, s, names, radius, plan).select(*out)


def _disjoint(t: Layer, s: Layer, radius: Radius, plan: JoinPlan, meeting: DataFrame | None) -> DataFrame:
    """Targets apart from every source or, where ``meeting`` names those that meet all, from at least one."""
    present = t.df.where(t.geometry.present())
    if meeting is not None:
        return sized_join(present, meeting, t.pk, "left_anti", t.pk)
    return _matching(t, s, ("intersects",), radius, plan, found=False) if plan.source_levels else present


def _meeting_all(t: Layer, s: Layer, radius: Radius, plan: JoinPlan) -> DataFrame:
    """Keys of the targets that meet every source; sources that vanish when shrunk do not count.

    Such a target's box meets every source box, so only those are paired. Without any source, all meet all.
    """
    side = _source_side(s, radius, False)
    if not _is_plain(radius):
        shrinks = side.where("_sr < 0")
        if s.geometry.kind == "shape" and not shrinks.isEmpty():
            raise ValueError("disjoint with mode 'any' and a negative radius works with boxes only")
        side = side.where("_sr >= 0 OR (_sx1 - _sx0 > -2 * _sr AND _sy1 - _sy0 > -2 * _sr)")
    pad = F.col("_spad")
    n, *box = side.agg(
        F.count("*"), F.max(F.col("_sx0") - pad), F.max(F.col("_sy0") - pad), F.min(F.col("_sx1") + pad),
        F.min(F.col("_sy1") + pad)).first()
    if not n:
        return t.df.select(*t.pk)
    x0, y0, x1, y1 = t.geometry.bbox()
    suspects = t.where((x1 >= box[0]) & (y1 >= box[1]) & (x0 <= box[2]) & (y0 <= box[3]))
    pairs = _pairs(suspects, s, ("intersects",), radius, plan)
    return pairs.groupBy(*t.pk).count().where(F.col("count") == n).select(*t.pk)


def small_source(source: Layer) -> bool:
    """At most 100 source rows: the source travels to the targets instead of being shuffled with them."""
    return source.df.count() <= SMALL_SOURCE_ROWS


def select_by_location(target: Layer, source: Layer, predicates=("intersects",), **options) -> DataFrame:
    return spatial_filter(target, source, predicates, **options)


def filter_many(targets: dict[str, Layer], source: Layer, predicates=("intersects",), radius: Radius = None, **options
                ) -> dict[str, DataFrame]:
    """The same filter on many layers.

    One plan serves all point layers as long as it broadcasts: such a plan depends on the source alone. A source that
    is dear to make is best persisted, or written, by the caller, who knows when to release it.
    """
    found, plan = {}, options.pop("plan", None)
    for name, layer in targets.items():
        alike = not options and layer.geometry.kind == "point" and layer.crs == source.crs
        if alike and plan is None:
            first = plan_join(layer, source, radius)
            plan = first if first.strategy == "broadcast" else None
        found[name] = spatial_filter(layer, source, predicates, radius, plan=plan if alike else None, **options)
    return found
