"""Point in polygon and cell lattices.

A polygon set is an edge table (x1, y1, x2, y2). Holes and several rings work by parity: a point is
inside if an odd number of edges lies to the east of it. Two ways give the same booleans:

* Up to ``SMALL`` edges: they are sorted into latitude bands once, as a scalar subquery; each point tests
  the edges of its own band, in a plain column expression. No join and no shuffle of the points.
* Beyond: a cover of cells, each with the number of edges that every point of the cell has to its east, and
  a list of the edges that must be tested. Bands with many corners are split. Points meet their cell by an
  equi-join; most cells have an empty list. The driver sees the box and one number a band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.functions.spatial import with_cell

BANDS = 256
SMALL = 4096  # edges that one row may hold
COVER, COLUMNS, CORNERS = 1024, 64, 8  # bands and columns of a cover; corners a band may hold unsplit


def edges_from_rings(spark: SparkSession, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """Edge table of rings given as (lon, lat) corners; an open ring is closed."""
    rows = []
    for n, ring in enumerate(rings):
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        for a, b in zip(closed, closed[1:]):
            numbers = ", ".join(f"{float(v)!r}D" for v in (*a, *b))
            rows.append(f"({n}, {numbers})")
    return spark.sql("SELECT * FROM VALUES " + ", ".join(rows) + " AS e(ring_id, x1, y1, x2, y2)")


def edge_bands(edges: DataFrame, bands: int = BANDS) -> Column:
    """Scalar subquery struct(lo, step, slots): the edges that reach into each latitude band.

    It is one row, so only outlines of up to ``SMALL`` edges come here.
    """
    box = edges.agg(F.struct(
        F.min(F.least("y1", "y2")).alias("lo"), F.max(F.greatest("y1", "y2")).alias("hi")).alias("s")).scalar()
    sized = edges.withColumn("_box", box).withColumns({
        "lo": F.col("_box.lo"), "step": (F.col("_box.hi") - F.col("_box.lo")) / bands})

    def slot(y):
        return F.floor(F.try_divide(y - F.col("lo"), F.col("step"))).cast("int")

    spread = sized.where(F.col("y1") != F.col("y2")).select(
        "lo", "step", F.struct("x1", "y1", "x2", "y2").alias("e"),
        F.explode(F.sequence(slot(F.least("y1", "y2")), slot(F.greatest("y1", "y2")))).alias("slot"))
    grouped = spread.groupBy("slot").agg(
        F.first("lo").alias("lo"), F.first("step").alias("step"), F.collect_list("e").alias("es"))
    packed = grouped.agg(
        F.first("lo").alias("lo"), F.first("step").alias("step"),
        F.map_from_entries(F.collect_list(F.struct("slot", "es"))).alias("m"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(bands)), lambda i: F.col("m")[i])
    return packed.select(F.struct("lo", "step", slots.alias("slots")).alias("b")).scalar()


def _is_east(x, y, e) -> Column:
    return (((e["y1"] <= y) != (e["y2"] <= y))
            & (x < e["x1"] + (y - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])))


class Cover:
    """Cells over the box of an outline; a cell is (band, part of the band, column)."""

    def __init__(self, edges: DataFrame, bands: int = COVER, columns: int = COLUMNS, corners: int = CORNERS):
        self.bands, self.columns = bands, columns
        box = edges.agg(
            F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x9"),
            F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y9")).first()
        self.flat = box.y0 is None or box.y0 == box.y9  # no area: nothing is inside
        if self.flat:
            return
        self.x0, self.y0 = box.x0, box.y0
        self.width, self.height = (box.x9 - box.x0) / columns or 1.0, (box.y9 - box.y0) / bands
        met = edges.where("y1 <> y2").select(self._band(F.col("y1")).alias("band")).groupBy("band").count()
        parts = dict.fromkeys(range(bands + 1), 1) | {r["band"]: -(-r["count"] // corners) for r in met.collect()}
        self.parts = F.array(*(F.lit(parts[b]) for b in range(bands + 1)))
        self.edges = edges.where("y1 <> y2").select("x1", "y1", "x2", "y2")

    def _row(self, y: Column) -> Column:
        return (y - F.lit(self.y0)) / F.lit(self.height)

    def _band(self, y: Column) -> Column:
        return F.floor(self._row(y)).cast("int")

    def _part(self, y: Column, parts: Column) -> Column:
        """The part of its band that holds y; grows with y like the band itself, so no rounding can part a point from an edge."""
        return F.least(F.floor((self._row(y) - F.floor(self._row(y))) * parts).cast("int"), parts - 1)

    def _column(self, x: Column) -> Column:
        return F.floor(F.greatest(F.least((x - F.lit(self.x0)) / F.lit(self.width), F.lit(self.columns + 1.0)), F.lit(0.0))).cast("int")

    def cells(self) -> DataFrame:
        """band, part, col, sure (edges east of the whole cell), es (edges to test)."""
        low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
        by_band = self.edges.select(
            "*", self._band(low).alias("b1"), self._band(high).alias("b2"),
            F.explode(F.sequence(self._band(low), self._band(high))).alias("band")).withColumn("parts", F.get(self.parts, F.col("band")))
        first = F.when(F.col("band") == F.col("b1"), self._part(low, F.col("parts"))).otherwise(0)
        last = F.when(F.col("band") == F.col("b2"), self._part(high, F.col("parts"))).otherwise(F.col("parts") - 1)
        by_part = by_band.withColumns({"first": first, "last": last}).select("*", F.explode(F.sequence("first", "last")).alias("part"))
        ends = (((F.col("band") == F.col("b1")) & (F.col("part") == F.col("first")))
                | ((F.col("band") == F.col("b2")) & (F.col("part") == F.col("last"))))

        def x_at(row: Column, off: float) -> Column:
            y = F.lit(self.y0) + F.lit(self.height) * (row / F.col("parts") + F.col("band") + F.lit(off))
            share = F.greatest(F.least((y - F.col("y1")) / (F.col("y2") - F.col("y1")), F.lit(1.0)), F.lit(0.0))
            return F.col("x1") + share * (F.col("x2") - F.col("x1"))

        # a margin far above rounding and far below a cell keeps edges near a border on the tested side
        xa, xb, margin = x_at(F.col("part"), -1e-6), x_at(F.col("part") + 1, 1e-6), F.lit(self.width * 1e-6)
        pieces = by_part.select(
            "band", "part", ends.alias("ends"), F.struct("x1", "y1", "x2", "y2").alias("e"),
            self._column(F.least(xa, xb) - margin).alias("c1"), self._column(F.greatest(xa, xb) + margin).alias("c2"))
        tested = pieces.select("band", "part", F.explode(F.sequence(F.when(F.col("ends"), 0).otherwise(F.col("c1")), F.col("c2"))).alias("col"), "e")
        tested = tested.groupBy("band", "part", "col").agg(F.collect_list("e").alias("es"))
        whole = pieces.where("NOT ends AND c1 > 0").groupBy("band", "part", "c1").agg(F.count(F.lit(1)).alias("n"))
        sure = whole.select("band", "part", F.explode(F.sequence(F.lit(0), F.col("c1") - 1)).alias("col"), "n")
        sure = sure.groupBy("band", "part", "col").agg(F.sum("n").alias("sure"))
        return sure.join(tested, ["band", "part", "col"], "full").select(
            "band", "part", "col", F.coalesce("sure", F.lit(0)).alias("sure"), "es")

    def locate(self, y: Column, x: Column) -> dict[str, Column]:
        """The cell of a point; NULL outside the rows of the box."""
        row = self._row(y)
        band = F.when((row >= 0) & (row < self.bands + 1), self._band(y))
        return {"_band": band, "_part": self._part(y, F.get(self.parts, band)), "_col": F.when(x.isNotNull(), self._column(x))}


def _with_inside_cells(df: DataFrame, edges: DataFrame, lat: str, lon: str, out: str, **sizes: int) -> DataFrame:
    cover = Cover(edges, **sizes)
    if cover.flat:
        return df.withColumn(out, F.lit(False))
    x, y = F.col(lon), F.col(lat)
    cells = cover.cells().toDF("_band", "_part", "_col", "_sure", "_es")
    met = df.withColumns(cover.locate(y, x)).join(cells, ["_band", "_part", "_col"], "left")
    hits = F.coalesce(F.size(F.filter("_es", lambda e: _is_east(x, y, e))), F.lit(0))
    odd = (F.coalesce("_sure", F.lit(0)) + F.when(F.col("_es").isNull(), 0).otherwise(hits)) % 2 == 1
    return met.withColumn(out, odd).select(*df.columns, out)


def with_inside(
    df: DataFrame, edges: DataFrame, lat: str = "latitude", lon: str = "longitude",
    out: str = "inside", small: int = SMALL,
) -> DataFrame:
    """Add a boolean: an odd number of edges lies to the east of the point."""
    if edges.limit(small + 1).count() > small:
        return _with_inside_cells(df, edges, lat, lon, out)
    x, y = F.col(lon), F.col(lat)
    banded = df.withColumn("_bands", edge_bands(edges))
    slot = F.floor((y - F.col("_bands.lo")) / F.col("_bands.step")).cast("int")
    near = F.when(slot >= 0, F.get(F.col("_bands.slots"), slot))
    odd = F.coalesce(F.size(F.filter(near, lambda e: _is_east(x, y, e))) % 2 == 1, F.lit(False))
    return banded.withColumn(out, F.when(near.isNull(), False).otherwise(odd)).drop("_bands")


def within_polygon(df: DataFrame, edges: DataFrame, lat="latitude", lon="longitude", small: int = SMALL) -> DataFrame:
    return with_inside(df, edges, lat, lon, "_inside", small).where("_inside").drop("_inside")


def lattice_cells(spark: SparkSession, edges: DataFrame, size_km: float = 1) -> DataFrame:
    """Distinct cell ids of a lattice of step size/111 degrees inside the polygon.

    The driver reads the four corners of the outline to size one ``range``.
    """
    box = edges.agg(
        F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x9"),
        F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y9")).first()
    step = size_km / 111.0
    nx = int((box.x9 - box.x0) / step) + 1
    ny = int((box.y9 - box.y0) / step) + 1
    points = spark.range(nx * ny).select(
        (F.lit(box.y0) + F.floor(F.col("id") / nx) * F.lit(step)).alias("latitude"),
        (F.lit(box.x0) + (F.col("id") % nx) * F.lit(step)).alias("longitude"))
    inside = within_polygon(points, edges)
    return with_cell(inside, size_km).select("grid_id").distinct()

