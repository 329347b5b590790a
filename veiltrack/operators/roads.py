"""Road reference data, vertices and their degrees, and the spatial index of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import Bounds, LatLon, edge_touches, in_bounds, outdegree
from ..session import checkpointed, kept

#: Way types in the order of their numbers, from 0.
WAY_TYPES = [
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service",
    "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "living_street", "pedestrian", "track",
    "bus_guideway", "raceway", "road", "footway", "bridleway", "steps", "path", "cycleway",
    "proposed", "construction", "bus_stop", "crossing", "elevator", "emergency_access_point", "escape", "give_way",
    "mini_roundabout", "motorway_junction", "passing_place", "rest_area", "speed_camera", "street_lamp", "services", "stop",
    "traffic_signals", "turning_circle", "user_defined",
]
WAY_IDS = {name: number for number, name in enumerate(WAY_TYPES)}
OTHER = WAY_IDS["user_defined"]
#: Road widths in metres by way type; all others are 16.
WIDTHS = {"motorway": 22.0, "primary": 30.0, "secondary": 17.0, "unclassified": 22.0, "residential": 17.0, "primary_link": 30.0, "secondary_link": 18.0, "pedestrian": 10.0, "user_defined": 80.0}
WIDTH = 16.0
#: Way types on which nobody stops for a reason of their own.
EXCLUDED_WAYS = frozenset(WAY_IDS[n] for n in ("motorway", "trunk", "primary", "motorway_link", "trunk_link", "primary_link"))

#: Edges in a leaf before it splits, least half of a leaf's side in degrees, part of its side by which a leaf reaches out.
LEAF_EDGES, LEAF_DEGREES, LEAF_MARGIN = 32, 0.003, 10.0

EDGE_COLUMNS = ["edge_id", "v1_id", "v1_lat", "v1_lon", "v2_id", "v2_lat", "v2_lon", "way_type", "width", "is_explicit"]


def way_width(way_type: Column) -> Column:
    table = [WIDTHS.get(name, WIDTH) for name in WAY_TYPES]
    return F.element_at(F.array(*(F.lit(w) for w in table)), F.coalesce(way_type, F.lit(OTHER)) + 1)


def highways(spark: SparkSession) -> DataFrame:
    """way_type, name, width, excluded: one row a way type."""
    rows = [(i, n, WIDTHS.get(n, WIDTH), i in EXCLUDED_WAYS) for i, n in enumerate(WAY_TYPES)]
    return spark.createDataFrame(rows, "way_type int, name string, width double, excluded boolean")


def ends(row: str = "") -> tuple[LatLon, LatLon]:
    return LatLon(F.col(f"{row}v1_lat"), F.col(f"{row}v1_lon")), LatLon(F.col(f"{row}v2_lat"), F.col(f"{row}v2_lon"))


def incidence(edges: DataFrame) -> DataFrame:
    """vertex_id, edge_id: both ends of every edge."""
    return edges.select(F.explode(F.array("v1_id", "v2_id")).alias("vertex_id"), "edge_id").distinct()


def vertices(edges: DataFrame) -> DataFrame:
    """vertex_id, degree, out_degree."""
    return incidence(edges).groupBy("vertex_id").agg(F.count(F.lit(1)).alias("degree")).withColumn("out_degree", outdegree(F.col("degree")))


def box_of(prefix: str = "") -> Bounds:
    return Bounds(LatLon(F.col(f"{prefix}sw_lat"), F.col(f"{prefix}sw_lon")), LatLon(F.col(f"{prefix}ne_lat"), F.col(f"{prefix}ne_lon")))


def fuzzy(box: Bounds) -> Bounds:
    """A node's box with its margin, in which its edges are looked for."""
    high, wide = box.height / LEAF_MARGIN, box.width / LEAF_MARGIN
    return Bounds(LatLon(box.sw.lat - high, box.sw.lon - wide), LatLon(box.ne.lat + high, box.ne.lon + wide))


_CORNERS = ("sw_lat", "sw_lon", "ne_lat", "ne_lon")


#: Levels that are made in one job.
_TOGETHER = 4


def _margins(box: Bounds) -> Column:
    """A box with its margin as a struct."""
    wide = fuzzy(box)
    return F.struct(*(v.alias(c) for v, c in zip((*wide.sw, *wide.ne), _CORNERS)))


def _children(box: Bounds) -> Column:
    """Boxes into which a full node splits, in the order in which they are searched; none if its sides are too short."""
    tall, wide = box.height / 2.0 >= LEAF_DEGREES, box.width / 2.0 >= LEAF_DEGREES
    struct = lambda n, sw, ne: F.struct(F.lit(n).alias("n"), sw.lat.alias("sw_lat"), sw.lon.alias("sw_lon"), ne.lat.alias("ne_lat"), ne.lon.alias("ne_lon"))
    c = box.center
    four = F.array(struct(0, box.west, box.north), struct(1, c, box.ne), struct(2, box.sw, c), struct(3, box.south, box.east))
    across = F.array(struct(0, box.west, box.ne), struct(1, box.sw, box.east))
    along = F.array(struct(0, box.sw, box.north), struct(1, box.south, box.ne))
    return F.when(tall & wide, four).when(tall, across).when(wide, along)


def _levels(box: tuple[float, float, float, float]) -> int:
    """Levels under the root before both sides of a box are too short to halve."""
    tall, wide, levels = box[2] - box[0], box[3] - box[1], 0
    while tall / 2.0 >= LEAF_DEGREES or wide / 2.0 >= LEAF_DEGREES:
        tall, wide = (v / 2.0 if v / 2.0 >= LEAF_DEGREES else v for v in (tall, wide))
        levels += 1
    return levels + 1  # one more, as halves of halves are rounded


def build_index(edges: DataFrame, sw: tuple[float, float], ne: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """The tree's nodes (node, sw_lat, sw_lon, ne_lat, ne_lon, level, is_leaf, n_edges) and its leaf_edges (node, edge_id).

    A node splits while more than LEAF_EDGES edges touch its box with margin
    and its sides allow it.  As a child's box with margin lies in its
    parent's, a full node's parents are full as well, so the tree does not
    depend on the order of edges: each edge gets the boxes that it touches,
    level by level without an exchange, and counting them once tells which of
    the boxes are nodes.  Rows are the edges times the levels, a dozen for a map.
    """
    spark = edges.sparkSession
    root = F.struct(F.lit("r").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"), *(F.lit(float(v)).alias(c) for v, c in zip((*sw, *ne), _CORNERS)))
    shape = ["edge_id", "v1_lat", "v1_lon", "v2_lat", "v2_lon"]

    # expressions that all levels share
    touches, children = edge_touches(box_of("f_"), *ends()), _children(box_of())
    bare = lambda c: F.struct(*(c[x].alias(x) for x in ("node", "parent", "level", *_CORNERS)))
    child = lambda c: F.struct(F.concat("node", F.lit("."), c["n"].cast("string")).alias("node"), F.col("node").alias("parent"), (F.col("level") + 1).alias("level"), *(c[x].alias(x) for x in _CORNERS))
    # margins are made before boxes are taken apart, so that no test repeats them
    with_margin = lambda c: F.struct(bare(c).alias("at"), _margins(Bounds(LatLon(c["sw_lat"], c["sw_lon"]), LatLon(c["ne_lat"], c["ne_lon"]))).alias("f"))
    own, below = F.array(F.struct("node", "parent", "level", *_CORNERS)), F.transform(children, child)
    first, further = F.transform(F.array(root), with_margin), F.transform(F.concat(own, F.coalesce(F.when(F.col("level") == F.col("__level"), below), F.filter(own, lambda c: F.lit(False)))), with_margin)

    def touching(rows: DataFrame, boxes: Column, level: int) -> DataFrame:
        found = rows.select(*shape, F.explode(boxes).alias("x")).select(*shape, "x.at.*", *(F.col(f"x.f.{c}").alias(f"f_{c}") for c in _CORNERS))
        return found.filter((F.col("level") < level) | touches).select(*shape, "node", "parent", "level", *_CORNERS)

    held, depth = touching(edges, first, 0), _levels((*sw, *ne))
    for level in range(depth):
        held = touching(held.withColumn("__level", F.lit(level)), further, level + 1)
        if level % _TOGETHER == _TOGETHER - 1 or level == depth - 1:
            held = checkpointed(held)
    held = held.drop(*shape[1:])
    kids = F.when(F.col("n_edges") > LEAF_EDGES, _children(box_of()))
    full = held.groupBy("node", "parent", "level", *_CORNERS).agg(F.count(F.lit(1)).alias("n_edges")).withColumn("children", kids).filter("children is not null")
    boxes = full.select(F.col("node").alias("parent"), "level", F.explode("children").alias("c")).select(F.concat("parent", F.lit("."), F.col("c.n").cast("string")).alias("node"), (F.col("level") + 1).alias("level"), *(F.col(f"c.{x}").alias(x) for x in _CORNERS))
    boxes = spark.range(1).select(root.alias("at")).select("at.node", "at.level", *(f"at.{x}" for x in _CORNERS)).unionByName(boxes)
    counts = held.groupBy("node").agg(F.count(F.lit(1)).alias("n_edges"))
    split = full.select("node", F.lit(False).alias("is_leaf"))
    nodes = boxes.join(counts, "node", "left").join(split, "node", "left")
    nodes = nodes.select("node", *_CORNERS, "level", F.coalesce("is_leaf", F.lit(True)).alias("is_leaf"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
    leaf_edges = held.join(full.select("node"), "node", "left_anti").join(full.select(F.col("node").alias("up")), F.coalesce("parent", F.lit("")) == F.col("up"), "left_semi")
    alone = held.filter("level = 0").join(full.select("node"), "node", "left_anti")  # a root that is a leaf
    return nodes, leaf_edges.select("node", "edge_id").unionByName(alone.select("node", "edge_id"))


def kept_index(edges: DataFrame, sw: tuple[float, float], ne: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """build_index, once a session for a map and a box."""
    return kept(edges, ("index", *sw, *ne), lambda: build_index(edges, sw, ne))


def path_of(root: tuple[float, float, float, float], levels: int) -> Column:
    """The path of a point at lat, lon: the smallest box of the halved root that has it, by its name in the tree; of boxes that share a border, the one searched first.  Null outside the root.

    Every node that has the point, whatever its level, is a beginning of its
    path.  The boxes are halved with the arithmetic of build_index, so that
    borders agree to the last bit; as a fold, so that the expression does not
    grow with the levels.
    """
    lat, lon = F.col("lat"), F.col("lon")
    inside = in_bounds(Bounds(LatLon(*(F.lit(float(v)) for v in root[:2])), LatLon(*(F.lit(float(v)) for v in root[2:]))), LatLon(lat, lon))

    def halve(box: Column, _: Column) -> Column:
        own = Bounds(LatLon(box["sw_lat"], box["sw_lon"]), LatLon(box["ne_lat"], box["ne_lon"]))
        tall, wide, center = own.height / 2.0 >= LEAF_DEGREES, own.width / 2.0 >= LEAF_DEGREES, own.center
        low, right = tall & (lat < center.lat), wide & (lon > center.lon)
        number = F.when(low, F.when(wide, 2).otherwise(1)).otherwise(0) + F.when(right, 1).otherwise(0)
        return F.struct(
            F.when(tall | wide, F.concat(box["path"], F.lit("."), number.cast("string"))).otherwise(box["path"]).alias("path"),
            F.when(tall & ~low, center.lat).otherwise(own.sw.lat).alias("sw_lat"), F.when(right, center.lon).otherwise(own.sw.lon).alias("sw_lon"),
            F.when(low, center.lat).otherwise(own.ne.lat).alias("ne_lat"), F.when(wide & ~right, center.lon).otherwise(own.ne.lon).alias("ne_lon"),
        )

    start = F.struct(F.lit("r").alias("path"), *(F.lit(float(v)).alias(c) for c, v in zip(_CORNERS, root)))
    last = F.aggregate(F.array(*(F.lit(i) for i in range(levels))), start, halve)
    return F.when(inside, last["path"])


#: Leaves, or areas of roads, that are broadcast at most; they are counted first.
MOST_BROADCAST = 200_000


def leaf_levels(nodes: DataFrame) -> tuple[tuple[float, float, float, float], int, list[int], int]:
    """The root's box, the levels under it at most, the levels that have leaves, and how many leaves there are."""
    root = F.min(F.when(F.col("level") == 0, F.struct(*_CORNERS)))
    found = nodes.agg(root.alias("root"), F.sort_array(F.collect_set(F.when(F.col("is_leaf"), F.col("level")))).alias("levels"), F.count(F.when(F.col("is_leaf"), 1)).alias("n")).first()
    return tuple(found["root"]), _levels(tuple(found["root"])), found["levels"], found["n"]


def leaf_of(points: DataFrame, nodes: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of points with node: the leaf whose closed box has the point; of leaves that share a border, the one searched first.  Null outside the tree.

    A point's path has its boxes of all sizes, and leaves tile the root, so of
    a key for each level that has leaves exactly one meets a leaf: an equi-join
    whose rows don't depend on the area that leaves cover.
    """
    root, depth, levels, n = leaf_levels(nodes)
    leaves = nodes.filter("is_leaf").select(F.col("node").alias("__leaf"), F.lit(True).alias("__met"))
    name = lambda level: 1 + 2 * level  # noqa: E731  how long the names of a level are
    named = lambda path: F.when(path.isNotNull(), F.filter(F.array(*(F.when(F.length(path) >= name(level), F.substring(path, 1, name(level))) for level in levels)), lambda k: k.isNotNull()))
    keys = F.get(F.transform(F.array(path_of(root, depth)), named), 0)  # by way of an array, so that the path is made once
    rows = points.select(*keep, F.explode_outer(keys).alias("node"))
    met = rows.join(F.broadcast(leaves) if n <= MOST_BROADCAST else leaves, F.col("node") == F.col("__leaf"), "left")
    return met.filter("__met or node is null").select(*keep, "node")
