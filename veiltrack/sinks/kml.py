"""Annotated trips as KML, a document a trip."""

from __future__ import annotations

import math
from functools import cache
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import MAX_SPEED, SPEED_COLORS, LatLon, bearing, project
from ..operators.folds import fold_trips
from ..operators.roads import way_width
from .files import paths_of, write_files

#: Miles an hour in a metre a second; icons; colours (aabbggrr) and widths of the styles.
MPH = 2.23694
ICONS = {
    "start_style": ("http://maps.google.ca/mapfiles/kml/pal4/icon54.png", 1),
    "end_style": ("http://maps.google.ca/mapfiles/kml/pal4/icon7.png", 1),
    "stop_marker_style": ("http://maps.google.com/mapfiles/kml/paddle/S.png", 2),
    "turnaround_marker_style": ("http://maps.google.com/mapfiles/kml/paddle/T.png", 2),
}
BOXES = {"explicit_boxes": (0xFF990000, 1), "implicit_boxes": (0xFF0033FF, 1)}
LINES = {"ci_intervals": (0xFFFF00FF, 7), "priv_intervals": (0xFFFFFF00, 5)}
STRIDE, INTERVAL_STRIDE, BOX_WIDTH = 20, 10, 10.0


def number(value: float, digits: int = 10) -> str:
    return f"{value:.{digits}g}"


def _place(p: LatLon, digits: int = 10) -> str:
    return f"{number(p.lon, digits)},{number(p.lat, digits)},0"


def element(tag: str, *inner: str, **attributes: str) -> str:
    """One element with its children, each on its own line."""
    head = "".join(f' {k}="{escape(str(v))}"' for k, v in attributes.items())
    body = inner[0] if len(inner) == 1 and "\n" not in inner[0] and "<" not in inner[0] else "\n" + "\n".join(inner) + "\n"
    return f"<{tag}{head}>{body}</{tag}>"


def icon_style(name: str, href: str, scale: float = 1) -> str:
    return element("Style", element("IconStyle", element("Icon", element("href", href)), '<hotSpot x="0.5" xunits="fraction" y="0.5" yunits="fraction"/>', element("scale", number(scale))), id=name)


def line_style(name: str, color: int, width: int) -> str:
    return element("Style", element("LineStyle", element("color", f"{color:x}"), element("width", str(width)), element("gx:labelVisibility", "1")), id=name)


def poly_style(name: str, color: int, width: int, fill: bool = True, outline: bool = True) -> str:
    """A line style and a fill of its colour, made transparent."""
    clear = color & 0x00FFFFFF | 0x55000000
    return element("Style", element("LineStyle", element("color", f"{color:x}"), element("width", str(width))), element("PolyStyle", element("color", f"{clear:x}"), element("colorMode", "normal"), element("fill", str(int(fill))), element("outline", str(int(outline)))), id=name)


def folder(name: str, *inner: str, description: str = "", ident: str = "") -> str:
    return element("Folder", element("name", escape(name)), element("description", escape(description or name)), element("visibility", "0"), element("open", "0"), *inner, **({"id": ident} if ident else {}))


def point_mark(p: LatLon, style: str) -> str:
    return element("Placemark", element("styleUrl", f"#{style}"), element("description", style), element("Point", element("gx:altitudeMode", "clampToGround"), element("coordinates", _place(p))))


def line_mark(name: str, style: str, places: list[LatLon]) -> str:
    """A line, if there is more than one place."""
    labels = [element("name", escape(name))] * bool(name) + [element("styleUrl", f"#{style}")] * bool(style)
    return element("Placemark", *labels, *([element("LineString", element("coordinates", " ".join(map(_place, places)) + "\n"))] if len(places) > 1 else []))


def polygon_mark(ring: list[LatLon], style: str, name: str = "", digits: int = 10) -> str:
    labels = [element("name", escape(name))] * bool(name) + [element("styleUrl", f"#{style}")] * bool(style)
    around = " ".join(_place(p, digits) for p in [*ring, ring[0]])
    return element("Placemark", *labels, element("Polygon", element("extrude", "0"), element("altitudeMode", "clampToGround"), element("outerBoundaryIs", element("LinearRing", element("coordinates", around + "\n")))))


def circle_mark(center: LatLon, radius: float, style: str, name: str = "", segments: int = 36) -> str:
    if segments < 3:
        raise ValueError("a circle has three segments or more")
    return polygon_mark([project(center, 360.0 / segments * i, radius) for i in range(segments)], style, name, 16)


def bounds_mark(sw: LatLon, ne: LatLon, style: str) -> str:
    return polygon_mark([sw, LatLon(sw.lat, ne.lon), ne, LatLon(ne.lat, sw.lon)], style, digits=16)


def color_of(speed: float) -> int:
    return SPEED_COLORS[min(int(speed / MAX_SPEED * len(SPEED_COLORS)), len(SPEED_COLORS) - 1)]


def trajectory(places: list[LatLon], speeds: list[float], hidden: list[bool], stride: int = STRIDE) -> str:
    """Segments of one speed colour, every stride-th point; they leave out hidden points and start anew after them."""
    n, at, marks = len(places), 0, []
    while at < n:
        if hidden[at]:
            at += 1
            continue
        color, line = color_of(speeds[at]), []
        name = f"MPH = {number(speeds[at] * MPH)}"
        while True:
            line.append(places[at])
            shut, own = hidden[at], color_of(speeds[at])
            at += stride
            if shut or at >= n or (len(line) > 1 and own != color):
                break
        if at >= n and not shut:
            line.append(places[-1])
        else:
            at = at - stride if not shut else at - stride + 1  # the next segment starts where this one ended
        marks.append(line_mark(name, f"lcolor_{color}", line) if len(line) > 1 else "")
    return folder("trajectory-full", point_mark(places[0], "start_style"), *filter(None, marks), point_mark(places[-1], "end_style"), description="trip point list", ident="TRAJ")


def trajectory_simple(name: str, style: str, places: list[LatLon], stride: int = STRIDE) -> str:
    """One line of every stride-th point and the last."""
    return folder("trajectory-simple", point_mark(places[0], "start_style"), line_mark(name, style, [*places[::stride], places[-1]]), point_mark(places[-1], "end_style"), description="trip point list", ident="TRAJ")


def intervals(spans: list[tuple[int, int]], places: list[LatLon], style: str, marker: str = "", stride: int = INTERVAL_STRIDE) -> str:
    """A line along each interval, with a mark at its start if there is a marker."""
    marks = []
    for left, right in spans:
        inside = places[left:right]
        if inside:
            marks += [point_mark(inside[0], marker)] * bool(marker) + [line_mark(style, style, [*inside[::stride], inside[-1]])]
    return folder(marker or style, *marks, ident="intervals")


def areas(rings: list[list[LatLon]], style: str) -> str:
    return folder(style, *(polygon_mark(r, style) for r in rings), ident="areas")


@cache
def _styles() -> tuple[str, ...]:
    """The styles of every document, made once a worker."""
    return (*(icon_style(n, *v) for n, v in ICONS.items()), *(line_style(f"lcolor_{c}", c, 2) for c in SPEED_COLORS), *(poly_style(n, *v) for n, v in BOXES.items()), *(line_style(n, *v) for n, v in LINES.items()))


def document(name: str, *folders: str) -> str:
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + element("kml", element("Document", element("name", escape(name)), element("open", "0"), *_styles(), *folders), xmlns="http://www.opengis.net/kml/2.2", **{"xmlns:gx": "http://www.google.com/kml/ext/2.2"})


def road_area(v1: LatLon, v2: LatLon, width: float, extension: float) -> list[LatLon]:
    """The area of a road as the fit has it: of the road's bearing, lengthened at both ends."""
    course = bearing(v1, v2)
    turned = lambda by: math.fmod(course + by, 360.0)
    if extension > 0:
        v1, v2 = project(v1, turned(-180.0), extension), project(v2, course, extension)
    return [project(v, turned(by), width / 2.0) for v, by in ((v1, -90.0), (v2, -90.0), (v2, 90.0), (v1, 90.0))]


def trip_kml(marked: DataFrame, found: DataFrame, fit_scale: float = 1.0, fit_extension: float = 5.0) -> DataFrame:
    """trip_id, content: each trip with its points, the areas of its edges and its intervals (trip_id, left, right, aux of all detectors and of the privacy search).  Roads have the areas of the fit, by the width of their way type, scale and extension."""
    spans = found.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("left", "right", "aux"))).alias("spans"))
    rows = marked.join(spans, "trip_id", "left").select("trip_id", "idx", "lat", "lon", "speed", "edge_explicit", "edge_id", "v1_lat", "v1_lon", "v2_lat", "v2_lon", (way_width(F.col("edge_way_type")) * fit_scale).alias("width"), (F.col("is_critical") | F.col("is_private")).alias("hidden"), "spans")

    def draw(table: pa.Table) -> pa.Table:
        trip = {c: table.column(c).to_pylist() for c in table.column_names if c not in ("trip_id", "idx", "spans")}
        places = [LatLon(a, b) for a, b in zip(trip["lat"], trip["lon"])]
        held = table.column("spans")[0].as_py() or []
        tagged = lambda test: [(s["left"], s["right"]) for s in held if any(test(a) for a in s["aux"])]
        boxes: dict[bool, list] = {True: [], False: []}
        seen = set()
        for e, edge, width, *v in zip(*(trip[c] for c in ("edge_explicit", "edge_id", "width", "v1_lat", "v1_lon", "v2_lat", "v2_lon"))):
            if (e, edge) in seen:
                continue
            seen.add((e, edge))
            ends = LatLon(*v[:2]), LatLon(*v[2:])
            boxes[bool(e)].append(road_area(*ends, width, fit_extension) if e else road_area(*ends, BOX_WIDTH, 0.0))
        content = document(
            str(table.column("trip_id")[0].as_py()),
            trajectory(places, trip["speed"], trip["hidden"]),
            areas(boxes[True], "explicit_boxes"),
            areas(boxes[False], "implicit_boxes"),
            intervals(tagged(lambda a: a == "stop"), places, "ci_intervals", "stop_marker_style"),
            intervals(tagged(lambda a: a in ("ta", "ta_fit")), places, "ci_intervals", "turnaround_marker_style"),
            intervals(tagged(lambda a: ":" in a), places, "priv_intervals"),
        )
        return pa.table({"trip_id": table.column("trip_id").slice(0, 1), "content": [content]})

    return fold_trips(rows, ["idx"], draw, f"trip_id {marked.schema['trip_id'].dataType.simpleString()}, content string")


def write_kml(kml: DataFrame, folder_path: str) -> DataFrame:
    """Files folder/trip_id.di.kml, which appear when all are written; gives trip_id and path of each."""
    write_files(kml, F.col("trip_id"), F.col("content"), folder_path, ".di.kml", [])
    return paths_of(kml, "trip_id", folder_path, ".di.kml")
