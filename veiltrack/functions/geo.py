"""Geodesy on a sphere and plane geometry in degrees, as column expressions.

Positions are pairs of latitude and longitude in degrees, lengths are metres,
bearings degrees clockwise from north.  The formulas that grouped-map folds
need as well take plain floats too: they pick their functions by the type of
what they get.  Everything else builds Spark expressions only, so it stays in
generated code.  Remainders keep the sign of the dividend, which is ``%`` in
Spark SQL.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere's radius in metres, and what two GPS degrees may differ by and be equal.
EARTH_RADIUS_M = 6378137.0
GPS_EPSILON = 100 * 2.220446049250313e-16


class _Floats:
    radians, degrees, sin, cos, asin, atan2, sqrt, fmod = math.radians, math.degrees, math.sin, math.cos, math.asin, math.atan2, math.sqrt, math.fmod


class _Columns:
    radians, degrees, sin, cos, asin, atan2, sqrt = F.radians, F.degrees, F.sin, F.cos, F.asin, F.atan2, F.sqrt

    @staticmethod
    def fmod(a: Column, b: float) -> Column:
        return a % F.lit(b)


def _by(*values):
    return _Columns if any(isinstance(v, Column) for v in values) else _Floats


class LatLon(NamedTuple):
    """A position: two columns, or two floats."""

    lat: Column | float
    lon: Column | float


def point(lat, lon) -> LatLon:
    """A position from columns or their names."""
    return LatLon(*(F.col(x) if isinstance(x, str) else x for x in (lat, lon)))


# Distances, projections and bearings


def distance(a: LatLon, b: LatLon):
    """Equirectangular distance; longitudes are not wrapped."""
    m = _by(*a, *b)
    x = (m.radians(b.lon) - m.radians(a.lon)) * m.cos((m.radians(a.lat) + m.radians(b.lat)) / 2.0)
    y = m.radians(b.lat) - m.radians(a.lat)
    return m.sqrt(x * x + y * y) * EARTH_RADIUS_M


def haversine(a: LatLon, b: LatLon):
    m = _by(*a, *b)
    x, y = m.sin(m.radians(b.lat - a.lat) / 2.0), m.sin(m.radians(b.lon - a.lon) / 2.0)
    return 2.0 * m.asin(m.sqrt(x * x + m.cos(m.radians(a.lat)) * m.cos(m.radians(b.lat)) * y * y)) * EARTH_RADIUS_M


def _wrapped(m, lon_radians):
    return m.fmod(m.degrees(lon_radians) + 540.0, 360.0) - 180.0


def project(a: LatLon, bearing_deg, metres) -> LatLon:
    """Where a great circle leads from a."""
    m = _by(*a, bearing_deg, metres)
    if m is _Columns:
        bearing_deg, metres = (v if isinstance(v, Column) else F.lit(float(v)) for v in (bearing_deg, metres))
    angle, course, lat = metres / EARTH_RADIUS_M, m.radians(bearing_deg), m.radians(a.lat)
    to = m.asin(m.sin(lat) * m.cos(angle) + m.cos(lat) * m.sin(angle) * m.cos(course))
    lon = m.radians(a.lon) + m.atan2(m.sin(course) * m.sin(angle) * m.cos(lat), m.cos(angle) - m.sin(lat) * m.sin(to))
    return LatLon(m.degrees(to), _wrapped(m, lon))


def midpoint(a: LatLon, b: LatLon) -> LatLon:
    m = _by(*a, *b)
    lat1, lat2, turn = m.radians(a.lat), m.radians(b.lat), m.radians(b.lon) - m.radians(a.lon)
    bx, by = m.cos(lat2) * m.cos(turn), m.cos(lat2) * m.sin(turn)
    lat = m.atan2(m.sin(lat1) + m.sin(lat2), m.sqrt((m.cos(lat1) + bx) * (m.cos(lat1) + bx) + by * by))
    return LatLon(m.degrees(lat), _wrapped(m, m.radians(a.lon) + m.atan2(by, m.cos(lat1) + bx)))


def bearing(a: LatLon, b: LatLon):
    """Initial bearing from a to b, in [0, 360)."""
    m = _by(*a, *b)
    lat1, lat2, turn = m.radians(a.lat), m.radians(b.lat), m.radians(b.lon) - m.radians(a.lon)
    x, y = m.sin(turn) * m.cos(lat2), m.cos(lat1) * m.sin(lat2) - m.sin(lat1) * m.cos(lat2) * m.cos(turn)
    return m.fmod(m.degrees(m.atan2(x, y)) + 360.0, 360.0)


def same_point(a: LatLon, b: LatLon) -> Column:
    return (F.abs(a.lat - b.lat) < GPS_EPSILON) & (F.abs(a.lon - b.lon) < GPS_EPSILON)


# Edges: segments between two positions


def same_edge(a1: LatLon, a2: LatLon, b1: LatLon, b2: LatLon) -> Column:
    """Equal ends, in either order."""
    return (same_point(a1, b1) & same_point(a2, b2)) | (same_point(a1, b2) & same_point(a2, b1))


def point_edge_distance(p: LatLon, v1: LatLon, v2: LatLon) -> Column:
    """To the nearest position on the segment, found in degrees; 0 for an edge without length."""
    dlat, dlon = v2.lat - v1.lat, v2.lon - v1.lon
    norm = dlat * dlat + dlon * dlon
    t = ((p.lat - v1.lat) * dlat + (p.lon - v1.lon) * dlon) / norm
    foot = LatLon(v1.lat + t * dlat, v1.lon + t * dlon)
    return F.when(F.abs(norm) < GPS_EPSILON, F.lit(0.0)).when(t <= 0.0, distance(p, v1)).when(t >= 1.0, distance(p, v2)).otherwise(distance(foot, p))


def segments_cross(a1: LatLon, a2: LatLon, b1: LatLon, b2: LatLon) -> Column:
    """Closed segments in degrees; parallel ones do not cross."""
    alat, alon, blat, blon = a2.lat - a1.lat, a2.lon - a1.lon, b2.lat - b1.lat, b2.lon - b1.lon
    d = alat * blon - blat * alon
    xlat, xlon = a1.lat - b1.lat, a1.lon - b1.lon
    safe = F.when(F.abs(d) < GPS_EPSILON, F.lit(None).cast("double")).otherwise(d)
    s, t = (alat * xlon - alon * xlat) / safe, (blat * xlon - blon * xlat) / safe
    return F.coalesce((s >= 0.0) & (s <= 1.0) & (t >= 0.0) & (t <= 1.0), F.lit(False))


def edge_area(v1: LatLon, v2: LatLon, width, extension=0.0) -> list[LatLon]:
    """Four corners of the rectangle of that width around an edge, lengthened at both ends; null where the width isn't above 0.  The corners keep the bearing of the edge as it was."""
    width = width if isinstance(width, Column) else F.lit(float(width))
    wide = F.when(width > 0, width / 2.0)
    course = bearing(v1, v2)
    if isinstance(extension, Column) or extension > 0:
        v1, v2 = project(v1, (course - 180.0) % 360.0, extension), project(v2, course, extension)
    left, right = (course - 90.0) % 360.0, (course + 90.0) % 360.0
    return [project(v1, left, wide), project(v2, left, wide), project(v2, right, wide), project(v1, right, wide)]


def outside_side(corners: list[LatLon], side: int, p: LatLon):
    """Whether p is beyond one of the four sides of an area; other sides have no outside."""
    if side not in (0, 1, 2, 3):
        return F.lit(False)
    a, b = corners[side], corners[(side + 1) % 4]
    return (a.lat * (b.lon - a.lon) - a.lon * (b.lat - a.lat)) - p.lat * (b.lon - a.lon) + p.lon * (b.lat - a.lat) < 0.0


def area_contains(corners: list[LatLon], p: LatLon) -> Column:
    """The border is inside."""
    out = outside_side(corners, 0, p)
    for side in (1, 2, 3):
        out = out | outside_side(corners, side, p)
    return ~out


# Bounds: boxes along the axes, closed on all sides


class Bounds(NamedTuple):
    sw: LatLon
    ne: LatLon

    @property
    def nw(self) -> LatLon:
        return LatLon(self.ne.lat, self.sw.lon)

    @property
    def se(self) -> LatLon:
        return LatLon(self.sw.lat, self.ne.lon)

    @property
    def width(self):
        return self.ne.lon - self.sw.lon

    @property
    def height(self):
        return self.ne.lat - self.sw.lat

    @property
    def center(self) -> LatLon:
        return LatLon(self.sw.lat + self.height / 2.0, self.sw.lon + self.width / 2.0)

    @property
    def west(self) -> LatLon:
        return LatLon(self.sw.lat + self.height / 2.0, self.sw.lon)

    @property
    def east(self) -> LatLon:
        return LatLon(self.sw.lat + self.height / 2.0, self.ne.lon)

    @property
    def north(self) -> LatLon:
        return LatLon(self.ne.lat, self.sw.lon + self.width / 2.0)

    @property
    def south(self) -> LatLon:
        return LatLon(self.sw.lat, self.sw.lon + self.width / 2.0)

    @property
    def corners(self) -> list[LatLon]:
        return [self.sw, self.nw, self.ne, self.se]


def bounds(sw_lat, sw_lon, ne_lat, ne_lon) -> Bounds:
    """From columns, names of columns or numbers."""
    lift = lambda v: F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v))
    return Bounds(LatLon(lift(sw_lat), lift(sw_lon)), LatLon(lift(ne_lat), lift(ne_lon)))


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def in_bounds(box: Bounds, p: LatLon) -> Column:
    return (box.sw.lat <= p.lat) & (p.lat <= box.ne.lat) & (box.sw.lon <= p.lon) & (p.lon <= box.ne.lon)


def bounds_contains_edge(box: Bounds, v1: LatLon, v2: LatLon) -> Column:
    return in_bounds(box, v1) & in_bounds(box, v2)


def bounds_cross_edge(box: Bounds, v1: LatLon, v2: LatLon) -> Column:
    c = box.corners
    return _any(segments_cross(v1, v2, c[i], c[(i + 1) % 4]) for i in range(4))


def edge_touches(box: Bounds, v1: LatLon, v2: LatLon) -> Column:
    """An end is inside, or a side is crossed."""
    return in_bounds(box, v1) | in_bounds(box, v2) | bounds_cross_edge(box, v1, v2)


def area_touches(corners: list[LatLon], box: Bounds) -> Column:
    """A corner of one lies in the other, or sides cross."""
    return _any(in_bounds(box, c) for c in corners) | _any(area_contains(corners, c) for c in box.corners) | _any(bounds_cross_edge(box, corners[i], corners[(i + 1) % 4]) for i in range(4))


def bounds_touch(a: Bounds, b: Bounds) -> Column:
    """A corner of one box lies in the other; boxes that cross like a plus sign do not touch."""
    return _any(in_bounds(b, c) for c in a.corners) | _any(in_bounds(a, c) for c in b.corners)


# Circles


def cardinals(center: LatLon, radius) -> list[LatLon]:
    """North, east, south and west of a circle."""
    return [project(center, course, radius) for course in (0.0, 90.0, 180.0, 270.0)]


def circle_contains(center: LatLon, radius, p: LatLon) -> Column:
    return distance(center, p) <= radius


def circle_touches(center: LatLon, radius, box: Bounds) -> Column:
    return _any(in_bounds(box, c) for c in [center, *cardinals(center, radius)]) | _any(circle_contains(center, radius, c) for c in box.corners)


def bounds_contains_circle(box: Bounds, center: LatLon, radius) -> Column:
    c = cardinals(center, radius)
    return in_bounds(box, c[0]) & in_bounds(box, c[1]) & in_bounds(box, c[2]) & in_bounds(box, c[3])


def bounds_cross_circle(box: Bounds, center: LatLon, radius) -> Column:
    """By the diamond of the circle's four cardinal points."""
    c = cardinals(center, radius)
    return _any(bounds_cross_edge(box, c[i], c[(i + 1) % 4]) for i in range(4))


def same_circle(a: LatLon, a_radius, b: LatLon, b_radius) -> Column:
    return same_point(a, b) & (F.abs(a_radius - b_radius) < GPS_EPSILON)


# Headings, degrees of vertices, colours


def heading_delta(a: Column, b: Column) -> Column:
    """The smaller angle between two headings."""
    d = F.abs(a - b)
    return F.when(d < 180.0, d).otherwise(360.0 - d)


def diff_180(a: Column, b: Column) -> Column:
    """A difference of angles brought to [0, 180] from either side."""
    d = a - b
    return F.when(d > 180.0, F.abs(d - 360.0)).when(d < -180.0, d + 360.0).otherwise(F.abs(d))


def angle_error(a: Column, b: Column) -> Column:
    """Of two directions without regard to which way they run: 0 to 90."""
    return F.least(diff_180(a, b), diff_180(a, (b + 180.0) % 360.0))


def consistent_with(heading: Column, edge_bearing: Column) -> Column:
    return angle_error(heading, edge_bearing) < 15.0


def outdegree(degree: Column) -> Column:
    """Choices at a vertex: none for a mere bend or an end."""
    return F.when(degree > 2, degree - 1).otherwise(F.lit(0))


def heading_sector(heading: Column, sectors: int) -> Column:
    return F.floor(heading / (360.0 / sectors)).cast("bigint") % sectors


#: Metres a second from which the last colour holds; colours are aabbggrr, red to yellow, then to green.
MAX_SPEED = 36.0
SPEED_COLORS = [0xFF0000FF | green << 8 for green in range(0, 256, 16)] + [0xFF00FF00 | red for red in range(255, -1, -16)]


def speed_color(speed: Column) -> Column:
    """Number of a speed's colour, as a bigint."""
    n = len(SPEED_COLORS)
    step = F.least((speed / MAX_SPEED * float(n)).cast("int"), F.lit(n - 1))
    return F.element_at(F.array(*(F.lit(c).cast("bigint") for c in SPEED_COLORS)), step + 1)


def grid_tiles(nw_lat: float, nw_lon: float, metres: float, lat_limit: float, lon_limit: float) -> list[tuple]:
    """Tiles of that width, row by row from the north-west: (row, col, sw_lat, sw_lon, ne_lat, ne_lon).  Each tile starts where the one before it ended, so this is a recurrence over a small table."""
    out, row, lat = [], 0, nw_lat
    while lat > lat_limit:
        col, lon = 0, nw_lon
        south = project(LatLon(lat, lon), 180.0, metres).lat
        while lon < lon_limit:
            east = project(LatLon(lat, lon), 90.0, metres).lon
            out.append((row, col, south, lon, lat, east))
            col, lon = col + 1, east
        row, lat = row + 1, south
    return out
