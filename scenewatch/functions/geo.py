"""Plane and map coordinates as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half the length of the equator in Web Mercator, and the WGS84 ellipsoid.
HALF_EQUATOR = 20037508.342789244
SEMI_MAJOR, FLATTENING, UTM_SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
THIRD = FLATTENING / (2 - FLATTENING)
RADIUS = SEMI_MAJOR / (1 + THIRD) * (1 + THIRD**2 / 4 + THIRD**4 / 64)
ALPHA = (THIRD / 2 - 2 * THIRD**2 / 3 + 5 * THIRD**3 / 16, 13 * THIRD**2 / 48 - 3 * THIRD**3 / 5, 61 * THIRD**3 / 240)
BETA = (THIRD / 2 - 2 * THIRD**2 / 3 + 37 * THIRD**3 / 96, THIRD**2 / 48 + THIRD**3 / 15, 17 * THIRD**3 / 480)
DELTA = (2 * THIRD - 2 * THIRD**2 / 3 - 2 * THIRD**3, 7 * THIRD**2 / 3 - 8 * THIRD**3 / 5, 56 * THIRD**3 / 15)


def pixel_to_world(gt: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """World position of a pixel position by the six numbers of an affine transform."""
    return gt[0] + x * gt[1] + y * gt[2], gt[3] + x * gt[4] + y * gt[5]


def world_to_pixel(gt: Column, wx: Column, wy: Column) -> tuple[Column, Column]:
    """Index of the pixel that holds a world position, for grids without rotation."""
    return F.floor((wx - gt[0]) / gt[1]), F.floor((wy - gt[3]) / gt[5])


def nearest_index(world: Column, origin: Column, pixel: Column) -> Column:
    """Index of the pixel whose centre is nearest, halves away from zero."""
    at = (world - origin) / pixel - 0.5
    return (F.signum(at) * F.floor(F.abs(at) + 0.5)).cast("int")


def lonlat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator metres; latitudes are clamped to 89.5 degrees."""
    low = F.greatest(F.lit(-89.5), F.least(F.lit(89.5), lat))
    return lon * HALF_EQUATOR / 180.0, F.log(F.tan((90.0 + low) * math.pi / 360.0)) * HALF_EQUATOR / math.pi


def mercator_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    return x * 180.0 / HALF_EQUATOR, F.atan(F.exp(y * math.pi / HALF_EQUATOR)) * 360.0 / math.pi - 90.0


def wgs84_to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a UTM zone (negative numbers: south) by Krueger's series, to about a millimetre."""
    middle = F.radians(F.abs(zone) * 6 - 183.0)
    phi, lam = F.radians(lat), F.radians(lon) - middle
    root = 2 * math.sqrt(THIRD) / (1 + THIRD)
    sin = F.sin(phi)
    t = F.sinh(F.atanh(sin) - root * F.atanh(root * sin))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return FALSE_EAST + UTM_SCALE * RADIUS * east, F.when(zone < 0, FALSE_NORTH).otherwise(0.0) + UTM_SCALE * RADIUS * north


def utm_to_wgs84(east: Column, north: Column, zone: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a position in a UTM zone (negative numbers: south)."""
    xi0 = (north - F.when(zone < 0, FALSE_NORTH).otherwise(0.0)) / (UTM_SCALE * RADIUS)
    eta0 = (east - FALSE_EAST) / (UTM_SCALE * RADIUS)
    xi, eta = xi0, eta0
    for k, b in enumerate(BETA, 1):
        xi = xi - b * F.sin(2 * k * xi0) * F.cosh(2 * k * eta0)
        eta = eta - b * F.cos(2 * k * xi0) * F.sinh(2 * k * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for k, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * k * chi)
    return F.abs(zone) * 6 - 183.0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(phi)


def rect_ring(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """The closed ring of a rectangle, five points."""
    corners = ((min_x, min_y), (max_x, min_y), (max_x, max_y), (min_x, max_y), (min_x, min_y))
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])


def envelopes_touch(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two rectangles share a point; edges count."""
    return (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])


def as_multipolygon(kind: Column, coordinates: Column) -> Column:
    """Coordinates text of a Polygon wrapped as that of a MultiPolygon; others null. See collection_parts() for collections."""
    return F.when(kind == "Polygon", F.concat(F.lit("["), coordinates, F.lit("]"))).when(kind == "MultiPolygon", coordinates)


def collection_parts(geometries: Column) -> Column:
    """The polygons of a collection's geometries (type, coordinates as text), each as an array of rings; others are left out."""
    rings = "array<array<array<double>>>"
    one = F.transform(F.filter(geometries, lambda g: g["type"] == "Polygon"), lambda g: F.from_json(F.concat(F.lit("["), g["coordinates"], F.lit("]")), f"array<{rings}>"))
    many = F.transform(F.filter(geometries, lambda g: g["type"] == "MultiPolygon"), lambda g: F.from_json(g["coordinates"], f"array<{rings}>"))
    return F.flatten(F.concat(one, many))


def sieve_pixels(min_area: Column, pixel: Column) -> Column:
    """The least size in pixels that a sieve keeps: that of min_area, eight at least."""
    return F.when(F.coalesce(min_area, F.lit(0.0)) <= 0, 8).otherwise(F.greatest(F.lit(8), F.ceil(min_area / (pixel * pixel)))).cast("int")


def window_owner(at: Column, tile: int, bound: int) -> Column:
    """Which window along one axis gives a pixel its result: later windows overwrite what they share."""
    step = tile - 2 * bound
    if step <= 0:
        raise ValueError(f"windows of {tile} with a bound of {bound} do not advance")
    return F.greatest(F.lit(0), F.floor((at - bound) / step)).cast("int")
