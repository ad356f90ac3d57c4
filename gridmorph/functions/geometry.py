"""Column expressions for rings, heights and shape ratios."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attribute keys that hold metres, those that hold storeys, and the number pattern.
METRE_KEYS = ("height", "building:height", "HEIGHT", "Height", "h")
LEVEL_KEYS = ("building:levels", "levels", "floors", "этажность")
NUMBER = r"([-+]?\d+(?:[.,]\d+)?)"
FOOT = 0.3048


def ring_area(ring: Column) -> Column:
    """Signed area of a ring of structs (x, y) by the shoelace sum."""
    n = F.size(ring)
    shifted = F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, F.lit(1), F.lit(1)))
    terms = F.zip_with(ring, shifted, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def ring_perimeter(ring: Column) -> Column:
    n = F.size(ring)
    shifted = F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, F.lit(1), F.lit(1)))
    sides = F.zip_with(ring, shifted, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(sides, F.lit(0.0), lambda s, t: s + t)


def compactness_2d(area: Column, perimeter: Column) -> Column:
    return F.when((area > 0) & (perimeter > 0), 4 * F.pi() * area / (perimeter * perimeter))


def compactness_3d(volume: Column, surface: Column) -> Column:
    return F.when((volume > 0) & (surface > 0), 36 * F.pi() * volume * volume / (surface * surface * surface))


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, else null."""
    return F.when(b > 0, a / b)


def parsed_height(text: Column) -> Column:
    """Metres in a free-form height: first number, comma or point, feet converted; null unless positive."""
    low = F.lower(F.trim(text))
    number = F.replace(F.regexp_extract(low, NUMBER, 1), F.lit(","), F.lit(".")).try_cast("double")
    metres = F.when(low.contains("ft") | low.contains("feet"), number * FOOT).otherwise(number)
    return F.when(metres > 0, metres)


def height_and_source(attributes: Column, storey: float = 3.0, default: float = 12.0) -> Column:
    """struct(value, source) from a map of attributes: metres first, then storeys, then the default."""
    found = [F.when(parsed_height(attributes[k]).isNotNull(), F.struct(parsed_height(attributes[k]).alias("value"), F.lit(k).alias("source"))) for k in METRE_KEYS]
    found += [F.when(parsed_height(attributes[k]).isNotNull(), F.struct((parsed_height(attributes[k]) * storey).alias("value"), F.lit(k).alias("source"))) for k in LEVEL_KEYS]
    return F.coalesce(*found, F.struct(F.lit(float(default)).alias("value"), F.lit("default").alias("source")))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(a))


def utm_srid(lon: Column, lat: Column) -> Column:
    """SRID of the point's UTM zone."""
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


#: Fixed values of the ellipsoid (WGS 84) and of the UTM grid.
EQUATOR, FLATTENING = 6378137.0, 1 / 298.257223563
UTM_SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500_000.0, 10_000_000.0
#: Latitude of true scale of the cylindrical equal-area grid, in degrees.
EQUAL_AREA_PARALLEL = 30.0


def utm(lon: Column, lat: Column, zone: Column | None = None, south: Column | None = None) -> Column:
    """struct(x, y) in metres in the point's own UTM zone, by the third-order Krüger series.

    All points of a site share the zone (0..59) and hemisphere that are given.
    """
    n = FLATTENING / (2 - FLATTENING)
    radius = UTM_SCALE * EQUATOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    zone = F.least(F.floor((lon + 180) / 6), F.lit(59)) if zone is None else zone
    dlon = F.radians(lon - (zone * 6 - 177))
    sine = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(dlon)), F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))
    x = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(series, 1)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(series, 1)), F.lit(0.0))
    return F.struct((FALSE_EASTING + radius * x).alias("x"), (radius * y + F.when(lat < 0 if south is None else south, FALSE_NORTHING).otherwise(0.0)).alias("y"))


def equal_area(lon: Column, lat: Column) -> Column:
    """struct(x, y) in metres on the cylindrical equal-area grid."""
    e2 = FLATTENING * (2 - FLATTENING)
    e, s0 = math.sqrt(e2), math.sin(math.radians(EQUAL_AREA_PARALLEL))
    k0 = math.cos(math.radians(EQUAL_AREA_PARALLEL)) / math.sqrt(1 - e2 * s0 * s0)
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) + F.atanh(e * s) / e)
    return F.struct((EQUATOR * k0 * F.radians(lon)).alias("x"), (EQUATOR / (2 * k0) * q).alias("y"))


def projected_ring(ring: Column, to=utm) -> Column:
    """A ring of structs (x: longitude, y: latitude) in metres."""
    return F.transform(ring, lambda p: to(p["x"], p["y"]))


#: Latitudes that the zones cover; beyond them the spherical web grid serves.
UTM_SOUTH, UTM_NORTH = -80.0, 84.0


def web_mercator(lon: Column, lat: Column) -> Column:
    """struct(x, y) in metres on the spherical web grid (SRID 3857)."""
    return F.struct((EQUATOR * F.radians(lon)).alias("x"), (EQUATOR * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))).alias("y"))


def metric_srid(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """SRID of the grid for an extent: the UTM zone of its middle, or the web grid where no zone reaches."""
    lon, lat = (min_lon + max_lon) / 2, (min_lat + max_lat) / 2
    return F.when(lat.between(UTM_SOUTH, UTM_NORTH) & lon.between(-180, 180), utm_srid(lon, lat)).otherwise(F.lit(3857))


def to_metric(rings: Column, srid: Column) -> Column:
    """Rings of (x: longitude, y: latitude) in metres on the grid of the SRID."""
    zone, south = F.pmod(srid, F.lit(100)) - 1, srid >= 32700

    def project(p):
        return F.when(srid == 3857, web_mercator(p["x"], p["y"])).otherwise(utm(p["x"], p["y"], zone, south))

    return F.transform(rings, lambda r: F.transform(r, project))


def with_heights(features, storey: float = 3.0, default: float = 12.0):
    """features(attrs: map) with ``height`` in metres and ``source``, the attribute it comes from."""
    keys = F.array(*[F.lit(k) for k in (*METRE_KEYS, *LEVEL_KEYS)])
    known = F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at("attrs", k)))
    return features.withColumn("h_", height_and_source(known, storey, default)).withColumns({"height": F.col("h_")["value"], "source": F.col("h_")["source"]}).drop("h_")
