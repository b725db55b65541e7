"""WGS84 and flat-earth geometry as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid, and metres in a degree of the flat approximation.
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
B = A * (1 - FLATTENING)
METRES_PER_DEGREE = 111320.0


def geodetic_to_ecef(lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(A) / F.sqrt(1 - F.lit(E2) * F.sin(phi) * F.sin(phi))
    return (n + h) * F.cos(phi) * F.cos(lam), (n + h) * F.cos(phi) * F.sin(lam), (n * (1 - E2) + h) * F.sin(phi)


def ecef_to_geodetic(x: Column, y: Column, z: Column, steps: int = 6) -> tuple[Column, Column, Column]:
    """Longitude, latitude, height, by a fixed number of iterations of the latitude."""
    p = F.sqrt(x * x + y * y)

    def step(lat: Column, _: Column) -> Column:
        s = F.sin(lat)
        n = F.lit(A) / F.sqrt(1 - F.lit(E2) * s * s)
        return F.atan2(z + F.lit(E2) * n * s, p)

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.atan2(z, p * (1 - E2)), step)
    s, c = F.sin(lat), F.cos(lat)
    n = F.lit(A) / F.sqrt(1 - F.lit(E2) * s * s)
    height = F.when(F.abs(c) > 1e-9, p / c - n).otherwise(F.abs(z) - B)
    return F.degrees(F.atan2(y, x)), F.degrees(lat), height


def ecef_to_enu(x: Column, y: Column, z: Column, lon0: Column, lat0: Column, h0: Column) -> tuple[Column, Column, Column]:
    x0, y0, z0 = geodetic_to_ecef(lon0, lat0, h0)
    dx, dy, dz = x - x0, y - y0, z - z0
    so, co, sa, ca = F.sin(F.radians(lon0)), F.cos(F.radians(lon0)), F.sin(F.radians(lat0)), F.cos(F.radians(lat0))
    return -so * dx + co * dy, -sa * co * dx - sa * so * dy + ca * dz, ca * co * dx + ca * so * dy + sa * dz


def enu_to_ecef(e: Column, n: Column, u: Column, lon0: Column, lat0: Column, h0: Column) -> tuple[Column, Column, Column]:
    x0, y0, z0 = geodetic_to_ecef(lon0, lat0, h0)
    so, co, sa, ca = F.sin(F.radians(lon0)), F.cos(F.radians(lon0)), F.sin(F.radians(lat0)), F.cos(F.radians(lat0))
    return x0 - so * e - sa * co * n + ca * co * u, y0 + co * e - sa * so * n + ca * so * u, z0 + ca * n + sa * u


def flat_enu(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    return (lon - lon0) * METRES_PER_DEGREE * F.cos(F.radians(lat0)), (lat - lat0) * METRES_PER_DEGREE


def flat_wgs84(e: Column, n: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    return lon0 + e / (METRES_PER_DEGREE * F.cos(F.radians(lat0))), lat0 + n / METRES_PER_DEGREE


def cov_weight(std_e: Column, std_n: Column) -> Column:
    """The weight of a fix: the inverse square of its larger horizontal deviation, 5 cm at least."""
    s = F.greatest(F.lit(0.05), std_e, std_n)
    return 1 / (s * s)


# Areas of interest ------------------------------------------------------------------------------------------------


def normalized(west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column, Column, Column]:
    return F.least(west, east), F.least(south, north), F.greatest(west, east), F.greatest(south, north)


def aoi_valid(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.coalesce((east - west > 1e-5) & (north - south > 1e-5), F.lit(False))


def aoi_reject_reason(west: Column, south: Column, east: Column, north: Column, span: float = 5.0) -> Column:
    """Null for an area that may be fetched; else why not."""
    return (
        F.when(west.isNull() | south.isNull() | east.isNull() | north.isNull(), "not finite")
        .when((east <= west) | (north <= south), "not positive")
        .when((west < -180) | (east > 180) | (south < -90) | (north > 90), "outside WGS84")
        .when((east - west > span) | (north - south > span), "too large")
    )


def grid_domain(west: Column, south: Column, east: Column, north: Column, low_power: bool = False) -> tuple[Column, Column, Column]:
    """dx, columns and rows of the grid over an area."""
    cells = 48 if low_power else 96
    width = F.abs(east - west) * METRES_PER_DEGREE * F.cos(F.radians((south + north) * 0.5))
    height = F.abs(north - south) * METRES_PER_DEGREE
    dx = F.greatest(F.lit(4.0), F.greatest(width, height, F.lit(50.0)) / cells)
    cols, rows = F.floor(width / dx + 0.5), F.floor(height / dx + 0.5)
    cols = F.when(cols == 0, cells).otherwise(cols)
    rows = F.when(rows == 0, round(cells * 0.75)).otherwise(rows)
    return dx, F.greatest(F.lit(24), F.least(F.lit(192), cols)).cast("int"), F.greatest(F.lit(16), F.least(F.lit(144), rows)).cast("int")


def dem_pixel_size(west: Column, south: Column, east: Column, north: Column, cell: float = 30.0, most: int = 2048) -> tuple[Column, Column, Column]:
    """Pixels east and north of an elevation request, and the cell that results."""
    lon_m = METRES_PER_DEGREE * F.greatest(F.abs(F.cos(F.radians((south + north) * 0.5))), F.lit(0.2))
    width, height = (east - west) * lon_m, (north - south) * METRES_PER_DEGREE
    w, h = F.greatest(F.ceil(width / max(cell, 1.0)), F.lit(1)), F.greatest(F.ceil(height / max(cell, 1.0)), F.lit(1))
    scale = F.lit(float(most)) / F.greatest(w, h)
    over = F.greatest(w, h) > most
    w = F.when(over, F.greatest(F.floor(w * scale), F.lit(1))).otherwise(w)
    h = F.when(over, F.greatest(F.floor(h * scale), F.lit(1))).otherwise(h)
    return w.cast("int"), h.cast("int"), (width / w + height / h) * 0.5


def lonlat_to_tile(lon: Column, lat: Column, z: Column | int) -> tuple[Column, Column]:
    n = F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(z))
    phi = F.radians(lat)
    y = (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2
    return F.floor((lon + 180) / 360 * n), F.floor(y * n)


def pick_zoom(west: Column, south: Column, east: Column, north: Column, most_tiles: int) -> Column:
    """The finest zoom from 16 to 4 whose tiles over the area are few enough; 4 if none."""

    def few(z: Column) -> Column:
        x0, y0 = lonlat_to_tile(west, north, z)
        x1, y1 = lonlat_to_tile(east, south, z)
        return (x1 - x0 + 1) * (y1 - y0 + 1) <= most_tiles

    zooms = F.filter(F.sequence(F.lit(16), F.lit(4), F.lit(-1)), few)
    return F.coalesce(F.get(zooms, F.lit(0)), F.lit(4))


def dem_tile_name(lon: Column, lat: Column) -> Column:
    """The name of the elevation tile whose south-west corner is at whole degrees."""
    return F.format_string(
        "Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM",
        F.when(lat >= 0, "N").otherwise("S"), F.abs(lat), F.when(lon >= 0, "E").otherwise("W"), F.abs(lon),
    )


def continent_code(lon: Column, lat: Column) -> Column:
    # Boxes in order, the first that holds the point counts.
    boxes = (
        ("na", -170, -50, 7, 84), ("sa", -92, -32, -56, 15), ("af", -25, 60, -35, 38),
        ("eu", -12, 70, 35, 82), ("as", 40, 180, -12, 60), ("au", 110, 180, -50, 0),
    )
    out = None
    for code, w, e, s, n in boxes:
        inside = (lon >= w) & (lon < e) & (lat >= s) & (lat < n)
        out = F.when(inside, code) if out is None else out.when(inside, code)
    return out.when(lon < -50, "na").otherwise("eu")


def in_us_envelope(west: Column, south: Column, east: Column, north: Column) -> Column:
    return (east > -180) & (west < -64) & (north > 17) & (south < 72)
