"""Grids and coordinates: affine transforms, cells, levels, UTM, Web Mercator, footprints.

A transform is (a, b, c, d, e, f): x = a col + b row + c, y = d col + e row + f, at pixel corners.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Transform = tuple[float, float, float, float, float, float]

WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
#: UTM: scale at the central meridian, false easting, false northing of the south.
UTM_K0, UTM_EAST, UTM_NORTH_SOUTH = 0.9996, 500_000.0, 10_000_000.0

# Krueger's series in the third flattening n to order 6 (Karney 2011, eqs. 35 and 36). Row j has the
# coefficients of n^j, n^(j+1), ..., n^6.
ALPHA = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
BETA = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)

_N = WGS84_F / (2 - WGS84_F)
_E = math.sqrt(WGS84_F * (2 - WGS84_F))
_RADIUS = UTM_K0 * WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def _series(table: Sequence[Sequence[float]]) -> list[float]:
    return [sum(c * _N ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(table, 1)]


_ALPHA, _BETA = _series(ALPHA), _series(BETA)


def _conformal(tau: np.ndarray) -> np.ndarray:
    """Tangent of the conformal latitude from that of the geodetic one."""
    root = np.hypot(1, tau)
    s = np.sinh(_E * np.arctanh(_E * tau / root))
    return tau * np.hypot(1, s) - s * root


def _wave(xi: np.ndarray, eta: np.ndarray, coefficients: Sequence[float], sign: int) -> tuple[np.ndarray, np.ndarray]:
    """zeta + sign * sum of c_j sin(2 j zeta) over the complex coordinate zeta = xi + i eta."""
    zeta = np.asarray(xi) + 1j * np.asarray(eta)
    out = zeta + sign * sum(c * np.sin(2 * j * zeta) for j, c in enumerate(coefficients, 1))
    return out.real, out.imag


def utm_zone(crs: str) -> tuple[int, bool]:
    """Zone and whether it is southern, of EPSG:326zz or EPSG:327zz."""
    m = re.fullmatch(r"EPSG:32([67])(\d\d)", crs)
    if not m or not 1 <= int(m[2]) <= 60:
        raise ValueError(f"{crs!r} is no UTM zone")
    return int(m[2]), m[1] == "7"


def utm_forward(lon, lat, zone: int, south: bool) -> tuple[np.ndarray, np.ndarray]:
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    away = lon - (6 * zone - 183)
    lam = np.radians(away - 360 * np.round(away / 360))
    tau = _conformal(np.tan(np.radians(lat)))
    xi, eta = _wave(np.arctan2(tau, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(tau, np.cos(lam))), _ALPHA, 1)
    return UTM_EAST + _RADIUS * eta, (UTM_NORTH_SOUTH if south else 0.0) + _RADIUS * xi


def utm_inverse(x, y, zone: int, south: bool) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.asarray(x, float), np.asarray(y, float)
    xi, eta = _wave((y - (UTM_NORTH_SOUTH if south else 0.0)) / _RADIUS, (x - UTM_EAST) / _RADIUS, _BETA, -1)
    goal = np.sin(xi) / np.hypot(np.sinh(eta), np.cos(xi))
    tau, rest, off = goal, 1 - _E**2, np.inf
    while True:  # Newton's steps, as long as they bring the farthest point nearer
        now = _conformal(tau)
        step = (goal - now) / np.hypot(1, now) * (1 + rest * tau**2) / (rest * np.hypot(1, tau))
        size = float(np.max(np.abs(step / np.hypot(1, tau)), initial=0.0, where=np.isfinite(step)))
        if size >= off or size == 0.0:
            break
        tau, off = tau + step, size
    return 6 * zone - 183 + np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))), np.degrees(np.arctan(tau))


def web_forward(lon, lat) -> tuple[np.ndarray, np.ndarray]:
    return np.radians(lon) * WGS84_A, WGS84_A * np.log(np.tan(np.pi / 4 + np.radians(lat) / 2))


def web_inverse(x, y) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(x, float) / (np.pi * WGS84_A) * 180, np.degrees(2 * np.arctan(np.exp(np.asarray(y, float) / WGS84_A)) - np.pi / 2)


Pair = Callable[..., tuple[np.ndarray, np.ndarray]]

SUPPORTED = "degrees (EPSG:4326), Web Mercator (EPSG:3857) and the northern and southern UTM zones (EPSG:32601 to 32660, 32701 to 32760)"


def projection(crs: str) -> tuple[Pair, Pair]:
    """(to lon/lat, from lon/lat) of a reference system; raises for others, naming those that there are."""
    if crs == "EPSG:3857":
        return web_inverse, web_forward
    if crs == "EPSG:4326":
        return (lambda x, y: (np.asarray(x, float), np.asarray(y, float)),) * 2
    try:
        zone, south = utm_zone(crs)
    except ValueError:
        raise ValueError(f"{crs!r} is unsupported: coordinates can be turned between {SUPPORTED}") from None
    return (lambda x, y: utm_inverse(x, y, zone, south)), (lambda lon, lat: utm_forward(lon, lat, zone, south))


def lonlat(crs: str, x: Column, y: Column) -> Column:
    """struct(lon, lat) of coordinates, by an Arrow function over whole batches."""
    to, _ = projection(crs)

    @F.pandas_udf("lon double, lat double")
    def f(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        lon, lat = to(x.to_numpy(float), y.to_numpy(float))
        return pd.DataFrame({"lon": lon, "lat": lat})

    return f(x, y)


def projected(crs: str, lon: Column, lat: Column) -> Column:
    """struct(x, y) of longitudes and latitudes."""
    _, back = projection(crs)

    @F.pandas_udf("x double, y double")
    def f(lon: pd.Series, lat: pd.Series) -> pd.DataFrame:
        x, y = back(lon.to_numpy(float), lat.to_numpy(float))
        return pd.DataFrame({"x": x, "y": y})

    return f(lon, lat)


# --- column expressions ---------------------------------------------------------------------------------------------


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """World coordinates from 0 to 1, x to the east and y to the south."""
    return (lon + 180) / 360, F.lit(0.5) - F.asinh(F.tan(F.radians(lat))) / (2 * math.pi)


def from_mercator(mx: Column, my: Column) -> tuple[Column, Column]:
    return mx * 360 - 180, F.degrees(F.atan(F.sinh((F.lit(1.0) - my * 2) * math.pi)))


def corner(t: Transform, col: Column, row: Column) -> tuple[Column, Column]:
    return col * t[0] + row * t[1] + t[2], col * t[3] + row * t[4] + t[5]


def pixel(t: Transform, x: Column, y: Column) -> tuple[Column, Column]:
    """(col, row), with fractions, of coordinates."""
    det = t[0] * t[4] - t[1] * t[3]
    if not math.isfinite(det) or det == 0:
        raise ValueError(f"the transform {t} is singular")
    dx, dy = x - t[2], y - t[5]
    return (dx * t[4] - dy * t[1]) / det, (dy * t[0] - dx * t[3]) / det


def centre(t: Transform, col: Column, row: Column) -> tuple[Column, Column]:
    """x and y of pixel centres of a north-up grid."""
    return (col + 0.5) * t[0] + t[2], (row + 0.5) * t[4] + t[5]


# --- plain functions ------------------------------------------------------------------------------------------------


def level_transform(t: Transform, level: int) -> Transform:
    s = 2**level
    return (t[0] * s, t[1] * s, t[2], t[3] * s, t[4] * s, t[5])


def cells(height: int, width: int, cell: int) -> tuple[int, int]:
    return -(-height // cell), -(-width // cell)


def cell_extent(height: int, width: int, cell: int, row: int, col: int) -> tuple[int, int]:
    """Height and width of a cell without its padding."""
    rows, cols = cells(height, width, cell)
    if not (0 <= row < rows and 0 <= col < cols):
        raise IndexError(f"cell ({row}, {col}) is not in the grid of {rows} x {cols}")
    return min(cell, height - row * cell), min(cell, width - col * cell)


def bounds(t: Transform, height: int, width: int) -> tuple[float, float, float, float]:
    return t[2], t[5] + t[4] * height, t[2] + t[0] * width, t[5]


def checked_bounds(values) -> tuple[float, float, float, float]:
    out = tuple(float(v) for v in values)
    if len(out) != 4 or not all(map(math.isfinite, out)) or not (out[0] < out[2] and out[1] < out[3]):
        raise ValueError(f"bounds must be four finite numbers west < east and south < north, not {values}")
    return out


def bounds_transform(box: Sequence[float], height: int, width: int) -> Transform:
    west, south, east, north = checked_bounds(box)
    return ((east - west) / width, 0.0, west, 0.0, -(north - south) / height, north)


def snapped_grid(box: Sequence[float], resolution: float) -> tuple[Transform, int, int]:
    """transform, height, width of the grid on whole multiples of the resolution that covers a box."""
    west, south, east, north = box
    left, bottom = math.floor(west / resolution) * resolution, math.floor(south / resolution) * resolution
    right, top = math.ceil(east / resolution) * resolution, math.ceil(north / resolution) * resolution
    return (resolution, 0.0, left, 0.0, -resolution, top), round((top - bottom) / resolution), round((right - left) / resolution)


def transform_of(x: Sequence[float], y: Sequence[float]) -> Transform:
    """The transform of a north-up grid from its pixel centres."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) < 2 or len(y) < 2:
        raise ValueError("a transform needs two pixels at least along both axes")
    dx, dy = x[1] - x[0], y[1] - y[0]
    if dx <= 0 or dy >= 0:
        raise ValueError("x must increase and y decrease (north up)")
    if not (np.allclose(np.diff(x), dx) and np.allclose(np.diff(y), dy)):
        raise ValueError("the coordinates aren't evenly spaced")
    return (float(dx), 0.0, float(x[0] - dx / 2), 0.0, float(dy), float(y[0] - dy / 2))


def north_up(t: Sequence[float]) -> Transform:
    a, b, c, d, e, f = (float(v) for v in t)
    if b or d or a <= 0 or e >= 0:
        raise ValueError(f"the grid is rotated or not north up: {tuple(t)}")
    return (a, b, c, d, e, f)


def same_grid(a: tuple[str, Transform, int, int], b: tuple[str, Transform, int, int]) -> bool:
    """crs, transform, height and width agree, coefficients to a millionth of a pixel."""
    return a[0] == b[0] and a[2:] == b[2:] and all(abs(p - q) <= 1e-6 * abs(a[1][0]) for p, q in zip(a[1], b[1], strict=True))


def _edge(t: Transform, height: int, width: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """x and y around the outline of a grid, ``points`` per side, clockwise from the upper left."""
    west, south, east, north = bounds(t, height, width)
    s = np.linspace(0, 1, points)
    one = np.ones(points)
    x = np.concatenate([west + s * (east - west), east * one, east + s * (west - east), west * one])
    y = np.concatenate([north * one, north + s * (south - north), south * one, south + s * (north - south)])
    return x, y


def footprint(crs: str, t: Transform, height: int, width: int, points: int = 21) -> tuple[list[list[float]], list[float]]:
    """A closed ring in longitude and latitude with ``points`` per side, and its bounding box; six digits."""
    lon, lat = projection(crs)[0](*_edge(t, height, width, points))
    ring = [[round(float(a), 6), round(float(b), 6)] for a, b in zip(lon, lat, strict=True)]
    return [*ring, ring[0]], [round(float(v), 6) for v in (lon.min(), lat.min(), lon.max(), lat.max())]


def footprint_bounds(crs: str, t: Transform, height: int, width: int) -> list[list[float]]:
    lon, lat = projection(crs)[0](*_edge(t, height, width, 33))
    return [[float(lon.min()), float(lat.min())], [float(lon.max()), float(lat.max())]]


def world(lon, lat) -> tuple[np.ndarray, np.ndarray]:
    """mercator() over arrays."""
    return (np.asarray(lon, float) + 180) / 360, 0.5 - np.arcsinh(np.tan(np.radians(lat))) / (2 * np.pi)


def mercator_per_texel(crs: str, t: Transform, height: int, width: int) -> float:
    """The size of a pixel at the grid's centre in world coordinates: the mean of a step east and one south."""
    col, row = np.array([0, 1, 0]) + width / 2, np.array([0, 0, 1]) + height / 2
    mx, my = world(*projection(crs)[0](t[0] * col + t[1] * row + t[2], t[3] * col + t[4] * row + t[5]))
    return float((np.hypot(mx[1] - mx[0], my[1] - my[0]) + np.hypot(mx[2] - mx[0], my[2] - my[0])) / 2)


def mesh(crs: str, t: Transform, cell: int, row: int, col: int, height: int, width: int, n: int) -> np.ndarray:
    """[(n + 1)^2, 2] world coordinates of an even mesh over one cell, row by row."""
    h, w = cell_extent(height, width, cell, row, col)
    r, c = np.meshgrid(np.linspace(0, h, n + 1) + row * cell, np.linspace(0, w, n + 1) + col * cell, indexing="ij")
    x, y = t[0] * c + t[1] * r + t[2], t[3] * c + t[4] * r + t[5]
    return np.stack([a.ravel() for a in world(*projection(crs)[0](x, y))], 1)


def convex_meets_box(polygon: Sequence[tuple[float, float]], box: Sequence[float]) -> bool:
    """Whether a convex polygon meets a rectangle (x0, y0, x1, y1): no edge of either separates them."""
    p = np.asarray(polygon, float)
    q = np.array([[box[0], box[1]], [box[2], box[1]], [box[2], box[3]], [box[0], box[3]]], float)
    edges = np.concatenate([np.roll(p, -1, 0) - p, [[1, 0], [0, 1]]])
    normals = np.stack([-edges[:, 1], edges[:, 0]], 1)
    a, b = p @ normals.T, q @ normals.T
    return bool(np.all((a.max(0) >= b.min(0)) & (b.max(0) >= a.min(0))))


def level_for_resolution(levels: Sequence[tuple[int, float]], wanted: float) -> int:
    """The coarsest of (level, resolution) that is no coarser than wanted, else 0."""
    return max((k for k, r in levels if r <= wanted), default=0)


def level_for_zoom(texel_pixels: float, coarsest: int, bias: float = 0.0) -> int:
    """The level whose pixels are about one screen pixel, if one of level 0 is texel_pixels wide."""
    return max(0, min(coarsest, math.floor(math.log2(1 / texel_pixels) + bias + 1e-9)))
