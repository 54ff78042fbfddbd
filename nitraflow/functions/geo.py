"""Coordinates as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Albers:
    """Ellipsoidal Albers equal-area conic; the defaults are CONUS Albers on GRS80 (EPSG:5070)."""

    a: float = 6378137.0
    e2: float = 0.006694380022900787
    parallel1: float = 29.5
    parallel2: float = 45.5
    lat0: float = 23.0
    lon0: float = -96.0

    def _q(self, s: float) -> float:
        e = math.sqrt(self.e2)
        return (1 - self.e2) * (s / (1 - self.e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def constants(self) -> tuple[float, float, float]:
        """(n, C, rho0)"""
        m, q = [], []
        for d in (self.parallel1, self.parallel2):
            s = math.sin(math.radians(d))
            m.append(math.cos(math.radians(d)) / math.sqrt(1 - self.e2 * s * s))
            q.append(self._q(s))
        n = (m[0] ** 2 - m[1] ** 2) / (q[1] - q[0])
        c = m[0] ** 2 + n * q[0]
        return n, c, self.a * math.sqrt(c - n * self._q(math.sin(math.radians(self.lat0)))) / n

    def project(self, lon: float, lat: float) -> tuple[float, float]:
        """One point, on the driver."""
        n, c, rho0 = self.constants()
        rho = self.a * math.sqrt(c - n * self._q(math.sin(math.radians(lat)))) / n
        theta = n * math.radians(lon - self.lon0)
        return rho * math.sin(theta), rho0 - rho * math.cos(theta)


def albers(lon: Column, lat: Column, grid: Albers = Albers()) -> tuple[Column, Column]:  # noqa: B008
    """(x, y) in metres."""
    n, c, rho0 = grid.constants()
    e, s = math.sqrt(grid.e2), F.sin(F.radians(lat))
    q = (1 - grid.e2) * (s / (1 - grid.e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = grid.a * F.sqrt(c - n * q) / n, n * F.radians(lon - grid.lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def bbox_filter(df: DataFrame, x: str, y: str, bbox_wgs84: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose projected x, y lie in the box of the two projected corners (west, south, east, north)."""
    west, south, east, north = bbox_wgs84
    (x1, y1), (x2, y2) = Albers().project(west, south), Albers().project(east, north)
    return df.where(F.col(x).between(min(x1, x2), max(x1, x2)) & F.col(y).between(min(y1, y2), max(y1, y2)))


def point_xy(wkt: Column) -> tuple[Column, Column]:
    """(longitude, latitude) of POINT text; null for anything else."""
    number = r"([-+0-9.eE]+)"
    pattern = rf"^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"
    return tuple(F.regexp_extract(wkt, pattern, i).try_cast("double") for i in (1, 2))
