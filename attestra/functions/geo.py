"""Map projection, lattice snapping and grid congruence as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from attestra import fixed_values as fixed


def utm54(longitude: Column, latitude: Column) -> Column:
    """Longitude/latitude to UTM zone 54 south, transverse Mercator series on WGS84."""
    e2 = fixed.WGS84_F * (2 - fixed.WGS84_F)
    ep2 = e2 / (1 - e2)
    phi = F.radians(latitude)
    offset = F.radians(longitude) - F.radians(F.lit(fixed.UTM54_CENTRAL_MERIDIAN))
    n = F.lit(fixed.WGS84_A) / F.sqrt(1 - F.lit(e2) * F.pow(F.sin(phi), 2))
    t = F.pow(F.tan(phi), 2)
    c = F.lit(ep2) * F.pow(F.cos(phi), 2)
    a = F.cos(phi) * offset
    m = F.lit(fixed.WGS84_A) * (
        F.lit(1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - F.lit(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + F.lit(15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - F.lit(35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    easting = fixed.UTM_FALSE_EASTING + fixed.UTM_SCALE * n * (
        a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120
    )
    northing = fixed.UTM_SCALE * (
        m + n * F.tan(phi) * (
            F.pow(a, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24
            + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720
        )
    ) + fixed.UTM_FALSE_NORTHING
    return F.struct(easting.alias("x"), northing.alias("y"))


def snapped_grid(
    min_x: Column, min_y: Column, max_x: Column, max_y: Column,
    resolution: float = fixed.GRID_RESOLUTION,
    origin_x: float = fixed.GRID_ORIGIN_X,
    origin_y: float = fixed.GRID_ORIGIN_Y,
) -> Column:
    """Bounds widened to the lattice, with width, height and transform; NULL if degenerate."""
    snap = lambda value, origin, way: F.lit(origin) + way((value - origin) / resolution) * F.lit(resolution)
    left, right = snap(min_x, origin_x, F.floor), snap(max_x, origin_x, F.ceil)
    bottom, top = snap(min_y, origin_y, F.floor), snap(max_y, origin_y, F.ceil)
    width = F.round((right - left) / resolution).cast("long")
    height = F.round((top - bottom) / resolution).cast("long")
    grid = F.struct(
        left.alias("left"), bottom.alias("bottom"), right.alias("right"), top.alias("top"),
        width.alias("width"), height.alias("height"), (width * height).alias("pixel_count"),
        F.array(F.lit(resolution), F.lit(0.0), left, F.lit(0.0), F.lit(-resolution), top).alias("transform"),
    )
    return F.when((min_x < max_x) & (min_y < max_y), grid)


def congruent(
    x_resolution: Column, y_resolution: Column, x_origin: Column, y_origin: Column,
    resolution: float = fixed.GRID_RESOLUTION,
) -> Column:
    """Lattice resolution and an origin on the lattice (remainder close to zero, from above)."""
    size = lambda r: F.abs(F.abs(r) - resolution) <= 1e-9 * resolution
    on_lattice = lambda o: F.abs(F.pmod(o, F.lit(resolution))) <= 1e-9
    return F.coalesce(
        size(x_resolution) & size(y_resolution) & on_lattice(x_origin) & on_lattice(y_origin), F.lit(False)
    )


def north_up_congruent(transform: Column, resolution: float = fixed.GRID_RESOLUTION) -> Column:
    """Six-number transform: native resolution, north up, origin on the lattice."""
    near = lambda i, expected: F.abs(transform[i] - expected) <= 1e-9
    on_lattice = lambda i: F.abs(F.pmod(transform[i], F.lit(resolution))) <= 1e-9
    return F.coalesce(
        (F.size(transform) == 6) & near(0, resolution) & near(1, 0.0) & near(3, 0.0) & near(4, -resolution)
        & on_lattice(2) & on_lattice(5),
        F.lit(False),
    )
