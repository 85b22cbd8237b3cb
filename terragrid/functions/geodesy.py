"""WGS84: geodetic, earth-centred, local east-north-up, and UTM coordinates as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
B = A * (1 - FLAT)
UTM_SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0


def to_ecef(lat: Column, lon: Column, alt: Column) -> list[Column]:
    p, m = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return [(n + alt) * F.cos(p) * F.cos(m), (n + alt) * F.cos(p) * F.sin(m), (n * (1 - E2) + alt) * F.sin(p)]


def _origin(lat0: float, lon0: float, alt0: float):
    p, m = math.radians(lat0), math.radians(lon0)
    n = A / math.sqrt(1 - E2 * math.sin(p) ** 2)
    centre = [(n + alt0) * math.cos(p) * math.cos(m), (n + alt0) * math.cos(p) * math.sin(m), (n * (1 - E2) + alt0) * math.sin(p)]
    axes = [[-math.sin(m), math.cos(m), 0.0], [-math.sin(p) * math.cos(m), -math.sin(p) * math.sin(m), math.cos(p)], [math.cos(p) * math.cos(m), math.cos(p) * math.sin(m), math.sin(p)]]
    return centre, axes


def geodetic_to_enu(lat: Column, lon: Column, alt: Column, lat0: float, lon0: float, alt0: float) -> list[Column]:
    """East, north, up about an origin."""
    centre, axes = _origin(lat0, lon0, alt0)
    d = [x - c for x, c in zip(to_ecef(lat, lon, alt), centre)]
    return [sum((a * x for a, x in zip(row[1:], d[1:])), row[0] * d[0]) for row in axes]


def let(values: list[Column], body) -> Column:
    """``body`` of values that are computed once, bound as the variables of a lambda.

    Long recurrences written out, or as columns of their own, grow exponentially when a filter on
    their result is pushed down through them; bound this way the expression stays as long as its text."""
    names = [f"v{i}" for i in range(len(values))]
    packed = F.array(F.struct(*[v.alias(n) for n, v in zip(names, values)]))
    return F.transform(packed, lambda s: body(*[s[n] for n in names]))[0]


def ecef_to_geodetic(x: Column, y: Column, z: Column, rounds: int = 3) -> Column:
    """struct(lat, lon, alt) by Bowring's iteration on the reduced latitude, a fixed number of times."""
    ep2 = E2 / (1 - E2)

    def last(x, y, z, r, p):
        alt = r * F.cos(p) + z * F.sin(p) - A * F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
        return F.struct(F.degrees(p).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"), alt.alias("alt"))

    def step(left):
        def body(x, y, z, r, b):
            p = F.atan2(z + ep2 * B * F.pow(F.sin(b), F.lit(3)), r - E2 * A * F.pow(F.cos(b), F.lit(3)))
            if not left:
                return let([x, y, z, r, p], last)
            return let([x, y, z, r, p], lambda x, y, z, r, p: let([x, y, z, r, F.atan2((1 - FLAT) * F.sin(p), F.cos(p))], step(left - 1)))

        return body

    start = lambda x, y, z: let([x, y, z, F.sqrt(x * x + y * y)], lambda x, y, z, r: let([x, y, z, r, F.atan2(z, (1 - FLAT) * r)], step(rounds - 1)))
    return let([x, y, z], start)


def enu_to_geodetic(e: Column, n: Column, u: Column, lat0: float, lon0: float, alt0: float) -> Column:
    """struct(lat, lon, alt) of east, north, up about an origin."""
    centre, axes = _origin(lat0, lon0, alt0)
    xyz = [centre[i] + axes[0][i] * e + axes[1][i] * n + axes[2][i] * u for i in range(3)]
    return ecef_to_geodetic(*xyz)


def _series() -> tuple[float, list[float], list[float]]:
    """Radius and coefficients of Krueger's series to the sixth order in the third flattening."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    # fixed values: the published series (forward alpha, inverse beta)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    ]
    return radius, alpha, beta


def central_meridian(zone: int) -> float:
    return zone * 6 - 183.0


def to_utm(lat: Column, lon: Column, zone: int, south: bool) -> Column:
    """struct(east, north) in an explicit zone."""
    radius, alpha, _ = _series()
    e = math.sqrt(E2)

    def place(xi, eta):
        x, y = eta, xi
        for j, a in enumerate(alpha, 1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return F.struct((FALSE_EAST + UTM_SCALE * radius * x).alias("east"), (UTM_SCALE * radius * y + (FALSE_NORTH if south else 0.0)).alias("north"))

    sphere = lambda t, m: let([F.atan2(t, F.cos(m)), F.asinh(F.sin(m) / F.sqrt(t * t + F.cos(m) * F.cos(m)))], place)
    conformal = lambda s, m: let([F.sinh(F.atanh(s) - e * F.atanh(e * s)), m], sphere)
    return let([F.sin(F.radians(lat)), F.radians(lon - central_meridian(zone))], conformal)


def from_utm(east: Column, north: Column, zone: int, south: bool) -> Column:
    """struct(lat, lon): the inverse series, then Newton steps from the conformal latitude."""
    radius, _, beta = _series()
    e = math.sqrt(E2)

    def last(tau, tau1, lon):
        return F.struct(F.degrees(F.atan(tau)).alias("lat"), lon.alias("lon"))

    def newton(left):
        def sigma(tau, tau1, lon):
            root = F.sqrt(1 + tau * tau)
            return let([tau, tau1, lon, root, F.sinh(e * F.atanh(e * tau / root))], have)

        def have(tau, tau1, lon, root, sg):
            return let([tau, tau1, lon, root, tau * F.sqrt(1 + sg * sg) - sg * root], step)

        def step(tau, tau1, lon, root, h):
            new = tau + (tau1 - h) / F.sqrt(1 + h * h) * (1 + (1 - E2) * tau * tau) / ((1 - E2) * root)
            return let([new, tau1, lon], newton(left - 1) if left > 1 else last)

        return sigma

    def sphere(xi0, eta0):
        xi, eta = xi0, eta0
        for j, b in enumerate(beta, 1):
            xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
            eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
        return let([xi, eta], ellipsoid)

    def ellipsoid(xi, eta):
        tau1 = F.sin(xi) / F.sqrt(F.sinh(eta) * F.sinh(eta) + F.cos(xi) * F.cos(xi))
        lon = F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + central_meridian(zone)
        return let([tau1, lon], lambda t, m: let([t, t, m], newton(3)))

    return let([(north - (FALSE_NORTH if south else 0.0)) / (UTM_SCALE * radius), (east - FALSE_EAST) / (UTM_SCALE * radius)], sphere)
