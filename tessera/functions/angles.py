"""Column expressions for polarisation, quaternions, pixel numbers, spectra, splines and small matrices.

All of them are built-in JVM expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def grid(x: Column, scale: float) -> Column:
    """x on a grid of 1 / scale, as both engines of a comparison can compute it; also turns -0.0 into 0.0."""
    return F.floor(x * F.lit(float(scale)) + 0.5) / F.lit(float(scale))


# --- Stokes parameters ---------------------------------------------------------------------------------------------

def rotate_qu(q: Column, u: Column, angle: Column, sign: int = 1) -> tuple[Column, Column]:
    c, s = F.cos(angle * 2), F.sin(angle * 2) * sign
    return q * c + u * s, u * c - q * s


def rotating_hwp(q: Column, u: Column, v: Column, angle: Column) -> tuple[Column, Column, Column]:
    """Half-wave plate diag(1, 1, -1, -1) between a rotation by the angle and its inverse."""
    c, s = F.cos(angle * 4), F.sin(angle * 4)
    return q * c + u * s, q * s - u * c, -v


def polarizer(i: Column, q: Column) -> Column:
    return (i + q) * 0.5


def modulation(i: Column, q: Column, u: Column, angle: Column) -> Column:
    return i + F.cos(angle * 4) * q + F.sin(angle * 4) * u


# --- quaternions (scalar first), as tuples of four columns ---------------------------------------------------------

def euler(axis: int, angle: Column) -> tuple[Column, ...]:
    parts = [F.cos(angle / 2), F.lit(0.0), F.lit(0.0), F.lit(0.0)]
    parts[axis] = F.sin(angle / 2)
    return tuple(parts)


def qmul(p, q) -> tuple[Column, ...]:
    a, b, c, d = p
    e, f, g, h = q
    return (a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e)


def qnorm(q) -> tuple[Column, ...]:
    n = F.sqrt(sum((x * x for x in q[1:]), q[0] * q[0]))
    return tuple(x / n for x in q)


def from_iso(theta: Column, phi: Column, psi: Column) -> tuple[Column, ...]:
    return qmul(qmul(euler(3, phi), euler(2, theta)), euler(3, psi))


def iso_angles(q) -> tuple[Column, Column, Column]:
    a, b, c, d = q
    return F.atan2(F.sqrt(b * b + c * c), F.sqrt(a * a + d * d)) * 2, F.atan2(c * d - a * b, a * c + b * d), F.atan2(c * d + a * b, a * c - b * d)


def z_axis(q) -> tuple[Column, Column, Column]:
    a, b, c, d = q
    return (b * d + a * c) * 2, (c * d - a * b) * 2, a * a - b * b - c * c + d * d


def x_axis(q) -> tuple[Column, Column, Column]:
    a, b, c, d = q
    return a * a + b * b - c * c - d * d, (b * c + a * d) * 2, (b * d - a * c) * 2


# --- pixels --------------------------------------------------------------------------------------------------------

def ring_pixel(nside: int, z: Column, phi: Column) -> Column:
    """HEALPix RING pixel of a direction (Gorski et al. 2005)."""
    n, za = nside, F.abs(z)
    tt = F.pmod(phi, F.lit(2 * PI)) / (PI / 2)
    t1, t2 = (tt + 0.5) * n, z * (0.75 * n)
    jp, jm = F.floor(t1 - t2), F.floor(t1 + t2)
    ir = jp - jm + (n + 1)
    ks = F.lit(1) - F.pmod(ir, F.lit(2))
    ip = F.pmod(F.floor((jp + jm - n + ks + 1) / 2), F.lit(4 * n))
    belt = (ir - 1) * (4 * n) + 2 * n * (n - 1) + ip
    tp = tt - F.floor(tt)
    w = F.sqrt((F.lit(1.0) - za) * 3) * n
    kp, km = F.floor(tp * w), F.floor((F.lit(1.0) - tp) * w)
    jr = kp + km + 1
    jq = F.pmod(F.floor(tt * jr), jr * 4)
    cap = F.when(z > 0, jr * (jr - 1) * 2 + jq).otherwise(F.lit(12 * n * n) - jr * (jr + 1) * 2 + jq)
    return F.when(za <= 2 / 3, belt).otherwise(cap).cast("long")


def car_pixel(lon: Column, lat: Column, lon0: float, step: float, nx: int, ny: int) -> Column:
    """Plate carree pixel (degrees), x fastest, half to even; -1 outside."""
    x = F.rint((F.pmod(lon - lon0 + 180.0, F.lit(360.0)) - 180.0) / -step + (nx - 1) / 2).cast("long")
    y = F.rint(lat / step + (ny - 1) / 2).cast("long")
    return F.when((x >= 0) & (x < nx) & (y >= 0) & (y < ny), y * nx + x).otherwise(F.lit(-1)).cast("long")


def horizon_pixel(az: Column, alt: Column, n_az: int, n_alt: int, low: float, high: float) -> Column:
    a = F.pmod(F.rint(F.pmod(az, F.lit(2 * PI)) / (2 * PI / n_az)), F.lit(float(n_az))).cast("long")
    h = F.rint((alt - low) / ((high - low) / n_alt) - 0.5).cast("long")
    return F.when((h >= 0) & (h < n_alt), h + a * n_alt).otherwise(F.lit(-1)).cast("long")


def tangential_pixel(theta: Column, phi: Column, height: float, step: float, nx: int, ny: int) -> Column:
    """Gnomonic projection at the zenith onto a screen at a height."""
    x, y = F.tan(theta) * F.cos(phi) * height, F.tan(theta) * F.sin(phi) * height
    i, j = F.rint(x / step + (nx - 1) / 2).cast("long"), F.rint(y / step + (ny - 1) / 2).cast("long")
    return F.when((i >= 0) & (i < nx) & (j >= 0) & (j < ny), j * nx + i).otherwise(F.lit(-1)).cast("long")


def bilinear(x: Column, y: Column, nx: int, ny: int) -> Column:
    """Array of (pix, w) of the four neighbours; those outside get pixel -1 and weight 0, the rest are renormalised."""
    x0, y0 = F.floor(x), F.floor(y)
    fx, fy = x - x0, y - y0
    out = []
    for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)):
        i, j = x0 + dx, y0 + dy
        w = (fx if dx else 1 - fx) * (fy if dy else 1 - fy)
        ok = (i >= 0) & (i < nx) & (j >= 0) & (j < ny)
        out.append((F.when(ok, j * nx + i).otherwise(F.lit(-1)).cast("long"), F.when(ok, w).otherwise(F.lit(0.0))))
    total = sum((w for _, w in out[1:]), out[0][1])
    return F.array(*[F.struct(p.alias("pix"), F.when(total > 0, w / total).otherwise(F.lit(0.0)).alias("w")) for p, w in out])


# --- spectra -------------------------------------------------------------------------------------------------------

#: H / k in K per GHz and the temperature of the microwave background.
H_OVER_K_GHZ, T_CMB = 6.62607015e-34 * 1e9 / 1.380649e-23, 2.7255


def rj_to_cmb(nu: Column) -> Column:
    x = nu * (H_OVER_K_GHZ / T_CMB)
    return F.pow(F.expm1(x), F.lit(2.0)) / (F.exp(x) * x * x)


def dust(nu: Column, nu0: float, temperature: float, beta: float) -> Column:
    x = H_OVER_K_GHZ / temperature
    return math.expm1(nu0 * x) / F.expm1(nu * x) * F.pow(nu / nu0, F.lit(1.0 + beta))


def synchrotron(nu: Column, nu0: float, beta: float) -> Column:
    return F.pow(nu / nu0, F.lit(float(beta)))


# --- bases ---------------------------------------------------------------------------------------------------------

def bspline(u: Column) -> Column:
    """Cubic B-spline with support [0, 4)."""
    a = F.pow(u, F.lit(3.0)) / 6
    b = (F.pow(u, F.lit(3.0)) * -3 + F.pow(u, F.lit(2.0)) * 12 - u * 12 + 4) / 6
    c = (F.pow(u, F.lit(3.0)) * 3 - F.pow(u, F.lit(2.0)) * 24 + u * 60 - 44) / 6
    d = F.pow(F.lit(4.0) - u, F.lit(3.0)) / 6
    return F.when((u < 0) | (u >= 4), 0.0).when(u < 1, a).when(u < 2, b).when(u < 3, c).otherwise(d)


def legendre(l: int, x: Column) -> Column:  # noqa: E741
    before, now = F.lit(1.0), x
    if l == 0:
        return before
    for k in range(2, l + 1):
        before, now = now, (x * now * (2 * k - 1) - before * (k - 1)) / k
    return now


# --- small symmetric matrices --------------------------------------------------------------------------------------

def solve3(m, r) -> tuple[Column, Column, Column, Column]:
    """Determinant and solution of a symmetric 3 x 3 system; m = (m00, m01, m02, m11, m12, m22); 0 where singular."""
    a, b, c, d, e, f = m
    c00, c01, c02 = d * f - e * e, c * e - b * f, b * e - c * d
    c11, c12, c22 = a * f - c * c, b * c - a * e, a * d - b * b
    det = a * c00 + b * c01 + c * c02
    rows = ((c00, c01, c02), (c01, c11, c12), (c02, c12, c22))
    out = [F.when(F.abs(det) > 1e-12, sum((k * x for k, x in zip(row[1:], r[1:], strict=True)), row[0] * r[0]) / det).otherwise(0.0) for row in rows]
    return det, *out


def eigen2(a: Column, b: Column, d: Column) -> tuple[Column, Column]:
    mid, gap = (a + d) / 2, F.sqrt(F.pow((a - d) / 2, F.lit(2.0)) + b * b)
    return mid - gap, mid + gap


def eigen3(a, b, c, d, e, f) -> tuple[Column, Column, Column]:
    """Ascending eigenvalues by the trigonometric formula."""
    q = (a + d + f) / 3
    p2 = F.pow(a - q, F.lit(2.0)) + F.pow(d - q, F.lit(2.0)) + F.pow(f - q, F.lit(2.0)) + (b * b + c * c + e * e) * 2
    p = F.sqrt(p2 / 6)
    safe = F.when(p > 0, p).otherwise(1.0)
    x, y, z, s, t, w = (a - q) / safe, b / safe, c / safe, (d - q) / safe, e / safe, (f - q) / safe
    r = (x * (s * w - t * t) - y * (y * w - t * z) + z * (y * t - s * z)) / 2
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3
    high, low = q + p * F.cos(phi) * 2, q + p * F.cos(phi + 2 * PI / 3) * 2
    return low, q * 3 - high - low, high
