"""Spherical harmonics of HEALPix maps, beams, windows and eigenvalues: numpy on one map, matrix or batch at a time.

A map of one component is bounded by its pixels and handled by one task; batches of maps or matrices go through mapInArrow.
"""

from __future__ import annotations

import numpy as np


def ring_angles(nside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cos(theta), first phi and number of pixels of the 4 nside - 1 rings."""
    i = np.arange(1, 4 * nside)
    z = np.where(i < nside, 1 - i**2 / (3 * nside**2), 4 / 3 - 2 * i / (3 * nside))
    south = i > 3 * nside
    z[south] = -(1 - (4 * nside - i[south]) ** 2 / (3 * nside**2))
    n = 4 * np.minimum(nside, np.minimum(i, 4 * nside - i))
    shift = np.where((i < nside) | south, 1.0, ((i - nside + 1) % 2).astype(float))
    return z, np.pi / n * shift, n


def legendre_table(lmax: int, m: int, z: np.ndarray) -> np.ndarray:
    """Normalised associated Legendre functions of order m for l = m..lmax, by the recurrence upward in l."""
    s = np.sqrt(1 - z * z)
    start = np.full_like(z, np.sqrt(1 / (4 * np.pi)))
    for k in range(1, m + 1):
        start = -start * s * np.sqrt((2 * k + 1) / (2 * k))
    out = [start]
    if lmax > m:
        out.append(z * np.sqrt(2 * m + 3) * start)
    for l in range(m + 2, lmax + 1):  # noqa: E741
        a = np.sqrt((4 * l * l - 1) / (l * l - m * m))
        b = np.sqrt(((l - 1) ** 2 - m * m) / (4 * (l - 1) ** 2 - 1))
        out.append(a * (z * out[-1] - b * out[-2]))
    return np.array(out)


def map2alm(x: np.ndarray, lmax: int, rounds: int = 3) -> np.ndarray:
    """alm[l, m] (m from 0) of a RING map, refined by analysing what the synthesis lacks."""
    nside = int(round((len(x) / 12) ** 0.5))
    if 12 * nside**2 != len(x):
        raise ValueError("not the length of a HEALPix map")
    alm = _analyse(x, nside, lmax)
    for _ in range(rounds):
        alm += _analyse(x - alm2map(alm, nside), nside, lmax)
    return alm


def _analyse(x: np.ndarray, nside: int, lmax: int) -> np.ndarray:
    z, phi0, n = ring_angles(nside)
    at = np.concatenate([[0], np.cumsum(n)])
    waves = np.zeros((len(z), lmax + 1), complex)
    m = np.arange(lmax + 1)
    for r in range(len(z)):
        f = np.fft.fft(x[at[r] : at[r + 1]])
        waves[r] = f[m % n[r]] * np.exp(-1j * m * phi0[r])
    out = np.zeros((lmax + 1, lmax + 1), complex)
    for k in range(lmax + 1):
        out[k:, k] = legendre_table(lmax, k, z) @ waves[:, k]
    return out * (4 * np.pi / len(x))


def alm2map(alm: np.ndarray, nside: int) -> np.ndarray:
    lmax = len(alm) - 1
    z, phi0, n = ring_angles(nside)
    waves = np.array([legendre_table(lmax, k, z).T @ alm[k:, k] for k in range(lmax + 1)]).T
    out = []
    m = np.arange(lmax + 1)
    for r in range(len(z)):
        phi = phi0[r] + 2 * np.pi * np.arange(n[r]) / n[r]
        twice = np.where(m == 0, 1.0, 2.0)
        out.append((np.exp(1j * np.outer(phi, m)) @ (waves[r] * twice)).real)
    return np.concatenate(out)


def beam(x: np.ndarray, window: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A map smoothed by a beam given for each l; the inverse divides, and drops l where the window is zero."""
    nside = int(round((len(x) / 12) ** 0.5))
    w = np.divide(1.0, window, out=np.zeros(len(window)), where=np.asarray(window) != 0) if inverse else np.asarray(window, float)
    return alm2map(map2alm(x, len(window) - 1) * w[:, None], nside)


def eigvalsh(stack: np.ndarray, batch: int = 10_000) -> np.ndarray:
    """Ascending eigenvalues of symmetric matrices, in batches."""
    return np.concatenate([np.linalg.eigvalsh(stack[k : k + batch]) for k in range(0, len(stack), batch)]) if len(stack) else np.zeros(stack.shape[:2])


def chebyshev_half(size: int, decibels: float = 150.0) -> np.ndarray:
    """The later half of a Chebyshev window of length 2 * size, from its peak on: what bands of a noise covariance are tapered by."""
    m = 2 * size + 1
    order = m - 1
    beta = np.cosh(np.arccosh(10 ** (decibels / 20)) / order)
    x = beta * np.cos(np.pi * np.arange(m) / m)
    inside = np.abs(x) <= 1
    p = np.empty(m)
    p[inside] = np.cos(order * np.arccos(x[inside]))
    p[~inside] = np.sign(x[~inside]) ** order * np.cosh(order * np.arccosh(np.abs(x[~inside])))
    w = np.fft.fft(p).real
    w = w[: size + 1]
    return (w / w[0])[:size]


def gaussian_half(size: int, width: float = 0.3, power: float = 1.5) -> np.ndarray:
    """The same of a generalised Gaussian."""
    x = np.arange(size) / size
    return np.exp(-0.5 * (x / width) ** (2 * power))


def noise_psd(f: np.ndarray, sigma: float, alpha: float, fk: float, f0: float) -> np.ndarray:
    """sigma^2 (1 + ((f + f0) / fk)^alpha), alpha below zero; 0 for a dead detector."""
    return np.zeros_like(f) if sigma <= 0 else sigma**2 * (1 + ((f + f0) / fk) ** alpha)


def inverse_bands(psd_of, rate: float, length: int, taper: np.ndarray | None = None) -> np.ndarray:
    """Bands of the inverse noise covariance: the transform of 1 / PSD, cut to `length` and tapered."""
    n = 1 << int(np.ceil(np.log2(max(2, 2 * length - 1))))
    f = np.fft.rfftfreq(n, 1 / rate)
    psd = psd_of(f)
    if not np.any(psd > 0):
        return np.zeros(length)
    bands = np.fft.irfft(1 / psd, n)[:length]
    return bands if taper is None else bands * taper
