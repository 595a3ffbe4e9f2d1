"""Settings of map making as nested dataclasses, with loading from and dumping to YAML (where installed) or JSON."""

from __future__ import annotations

import dataclasses
import enum
import json
import types
import typing
from dataclasses import dataclass, field


class Method(enum.Enum):
    BINNED = "Binned"
    MAXL = "ML"
    TWOSTEP = "TwoStep"
    ATOP = "ATOP"


class WeightingMode(enum.Enum):
    IDENTITY = "identity"
    DIAGONAL = "diagonal"
    TOEPLITZ = "toeplitz"


class NoiseSource(enum.Enum):
    FIT = "fit"
    PRECOMPUTED = "precomputed"


class GapTreatment(enum.Enum):
    INNER_MASK = "inner_mask"
    FILL = "fill"
    NESTED = "nested"


@dataclass(frozen=True)
class Solver:
    rtol: float = 1e-6
    atol: float = 0.0
    max_steps: int = 1000
    verbose: bool = False


@dataclass(frozen=True)
class NoiseFit:
    nperseg: int = 2048
    max_iter: int = 100
    tol: float = 1e-10
    min_freq_nyquist: float = 1e-8
    max_freq_nyquist: float = 1.0
    low_freq_nyquist: float = 0.02
    high_freq_nyquist: float = 0.02
    mask_hwp_harmonics: bool = True
    mask_ptc_harmonics: bool = False
    freq_mask_width: float = 0.5
    ptc_freq: float = 1.4


@dataclass(frozen=True)
class Weighting:
    mode: WeightingMode = WeightingMode.DIAGONAL
    source: NoiseSource = NoiseSource.FIT
    correlation_length: int = 1000
    fitting: NoiseFit = field(default_factory=NoiseFit)


@dataclass(frozen=True)
class GapFilling:
    seed: int = 286502183
    max_steps: int = 50
    rtol: float = 1e-4
    precondition: bool = False


@dataclass(frozen=True)
class Nested:
    max_flag_fraction: float = 0.3
    inner_steps: int = 20
    rtol: float = 0.0
    atol: float = 0.0
    precondition: bool = False


@dataclass(frozen=True)
class Gaps:
    treatment: GapTreatment = GapTreatment.FILL
    fill: GapFilling = field(default_factory=GapFilling)
    nested: Nested = field(default_factory=Nested)


@dataclass(frozen=True)
class HealpixSettings:
    nside: int = 512


@dataclass(frozen=True)
class WcsSettings:
    resolution: float = 4.0
    geometry_file: str | None = None
    patch: tuple[float, float, float, float] | None = None

    def __post_init__(self):
        if self.geometry_file is not None and self.patch is not None:
            raise ValueError("a geometry file or a patch, not both")


@dataclass(frozen=True)
class LandscapeSettings:
    stokes: str = "IQU"
    healpix: HealpixSettings | None = None
    wcs: WcsSettings | None = None

    def __post_init__(self):
        if (self.healpix is None) == (self.wcs is None):
            raise ValueError("exactly one of healpix and wcs")


@dataclass(frozen=True)
class PointingSettings:
    on_the_fly: bool = True
    batch_size: int = 32
    interpolation: str = "nearest"


@dataclass(frozen=True)
class Polynomial:
    min_order: int = 0
    max_order: int = 3


@dataclass(frozen=True)
class ScanSynchronous:
    min_order: int = 3
    max_order: int = 7


@dataclass(frozen=True)
class BinAzSynchronous:
    n_bins: int = 4
    interpolate: bool = False
    smooth: bool = False


@dataclass(frozen=True)
class HwpSynchronous:
    harmonics: int = 3


@dataclass(frozen=True)
class AzHwpSynchronous:
    min_order: int = 0
    max_order: int = 3
    harmonics: int = 4
    split_scans: bool = False


@dataclass(frozen=True)
class SplineHwpss:
    n_knots: int | None = None
    samples_per_knot: int = 4000
    harmonics: tuple[int, ...] = (4,)

    def __post_init__(self):
        if self.n_knots is not None and self.n_knots < 2:
            raise ValueError("a spline needs two knots at least")


@dataclass(frozen=True)
class Ground:
    azimuth_resolution: float = 0.05
    elevation_resolution: float = 0.05


@dataclass(frozen=True)
class Templates:
    polynomial: Polynomial | None = None
    scan_synchronous: ScanSynchronous | None = None
    binaz_synchronous: BinAzSynchronous | None = None
    hwp_synchronous: HwpSynchronous | None = None
    azhwp_synchronous: AzHwpSynchronous | None = None
    spline_hwpss: SplineHwpss | None = None
    ground: Ground | None = None
    regularization: float = 0.0


@dataclass(frozen=True)
class MapMaking:
    method: Method = Method.BINNED
    scanning_mask: bool = False
    sample_mask: bool = False
    hits_cut: float = 1e-2
    cond_cut: float = 1e-2
    double_precision: bool = True
    debug: bool = True
    atop_tau: int = 0
    landscape: LandscapeSettings = field(default_factory=lambda: LandscapeSettings(healpix=HealpixSettings()))
    weighting: Weighting = field(default_factory=Weighting)
    gaps: Gaps = field(default_factory=Gaps)
    pointing: PointingSettings = field(default_factory=PointingSettings)
    solver: Solver = field(default_factory=Solver)
    templates: Templates | None = None

    @classmethod
    def for_method(cls, method: Method | str) -> MapMaking:
        """Settings that each method is used with by default."""
        method = Method(method) if isinstance(method, str) else method
        if method is Method.MAXL:
            return cls(method, weighting=Weighting(mode=WeightingMode.TOEPLITZ, correlation_length=1000), solver=Solver(max_steps=1000))
        if method is Method.TWOSTEP:
            return cls(method, templates=Templates(polynomial=Polynomial()))
        if method is Method.ATOP:
            return cls(method, atop_tau=37, solver=Solver(max_steps=100))
        return cls(method)


def to_dict(settings) -> dict:
    def plain(x):
        if dataclasses.is_dataclass(x):
            return {f.name: plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
        if isinstance(x, enum.Enum):
            return x.value
        return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x

    return plain(settings)


def from_dict(kind: type, data: dict):
    """An object of the dataclass; names it does not have, and values of a wrong kind, are errors."""
    hints = typing.get_type_hints(kind)
    unknown = set(data) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"{kind.__name__} has no {sorted(unknown)}")
    return kind(**{name: _value(hints[name], x, f"{kind.__name__}.{name}") for name, x in data.items()})


def _value(kind, x, where: str):
    if typing.get_origin(kind) in (typing.Union, types.UnionType):
        if x is None:
            return None
        kind = next(k for k in typing.get_args(kind) if k is not type(None))
    if dataclasses.is_dataclass(kind):
        if not isinstance(x, dict):
            raise ValueError(f"{where}: settings by name expected")
        return from_dict(kind, x)
    if isinstance(kind, type) and issubclass(kind, enum.Enum):
        return kind(x)
    if typing.get_origin(kind) is tuple:
        return tuple(x)
    if kind is float and isinstance(x, int) and not isinstance(x, bool):
        return float(x)
    if not isinstance(x, kind) or (kind is int and isinstance(x, bool)):
        raise ValueError(f"{where}: {kind.__name__} expected, not {x!r}")
    return x


def load(path: str, kind: type = MapMaking):
    """From a .json file, or a YAML one where the yaml package is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return from_dict(kind, json.loads(text))
    import yaml

    return from_dict(kind, yaml.safe_load(text) or {})


def dump(settings, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        if path.endswith(".json"):
            json.dump(to_dict(settings), f, indent=2)
        else:
            import yaml

            yaml.safe_dump(to_dict(settings), f, sort_keys=False)
