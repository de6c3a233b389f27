"""Workflow settings: plain dataclasses, read from and written to YAML."""

from __future__ import annotations

import dataclasses
import glob
import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass
class PsOptions:
    amp_dispersion_threshold: float = 0.25


@dataclass
class HalfWindow:
    y: int = 7
    x: int = 14

    @property
    def looks(self) -> tuple[int, int]:
        return 2 * self.y + 1, 2 * self.x + 1


@dataclass
class PhaseLinkingOptions:
    ministack_size: int = 15
    max_num_compressed: int = 10
    output_reference_idx: int | None = None
    half_window: HalfWindow = field(default_factory=HalfWindow)
    use_evd: bool = False
    beta: float = 0.0
    zero_correlation_threshold: float = 0.0
    shp_method: str = "glrt"
    shp_alpha: float = 0.001
    mask_input_ps: bool = False
    fill_ps: bool = True
    use_max_ps: bool = True
    use_slc_amplitude: bool = False
    baseline_lag: int | None = None
    compressed_slc_plan: str = "always_first"
    write_crlb: bool = True
    write_closure_phase: bool = False


@dataclass
class InterferogramNetwork:
    """With nothing set, the nearest three."""

    reference_idx: int | None = None
    max_bandwidth: int | None = None
    max_temporal_baseline: float | None = None
    include_annual: bool = False
    annual_buffer_days: float = 30
    indexes: list[tuple[int, int]] | None = None


@dataclass
class TimeseriesOptions:
    run_inversion: bool = True
    method: str = "L1"
    reference_point: tuple[int, int] | None = None
    run_velocity: bool = True
    #: none, correlation (as phase variance's inverse) or conncomp (unlabelled pixels are left out); for L2 only.
    weighting: str = "none"
    apply_mask_to_timeseries: bool = True
    #: Below it, an interferogram's pixel has no weight in a weighted inversion, and a date's in the velocity.
    correlation_threshold: float = 0.2


@dataclass
class UnwrapOptions:
    run_unwrap: bool = True
    run_goldstein: bool = False
    run_interpolation: bool = False
    unwrap_method: str = "least_squares"
    zero_where_masked: bool = False
    alpha: float = 0.5
    max_radius: int = 51
    interpolation_cor_threshold: float = 0.25
    interpolation_similarity_threshold: float = 0.3


@dataclass
class OutputOptions:
    strides_y: int = 1
    strides_x: int = 1
    #: First and last row, first and last column (the last ones not included) of the input's pixels; others are nodata.
    bounds: tuple[int, int, int, int] | None = None
    add_overviews: bool = True
    overview_levels: tuple[int, ...] = (4, 8, 16, 32, 64)
    extra_reference_date: int | None = None


@dataclass
class InputOptions:
    """Parquet tables. stack: scene, t, row, col, re, im; dates: scene, t, dt; mask: scene, row, col, valid of the input's pixels;
    bursts: scene, frame, row0, col0, where the scenes are bursts that are stitched to frames; ionosphere: scene, t, row, col,
    delay (in metres, of the output pixels), which is taken off the displacement."""

    stack: str = ""
    dates: str = ""
    wavelength: float | None = None
    mask: str = ""
    bursts: str = ""
    ionosphere: str = ""


@dataclass
class Workflow:
    work_directory: str = "."
    inputs: InputOptions = field(default_factory=InputOptions)
    ps: PsOptions = field(default_factory=PsOptions)
    phase_linking: PhaseLinkingOptions = field(default_factory=PhaseLinkingOptions)
    network: InterferogramNetwork = field(default_factory=InterferogramNetwork)
    unwrap: UnwrapOptions = field(default_factory=UnwrapOptions)
    timeseries: TimeseriesOptions = field(default_factory=TimeseriesOptions)
    output: OutputOptions = field(default_factory=OutputOptions)

    def __post_init__(self) -> None:
        if self.timeseries.method.upper() not in ("L1", "L2"):
            raise ValueError(f"unknown inversion method {self.timeseries.method}")
        if self.timeseries.weighting not in ("none", "correlation", "conncomp"):
            raise ValueError(f"unknown weighting {self.timeseries.weighting}")
        if self.phase_linking.shp_method not in ("rect", "glrt", "ks"):
            raise ValueError(f"unknown method {self.phase_linking.shp_method}")
        from fringeflow.operators.images import SINGLE_REFERENCE

        if self.unwrap.unwrap_method in SINGLE_REFERENCE:
            self.network = InterferogramNetwork(reference_idx=self.network.reference_idx or 0)

    def to_dict(self) -> dict[str, Any]:
        return dataclasses.asdict(self)

    def to_yaml(self, path: str | Path) -> None:
        import yaml

        plain = _plain(self.to_dict())
        Path(path).write_text(yaml.safe_dump(plain, sort_keys=False))

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> Workflow:
        return _built(cls, values)

    @classmethod
    def from_yaml(cls, path: str | Path) -> Workflow:
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text()) or {})


def _plain(value):
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def _built(kind, values: dict[str, Any]):
    known = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise ValueError(f"unknown settings for {kind.__name__}: {', '.join(unknown)}")
    out = {}
    for name, value in values.items():
        default = known[name].default_factory if known[name].default_factory is not dataclasses.MISSING else None
        if default and dataclasses.is_dataclass(default) and isinstance(value, dict):
            value = _built(default, value)
        elif isinstance(value, list) and name != "indexes":
            value = tuple(value)
        elif name == "indexes" and value:
            value = [tuple(x) for x in value]
        out[name] = value
    return kind(**out)


def file_list(spec: str | list[str]) -> list[str]:
    """Paths from a glob, from @list.txt (one per line, relative to the list), from a text of lines, or a list; sorted, distinct."""
    if isinstance(spec, list):
        return sorted(set(spec))
    if spec.startswith("@"):
        base = os.path.dirname(spec[1:])
        lines = [x.strip() for x in Path(spec[1:]).read_text().splitlines()]
        return sorted({x if os.path.isabs(x) or "://" in x else os.path.join(base, x) for x in lines if x and not x.startswith("#")})
    if "\n" in spec:
        return sorted({x.strip() for x in spec.splitlines() if x.strip()})
    return sorted(glob.glob(spec))
