"""The run's settings: frozen dataclasses read strictly from one YAML file."""

from __future__ import annotations

import dataclasses
import math
import typing
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from drift_engine.functions.geodesy import ELLIPSOIDS, METRES, Grid, Space
from drift_engine.operators.gradients import GradientConfig
from drift_engine.operators.sections import SectionConfig
from drift_engine.operators.tracks import SECONDS


class ConfigError(ValueError):
    """Settings that do not fit."""


@dataclass(frozen=True)
class Columns:
    time: str
    x: str
    y: str
    trajectory: str | None = None
    obs: str | None = None
    group_member: str | None = None


@dataclass(frozen=True)
class TrajectoryId:
    mode: str = "column"
    scope: str = "file"


@dataclass(frozen=True)
class Time:
    kind: str
    unit: str | None = None


@dataclass(frozen=True)
class Input:
    paths: tuple[str, ...]
    columns: Columns
    time: Time
    trajectory_id: TrajectoryId = field(default_factory=TrajectoryId)
    format: str = "auto"


@dataclass(frozen=True)
class Matrix:
    timestep: float
    time_unit: str
    compute: bool = True
    path: str | None = None
    id: str | None = None
    segment_mode: str = "non_overlapping"
    max_interpolation_gap: float | None = None


@dataclass(frozen=True)
class Geometry:
    coordinate_system: str
    length_unit: str
    ellipsoid: str | None = None


@dataclass(frozen=True)
class GridSettings:
    x_min: float
    x_max: float
    y_min: float
    y_max: float
    dx: float
    dy: float
    periodic_longitude: bool = False


@dataclass(frozen=True)
class Statistics:
    min_moving_support: int = 10
    angular_bins: int = 36
    direction_zero_tolerance: float = 1e-12
    high_R1: float = 0.8
    low_R1: float = 0.5


@dataclass(frozen=True)
class Flux:
    percentile: float = 0.9
    ridge_field: str = "raw"
    transverse_scale_grid: float = 1.0
    interpolation_weight_tolerance: float = 1e-10
    orientation_reliable_R1: float = 0.8
    orientation_ambiguous_R1: float = 0.5
    direction_disagreement_degrees: float = 20.0
    abrupt_tangent_mismatch_degrees: float = 45.0
    ridge_comparison_tolerance: float = 1e-12
    smoothing_window_cells: int = 3


@dataclass(frozen=True)
class Directional:
    minimum_P_move: float = 0.5
    minimum_R1: float = 0.8
    minimum_strength: float = 0.5
    maximum_neighbor_direction_difference_degrees: float = 45.0
    maximum_step_direction_mismatch_degrees: float = 45.0
    minimum_component_cells: int = 3
    transverse_scale_grid: float = 1.0
    ridge_comparison_tolerance: float = 1e-12
    ridge_plateau_tolerance: float = 1e-12
    interpolation_weight_tolerance: float = 1e-10


@dataclass(frozen=True)
class Fronts:
    half_width_grid_scales: float = 5
    sampling_interval_grid_scales: float = 1
    core_refinement_grid_scales: float = 1
    robust_median_window_samples: int = 3
    composite_half_window_sections: int = 2
    minimum_persistent_neighbor_sections: int = 2
    minimum_persistent_fraction: float = 0.5
    diagnostic_low_R1: float = 0.5
    diagnostic_large_direction_disagreement_degrees: float = 20.0
    diagnostic_high_curvature_degrees: float = 60.0
    diagnostic_strong_outer_recovery_fraction: float = 0.5
    diagnostic_min_full_section_valid_samples: int = 7
    nearby_branch_cross_distance_scales: float = 5.0
    nearby_branch_along_distance_scales: float = 1.0

    def sections(self, weight_tolerance: float = 1e-10) -> SectionConfig:
        return SectionConfig(
            half_width=self.half_width_grid_scales,
            interval=self.sampling_interval_grid_scales,
            refinement=self.core_refinement_grid_scales,
            median_samples=self.robust_median_window_samples,
            composite_window=self.composite_half_window_sections,
            persistent_sections=self.minimum_persistent_neighbor_sections,
            persistent_fraction=self.minimum_persistent_fraction,
            strong_recovery=self.diagnostic_strong_outer_recovery_fraction,
            tolerance=weight_tolerance,
            along_scales=self.nearby_branch_along_distance_scales,
            cross_scales=self.nearby_branch_cross_distance_scales,
            low_r1=self.diagnostic_low_R1,
            disagreement=self.diagnostic_large_direction_disagreement_degrees,
            high_turn=self.diagnostic_high_curvature_degrees,
            least_valid=self.diagnostic_min_full_section_valid_samples,
        )


@dataclass(frozen=True)
class Validation:
    normalization_atol: float = 1e-12
    probability_rtol: float = 1e-10
    probability_atol: float = 1e-12
    center_atol: float = 1e-9
    gradient_zero_tolerance: float = 1e-12
    interpolation_weight_tolerance: float = 1e-10
    gradient_search_radius_grid_scales: float = 1.0
    local_background_radius_grid_scales: float = 2.0
    duplicate_disagreement_grid_scales: float = 1.0
    core_gradient_ratio_epsilon: float = 1e-12
    multiple_drop_similarity_fraction: float = 0.1
    direct_sample_atol_grid_cells: float = 1e-8

    def gradients(self) -> GradientConfig:
        return GradientConfig(self.gradient_zero_tolerance, self.interpolation_weight_tolerance, self.gradient_search_radius_grid_scales, self.local_background_radius_grid_scales, self.duplicate_disagreement_grid_scales, self.core_gradient_ratio_epsilon, self.direct_sample_atol_grid_cells)


@dataclass(frozen=True)
class Plotting:
    enabled: bool = False
    dpi: int = 160
    projection: str | None = None
    central_longitude: float | None = None
    circular_boundary: bool = False
    draw_coastlines: bool = False
    vector_stride_cells: int = 5
    vector_reference: float = 5.0
    directional_vector_reference: float = 0.5
    structure_map_max_percentile: float = 100.0
    debug_plots: bool = False


@dataclass(frozen=True)
class Output:
    root: str
    run_name: str


@dataclass(frozen=True)
class Config:
    matrix: Matrix
    geometry: Geometry
    grid: GridSettings
    output: Output
    input: Input | None = None
    statistics: Statistics = field(default_factory=Statistics)
    flux: Flux = field(default_factory=Flux)
    directional: Directional = field(default_factory=Directional)
    fronts: Fronts = field(default_factory=Fronts)
    validation: Validation = field(default_factory=Validation)
    plotting: Plotting = field(default_factory=Plotting)
    write_debug_outputs: bool = False
    run_validation: bool = False
    analysis_version: str | None = None
    config_version: int = 1

    @property
    def space(self) -> Space:
        return Space(self.geometry.coordinate_system == "geographic", self.geometry.length_unit, self.geometry.ellipsoid or "WGS84")

    @property
    def engine_grid(self) -> Grid:
        g = self.grid
        return Grid(g.x_min, g.x_max, g.y_min, g.y_max, g.dx, g.dy, g.periodic_longitude)

    @property
    def lag(self) -> float:
        return self.matrix.timestep * SECONDS[self.matrix.time_unit]


_GEOGRAPHIC = {"longitude_min": "x_min", "longitude_max": "x_max", "latitude_min": "y_min", "latitude_max": "y_max", "lon_min": "x_min", "lon_max": "x_max", "lat_min": "y_min", "lat_max": "y_max", "dlon": "dx", "dlat": "dy"}


def _scalar(kind, value, where: str):
    if kind is float and type(value) in (int, float):
        if not math.isfinite(value):
            raise ConfigError(f"{where}: not finite")
        return float(value)
    if type(value) is not kind:
        raise ConfigError(f"{where}: {kind.__name__} expected, not {value!r}")
    return value


def _read(kind, value, where: str):
    """A value of the annotated kind; unknown and missing keys and other types raise."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if args and type(None) in args:
        return None if value is None else _read(next(a for a in args if a is not type(None)), value, where)
    if origin is tuple:
        if not isinstance(value, list) or not value:
            raise ConfigError(f"{where}: a list with an entry is expected")
        return tuple(_read(args[0], v, f"{where}[{i}]") for i, v in enumerate(value))
    if not dataclasses.is_dataclass(kind):
        return _scalar(kind, value, where)
    if not isinstance(value, dict):
        raise ConfigError(f"{where}: a mapping is expected")
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(value) - set(fields)):
        raise ConfigError(f"{where}: unknown keys {unknown}")
    hints = typing.get_type_hints(kind)
    missing = [n for n, f in fields.items() if n not in value and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
    if missing:
        raise ConfigError(f"{where}: missing keys {missing}")
    return kind(**{k: _read(hints[k], v, f"{where}.{k}" if where else k) for k, v in value.items()})


def _one_of(value, allowed, where: str) -> None:
    if value not in allowed:
        raise ConfigError(f"{where}: one of {sorted(allowed)} expected, not {value!r}")


def check(c: Config) -> None:
    """Rules across settings."""
    _one_of(c.config_version, {1}, "config_version")
    _one_of(c.geometry.coordinate_system, {"geographic", "cartesian"}, "geometry.coordinate_system")
    _one_of(c.geometry.length_unit, METRES, "geometry.length_unit")
    geographic = c.geometry.coordinate_system == "geographic"
    if c.geometry.ellipsoid is not None:
        if not geographic:
            raise ConfigError("geometry.ellipsoid: only for geographic coordinates")
        _one_of(c.geometry.ellipsoid, ELLIPSOIDS, "geometry.ellipsoid")
    m = c.matrix
    _one_of(m.time_unit, SECONDS, "matrix.time_unit")
    _one_of(m.segment_mode, {"non_overlapping", "every_observation"}, "matrix.segment_mode")
    if not m.timestep > 0 or m.max_interpolation_gap is not None and not m.max_interpolation_gap > 0:
        raise ConfigError("matrix: timestep and max_interpolation_gap must be positive")
    if m.compute and c.input is None or not m.compute and m.path is None:
        raise ConfigError("matrix: compute needs input, and loading needs path")
    g = c.grid
    for low, high, step, axis in ((g.x_min, g.x_max, g.dx, "x"), (g.y_min, g.y_max, g.dy, "y")):
        if not step > 0 or not high > low or abs((high - low) / step - round((high - low) / step)) > 1e-9:
            raise ConfigError(f"grid: the {axis} span must be a whole number of positive steps")
    if geographic and not (-90 <= g.y_min < g.y_max <= 90) or g.periodic_longitude and abs(g.x_max - g.x_min - 360) > 1e-9:
        raise ConfigError("grid: latitudes must be within -90 to 90, and a periodic grid must span 360 degrees")
    if c.input is not None:
        i = c.input
        _one_of(i.format, {"auto", "csv", "parquet", "netcdf", "zarr"}, "input.format")
        _one_of(i.trajectory_id.mode, {"column", "filename"}, "input.trajectory_id.mode")
        _one_of(i.trajectory_id.scope, {"file", "global"}, "input.trajectory_id.scope")
        _one_of(i.time.kind, {"datetime", "numeric"}, "input.time.kind")
        if (i.time.kind == "numeric") != (i.time.unit is not None):
            raise ConfigError("input.time.unit: for numeric time, and only for it")
        if i.time.unit is not None:
            _one_of(i.time.unit, SECONDS, "input.time.unit")
        names = [v for v in dataclasses.asdict(i.columns).values() if v is not None]
        if len(set(names)) < len(names):
            raise ConfigError("input.columns: names must differ")
        if i.trajectory_id.mode == "column" and i.columns.trajectory is None:
            raise ConfigError("input.columns.trajectory: needed for column identities")
    shares = {"flux.percentile": c.flux.percentile, "directional.minimum_P_move": c.directional.minimum_P_move, "directional.minimum_R1": c.directional.minimum_R1, "fronts.minimum_persistent_fraction": c.fronts.minimum_persistent_fraction}
    for name, v in shares.items():
        if not 0 <= v <= 1:
            raise ConfigError(f"{name}: between 0 and 1")
    _one_of(c.flux.ridge_field, {"raw", "smoothed"}, "flux.ridge_field")
    _one_of(c.flux.smoothing_window_cells, {3}, "flux.smoothing_window_cells")
    if c.statistics.angular_bins < 4 or c.statistics.min_moving_support < 1:
        raise ConfigError("statistics: at least 4 angular bins and a support of 1")
    if c.fronts.robust_median_window_samples % 2 != 1:
        raise ConfigError("fronts.robust_median_window_samples: odd")
    f = c.fronts
    if not f.sampling_interval_grid_scales > 0 or not f.half_width_grid_scales > 0:
        raise ConfigError("fronts: half_width_grid_scales and sampling_interval_grid_scales must be positive")
    steps = f.half_width_grid_scales / f.sampling_interval_grid_scales
    if abs(steps - round(steps)) > 1e-9:
        raise ConfigError("fronts.half_width_grid_scales: a whole number of sampling intervals, so that a sample is at the core")
    if not 0 <= c.plotting.structure_map_max_percentile <= 100 or c.plotting.vector_stride_cells < 1:
        raise ConfigError("plotting: a percentile up to 100 and a stride of 1 or more")


def from_dict(values: dict, base: Path | None = None) -> Config:
    """Settings from nested mappings; relative paths are those of `base`."""
    values = dict(values)
    if "transport" in values:
        raise ConfigError("transport: this section is now called flux")
    grid = dict(values.get("grid") or {})
    geographic = (values.get("geometry") or {}).get("coordinate_system") == "geographic"
    if geographic:
        grid = {_GEOGRAPHIC.get(k, k): v for k, v in grid.items()}
        grid.setdefault("periodic_longitude", True)
    elif grid.get("periodic_longitude"):
        raise ConfigError("grid.periodic_longitude: only for geographic coordinates")
    values["grid"] = grid
    c = _read(Config, values, "")
    check(c)
    if base is not None:
        at = lambda p: p if Path(p).is_absolute() or "://" in p else str((base / p).resolve())
        if c.input is not None:
            c = dataclasses.replace(c, input=dataclasses.replace(c.input, paths=tuple(map(at, c.input.paths))))
        if c.matrix.path is not None:
            c = dataclasses.replace(c, matrix=dataclasses.replace(c.matrix, path=at(c.matrix.path)))
        c = dataclasses.replace(c, output=dataclasses.replace(c.output, root=at(c.output.root)))
    return c


def input_of(values: dict) -> Input:
    """The settings of a run's input alone."""
    return _read(Input, values, "input")


def load(path: str | Path) -> Config:
    path = Path(path)
    values = yaml.safe_load(path.read_text())
    if not isinstance(values, dict):
        raise ConfigError("a mapping is expected")
    return from_dict(values, path.parent.resolve())


def as_dict(c: Config) -> dict:
    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return plain(dataclasses.asdict(c))
