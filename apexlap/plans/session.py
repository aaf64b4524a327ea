"""The whole chain over many sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.corners import detect_corners
from ..operators.deltas import lap_delta_traces
from ..operators.laps import annotate_lap_samples, detect_laps, plausible_laps, start_points
from ..operators.layers import heatmap_layers, lap_collections, lap_features, lap_pieces, track_geojson, track_pieces
from ..operators.motion import build_telemetry_records, compute_derived_metrics
from ..sources.staging import written


def build_sessions(series: DataFrame, starts: DataFrame | None = None, whole: bool = True, **smoothing) -> dict[str, DataFrame]:
    """The eight results of every session: track, telemetry, laps, lap_features, lap_deltas, partial_lap_features, corners, heatmap.

    The series, telemetry and laps are written once, as all others read them.
    Unless whole, the track and the features come in pieces, for sessions of any
    length.
    """
    series = written(series, "series")
    telemetry = written(build_telemetry_records(compute_derived_metrics(series, **smoothing)), "telemetry")
    laps = written(detect_laps(telemetry, starts), "laps")
    annotated = written(annotate_lap_samples(telemetry, laps), "annotated")
    full = laps.where("not is_partial")
    features = written((lap_collections if whole else lap_pieces)(lap_features(telemetry, laps)), "features")
    return {
        "track": (track_geojson if whole else track_pieces)(telemetry, start_points(telemetry, starts)),
        "telemetry": annotated,
        "laps": full,
        "lap_features": features.where("not is_partial").drop("is_partial"),
        "lap_deltas": lap_delta_traces(annotated, laps),
        "partial_lap_features": features.where("is_partial").drop("is_partial"),
        "corners": detect_corners(telemetry, full),
        "heatmap": heatmap_layers(telemetry),
    }


def load_trajectory(series: DataFrame, starts: DataFrame | None = None, smooth_method: str = "gaussian", smooth_window: int = 7) -> tuple[DataFrame, DataFrame]:
    """Smoothed telemetry with lap annotation, and the plausible laps, of every session."""
    series = written(series, "series")
    telemetry = written(build_telemetry_records(compute_derived_metrics(series, smooth_method=smooth_method, smooth_window=smooth_window)), "telemetry")
    laps = written(plausible_laps(telemetry, detect_laps(telemetry, starts)), "laps")
    return annotate_lap_samples(telemetry, laps), laps
