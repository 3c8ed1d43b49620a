"""Coordinate frames as column metadata, checked when a plan is built.

A frame stays with a column through projections, filters, joins and renaming.  Distance operators refuse a degree column, two sides in
different frames and, with ``tidewright.frame.required``, a column whose frame is not stated: a frame is set where data enter, never
guessed inside an operator."""
from __future__ import annotations

from pyspark.sql import DataFrame

FRAME_REQUIRED_KEY = "tidewright.frame.required"
METRIC = "EPSG:32636"
GEOGRAPHIC = ("EPSG:4326", "OGC:CRS84")


def in_frame(df: DataFrame, frame: str, *columns: str) -> DataFrame:
    """State the frame of coordinate columns; other metadata of theirs is kept."""
    for c in columns:
        df = df.withMetadata(c, {**df.schema[c].metadata, "frame": frame})
    return df


def frame_of(df: DataFrame, column: str) -> str | None:
    return df.schema[column].metadata.get("frame")


def fault(frame: str | None, metric: str | None = METRIC) -> str | None:
    """Why a frame does not serve for distances, areas or grids; None where it does."""
    if frame is None:
        return "MISSING"
    if frame in GEOGRAPHIC:
        return "GEOGRAPHIC"
    return None if metric is None or frame == metric else "OTHER"


def require_metric(*sides: tuple[DataFrame, tuple[str, ...]]) -> None:
    """Raise unless the coordinates of all sides are metric and of one frame; a frame that is not stated passes unless frames are required."""
    strict = sides[0][0].sparkSession.conf.get(FRAME_REQUIRED_KEY, "false") == "true"
    seen: dict[str, str] = {}
    for df, columns in sides:
        for c in columns:
            frame = frame_of(df, c)
            why = fault(frame, None)
            if why == "GEOGRAPHIC":
                raise ValueError(f"{c} is in degrees ({frame}): project it before distances, areas or grids")
            if why == "MISSING":
                if strict:
                    raise ValueError(f"{c} states no frame: set it with in_frame where the data enter")
                continue
            seen[frame] = c
    if len(seen) > 1:
        raise ValueError(f"columns of different frames: {', '.join(f'{c} in {f}' for f, c in sorted(seen.items()))}")
