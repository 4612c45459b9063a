"""What both jobs share: their config files, grids and logging."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from drift_engine.functions.geodesy import Grid

LOG = logging.getLogger("drift_engine.jobs")


def config(name: str, path: str | None = None) -> dict:
    """The job's own config file, with the settings of `path` put over it; unknown settings are refused."""
    own = json.loads(Path(__file__).with_name(f"{name}.json").read_text())
    if path:
        given = json.loads(Path(path).read_text())
        if unknown := sorted(set(given) - set(own)):
            raise ValueError(f"unknown settings {unknown}; known are {sorted(own)}")
        own |= given
    return own


def grid(settings: dict) -> Grid:
    g = settings["grid"]
    return Grid(*(float(g[k]) for k in ("x_min", "x_max", "y_min", "y_max", "x_step", "y_step")))


def say(job: str, what: str, **counts) -> None:
    LOG.info("%s: %s %s", job, what, " ".join(f"{k}={v}" for k, v in counts.items()))
