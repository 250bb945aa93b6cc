"""Configuration: YAML over defaults, environment over YAML, required keys checked, and the settings that it gives."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import fields
from typing import Any

from pyspark.sql import SparkSession

from tidewatch.functions.session import Settings
from tidewatch.sources import stores

#: Where a configuration has each setting.
PLACES = {
    "width": "windowing.window_size", "step": "windowing.step_size", "lookback": "windowing.hrv_freq_window", "fs_eda": "sampling_rates.eda", "fs_beat": "sampling_rates.bvp", "fs_temp": "sampling_rates.temp",
    "fs_acc": "sampling_rates.acc", "fs_label": "sampling_rates.label", "smooth_hz": "preprocessing.eda.presmooth_cutoff_hz", "tonic_hz": "preprocessing.eda.band_cutoff_hz", "delay": "preprocessing.eda.group_delay_seconds",
    "off_level": "preprocessing.eda.electrode_off_min_us", "off_seconds": "preprocessing.eda.electrode_off_flat_seconds", "least_amplitude": "preprocessing.eda.scr_amplitude_min_us", "most_amplitude": "preprocessing.eda.scr_amplitude_max_us",
    "band_order": "preprocessing.bvp.order", "motion_limit": "preprocessing.bvp.motion_jerk_threshold_g_per_s", "temp_hz": "preprocessing.temp.smoothing_cutoff_hz", "most_step": "preprocessing.temp.max_step_celsius",
    "divisor": "preprocessing.acc.raw_to_g_divisor", "activity_hz": "preprocessing.acc.activity_cutoff_hz",
}
BAND = ("preprocessing.bvp.band_low_hz", "preprocessing.bvp.band_high_hz")


def merged(base: Any, over: Any) -> Any:
    """Mappings merged key by key, at every depth; anything else is replaced."""
    if not isinstance(base, Mapping) or not isinstance(over, Mapping):
        return over
    return {**base, **{k: merged(base[k], v) if k in base else v for k, v in over.items()}}


def at(config: Mapping, place: str, default: Any = None) -> Any:
    """The value at a dotted place."""
    for key in place.split("."):
        if not isinstance(config, Mapping) or key not in config:
            return default
        config = config[key]
    return config


def placed(place: str, value: Any) -> dict:
    """A configuration that holds one value."""
    for key in reversed(place.split(".")):
        value = {key: value}
    return value


def load(spark: SparkSession, path: str | None, defaults: Mapping | None = None, required: Sequence[str] = ("labels.mapping",), environment: Mapping[str, str] | None = None) -> dict:
    """The configuration of a YAML file over defaults. ``environment`` names, by variable, the place that it overrides if set. Without defaults an absent file is an error; with them they do. Keys of labels.mapping become integers."""
    import yaml

    config: Any = dict(defaults or {})
    if path is not None and (defaults is None or stores.exists(spark, path)):
        config = merged(config, yaml.safe_load(stores.read_text(spark, path)) or {})
    elif defaults is None:
        raise FileNotFoundError("no configuration file, and no defaults")
    for variable, place in (environment or {}).items():
        if os.environ.get(variable):
            config = merged(config, placed(place, os.environ[variable]))
    absent = [place for place in required if at(config, place) is None]
    if absent:
        raise ValueError(f"the configuration lacks {', '.join(absent)}")
    mapping = at(config, "labels.mapping")
    if isinstance(mapping, Mapping):
        config = merged(config, {"labels": {"mapping": None}})
        config["labels"]["mapping"] = {int(k): v for k, v in mapping.items()}
    return config


def settings(config: Mapping) -> Settings:
    """The window table's settings; what a configuration doesn't have keeps its default."""
    known = {f.name: f for f in fields(Settings)}
    found = {name: at(config, place) for name, place in PLACES.items() if at(config, place) is not None}
    typed = {name: int(v) if known[name].default.__class__ is int else float(v) for name, v in found.items()}
    band = [at(config, p) for p in BAND]
    return Settings(**typed, **({"band": (float(band[0]), float(band[1]))} if None not in band else {}))
