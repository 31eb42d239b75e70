"""Settings from a file, the environment and commands. Plain driver-side values; nothing here touches data."""

from __future__ import annotations

import os
import shlex
import subprocess
from copy import deepcopy
from typing import Any

DEFAULTS: dict[str, dict[str, Any]] = {
    "home": {"lat": None, "lng": None, "name": ""},
    "defaults": {"surface": "gravel", "loop": True},
    "fitness": {"max_hr": 0, "ftp": 0, "resting_hr": 0},
    "secrets": {"password": ""},
}
PREFIX = "RIDGELINE"


def secret(section: dict[str, Any], key: str) -> str:
    """A value given as it is, by the name of an environment variable (key_env), or by a command that prints it (key_cmd)."""
    value = section.get(key) or os.environ.get(section.get(f"{key}_env") or "", "")
    command = section.get(f"{key}_cmd")
    if not value and command:
        try:
            value = subprocess.run(shlex.split(command), capture_output=True, check=True, text=True).stdout.strip()
        except (OSError, ValueError, subprocess.CalledProcessError):
            value = ""
    return value


def load(path: str | None = None) -> dict[str, Any]:
    """Defaults, overlaid by the YAML file at `path` if there is one, overlaid by variables such as RIDGELINE_HOME_LAT.

    `avoid` is a list of zones (lat, lng, radius); it becomes a DataFrame by avoid_zones().
    """
    found: dict[str, Any] = deepcopy(DEFAULTS) | {"avoid": []}
    if path and os.path.exists(path):
        import yaml

        with open(path, encoding="utf-8") as file:
            given = yaml.safe_load(file) or {}
        for name, values in given.items():
            found[name] = found[name] | values if isinstance(values, dict) and isinstance(found.get(name), dict) else values
    for name, section in found.items():
        if isinstance(section, dict):
            for key in section:
                if text := os.environ.get(f"{PREFIX}_{name}_{key}".upper()):
                    section[key] = typed(text, DEFAULTS.get(name, {}).get(key))
    for key in DEFAULTS["secrets"]:
        found["secrets"][key] = secret(found["secrets"], key)
    found["avoid"] = found["avoid"] or []
    return found


def typed(text: str, like: Any) -> Any:
    """A variable's text in the type of the default; numbers where there is none and it reads as one."""
    if isinstance(like, bool):
        return text.lower() in ("1", "true", "yes")
    try:
        return int(text) if isinstance(like, int) else float(text) if like is None else text
    except ValueError:
        return like if isinstance(like, int) else text


def avoid_zones(spark, settings: dict[str, Any]):
    """lat, lng, radius of the zones to avoid (radius null where none is given)."""
    rows = [(float(z["lat"]), float(z["lng"]), float(z["radius"]) if z.get("radius") is not None else None) for z in settings["avoid"]]
    return spark.createDataFrame(rows, "lat double, lng double, radius double")
