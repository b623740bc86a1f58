"""The settings of a project's table of attempts."""

from __future__ import annotations

import tomllib
from pathlib import Path
from typing import NamedTuple

# Keys that must be there.
KEYS, COLUMNS = ("file", "heading", "columns"), ("number", "date", "description", "variables", "result", "verdict")


class ConfigError(ValueError):
    """The settings are missing or wrong."""


class Attempts(NamedTuple):
    """A list that isn't there is None, which is not the same as an empty one."""

    file: str
    heading: str
    columns: dict[str, str]
    steps_dir: str | None = None
    dead_variables: list[str] | None = None
    active_verdicts: list[str] | None = None
    date_year: int | None = None


def read(path: str) -> Attempts:
    try:
        data = tomllib.loads(Path(path).read_text())
    except OSError as e:
        raise ConfigError(f"{path}: {e.strerror}") from e
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e
    absent = [k for k in KEYS if k not in data] or [k for k in COLUMNS if k not in data["columns"]]
    if absent:
        raise ConfigError(f"{path} lacks {', '.join(absent)}")
    year = data.get("date_year")
    if year is not None and (not isinstance(year, int) or isinstance(year, bool)):
        raise ConfigError(f"{path}: date_year must be a year")
    return Attempts(**{k: data.get(k) for k in Attempts._fields})
