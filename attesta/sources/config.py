"""Configuration files: JSON with refused repeats, overridden by the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path

from attesta.operators.adapters import Adapter
from attesta.operators.schedule import check_zone


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        names = [k for k, _ in pairs]
        raise ValueError(f"repeated keys: {', '.join(sorted({k for k in names if names.count(k) > 1}))}")
    return out


def read(path: str | os.PathLike) -> object:
    """Decoded JSON of a file, {} if there is none; repeated keys raise."""
    file = Path(path)
    return json.loads(file.read_text(encoding="utf-8"), object_pairs_hook=_no_repeats) if file.exists() else {}


def config_dir(env: Mapping[str, str], variable: str = "ATTESTA_CONFIG_DIR", otherwise: str = "config") -> Path:
    return Path(env.get(variable) or otherwise)


def load_adapters(path: str | os.PathLike) -> dict[str, Adapter]:
    """Adapters by name; of specs that share a name the last counts; an adapter called default is refused."""
    specs = read(path)
    if isinstance(specs, dict) and "default" in specs:
        raise ValueError("there is no default adapter")
    rows = specs if isinstance(specs, list) else [{"name": k, **v} for k, v in specs.items()]
    fields = Adapter.__dataclass_fields__
    out = {}
    for spec in rows:
        given = {k: tuple(v) if k == "owner_field" else v for k, v in spec.items() if k in fields}
        out[spec["name"]] = Adapter(**given)
    return out


def load_performer_ids(path: str | os.PathLike) -> dict[str, str]:
    return {str(k): str(v) for k, v in read(path).items()}


def load_schedule(path: str | os.PathLike, renamed: Mapping[str, str] | None = None) -> dict[str, dict]:
    """Overrides by producer. A job under an old and a new name must have the same entry under both."""
    out: dict[str, dict] = {}
    for name, entry in read(path).items():
        new = (renamed or {}).get(name, name)
        if new in out and out[new] != entry:
            raise ValueError(f"{new}: two entries that differ")
        out[new] = entry
    return out


def setting(env: Mapping[str, str], variable: str, file: Mapping, key: str, otherwise: str | None = None) -> str | None:
    """The environment's value, else the file's, else a default; blanks do not count."""
    return (env.get(variable) or "").strip() or str(file.get(key) or "").strip() or otherwise


def load_server(path: str | os.PathLike, env: Mapping[str, str]) -> tuple[str, str | None]:
    """(url, key) of the library server; without a url it raises."""
    file = read(path)
    url = setting(env, "ATTESTA_SERVER_URL", file, "url")
    if not url:
        raise ValueError("the server's url is not set")
    return url, setting(env, "ATTESTA_SERVER_KEY", file, "api_key")


def load_marker_tag(path: str | os.PathLike, env: Mapping[str, str]) -> str | None:
    return setting(env, "ATTESTA_MARKER_TAG", read(path), "marker_tag")


def load_zone(path: str | os.PathLike, env: Mapping[str, str]) -> str:
    return check_zone(setting(env, "ATTESTA_ZONE", read(path), "zone", "UTC"))
