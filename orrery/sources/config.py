"""Configuration files and protocols, checked on the driver before any data is read."""

from __future__ import annotations

import hashlib
import re
import tomllib
from pathlib import Path
from typing import Any

EFFECTS = ("shear", "shadow", "flare", "radiation")


def load(path: str, allowed: dict[str, type | tuple[type, ...]], required: tuple[str, ...] = (), paths: tuple[str, ...] = ()) -> dict[str, Any]:
    """A TOML file of known keys and kinds, with ``sha256`` of its bytes; keys of ``paths`` are taken from the file's folder.

    Raises ValueError for keys that are unknown, missing or of another kind, and
    for paths that leave the folder.
    """
    data = Path(path).read_bytes()
    config = tomllib.loads(data.decode())
    wrong = sorted(set(config) - set(allowed)) + [f"no {k}" for k in required if k not in config]
    wrong += [f"{k} is a {type(v).__name__}" for k, v in config.items() if k in allowed and (not isinstance(v, allowed[k]) or (isinstance(v, bool) and allowed[k] is not bool))]
    if wrong:
        raise ValueError(f"{path}: {', '.join(wrong)}")
    folder = Path(path).resolve().parent
    for key in paths:
        if key in config:
            at = (folder / config[key]).resolve()
            if not at.is_relative_to(folder):
                raise ValueError(f"{path}: {key} leaves its folder")
            config[key] = str(at)
    return config | {"sha256": hashlib.sha256(data).hexdigest()}


def protocol_violations(conditions: list[dict[str, Any]], effects: tuple[str, ...] = EFFECTS) -> list[str]:
    """What is wrong with a protocol: ids that repeat or are odd, chains of unknown or repeated effects, missing parameters, empty chains but 'clean'."""
    found, seen = [], set()
    for c in conditions:
        name, chain = str(c.get("id", "")), list(c.get("effects", []))
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.+-]{0,127}", name):
            found.append(f"id {name!r}")
        if name in seen:
            found.append(f"{name}: twice")
        seen.add(name)
        if (name == "clean") != (not chain):
            found.append(f"{name}: chain is {'empty' if not chain else 'not empty'}")
        found += [f"{name}: unknown effect {e}" for e in chain if e not in effects]
        if len(set(chain)) != len(chain):
            found.append(f"{name}: an effect repeats")
        found += [f"{name}: no parameters of {e}" for e in chain if not isinstance(c.get("parameters", {}).get(e), dict)]
    return found


def gate(identity: dict[str, Any], wanted: dict[str, Any]) -> None:
    """All or nothing: raises ValueError with every field of ``wanted`` that ``identity`` hasn't; a tuple lists what may be."""
    wrong = [f"{k}: {identity.get(k)!r}" for k, v in wanted.items() if (identity.get(k) not in v if isinstance(v, tuple) else identity.get(k) != v)]
    if wrong:
        raise ValueError("; ".join(wrong))
