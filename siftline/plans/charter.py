"""A corpus's own settings: roots, skipped paths and additional types, kept as TOML."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, fields, replace

from siftline.functions import paths
from siftline.plans.request import SearchRequest


@dataclass(frozen=True)
class Charter:
    roots: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()
    types: tuple[str, ...] = ()  # as in ``SearchRequest.type_add``

    def apply(self, request: SearchRequest) -> SearchRequest:
        """The request with these settings where it has none of its own; skipped paths are always out."""
        return replace(
            request,
            paths=request.paths or self.roots,
            ignore_rules=request.ignore_rules + self.skip,
            type_add=self.types + request.type_add,
        )

    def to_toml(self) -> str:
        return "".join(f"{f.name} = {json.dumps(list(getattr(self, f.name)), ensure_ascii=False)}\n" for f in fields(self))


def parse(text: str) -> Charter:
    found = problems(text)
    if found:
        raise ValueError("; ".join(found))
    return Charter(**{k: tuple(v) for k, v in tomllib.loads(text).items()})


def problems(text: str) -> list[str]:
    """What is wrong with a charter; nothing if it can be used."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        return [f"not TOML: {e}"]
    known, out = {f.name for f in fields(Charter)}, []
    for key, value in data.items():
        if key not in known:
            out.append(f"unknown setting {key!r}")
        elif not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            out.append(f"{key} must be a list of strings")
    if not out:
        try:
            paths.registry(tuple(data.get("types", ())))
        except ValueError as e:
            out.append(str(e))
    return out
