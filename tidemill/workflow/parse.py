"""Strict reading of workflow files: every key must be known and every value of its type."""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from pathlib import Path
from typing import Any

from ..functions.durations import micros
from .spec import Duration, Workflow


class ParseError(ValueError):
    pass


def load(path: str) -> Workflow:
    kinds = {".yaml": "yaml", ".yml": "yaml", ".json": "json"}
    suffix = Path(path).suffix.lower()
    if suffix not in kinds:
        raise ParseError(f"unsupported workflow file {suffix!r} (want .yaml, .yml or .json)")
    return loads(Path(path).read_text(encoding="utf-8"), kinds[suffix])


def loads(text: str, kind: str = "yaml") -> Workflow:
    try:
        if kind == "json":
            data = json.loads(text, object_pairs_hook=_unique)
        else:
            import yaml

            data = yaml.load(text, Loader=_loader())
    except ParseError:
        raise
    except Exception as e:
        raise ParseError(f"malformed {kind}: {e}") from e
    if not isinstance(data, dict):
        raise ParseError("a workflow is a mapping")
    return build(Workflow, data, "")


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in pairs:
        if k in out:
            raise ParseError(f"key {k!r} occurs twice")
        out[k] = v
    return out


def _loader() -> type:
    import yaml

    class Loader(yaml.SafeLoader):
        """Safe, and without keys that occur twice."""

    def mapping(loader: Any, node: Any) -> dict:
        return _unique([(loader.construct_object(k, deep=True), loader.construct_object(v, deep=True)) for k, v in node.value])

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return Loader


def build(kind: Any, data: Any, path: str) -> Any:
    """``data`` as a value of ``kind``, or a ParseError that names the place."""
    where = path or "workflow"
    origin = typing.get_origin(kind)
    if origin in (types.UnionType, typing.Union):
        return None if data is None else build(typing.get_args(kind)[0], data, path)
    if kind is Any:
        return data
    if kind is Duration:
        if not isinstance(data, str):
            raise ParseError(f"{where}: a duration must be a string")
        try:
            return Duration(micros(data))
        except ValueError as e:
            raise ParseError(f"{where}: {e}") from e
    if dataclasses.is_dataclass(kind):
        if data is None:
            data = {}
        if not isinstance(data, dict):
            raise ParseError(f"{where}: want a mapping")
        hints = typing.get_type_hints(kind)
        names = {n.rstrip("_"): n for n in hints}
        if unknown := [k for k in data if k not in names]:
            raise ParseError(f"{where}: unknown field {unknown[0]!r}")
        return kind(**{names[k]: build(hints[names[k]], v, f"{path}.{k}".lstrip(".")) for k, v in data.items()})
    if origin is list:
        if data is None:
            return []
        if not isinstance(data, list):
            raise ParseError(f"{where}: want a list")
        return [build(typing.get_args(kind)[0], x, f"{path}[{i}]") for i, x in enumerate(data)]
    if origin is dict:
        if not isinstance(data, dict):
            raise ParseError(f"{where}: want a mapping")
        return {str(k): build(typing.get_args(kind)[1], v, f"{path}.{k}") for k, v in data.items()}
    if kind is str and isinstance(data, (int, float)) and not isinstance(data, bool):
        return str(data)
    if data is None:
        return kind()
    if not isinstance(data, kind) or kind is int and isinstance(data, bool):
        raise ParseError(f"{where}: want {kind.__name__}, got {type(data).__name__}")
    return data
