"""Search specifications: a suite of searches from JSON or YAML, with closed fields."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from pathlib import Path
from typing import Any

DEFAULT_LIMIT = 2000
KINDS = ("geometry", "time", "bbox", "attribute_raw")
ACTIONS = ("count", "greater-then", "less-then", "exact", "contain", "contains")


class SpecError(ValueError):
    """A specification with unknown, missing or ill-typed fields."""


def _closed(cls, data: Any, where: str) -> dict:
    if not isinstance(data, dict):
        raise SpecError(f"{where} must be an object")
    known = {f.name for f in fields(cls)}
    unknown = sorted(set(data) - known)
    if unknown:
        raise SpecError(f"{where} has unknown fields: {', '.join(unknown)}")
    return dict(data)


def _typed(data: dict, where: str, **kinds: type | tuple[type, ...]) -> None:
    for name, kind in kinds.items():
        value = data.get(name)
        if value is None:
            continue
        if isinstance(value, bool) or not isinstance(value, kind):
            raise SpecError(f"{where}.{name} has the wrong type")


@dataclass(frozen=True)
class Predicate:
    type_of: str
    description: str | None = None
    option: str | None = None
    value: str | None = None
    xmin: float | None = None
    xmax: float | None = None
    ymin: float | None = None
    ymax: float | None = None
    bbox_column_name: str = "bbox"
    statement: str | None = None

    @classmethod
    def build(cls, data: Any, where: str) -> "Predicate":
        data = _closed(cls, data, where)
        text = dict.fromkeys(("type_of", "description", "option", "value", "bbox_column_name", "statement"), str)
        number = dict.fromkeys(("xmin", "xmax", "ymin", "ymax"), (int, float))
        _typed(data, where, **text, **number)
        if data.get("type_of") not in KINDS:
            raise SpecError(f"{where}.type_of must be one of {', '.join(KINDS)}")
        return cls(**data)


@dataclass(frozen=True)
class Operation:
    ands: tuple[Predicate, ...] = ()
    ors: tuple[Predicate, ...] = ()
    nots: tuple[Predicate, ...] = ()

    @classmethod
    def build(cls, data: Any, where: str) -> "Operation":
        data = _closed(cls, data, where)
        groups = {}
        for name in ("ands", "ors", "nots"):
            listed = data.get(name)
            if listed is None:
                continue
            if not isinstance(listed, list):
                raise SpecError(f"{where}.{name} must be a list")
            groups[name] = tuple(Predicate.build(p, f"{where}.{name}[{i}]") for i, p in enumerate(listed))
        if not groups:
            raise SpecError(f"{where} needs at least one of ands, ors, nots")
        return cls(**groups)


@dataclass(frozen=True)
class Rule:
    action: str
    value: str | int

    @classmethod
    def build(cls, data: Any, where: str) -> "Rule":
        data = _closed(cls, data, where)
        _typed(data, where, action=str, value=(str, int))
        if data.get("action") not in ACTIONS or data.get("value") is None:
            raise SpecError(f"{where} needs an action of {', '.join(ACTIONS)} and a value")
        return cls(**data)


@dataclass(frozen=True)
class Search:
    name: str | None = None
    description: str | None = None
    raw: str | None = None
    columns: tuple[str, ...] = ("*",)
    operations: tuple[Operation, ...] | None = None
    sortby: str | None = None
    limit: int = DEFAULT_LIMIT
    source: str = "**/*.parquet"
    expected: Rule | None = None

    @classmethod
    def build(cls, data: Any, where: str) -> "Search":
        data = _closed(cls, data, where)
        _typed(data, where, name=str, description=str, raw=str, columns=list, operations=list, sortby=str)
        _typed(data, where, limit=int, source=str)
        if data.get("raw") is None and data.get("operations") is None:
            raise SpecError(f"{where} needs raw or operations")
        if data.get("columns") is not None:
            data["columns"] = tuple(data["columns"])
        if data.get("operations") is not None:
            data["operations"] = tuple(
                Operation.build(o, f"{where}.operations[{i}]") for i, o in enumerate(data["operations"])
            )
        if data.get("expected") is not None:
            data["expected"] = Rule.build(data["expected"], f"{where}.expected")
        return cls(**{k: v for k, v in data.items() if v is not None})

    def with_limit(self, limit: int) -> "Search":
        """Another limit; a search without one stays without."""
        return self if self.limit < 1 else replace(self, limit=limit)

    def without_order(self) -> "Search":
        return replace(self, sortby=None)

    def all_columns(self) -> "Search":
        return self if "*" in self.columns else replace(self, columns=("*",))


@dataclass(frozen=True)
class Suite:
    tests: tuple[Search, ...]
    name: str | None = None
    description: str | None = None
    inputs: tuple[str, ...] | None = None
    setup: dict | None = None
    takedown: dict | None = None

    @classmethod
    def build(cls, data: Any) -> "Suite":
        data = _closed(cls, data, "suite")
        _typed(data, "suite", name=str, description=str, inputs=list, setup=dict, takedown=dict)
        if not isinstance(data.get("tests"), list):
            raise SpecError("suite.tests must be a list")
        data["tests"] = tuple(Search.build(t, f"tests[{i}]") for i, t in enumerate(data["tests"]))
        if data.get("inputs") is not None:
            data["inputs"] = tuple(data["inputs"])
        return cls(**data)


def from_json(text: str) -> Suite:
    return Suite.build(json.loads(text))


def from_yaml(text: str) -> Suite:
    try:
        import yaml
    except ImportError as missing:  # YAML is optional
        raise SpecError("reading YAML needs the yaml package") from missing
    return Suite.build(yaml.safe_load(text))


def load(path: str) -> Suite:
    """Read a suite; `.yml` / `.yaml` files are YAML, everything else is JSON."""
    text = Path(path).read_text(encoding="utf-8")
    return from_yaml(text) if path.lower().endswith((".yml", ".yaml")) else from_json(text)
