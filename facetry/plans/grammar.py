"""The keys of a model: templates, bindings, alternatives, tag ranges and criteria share one object.

model      := { key : value, ... }
key        := identifier | alias "=" expression | index | tag range | op expression | "@" | "#"
op         := < > <= >= ~ ? ! + ^
expression := { transform ":" } path        the leftmost transform is the outermost
path       := "" | identifier { "." identifier }
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ..shapes import ShapeError

_IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
_NAME = re.compile(_IDENTIFIER)
_EXPRESSION = re.compile(rf"((?:[a-z]+:)*)({_IDENTIFIER}(?:\.{_IDENTIFIER})*)?")
_OPERATOR = re.compile(r"(<=|>=|[<>~?!+^])(.*)", re.S)
_BINDING = re.compile(rf"({_IDENTIFIER})=(.*)", re.S)
_INDEX = re.compile(r"0|[1-9][0-9]*")
#: Basic language ranges only.
_RANGE = re.compile(r"\*|[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*")


@dataclass(frozen=True)
class Expression:
    """Transforms, outermost first, over a path."""

    pipe: tuple[str, ...]
    path: tuple[str, ...]

    def __str__(self) -> str:
        return "".join(f"{p}:" for p in self.pipe) + ".".join(self.path)


@dataclass(frozen=True)
class Criterion:
    op: str
    expression: Expression
    value: Any


@dataclass(frozen=True)
class Binding:
    alias: str
    expression: Expression
    model: Mapping[str, Any]


@dataclass
class Query:
    """A model taken apart.  A node with bindings is a projection; with alternatives, a union; with bare names, a template."""

    template: dict[str, Mapping[str, Any]] = field(default_factory=dict)
    bindings: list[Binding] = field(default_factory=list)
    alternatives: dict[int, Mapping[str, Any]] = field(default_factory=dict)
    criteria: list[Criterion] = field(default_factory=list)
    offset: int = 0
    #: None where the model has no `#`; 0 asks for all.
    limit: int | None = None

    @property
    def plain(self) -> bool:
        return not (self.template or self.bindings or self.alternatives)


def expression(text: str) -> Expression:
    m = _EXPRESSION.fullmatch(text)
    if not m:
        raise ShapeError(f"malformed expression {text!r}")
    return Expression(tuple(p for p in m[1].split(":") if p), tuple(m[2].split(".")) if m[2] else ())


def _count(key: str, value: Any) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ShapeError(f"{key} takes a whole number that is not negative, not {value!r}")
    return value


def parse(model: Mapping[str, Any]) -> Query:
    """Takes a model apart; keys with the value None stand for nothing."""
    if not isinstance(model, Mapping):
        raise ShapeError(f"a model is a mapping, not {model!r}")
    q = Query()
    for key, value in model.items():
        if key in ("@", "#"):
            if value is not None:
                setattr(q, "offset" if key == "@" else "limit", _count(key, value))
        elif m := _OPERATOR.fullmatch(key):
            if value is None and m[1] not in "?!+":
                continue
            if m[1] == "^":
                value = {"asc": 1, "desc": -1}.get(value, value) if isinstance(value, str) else value
                if isinstance(value, bool) or not isinstance(value, int):
                    raise ShapeError(f"{key} takes asc, desc or a whole number")
            q.criteria.append(Criterion(m[1], expression(m[2]), value))
        elif value is None:
            continue
        elif m := _BINDING.fullmatch(key):
            if any(b.alias == m[1] for b in q.bindings):
                raise ShapeError(f"{m[1]} is bound twice")
            q.bindings.append(Binding(m[1], expression(m[2]), value))
        elif _INDEX.fullmatch(key):
            q.alternatives[int(key)] = value
        elif _NAME.fullmatch(key):
            q.template[key] = value
        else:
            raise ShapeError(f"malformed key {key!r}")
    if q.bindings and (q.template or q.alternatives):
        raise ShapeError("a projection has bindings only")
    if q.alternatives and q.template:
        raise ShapeError("a union has alternatives only")
    return q


def tag_ranges(model: Mapping[str, Any]) -> list[str]:
    """The ranges of a locale map: keys of a model on localised text."""
    out = [k for k, v in model.items() if v is not None and not _OPERATOR.fullmatch(k)]
    for k in out:
        if not _RANGE.fullmatch(k):
            raise ShapeError(f"{k!r} is not a basic language range")
    return out
