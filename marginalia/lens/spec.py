"""Lens specs: JSON objects read into dataclasses with types and names resolved."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

SPEC_TYPE = "org.marginalia.lens"


class LensError(ValueError):
    """A spec that can't be read, inverted or composed."""


def strip_version(name: str) -> str:
    return name.rpartition("@")[0] if "@" in name else name


@dataclass(frozen=True)
class Pattern:
    type_id: str
    name: str | None = None
    attrs: dict = field(default_factory=dict)
    any: dict = field(default_factory=dict)
    all: dict = field(default_factory=dict)
    also: tuple[Pattern, ...] = ()  # further attribute tests, from composition

    @property
    def tests_attrs(self) -> bool:
        return bool(self.attrs or self.any or self.all or self.also)


@dataclass(frozen=True)
class Replacement:
    type_id: str
    name: str | None = None
    template: str | None = None
    rename: dict = field(default_factory=dict)
    value_ops: dict = field(default_factory=dict)  # key -> {"op": ..., "value": ...}
    add: dict = field(default_factory=dict)
    drop: tuple = ()
    keep: tuple | None = None
    then: Replacement | None = None  # what composition applies to the result

    @property
    def steps(self) -> list[Replacement]:
        return [self, *(self.then.steps if self.then else [])]

    @property
    def touches_attrs(self) -> bool:
        return any(s.rename or s.value_ops or s.add or s.drop or s.keep is not None for s in self.steps)


@dataclass(frozen=True)
class Rule:
    match: Pattern | None
    replace: Replacement | None
    join: dict | None = None
    sql: str | None = None
    delete_text: bool = False


@dataclass(frozen=True)
class Lens:
    id: str
    source: str
    target: str
    rules: tuple[Rule, ...] = ()
    passthrough: str = "keep"
    invertible: bool = True
    user_function: str | None = None
    parent_steps: tuple | None = None  # of a composed lens: (names renamed, names dropped) in everyone's parents, in turn

    @classmethod
    def from_json(cls, spec: str | dict) -> Lens:
        d = json.loads(spec) if isinstance(spec, str) else spec
        try:
            source, target = d["source"], d["target"]
            rules = tuple(_rule(r, source, target) for r in d.get("rules") or [])
            return cls(d["id"], source, target, rules, d.get("passthrough") or "keep", d.get("invertible", True), json.dumps(d["wasmModule"]) if d.get("wasmModule") else None)
        except (KeyError, TypeError, AttributeError) as e:
            raise LensError(f"not a lens spec: {e!r}") from e

    def to_json(self) -> dict:
        if self.parent_steps is not None:
            raise LensError("a composed lens has no JSON form; write its parts")
        out: dict = {"$type": SPEC_TYPE, "id": self.id, "source": self.source, "target": self.target, "rules": [_rule_json(r, self) for r in self.rules], "passthrough": self.passthrough}
        if not self.invertible:
            out["invertible"] = False
        return out

    def but(self, **changes: object) -> Lens:
        return replace(self, **changes)


def _rule(r: dict, source: str, target: str) -> Rule:
    match = replaced = None
    if (m := r.get("match")) is not None:
        match = Pattern(m.get("typeId") or source, m.get("name"), m.get("matchAttrs") or {}, m.get("matchAttrsAny") or {}, m.get("matchAttrsAll") or {})
    if (p := r.get("replace")) is not None:
        name = p.get("name")
        template = name.get("template") if isinstance(name, dict) else None
        keep = p.get("keepAttrs")
        replaced = Replacement(p.get("typeId") or target, None if template is not None else name, template, p.get("renameAttrs") or {}, p.get("mapAttrValue") or {}, p.get("addAttrs") or {}, tuple(p.get("dropAttrs") or ()), None if keep is None else tuple(keep))
    return Rule(match, replaced, r.get("join"), r.get("sql"), bool(r.get("deleteText")))


def _rule_json(r: Rule, lens: Lens) -> dict:
    out: dict = {}
    if r.match is not None:
        m = {"typeId": r.match.type_id if r.match.type_id != lens.source else None, "name": r.match.name, "matchAttrs": r.match.attrs, "matchAttrsAny": r.match.any, "matchAttrsAll": r.match.all}
        out["match"] = {k: v for k, v in m.items() if v}
    p = r.replace
    if p is not None:
        d = {"typeId": p.type_id if p.type_id != lens.target else None, "name": {"template": p.template} if p.template is not None else p.name, "renameAttrs": p.rename, "mapAttrValue": p.value_ops, "addAttrs": p.add, "dropAttrs": list(p.drop), "keepAttrs": None if p.keep is None else list(p.keep)}
        out["replace"] = {k: v for k, v in d.items() if v or (k == "keepAttrs" and v is not None)}
    elif r.join is None and r.sql is None:
        out["replace"] = None
    for k, v in (("join", r.join), ("sql", r.sql), ("deleteText", r.delete_text)):
        if v:
            out[k] = v
    return out
