"""A lens on one document's features in plain Python: for the SQL function over JSON documents, and to hold the compiled
form against. Join and SQL rules are passed over."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from .compile import parent_steps, plain_rules
from .spec import Lens, LensError, Pattern, Replacement, Rule, strip_version


def _text(v: object) -> str:
    return json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def _lookup(fields: dict, key: str) -> tuple[bool, object]:
    nested = fields.get("attrs")
    if isinstance(nested, dict) and key in nested:
        return True, nested[key]
    return key in fields, fields.get(key)


def matches(p: Pattern, type_id: str, name: str | None, fields: dict) -> bool:
    kind, whole = strip_version(type_id or ""), strip_version(p.type_id)
    if not (kind == whole and (p.name is None or name == p.name)) and not (p.name is not None and kind == f"{whole}#{p.name}"):
        return False
    for q in (p, *p.also):
        for k in dict.fromkeys((*q.attrs, *q.any, *q.all)):
            there, v = _lookup(fields, k)
            if not there:
                return False
            members = [_text(x) for x in (v if isinstance(v, list) else [v])]
            if k in q.attrs and _text(v) != _text(q.attrs[k]):
                return False
            if k in q.any and not any(_text(x) in members for x in q.any[k]):
                return False
            if k in q.all and not ((isinstance(v, list) or len(q.all[k]) == 1) and all(_text(x) in members for x in q.all[k])):
                return False
    return True


def _whole(x: float) -> int | float:
    return int(x) if x == int(x) and abs(x) < 9e15 else x


def value_op(v: object, op: dict) -> object:
    """Values of types that the op does not know stay."""
    name, arg = op["op"], op.get("value")
    number, text, boolean = isinstance(v, (int, float)) and not isinstance(v, bool), isinstance(v, str), isinstance(v, bool)
    if name in ("add", "subtract", "multiply"):
        arg = float(arg or 0)
        return _whole({"add": v + arg, "subtract": v - arg, "multiply": v * arg}[name]) if number else v
    if name in ("prefix", "suffix"):
        return (arg + v if name == "prefix" else v + arg) if text else v
    if name == "negate":
        return not v if boolean else v
    if name == "to-string":
        return v if text or isinstance(v, (list, dict)) else _text(v)
    if name == "to-number":
        if text:
            try:
                return _whole(float(v))
            except ValueError:
                return None
        return int(v) if boolean else v
    if name == "to-boolean":
        return v not in ("", "false", "0") if text else v != 0 if number else False if v is None else v
    raise LensError(f"unknown value op {name}")


def _attrs(m: dict, r: Replacement, flat: bool) -> dict:
    """rename, map, add, drop, keep - in this order."""
    m = {r.rename.get(k, k): v for k, v in m.items() if k not in r.rename.values() or k in r.rename}
    m = {k: value_op(v, r.value_ops[k]) if k in r.value_ops else v for k, v in m.items()} | r.add
    keep = None if r.keep is None else {*r.keep, *(("name", "parents") if flat else ())}
    return {k: v for k, v in m.items() if k not in r.drop and (keep is None or k in keep)}


def _replaced(r: Replacement, name: str | None, fields: dict) -> tuple[str | None, dict]:
    nested = fields.get("attrs") if isinstance(fields.get("attrs"), dict) else None
    for step in r.steps:
        if step.template is not None:
            here = {**fields, **({"attrs": nested} if nested is not None else {})}

            def put(m: re.Match, here: dict = here, step: Replacement = step) -> str:
                there, v = _lookup(here, m[1])
                return (v if isinstance(v, str) else _text(v)) if there else str(step.add.get(m[1], m[0]))

            name = re.sub(r"\{([^{}]+)\}", put, step.template)
        elif step.name is not None:
            name = step.name
        if nested is not None:
            nested = _attrs(nested, step, False)
        else:
            fields = _attrs(fields, step, True)
    return name, fields | ({"attrs": nested} if nested is not None and r.touches_attrs else {})


def rule_finder(lens: Lens) -> Callable[[str, str | None, dict], Rule | None]:
    """The first rule that matches; those on type and name alone by a lookup."""
    exact: dict[tuple, int] = {}
    tested = []
    rules = plain_rules(lens)
    for i, r in enumerate(rules):
        if r.match.tests_attrs:
            tested.append(i)
        else:
            exact.setdefault((strip_version(r.match.type_id), r.match.name), i)

    def find(type_id: str, name: str | None, fields: dict) -> Rule | None:
        kind = strip_version(type_id or "")
        head, _, tail = kind.rpartition("#")
        at = min((i for i in (exact.get((kind, None)), exact.get((kind, name)), exact.get((head, tail))) if i is not None), default=len(rules))
        at = next((i for i in tested if i < at and matches(rules[i].match, type_id, name, fields)), at)
        return rules[at] if at < len(rules) else None

    return find


def apply_to_feature(lens: Lens, type_id: str, name: str | None, fields: dict, find: Callable | None = None) -> tuple[str, str | None, dict] | None:
    """(type, name, fields) after the first matching rule; None if the feature goes. fields: all but $type. find: a
    rule_finder, where many features go through one lens."""
    rule = (find or rule_finder(lens))(type_id, name, fields)
    if rule is None and lens.passthrough == "drop" or rule is not None and rule.replace is None:
        return None
    if rule is not None:
        type_id, (new, fields) = rule.replace.steps[-1].type_id, _replaced(rule.replace, name, fields)
        if new != name and new is not None:
            fields = fields | {"name": new}
        name = new
    if isinstance(fields.get("parents"), list) and fields["parents"]:
        parents = fields["parents"]
        for renamed, gone in parent_steps(lens):
            parents = [renamed.get(x, x) for x in parents if x not in gone]
        fields = fields | {"parents": parents}
    return type_id, name, fields


def apply_to_json(doc: str, lens: Lens) -> str:
    """A JSON document rewritten; facets left without a feature go, and text under rules with deleteText."""
    d = json.loads(doc)
    facets, cuts = [], []
    for facet in d.get("facets") or []:
        features = []
        for f in facet["features"]:
            fields = {k: v for k, v in f.items() if k != "$type"}
            name = f["name"] if isinstance(f.get("name"), str) else None
            if any(r.delete_text and matches(r.match, f.get("$type", ""), name, fields) for r in lens.rules if r.match is not None):
                cuts.append((facet["index"]["byteStart"], facet["index"]["byteEnd"]))
            if (done := apply_to_feature(lens, f.get("$type", ""), name, fields)) is not None:
                features.append({"$type": done[0]} | done[2])
        if features:
            facets.append(facet | {"features": features})
    raw, gone = d["text"].encode(), 0
    merged: list[list[int]] = []
    for lo, hi in sorted(c for c in cuts if c[0] < c[1]):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    for lo, hi in merged:
        raw = raw[: lo - gone] + raw[hi - gone :]
        gone += hi - lo
    shift = lambda x: x - sum(max(0, min(x, hi) - lo) for lo, hi in merged)
    if merged:
        facets = [f | {"index": {"byteStart": shift(f["index"]["byteStart"]), "byteEnd": shift(f["index"]["byteEnd"])}} for f in facets]
        facets = [f for f in facets if f["index"]["byteStart"] < f["index"]["byteEnd"]]
    return json.dumps(d | {"text": raw.decode()} | ({"facets": facets} if "facets" in d else {}), ensure_ascii=False, separators=(",", ":"))
