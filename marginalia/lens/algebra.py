"""Inverse and composition of lenses, and shortest paths in a graph of vocabularies: plain Python on specs."""

from __future__ import annotations

import dataclasses
import json
from collections import deque

from .spec import Lens, LensError, Pattern, Replacement, Rule, strip_version

#: Value ops that another op undoes.
_UNDO = {"add": "subtract", "subtract": "add", "negate": "negate"}


def identity(namespace: str) -> Lens:
    return Lens(f"identity.{namespace}", namespace, namespace)


def _undo(op: dict) -> dict:
    name = op["op"]
    if name in _UNDO:
        return {"op": _UNDO[name]} | ({"value": op["value"]} if "value" in op else {})
    if name == "multiply" and op.get("value"):
        return {"op": "multiply", "value": 1 / op["value"]}
    raise LensError(f"value op {name} can't be undone")


def inverse(lens: Lens) -> Lens:
    """Ends swapped, every rule turned around; raises where something is lost on the way."""
    if not lens.invertible:
        raise LensError("declared as not invertible")
    if lens.user_function:
        raise LensError("user functions have no inverse")
    rules = []
    if lens.parent_steps is not None:
        raise LensError("a composed lens has no inverse; invert its parts and compose them the other way round")
    for r in lens.rules:
        if r.sql or r.join or r.delete_text or r.match is None:
            raise LensError("SQL, join and text-deleting rules have no inverse")
        p = r.replace
        if p is None:
            raise LensError("dropped features can't be restored")
        if p.template is not None or p.keep is not None:
            raise LensError("templates and keepAttrs lose what they replace")
        if lost := [k for k in p.drop if k not in r.match.attrs]:
            raise LensError(f"dropAttrs without matchAttrs: {lost}")
        if r.match.any or r.match.all:
            raise LensError("any/all patterns stand for several features")
        name = p.name if p.name is not None else r.match.name
        ops = {p.rename.get(k, k): _undo(op) for k, op in p.value_ops.items()}
        back = {new: old for old, new in p.rename.items()}
        # ops come after renames, so the inverse, which renames first as well, must speak of the renamed-back keys
        ops = {back.get(k, k): op for k, op in ops.items()}
        match = Pattern(p.type_id, name, dict(p.add))
        restored = {k: r.match.attrs[k] for k in p.drop}
        rules.append(Rule(match, Replacement(r.match.type_id, r.match.name, None, back, ops, restored, tuple(p.add), None)))
    return Lens(f"{lens.id}.inverse", lens.target, lens.source, tuple(rules), lens.passthrough)


def _same(a: object, b: object) -> bool:
    """Equal as JSON, type included."""
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _before(op: dict, v: object) -> list:
    """Values from which an op makes ``v``: at most one. Values of other types than the op's stay as they are."""
    name, arg = op["op"], op.get("value")
    if name == "negate":
        return [not v] if isinstance(v, bool) else [v]
    if name in ("prefix", "suffix"):
        if not isinstance(v, str):
            return [v]
        cut = v.removeprefix(arg) if name == "prefix" else v.removesuffix(arg)
        return [cut] if len(cut) + len(arg) == len(v) else []
    if name in ("add", "subtract") and isinstance(arg or 0, int):
        return [v] if not _number(v) else [v - (arg or 0) if name == "add" else v + (arg or 0)] if isinstance(v, int) else []
    raise LensError(f"a test on an attribute that {name} has changed can't be moved before it")


def _holds(p: Pattern, k: str, v: object) -> bool:
    """The tests of one attribute on a constant."""
    members = [json.dumps(x, sort_keys=True) for x in (v if isinstance(v, list) else [v])]
    texts = lambda xs: [json.dumps(x, sort_keys=True) for x in xs]
    return (
        (k not in p.attrs or _same(p.attrs[k], v))
        and (k not in p.any or any(x in members for x in texts(p.any[k])))
        and (k not in p.all or ((isinstance(v, list) or len(p.all[k]) == 1) and all(x in members for x in texts(p.all[k]))))
    )


def _pull_back(r: Replacement, p: Pattern) -> Pattern | None:
    """The attribute tests that the input of a replacement must pass so that its output passes those of ``p``; None if
    none ever does."""
    back = {new: old for old, new in r.rename.items()}
    out = Pattern("", None, {}, {}, {})
    for k in dict.fromkeys((*p.attrs, *p.any, *p.all)):
        if k in r.drop or (r.keep is not None and k not in r.keep):
            return None
        if k in r.add:
            if not _holds(p, k, r.add[k]):
                return None
            continue
        if k not in back and k in r.rename:  # the key has gone to another
            return None
        old, op = back.get(k, k), r.value_ops.get(k)
        if op is not None and (k in p.all or any(isinstance(x, (list, dict)) for x in [p.attrs.get(k)])):
            raise LensError(f"tests on members of {k} can't be moved before {op['op']}")
        if k in p.attrs:
            found = [p.attrs[k]] if op is None else _before(op, p.attrs[k])
            if not found:
                return None
            out.attrs[old] = found[0]
        if k in p.any:
            found = p.any[k] if op is None else [x for v in p.any[k] for x in _before(op, v)]
            if not found:
                return None
            out.any[old] = found
        if k in p.all:
            out.all[old] = p.all[k]
    return out


def _pull_back_all(steps: list[Replacement], p: Pattern) -> tuple[Pattern, ...] | None:
    """Tests of ``p`` and of what else it asks for, before all steps."""
    found = []
    for q in (p, *p.also):
        for r in reversed(steps):
            q = _pull_back(r, q)
            if q is None:
                return None
        if q.attrs or q.any or q.all:
            found.append(q)
    return tuple(found)


def _chain(steps: list[Replacement]) -> Replacement:
    out = None
    for r in reversed(steps):
        out = dataclasses.replace(r, then=out)
    return out


def compose(first: Lens, second: Lens) -> Lens | None:
    """first then second as one lens; None where the ends differ. Each rule of the first is followed by each rule of the
    second that may match its result, and by what the second does without a match; features that no rule of the first
    matches get the second's rules. The first's join and SQL rules are passed over, the second's come last. Raises where a
    test of the second can't be told from the source, as after a conversion to text."""
    if first.target != second.source:
        return None
    from .compile import parent_steps

    rules: list[Rule] = []
    plain = [r for r in second.rules if r.match is not None and not r.join and not r.sql]
    for a in first.rules:
        if a.match is None or a.join or a.sql:
            continue
        if a.replace is None:
            rules.append(a)
            continue
        steps = a.replace.steps
        if any(s.template is not None for s in steps) and any(b.match.name is not None for b in plain):
            raise LensError("what matches a name made from a template can't be told from the source")
        names = [s.name for s in steps if s.name is not None]
        name = names[-1] if names else a.match.name
        # without a name of its own the feature keeps its name, and the second's tests on names are tests on the source
        kind, ended = strip_version(steps[-1].type_id), False
        for b in plain:
            whole, wanted = strip_version(b.match.type_id), b.match.name
            if name is None and wanted is not None:
                if whole != kind:
                    continue
                match_name = wanted
            else:
                if not (kind == whole and (wanted is None or wanted == name)) and not (wanted is not None and kind == f"{whole}#{wanted}"):
                    continue
                match_name = a.match.name
            need = _pull_back_all(steps, b.match)
            if need is None:
                continue
            match = dataclasses.replace(a.match, name=match_name, also=(*a.match.also, *need))
            rules.append(Rule(match, None if b.replace is None else _chain([*steps, *b.replace.steps]), delete_text=a.delete_text or b.delete_text))
            if not need and match_name == a.match.name:
                ended = True
                break
        if not ended:
            rules.append(a if second.passthrough == "keep" else Rule(a.match, None, delete_text=a.delete_text))
    if first.passthrough == "keep":
        rules += plain
    rules += [r for r in second.rules if r.join or r.sql]
    drop = "drop" in (first.passthrough, second.passthrough)
    return Lens(f"{first.id}+{second.id}", first.source, second.target, tuple(rules), "drop" if drop else "keep", first.invertible and second.invertible, parent_steps=(*parent_steps(first), *parent_steps(second)))


class LensGraph:
    """Vocabularies and the lenses between them; the last lens registered for a pair of ends counts."""

    def __init__(self) -> None:
        self.edges: dict[str, dict[str, Lens]] = {}
        self.auto: list[str] = []
        self._paths: dict[tuple[str, str], Lens | None] = {}

    def register(self, lens: Lens, auto_apply: bool = False, both_ways: bool = False) -> None:
        self.edges.setdefault(lens.source, {})[lens.target] = lens
        self._paths.clear()
        if auto_apply and lens.source not in self.auto:
            self.auto.append(lens.source)
        if both_ways:
            try:
                back = inverse(lens)
            except LensError:
                return
            self.edges.setdefault(back.source, {})[back.target] = back

    def find_path(self, source: str, target: str) -> Lens | None:
        """The composed lens with the fewest hops, in order of registration; the identity for equal ends."""
        if source == target:
            return identity(source)
        if (source, target) not in self._paths:
            self._paths[source, target] = self._search(source, target)
        return self._paths[source, target]

    def _search(self, source: str, target: str) -> Lens | None:
        came: dict[str, Lens] = {}
        queue, seen = deque([source]), {source}
        while queue:
            here = queue.popleft()
            for there, lens in self.edges.get(here, {}).items():
                if there in seen:
                    continue
                seen.add(there)
                came[there] = lens
                if there == target:
                    path = []
                    while there != source:
                        path.append(came[there])
                        there = came[there].source
                    whole = path.pop()
                    while path:
                        whole = compose(whole, path.pop())
                    return whole
                queue.append(there)
        return None

    def auto_transform(self, features, target: str):  # noqa: ANN001, ANN201
        """Every registered auto source that reaches the target, each over its own features only."""
        from .compile import apply_lens

        for source in self.auto:
            if source != target and (lens := self.find_path(source, target)) is not None:
                features = apply_lens(features, lens)
        return features
