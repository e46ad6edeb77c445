"""What parsers make and printers read: a tree of blocks with runs of marked text, under common names.

A node is a dict with ``kind``: leaves (paragraph, heading, code-block, horizontal-rule, table, ... or a format's own block
name) have ``runs``; containers are quote and list, whose items are lists of nodes. A run is (text, marks); a mark is
(name, attrs). Features write the same thing flat, as markers in the text and ``parents`` paths."""

from __future__ import annotations

import json
from collections.abc import Callable

FIRST, NEXT = "￼", "\n"
Run = tuple[str, tuple]


def leaf(kind: str, runs: list[Run] | None = None, **attrs: object) -> dict:
    return {"kind": kind, "attrs": attrs, "runs": runs or []}


def quote(children: list[dict]) -> dict:
    return {"kind": "quote", "children": children}


def listing(items: list[list[dict]], ordered: bool = False, start: int = 1) -> dict:
    return {"kind": "list", "ordered": ordered, "start": start, "items": items}


def merge_runs(runs: list[Run]) -> list[Run]:
    out: list[Run] = []
    for text, marks in runs:
        if text and out and out[-1][1] == marks:
            out[-1] = (out[-1][0] + text, marks)
        elif text:
            out.append((text, marks))
    return out


def plain(runs: list[Run]) -> str:
    return "".join(t for t, _ in runs)


def mark(name: str, **attrs: object) -> tuple:
    return (name, json.dumps(attrs, sort_keys=True, ensure_ascii=False))


def attrs_of(m: tuple) -> dict:
    return json.loads(m[1])


def to_features(tree: list[dict], namespace: str, rename: Callable[[str], str]) -> tuple[str, list[dict]]:
    """Text with markers and feature rows (facet_ord, feat_ord, byte_start, byte_end, type_id, name, data)."""
    text: list[str] = []
    size = 0
    rows: list[dict] = []

    def put(s: str) -> tuple[int, int]:
        nonlocal size
        start = size
        size += len(s.encode())
        text.append(s)
        return start, size

    def feature(s: int, e: int, name: str, fields: dict) -> None:
        name = rename(name)
        rows.append({"byte_start": s, "byte_end": e, "type_id": namespace, "name": name, "data": json.dumps({"name": name} | fields, ensure_ascii=False)})

    def block(name: str, parents: list[str], attrs: dict) -> None:
        s, e = put(FIRST if size == 0 else NEXT)
        feature(s, e, name, {"parents": parents} | ({"attrs": attrs} if attrs else {}))

    def inline(runs: list[Run]) -> None:
        open_: list[tuple[tuple, int]] = []
        for s, marks in merge_runs(runs):
            keep = 0
            while keep < len(open_) and keep < len(marks) and open_[keep][0] == marks[keep]:
                keep += 1
            while len(open_) > keep:
                m, start = open_.pop()
                feature(start, size, m[0], attrs_of(m))
            open_ += [(m, size) for m in marks[keep:]]
            put(s)
        while open_:
            m, start = open_.pop()
            feature(start, size, m[0], attrs_of(m))

    def walk(nodes: list[dict], parents: list[str], in_item: bool) -> None:
        for n in nodes:
            if n["kind"] == "quote":
                block("blockquote-marker", parents, {})
                walk(n["children"], [*parents, "blockquote"], False)
            elif n["kind"] == "list":
                tag, item = ("ol", "ordered-list-item") if n["ordered"] else ("ul", "unordered-list-item")
                block("ordered-list-marker" if n["ordered"] else "bullet-list-marker", parents, {"start": n["start"]} if n["ordered"] and n["start"] != 1 else {})
                for children in n["items"]:
                    block("list-item-marker", [*parents, tag], {})
                    walk(children, [*parents, tag, item], True)
            else:
                name = "list-item-text" if in_item and n["kind"] == "paragraph" else n["kind"]
                block(name, n.get("parents", parents), n["attrs"])
                inline(n["runs"])

    walk(tree, [], False)
    rows.sort(key=lambda r: (r["byte_start"], -r["byte_end"]))
    facet, last = -1, None
    feat = 0
    for r in rows:
        if (r["byte_start"], r["byte_end"]) != last:
            facet, feat, last = facet + 1, 0, (r["byte_start"], r["byte_end"])
        r["facet_ord"], r["feat_ord"] = facet, feat
        feat += 1
    return "".join(text), rows


def from_features(text: str, rows: list[dict], restore: Callable[[str], str]) -> list[dict]:
    """The tree again. Blocks are rows with ``parents``; a document without any is one paragraph."""
    raw = text.encode()
    feats = [r | {"fields": json.loads(r["data"] or "{}"), "hub": restore(r["name"] or r["type_id"])} for r in sorted(rows, key=lambda r: (r["byte_start"], -r["byte_end"], r.get("facet_ord", 0), r.get("feat_ord", 0)))]
    blocks = [f for f in feats if "parents" in f["fields"]]
    marks = [f for f in feats if "parents" not in f["fields"] and f["byte_end"] > f["byte_start"]]

    def runs(lo: int, hi: int) -> list[Run]:
        own = [m for m in marks if m["byte_start"] < hi and m["byte_end"] > lo]
        cuts = sorted({lo, hi, *(min(max(x, lo), hi) for m in own for x in (m["byte_start"], m["byte_end"]))})
        out = []
        for s, e in zip(cuts, cuts[1:], strict=False):
            held = tuple((m["hub"], json.dumps({k: v for k, v in m["fields"].items() if k not in ("name", "expandStart", "expandEnd")}, sort_keys=True, ensure_ascii=False)) for m in own if m["byte_start"] <= s and m["byte_end"] >= e)
            out.append((raw[s:e].decode(errors="replace"), held))
        return merge_runs(out)

    if not blocks:
        return [leaf("paragraph", runs(0, len(raw)))] if raw else []
    top: list[dict] = []
    stack: list[tuple[list[str], list[dict] | dict]] = [([], top)]
    for i, b in enumerate(blocks):
        parents = list(b["fields"]["parents"])
        while len(stack) > 1 and stack[-1][0] != parents[: len(stack[-1][0])]:
            stack.pop()
        end = blocks[i + 1]["byte_start"] if i + 1 < len(blocks) else len(raw)
        name, here = b["hub"], stack[-1][1]
        attrs = b["fields"].get("attrs") or {k: v for k, v in b["fields"].items() if k not in ("name", "parents")}
        if name == "list-item-marker":
            while len(stack) > 1 and not (isinstance(stack[-1][1], dict) and stack[-1][0] == parents):
                stack.pop()
            item: list[dict] = []
            if isinstance(stack[-1][1], dict):
                stack[-1][1]["items"].append(item)
            else:
                n = listing([item], bool(parents) and parents[-1].startswith("ol"))
                stack[-1][1].append(n)
            stack.append(([*parents, "ordered-list-item" if parents and parents[-1].startswith("ol") else "unordered-list-item"], item))
            if end > b["byte_end"]:
                item.append(leaf("paragraph", runs(b["byte_end"], end)))
            continue
        while isinstance(here, dict):  # a list takes items only
            stack.pop()
            here = stack[-1][1]
        if name in ("bullet-list-marker", "ordered-list-marker"):
            n = listing([], name.startswith("ordered"), attrs.get("start", 1))
            here.append(n)
            stack.append(([*parents, "ol" if n["ordered"] else "ul"], n))
        elif name == "blockquote-marker":
            n = quote([])
            here.append(n)
            stack.append(([*parents, "blockquote"], n["children"]))
            if end > b["byte_end"]:
                n["children"].append(leaf("paragraph", runs(b["byte_end"], end)))
        else:
            here.append({"kind": "paragraph" if name == "list-item-text" else name, "attrs": attrs, "runs": runs(b["byte_end"], end), "parents": parents})
    return top


