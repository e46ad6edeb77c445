"""Formats that are JSON (and OPML's XML): walks from and to the common tree."""

from __future__ import annotations

import json
import re
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

from .markup import scan
from .tree import Run, attrs_of, leaf, listing, mark, merge_runs, plain, quote

#: Spellings of node and mark names that formats use, as the common names.
NODE = {"heading": "heading", "header": "heading", "code_block": "code-block", "codeBlock": "code-block", "code-block": "code-block", "code": "code-block", "horizontal_rule": "horizontal-rule", "horizontalRule": "horizontal-rule", "horizontalrule": "horizontal-rule", "hr": "horizontal-rule", "divider": "horizontal-rule", "thematic-break": "horizontal-rule", "paragraph": "paragraph"}
MARK = {"strong": "bold", "b": "bold", "bold": "bold", "em": "italic", "i": "italic", "italic": "italic", "strike": "strikethrough", "strikethrough": "strikethrough", "strike-through": "strikethrough", "s": "strikethrough", "u": "underline", "underline": "underline", "code": "code", "sup": "superscript", "superscript": "superscript", "sub": "subscript", "subscript": "subscript", "highlight": "highlight"}
LEXICAL_BITS = ((1, "bold"), (2, "italic"), (4, "strikethrough"), (8, "underline"), (16, "code"), (32, "subscript"), (64, "superscript"))
BREAK = ("￼", (mark("line-break"),))


def _load(raw: str) -> object:
    x = json.loads(raw)
    return json.loads(x) if isinstance(x, str) else x


def _level(name: str) -> int:
    words = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}
    m = re.search(r"([1-6])$", name)
    return int(m[1]) if m else words.get(name.rpartition("-")[2], 1)


# -- ProseMirror and Tiptap -------------------------------------------------------------------------------------------


def _pm_runs(nodes: list[dict]) -> list[Run]:
    out = []
    for n in nodes or []:
        marks = tuple(mark("link", **{"href": (m.get("attrs") or {}).get("href", "")}) if m["type"] == "link" else mark(MARK.get(m["type"], m["type"]), **(m.get("attrs") or {})) for m in n.get("marks") or [])
        if n["type"] == "text":
            out.append((n.get("text", ""), marks))
        elif n["type"] in ("hard_break", "hardBreak"):
            out.append(BREAK)
        elif n["type"] == "image":
            out.append(("￼", (*marks, mark("image", **(n.get("attrs") or {})))))
        else:
            out += _pm_runs(n.get("content"))
    return merge_runs(out)


def parse_prosemirror(raw: str) -> list[dict]:
    def walk(nodes: list[dict]) -> list[dict]:
        out = []
        for n in nodes or []:
            t, a, c = n["type"], n.get("attrs") or {}, n.get("content") or []
            if t == "blockquote":
                out.append(quote(walk(c)))
            elif t in ("bullet_list", "bulletList", "ordered_list", "orderedList"):
                out.append(listing([walk(i.get("content")) for i in c], t[0] == "o", a.get("order", a.get("start", 1)) or 1))
            elif t == "table":
                rows = [[plain(_pm_runs(cell.get("content"))) for cell in r.get("content") or []] for r in c]
                out.append(leaf("table", [], headers=rows[0] if rows else [], rows=rows[1:]))
            elif t == "image":
                out.append(leaf("paragraph", _pm_runs([n])))
            else:
                kind = NODE.get(t, t)
                keep = {"level": a.get("level", 1)} if kind == "heading" else {"language": a.get("language", a.get("params"))} if kind == "code-block" and (a.get("language") or a.get("params")) else a if kind not in NODE.values() else {}
                out.append(leaf(kind, _pm_runs(c), **keep))
        return out

    doc = _load(raw)
    return walk(doc.get("content") or [])


def _print_prosemirror(tree: list[dict], camel: bool) -> str:
    pick = lambda snake, other: other if camel else snake
    names = {"strikethrough": "strike"}

    def runs(rs: list[Run]) -> list[dict]:
        out = []
        for text, ms in rs:
            special = next((m for m in ms if m[0] in ("image", "line-break")), None)
            marks = [{"type": "link", "attrs": {"href": attrs_of(m).get("href", "")}} if m[0] == "link" else {"type": names.get(m[0], m[0])} for m in ms if m is not special]
            node = {"type": "text", "text": text} if special is None else {"type": "image", "attrs": attrs_of(special)} if special[0] == "image" else {"type": pick("hard_break", "hardBreak")}
            out.append(node | ({"marks": marks} if marks else {}))
        return out

    def walk(nodes: list[dict]) -> list[dict]:
        out = []
        for n in nodes:
            if n["kind"] == "quote":
                out.append({"type": "blockquote", "content": walk(n["children"])})
            elif n["kind"] == "list":
                kind = pick("ordered_list", "orderedList") if n["ordered"] else pick("bullet_list", "bulletList")
                out.append({"type": kind, **({"attrs": {pick("order", "start"): n["start"]}} if n["ordered"] else {}), "content": [{"type": pick("list_item", "listItem"), "content": walk(i)} for i in n["items"]]})
            else:
                t = {"code-block": pick("code_block", "codeBlock"), "horizontal-rule": pick("horizontal_rule", "horizontalRule")}.get(n["kind"], n["kind"])
                out.append({"type": t, **({"attrs": n["attrs"]} if n["attrs"] else {}), **({"content": runs(n["runs"])} if n["runs"] else {})})
        return out

    return json.dumps({"type": "doc", "content": walk(tree)}, ensure_ascii=False)


def print_prosemirror(tree: list[dict]) -> str:
    return _print_prosemirror(tree, False)


def print_tiptap(tree: list[dict]) -> str:
    return _print_prosemirror(tree, True)


# -- Quill ------------------------------------------------------------------------------------------------------------


def parse_quill(raw: str) -> list[dict]:
    doc = _load(raw)
    ops = doc["ops"] if isinstance(doc, dict) else doc
    lines: list[tuple[list[Run], dict]] = []
    now: list[Run] = []
    for op in ops:
        a, x = op.get("attributes") or {}, op.get("insert")
        marks = tuple(mark("link", href=v) if k == "link" else mark("superscript" if v == "super" else "subscript") if k == "script" else mark(MARK.get(k, k), **({} if v is True else {"value": v})) for k, v in a.items() if v and k not in ("header", "list", "blockquote", "code-block", "indent", "align"))
        if isinstance(x, dict):
            kind, v = next(iter(x.items()))
            now.append((" ", (mark(kind, src=v),)))
            continue
        parts = x.split("\n")
        for i, p in enumerate(parts):
            if p:
                now.append((p, marks))
            if i < len(parts) - 1:
                lines.append((now, a))
                now = []
    if now:
        lines.append((now, {}))
    out: list[dict] = []
    for runs, a in lines:
        p = leaf("paragraph", merge_runs(runs))
        if a.get("header"):
            out.append(leaf("heading", merge_runs(runs), level=a["header"]))
        elif a.get("code-block"):
            if out and out[-1]["kind"] == "code-block":
                out[-1]["runs"] = [(plain(out[-1]["runs"]) + plain(runs) + "\n", ())]
            else:
                out.append(leaf("code-block", [(plain(runs) + "\n", ())]))
        elif a.get("list"):
            ordered = a["list"] == "ordered"
            if out and out[-1]["kind"] == "list" and out[-1]["ordered"] == ordered:
                out[-1]["items"].append([p])
            else:
                out.append(listing([[p]], ordered))
        elif a.get("blockquote"):
            if out and out[-1]["kind"] == "quote":
                out[-1]["children"].append(p)
            else:
                out.append(quote([p]))
        else:
            out.append(p)
    return out


def print_quill(tree: list[dict]) -> str:
    ops: list[dict] = []

    def line(runs: list[Run], attrs: dict) -> None:
        for text, ms in runs:
            a, embed = {}, None
            for m in ms:
                v = attrs_of(m)
                if m[0] in ("image", "video", "formula"):
                    embed = {m[0]: v.get("src", "")}
                elif m[0] in ("superscript", "subscript"):
                    a["script"] = m[0][:-6]
                else:
                    a[{"strikethrough": "strike"}.get(m[0], m[0])] = v.get("href", "") if m[0] == "link" else v.get("value", True)
            ops.append({"insert": embed or text} | ({"attributes": a} if a else {}))
        ops.append({"insert": "\n"} | ({"attributes": attrs} if attrs else {}))

    def walk(nodes: list[dict], attrs: dict) -> None:
        for n in nodes:
            if n["kind"] == "quote":
                walk(n["children"], {"blockquote": True})
            elif n["kind"] == "list":
                for i in n["items"]:
                    walk(i, {"list": "ordered" if n["ordered"] else "bullet"})
            elif n["kind"] == "code-block":
                for s in plain(n["runs"]).removesuffix("\n").split("\n"):
                    line([(s, ())] if s else [], {"code-block": True})
            else:
                line(n["runs"], {"header": n["attrs"].get("level", 1)} if n["kind"] == "heading" else attrs)

    walk(tree, {})
    return json.dumps({"ops": ops}, ensure_ascii=False)


# -- trees of typed nodes: Lexical, Slate, Contentful -----------------------------------------------------------------


def parse_lexical(raw: str) -> list[dict]:
    def runs(nodes: list[dict], more: tuple = ()) -> list[Run]:
        out = []
        for n in nodes or []:
            if n["type"] == "text":
                out.append((n.get("text", ""), (*more, *(mark(name) for bit, name in LEXICAL_BITS if (n.get("format") or 0) & bit))))
            elif n["type"] in ("link", "autolink"):
                out += runs(n.get("children"), (*more, mark("link", href=n.get("url", ""))))
            elif n["type"] == "linebreak":
                out.append(BREAK)
            else:
                out += runs(n.get("children"), more)
        return merge_runs(out)

    def walk(nodes: list[dict]) -> list[dict]:
        out = []
        for n in nodes or []:
            t, c = n["type"], n.get("children") or []
            if t == "quote":
                out.append(quote([leaf("paragraph", runs(c))]))
            elif t == "list":
                items = [[*([leaf("paragraph", runs([k for k in i.get("children") or [] if k["type"] != "list"]))]), *walk([k for k in i.get("children") or [] if k["type"] == "list"])] for i in c]
                out.append(listing(items, n.get("listType") == "number", n.get("start", 1)))
            elif t == "heading":
                out.append(leaf("heading", runs(c), level=_level(n.get("tag", "h1"))))
            elif t in ("youtube", "tweet", "embed"):
                out.append(leaf("embed", [], provider=t, id=n.get("videoID") or n.get("id") or n.get("url", "")))
            else:
                out.append(leaf(NODE.get(t, t), runs(c), **({"language": n["language"]} if n.get("language") else {})))
        return out

    return walk(_load(raw)["root"]["children"])


def print_lexical(tree: list[dict]) -> str:
    def runs(rs: list[Run]) -> list[dict]:
        out = []
        for text, ms in rs:
            names = {m[0] for m in ms}
            node = {"type": "linebreak"} if "line-break" in names else {"type": "text", "text": text, "format": sum(b for b, n in LEXICAL_BITS if n in names)}
            link = next((m for m in ms if m[0] == "link"), None)
            out.append({"type": "link", "url": attrs_of(link).get("href", ""), "children": [node]} if link else node)
        return out

    def walk(nodes: list[dict]) -> list[dict]:
        out = []
        for n in nodes:
            k = n["kind"]
            if k == "quote":
                out += [{"type": "quote", "children": runs(c.get("runs", []))} for c in n["children"]]
            elif k == "list":
                out.append({"type": "list", "listType": "number" if n["ordered"] else "bullet", "start": n["start"], "children": [{"type": "listitem", "children": [x for c in i for x in (walk([c]) if c["kind"] == "list" else runs(c.get("runs", [])))]} for i in n["items"]]})
            elif k == "heading":
                out.append({"type": "heading", "tag": f"h{n['attrs'].get('level', 1)}", "children": runs(n["runs"])})
            else:
                out.append({"type": {"code-block": "code", "horizontal-rule": "horizontalrule"}.get(k, k), **n["attrs"], "children": runs(n["runs"])})
        return out

    return json.dumps({"root": {"type": "root", "children": walk(tree)}}, ensure_ascii=False)


def parse_slate(raw: str) -> list[dict]:
    def runs(nodes: list[dict], more: tuple = ()) -> list[Run]:
        out = []
        for n in nodes or []:
            if "text" in n:
                out.append((n["text"], (*more, *(mark(MARK.get(k, k)) for k, v in n.items() if k != "text" and v is True))))
            elif n.get("type") in ("link", "a"):
                out += runs(n.get("children"), (*more, mark("link", href=n.get("url") or n.get("href") or "")))
            else:
                out += runs(n.get("children"), more)
        return merge_runs(out)

    def walk(nodes: list[dict]) -> list[dict]:
        out = []
        for n in nodes or []:
            t, c = n.get("type", "paragraph"), n.get("children") or []
            if t in ("block-quote", "blockquote", "quote"):
                inner = walk(c) if c and "text" not in c[0] else [leaf("paragraph", runs(c))]
                out.append(quote(inner))
            elif re.fullmatch(r"(bulleted|numbered|unordered|ordered)[-_]list|ul|ol", t):
                out.append(listing([walk(i["children"]) if i.get("children") and "type" in i["children"][0] and i["children"][0]["type"] != "link" else [leaf("paragraph", runs(i.get("children")))] for i in c], t[0] in "no"))
            elif t.startswith("heading") or re.fullmatch(r"h[1-6]", t):
                out.append(leaf("heading", runs(c), level=n.get("level") or _level(t)))
            else:
                out.append(leaf(NODE.get(t, t), runs(c), **({"language": n["language"]} if n.get("language") else {})))
        return out

    doc = _load(raw)
    return walk(doc if isinstance(doc, list) else doc.get("children") or [])


def print_slate(tree: list[dict]) -> str:
    numbers = ("one", "two", "three", "four", "five", "six")

    def runs(rs: list[Run]) -> list[dict]:
        out = []
        for text, ms in rs:
            node = {"text": text} | {m[0]: True for m in ms if m[0] != "link"}
            link = next((m for m in ms if m[0] == "link"), None)
            out.append({"type": "link", "url": attrs_of(link).get("href", ""), "children": [node]} if link else node)
        return out or [{"text": ""}]

    def walk(nodes: list[dict]) -> list[dict]:
        out = []
        for n in nodes:
            k = n["kind"]
            if k == "quote":
                out.append({"type": "block-quote", "children": walk(n["children"])})
            elif k == "list":
                out.append({"type": "numbered-list" if n["ordered"] else "bulleted-list", "children": [{"type": "list-item", "children": walk(i)} for i in n["items"]]})
            else:
                t = f"heading-{numbers[min(6, int(n['attrs'].get('level', 1))) - 1]}" if k == "heading" else {"code-block": "code", "horizontal-rule": "divider"}.get(k, k)
                out.append({"type": t, **({k2: v for k2, v in n["attrs"].items() if k2 != "level"}), "children": runs(n["runs"])})
        return out

    return json.dumps(walk(tree), ensure_ascii=False)


def parse_contentful(raw: str) -> list[dict]:
    def runs(nodes: list[dict], more: tuple = ()) -> list[Run]:
        out = []
        for n in nodes or []:
            if n["nodeType"] == "text":
                out.append((n.get("value", ""), (*more, *(mark(MARK.get(m["type"], m["type"])) for m in n.get("marks") or []))))
            elif n["nodeType"] == "hyperlink":
                out += runs(n.get("content"), (*more, mark("link", href=(n.get("data") or {}).get("uri", ""))))
            else:
                out += runs(n.get("content"), more)
        return merge_runs(out)

    def walk(nodes: list[dict]) -> list[dict]:
        out = []
        for n in nodes or []:
            t, c = n["nodeType"], n.get("content") or []
            if t == "blockquote":
                out.append(quote(walk(c)))
            elif t in ("unordered-list", "ordered-list"):
                out.append(listing([walk(i.get("content")) for i in c], t[0] == "o"))
            elif t.startswith("heading-"):
                out.append(leaf("heading", runs(c), level=_level(t)))
            elif t.startswith("embedded-"):
                out.append(leaf("embed", [], node=t, target=((n.get("data") or {}).get("target") or {}).get("sys", {}).get("id", "")))
            else:
                out.append(leaf(NODE.get(t, t), runs(c)))
        return out

    return walk(_load(raw).get("content") or [])


def print_contentful(tree: list[dict]) -> str:
    def runs(rs: list[Run]) -> list[dict]:
        out = []
        for text, ms in rs:
            node = {"nodeType": "text", "value": text, "marks": [{"type": m[0]} for m in ms if m[0] != "link"], "data": {}}
            link = next((m for m in ms if m[0] == "link"), None)
            out.append({"nodeType": "hyperlink", "data": {"uri": attrs_of(link).get("href", "")}, "content": [node]} if link else node)
        return out

    def walk(nodes: list[dict]) -> list[dict]:
        out = []
        for n in nodes:
            k = n["kind"]
            if k == "quote":
                out.append({"nodeType": "blockquote", "data": {}, "content": walk(n["children"])})
            elif k == "list":
                out.append({"nodeType": "ordered-list" if n["ordered"] else "unordered-list", "data": {}, "content": [{"nodeType": "list-item", "data": {}, "content": walk(i)} for i in n["items"]]})
            else:
                t = f"heading-{n['attrs'].get('level', 1)}" if k == "heading" else {"horizontal-rule": "hr"}.get(k, k)
                out.append({"nodeType": t, "data": {}, "content": runs(n["runs"])})
        return out

    return json.dumps({"nodeType": "document", "data": {}, "content": walk(tree)}, ensure_ascii=False)


# -- flat lists of blocks: Notion, Portable Text, Apple News, Jupyter, Roam --------------------------------------------


def _gather(blocks: list[tuple[str | None, dict]]) -> list[dict]:
    """Neighbouring list items form a list."""
    out: list[dict] = []
    for kind, node in blocks:
        if kind in ("bullet", "number"):
            ordered = kind == "number"
            if out and out[-1]["kind"] == "list" and out[-1]["ordered"] == ordered:
                out[-1]["items"].append([node])
            else:
                out.append(listing([[node]], ordered))
        elif kind == "quote":
            out.append(quote([node]))
        else:
            out.append(node)
    return out


def parse_notion(raw: str) -> list[dict]:
    def runs(rich: list[dict]) -> list[Run]:
        out = []
        for r in rich or []:
            ms = tuple(mark(MARK[k]) for k, v in (r.get("annotations") or {}).items() if v is True and k in MARK)
            href = r.get("href") or (((r.get("text") or {}).get("link")) or {}).get("url")
            out.append((r.get("plain_text") or (r.get("text") or {}).get("content", ""), (*((mark("link", href=href),) if href else ()), *ms)))
        return merge_runs(out)

    doc, found = _load(raw), []
    for b in doc if isinstance(doc, list) else doc.get("results") or doc.get("blocks") or doc.get("children") or []:
        t = b["type"]
        body = b.get(t) or {}
        rs = runs(body.get("rich_text") or body.get("text"))
        if t.startswith("heading_"):
            found.append((None, leaf("heading", rs, level=_level(t))))
        elif t in ("bulleted_list_item", "numbered_list_item"):
            found.append(("bullet" if t[0] == "b" else "number", leaf("paragraph", rs)))
        elif t in ("quote", "callout"):
            found.append(("quote", leaf("paragraph", rs)))
        else:
            found.append((None, leaf(NODE.get(t, t), rs, **({"language": body["language"]} if body.get("language") else {}))))
    return _gather(found)


def _flat(tree: list[dict], kind: str | None = None) -> list[tuple[str | None, dict]]:
    out = []
    for n in tree:
        if n["kind"] == "quote":
            out += _flat(n["children"], "quote")
        elif n["kind"] == "list":
            for i in n["items"]:
                out += _flat(i, "number" if n["ordered"] else "bullet")
        else:
            out.append((kind, n))
    return out


def print_notion(tree: list[dict]) -> str:
    def rich(rs: list[Run]) -> list[dict]:
        out = []
        for text, ms in rs:
            names = {m[0] for m in ms}
            link = next((attrs_of(m).get("href") for m in ms if m[0] == "link"), None)
            out.append({"type": "text", "plain_text": text, "text": {"content": text, "link": {"url": link} if link else None}, "href": link, "annotations": {k: k in names for k in ("bold", "italic", "strikethrough", "underline", "code")}})
        return out

    out = []
    for kind, n in _flat(tree):
        t = {"bullet": "bulleted_list_item", "number": "numbered_list_item", "quote": "quote"}.get(kind or "") or (f"heading_{min(3, int(n['attrs'].get('level', 1)))}" if n["kind"] == "heading" else {"code-block": "code", "horizontal-rule": "divider"}.get(n["kind"], n["kind"]))
        out.append({"object": "block", "type": t, t: {} if t == "divider" else {"rich_text": rich(n["runs"])} | ({"language": n["attrs"]["language"]} if n["attrs"].get("language") else {})})
    return json.dumps(out, ensure_ascii=False)


def parse_sanity(raw: str) -> list[dict]:
    found = []
    for b in _load(raw):
        if b.get("_type") != "block":
            t = b.get("_type", "")
            found.append((None, leaf("code-block", [(b.get("code", ""), ())], **({"language": b["language"]} if b.get("language") else {})) if t == "code" else leaf(NODE.get(t, t))))
            continue
        defs = {d["_key"]: d for d in b.get("markDefs") or []}
        rs = merge_runs([(c.get("text", ""), tuple(mark("link", href=defs[m].get("href", "")) if m in defs else mark(MARK.get(m, m)) for m in c.get("marks") or [])) for c in b.get("children") or []])
        style = b.get("style", "normal")
        node = leaf("heading", rs, level=_level(style)) if re.fullmatch(r"h[1-6]", style) else leaf("paragraph", rs)
        found.append((b.get("listItem") or ("quote" if style == "blockquote" else None), node))
    return _gather(found)


def print_sanity(tree: list[dict]) -> str:
    names = {"bold": "strong", "italic": "em", "strikethrough": "strike-through", "superscript": "sup", "subscript": "sub"}
    out = []
    for i, (kind, n) in enumerate(_flat(tree)):
        if n["kind"] == "code-block":
            out.append({"_type": "code", "_key": f"b{i}", "code": plain(n["runs"]), **n["attrs"]})
            continue
        if n["kind"] == "horizontal-rule":
            out.append({"_type": "hr", "_key": f"b{i}"})
            continue
        defs, children = [], []
        for j, (text, ms) in enumerate(n["runs"]):
            keys = []
            for m in ms:
                if m[0] == "link":
                    defs.append({"_key": f"l{i}_{j}", "_type": "link", "href": attrs_of(m).get("href", "")})
                    keys.append(f"l{i}_{j}")
                else:
                    keys.append(names.get(m[0], m[0]))
            children.append({"_type": "span", "_key": f"s{i}_{j}", "text": text, "marks": keys})
        style = f"h{n['attrs'].get('level', 1)}" if n["kind"] == "heading" else "blockquote" if kind == "quote" else "normal"
        out.append({"_type": "block", "_key": f"b{i}", "style": style, "markDefs": defs, "children": children} | ({"listItem": kind, "level": 1} if kind in ("bullet", "number") else {}))
    return json.dumps(out, ensure_ascii=False)


def parse_applenews(raw: str) -> list[dict]:
    doc, out = _load(raw), []
    for c in doc if isinstance(doc, list) else doc.get("components") or []:
        text, role = c.get("text", ""), c.get("role", "body")
        cuts = {0, len(text)}
        spans = []
        for s in c.get("inlineTextStyles") or []:
            lo, hi = s["rangeStart"], s["rangeStart"] + s["rangeLength"]
            style = s.get("textStyle")
            names = [style] if isinstance(style, str) else [n for n, k in (("bold", "fontWeight"), ("italic", "fontStyle"), ("underline", "underline"), ("strikethrough", "strikethrough")) if (style or {}).get(k)]
            spans += [(lo, hi, mark(MARK.get(n, n))) for n in names]
        spans += [(a["rangeStart"], a["rangeStart"] + a["rangeLength"], mark("link", href=a.get("URL", ""))) for a in c.get("additions") or [] if a.get("type") == "link"]
        for lo, hi, _ in spans:
            cuts |= {lo, min(hi, len(text))}
        edges = sorted(cuts)
        rs = merge_runs([(text[a:b], tuple(m for lo, hi, m in spans if lo <= a and b <= hi)) for a, b in zip(edges, edges[1:], strict=False)])
        m = re.fullmatch(r"heading([1-6])?", role)
        out.append(leaf("heading", rs, level=int(m[1] or 1)) if m else quote([leaf("paragraph", rs)]) if role == "quote" else leaf("paragraph" if role == "body" else role, rs))
    return out


def print_applenews(tree: list[dict]) -> str:
    out = []
    for kind, n in _flat(tree):
        text, styles, links, at = plain(n["runs"]), [], [], 0
        for t, ms in n["runs"]:
            for m in ms:
                span = {"rangeStart": at, "rangeLength": len(t)}
                if m[0] == "link":
                    links.append({"type": "link", **span, "URL": attrs_of(m).get("href", "")})
                else:
                    styles.append({**span, "textStyle": m[0]})
            at += len(t)
        role = "quote" if kind == "quote" else f"heading{n['attrs'].get('level', 1)}" if n["kind"] == "heading" else "body" if n["kind"] == "paragraph" else n["kind"]
        out.append({"role": role, "text": text} | ({"inlineTextStyles": styles} if styles else {}) | ({"additions": links} if links else {}))
    return json.dumps({"components": out}, ensure_ascii=False)


def parse_jupyter(raw: str) -> list[dict]:
    doc = _load(raw)
    meta = doc.get("metadata") or {}
    lang = (meta.get("kernelspec") or {}).get("language") or (meta.get("language_info") or {}).get("name") or "python"
    out = []
    for c in doc.get("cells") or []:
        src = c.get("source", "")
        text = "".join(src) if isinstance(src, list) else src
        out.append(leaf("code", [(text, ())], language=lang) if c.get("cell_type") == "code" else leaf("markdown", [(text, ())]))
    return out


def print_jupyter(tree: list[dict]) -> str:
    cells = [{"cell_type": "code" if n["kind"] in ("code", "code-block") else "markdown", "metadata": {}, "source": plain(n["runs"])} | ({"outputs": [], "execution_count": None} if n["kind"] in ("code", "code-block") else {}) for _, n in _flat(tree)]
    lang = next((n["attrs"]["language"] for _, n in _flat(tree) if n["attrs"].get("language")), "python")
    return json.dumps({"cells": cells, "metadata": {"kernelspec": {"language": lang}}, "nbformat": 4, "nbformat_minor": 5}, ensure_ascii=False)


def parse_roam(raw: str) -> list[dict]:
    from .lines import roam

    out: list[dict] = []

    def walk(b: dict, depth: int) -> None:
        out.append(leaf("block", scan(b.get("string", ""), roam), level=depth, **({"uid": b["uid"]} if b.get("uid") else {})))
        for c in sorted(b.get("children") or [], key=lambda c: c.get("order", 0)):
            walk(c, depth + 1)

    doc = _load(raw)
    for page in doc if isinstance(doc, list) else [doc]:
        if page.get("title") is not None:
            out.append(leaf("page", [(page["title"], ())]))
        for c in sorted(page.get("children") or [], key=lambda c: c.get("order", 0)):
            walk(c, 0)
    return out


def print_roam(tree: list[dict]) -> str:
    from .lines import roam
    from .markup import inline

    pages: list[dict] = []
    stack: list[dict] = []
    for n in tree:
        if n["kind"] == "page":
            pages.append({"title": plain(n["runs"]), "children": []})
            stack = [pages[-1]]
            continue
        if not pages:
            pages.append({"title": "", "children": []})
            stack = [pages[-1]]
        depth = int((n.get("attrs") or {}).get("level", 0))
        del stack[depth + 1 :]
        block = {"string": inline(n.get("runs", []), roam), "children": []} | ({"uid": n["attrs"]["uid"]} if n.get("attrs", {}).get("uid") else {})
        stack[-1]["children"].append(block)
        stack.append(block)
    return json.dumps(pages, ensure_ascii=False)


# -- Bluesky (documents as they are) and OPML -------------------------------------------------------------------------


def parse_opml(raw: str) -> list[dict]:
    out: list[dict] = []

    def walk(e: ElementTree.Element, parents: list[str]) -> None:
        for o in e.findall("outline"):
            text = o.get("text") or o.get("title") or ""
            kind = "feed" if (o.get("type") or "").lower() in ("rss", "atom") or o.get("xmlUrl") else "outline"
            n = leaf(kind, [(text, ())], **{k: v for k, v in o.attrib.items() if k != "text"})
            out.append(n | {"parents": parents})
            walk(o, [*parents, "outline"])

    root = ElementTree.fromstring(raw)
    title = root.findtext("head/title")
    if title:
        out.append(leaf("heading", [(title, ())], level=1))
    body = root.find("body")
    walk(body if body is not None else root, [])
    return out


def print_opml(tree: list[dict]) -> str:
    title, lines, depth = "", [], 0
    for n in tree:
        if n["kind"] == "heading":
            title = plain(n["runs"])
            continue
        d = len(n.get("parents") or [])
        while depth > d:
            lines.append("  " * depth + "</outline>")
            depth -= 1
        a = " ".join(f"{k}={quoteattr(str(v))}" for k, v in {"text": plain(n.get("runs", [])), **n.get("attrs", {})}.items())
        lines.append((d, a))
    out: list[str] = []
    items = [x for x in lines if isinstance(x, tuple)]
    open_ = 0
    for i, (d, a) in enumerate(items):
        while open_ > d:
            open_ -= 1
            out.append("  " * open_ + "</outline>")
        nested = i + 1 < len(items) and items[i + 1][0] > d
        out.append("  " * d + f"<outline {a}" + (">" if nested else "/>"))
        open_ += nested
    while open_:
        open_ -= 1
        out.append("  " * open_ + "</outline>")
    head = f"<head><title>{title}</title></head>" if title else "<head/>"
    return '<?xml version="1.0"?>\n<opml version="2.0">' + head + "<body>\n" + "\n".join(out) + "\n</body></opml>"


