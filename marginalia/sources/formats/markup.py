"""Formats of lines and delimiters, each a table: inline delimiters, line prefixes, and how to print them.

One scanner and one block reader serve all: nesting of quotes and lists, fences, headings and rules differ by pattern
only."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from .tree import Run, attrs_of, leaf, listing, mark, merge_runs, plain, quote


@dataclass(frozen=True)
class Syntax:
    """delimiters: (open, close, mark) tried in order; patterns: (regex, maker(match, scan) -> runs) before them."""

    delimiters: tuple[tuple[str, str, str], ...] = ()
    patterns: tuple[tuple[str, Callable], ...] = ()
    escape: str = ""
    nest: bool = True
    heading: str | None = None  # groups: level mark, text
    heading_level: Callable[[str], int] = len
    print_heading: Callable[[int, str], str] | None = None
    bullet: str | None = r"(?P<indent>\s*)[-*+•] +(?P<text>.*)"
    ordered: str | None = r"(?P<indent>\s*)(?P<n>\d+)[.)] +(?P<text>.*)"
    print_bullet: Callable[[int, bool, int], str] = lambda depth, ordered, n: "  " * depth + (f"{n}. " if ordered else "- ")
    quote: str | None = r"> ?(.*)"
    print_quote: str = "> "
    fence: tuple[str, str] | None = (r"```\s*(?P<lang>\S*)\s*", r"```\s*")
    print_fence: tuple[str, str] = ("```{lang}", "```")
    rule: str | None = None
    print_rule: str = "---"
    blank_splits: bool = False  # paragraphs end at blank lines, else at every line
    line_blocks: tuple[tuple[str, Callable], ...] = ()  # regex over a line -> node(s)
    print_block: dict = field(default_factory=dict)  # kind -> fn(node, inline) -> str
    print_mark: dict = field(default_factory=dict)  # mark -> fn(text, attrs) -> str
    word_edges: bool = True  # delimiters open before and close after text, not spaces

    @functools.cached_property
    def compiled(self) -> tuple[list, re.Pattern]:
        """The patterns, and one for the places where an escape, a pattern or a delimiter can begin. Kept in the object: a
        worker gets copies, and the next may lie where one before it lay."""
        unnamed = [re.sub(r"\(\?P<\w+>", "(?:", p) for p, _ in self.patterns]
        starts = [*([re.escape(self.escape)] if self.escape else []), *dict.fromkeys(re.escape(a) for a, _, _ in self.delimiters), *unnamed]
        return [(re.compile(p), f) for p, f in self.patterns], re.compile("|".join(starts) or r"(?!)")


def scan(s: str, x: Syntax, marks: tuple = ()) -> list[Run]:
    out: list[Run] = []
    at, last, line_end = 0, 0, -1
    patterns, starts = x.compiled
    doubled = {a: any(d[0] == a + a for d in x.delimiters) for a, _, _ in x.delimiters}
    while (start := starts.search(s, at)) is not None:
        at = start.start()
        if x.escape and s[at] == x.escape and at + 1 < len(s) and not s[at + 1].isalnum() and not s[at + 1].isspace():
            out += [(s[last:at], marks), (s[at + 1], marks)]
            at = last = at + 2
            continue
        hit = None
        for p, make in patterns:
            if m := p.match(s, at):
                made = make(m, lambda t, more: scan(t, x, (*marks, *more)))
                if made is not None:
                    hit = (m.end(), [(t, ms if ms[: len(marks)] == marks else (*marks, *ms)) for t, ms in made])
                    break
        if hit is None:
            for a, b, name in x.delimiters:
                if not s.startswith(a, at) or (x.word_edges and a[0] in "_~-+^" and at and s[at - 1].isalnum()):
                    continue
                lo = at + len(a)
                if line_end < lo:
                    line_end = end if (end := s.find("\n", lo)) >= 0 else len(s)
                hi = s.find(b, lo + 1, line_end)  # a mark ends in its line
                if len(b) == 2 and b[0] == b[1]:
                    while hi >= 0 and s.startswith(b, hi + 1):  # the last two of three close the outer mark
                        hi += 1
                elif doubled[a]:
                    while hi >= 0 and s.startswith(b + b, hi):  # those of a doubled delimiter close nothing here
                        pair = s.find(b + b, hi + 2)
                        hi = s.find(b, (pair if pair >= 0 else hi) + 2, line_end)
                if hi < 0 or (x.word_edges and (s[lo].isspace() or s[hi - 1].isspace())):
                    continue
                m = (*marks, mark(name))
                hit = (hi + len(b), [(s[lo:hi], m)] if name in ("code", "literal") or not x.nest else scan(s[lo:hi], x, m))
                break
        if hit is None:
            at += 1
            continue
        out.append((s[last:at], marks))
        out += [(t, tuple(y for y in ms if y[0] != "literal")) for t, ms in hit[1]]
        at = last = hit[0]
    return merge_runs([*out, (s[last:], marks)])


@functools.cache
def _whole(pattern: str) -> Callable[[str], re.Match | None]:
    """A line's match of the whole pattern, which is looked up once."""
    return re.compile(pattern).fullmatch


def parse(raw: str, x: Syntax) -> list[dict]:
    return _blocks(raw.replace("\r\n", "\n").split("\n"), x)


def _blocks(lines: list[str], x: Syntax) -> list[dict]:
    out: list[dict] = []
    held: list[str] = []
    i = 0

    def flush() -> None:
        if held:
            out.append(leaf("paragraph", scan("\n".join(held) if x.blank_splits else held[0], x)))
            held.clear()

    while i < len(lines):
        line = lines[i]
        if not line.strip():
            flush()
            i += 1
            continue
        if x.fence and (m := _whole(x.fence[0])(line.strip())):
            flush()
            body = []
            i += 1
            while i < len(lines) and not _whole(x.fence[1])(lines[i].strip()):
                body.append(lines[i])
                i += 1
            i += 1
            lang = m.groupdict().get("lang") or ""
            out.append(leaf("code-block", [("\n".join(body), ())], **({"language": lang} if lang else {})))
            continue
        if x.rule and _whole(x.rule)(line.strip()):
            flush()
            out.append(leaf("horizontal-rule"))
            i += 1
            continue
        special = next(((m, f) for p, f in x.line_blocks if (m := _whole(p)(line))), None)
        if special:
            flush()
            made = special[1](special[0], lambda t: scan(t, x))
            out += made if isinstance(made, list) else [made]
            i += 1
            continue
        if x.heading and (m := _whole(x.heading)(line.strip())):
            flush()
            out.append(leaf("heading", scan(m["text"].strip(), x), level=x.heading_level(m["level"])))
            i += 1
            continue
        if x.quote and (m := _whole(x.quote)(line)):
            flush()
            inner = []
            while i < len(lines) and (m := _whole(x.quote)(lines[i])):
                inner.append(m[1])
                i += 1
            out.append(quote(_blocks(inner, x)))
            continue
        if _item(line, x):
            flush()
            found = []
            while i < len(lines) and (it := _item(lines[i], x)):
                found.append(it)
                i += 1
            out += _lists(found, x)
            continue
        if not x.blank_splits:
            flush()
        held.append(line)
        if not x.blank_splits:
            flush()
        i += 1
    flush()
    return out


def _item(line: str, x: Syntax) -> tuple | None:
    """(depth key, ordered, number, text)"""
    for ordered, p in ((False, x.bullet), (True, x.ordered)):
        if p and (m := _whole(p)(line)):
            g = m.groupdict()
            return (len(g.get("indent") or g.get("stars") or ""), ordered, int(g["n"]) if g.get("n") else 1, m["text"])
    return None


def _lists(items: list[tuple], x: Syntax) -> list[dict]:
    out: list[dict] = []
    i = 0
    while i < len(items):
        depth, ordered, n, _ = items[i]
        node = listing([], ordered, n)
        while i < len(items) and items[i][0] == depth and items[i][1] == ordered:
            item = [leaf("paragraph", scan(items[i][3], x))]
            i += 1
            j = i
            while j < len(items) and items[j][0] > depth:
                j += 1
            item += _lists(items[i:j], x)
            node["items"].append(item)
            i = j
        out.append(node)
        if i < len(items) and items[i][0] < depth:
            depth = items[i][0]
    return out


def inline(runs: list[Run], x: Syntax) -> str:
    """Print runs: marks that stay open from run to run are opened once."""

    def build(part: list[Run], level: int) -> str:
        out, i = [], 0
        while i < len(part):
            text, marks = part[i]
            if len(marks) <= level:
                out.append(text)
                i += 1
                continue
            j = i
            while j < len(part) and len(part[j][1]) > level and part[j][1][level] == marks[level]:
                j += 1
            out.append(_wrap(build(part[i:j], level + 1), marks[level], x))
            i = j
        return "".join(out)

    return build(runs, 0)


def _wrap(s: str, m: tuple, x: Syntax) -> str:
    if m[0] in x.print_mark:
        return x.print_mark[m[0]](s, attrs_of(m))
    for a, b, name in x.delimiters:
        if name == m[0]:
            return f"{a}{s}{b}"
    return s


def render(tree: list[dict], x: Syntax) -> str:
    return ("\n\n" if x.blank_splits else "\n").join(_render(tree, x, 0))


def _render(nodes: list[dict], x: Syntax, depth: int) -> list[str]:
    out = []
    for n in nodes:
        kind = n["kind"]
        if kind == "quote":
            inner = ("\n\n" if x.blank_splits else "\n").join(_render(n["children"], x, 0))
            out.append("\n".join((x.print_quote + line) if line else x.print_quote.rstrip() for line in inner.split("\n")))
        elif kind == "list":
            out.append("\n".join(_list(n, x, depth)))
        elif kind == "code-block":
            lang = n["attrs"].get("language", "")
            a, b = x.print_fence
            body = plain(n["runs"])
            out.append("\n".join(p for p in (a.format(lang=lang), body, b) if p or p is body) if a else body)
        elif kind == "heading" and x.print_heading:
            more = f" {{{n['attrs']['attributes']}}}" if n["attrs"].get("attributes") else ""
            out.append(x.print_heading(int(n["attrs"].get("level", 1)), inline(n["runs"], x)) + more)
        elif kind == "horizontal-rule":
            out.append(x.print_rule)
        elif kind in x.print_block:
            out.append(x.print_block[kind](n, lambda r: inline(r, x)))
        else:
            out.append(inline(n["runs"], x))
    return out


def _list(n: dict, x: Syntax, depth: int) -> list[str]:
    out = []
    for k, item in enumerate(n["items"], n.get("start") or 1):
        first = True
        for child in item:
            if child["kind"] == "list":
                out += _list(child, x, depth + 1)
            else:
                text = "\n".join(_render([child], x, depth))
                out.append(x.print_bullet(depth, n["ordered"], k) + text if first else "  " * (depth + 1) + text)
                first = False
    return out
