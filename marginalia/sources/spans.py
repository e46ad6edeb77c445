"""Marked spans, the interchange form of collaborative editors: [{type: text, value, marks} | {type: block, value}]."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_spans(spans: list[dict], namespace: str) -> tuple[str, list[dict]]:
    """A mark goes on while the next span has it with the same value. A link's text value is its href; other values than
    true are kept as value."""
    text, rows, open_ = "", [], {}

    def close(keep: dict) -> None:
        for name in [n for n, (v, _) in open_.items() if n not in keep or keep[n] != v]:
            value, start = open_.pop(name)
            extra = {} if value is True else {"attrs": {"href": value} if name == "link" and isinstance(value, str) else {"value": value}}
            rows.append((start, len(text.encode()), name, {"name": name} | extra))

    for s in spans:
        if s["type"] == "block":
            close({})
            b = s.get("value") or {}
            at = len(text.encode())
            text += "￼" if not text else "\n"
            rows.append((at, len(text.encode()), b.get("type", "paragraph"), {"name": b.get("type", "paragraph"), "parents": b.get("parents") or []} | ({"attrs": b["attrs"]} if b.get("attrs") else {})))
            continue
        marks = {k: v for k, v in (s.get("marks") or {}).items() if v is not None and v is not False}
        close(marks)
        for name, value in marks.items():
            open_.setdefault(name, (value, len(text.encode())))
        text += s.get("value", "")
    close({})
    rows.sort(key=lambda r: (r[0], -r[1]))
    return text, [{"facet_ord": i, "feat_ord": 0, "byte_start": s, "byte_end": e, "type_id": namespace, "name": n, "data": json.dumps(d, ensure_ascii=False)} for i, (s, e, n, d) in enumerate(rows)]


def write_spans(text: str, rows: list[dict]) -> list[dict]:
    raw = text.encode()
    feats = [r | {"f": json.loads(r["data"] or "{}")} for r in rows]
    blocks = {r["byte_start"]: r for r in feats if "parents" in r["f"]}
    marks = [r for r in feats if "parents" not in r["f"]]
    cuts = sorted({0, len(raw), *(x for r in feats for x in (r["byte_start"], r["byte_end"])), *(b["byte_end"] for b in blocks.values())})
    out = []
    for s, e in zip(cuts, cuts[1:], strict=False):
        if s in blocks and blocks[s]["byte_end"] == e:
            b = blocks[s]
            out.append({"type": "block", "value": {"type": b["name"], "parents": b["f"]["parents"]} | ({"attrs": b["f"]["attrs"]} if b["f"].get("attrs") else {})})
            continue
        held = {}
        for m in marks:
            if m["byte_start"] <= s and m["byte_end"] >= e:
                a = m["f"].get("attrs") or {}
                held[m["name"]] = a.get("href", a.get("value", True)) if a else True
        out.append({"type": "text", "value": raw[s:e].decode()} | ({"marks": held} if held else {}))
    return out


def from_spans(df: DataFrame, namespace: str, spans: str = "spans") -> tuple[DataFrame, DataFrame]:
    """df(doc_id, spans JSON) -> (docs, features)."""
    from .formats.registry import FEATURE_ARRAY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [read_spans(json.loads(x) if x else [], namespace) for x in batch.column(1).to_pylist()]
            row = pa.struct([(c, pa.int32()) for c in ("facet_ord", "feat_ord", "byte_start", "byte_end")] + [(c, pa.string()) for c in ("type_id", "name", "data")])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": [t for t, _ in done], "fs": pa.array([r for _, r in done], pa.list_(row))})

    parsed = df.select(F.col("doc_id").cast("long").alias("doc_id"), spans).mapInArrow(run, f"doc_id long, text string, fs {FEATURE_ARRAY}")
    return parsed.select("doc_id", "text"), parsed.select("doc_id", F.explode("fs").alias("f")).select("doc_id", "f.*")
