"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as bytes, A-Z lower-cased and spaces joined. An item of m bytes is in a document if a region of it is
within e = floor(rate * m) edits of the item. Two bounds leave few regions:

* the item's floor(m / q) disjoint q-grams: an edit spoils at most one, so at least floor(m / q) - e of them occur in the
  region, on diagonals (place in the document less place in the item) at most e apart. Hits are counted in diagonal bands
  of width 2e + 1 at steps of e + 1, which overlap so that some band holds all of a region's hits;
* the q-gram lemma: region and item share at least m - q + 1 - q * e of all overlapping q-grams.

What is left is verified by alignment within the band. The filter loses nothing. Grams that many items share are passed
over as far as the first bound allows, and hits are paired with postings a bounded number at a time, so phrases common
to a whole benchmark cost neither memory nor much time. Items under ``min_item_bytes`` are looked up exactly (no edits), at bounds of words: a
letter, digit or byte beyond ASCII at the item's edge has no other such byte next to it in the document.

The items are broadcast in blocks of at most ``block_bytes``; a larger benchmark goes over the documents block by block.

Defined results: null and empty texts hold no item; null items and items without a word are passed over; items with equal texts are all reported;
a null item_id is reported as -1; rows are judged one by one, so repeated rows repeat; a null id is carried through; extra
columns are ignored (``drop_contaminated`` keeps them); an empty benchmark leaves everything clean.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts

Q = 8
TABLE_BITS = 22
#: Runs of word bytes, or single other bytes but the space.
_TOKEN, _WORD = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff ]"), re.compile(rb"[0-9a-z\x80-\xff]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def grams(text: bytes) -> np.ndarray:
    """Every Q bytes as one integer."""
    n = len(text) - Q + 1
    return np.ndarray((n,), "<u8", text, strides=(1,)).copy() if n > 0 else np.zeros(0, np.uint64)


def _slots(g: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (g * _MIX) >> np.uint64(64 - TABLE_BITS)


def budget(size: int, rate: float) -> int:
    """Edits allowed for an item: both bounds must stay positive. At a tenth that lowers no item of 32 bytes or more."""
    return max(0, min(int(rate * size), (size - Q) // Q, size // Q - 1))


@dataclass
class Index:
    """Items and the postings of their disjoint q-grams."""

    ids: list[int]
    texts: list[bytes]
    edits: np.ndarray
    need: np.ndarray  # hits that a band of each item must have
    gram: np.ndarray  # sorted; posting i is of item[i] at place[i]
    item: np.ndarray
    place: np.ndarray
    first: np.ndarray  # distinct grams
    rank: np.ndarray  # posting i is of gram first[rank[i]]
    table: np.ndarray
    short: dict[bytes, list[int]] = field(default_factory=dict)  # places of the items to look up exactly
    short_sizes: dict[bytes, list[int]] = field(default_factory=dict)  # by first token


def build_index(items: list[tuple[int, bytes]], rate: float, min_item_bytes: int, often: int = 32) -> Index:
    named = sorted((i, t) for i, t in ((i, normal(t)) for i, t in items) if t)
    items = [x for x in named if len(x[1]) >= min_item_bytes]
    exact = [x for x in named if len(x[1]) < min_item_bytes]  # places after those of ``items``
    short: dict[bytes, list[int]] = {}
    for k, (_, text) in enumerate(exact, len(items)):
        short.setdefault(text, []).append(k)
    sizes: dict[bytes, set[int]] = {}
    for text in short:
        sizes.setdefault(_TOKEN.match(text)[0], set()).add(len(text))
    gram, item, place = [], [], []
    for k, (_, text) in enumerate(items):
        g = grams(text)[::Q]
        gram.append(g)
        item.append(np.full(len(g), k))
        place.append(np.arange(len(g)) * Q)
    g, i, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (gram, item, place))
    g, i = g.astype(np.uint64), i.astype(np.int64)
    both = items + exact
    edits = np.array([budget(len(t), rate) for _, t in items] + [0] * len(exact), np.int64)
    need = np.array([len(t) // Q for _, t in both], np.int64) - edits
    g, i, p, need = _without_frequent(g, i, p.astype(np.int64), need, often)
    order = np.lexsort((i, g))
    first, rank = np.unique(g[order], return_inverse=True)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[_slots(first)] = True
    return Index([x for x, _ in both], [t for _, t in both], edits, need, g[order], i[order], p[order], first, rank, table, short, {k: sorted(v) for k, v in sizes.items()})


def _without_frequent(g: np.ndarray, item: np.ndarray, place: np.ndarray, need: np.ndarray, often: int) -> tuple:
    """Leave out postings of grams that more than ``often`` postings have, the most frequent first. Each of an item's
    costs it one of the hits it needs, and two are left to need where it needed more, so no region is lost."""
    _, which, count = np.unique(g, return_inverse=True, return_counts=True)
    times = count[which] if len(g) else np.zeros(0, np.int64)
    order = np.lexsort((-times, item))
    start = np.searchsorted(item[order], np.arange(len(need)))
    turn = np.arange(len(order)) - start[item[order]] if len(order) else np.zeros(0, np.int64)  # its place among its item's
    out = np.zeros(len(g), bool)
    out[order] = (times[order] > often) & (turn < need[item[order]] - 2)
    return g[~out], item[~out], place[~out], need - np.bincount(item[out], minlength=len(need)).astype(np.int64)


def candidates(index: Index, texts: list[bytes], most: int = 1 << 21) -> Iterator[tuple[int, int, int]]:
    """(document, item, lowest diagonal of the band) of bands with hits enough. Hits are paired with postings ``most`` at a
    time or a little more: of some documents, or of one document and some items."""
    starts = np.cumsum([0, *(len(t) + Q for t in texts)])
    joined = b"".join(t + b"\x00" * Q for t in texts)
    g = grams(joined)
    at = np.flatnonzero(index.table[_slots(g)]) if len(g) and len(index.first) else np.zeros(0, np.int64)
    if not len(at):
        return
    k = np.searchsorted(index.first, g[at])
    ok = index.first[np.minimum(k, len(index.first) - 1)] == g[at]
    at, k = at[ok], k[ok]
    doc = np.searchsorted(starts, at, side="right") - 1
    n_items = len(index.ids)
    key = index.rank * n_items + index.item  # ascending
    work = np.cumsum(np.concatenate([[0], np.searchsorted(key, (k + 1) * n_items) - np.searchsorted(key, k * n_items)]))
    lo = 0
    while lo < len(at):
        hi = max(int(np.searchsorted(work, work[lo] + most, side="right")) - 1, lo + 1)
        if hi < len(at):  # whole documents, if more than one
            hi = first if (first := int(np.searchsorted(doc, doc[hi]))) > lo else int(np.searchsorted(doc, doc[lo], side="right"))
        parts = min(n_items, -(-int(work[hi] - work[lo]) // (2 * most)))
        cuts = np.linspace(0, n_items, max(1, parts) + 1).astype(np.int64)
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield from _bands(index, starts, at[lo:hi], k[lo:hi], doc[lo:hi], np.searchsorted(key, k[lo:hi] * n_items + a), np.searchsorted(key, k[lo:hi] * n_items + b))
        lo = hi


def _bands(index: Index, starts: np.ndarray, at: np.ndarray, k: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    n = end - begin
    if not n.sum():
        return []
    post = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at, doc = np.repeat(at, n), np.repeat(doc, n)
    item, place = index.item[post], index.place[post]
    diagonal = at - starts[doc] - place + 2**20  # items are far shorter
    step, need = index.edits[item] + 1, index.need[item]
    band = np.concatenate([diagonal // step, diagonal // step - 1])  # a band spans two steps
    doc, item, need, step = (np.concatenate([x, x]) for x in (doc, item, need, step))
    order = np.lexsort((band, item, doc))
    doc, item, band, need, step = doc[order], item[order], band[order], need[order], step[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1]))))
    count = np.diff(np.append(new, len(doc)))
    good = new[count >= need[new]]
    return [(int(doc[i]), int(item[i]), int(band[i] * step[i] - 2**20)) for i in good]


def shared_grams(a: bytes, b: bytes) -> int:
    x, y = Counter(grams(a).tolist()), Counter(grams(b).tolist())
    return sum(min(n, y[g]) for g, n in x.items() if g in y)


def banded_distance(item: bytes, text: bytes, low: int, width: int, most: int) -> int:
    """Fewest edits from ``item`` to a region of ``text`` on diagonals low..low + width; most + 1 if more."""
    a = np.frombuffer(text, np.uint8)
    cells = np.arange(width + 1)
    big = most + 1
    row = np.where((low + cells >= 0) & (low + cells <= len(a)), 0, big)  # a region may begin anywhere in the band
    padded = np.concatenate([np.zeros(max(0, -low) + 1, np.uint8), a, np.zeros(len(item) + width + 2, np.uint8)])
    shift = max(0, -low) + 1
    for i, c in enumerate(item, 1):
        end = low + i + cells  # place after the last byte used
        use = padded[shift + low + i - 1 : shift + low + i + width]
        valid = (end >= 0) & (end <= len(a))
        new = row + np.where((use == c) & (end >= 1), 0, 1)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where(valid, new, big)
        new = np.minimum.accumulate(new - cells) + cells
        row = np.minimum(np.where(valid, new, big), big)
        if row.min() >= big:
            return big
    return int(row.min())


def short_items(index: Index, text: bytes) -> set[int]:
    """Places of the items under the least size that the normal text holds."""
    out: set[int] = set()
    for m in _TOKEN.finditer(text):
        at = m.start()
        for size in index.short_sizes.get(m[0], ()):
            found = index.short.get(text[at : at + size])
            if found and not (_WORD.match(text, at + size - 1) and _WORD.match(text, at + size)):
                out.update(found)
    return out


def find_items(index: Index, texts: list[bytes]) -> list[dict[int, int]]:
    """For each text the items it holds, by place in the index, with their edits."""
    texts = [normal(t) for t in texts]
    out: list[dict[int, int]] = [{} for _ in texts]
    for doc, k, low in candidates(index, texts):
        item, e = index.texts[k], int(index.edits[k])
        if out[doc].get(k) == 0:
            continue
        lo, hi = max(0, low - e), min(len(texts[doc]), low + 3 * e + 2 + len(item))
        region = texts[doc][lo:hi]
        if item in region:
            out[doc][k] = 0
        elif shared_grams(item, region) >= len(item) - Q + 1 - Q * e:
            d = banded_distance(item, region, low - e - lo, 4 * e + 2, e)
            if d <= e:
                out[doc][k] = min(d, out[doc].get(k, d))
    if index.short:
        for own, text in zip(out, texts, strict=True):
            own.update(dict.fromkeys(short_items(index, text), 0))
    return out


def _blocks(benchmark: DataFrame, rate: float, min_item_bytes: int, block_bytes: int) -> Iterator[Index]:
    rows = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id"), F.lit(-1)).alias("item_id"), F.col("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    for b in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        yield build_index([(r.item_id, r.text.encode()) for r in own.collect()], rate, min_item_bytes)


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, min_item_bytes: int = 32, block_bytes: int = 32 << 20, rows: int = 128) -> DataFrame:
    """Per row of docs(doc_id, text): contaminated, the items held and the fewest edits of any."""
    found = docs.select("doc_id", "text", F.array().cast("array<struct<item_id:long,edits:long>>").alias("found"))
    schema = found.schema
    pair = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64())]))
    for index in _blocks(benchmark, rate, min_item_bytes, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for whole in batches:
                for lo in range(0, whole.num_rows, rows):
                    batch = whole.slice(lo, rows)
                    own = shared.value
                    new = [[*old, *({"item_id": own.ids[k], "edits": d} for k, d in sorted(x.items()))] for old, x in zip(batch.column(2).to_pylist(), find_items(own, byte_texts(batch.column(1))), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pair)], names=["doc_id", "text", "found"])

        found = found.mapInArrow(run, schema)
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.array_sort(F.array_distinct("found.item_id")).alias("item_ids"), F.array_min("found.edits").alias("edits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, min_item_bytes: int = 32, block_bytes: int = 32 << 20, rows: int = 128) -> DataFrame:
    """docs without the rows that hold an item; all columns stay."""
    at = docs.columns.index("text")
    for index in _blocks(benchmark, rate, min_item_bytes, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for whole in batches:
                for lo in range(0, whole.num_rows, rows):
                    batch = whole.slice(lo, rows)
                    yield batch.filter(pa.array([not x for x in find_items(shared.value, byte_texts(batch.column(at)))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
