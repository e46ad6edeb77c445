"""Exact removal of repeated byte strings.

Every string of ``size`` bytes that also starts earlier loses its bytes. A string's anchor is the 24-byte piece in it with
the least hash (the leftmost of equals), so equal strings have equal anchors at equal places. Consecutive strings with one
anchor form a context; contexts partition the strings of a document. Then

* two Bloom filters find the anchors that occur twice; only their contexts go further;
* equal contexts are one row with their first occurrence, so groups of copies collapse; later occurrences are removed;
* contexts that share an anchor and differ are compared string by string, in order of first occurrence. Anchors with
  more than ``crowd`` different contexts - large groups of near copies - are dealt over many tasks in parts; what is
  first in its part is compared with the other parts by its strings' hashes.

Contexts are told apart by their anchor's and their own 64-bit hash, strings by 128 bits. A run-compressed
Burrows-Wheeler index is not used; see the README. Only texts that lose bytes are shuffled, to meet their ranges.

Defined results: null texts are empty; texts shorter than ``size`` lose nothing; a null id comes before all others; rows
with equal ids stand at one place, so neither loses what only the other holds; extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, dropped, stored
from .lines import filter_bits, map_with, probably_twice, seen, seen_twice

ANCHOR = 24
PARTS = 16
NULL_ID = -(2**63)
#: Fixed odd multipliers, the same on all machines.
_ODD = np.random.Generator(np.random.PCG64(24_100)).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Two polynomials over values of bytes, modulo 2**64: the factors, their inverses, and a value for each byte.
_FACTORS = [int(x) | 1 for x in _ODD[46:48]]
_VALUES = np.random.Generator(np.random.PCG64(24_200)).integers(0, 2**64, (2, 256), dtype=np.uint64)


@lru_cache
def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def _words(joined: bytes, offset: int, n: int) -> np.ndarray:
    """Eight bytes from each of n places as integers."""
    return np.ndarray((n,), "<u8", joined, offset=offset, strides=(1,))


def _stir(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchor_hashes(joined: bytes) -> np.ndarray:
    n = len(joined) - ANCHOR + 1
    with np.errstate(over="ignore"):
        h = _words(joined, 0, n) * _ODD[0]
        h ^= h >> np.uint64(31)
        h += _words(joined, 8, n) * _ODD[1]
        h ^= h >> np.uint64(33)
        h += _words(joined, 16, n) * _ODD[2]
        return _stir(h)


def least_in_window(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each window of w values, from the least of windows of 1, 2, 4, ... values."""
    m, k = h, 1
    while 2 * k <= w:
        m, k = np.minimum(m[:-k], m[k:]), 2 * k
    return m if k == w else np.minimum(m[: len(h) - w + 1], m[w - k :])


def contexts(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Of some texts: anchor hash, text, first string, strings of each context; the texts joined and their starts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(np.concatenate(([0], lengths)))[:-1] if len(texts) else np.zeros(0, np.int64)
    joined = b"".join(texts)
    empty = np.zeros(0, np.int64)
    if len(joined) < size:
        return np.zeros(0, np.uint64), empty, empty, empty, joined, starts
    h = anchor_hashes(joined)
    least = least_in_window(h, size - ANCHOR + 1)
    ends = starts + lengths
    edge = np.zeros(len(joined) + 1, np.int64)
    lo = np.maximum(starts, ends - size + 1)  # strings that would run over a text's end
    np.add.at(edge, lo, 1)
    np.add.at(edge, ends, -1)
    whole = np.cumsum(edge)[: len(least)] == 0  # strings within one text
    new = np.ones(len(least), bool)
    # the leftmost least piece is another one if the least changes, or if the string before began with it
    new[1:] = (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    stop = np.flatnonzero(np.concatenate(((new | ~whole)[1:], [True])) & whole) + 1
    doc = np.searchsorted(starts, first, side="right") - 1
    return least[first], doc, first - starts[doc], stop - first, joined, starts


def _filter(docs: DataFrame, size: int, max_bits: int) -> np.ndarray:
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = filter_bits(16 * 2 * n_bytes // (size - ANCHOR + 2), max_bits)
    return seen_twice(docs, lambda texts: contexts(texts, size)[0], bits)


def string_hashes(joined: bytes, size: int, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each ``size`` bytes: differences of running sums of values times powers, brought to one power. Goes by
    blocks, which bounds the tables of powers."""
    points, n = np.frombuffer(joined, np.uint8), len(joined) - size + 1
    out = np.zeros((2, n), np.uint64)
    with np.errstate(over="ignore"):
        for row, factor, values in zip(out, _FACTORS, _VALUES, strict=True):
            up, down = _powers(factor, block + size), _powers(pow(factor, -1, 2**64), block)
            for lo in range(0, n, block):
                own = points[lo : lo + block + size - 1]
                sums = np.zeros(len(own) + 1, np.uint64)
                np.cumsum(values[own] * up[: len(own)], out=sums[1:])
                row[lo : lo + block] = (sums[size:] - sums[:-size]) * down[: len(sums) - size]
            _stir(row)
    return out[0], out[1]


def _strings(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts: context, offset and both hashes of each string."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    a, b = string_hashes(b"".join(texts), size)
    count = lengths - size + 1
    which = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = (ends - lengths)[which] + offset
    return which, offset, a[at], b[at]


def compare(anchors: list[int], parts: list[int], docs: list, starts: list[int], texts: list[bytes], size: int) -> tuple[list[tuple], list[tuple]]:
    """(doc_id, start, end) of the removed bytes at the contexts' first occurrences; and, of anchors that come in parts, the
    first of each string of a part: (doc_id, start, end, hash, hash). Contexts come in order of anchor, part and first
    occurrence."""
    which, offset, a, b = _strings(texts, size)
    group = np.cumsum([0, *(x != y for x, y in zip(zip(anchors, parts, strict=True), zip(anchors[1:], parts[1:], strict=False), strict=False))])
    g = group[which]
    with np.errstate(over="ignore"):
        key = a + g.astype(np.uint64) * _ODD[44]
    # only strings whose key comes twice, and few others, are put in order: equal ones of a group together, the earliest first
    ranked, slots = np.sort(key), np.zeros(1 << 20, bool)
    slots[(ranked[1:][ranked[1:] == ranked[:-1]] >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(slots[(key >> np.uint64(44)).astype(np.int64)])
    order = maybe[np.lexsort((b[maybe], key[maybe]))]
    again = np.zeros(len(a), bool)
    again[order[1:]] = (g[order][1:] == g[order][:-1]) & (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    before = np.concatenate(([False], again[:-1] & (which[1:] == which[:-1])))
    after = np.concatenate((again[1:] & (which[1:] == which[:-1]), [False]))
    lo, hi = np.flatnonzero(again & ~before), np.flatnonzero(again & ~after)
    done = [(docs[w], starts[w] + int(x), starts[w] + int(y) + size) for w, x, y in zip(which[lo].tolist(), offset[lo], offset[hi], strict=True)]
    first = np.flatnonzero(~again & (np.array(parts)[which] >= 0))
    strings = [(docs[w], starts[w] + o, starts[w] + o + size, x, y) for w, o, x, y in zip(which[first].tolist(), offset[first].tolist(), a[first].view(np.int64).tolist(), b[first].view(np.int64).tolist(), strict=True)]
    return done, strings


def _digests(texts: list[bytes], size: int, packed: np.ndarray) -> tuple:
    """Of suspected contexts: anchor, digest, text, start, strings, whether its text has held it before, bytes."""
    h, doc, first, count, joined, starts = contexts(texts, size)
    keep = np.flatnonzero(probably_twice(packed, h)) if len(h) else np.zeros(0, np.int64)
    h, doc, first, count = h[keep], doc[keep], first[keep], count[keep]
    pieces = [joined[i : i + n] for i, n in zip((starts[doc] + first).tolist(), (count + size - 1).tolist(), strict=True)] if len(h) else []
    digest = np.array([xxhash.xxh3_64_intdigest(x) for x in pieces], np.uint64)
    with np.errstate(over="ignore"):
        order = np.lexsort((digest, h + doc.astype(np.uint64) * _ODD[45]))  # equal contexts of a text together, in order
    again = np.zeros(len(h), bool)
    again[order[1:]] = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1]) & (digest[order][1:] == digest[order][:-1])
    return h, digest, doc, first, count, again, pieces


def _place_hash(anchor: np.ndarray, digest: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _stir(anchor.view(np.uint64) * _ODD[40] + digest.view(np.uint64) * _ODD[41] + doc_id.astype(np.int64).view(np.uint64) * _ODD[42])


def _anchor_hash(anchor: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _stir(anchor.view(np.uint64) * _ODD[43])


def removed_ranges(docs: DataFrame, size: int = 100, crowd: int = 2048, max_bits: int = 1 << 30) -> DataFrame:
    """(doc_id, ranges), stored: bytes to remove of each document that loses any; ranges may overlap. size: 32 or more."""
    if size < ANCHOR + 8:
        raise ValueError(f"size is {ANCHOR + 8} or more")
    spark = docs.sparkSession
    own = docs.select("doc_id", "text")
    twice = spark.sparkContext.broadcast(_filter(docs, size, max_bits))

    def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple]:
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                batch = whole.slice(lo, rows)
                found = _digests(byte_texts(batch.column(1)), size, twice.value)
                if len(found[0]):
                    yield batch.column(0), *found

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts whose anchor may occur twice; ``again`` marks a context that its own document has held before."""
        for ids, h, digest, doc, first, count, again, _ in slices(batches):
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(h.view(np.int64)), "digest": pa.array(digest.view(np.int64)), "doc_id": ids.take(pa.array(doc)), "start": pa.array(first.astype(np.int32)), "n": pa.array(count.astype(np.int32)), "again": pa.array(again)})

    found = stored(own.mapInArrow(suspects, "anchor long, digest long, doc_id long, start int, n int, again boolean"), "contexts", release=True)
    # the document of each context's first occurrence; null ids come first. Within a document ``again`` has told already
    first = stored(found.where("not again").groupBy("anchor", "digest").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("first_doc"), F.count(F.lit(1)).alias("times")), "first-contexts", release=True)
    copied = first.where("times > 1").select(F.col("anchor").alias("a"), F.col("digest").alias("d"), "first_doc")
    other = found.where("not again").join(copied, (F.col("anchor") == F.col("a")) & (F.col("digest") == F.col("d"))).where(F.coalesce("doc_id", F.lit(NULL_ID)) != F.col("first_doc"))
    end = (F.col("start") + F.col("n") + (size - 1)).cast("int").alias("end")
    later = other.select("doc_id", "start", end).unionByName(found.where("again").select("doc_id", "start", end))

    # anchors with several contexts: their first occurrences are fetched from the texts again, through a Bloom filter; a
    # false hit fetches a later occurrence, whose strings all are repeats, as they should be
    counts = stored(first.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1").select(F.col("anchor").alias("a"), "contexts"), "anchors")
    # both sides are read from files, so adaptive execution can split the anchors of crowds
    several = stored(first.join(counts, F.col("anchor") == F.col("a")).select("anchor", "digest", "first_doc"), "several", release=True)
    wanted = spark.sparkContext.broadcast(seen(several, lambda b: _place_hash(*(b.column(i).to_numpy(zero_copy_only=False) for i in range(3))), filter_bits(16 * several.count(), max_bits)))
    # filters of the anchors with more than crowd, 16 crowd, 256 crowd ... contexts, as far as there are any: each parts a
    # group's contexts 16 times. A false hit parts a smaller group; the result is the same
    most, crowds = counts.agg(F.max("contexts")).first()[0] or 0, []
    while most > crowd * PARTS ** len(crowds):
        own_crowd = counts.where(F.col("contexts") > crowd * PARTS ** len(crowds)).select("a")
        crowds.append(spark.sparkContext.broadcast(seen(own_crowd, lambda b: _anchor_hash(b.column(0).to_numpy(zero_copy_only=False)), filter_bits(16 * own_crowd.count(), max_bits))))

    def part_of(anchor: np.ndarray, digest: np.ndarray) -> np.ndarray:
        """-1, or a context's part of its anchor's crowd."""
        out, in_crowd = np.full(len(anchor), -1, np.int64), np.ones(len(anchor), bool)
        for k, held in enumerate(crowds, 1):
            in_crowd &= probably_twice(held.value, _anchor_hash(anchor))
            out[in_crowd] = (digest[in_crowd] >> np.uint64(32)).astype(np.int64) % PARTS**k
        return out

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, digest, doc, first, _, again, pieces in slices(batches):
            at = ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(probably_twice(wanted.value, _place_hash(h.view(np.int64), digest.view(np.int64), at[doc])) & ~again)
            if len(keep):
                anchor = h[keep].view(np.int64)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor), "part": pa.array(part_of(anchor, digest[keep]).astype(np.int32)), "doc_id": ids.take(pa.array(doc[keep])), "start": pa.array(first[keep].astype(np.int32)), "context": pa.array([pieces[i] for i in keep.tolist()], pa.binary())})

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor, part and first occurrence; groups are compared some thousand contexts at a time. Of
        a crowd's part, the first of each string is given with its hashes, to be compared with the other parts'."""
        held: list[tuple] = []

        def closed(rows: list[tuple]) -> pa.RecordBatch:
            key = np.array([r[:2] for r in rows])
            same = (key[1:] == key[:-1]).all(1)
            many = key[:, 1] >= 0
            many[1:] |= same
            many[:-1] |= same
            rows = [r for r, m in zip(rows, many, strict=True) if m]
            if rows:
                anchor, part, docs, starts, texts = (list(c) for c in zip(*rows, strict=True))
                done, strings = compare(anchor, part, docs, starts, texts, size)
            else:
                done, strings = [], []
            made = [(*x, None, None) for x in done] + strings
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["doc_id", "start", "end", "a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) > 8192 and row[:2] != held[-1][:2]:
                    yield closed(held)
                    held = []
                held.append(row)
        if held:
            yield closed(held)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = own.mapInArrow(fetch, "anchor long, part int, doc_id long, start int, context binary").repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part", "doc_id", "start").mapInArrow(differ, "doc_id long, start int, end int, a long, b long")
    told = stored(told, "told-apart", release=True)
    ranges = later.unionByName(told.where("a is null").select("doc_id", "start", "end"))
    if crowds:
        strings = told.where("a is not null")
        least = strings.groupBy("a", "b").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col("a").alias("x"), F.col("b").alias("y"), "f")
        apart = strings.join(least, (strings["a"] == F.col("x")) & (strings["b"] == F.col("y"))).where(~F.struct("doc_id", "start").eqNullSafe(F.col("f")))
        ranges = ranges.unionByName(apart.select("doc_id", "start", "end"))
    out = stored(ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "removed", release=True)
    dropped(found, first, counts, several, told)
    return out


def cut(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, what stays."""
    spans: list[list[int]] = []
    for lo, hi in sorted(ranges):
        hi = min(hi, len(text))
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        elif lo < hi:
            spans.append([lo, hi])
    parts, at = [], 0
    for lo, hi in spans:
        parts.append(text[at:lo])
        at = hi
    return sum(hi - lo for lo, hi in spans), len(spans), b"".join([*parts, text[at:]])


def repeat_report(docs: DataFrame, size: int = 100) -> DataFrame:
    """Per row of docs(doc_id, text): n_bytes, n_removed, n_spans and a digest of what stays."""
    own = docs.select("doc_id", "text")

    def rows(batch: pa.RecordBatch, ranges: list) -> pa.RecordBatch:
        texts = byte_texts(batch.column(1))
        done = [cut(t, [(x["start"], x["end"]) for x in r or []]) for t, r in zip(texts, ranges, strict=True)]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array([x[0] for x in done], pa.int64()), "n_spans": pa.array([x[1] for x in done], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x[2]).hexdigest() for x in done], pa.string())})

    return map_with(own, removed_ranges(own, size), rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
