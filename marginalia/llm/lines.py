"""Line dedup with two Bloom filters.

Every task notes the keys it has seen once and those it has seen twice; merged filters send what two tasks saw once to
the second filter, bit by bit, so a repeated key is never missed. Only keys in the second filter - repeats and few false
hits - are shuffled, as 128-bit digests with their documents, to be counted exactly and to choose the document that
keeps the line. Up to 500,000 repeated keys are broadcast with the document that keeps each, and no text is shuffled.
Beyond that documents that lose a line are shuffled, to meet their lines; a third filter, over their ids, lets all others
pass where they are.

The filters' size follows the number of documents up to ``max_bits`` (128 MB); beyond that more false hits are shuffled,
24 bytes each, and the result stays exact. What is broadcast are the filters, so its size is bounded.

Defined results: a null or empty text is one empty line; rows with a null id count as one document, which never is the
largest; repeated rows of one id count as one document and get the same lines dropped; extra columns, whatever their
names, are ignored by ``line_drops`` and kept by ``dedup_lines``; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .common import SPACES, byte_texts, dropped, slices, stored, unused

SEGMENT_BITS = 1 << 19
HASHES = 4


def line_keys(text: bytes, min_chars: int) -> list[bytes]:
    """Key of each line; None for lines too short to count. bytes.lower() changes A-Z only."""
    out: list = []
    for line in text.split(b"\n"):
        key = line.strip(SPACES).lower()
        out.append(key if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars) else None)
    return out


def bit_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(HASHES, n) places of 64-bit hashes in a filter of ``bits`` (a power of two)."""
    first, step = hashes, (hashes >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(first + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(HASHES)])


def filter_bits(want: int, max_bits: int) -> int:
    return min(max_bits, max(SEGMENT_BITS, 1 << (max(1, want) - 1).bit_length()))


def seen_twice(docs: DataFrame, hashes_of: Callable[[list[bytes]], np.ndarray], bits: int) -> np.ndarray:
    """The second filter over the hashes of all texts, packed. hashes_of: the hashes of some texts, repeats included."""
    return _filters(docs.select("text"), lambda batch: hashes_of(byte_texts(batch.column(0))), bits, "twice")


def seen(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """The first filter over the hashes of all rows, packed."""
    return _filters(rows, hashes_of, bits, "once")


def _filters(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], bits: int, wanted: str) -> np.ndarray:
    parts_wanted = ("once", "twice") if wanted == "twice" else ("once",)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(hashes), return_counts=True)
            hashes.clear()
            pack, segs = zstandard.ZstdCompressor(level=1), {}
            for part, chosen in (("once", keys), ("twice", keys[n > 1])):
                if part not in parts_wanted:
                    continue
                places = np.sort(bit_places(chosen, bits).ravel()).astype(np.int64)
                cuts = np.searchsorted(places, np.arange(0, bits + 1, SEGMENT_BITS))
                for s in np.flatnonzero(np.diff(cuts)):
                    own = np.zeros(SEGMENT_BITS, np.uint8)
                    own[places[cuts[s] : cuts[s + 1]] - s * SEGMENT_BITS] = 1
                    segs.setdefault(int(s), {})[part] = pack.compress(np.packbits(own, bitorder="little").tobytes())
            yield pa.RecordBatch.from_pydict({"seg": pa.array(list(segs), pa.int32()), "once": pa.array([x.get("once") for x in segs.values()], pa.binary()), "twice": pa.array([x.get("twice") for x in segs.values()], pa.binary())})

        held = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                hashes.append(hashes_of(batch.slice(lo, 256)))
                held += len(hashes[-1])
                if held > 4_000_000:
                    yield from flush()
                    held = 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = {}, {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for seg, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seg not in once:
                    once[seg], twice[seg] = (np.zeros(SEGMENT_BITS // 8, np.uint8) for _ in range(2))
                if b is not None:
                    twice[seg] |= np.frombuffer(unpack.decompress(b), np.uint8)
                if a is not None:
                    new = np.frombuffer(unpack.decompress(a), np.uint8)
                    twice[seg] |= once[seg] & new
                    once[seg] |= new
        found = twice if wanted == "twice" else once
        yield pa.RecordBatch.from_pydict({"seg": pa.array(list(found), pa.int32()), "bits": pa.array([x.tobytes() for x in found.values()], pa.binary())})

    parts = rows.mapInArrow(build, "seg int, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    step = SEGMENT_BITS // 8
    for r in parts.repartition("seg").mapInArrow(merge, "seg int, bits binary").toLocalIterator():
        out[r.seg * step : (r.seg + 1) * step] = np.frombuffer(r.bits, np.uint8)
    return out


def probably_twice(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    hit = np.ones(len(hashes), bool)
    for p in bit_places(hashes, 8 * len(packed)):
        hit &= (packed[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


def _key_hashes(texts: list[bytes], min_chars: int) -> np.ndarray:
    """Once a document."""
    return np.array([h for t in texts for h in {xxhash.xxh3_64_intdigest(k) for k in line_keys(t, min_chars) if k is not None}], np.uint64)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _suspects(texts: list[bytes], packed: np.ndarray, min_chars: int) -> tuple[list[bytes], np.ndarray]:
    """Digests of the keys that the filter holds for repeats, once a text, and the place of each one's text."""
    keys, rows = [], []
    for i, text in enumerate(texts):
        own = {k for k in line_keys(text, min_chars) if k is not None}
        keys += own
        rows += [i] * len(own)
    found = np.flatnonzero(probably_twice(packed, np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)))
    return [_digest(keys[i]) for i in found], np.array(rows, np.int64)[found]


def _repeats(docs: DataFrame, min_chars: int, min_docs: int, bits_per_doc: int, max_bits: int) -> tuple[Broadcast, DataFrame, DataFrame]:
    """The filter of repeats; (key, doc_id) of what it holds; (key, last) of the keys in ``min_docs`` documents or more."""
    spark = docs.sparkSession
    bits = filter_bits(docs.count() * bits_per_doc, max_bits)
    twice = spark.sparkContext.broadcast(seen_twice(docs, lambda texts: _key_hashes(texts, min_chars), bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = twice.value
        for batch in slices(batches):
            found, rows = _suspects(byte_texts(batch.column(1)), packed, min_chars)
            yield pa.RecordBatch.from_pydict({"key": pa.array(found, pa.binary()), "doc_id": batch.column(0).take(pa.array(rows))})

    pairs = stored(docs.select("doc_id", "text").mapInArrow(suspects, "key binary, doc_id long"), "line-suspects")
    exact = pairs.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    exact = stored(exact.select("key", "last"), "line-repeats")
    return twice, pairs, exact


def _lost_pairs(pairs: DataFrame, exact: DataFrame, few: int) -> DataFrame:
    # up to ``few`` keys of 24 bytes are sent to the pairs; beyond that both are shuffled, and hot keys split by the planner
    met = pairs.join(F.broadcast(exact) if exact.count() <= few else exact, "key")
    lost = met.where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("last")))
    out = stored(lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "line-drops")
    dropped(pairs, exact)
    return out


def line_drops(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits_per_doc: int = 512, max_bits: int = 1 << 30, few: int = 500_000) -> DataFrame:
    """(doc_id, keys): digests of the keys whose lines the document loses."""
    _, pairs, exact = _repeats(docs, min_chars, min_docs, bits_per_doc, max_bits)
    return _lost_pairs(pairs, exact, few)


def map_lines(docs: DataFrame, rows: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema: str | T.StructType, min_chars: int = 40, min_docs: int = 5, few: int = 500_000) -> DataFrame:
    """rows(batch of docs, the keys each row loses). Up to ``few`` repeated keys are broadcast, with the document that keeps
    each, and every document finds its own where it is; with more, documents that lose a line are shuffled."""
    twice, pairs, exact = _repeats(docs.select("doc_id", "text"), min_chars, min_docs, 512, 1 << 30)
    if exact.count() > few:
        return map_with(docs, _lost_pairs(pairs, exact, few), rows, schema)
    found = exact.toArrow().sort_by("key")
    side = docs.sparkSession.sparkContext.broadcast((np.array(found["key"].to_pylist(), "S16"), found["last"].to_numpy()))
    dropped(pairs, exact)
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, lasts = side.value
        for batch in slices(batches, 512):
            lost: list = [None] * batch.num_rows
            own, at = _suspects(byte_texts(batch.column(text_at)), twice.value, min_chars) if len(digests) else ([], [])
            if own:
                keys = np.array(own, "S16")
                place = np.minimum(np.searchsorted(digests, keys), len(digests) - 1)
                ids = batch.column(id_at).cast(pa.int64())
                null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
                for i in np.flatnonzero((digests[place] == keys) & (null[at] | (ids[at] != lasts[place]))):
                    lost[at[i]] = [*(lost[at[i]] or ()), own[i]]
            yield rows(batch, lost)

    return docs.mapInArrow(run, schema)


def _id_hashes(ids: pa.Array) -> np.ndarray:
    """Of integer ids; nulls have one of their own."""
    h = ids.cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def map_with(docs: DataFrame, side: DataFrame, rows: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema: str | T.StructType, max_bits: int = 1 << 30) -> DataFrame:
    """rows(batch of docs, the batch's values from the side). side(doc_id, value), stored, one row an id; docs without one
    have None. A Bloom filter over the side's ids tells which rows of docs to shuffle; the others are mapped where they
    are."""
    own, at = docs.columns, docs.columns.index("doc_id")
    ids = side.select("doc_id")
    held = docs.sparkSession.sparkContext.broadcast(seen(ids, lambda b: _id_hashes(b.column(0)), filter_bits(16 * ids.count(), max_bits)))
    found = lambda batch: probably_twice(held.value, _id_hashes(batch.column(at)))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches):
            batch = whole.filter(pa.array(~found(whole)))
            if batch.num_rows:
                yield rows(batch, [None] * batch.num_rows)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(found(batch)))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            yield rows(pa.RecordBatch.from_arrays(batch.columns[: len(own)], names=own), batch.column(len(own)).to_pylist())

    key, value = unused(docs, "side_id"), unused(docs, "side_value")
    wanted = docs.mapInArrow(chosen, docs.schema)
    right = side.toDF(key, value)
    joined = wanted.join(right, wanted["doc_id"].eqNullSafe(right[key]), "left").drop(right[key])
    return docs.mapInArrow(alone, schema).unionByName(joined.mapInArrow(met, schema))


def kept_text(text: bytes, keys: list[bytes] | None, min_chars: int) -> tuple[bytes, int, int]:
    """What stays, the lines before, the lines dropped."""
    if not keys:
        return text, text.count(b"\n") + 1, 0
    gone, lines = set(keys), text.split(b"\n")
    stay = [line for line, key in zip(lines, line_keys(text, min_chars), strict=True) if key is None or _digest(key) not in gone]
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


def line_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per row of docs(doc_id, text): n_lines, n_dropped and a digest of what stays."""
    own = docs.select("doc_id", "text")

    def rows(batch: pa.RecordBatch, keys: list) -> pa.RecordBatch:
        done = [kept_text(t, k, min_chars) for t, k in zip(byte_texts(batch.column(1)), keys, strict=True)]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_lines": pa.array([x[1] for x in done], pa.int64()), "n_dropped": pa.array([x[2] for x in done], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x[0]).hexdigest() for x in done], pa.string())})

    return map_lines(own, rows, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", min_chars, min_docs)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``; a null text stays null; other columns stay as they are."""
    names, at = docs.columns, docs.columns.index("text")

    def rows(batch: pa.RecordBatch, keys: list) -> pa.RecordBatch:
        texts = batch.column(at).cast(pa.binary()).to_pylist()
        stay = [t if t is None else kept_text(t, k, min_chars)[0] for t, k in zip(texts, keys, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(stay, pa.binary()).cast(pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return map_lines(docs, rows, docs.schema, min_chars, min_docs)
