"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in few bits have a common middle: a value within half of that many bits of both. So every
fingerprint emits all values within half the radius, equal values meet in a shuffle, and pairs that met are verified.

Of 64 bits at radius 4 the half-radius ball has 2,081 values. ``blocks=2`` (the default) first halves the word: of 4
differing bits one 32-bit half holds at most 2, so within that half the middle is at most 1 bit away, and 2 x 33 values
do. The price is verification, since the other half may differ. Where a value of a half is shared by more than
``crowd`` fingerprints - large groups of near copies - pairs are not compared; its members emit their whole
``blocks=1`` ball instead, in which any two that meet are within the radius by construction, so one link each to the
smallest suffices. No link is lost either way.

Equal fingerprints are one node throughout, so groups of exact copies cost one row.

Defined results: null and empty texts have fingerprint zero and link like any other; a null id keeps its row, with the
smallest id reachable or null where there is none; repeated rows repeat; extra columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, dropped, slices, stored, unused
from .components import components


def fingerprint(text: bytes, words_per_shingle: int = 4, seed: int = 42) -> int:
    words = text.lower().split()  # bytes: A-Z and the six spaces only
    if not words:
        return 0
    runs = [words[i:] for i in range(min(words_per_shingle, len(words)))]
    hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in map(b" ".join, zip(*runs, strict=False))], "<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 4096):  # bounds the bit matrix of a long text
        ones += np.unpackbits(hashes[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, words_per_shingle) for t in byte_texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(fps)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of ``bits`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def _emit(fps: DataFrame, masks: np.ndarray, block_bits: int, rows: int) -> DataFrame:
    """(block, value, fp) for each block of each fp and each mask."""
    blocks = 64 // block_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(all_fps), rows):
                fp = all_fps[lo : lo + rows]
                for b in range(blocks):
                    own = (fp.view(np.uint64) >> np.uint64(b * block_bits)) & np.uint64(2**block_bits - 1)
                    values = (own[:, None] ^ masks[None]).ravel().view(np.int64)
                    yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(values), b, np.int32)), "value": pa.array(values), "fp": pa.array(np.repeat(fp, len(masks)))})

    return fps.select("fp").mapInArrow(run, "block int, value long, fp long")


def _links_of_group(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what pairs within the radius connect, at most one a fingerprint: not all pairs."""
    u = fp.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None]) <= radius
    todo, out = np.ones(len(fp), bool), []
    for start in range(len(fp)):
        if not todo[start]:
            continue
        todo[start], stack = False, [start]
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(near[i] & todo):
                todo[j] = False
                out.append((int(fp[i]), int(fp[j])))
                stack.append(int(j))
    return out


def links(fps: DataFrame, radius: int = 4, blocks: int = 2, crowd: int = 256) -> DataFrame:
    """fps(fp), distinct -> (a, b): links whose transitive closure is that of all pairs within the radius."""
    if blocks == 1:
        met = _emit(fps, ball(64, radius // 2), 64, 64).select("value", "fp")
        least = met.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
        pairs = least.where("n = 2").select("a", "b")
        more = stored(least.where("n > 2").select("value", "a"), "middles")
        return pairs.unionByName(met.join(more, "value").where("fp != a").select("a", F.col("fp").alias("b")))
    bits, own = 64 // blocks, radius // blocks
    met = _emit(fps, ball(bits, (own + 1) // 2), bits, 4096)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block and value. A crowd's members are only marked: (fp, null)."""
        held: list[int] = []
        key, crowded = None, False

        def close() -> list:
            if crowded:
                return [(x, None) for x in held]
            if len(held) == 2:
                return [(held[0], held[1])] if ((held[0] ^ held[1]) & (2**64 - 1)).bit_count() <= radius else []
            return _links_of_group(np.array(held, np.int64), radius) if len(held) > 2 else []

        for batch in batches:
            b, v, f = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.flatnonzero((b[1:] != b[:-1]) | (v[1:] != v[:-1])) + 1
            cuts, out = [0, *new.tolist(), len(b)], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                at = (int(b[lo]), int(v[lo]))
                if at != key:
                    if len(held) > 1 or crowded:
                        out += close()
                    held, key, crowded = [], at, False
                if hi - lo == 1 and not held and not crowded and hi < len(b):
                    continue  # alone with its value
                held += f[lo:hi].tolist()
                if len(held) > crowd:
                    crowded = True
                    out += [(x, None) for x in held]
                    held = []
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})
        out = close() if len(held) > 1 or crowded else []
        yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(met.repartition(n, "block", "value").sortWithinPartitions("block", "value").mapInArrow(verify, "a long, b long"), "met")
    crowded = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    return found.where("b is not null").unionByName(links(crowded, radius, 1))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, radius: int = 4, blocks: int = 2) -> DataFrame:
    """Per row of docs(doc_id, text): fingerprint and component_id, the smallest id reachable over links."""
    own = stored(fingerprints(docs, words_per_shingle), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = stored(nodes, "nodes")
    roots = components(links(nodes.select("fp"), radius, blocks))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # equal fingerprints of a hot group meet one row here; adaptive execution may split that side
    final = stored(named.join(ids, "root").select(F.col("fp").alias("node"), "component_id"), "classes")
    dropped(nodes)
    return own.join(final, own["fp"] == final["node"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **how: int) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest id. Rows with a null id or with an id that
    occurs more than once stay as they are where they belong to the group's smallest id."""
    found = near_duplicates(docs, **how)
    key = unused(docs, "stays")
    stay = found.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay[key]), "left_semi")
