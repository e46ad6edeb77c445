"""Near copies by shingle sets: Jaccard similarity of at least 0.8 of the sets of five-word shingles, verified exactly.

Fingerprints of 64 bits differ by some 10 bits at that similarity, out of reach of a ball. So candidates come from 120
minhashes in 40 bands of 3: a pair of similarity 0.8 shares no band with probability (1 - 0.8^3)^40 = 3e-13, comparable
to the chance of a hash collision over a large corpus. Members of a band are compared by sizes, which is exact, and by
how many of the 120 minhashes agree: fewer than ``AGREE`` have a chance of 3e-11 at similarity 0.8. What is left is verified
on the shingle sets themselves.

Bands of many members don't ship all pairs: a first round links each member along a tree of likely pairs; a second one
takes the shingle sets along and compares, within a band, all plausible pairs the first left in different groups. It
gives links, at most one a member; no link between two groups is passed over. Within a band of k members that are alike
but mostly under the similarity, that is up to k^2 / 2 comparisons in one task.

Equal shingle sets are one node. Texts under five words are one shingle; texts without words have none and one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, distinct, dropped, slices, stored, unused
from .components import components
from .lines import map_with
from .simhash import fingerprint
from .simhash import links as simhash_links

BANDS, ROWS = 40, 3
N = BANDS * ROWS
AGREE, LIKELY = 62, 100
_random = np.random.Generator(np.random.PCG64(20_000_003))
FACTORS = _random.integers(0, 2**31, N, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _random.integers(0, 2**32, N, dtype=np.uint32)
BAND_SEEDS = _random.integers(0, 2**63, BANDS, dtype=np.uint64)


def shingles(text: bytes, words_per_shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = [words[i:] for i in range(min(words_per_shingle, len(words)))]
    return distinct(np.array([xxhash.xxh64_intdigest(s, 5) for s in map(b" ".join, zip(*runs, strict=False))], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def minhashes(hashes: np.ndarray) -> np.ndarray:
    out, x = np.full(N, 2**32 - 1, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(x), 2048):
        np.minimum(out, (FACTORS[:, None] * x[None, lo : lo + 2048] + OFFSETS[:, None]).min(1), out=out)
    return out


def band_values(sigs: np.ndarray) -> np.ndarray:
    """(texts, N) minhashes -> (texts, BANDS); a band's values differ from other bands' but for chance."""
    s, p = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64), np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        v = np.broadcast_to(BAND_SEEDS, s.shape[:2])
        for r in range(ROWS):
            v = (v ^ s[:, :, r]) * p
            v = v ^ (v >> np.uint64(29))
    return v.view(np.int64)


def signatures(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """(doc_id, fp, node, n, key, bands, agree): n shingles; key of the text; agree has the low byte of each minhash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = byte_texts(batch.column(1))
            sets = [shingles(t, words_per_shingle) for t in texts]
            sigs = np.array([minhashes(s) for s in sets], np.uint32)
            bands = band_values(sigs)
            low = (sigs & np.uint32(255)).astype(np.uint8)
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 5) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "fp": pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)),
                    "node": pa.array(nodes),
                    "n": pa.array([len(s) for s in sets], pa.int32()),
                    "key": batch.column(2),
                    "bands": pa.array([v if len(s) else [] for v, s in zip(bands, sets, strict=True)], pa.list_(pa.int64())),
                    "agree": pa.array([x.tobytes() for x in low], pa.binary()),
                }
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(run, "doc_id long, fp long, node long, n int, key long, bands array<long>, agree binary")


def _pairs(members: DataFrame, small: int, least: tuple[int, int]) -> DataFrame:
    """members(value, node, n, agree, root) -> (a, b) to verify: all plausible pairs of bands of at most ``small``
    members, a tree of likely ones in larger bands. Where members have a ``set``: verified links instead, that connect
    what pairs of different roots connect."""
    second = "set" in members.columns

    def plausible(i: int, rest: np.ndarray, n: np.ndarray, sig: np.ndarray, agree: int) -> np.ndarray:
        fits = (n[rest] * least[0] <= n[i] * least[1]) & (n[i] * least[0] <= n[rest] * least[1])
        rest = rest[fits]
        return rest[(sig[rest] == sig[i]).sum(1) >= agree]

    def group(node: np.ndarray, n: np.ndarray, sig: np.ndarray, root: np.ndarray, sets: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = n.astype(np.int64)
        if second:
            root = np.unique(root, return_inverse=True)[1]
            if root.max() == 0:
                return
            own = [np.frombuffer(x, np.uint64) for x in sets]
            for i in range(len(node) - 1):
                rest = np.arange(i + 1, len(node))
                for j in plausible(i, rest[root[rest] != root[i]], n, sig, AGREE):
                    if root[j] == root[i]:
                        continue
                    both, either = jaccard(own[i], own[j])
                    if both * least[1] >= either * least[0]:
                        root[root == root[j]] = root[i]
                        yield node[i : i + 1], node[j : j + 1]
            return
        if len(node) <= small:
            for i in range(len(node) - 1):
                rest = plausible(i, np.arange(i + 1, len(node)), n, sig, AGREE)
                yield np.full(len(rest), node[i]), node[rest]
            return
        todo = np.arange(len(node))
        while len(todo):
            stack, todo = [todo[0]], todo[1:]
            while stack and len(todo):
                i = stack.pop()
                near = plausible(i, todo, n, sig, LIKELY)
                yield np.full(len(near), node[i]), node[near]
                stack += near.tolist()
                todo = np.setdiff1d(todo, near, assume_unique=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by value."""
        held: list[pa.RecordBatch] = []
        key = None

        def close() -> pa.RecordBatch | None:
            t = pa.Table.from_batches(held)
            node, n, root = (t.column(c).to_numpy() for c in ("node", "n", "root"))
            sig = np.frombuffer(b"".join(t.column("agree").to_pylist()), np.uint8).reshape(len(node), N)
            sets = t.column("set").to_pylist() if second else []
            found = list(group(node, n, sig, root, sets)) if len(node) > 1 else []
            a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            if len(a):
                return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})
            return None

        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if key is not None and v[lo] != key and held:
                    if (done := close()) is not None:
                        yield done
                    held = []
                key = v[lo]
                held.append(batch.slice(lo, hi - lo))
        if held and (done := close()) is not None:
            yield done

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("value", "node", "n", "agree", "root", *(["set"] if second else [])).repartition(parts, "value").sortWithinPartitions("value", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, words_per_shingle: int, broadcast_rows: int) -> DataFrame:
    """(node, set) of the nodes wanted."""
    wanted = stored(wanted.distinct().join(nodes.select("node", "key"), "node"), "wanted")
    keyed = docs.select("text", F.xxhash64("text").alias("key"))
    few = wanted.count() <= broadcast_rows  # else texts are shuffled; the result is the same
    texts = keyed.join(F.broadcast(wanted) if few else wanted, "key").groupBy("node").agg(F.first("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "set": pa.array([shingles(t, words_per_shingle).tobytes() for t in byte_texts(batch.column(1))], pa.binary())})

    return stored(texts.mapInArrow(sets, "node long, set binary"), "sets")


def _verified(pairs: DataFrame, own: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Those of pairs(a, b) whose shingle sets reach the similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both, either = jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                keep.append(both * least[1] >= either * least[0])
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(own.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return stored(met.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "similar")


def keep_one(docs: DataFrame, words_per_shingle: int = 5, least: tuple[int, int] = (4, 5), radius: int = 4, small: int = 16, broadcast_rows: int = 500_000) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest id. Near copies are those whose shingle
    sets have a Jaccard similarity of at least ``least`` (a fraction), and, as in simhash.near_duplicates, those whose
    fingerprints differ in at most ``radius`` bits. Null and repeated ids as in simhash.keep_one."""
    own = stored(signatures(docs, words_per_shingle), "signatures")
    nodes = stored(own.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("key").alias("key"), F.first("bands").alias("bands"), F.first("agree").alias("agree")), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("value"))
    met = stored(banded.groupBy("value").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1"), "bands")
    members = banded.join(met.where("k > 2").select("value"), "value").join(nodes.select("node", "n", "agree"), "node")
    members = stored(members.withColumn("root", F.col("node")), "members")
    pairs = stored(met.where("k = 2").select("a", "b").union(_pairs(members, small, least)).distinct(), "pairs")
    how = (nodes, docs, words_per_shingle, broadcast_rows)
    similar = _verified(pairs, _sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), *how), least)

    leads = stored(own.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    same = own.select("fp", "node").distinct().join(leads, "fp").where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    balls = simhash_links(leads.select("fp"), radius)
    balls = balls.join(leads.toDF("a", "x"), "a").join(leads.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    first = stored(similar.union(same).union(balls), "first")
    roots = stored(components(first), "roots")

    large = members.join(met.where(F.col("k") > small).select("value"), "value").drop("root")
    large = stored(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "large")
    # where a band's members are one group already there is nothing to link, and no shingle set to ship
    parted = large.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("value")
    whole, large = large, stored(large.join(parted, "value"), "parted")
    if large.head(1):
        more = _pairs(large.join(_sets(large.select("node"), *how), "node"), small, least)
        roots = stored(components(first.union(more)), "roots")

    named = nodes.select("node", "least").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = stored(named.join(ids, "root").select("node", "component_id"), "classes")
    found = own.select("doc_id", "node").join(final, "node")
    stays = F.bool_or(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    gone = stored(found.groupBy("doc_id").agg(stays.alias("stays")).where("not stays"), "gone")
    dropped(own, nodes, met, members, pairs, leads, first, whole, large, roots, final)
    if gone.count() <= broadcast_rows:  # no text is shuffled, and no second pair of Python workers is started for the join
        key = unused(docs, "gone_id")
        ids = gone.select(F.col("doc_id").alias(key))
        return docs.join(F.broadcast(ids), docs["doc_id"] == ids[key], "left_anti")
    # texts aren't shuffled but for those that go, and the filter's false hits
    return map_with(docs, gone, lambda batch, values: batch.filter(pa.array([x is None for x in values], pa.bool_())), docs.schema)
