"""Language ID with hyperdimensional profiles.

Each letter has a random vector of -1 and 1. A trigram's vector binds (multiplies) the vectors of its letters, each
permuted by its place; a document's profile bundles (adds) those of its trigrams; a language's prototype bundles the
unit profiles of its training documents. The prototype of largest cosine wins.

Letters are code points for which str.isalpha holds, lower-cased; everything else is one gap. Letters beyond a fixed
table share its last rows by a hash, which bounds the table.

Fitting takes at most ``max_rows_per_lang`` documents a language (a documented bound), chosen by a hash of the id.

Defined results: null texts and texts without a letter are ``und`` with score 0; texts are scored row by row, so
repeated rows repeat; a null id is never held out, nor learned from; with nothing to learn from all are ``und``; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, distinct, remainder, slices

DIRECT, HASHED = 0x2000, 0x1000
ROWS = DIRECT + HASHED
BLOCK_DOCS, BLOCK_TRIGRAMS = 128, 8192


class Space:
    """The random letter vectors, the same wherever they are made."""

    def __init__(self, dims: int = 512, seed: int = 20_000_003):
        self.dims = dims
        random = np.random.Generator(np.random.PCG64(seed))
        base = (random.integers(0, 2, (ROWS, dims), dtype=np.int8) * 2 - 1).astype(np.int8)
        order = random.permutation(dims)
        self.base, self.orders = base, [np.arange(dims), order, order[order]]
        letter = np.zeros(0x110000, bool)
        # letters of all planes; surrogates never occur in texts
        letter[:] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.letter = letter

    def place(self, rows: np.ndarray, k: int) -> np.ndarray:
        """The vectors of letters at the k-th place before the last: permuted k times."""
        return self.base[rows][:, self.orders[k]]

    def trigrams(self, text: bytes) -> np.ndarray:
        """A code for each trigram of letters and gaps; empty without a letter."""
        points = np.frombuffer(text.decode().lower().encode("utf-32-le"), np.uint32)
        letters = self.letter[points]
        if not letters.any():
            return np.zeros(0, np.int64)
        ids = np.where(points < DIRECT, points, DIRECT + points * np.uint32(2654435761) % np.uint32(HASHED)).astype(np.int64)
        ids[~letters] = 0
        keep = letters.copy()
        keep[1:] |= letters[:-1]  # one gap after each word
        ids = np.concatenate(([0], ids[keep], [0]))
        return (ids[:-2] * ROWS + ids[1:-1]) * ROWS + ids[2:]

    def profiles(self, texts: list[bytes]) -> np.ndarray:
        """(texts, dims) bundles; zero rows for texts without a letter."""
        out = np.zeros((len(texts), self.dims), np.float32)
        for lo in range(0, len(texts), BLOCK_DOCS):
            found = [np.unique(self.trigrams(t), return_counts=True) for t in texts[lo : lo + BLOCK_DOCS]]
            codes = distinct(np.concatenate([c for c, _ in found]))
            for at in range(0, len(codes), BLOCK_TRIGRAMS):
                own = codes[at : at + BLOCK_TRIGRAMS]
                counts = np.zeros((len(found), len(own)), np.float32)
                for i, (c, n) in enumerate(found):
                    inside = slice(*np.searchsorted(c, (own[0], own[-1] + 1)))
                    counts[i, np.searchsorted(own, c[inside])] = n[inside]
                a, b, c = own // (ROWS * ROWS), own // ROWS % ROWS, own % ROWS
                bound = self.place(a, 2) * self.place(b, 1) * self.place(c, 0)
                out[lo : lo + len(found)] += counts @ bound.astype(np.float32)
        return out


_SPACES: dict[int, Space] = {}


def space_of(dims: int) -> Space:
    """One a worker process: making the letter table takes half a second."""
    if dims not in _SPACES:
        _SPACES[dims] = Space(dims)
    return _SPACES[dims]


@dataclass(frozen=True)
class Prototypes:
    langs: tuple[str, ...]
    vectors: np.ndarray  # unit rows
    dims: int


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)


def fit_prototypes(rows: DataFrame, dims: int = 512, max_rows_per_lang: int = 3000) -> Prototypes:
    """rows(doc_id, text, lang): those to learn from. One sum of ``dims`` numbers for every language reaches the driver."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    share = F.floor(F.lit(2.0**32) * F.least(F.lit(1.0), F.lit(float(max_rows_per_lang)) / F.col("count")))
    counts = rows.groupBy("lang").count().select("lang", share.alias("share"))
    place = F.xxhash64("doc_id", F.lit("language sample")).bitwiseAND(F.lit(2**32 - 1))
    chosen = rows.join(F.broadcast(counts), "lang").where(place < F.col("share"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, total = space_of(dims), {}
        for batch in slices(batches):
            langs = np.array(batch.column(1).to_pylist(), object)
            unit = _unit(space.profiles(byte_texts(batch.column(0))))
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + unit[langs == lang].sum(0, dtype=np.float64)
        rows_ = [(lang, i, float(x)) for lang, v in total.items() for i, x in enumerate(v)]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows_], pa.string()), "i": pa.array([r[1] for r in rows_], pa.int32()), "x": pa.array([r[2] for r in rows_], pa.float64())})

    found: dict[str, np.ndarray] = {}
    for r in chosen.select("text", "lang").mapInArrow(sums, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x")).toLocalIterator():
        found.setdefault(r.lang, np.zeros(dims))[r.i] = r.x
    if not found:
        return Prototypes((), np.zeros((0, dims), np.float32), dims)
    langs = tuple(sorted(found))
    return Prototypes(langs, _unit(np.array([found[x] for x in langs])).astype(np.float32), dims)


def predict(docs: DataFrame, model: Prototypes) -> DataFrame:
    """docs with lang_pred and score, rows as they are."""
    schema = docs.select("doc_id", "text").schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        space = space_of(model.dims)
        for batch in slices(batches):
            unit = _unit(space.profiles(byte_texts(batch.column(1))))
            known = np.abs(unit).sum(1) > 0
            if model.langs:
                cos = unit @ model.vectors.T
                best = cos.argmax(1)
                lang = [model.langs[j] if k else "und" for j, k in zip(best, known, strict=True)]
                score = np.where(known, np.clip(cos.max(1), 0, 1), 0).astype(float)
            else:
                lang, score = ["und"] * len(known), np.zeros(len(known))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    assert schema[1].dataType.simpleString() == "string"
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def learnable(docs: DataFrame, mod: int = 5) -> DataFrame:
    return docs.where(remainder(F.col("doc_id"), mod) != 0)


def identify(docs: DataFrame, mod: int = 5, **fit: int) -> DataFrame:
    """Fit on rows whose id isn't held out, predict all."""
    out = predict(docs, fit_prototypes(learnable(docs, mod), **fit))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), mod) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.15, min_bytes: int = 200, **fit: int) -> DataFrame:
    """docs without the rows that have no letter, and without those of at least ``min_bytes`` bytes (shorter texts give
    no sure cosine) whose cosine to every prototype is below ``min_score``. Fits on rows that aren't held out; all
    columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_prototypes(learnable(docs), **fit))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        space = space_of(model.dims)
        for batch in slices(batches):
            texts = byte_texts(batch.column(at))
            unit = _unit(space.profiles(texts))
            found = np.abs(unit).sum(1) > 0
            if model.langs:
                found &= ((unit @ model.vectors.T).max(1) >= min_score) | (np.array([len(t) for t in texts]) < min_bytes)
            yield batch.filter(pa.array(found))

    return docs.mapInArrow(run, docs.schema)
