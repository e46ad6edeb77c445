"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features: densities of a fixed lexicon and of one learned from the training rows, hits near a second-person word,
capitals, punctuation and obfuscation rates. Trees split on histogram bins and fit the logistic loss by Newton steps;
a held-back fifth of the training rows of each label calibrates their scores.

Training takes at most ``max_rows`` labelled rows (a documented bound), chosen by a hash of the id; only their features
reach the driver. Scoring goes over all rows, whole texts.

Defined results: null and empty texts have no hits and get the score of such rows; a null id is scored, never held out,
never learned from; a document with several labels counts once a label; rows are scored one by one, so repeated rows
repeat; with no labelled rows, or labels of one kind only, every score is that kind's share (0.5 without any); where a
label has fewer than ``fewest`` training rows, no trees are grown and the density of insults in plain or hidden spelling,
calibrated on all training rows, is the score; extra columns are ignored.
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

from .common import byte_texts, dropped, remainder, slices, stored

#: Common insults of four languages, as UTF-8, lower case.
INSULTS = frozenset(
    x.encode()
    for x in (
        "idiot idiots idiotic moron morons stupid dumb fool scum trash garbage loser losers worthless pathetic disgusting "
        "clown imbecile jerk pig vermin filth freak hate shut kill die ugly "
        "dumm dummkopf trottel abschaum müll versager wertlos erbärmlich widerlich dreck hass "
        "imbécile crétin débile ordure nul minable dégoûtant sale haine "
        "estúpido estúpida imbécil basura inútil patético asqueroso odio"
    ).split()
)
#: Second-person words of the same languages.
SECOND_PERSON = frozenset(x.encode() for x in "you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre tú ti tuyo usted ustedes vosotros".split())
#: Characters written for letters.
LEET = bytes.maketrans(b"0134578@$!*", b"oieastbasi*")
_PLAIN = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 or c in b"@$!*'" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
STEM_BYTES = (7, 8)
_ODD = re.compile(rb"[0-9@$!*]")
FEATURES = (
    "words", "lexicon_hits", "lexicon_density", "learned_hits", "learned_weight", "learned_density", "near_second_person", "second_person_density",
    "stem_hits", "stem_density", "stem_weight",
    "capital_words", "capital_letters", "exclamations", "question_marks", "repeated_marks", "symbols", "digits", "obfuscated", "obfuscated_hits", "repeated_letters",
)
_RUN_OF_MARKS, _RUN_OF_LETTERS, _CAPITALS = re.compile(rb"[!?]{2,}"), re.compile(rb"([a-z])\1\1"), re.compile(rb"\b[A-Z]{3,}\b")
_UPPER, _DIGITS, _SYMBOLS = (np.array(list(x), np.uint8) for x in (range(65, 91), range(48, 58), b"#$%&*@^~_<>|"))


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased words without punctuation; characters that stand for letters stay."""
    return text.translate(_PLAIN).split()


def stems(word: bytes) -> list[bytes]:
    """The first bytes of a longer word, so that endings not seen in training still count; marked by ^."""
    return [b"^" + word[:k] for k in STEM_BYTES if len(word) > k]


def features(text: bytes, learned: dict[bytes, float]) -> list[float]:
    words = plain_words(text)
    clean = [w.strip(b"!'") for w in words] if b"!" in text or b"'" in text else words
    n = max(1, len(words))
    hits = [i for i, w in enumerate(clean) if w in INSULTS]
    known = [i for i, w in enumerate(clean) if w in learned]
    odd = [i for i, w in enumerate(clean) if _ODD.search(w) and not w.isdigit()] if _ODD.search(text) else []
    hidden = [i for i in odd if (w := clean[i].translate(LEET)) in INSULTS or w in learned]
    stem = [learned[x] for k in STEM_BYTES for w in clean if len(w) > k and (x := b"^" + w[:k]) in learned]
    second = [i for i, w in enumerate(clean) if w in SECOND_PERSON]
    at = np.array(second)
    near = sum(1 for i in {*hits, *known, *hidden} if len(at) and np.abs(at - i).min() <= 3)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    per = 100.0 / n
    return [
        float(len(words)), float(len(hits)), len(hits) * per, float(len(known)), max((learned[clean[i]] for i in known), default=0.0), len(known) * per, float(near), len(second) * per,
        float(len(stem)), len(stem) * per, max(stem, default=0.0),
        len(_CAPITALS.findall(text)) * per, 100.0 * count[_UPPER].sum() / size, count[33] * per, count[63] * per, len(_RUN_OF_MARKS.findall(text)) * per, 100.0 * count[_SYMBOLS].sum() / size,
        100.0 * count[_DIGITS].sum() / size, len(odd) * per, float(len(hidden)), len(_RUN_OF_LETTERS.findall(text.lower())) * per,
    ]


@dataclass
class Trees:
    """Boosted trees of equal depth: feature and threshold a node (heap order), value a leaf."""

    depth: int = 3
    base: float = 0.0
    nodes: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for (f, t), leaf in zip(self.nodes, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 5.0) -> Trees:
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    # the quantiles of a feature that mostly is zero miss its few values
    edges = [np.unique(np.concatenate([e, [0.0], np.quantile(c[c > 0], np.linspace(0, 1, 9)[:-1]) if (c > 0).any() else []])) for e, c in zip(edges, x.T, strict=True)]
    code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    width = max(len(e) for e in edges) + 1
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(depth, float(np.log(share / (1 - share))))
    f = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            own = at - first
            for node in range(2**level):
                rows = np.flatnonzero(own == node)
                if len(rows) < 20:
                    continue
                best = 1e-6
                for j, e in enumerate(edges):
                    c = code[rows, j]
                    gs = np.cumsum(np.bincount(c, g[rows], width))[: len(e)]
                    hs = np.cumsum(np.bincount(c, h[rows], width))[: len(e)]
                    ga, ha = g[rows].sum(), h[rows].sum()
                    gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                    k = int(gain.argmax()) if len(gain) else 0
                    if len(gain) and gain[k] > best:
                        best, feature[first + node], threshold[first + node] = gain[k], j, e[k]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - (2**depth - 1)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        f += value[leaf]
        model.nodes.append((feature, threshold))
        model.leaves.append(value)
    return model


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators -> points (score, value) to interpolate between, both rising."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, lowest and highest score
    for s, v in zip(score[order], y[order], strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([float(v), 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    xs = [v for b in blocks for v in dict.fromkeys((b[2], b[3]))]
    ys = [b[0] / b[1] for b in blocks for _ in dict.fromkeys((b[2], b[3]))]
    return np.array(xs), np.array(ys)


@dataclass(frozen=True)
class Model:
    learned: dict[bytes, float]
    trees: Trees | None
    points: tuple[np.ndarray, np.ndarray] | None
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.points is None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(insult_density(x) if self.trees is None else self.trees.raw(x), *self.points), 0.0, 1.0)


def insult_density(x: np.ndarray) -> np.ndarray:
    """Hits a hundred words, from rows of FEATURES."""
    at = [FEATURES.index(c) for c in ("lexicon_hits", "learned_hits", "obfuscated_hits")]
    return 100.0 * x[:, at].sum(1) / np.maximum(x[:, FEATURES.index("words")], 1)


def _sampled(docs: DataFrame, labels: DataFrame, mod: int, out: int, max_rows: int) -> DataFrame:
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), mod) != out)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n, place = rows.count(), F.xxhash64("doc_id", F.lit("toxicity sample")).bitwiseAND(F.lit(2**32 - 1))
    if n > max_rows:  # a little more than wanted by the hash, then exactly the first max_rows
        rows = rows.withColumn("place", place).where(F.col("place") < int(2**32 * min(1.0, 1.1 * max_rows / n)))
        rows = rows.orderBy("place", "doc_id", "toxic").limit(max_rows).drop("place")
    # at most max_rows short rows are broadcast, so no text is shuffled
    return stored(docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("doc_id", "text", "toxic"), "labelled")


def _learned_words(rows: DataFrame, least: int, at_most: int) -> dict[bytes, float]:
    """Words that mark label 1, by smoothed log odds of their document counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = [*{*c[0], *c[1]}]
            done = pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "clean": pa.array([c[0][w] for w in words], pa.int64()), "toxic": pa.array([c[1][w] for w in words], pa.int64())})
            c[0].clear(), c[1].clear()
            return done

        for batch in batches:
            for text, y in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                own = {w.strip(b"!'") for w in plain_words(text)}
                c[y == 1].update(own.union(*map(stems, own)))
            if len(c[0]) + len(c[1]) > 400_000:
                yield out()
        yield out()

    found = rows.select("text", "toxic").mapInArrow(count, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))
    top = found.where((F.col("toxic") >= least) & (F.col("toxic") >= 3 * F.col("clean"))).select("word", odds.alias("w"), "toxic").orderBy(F.desc("toxic"), F.desc("w"), "word").limit(at_most)
    return {bytes(r.word): float(r.w) for r in top.collect()}


def fit(docs: DataFrame, labels: DataFrame, mod: int = 3, out: int = 1, max_rows: int = 20_000, max_learned: int = 600, fewest: int = 10) -> Model:
    """Learn from rows of labels(doc_id, toxic) whose crc32(id) mod ``mod`` is not ``out``. A word is learned if three rows
    and 0.3 % of those with label 1 have it."""
    rows = _sampled(docs, labels, mod, out, max_rows)
    # neither words nor trees learn from a fifth of a label's rows, by a hash; the least hash is always in, the largest out
    mark = F.xxhash64("doc_id", F.lit("calibration"))
    ends = rows.groupBy("toxic").agg(F.min_by("doc_id", mark).alias("lo"), F.max_by("doc_id", mark).alias("hi")).collect()  # one row a label
    fold = F.pmod(mark, F.lit(5)) == 0
    for r in ends:
        fold = F.when((F.col("toxic") == r.toxic) & (F.col("doc_id") == r.lo), True).when((F.col("toxic") == r.toxic) & (F.col("doc_id") == r.hi), False).otherwise(fold)
    kept = rows.withColumn("fold", fold)
    bad = kept.where("toxic = 1 and not fold").count()
    learned = _learned_words(kept.where(~F.col("fold")), max(3, round(0.003 * bad)), max_learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "toxic": batch.column(2), "fold": batch.column(3), "x": pa.array([features(t, learned) for t in byte_texts(batch.column(1))], pa.list_(pa.float64()))})

    got = sorted(kept.mapInArrow(run, "doc_id long, toxic int, fold boolean, x array<double>").collect(), key=lambda r: (r.doc_id, r.toxic, r.x))
    dropped(rows)
    y = np.array([r.toxic == 1 for r in got], float)
    if len(y) == 0 or y.min() == y.max():
        return Model(learned, None, None, float(y.mean()) if len(got) else 0.5)
    x = np.array([r.x for r in got])
    if min(y.sum(), len(y) - y.sum()) < fewest:
        return Model(learned, None, fit_isotonic(insult_density(x), y))
    fold = np.array([r.fold for r in got], bool)
    trees = fit_trees(x[~fold], y[~fold])
    return Model(learned, trees, fit_isotonic(trees.raw(x[fold]), y[fold]))


def score_toxicity(docs: DataFrame, model: Model, mod: int = 3, out: int = 1, threshold: float = 0.7) -> DataFrame:
    """Per row of docs(doc_id, text): held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred words and trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            x = np.array([features(t, own.learned) for t in byte_texts(batch.column(1))]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(own.score(x), pa.float64())})

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), mod) == out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
