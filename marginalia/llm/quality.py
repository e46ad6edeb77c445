"""Quality rules: distribution divergence.

A document's character-class histogram and its histogram of a language's common words and all others are compared with
references, one for every language of the table, by the Jensen-Shannon distance (base 2, so 0 to 1). The reference of
least sum of both distances counts, of equals the first by name. Histograms of short documents say little, so
each of both tests has a minimum length below which it passes.

Defined results: a null or empty text has no words and fails the base rules; a null id is carried through; rows are
judged one by one, so repeated rows give repeated results; extra columns are ignored; with no row that has a language
there are no references and only the base rules decide.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts

CLASSES = ("lower", "upper", "digit", "space", "sentence", "symbol", "other", "beyond_ascii")
SYMBOLS = b"#*$%&|<>"
TRIM = b".,;:!?\"'()"


def _class_matrix() -> np.ndarray:
    """From a histogram of 256 byte values to CLASSES; continuation bytes belong to none, so code points are counted."""
    m = np.zeros((len(CLASSES), 256), dtype=np.int64)
    for b in range(256):
        c = bytes([b])
        if b >= 0xC0:
            k = "beyond_ascii"
        elif b >= 0x80:
            continue
        elif c.islower():
            k = "lower"
        elif c.isupper():
            k = "upper"
        elif c.isdigit():
            k = "digit"
        elif c.isspace():
            k = "space"
        elif c in TRIM or c == b"-":
            k = "sentence"
        elif b > 32 and b < 127:
            k = "symbol"
        else:
            k = "other"
        m[CLASSES.index(k), b] = 1
    return m


CLASS_OF_BYTE = _class_matrix()


@dataclass(frozen=True)
class References:
    """langs in order; classes: (langs, CLASSES) shares; words: each language's common words, lower case, most frequent
    first; word_shares: (langs, most words + 1) shares of these words, the last column for all other words."""

    langs: tuple[str, ...]
    classes: np.ndarray
    words: tuple[tuple[bytes, ...], ...]
    word_shares: np.ndarray


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of rows of shares."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0)
        b = np.where(q > 0, q * np.log2(q / m), 0.0)
    return np.sqrt(np.clip((a.sum(-1) + b.sum(-1)) / 2, 0.0, 1.0))


def _common_form(word: bytes) -> bytes:
    return word.strip(TRIM).lower()


def fit_references(docs: DataFrame, common: int = 64, flush: int = 300_000, buckets: int = 8) -> References:
    """Statistics over all rows with a language, a reference for each. Tasks add up words before the shuffle and flush a
    full table early; each partition of the sums keeps its ``common`` largest words a language, and so does each of
    ``buckets`` parts of what is left, so that languages x buckets x common rows reach the driver, however many rows and
    partitions there are. A reference takes a few kB."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        held = 0

        def out() -> pa.RecordBatch:
            lang, key, n = [], [], []
            for name, c in words.items():
                forms: Counter = Counter()
                for w, k in c.items():
                    forms[w if w[:1] == b"\x00" else _common_form(w)] += k
                lang += [name] * len(forms)
                key += forms.keys()
                n += forms.values()
            words.clear()
            return pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "word": pa.array(key, pa.binary()), "n": pa.array(n, pa.int64())})

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                if lang is None:
                    continue
                c = words[lang]
                before = len(c)
                c.update(text.split())
                held += len(c) - before
                for name, k in zip(CLASSES, CLASS_OF_BYTE @ np.bincount(np.frombuffer(text, np.uint8), minlength=256), strict=True):
                    c[b"\x00" + name.encode()] += int(k)
                if held > flush:
                    yield out()
                    held = 0
        yield out()

    def largest(batches: Iterator[pa.RecordBatch], add_up: bool = False) -> Iterator[pa.RecordBatch]:
        """Of each language the sums of what stands for no word, and the largest words. add_up: and the sum of all words."""
        best: dict[str, list] = defaultdict(list)
        other: Counter = Counter()

        def cut(name: str) -> None:
            best[name] = sorted(best[name], key=lambda x: (-x[1], x[0]))[:common]

        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if word[:1] == b"\x00":
                    other[lang, word] += n
                elif word:
                    if add_up:
                        other[lang, b"\x00words"] += n
                    best[lang].append((word, n))
                    if len(best[lang]) > 50 * common:
                        cut(lang)
        for name in list(best):
            cut(name)
        rows = [(*k, n) for k, n in other.items()] + [(lang, w, n) for lang, x in best.items() for w, n in x]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "word": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([r[2] for r in rows], pa.int64())})

    schema = "lang string, word binary, n long"
    sums = docs.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = sums.mapInArrow(lambda batches: largest(batches, True), schema).repartition(parts, "lang", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    found: dict[str, Counter] = defaultdict(Counter)
    for r in few.mapInArrow(largest, schema).collect():
        found[r.lang][bytes(r.word)] += r.n
    langs = sorted(found)
    top = [sorted(((w, n) for w, n in found[x].items() if w[:1] != b"\x00"), key=lambda t: (-t[1], t[0]))[:common] for x in langs]
    shares = np.zeros((len(langs), max((len(t) for t in top), default=0) + 1))
    classes = np.zeros((len(langs), len(CLASSES)))
    for i, (x, t) in enumerate(zip(langs, top, strict=True)):
        shares[i, : len(t)] = [n for _, n in t]
        shares[i, -1] = max(0, found[x][b"\x00words"] - sum(n for _, n in t))
        classes[i] = [found[x][b"\x00" + c.encode()] for c in CLASSES]
    norm = lambda a: a / np.maximum(a.sum(1, keepdims=True), 1)
    return References(tuple(langs), norm(classes), tuple(tuple(w for w, _ in t) for t in top), norm(shares))


class WordIds(dict):
    """Integers for words as they come; ``slots`` gets each new word's places among the common words of all languages."""

    def __init__(self, common: dict[bytes, list[int]], slots: list[list[int]]):
        super().__init__()
        self.common, self.slots = common, slots

    def __missing__(self, word: bytes) -> int:
        self.slots.append(self.common.get(_common_form(word), []))
        self[word] = n = len(self)
        return n


def word_histograms(found: list[np.ndarray], slots: list[list[int]], langs: int, width: int) -> np.ndarray:
    """(texts, langs, width) counts of each language's common words, the last for all others. found: word ids a text."""
    sizes = np.array([len(x) for x in slots], np.int64)
    flat = np.array([s for x in slots for s in x], np.int64)
    begin = np.cumsum(sizes) - sizes
    out = np.zeros((len(found), langs, width))
    for i, ids in enumerate(found):
        n = sizes[ids]
        at = np.repeat(begin[ids], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[i] = np.bincount(flat[at], minlength=langs * width).reshape(langs, width)
        out[i, :, -1] = len(ids) - out[i].sum(1)
    return out


def repeated_words(ids: np.ndarray, window: int = 8) -> int:
    """Words in windows of eight that occur twice or more. ids: one integer a distinct word. Hashes of the windows rule
    most texts out; only texts with equal hashes are looked at exactly."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        p, k = 0xBF58476D1CE4E5B9, 1
        while k < window:
            h = h[:-k] * np.uint64(p) + h[k:]
            p, k = p * p % 2**64, 2 * k
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return 0
    r, k = ids.astype(np.int64), 1
    while k < window:  # exact ranks of runs of 2, 4, 8 words
        pair = r[:-k] * (int(r.max()) + 1) + r[k:]
        _, r, counts = np.unique(pair, return_inverse=True, return_counts=True)
        k *= 2
    starts = np.flatnonzero(counts[r] > 1)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def word_limits(refs: References, min_words: int, most: float) -> np.ndarray:
    """Per reference the largest word distance that passes: halfway between what 999 of 1,000 texts of ``min_words`` words
    drawn from the reference stay under and the distance of a text without any common word; ``most`` at most, and where
    texts so short can't be told apart."""
    random, out = np.random.Generator(np.random.PCG64(20_000_003)), np.full(len(refs.langs), most)
    for i, share in enumerate(refs.word_shares):
        if share.sum() > 0:
            none = js_distance(np.eye(len(share))[-1], share)
            clean = np.quantile(js_distance(random.multinomial(min_words, share / share.sum(), 2000) / min_words, share), 0.999)
            if clean < none:
                out[i] = min(most, (clean + none) / 2)
    return out


def score_quality(
    docs: DataFrame, refs: References, min_words: int = 60, min_chars: int = 200, max_class_distance: float = 0.3, max_word_distance: float = 0.5
) -> DataFrame:
    """Per row of docs(doc_id, text): the counts, the distances to the nearest reference and the verdict. The word distance
    is judged by the nearest reference's limit."""
    limits, shared = word_limits(refs, min_words, max_word_distance), docs.sparkSession.sparkContext.broadcast(refs)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, nearest string, kept boolean"
    arrow = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64()), ("nearest", pa.string()), ("kept", pa.bool_())])
    symbols, spaces = np.frombuffer(SYMBOLS, np.uint8), np.frombuffer(b"\t\n\x0b\x0c\r ", np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        width = refs.word_shares.shape[1]
        common: dict[bytes, list[int]] = {}
        for i, words in enumerate(refs.words):
            for j, w in enumerate(words):
                common.setdefault(w, []).append(i * width + j)
        step = max(1, (1 << 21) // max(1, refs.word_shares.size))  # texts whose histograms are held at once
        for batch in (whole.slice(lo, 2048) for whole in batches for lo in range(0, whole.num_rows, 2048)):
            texts = byte_texts(batch.column(1))
            slots: list[list[int]] = []
            seen = WordIds(common, slots)
            out: dict[str, list] = {f.name: [] for f in arrow}
            found: list[np.ndarray] = []
            kinds = np.zeros((len(texts), len(CLASSES)))
            for i, text in enumerate(texts):
                words = text.split()
                ids = np.array([seen[w] for w in words], dtype=np.int64)
                found.append(ids)
                bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
                kinds[i] = CLASS_OF_BYTE @ bytes_of
                lines = [x for x in text.split(b"\n") if x.strip()]
                repeats = repeated_words(ids)
                out["n_words"].append(len(words))
                out["word_chars"].append(int(len(text) - bytes_of[128:192].sum() - bytes_of[spaces].sum()))
                out["n_symbols"].append(int(bytes_of[symbols].sum()))
                out["n_dup_lines"].append(len(lines) - len(set(lines)))
                out["n_repeat_words"].append(repeats)
                out["base_failed"].append(len(words) < 20 or 100 * repeats > 30 * len(words))
            n_words, chars = np.array(out["n_words"]), kinds.sum(1)
            if refs.langs:
                shares = lambda a: a / np.maximum(a.sum(-1, keepdims=True), 1)
                best, k, w = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
                for j in range(0, len(texts), step):
                    own = slice(j, j + step)
                    a = js_distance(shares(kinds[own])[:, None, :], refs.classes[None])
                    b = js_distance(shares(word_histograms(found[own], slots, len(refs.langs), width)), refs.word_shares[None])
                    best[own] = pick = (a + b).argmin(1)
                    rows = np.arange(len(pick))
                    k[own], w[own] = a[rows, pick], b[rows, pick]
                far = ((chars >= min_chars) & (k > max_class_distance)) | ((n_words >= min_words) & (w > limits[best]))
                out["class_distance"], out["word_distance"] = k.tolist(), w.tolist()
                out["nearest"] = [refs.langs[j] for j in best]
            else:
                far = np.zeros(len(texts), bool)
                out["class_distance"] = out["word_distance"] = out["nearest"] = [None] * len(texts)
            out["doc_id"] = batch.column(0)
            out["kept"] = (~np.array(out["base_failed"], bool) & ~far).tolist()
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
