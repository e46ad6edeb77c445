"""SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are cut where no piece reaches across: before each run of word marks. Distinct words are grouped by length and a
group's words advance together, one place at a time: hashes of all substrings probe the sorted hashes of the pieces, each
place takes the best piece that ends there by a vectorised maximum, and its length is stored as the backpointer.

What "best" means depends on the model. For a unigram model it is the sum of scores. A BPE model's result is not the
largest sum, so the maximum runs over what byte-pair merging can produce: a piece may follow another only if merging the
two alone gives back the two, and exactly one piece that ends at a place meets this with the one before it. That makes
the backpointers those of the library's own BPE result. Words with two or more marks at once (runs of spaces), whose
merges tie in score, are merged step by step instead.

Characters without a piece become their bytes. What was found for short words is kept, up to a bound: in two halves, of
which the older goes when the newer is full; a word met again moves to the newer one.

Defined results: null and empty texts encode to nothing and decode to the empty text; a null id is carried through; rows
are encoded one by one, so repeated rows repeat; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import distinct

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_BASE = np.uint64(0x100000001B3)
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BPE = 1, 2
FILTER_BITS, PAIR_BITS = 20, 21


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)


def _hash(points: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the rows of code points."""
    h = np.zeros(points.shape[:-1], np.uint64)
    with np.errstate(over="ignore"):
        for i in range(points.shape[-1]):
            h = h * _BASE + points[..., i]
    return h


@dataclass
class Vocabulary:
    """From a SentencePiece model file. keys are the sorted hashes of the pieces, id_of_key their ids."""

    kind: int
    pieces: list[str]
    types: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    dummy_prefix: bool
    keys: np.ndarray
    id_of_key: np.ndarray
    longest: int
    hashes: np.ndarray
    lengths: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def load(cls, model: bytes) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type not in (UNIGRAM, BPE) or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only unigram and BPE models without text normalization")
        pieces = [p.piece for p in proto.pieces]
        types = np.array([p.type for p in proto.pieces])
        if any(MARK in p.lstrip(MARK) for p, t in zip(pieces, types, strict=True) if t == NORMAL):
            raise ValueError("pieces reach across words")
        byte_ids = np.full(256, -1, np.int64)
        for i in np.flatnonzero(types == BYTE):
            byte_ids[int(pieces[i][3:5], 16)] = i
        normal = np.flatnonzero(types == NORMAL)
        hashes = np.zeros(len(pieces), np.uint64)
        hashes[normal] = [_hash(_points(pieces[i])) for i in normal]
        order = np.argsort(hashes[normal])
        keys = hashes[normal][order]
        if (keys[1:] == keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        out = cls(proto.trainer_spec.model_type, pieces, types, np.array([p.score for p in proto.pieces]), byte_ids, int(np.flatnonzero(types == UNKNOWN)[0]), spec.add_dummy_prefix, keys, normal[order], max(len(pieces[i]) for i in normal), hashes, np.array([len(p) for p in pieces]), np.full(len(pieces), -1), np.full(len(pieces), -1))
        if out.kind == BPE:
            out._split_pieces(normal)
        return out

    def _split_pieces(self, normal: np.ndarray) -> None:
        """The last merge of each piece: the two pieces that merging leaves when the piece itself is not to be made."""
        lookup = {self.pieces[i]: int(i) for i in normal}
        score = self.scores.tolist()
        for i in normal:
            if self.lengths[i] > 1:
                two = merge(self.pieces[i], lookup, score, banned=int(i))
                if len(two) == 2 and all(x in lookup for x in two):
                    self.left[i], self.right[i] = lookup[two[0]], lookup[two[1]]

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slots(self.keys)] = True

    @staticmethod
    def _slots(hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash, -1 where there is none. A bit table spares most probes of the sorted keys."""
        out = np.full(hashes.shape, -1, np.int64)
        maybe = np.nonzero(self.filter[self._slots(hashes)])
        own = hashes[maybe]
        k = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[k] == own, self.id_of_key[k], -1)
        return out


def merge(word: str, lookup: dict[str, int], score: list[float], banned: int = -1) -> list[str]:
    """Byte-pair merging as the library does it: the pair of best score first, of equals the leftmost."""
    parts: list[str | None] = list(word)
    before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else len(parts)
        if i >= 0 and j < len(parts) and (k := lookup.get(parts[i] + parts[j])) is not None and k != banned:
            heapq.heappush(heap, (-score[k], i, parts[i] + parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]


class PieceEncoder:
    def __init__(self, vocabulary: Vocabulary, keep: int = 100_000, longest: int = 48, cells: int = 1 << 20):
        self.v, self.keep, self.longest, self.cells = vocabulary, keep, longest, cells
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.lookup = {p: i for i, (p, t) in enumerate(zip(vocabulary.pieces, vocabulary.types, strict=True)) if t == NORMAL}
        self.score = vocabulary.scores.tolist()
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)  # a table of fixed size: pairs asked before, and the answers
        self.pair_ok = np.zeros(1 << PAIR_BITS, bool)
        self.piece_bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() if t == NORMAL else b"" for p, t in zip(vocabulary.pieces, vocabulary.types, strict=True)]

    # -- which piece may follow which, for BPE ------------------------------------------------------------------------

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging piece a then piece b, alone, gives back the two. Undo merges from the later one on and look
        whether the pieces that then touch would have been merged before it."""
        v, n = self.v, len(a)
        a, b, ok, live = a.copy(), b.copy(), np.ones(n, bool), np.ones(n, bool)
        rank = lambda x: np.where(v.left[x] >= 0, -v.scores[x], -1.0)  # noqa: E731  when a piece is made; characters at once
        limit = np.full(n, np.inf)  # a merge of what touches counts if it comes before this
        right_later = np.zeros(n, bool)  # of equal rank the left of two places is merged first
        with np.errstate(over="ignore"):
            power = _BASE ** np.arange(2 * v.longest + 1, dtype=np.uint64)
            while live.any():
                i = np.flatnonzero(live)
                joined = v.hashes[a[i]] * power[v.lengths[b[i]]] + v.hashes[b[i]]
                c = v.find(joined)
                made = np.where(c >= 0, -v.scores[np.maximum(c, 0)], np.inf)
                bad = (made < limit[i]) | ((made == limit[i]) & right_later[i])
                ok[i[bad]], live[i[bad]] = False, False
                i = i[~bad]
                ra, rb = rank(a[i]), rank(b[i])
                done = (ra < 0) & (rb < 0)
                live[i[done]] = False
                i, ra, rb = i[~done], ra[~done], rb[~done]
                undo_left = ra > rb  # of equal rank the right one was made last
                left, right = i[undo_left], i[~undo_left]
                limit[left], right_later[left] = ra[undo_left], False
                a[left] = v.right[a[left]]
                limit[right], right_later[right] = rb[~undo_left], True
                b[right] = v.left[b[right]]
        return ok

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same with a memory of pairs. Start of word (-1) and characters without a piece (-2) go with everything."""
        out = (a < 0) | (b < 0)
        rows = np.flatnonzero(~out)
        if not len(rows):
            return out
        codes = a[rows] * len(self.v.pieces) + b[rows]
        slots = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)
        new = distinct(codes[self.pairs[slots] != codes])
        answers = self._compatible(new // len(self.v.pieces), new % len(self.v.pieces)) if len(new) else np.zeros(0, bool)
        out[rows] = self.pair_ok[slots]
        if len(new):
            missing = self.pairs[slots] != codes
            out[rows[missing]] = answers[np.searchsorted(new, codes[missing])]
            at = (new.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)
            self.pairs[at] = new  # a later pair takes the place of an earlier one
            last = self.pairs[at] == new
            self.pair_ok[at[last]] = answers[last]
        return out

    # -- the batched Viterbi ------------------------------------------------------------------------------------------

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of one length -> (ids, first): row i holds word i's ids from place first[i] on; -2 stands for a
        character without a piece."""
        v, n, size = self.v, len(words), len(words[0])
        points = _points("".join(words)).reshape(n, size)
        most = min(v.longest, size)
        best = np.zeros((n, size + 1))
        last = np.full((n, size + 1), -1, np.int64)  # the piece that ends at a place
        back = np.zeros((n, size + 1), np.int64)  # and its length
        window = np.zeros((n, 0), np.uint64)  # hashes of the substrings that end at the place before, by length
        low = float(v.scores[v.types == NORMAL].min()) - 10
        rows = np.arange(n)
        for end in range(1, size + 1):
            with np.errstate(over="ignore"):
                point = points[:, end - 1 : end]
                # substring of length k + 1 ending here = that of length k ending one before, times the base, plus the character
                window = np.concatenate([point, window[:, : most - 1] * _BASE + point], 1)
            ids = v.find(window)
            ids[ids[:, 0] < 0, 0] = -2
            r, c = np.nonzero(ids != -1)
            found, start = ids[r, c], end - 1 - c
            if v.kind == BPE:
                fits = self._may_follow(last[r, start], found)  # of each row's, exactly one
                back[r[fits], end] = c[fits] + 1
            else:
                score = np.full(ids.shape, -np.inf)
                score[r, c] = best[r, start] + np.where(found >= 0, v.scores[np.maximum(found, 0)], low)
                pick = score.shape[1] - 1 - score[:, ::-1].argmax(1)  # of equal sums the longest last piece, as the library
                best[:, end], back[:, end] = score[rows, pick], pick + 1
            last[:, end] = ids[rows, back[:, end] - 1]
        out = np.zeros((n, size), np.int32)
        at, first = np.full(n, size), np.full(n, size)
        live = rows
        while len(live):
            first[live] -= 1
            out[live, first[live]] = last[live, at[live]]
            at[live] -= back[live, at[live]]
            live = live[at[live] > 0]
        return out, first

    def _with_bytes(self, word: str, ids: list[int]) -> bytes:
        v, full, at = self.v, [], 0
        for i in ids:
            if i == -2:
                own = v.byte_ids[list(word[at].encode())].tolist()
                full += own if min(own) >= 0 else [v.unknown]
                at += 1
            else:
                full.append(i)
                at += len(v.pieces[i])
        return np.array(full, "<u4").tobytes()

    def _new_words(self, words: list[str]) -> dict[str, bytes]:
        out, by_length = {}, {}
        for w in words:
            if self.v.kind == BPE and w.startswith(MARK * 2):
                out[w] = self._with_bytes(w, [self.lookup.get(p, -2) for p in merge(w, self.lookup, self.score)])
            else:
                by_length.setdefault(len(w), []).append(w)
        for size, own in by_length.items():
            step = max(1, self.cells // (size * min(size, self.v.longest) + 1))
            for lo in range(0, len(own), step):
                some = own[lo : lo + step]
                ids, first = self.viterbi(some)
                flat = ids.astype("<u4").tobytes()
                for i, (w, f, odd) in enumerate(zip(some, first.tolist(), (ids == -2).any(1).tolist(), strict=True)):
                    out[w] = self._with_bytes(w, ids[i, f:].tolist()) if odd else flat[4 * (i * size + f) : 4 * (i + 1) * size]
        return out

    def encode(self, texts: list[str | None], rows: int = 256) -> Iterator[bytes]:
        """The ids of each text as little-endian u32."""
        for lo in range(0, len(texts), rows):
            cut = [_WORD.findall((MARK if self.v.dummy_prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts[lo : lo + rows]]
            new = set().union(*cut).difference(self.known)
            if len(self.known) + len(new) > self.keep // 2:
                self.before, self.known = self.known, {}
                new = set().union(*cut)
            again = new & self.before.keys()
            self.known |= {w: self.before[w] for w in again}
            self.known |= self._new_words(sorted(new - again))
            get = self.known.__getitem__
            for words in cut:
                yield b"".join(map(get, words))
            for w in new:
                if len(w) > self.longest:
                    del self.known[w]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text; the mark before the first word goes."""
        out = b"".join([self.piece_bytes[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return out[1:] if self.v.dummy_prefix and out[:1] == b" " else out


def encoder_of(vocabulary: Vocabulary) -> PieceEncoder:
    """One for a vocabulary in a worker process: what it has learned serves the process's next tasks."""
    if not hasattr(vocabulary, "encoder"):
        vocabulary.encoder = PieceEncoder(vocabulary)
    return vocabulary.encoder


def _vocabulary(spark: SparkSession, path: str) -> object:
    """Loaded once, on the driver; a few MB for any model of this kind."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Vocabulary.load(f.read()))


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """Per row of docs(doc_id, text): n_tokens and ids."""
    shared = _vocabulary(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):  # ids take more room than texts
                batch = whole.slice(lo, 256)
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in encoder.encode(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """encoded(doc_id, ids) -> (doc_id, text)."""
    shared = _vocabulary(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            texts = [encoder.decode(np.array(x or [], "<u4").tobytes()).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode: n_tokens, a checksum of the ids, digest of the decoded text and whether it is the text."""
    shared = _vocabulary(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in (whole.slice(lo, 1024) for whole in batches for lo in range(0, whole.num_rows, 1024)):
            texts, rows = batch.column(1).to_pylist(), []
            for text, ids in zip(texts, encoder.encode(texts), strict=True):
                back = encoder.decode(ids)
                rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back).hexdigest(), back == (text or "").encode()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array([r[0] for r in rows], pa.int64()), "ids_crc32": pa.array([r[1] for r in rows], pa.int64()), "decoded_sha256": pa.array([r[2] for r in rows], pa.string()), "round_trip": pa.array([r[3] for r in rows], pa.bool_())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
