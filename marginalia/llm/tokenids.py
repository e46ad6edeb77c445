"""Token-ID output: sorted-string-table shards.

A shard holds documents in ascending order of identifier. Entries are cut into blocks; in a block a key is stored as
the length it shares with the one before and the rest, with full keys at restart points for binary search; blocks are
compressed and carry a checksum. After the blocks come a Bloom filter over the keys, a sparse index with the last key of
each block, and a footer of fixed size.

    shard   = block* bloom index footer
    block   = u32 checksum of what follows, u32 stored size, zstd(entry* restart-offset:u32* n-restarts:u32)
    entry   = shared:varint rest:varint value:varint key-rest value
    value   = width:u8 (2 or 4) ids, little-endian, of that width
    index   = zstd of (key-length:u8 key offset:u64 size:u32)*
    footer  = index offset, index size, bloom offset, bloom size, entries, ids : u64, "MGSSTAB1"

A key is 0x00 for a null id, else 0x01 and the id with its sign bit turned, big-endian; a running u32 follows, which
tells rows with equal ids apart. Files are written under a task's own name and then renamed, so tasks may run again. The
folder's manifest.json lists the shards in order, each with its first and last id, rows and ids, so files can be read
and looked up later without anything else.

Defined results: null and empty texts encode to nothing and get the end id alone; null ids come first; rows with equal
ids follow one another in the order of their texts; extra columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_at_exit, shared_folder

MAGIC, MANIFEST = b"MGSSTAB1", "manifest.json"
FOOTER = struct.Struct("<6Q8s")
RESTART = 16
#: The code points with the Unicode property White_Space. A token never reaches from other text into these.
_SPACE = "\t-\r \x85\xa0  -     　"
_SPACES = frozenset(chr(i) for i in range(0x3001) if re.match(f"[{_SPACE}]", chr(i)))
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


class Encoder:
    """The tokenizers library over the pieces of a text that it would cut apart anyway; what it gave for short pieces is
    kept, up to ``keep`` of them, since most pieces recur."""

    def __init__(self, path: str, keep: int = 1_600_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        symbols = set(ByteLevel.alphabet())
        # bytes of each id: a byte-level token has one symbol a byte; added tokens stand for themselves
        self.sizes = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token) if token in vocabulary and symbols.issuperset(token) else len(token.encode())
        self.known: dict[str, bytes] = {}
        self.keep, self.longest = keep, longest

    def _encode(self, pieces: list[str], run: int = 2000) -> dict[str, bytes]:
        """Pieces that start with a space and end with other text are encoded many in one string, which the library cuts
        between them; sums of the ids' sizes tell whose ids are whose."""
        out: dict[str, bytes] = {}
        alone = [p for p in pieces if not (p[0] in _SPACES and p[-1] not in _SPACES)]
        if alone:
            out |= {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True)}
        rest = [p for p in pieces if p[0] in _SPACES and p[-1] not in _SPACES]
        for lo in range(0, len(rest), run):
            own = rest[lo : lo + run]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(own)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(p.encode()) for p in own])
            reached = np.cumsum(self.sizes[ids])
            cuts = np.searchsorted(reached, ends)
            if len(ids) == 0 or (reached[np.minimum(cuts, len(ids) - 1)] != ends).any():  # a token reaches over a cut
                out |= {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(own, self.tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True)}
                continue
            flat, at = ids.tobytes(), 0
            for p, c in zip(own, (4 * (cuts + 1)).tolist(), strict=True):
                out[p] = flat[at:c]
                at = c
        return out

    def batch(self, texts: list[str | None], rows: int = 256) -> Iterator[bytes]:
        """The ids of each text as little-endian u32."""
        for lo in range(0, len(texts), rows):
            cut = [_PIECE.findall(t) if t else [] for t in texts[lo : lo + rows]]
            got = [list(map(self.known.get, pieces)) for pieces in cut]
            new = {p for pieces, ids in zip(cut, got, strict=True) if None in ids for p, x in zip(pieces, ids, strict=True) if x is None}
            made = self._encode(list(new))
            for pieces, ids in zip(cut, got, strict=True):
                if None in ids:
                    ids = [made[p] if x is None else x for p, x in zip(pieces, ids, strict=True)]
                yield b"".join(ids)
            if len(self.known) + len(made) > self.keep:
                self.known.clear()
            self.known.update((p, x) for p, x in made.items() if len(p) <= self.longest)


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One a worker process: what it has learned serves the process's next tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def key_of(doc_id: int | None, n: int = 0) -> bytes:
    return (b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + 2**63)) + struct.pack(">I", n)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - 2**63


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9747B28C) | 1
    return [(a + i * b) % bits for i in range(6)]


def pack_ids(ids: bytes) -> bytes:
    a = np.frombuffer(ids, "<u4")
    return b"\x02" + a.astype("<u2").tobytes() if len(a) == 0 or a.max() < 65536 else b"\x04" + ids


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


class Writer:
    """Keys must come in ascending order."""

    def __init__(self, out, block_bytes: int = 1 << 18):  # noqa: ANN001  anything with write()
        self.out, self.block_bytes = out, block_bytes
        self.at = self.entries = self.ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.pack = zstandard.ZstdCompressor(level=1)
        self._reset()

    def _reset(self) -> None:
        self.block, self.restarts, self.n, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            shared = len(os.path.commonprefix([self.last, key]))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.n, self.last, self.entries = self.n + 1, key, self.entries + 1
        self.ids += (len(value) - 1) // value[0]
        self.keys.append(key[:-4])
        if len(self.block) >= self.block_bytes:
            self._close_block()

    def _close_block(self) -> None:
        if not self.n:
            return
        body = self.pack.compress(bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts)))
        stored = struct.pack("<II", zlib.crc32(body), len(body)) + body
        self.out.write(stored)
        self.index.append((self.last, self.at, len(stored)))
        self.at += len(stored)
        self._reset()

    def close(self) -> None:
        self._close_block()
        bits = max(64, 10 * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[_bloom_places(k, bits)] = 1
        bloom = np.packbits(bloom, bitorder="little").tobytes()
        index = self.pack.compress(b"".join(bytes([len(k)]) + k + struct.pack("<QI", at, size) for k, at, size in self.index))
        self.out.write(bloom + index + FOOTER.pack(self.at + len(bloom), len(index), self.at, len(bloom), self.entries, self.ids, MAGIC))


class Reader:
    """A shard: lookup by identifier through filter, index and block; scan in order."""

    def __init__(self, source):  # noqa: ANN001  a random-access file
        self.source, size = source, source.seek(0, 2) or source.tell()
        at, n, bat, bn, self.entries, self.ids, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.bloom_at, self.bloom_size, self._bloom = bat, bn, None
        raw, self.index, i = zstandard.ZstdDecompressor().decompress(self._read(at, n)), [], 0
        while i < len(raw):
            k = raw[i]
            self.index.append((raw[i + 1 : i + 1 + k], *struct.unpack_from("<QI", raw, i + 1 + k)))
            i += 13 + k

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, at: int, size: int) -> tuple[bytes, list[int]]:
        stored = self._read(at, size)
        crc, n = struct.unpack_from("<II", stored)
        if zlib.crc32(stored[8 : 8 + n]) != crc:
            raise ValueError("a block is damaged")
        body = zstandard.ZstdDecompressor().decompress(stored[8 : 8 + n])
        k = struct.unpack_from("<I", body, len(body) - 4)[0]
        return body[: len(body) - 4 - 4 * k], list(struct.unpack_from(f"<{k}I", body, len(body) - 4 - 4 * k))

    @staticmethod
    def _entries(body: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            yield key, body[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for _, at, size in self.index:
            yield from self._entries(self._block(at, size)[0], 0)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row with this identifier."""
        key = key_of(doc_id)[:-4]
        if self._bloom is None:
            self._bloom = np.frombuffer(self._read(self.bloom_at, self.bloom_size), np.uint8)
        if not all(self._bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, 8 * len(self._bloom))):
            return []
        out = []
        for _, at, size in self.index[bisect_left(self.index, (key,)) :]:
            body, restarts = self._block(at, size)
            lo, hi = 0, len(restarts) - 1
            while lo < hi:  # the last restart whose key is below
                mid = (lo + hi + 1) // 2
                if next(self._entries(body, restarts[mid]))[0] < key:
                    lo = mid
                else:
                    hi = mid - 1
            for k, v in self._entries(body, restarts[lo]):
                if k[:-4] == key:
                    out.append(unpack_ids(v))
                elif k > key:
                    return out
        return out


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> list[dict]:
    """Write docs(doc_id, text) below ``folder``; a dict a shard, in order of identifiers: path, rows, ids."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    where, base = pafs.FileSystem.from_uri(folder)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = writer = first = None
        part = TaskContext.get()
        where, base = pafs.FileSystem.from_uri(folder)
        name = f"{base}/shard-{part.partitionId():06d}.sst"
        own = f"{base}/_shard-{part.partitionId():06d}-{part.taskAttemptId()}"
        last, count = (), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = encoder_of(tokenizer)
                where.create_dir(base, recursive=True)
                sink = where.open_output_stream(own)
                writer = Writer(sink)
                first = batch.column(0)[0].as_py()
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1).to_pylist()), strict=True):
                count = count + 1 if last == (doc_id,) else 0
                last = (doc_id,)
                writer.add(key_of(doc_id, count), pack_ids(ids + end))
        if writer is not None:
            writer.close()
            sink.close()
            where.move(own, name)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part.partitionId()], pa.int32()), "path": [name.rpartition("/")[2]], "first": pa.array([first], pa.int64()), "last": pa.array(last, pa.int64()), "rows": pa.array([writer.entries], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    rows = ordered.mapInArrow(run, "part int, path string, first long, last long, rows long, ids long").collect()  # one a shard
    shards = [{c: r[c] for c in ("path", "first", "last", "rows", "ids")} for r in sorted(rows, key=lambda r: r.part)]
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/{MANIFEST}") as sink:
        sink.write(json.dumps({"format": MAGIC.decode(), "end_id": end_id, "shards": shards}).encode())
    return shards


def manifest(folder: str) -> list[dict]:
    """The shards of a folder, as write_shards gave them."""
    where, base = pafs.FileSystem.from_uri(folder)
    with where.open_input_file(f"{base}/{MANIFEST}") as source:
        return json.loads(source.read())["shards"]


def _place(doc_id: int | None) -> tuple:
    return (doc_id is not None, doc_id or 0)


def lookup(ids: DataFrame, folder: str) -> DataFrame:
    """ids(doc_id) -> (doc_id, n, token_ids) of each row of the shards with such an id, by binary search: ids go to the task
    of their shard, where filter, sparse index and restart points find them. An id that no shard has gives no row; an id
    asked for twice gives its rows twice. n counts the rows of one id."""
    spark, shards = ids.sparkSession, manifest(folder)
    schema = "doc_id long, n int, token_ids array<long>"
    if not shards:
        return spark.createDataFrame([], schema)
    firsts, lasts = ([_place(s[c]) for s in shards] for c in ("first", "last"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, shard = [], []
            for x in batch.column(0).to_pylist():
                k = _place(x)
                for i in range(bisect_left(lasts, k), len(shards)):  # rows of one id may lie in two shards that touch
                    if firsts[i] > k:
                        break
                    asked.append(x)
                    shard.append(i)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(asked, pa.int64()), "shard": pa.array(shard, pa.int32())})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard, so one shard is open at a time."""
        where, base = pafs.FileSystem.from_uri(folder)
        at, source, reader = None, None, None
        for batch in batches:
            rows: list[tuple] = []
            for x, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != at:
                    if source is not None:
                        source.close()
                    at, source = i, where.open_input_file(f"{base}/{shards[i]['path']}")
                    reader = Reader(source)
                rows += [(x, n, v) for n, v in enumerate(reader.get(x))]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int32()), "token_ids": pa.array([r[2].astype(np.int64) for r in rows], pa.list_(pa.int64()))})
        if source is not None:
            source.close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = ids.select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(route, "doc_id long, shard int")
    return routed.repartition(parts, "shard").sortWithinPartitions("shard", "doc_id").mapInArrow(find, schema)


def read_shards(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """(doc_id, start, n_tokens, ids_crc32) of each document, from manifest and files; one task a shard."""
    schema, shards = "doc_id long, start long, n_tokens long, ids_crc32 long", manifest(folder)
    if not shards:
        return spark.createDataFrame([], schema)
    starts = np.concatenate(([0], np.cumsum([s["ids"] for s in shards]))).tolist()
    paths = [s["path"] for s in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                at, rows = starts[i], []
                with where.open_input_file(f"{base}/{paths[i]}") as source:
                    for key, value in Reader(source).scan():
                        ids = unpack_ids(value)
                        rows.append((id_of(key), at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                        if len(rows) == 10_000:
                            yield _report(rows)
                            rows = []
                yield _report(rows)

    return spark.range(0, len(paths), 1, len(paths)).mapInArrow(run, schema)


def _report(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("doc_id", "start", "n_tokens", "ids_crc32"))})


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write shards to the shared folder and report from them."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-ids")
    write_shards(docs, tokenizer, end_id, folder)
    drop_at_exit(spark, folder)
    return read_shards(spark, folder)


def total_ids(table: DataFrame) -> int:
    return table.agg(F.sum("n_tokens")).first()[0] or 0
