"""WARC archives and their index.

Pages become records of compressed archives, one gzip member a record. Pages with equal payloads share one response -
that of the largest id - and the others are revisit records that name it. A revisit holds no payload, so only digests
are shuffled to tell which pages are revisits; a Bloom filter over these lets the tasks that read the payloads write the
responses where they are, and the few false hits follow in a pass of their own.

The archives are then read back: each gives a run of captures sorted by URL key and timestamp, written to a file beside
a sparse index. Runs are merged over ranges of (key, time, id), so one URL's captures may lie in several ranges: a loser
tree takes the next capture of at most ``fan_in`` runs, reading each run's range a block at a time; more runs are merged
in levels. The ranges in order are the globally ordered capture histories; a capture's place in its URL's history is
counted within the range, and one row a range tells how far the range before had counted. The driver holds paths, a
few keys a run and a row a range.

Defined results: a null html is an empty payload; equal empty payloads are revisits like others; a null url has the
empty key; a null id is written as such and comes back null, and is the response only where its payload has no id at
all; rows with one id and one payload are responses together; captures of one key, time and id keep no order of their
own; extra columns are ignored; an empty table writes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, drop_folder, dropped, shared_folder, stored
from .lines import filter_bits, probably_twice, seen

EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
EVERY = 256  # lines of a run between entries of its sparse index


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, lower case: captures of a site sort together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return (",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def capture_time(page_id: int | None) -> datetime:
    """Tables without a capture time get one second a page from a fixed day, within a hundred years."""
    return EPOCH + timedelta(seconds=(page_id or 0) % 3_155_760_000)


def write_record(page_id: int | None, url: str | None, payload: bytes | int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """payload: its length is enough for a revisit."""
    size = payload if isinstance(payload, int) else len(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {capture_time(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(source) -> Iterator[tuple[int, int, dict[str, str], bytes]]:  # noqa: ANN001
    """(offset, stored size, headers, block) of each record of an archive, read in pieces."""
    held, at, ended = b"", 0, False
    while True:
        member, size, out = zlib.decompressobj(31), 0, []
        while not member.eof:
            if not held:
                held = source.read(1 << 20)
                if not held:
                    ended = True
                    break
            before = len(held)
            out.append(member.decompress(held))
            held = member.unused_data if member.eof else b""
            size += before - len(held)
        if ended:
            return
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield at, size, headers, rest[: int(headers["Content-Length"])]
        at += size


def capture(offset: int, size: int, headers: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
    number = lambda name: (lambda x: int(x) if x else None)(headers[name][len("<urn:page:") : -1]) if name in headers else None
    return {"key": url_key(headers.get("WARC-Target-URI")), "time": headers["WARC-Date"], "page_id": number("WARC-Record-ID"), "bytes": length, "digest": digest, "type": kind, "refers_to": number("WARC-Refers-To"), "offset": offset, "size": size}


class LoserTree:
    """The smallest head of k sorted inputs: inner nodes keep the losers of a tournament, so a new head plays one game a
    level. Ended inputs have no head and lose every game."""

    def __init__(self, inputs: list[Iterator]):
        self.inputs, self.k = inputs, max(1, len(inputs))
        self.heads = [next(i, None) for i in inputs] or [None]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        self.losers[node], won = (b, a) if self._before(a, b) else (a, b)
        return won

    def __iter__(self) -> Iterator:
        while self.heads[self.winner] is not None:
            now = self.winner
            yield self.heads[now]
            self.heads[now] = next(self.inputs[now], None)
            node = (now + self.k) // 2
            while node:
                if self._before(self.losers[node], now):
                    self.losers[node], now = now, self.losers[node]
                node //= 2
            self.winner = now


def _sort_key(c: dict) -> list:
    return [c["key"], c["time"], c["page_id"] is not None, c["page_id"] or 0]


def _task_files(folder: str, end: str) -> tuple:
    part = TaskContext.get()
    where, base = pafs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    return where, f"{base}/{part.partitionId():06d}{end}", f"{base}/_{part.partitionId():06d}-{part.taskAttemptId()}{end}"


def classify(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, bytes, refers_to), stored: refers_to is null for responses. Digests of hot payloads are summed
    up before the shuffle, and the join back, of short rows only, is one that adaptive execution splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = byte_texts(batch.column(2))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "digest": pa.array([hashlib.sha1(x).digest() for x in payloads], pa.binary()), "bytes": pa.array([len(x) for x in payloads], pa.int64())})

    own = stored(pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, digest binary, bytes long"), "digests")
    first = stored(own.groupBy("digest").agg(F.max("page_id").alias("chosen"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("same"), "chosen"), "payloads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("chosen")), F.col("chosen"))
    out = stored(own.join(first, own["digest"] == first["same"]).select("page_id", "url", "digest", "bytes", refers.alias("refers_to")).where("refers_to is not null"), "revisits")
    dropped(own, first)
    return out


def _page_hashes(ids: pa.Array, digests: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(d + (b"" if i is None else i.to_bytes(8, "little", signed=True))) for i, d in zip(ids.to_pylist(), digests, strict=True)], np.uint64)


def write_archives(pages: DataFrame, folder: str, max_bits: int = 1 << 30) -> list[str]:
    """Write pages(page_id, url, html) as archives below ``folder``; their names."""
    spark = pages.sparkSession
    own, again = pages.select("page_id", "url", "html"), classify(pages)
    keyed = again.select("page_id", "digest")
    held = spark.sparkContext.broadcast(seen(keyed, lambda b: _page_hashes(b.column(0), b.column(1).to_pylist()), filter_bits(16 * again.count(), max_bits)))

    def writer(kind: str, rows) -> object:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sink, done = None, []
            for batch in batches:
                for record, kept in rows(batch):
                    if kept is not None:
                        done.append(kept)
                        continue
                    if sink is None:
                        where, name, own_name = _task_files(folder, f"-{kind}.warc.gz")
                        sink = where.open_output_stream(own_name, compression=None)
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    sink.write(pack.compress(write_record(*record)) + pack.flush())
                if done:
                    yield pa.RecordBatch.from_pydict({"path": pa.array([None] * len(done), pa.string()), "page_id": pa.array([x[0] for x in done], pa.int64()), "digest": pa.array([x[1] for x in done], pa.binary())})
                    done = []
            if sink is not None:
                sink.close()
                where.move(own_name, name)
                yield pa.RecordBatch.from_pydict({"path": pa.array([name.rpartition("/")[2]], pa.string()), "page_id": pa.array([None], pa.int64()), "digest": pa.array([None], pa.binary())})

        return run

    def responses(batch: pa.RecordBatch) -> Iterator[tuple]:
        """A record to write, or a page that may be a revisit."""
        payloads = byte_texts(batch.column(2))
        digests = [hashlib.sha1(x).digest() for x in payloads]
        hit = probably_twice(held.value, _page_hashes(batch.column(0), digests)).tolist()
        for page_id, url, payload, digest, maybe in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), payloads, digests, hit, strict=True):
            yield (None, (page_id, digest)) if maybe else ((page_id, url, payload, base64.b32encode(digest).decode(), None, False), None)

    def revisits(batch: pa.RecordBatch) -> Iterator[tuple]:
        for page_id, url, digest, size, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield (page_id, url, size, base64.b32encode(digest).decode(), refers_to, True), None

    def left_over(batch: pa.RecordBatch) -> Iterator[tuple]:
        for page_id, url, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2)), strict=True):
            yield (page_id, url, payload, base64.b32encode(hashlib.sha1(payload).digest()).decode(), None, False), None

    schema = "path string, page_id long, digest binary"
    first = stored(own.mapInArrow(writer("a", responses), schema), "written")
    second = stored(again.mapInArrow(writer("b", revisits), schema), "written")
    # pages that the filter took for revisits and that are none: a small share, by keys alone
    maybe = first.where("path is null").select(F.col("page_id").alias("p"), F.col("digest").alias("d")).distinct()
    false = stored(maybe.join(keyed, maybe["p"].eqNullSafe(keyed["page_id"]) & (maybe["d"] == keyed["digest"]), "left_anti"), "false-hits")
    names = first.where("path is not null").select("path").union(second.where("path is not null").select("path"))
    if n_false := false.count():
        few = spark.sparkContext.broadcast(seen(false, lambda b: _page_hashes(b.column(0), b.column(1).to_pylist()), filter_bits(16 * n_false, max_bits)))

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                digests = [hashlib.sha1(x).digest() for x in byte_texts(batch.column(2))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=["page_id", "url", "html", "digest"]).filter(pa.array(probably_twice(few.value, _page_hashes(batch.column(0), digests))))

        rest = own.mapInArrow(chosen, "page_id long, url string, html string, digest binary")
        rest = rest.join(false, rest["page_id"].eqNullSafe(false["p"]) & (rest["digest"] == false["d"]), "left_semi")
        third = stored(rest.select("page_id", "url", "html").mapInArrow(writer("c", left_over), schema), "written")
        names = names.union(third.select("path"))
    out = sorted(r.path for r in names.collect())  # one an archive
    dropped(again, first, second, false, *([third] if n_false else []))
    return out


def _write_run(where, captures, own_name: str, name: str) -> None:  # noqa: ANN001
    """A sorted run, and beside it the key and offset of every EVERY-th line."""
    marks, at = [], 0
    with where.open_output_stream(own_name, compression=None) as sink:
        for n, c in enumerate(captures):
            if n % EVERY == 0:
                marks.append([_sort_key(c), at])
            line = json.dumps(c).encode() + b"\n"
            sink.write(line)
            at += len(line)
    with where.open_output_stream(own_name + ".idx", compression=None) as sink:
        sink.write(json.dumps(marks).encode())
    where.move(own_name + ".idx", name + ".idx")
    where.move(own_name, name)


def index_runs(spark: SparkSession, folder: str, archives_in: str, archives: list[str], sample: int = 32) -> list[dict]:
    """Read each archive back into a sorted run below ``folder``; a dict a run: its path and up to ``sample`` of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source_at, base_in = pafs.FileSystem.from_uri(archives_in)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                where, name, own_name = _task_files(folder, ".cdx")
                with source_at.open_input_stream(f"{base_in}/{archives[i]}", compression=None) as source:
                    found = sorted((c | {"archive": archives[i]} for c in (capture(*r) for r in read_records(source))), key=_sort_key)
                _write_run(where, found, own_name, name)
                keys = [_sort_key(found[len(found) * j // sample]) for j in range(min(sample, len(found)))]
                yield pa.RecordBatch.from_pydict({"path": pa.array([name]), "keys": pa.array([json.dumps(keys)])})

    n = len(archives)
    rows = spark.range(0, n, 1, n).mapInArrow(run, "path string, keys string").collect() if n else []
    return [{"path": r.path, "keys": json.loads(r.keys)} for r in sorted(rows)]


def _lines(source, at: int, end: int, lo: list | None, hi: list | None) -> Iterator[tuple[list, dict]]:  # noqa: ANN001
    """Captures of a run with lo <= key < hi, read in blocks."""
    source.seek(at)
    held = b""
    while at < end or held:
        piece = source.read(min(1 << 16, end - at)) if at < end else b""
        at += len(piece)
        *whole, held = (held + piece).split(b"\n") if piece else (held, b"")
        for line in whole:
            if not line:
                continue
            c = json.loads(line)
            key = _sort_key(c)
            if hi is not None and key >= hi:
                return
            if lo is None or key >= lo:
                yield key, c


def _opened(where, path: str, lo: list | None, hi: list | None) -> tuple:  # noqa: ANN001
    """A run's file and its captures from lo to hi, by its index."""
    with where.open_input_file(path + ".idx") as source:
        marks = json.loads(source.read())
    at = marks[max(0, bisect_left([m[0] for m in marks], lo) - 1)][1] if lo is not None and marks else 0
    source = where.open_input_file(path)
    return source, _lines(source, at, source.size(), lo, hi)


def merge_runs(spark: SparkSession, folder: str, runs: list[dict], ranges: int, fan_in: int = 64) -> DataFrame:
    """The captures in global order of (key_range, ordinal): history_no counts the captures of a URL key."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, key_range int, ordinal long, history_no long"
    if not runs:
        return spark.createDataFrame([], schema)
    sample = sorted(k for r in runs for k in r["keys"])
    cuts = sorted({tuple(sample[len(sample) * i // ranges]) for i in range(1, ranges)} - {tuple(sample[0])})
    bounds = [None, *map(list, cuts), None]
    n = len(bounds) - 1
    paths = [r["path"] for r in runs]
    arrow = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("key_range", pa.int32()), ("ordinal", pa.int64()), ("history_no", pa.int64())])
    shared = spark.sparkContext.broadcast((bounds, paths))
    _, base = pafs.FileSystem.from_uri(folder)
    # a level merges groups of fan_in runs over ranges; where there are fan_in times fewer runs, there are fan_in times more
    # ranges, so each level has about as many tasks as there are runs, and each opens fan_in files
    levels = [len(paths)]
    while levels[-1] > fan_in:
        levels.append(-(-levels[-1] // fan_in))
    last = len(levels)
    width = [n] + [fan_in ** (last - k) for k in range(1, last + 1)]  # final ranges to a range of the level

    def inputs(where, level: int, i: int, group: int) -> tuple[list, list]:  # noqa: ANN001
        """What a task of a level merges: its group's runs over its range."""
        bounds, paths = shared.value
        lo, hi = bounds[i * width[level]], bounds[min((i + 1) * width[level], n)]
        sources, out = [], []
        for j in range(group * fan_in, min((group + 1) * fan_in, levels[level - 1])):
            path = paths[j] if level == 1 else f"{base}/level-{level - 1}/{i * width[level] // width[level - 1]:06d}-{j:06d}"
            source, lines = _opened(where, path, lo, hi)
            sources.append(source)
            out.append(lines)
        return sources, out

    def shrink(level: int) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where, _ = pafs.FileSystem.from_uri(folder)
            where.create_dir(f"{base}/level-{level}", recursive=True)
            for batch in batches:
                for task in batch.column(0).to_pylist():
                    i, group = divmod(task, levels[level])
                    sources, lines = inputs(where, level, i, group)
                    name = f"{i:06d}-{group:06d}"
                    _write_run(where, (c for _, c in LoserTree(lines)), f"{base}/level-{level}/_{name}-{TaskContext.get().taskAttemptId()}", f"{base}/level-{level}/{name}")
                    for s in sources:
                        s.close()
                yield pa.RecordBatch.from_pydict({"id": batch.column(0)})

        return run

    for level in range(1, last):
        tasks = -(-n // width[level]) * levels[level]
        spark.range(0, tasks, 1, tasks).mapInArrow(shrink(level), "id long").write.format("noop").mode("overwrite").save()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                sources, lines = inputs(where, last, i, 0)
                rows: list[tuple] = []
                key, count = None, 0
                for m, (_, c) in enumerate(LoserTree(lines)):
                    count = count + 1 if c["key"] == key else 1
                    key = c["key"]
                    rows.append((c["page_id"], c["bytes"], c["digest"], c["type"], c["refers_to"], key, c["time"], i, m, count))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pydict({f.name: [x[j] for x in rows] for j, f in enumerate(arrow)}, schema=arrow)
                        rows = []
                yield pa.RecordBatch.from_pydict({f.name: [x[j] for x in rows] for j, f in enumerate(arrow)}, schema=arrow)
                for s in sources:
                    s.close()

    merged = stored(spark.range(0, n, 1, n).mapInArrow(run, schema), "captures")
    # one row a range: its first key, its last key and how often that one came, to go on counting in the next range
    ends = merged.groupBy("key_range").agg(F.min_by("url_key", "ordinal").alias("first"), F.max_by("url_key", "ordinal").alias("last"), F.max_by("history_no", "ordinal").alias("n")).orderBy("key_range").collect()
    offsets, before, held = [], None, 0
    for r in ends:
        start = held if r.first == before else 0
        if start:
            offsets.append((r.key_range, r.first, start))
        held = r.n + (start if r.first == r["last"] else 0)
        before = r["last"]
    more = spark.createDataFrame(offsets, "__range int, __key string, __n long")
    joined = merged.join(F.broadcast(more), (F.col("key_range") == F.col("__range")) & (F.col("url_key") == F.col("__key")), "left")
    return joined.withColumn("history_no", F.col("history_no") + F.coalesce("__n", F.lit(0))).drop("__range", "__key", "__n")


def archive_pages(pages: DataFrame, fan_in: int = 64) -> DataFrame:
    """Write, read back, merge: a row a capture."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    archives = write_archives(pages, f"{folder}/archives")
    out = merge_runs(spark, folder, index_runs(spark, f"{folder}/runs", f"{folder}/archives", archives), max(1, len(archives)), fan_in)
    if archives:
        drop_folder(spark, folder)  # the captures are stored
    return out


def record_bytes(record: bytes) -> list[dict]:
    """The captures of an archive held in memory."""
    return [capture(*r) for r in read_records(io.BytesIO(record))]
