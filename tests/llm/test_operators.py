"""Each operator against a brute-force version or an exact round trip, on small cases with nulls, empty and long texts,
ties, repeated rows, extra columns and empty tables."""

import base64
import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marginalia.llm import components, decontam, langid, lines, pieces, quality, repeats, simhash, similar, tokenids, toxicity, warc

SF = "/root/testdata/sf0.001"
WORDS = ["the", "of", "and", "to", "in", "house", "river", "stone", "walks", "slowly", "bright", "morning", "étude", "naïve"]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = [(i, text_of(rng, rng.randint(1, 120)), rng.choice(["en", "fr"])) for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, " \t\n ", "en"), (None, "no identifier here", "en"), (103, rows[3][1], "en"), (104, "x" * 5000, "en"), (105, "a b " * 3000, "en"), (3, rows[3][1], "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("keys", F.lit(1)).withColumn("start", F.lit("clash"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_quality_counts(spark, docs, empty):
    refs = quality.fit_references(docs)
    got = quality.score_quality(docs, refs).collect()
    assert len(got) == docs.count() and quality.score_quality(empty, quality.fit_references(empty)).count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        b = (texts[r.doc_id] or "").encode()
        words = b.split()
        ls = [x for x in b.split(b"\n") if x.strip()]
        w = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        n, cover = Counter(w), set()
        for i, x in enumerate(w):
            if n[x] > 1:
                cover |= set(range(i, i + 8))
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(len(x.decode()) for x in words), len(ls) - len(set(ls)), len(cover))
        assert r.base_failed == (len(words) < 20 or 100 * len(cover) > 30 * len(words)) and not (r.base_failed and r.kept)


def test_quality_rejects_symbols(spark):
    rng = random.Random(1)
    good = [(i, text_of(rng, 100), "en") for i in range(30)]
    df = spark.createDataFrame([*good, (99, " ".join(w + "$$$" for w in text_of(rng, 100).split()), "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality.score_quality(df, quality.fit_references(df.where("doc_id < 90"))).collect()}
    assert not got[99] and all(got[i] for i in range(30))
    p = np.array([0.5, 0.5, 0.0])
    assert quality.js_distance(p, p) == 0 and quality.js_distance(p, np.array([0, 0, 1.0])) == 1


def test_quality_rejects_gibberish(spark):
    rng = random.Random(13)
    letters = "".join(WORDS[:12])
    made = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n))
    mixed = lambda n: " ".join(rng.choice(WORDS) if rng.random() < 0.37 else made(1) for _ in range(n))
    df = spark.createDataFrame([*((i, mixed(400), "en") for i in range(300)), (900, made(400), "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.score_quality(df, quality.fit_references(df.where("doc_id < 900"))).collect()}
    assert not got[900].base_failed and got[900].word_distance < 0.5 and not got[900].kept
    assert all(got[i].kept for i in range(300))


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        words = text_of(rng, 40).split()
        if bad:
            words[rng.randrange(40)] = rng.choice(["zorp", "idiot"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame([*rows, (None, "idiot"), (2000, None), (2001, "")], "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    got = toxicity.score_toxicity(d, model).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) + 3 and held and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert toxicity.score_toxicity(d, toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))).first().score == 0.5


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    s = rng.normal(size=300)
    x, y = toxicity.fit_isotonic(s, (rng.random(300) < 1 / (1 + np.exp(-3 * s))).astype(float))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all()


def test_language_held_out(spark, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    d = d.union(spark.createDataFrame([(9001, None, "en"), (9002, "123 !!", "en"), (9003, "Éa", None)], d.schema))
    got = langid.identify(d).join(d.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang and len(r.text or "") > 40]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[9001].lang_pred == by[9002].lang_pred == "und" and by[9003].lang_pred != "und"
    assert langid.identify(empty).count() == 0 and langid.predict(d, langid.fit_prototypes(empty)).where("lang_pred <> 'und'").count() == 0
    assert {9001, 9002}.isdisjoint({r.doc_id for r in langid.keep_identified(d).collect()})


def test_every_language_is_learned(spark):
    rows = [(k, " ".join([chr(0x4E00 + 7 * k + i) + chr(0x4E00 + 7 * k + (i + 1) % 7) for i in range(7)] * 3), f"x{k:03}") for k in range(230)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.fit_prototypes(d).langs) == 230


def test_language_binding():
    s = langid.Space(dims=64)
    c = s.trigrams("ab c".encode())
    assert len(c) == 4  # a gap at each end: _ab ab_ b_c _c_
    own = s.profiles(["abc".encode()])[0]
    want = np.zeros(64)
    for t in s.trigrams(b"abc"):
        a, b, d = t // langid.ROWS**2, t // langid.ROWS % langid.ROWS, t % langid.ROWS
        want += s.base[a][s.orders[2]].astype(int) * s.base[b][s.orders[1]] * s.base[d]
    assert (own == want).all()


def test_pieces_match_the_library(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    alphabet = list("the  an ing éß日本🙂\n\tabcxyz019.-")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(500)] + ["w" * 3000]
    enc = pieces.PieceEncoder(pieces.Vocabulary.load(open(path, "rb").read()), keep=200)
    for t, ids in zip(texts, enc.encode(texts, rows=16), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t) and enc.decode(ids).decode() == t
    got = pieces.round_trip(docs, path).collect()
    assert len(got) == docs.count() and all(r.round_trip for r in got)
    back = pieces.decode_documents(pieces.encode_documents(docs, path), path)
    assert sorted((r.text or "") for r in back.collect()) == sorted((r.text or "") for r in docs.collect())


def test_unigram_viterbi_is_the_best_path():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.model_type = 1
    enc = pieces.PieceEncoder(pieces.Vocabulary.load(m.SerializeToString()))
    v = enc.v
    for word in ("▁and", "▁hello", "▁walking", "abcdé"):
        best = {0: 0.0}
        for e in range(1, len(word) + 1):
            best[e] = max(best[s] + v.scores[enc.lookup[word[s:e]]] for s in range(e) if word[s:e] in enc.lookup)
        ids, first = enc.viterbi([word])
        assert sum(v.scores[i] for i in ids[0, first[0] :]) == best[len(word)]


def brute_components(rows, radius=4):
    fps = [(i, simhash.fingerprint((t or "").encode())) for i, t in rows]
    parent = {f: f for _, f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted((str(i), f"{f:016x}", least.get(find(f))) for i, f in fps)


@pytest.mark.parametrize("blocks,crowd", [(2, 256), (2, 3), (1, 256)])
def test_simhash(spark, docs, monkeypatch, blocks, crowd):
    rng = random.Random(4)
    base = text_of(rng, 400).split()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for i in range(12):
        own = list(base)
        own[rng.randrange(400)] = "changed"
        rows.append((500 + i, " ".join(own)))
    if crowd != 256:
        plain = simhash.links
        monkeypatch.setattr(simhash, "links", lambda f, r, b: plain(f, r, b, crowd=crowd))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(d, blocks=blocks).collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize("small", [16, 2])
def test_similar_pairs_go(spark, small):
    """Near copies by brute-force Jaccard that fingerprints of 4 bits leave apart."""
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 120, 300]))]
        for v in range(5):
            words = list(base)
            for _ in range(len(base) * v // 80 + (v > 0)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (None, "no identifier at all")]
    sets = {i: {tuple((t or "").lower().split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} for i, t in rows if i is not None}
    fps = {i: simhash.fingerprint((t or "").encode()) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    missed = 0
    for i in sorted(sets):
        for j in sorted(x for x in sets if x < i):
            alike, close = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]), (fps[i] ^ fps[j]).bit_count() <= 4
            missed += alike and not close
            if alike or close:
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in similar.keep_one(docs, small=small).collect()}
    assert missed > 5 and got == {i for i in sets if root[i] == i} | {None}
    assert similar.keep_one(docs.limit(0)).count() == 0


def test_fingerprint_definition():
    import xxhash

    words = "A b c D e f".split()
    runs = [" ".join(words[i : i + 4]).lower() for i in range(3)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    assert simhash.fingerprint(b"A b\tc D\ne f") == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert simhash.fingerprint(b" ") == 0 and simhash.fingerprint(b"X y") == xxhash.xxh64_intdigest(b"x y", 42)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_line_dedup(spark, docs, empty):
    rng = random.Random(6)
    common = ["A line that stands in many of the documents, number %d." % i for i in range(3)]
    rows = [(i, "\n".join(rng.sample([*common, "  " + common[0].upper() + "\t", "short", text_of(rng, 12), ""], 5))) for i in range(12)] + [(r.doc_id, r.text) for r in docs.collect()]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda s: s.encode().strip(b" \t\n\r\x0b\x0c").lower().decode()
    held: dict = {}
    for i, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 40:
                held.setdefault(key(s), set()).add(i)
    last = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v) >= 5}
    want = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [s for s in all_ if key(s) not in last or last[key(s)] == i]
        want.append((str(i), len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert sorted((str(r.doc_id), *r[1:]) for r in lines.line_report(d).collect()) == sorted(want)
    assert lines.line_report(empty).count() == 0
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_repeats(spark, docs, empty, monkeypatch):
    rng = random.Random(8)
    base = "".join(rng.choice("ab cdé") for _ in range(400))
    rows = [(i, base[: rng.randrange(200, 400)] + text_of(rng, 20)) for i in range(20)] + [(50, base[:150] * 2), (51, "a" * 400), (52, None), (53, ""), (54, "z" * 99), (55, "ab" * 150)]
    seen, want = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        cover = [False] * len(b)
        for j in range(len(b) - 99):
            if b[j : j + 100] in seen:
                cover[j : j + 100] = [True] * 100
            seen.add(b[j : j + 100])
        spans = sum(c and (j == 0 or not cover[j - 1]) for j, c in enumerate(cover))
        want[i] = (len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest())
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: tuple(r[1:]) for r in repeats.repeat_report(d).collect()} == want
    plain = repeats.removed_ranges
    monkeypatch.setattr(repeats, "removed_ranges", lambda x, size: plain(x, size, crowd=1))
    monkeypatch.setattr(repeats, "PARTS", 2)
    assert {r.doc_id: tuple(r[1:]) for r in repeats.repeat_report(d).collect()} == want
    assert repeats.repeat_report(empty).count() == 0 and repeats.repeat_report(docs).count() == docs.count()
    monkeypatch.setattr(repeats, "removed_ranges", plain)
    assert repeats.repeat_report(d, size=300).where("n_removed > 0").count() > 0
    with pytest.raises(ValueError):
        repeats.repeat_report(d, size=20)


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    items = [text_of(rng, rng.randint(12, 40)) for _ in range(20)]
    index = decontam.build_index([(i, t.encode()) for i, t in enumerate(items)], 0.1, 32)

    def distance(p, t):
        a = np.frombuffer(t, np.uint8)
        row, at = np.zeros(len(a) + 1, int), np.arange(len(a) + 1)
        for c in p:
            new = np.append(row[0] + 1, np.minimum(row[:-1] + (a != c), row[1:] + 1))
            row = np.minimum.accumulate(new - at) + at
        return row.min()

    for _ in range(80):
        k = rng.randrange(len(index.texts))
        p = bytearray(index.texts[k])
        for _ in range(rng.randint(0, int(index.edits[k]) + 3)):
            j = rng.randrange(len(p))
            rng.choice([lambda: p.__setitem__(j, 120), lambda: p.__delitem__(j), lambda: p.insert(j, 120)])()
        t = decontam.normal(text_of(rng, rng.randint(0, 30)).encode() + b" " + bytes(p) + b" " + text_of(rng, 5).encode())
        d = distance(index.texts[k], t)
        assert decontam.find_items(index, [t])[0].get(k) == (d if d <= index.edits[k] else None)
    bench = spark.createDataFrame([*enumerate(items), (None, items[0]), (77, None)], "item_id long, text string")
    df = docs.union(spark.createDataFrame([(900, "before " + "".join(c.upper() if c.isascii() else c for c in items[3]) + " after", "en", 1, "x")], docs.schema))
    for size in (32 << 20, 400):  # in one block and in several
        got = {r.doc_id: r for r in decontam.find_contamination(df, bench, block_bytes=size).collect()}
        assert got[900].contaminated and got[900].item_ids == [3] and got[900].edits == 0 and not got[104].contaminated
    clean = decontam.drop_contaminated(df, bench)
    assert clean.columns == df.columns and clean.where("doc_id = 900").count() == 0
    assert decontam.find_contamination(empty, bench).count() == 0 and decontam.find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_short_benchmark_items(spark):
    bench = spark.createDataFrame([(1, "Who  is Ada?"), (2, "7 x 6 = 42"), (3, " "), (4, "a much longer item of the benchmark, found by its grams")], "item_id long, text string")
    rows = [(1, 'He asked: "who is\nADA?" - and left'), (2, "who is adam? so 17 x 6 = 42"), (3, "(7 x 6 = 42)"), (4, "7 x 6 = 421"), (5, ""), (6, "a much longer item of the benchmark, found by its grams. 7 x 6 = 42")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.item_ids, r.edits) for r in decontam.find_contamination(df, bench).collect() if r.contaminated}
    assert got == {1: ([1], 0), 3: ([2], 0), 6: ([2, 4], 0)}
    assert {r.doc_id for r in decontam.drop_contaminated(df, bench).collect()} == {2, 4, 5}


@pytest.mark.parametrize("fan_in", [64, 2])
def test_warc(spark, fan_in, monkeypatch):
    monkeypatch.setattr(warc, "EVERY", 2)
    if fan_in == 2:  # a filter that takes every page for a revisit
        monkeypatch.setattr(warc, "probably_twice", lambda packed, h: np.ones(len(h), bool))
    rows = [(i, f"http://h{i % 3}.org/p?{i % 5}", f"<p>é{i % 4}</p>" * (i % 7)) for i in range(40)] + [(50, None, None), (51, "http://x.y/", ""), (None, "http://a.b/", "<p>é1</p>"), (52, "bad://[", "z" * 100_000), (7, "http://h1.org/p?2", "")]
    rows += [(1000 + i, "http://hot.org/", f"<b>{i % 50}</b>") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("p", F.lit(2)).repartition(9)
    got = warc.archive_pages(pages, fan_in).collect()
    assert len({r.key_range for r in got if r.url_key == "org,hot)/"}) > 1  # one URL's history in several ranges
    by: dict = {}
    for i, _, h in rows:
        by.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        top = max(x for x in by[h or ""] if x is not None)
        want.append((str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert sorted((str(r.page_id), *r[1:5]) for r in got) == sorted(want)
    order = sorted(got, key=lambda r: (r.key_range, r.ordinal))
    keys = [(r.url_key, r.captured) for r in order]
    assert keys == sorted(keys) and all(b.history_no == (a.history_no + 1 if a.url_key == b.url_key else 1) for a, b in zip(order, order[1:], strict=False))
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_loser_tree():
    rng = random.Random(10)
    for k in range(9):
        runs = [sorted((rng.randrange(50), n, j) for j in range(rng.randrange(6))) for n in range(k)]
        assert [x[0] for x in warc.LoserTree([iter([(y, None) for y in r]) for r in runs])] == sorted(y for r in runs for y in r)


def test_token_ids(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = tokenids.token_table(docs, path).collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (i, text) in zip(sorted(got, key=lambda r: r.start), rows, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenids.token_table(empty, path).count() == 0
    rng = random.Random(11)
    e = tokenids.Encoder(path, keep=50)
    alphabet = list(" \t\n\x1c\x85\xa0ab1é!'s?　 x")
    for _ in range(400):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(next(e.batch([s])), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids


def test_shard_lookup():
    out = io.BytesIO()
    w = tokenids.Writer(out, block_bytes=200)
    table = {None: [1], **{i * 3 - 50: list(range(i % 90)) for i in range(300)}, 10**12: [70000, 2]}
    for k, ids in table.items():
        w.add(tokenids.key_of(k), tokenids.pack_ids(np.array(ids, "<u4").tobytes()))
    w.add(tokenids.key_of(10**12, 1), tokenids.pack_ids(np.array([5], "<u4").tobytes()))
    w.close()
    r = tokenids.Reader(io.BytesIO(out.getvalue()))
    assert [tokenids.id_of(k) for k, _ in r.scan()] == [*table, 10**12] and len(r.index) > 5
    for k, ids in table.items():
        assert [x.tolist() for x in r.get(k)][0] == ids
    assert r.get(-49) == [] and [x.tolist() for x in r.get(10**12)] == [[70000, 2], [5]]
    bad = bytearray(out.getvalue())
    bad[20] ^= 255
    with pytest.raises(ValueError):
        list(tokenids.Reader(io.BytesIO(bytes(bad))).scan())


def test_quality_verdict_by_hand(spark, docs):
    """References, distances, limits and verdict against plain Python."""
    import math

    refs = quality.fit_references(docs, common=5)
    rows = docs.collect()
    langs = sorted({r.lang for r in rows if r.lang is not None})
    form = lambda w: w.strip(b".,;:!?\"'()").lower()

    def kinds(b):
        c = Counter()
        for x in b.decode():
            o = x.encode()
            c["beyond_ascii" if len(o) > 1 else "lower" if x.islower() else "upper" if x.isupper() else "digit" if x.isdigit() else "space" if o.isspace() else "sentence" if o in b".,;:!?\"'()-" else "symbol" if 32 < ord(x) < 127 else "other"] += 1
        return [c[k] for k in quality.CLASSES]

    share = lambda v: [x / max(1, sum(v)) for x in v]

    def distance(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        d = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a > 0)
        return math.sqrt(max(0.0, (d(p) + d(q)) / 2))

    made = {}
    for lang in langs:
        own = [(r.text or "").encode() for r in rows if r.lang == lang]
        c = Counter(f for b in own for w in b.split() if (f := form(w)))
        top = sorted(c, key=lambda w: (-c[w], w))[:5]
        made[lang] = (share([sum(x) for x in zip(*map(kinds, own), strict=True)]), top, share([*(c[w] for w in top), sum(c.values()) - sum(c[w] for w in top)]))
    assert refs.langs == tuple(langs) and [list(w) for w in refs.words] == [made[x][1] for x in langs]
    limits = quality.word_limits(refs, 60, 0.5)
    got = quality.score_quality(docs, refs).collect()
    texts = {r.doc_id: r.text for r in rows}
    for r in got:
        b = (texts[r.doc_id] or "").encode()
        words = [form(w) for w in b.split()]
        found = []
        for i, lang in enumerate(langs):
            classes, top, shares = made[lang]
            h = [words.count(w) for w in top]
            found.append((distance(share(kinds(b)), classes), distance(share([*h, len(words) - sum(h)]), shares), i))
        k, w, i = min(found, key=lambda x: (round(x[0] + x[1], 9), x[2]))
        assert abs(r.class_distance - k) < 1e-9 and abs(r.word_distance - w) < 1e-9 and r.nearest == langs[i]
        far = (len(b.decode()) >= 200 and k > 0.3) or (len(words) >= 60 and w > limits[i])
        assert r.kept == (not r.base_failed and not far)
        assert r.n_symbols == sum(b.count(x) for x in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))


def test_every_language_has_a_reference(spark):
    rows = [(k, " ".join(f"w{k}x{i % 9}" for i in range(90)), f"x{k:03}") for k in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality.fit_references(df)
    assert len(refs.langs) == 70 and {r.nearest for r in quality.score_quality(df, refs).collect()} == set(refs.langs)


def test_items_of_common_phrases_are_found():
    """Grams that all items share, and hits paired with postings a few at a time."""
    rng = random.Random(21)
    items = ["which of the following statements about the subject is true: " + text_of(rng, 8) for _ in range(90)]
    index = decontam.build_index([(i, t.encode()) for i, t in enumerate(items)], 0.1, 32, often=4)
    assert len(index.gram) < sum(len(t) // decontam.Q for t in index.texts) and (index.need >= 1).all()
    plain = decontam.build_index([(i, t.encode()) for i, t in enumerate(items)], 0.1, 32, often=10**9)
    texts = []
    for _ in range(60):
        p = bytearray(rng.choice(items).encode())
        for _ in range(rng.randint(0, 9)):
            p[rng.randrange(len(p))] = 113
        texts.append(text_of(rng, 5).encode() + b" " + bytes(p) + b" " + text_of(rng, 5).encode())
    whole = decontam.find_items(plain, texts)
    assert decontam.find_items(index, texts) == whole and any(whole)
    few = set(decontam.candidates(plain, texts, most=50))
    assert few == set(decontam.candidates(plain, texts))
    assert all(decontam.budget(n, 0.1) == n // 10 for n in range(32, 2000))


def test_shards_are_read_and_searched_later(spark, docs, empty, tmp_path):
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/shards"
    tokenids.write_shards(docs, path, 2, folder)
    shards = tokenids.manifest(folder)
    assert sum(s["rows"] for s in shards) == docs.count() == tokenids.read_shards(spark, folder).count()
    from tokenizers import Tokenizer

    t, asked = Tokenizer.from_file(path), [3, 0, 39, 105, 104, 777, -1, None, 100]
    got = sorted((str(r.doc_id), list(r.token_ids)) for r in tokenids.lookup(spark.createDataFrame([(x,) for x in asked], "doc_id long"), folder).collect())
    want = sorted((str(r.doc_id), [*t.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect() if r.doc_id in asked)
    assert got == want and len([x for x, _ in got if x == "3"]) == 2
    tokenids.write_shards(empty, path, 2, folder + "-none")
    assert tokenids.manifest(folder + "-none") == [] and tokenids.lookup(docs, folder + "-none").count() == 0


def test_trees_and_isotonic_by_hand():
    """The first tree's splits by trying all; the isotonic fit by the minimax formula."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (300, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (rng.random(300) < 0.1)).astype(float)
    one = toxicity.fit_trees(x, y, rounds=1, depth=1, rate=1.0)
    share = y.mean()
    g, h = share - y, np.full(300, share * (1 - share))
    best = max(((g[x[:, j] <= t].sum() ** 2 / (h[x[:, j] <= t].sum() + 5) + g[x[:, j] > t].sum() ** 2 / (h[x[:, j] > t].sum() + 5), j, t) for j in range(3) for t in range(6)), key=lambda s: s[0])
    (feature, threshold), leaf = one.nodes[0], one.leaves[0]
    left = x[:, feature[0]] <= threshold[0]
    assert (feature[0], set(np.flatnonzero(left))) == (best[1], set(np.flatnonzero(x[:, best[1]] <= best[2])))
    assert np.allclose(leaf, [-g[left].sum() / (h[left].sum() + 5), -g[~left].sum() / (h[~left].sum() + 5)])
    s, y = np.sort(rng.normal(size=60)), rng.integers(0, 2, 60).astype(float)
    px, py = toxicity.fit_isotonic(s, y)
    want = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(np.interp(s, px, py), want)


def test_few_labels_still_score(spark):
    rows = [(i, "you are an idiot" if i % 8 == 0 else "a walk by the river") for i in range(40)] + [(90, None), (91, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(9)).withColumn("fold", F.lit("x"))
    model = toxicity.fit(d, spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(40)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, model).collect()}
    assert model.trees is None and all(got[i].predicted == (i % 8 == 0) for i in range(40)) and got[90].score == got[91].score < 0.5
    assert toxicity.score_toxicity(d.limit(0), model).count() == 0


def test_unigram_equals_the_library():
    """Scores are multiples of 1/64, so the library's single-precision sums are exact; ties occur."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.model_type = 1
    rng = random.Random(12)
    for p in m.pieces:
        if p.type == 1:
            p.score = -rng.randint(2 * 64, 9 * 64) / 64
    raw = m.SerializeToString()
    lib, enc = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.PieceEncoder(pieces.Vocabulary.load(raw))
    alphabet = list("the  an ing éß日本🙂\n\tabcxyz019.-")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [text_of(rng, 60) for _ in range(40)]
    for t, ids in zip(texts, enc.encode(texts, rows=16), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t) and enc.decode(ids).decode() == t


def test_empty_tables(spark, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert pieces.round_trip(empty, path).count() == pieces.encode_documents(empty, path).count() == 0
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == similar.keep_one(empty).count() == 0
    assert lines.dedup_lines(empty).count() == langid.keep_identified(empty).count() == 0


def test_a_session_of_many_machines_needs_a_shared_folder():
    from types import SimpleNamespace

    from marginalia.llm import common

    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://x:7077"):
        session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(RuntimeError):
            common.shared_folder(session, "x")


def test_lines_go_without_a_shuffle_of_texts(spark):
    """Null, empty and repeated texts, null and repeated ids: broadcast keys and shuffled documents give the same, and with
    few keys no text is shuffled."""
    long = ["a line that is long enough to count, number %02d é" % i for i in range(4)]
    texts = [(i % 7, "\n".join([long[0], f"own {i}", long[i % 4].upper(), long[0]])) for i in range(30)]
    docs = spark.createDataFrame([*texts, (None, long[0]), (None, long[1] + "\n" + long[0]), (90, None), (91, ""), (92, long[0])], "doc_id long, text string")

    def rows(batch, keys):
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": batch.column(1), "n": pa.array([lines.kept_text((t or "").encode(), k, 40)[2] for t, k in zip(batch.column(1).to_pylist(), keys)], pa.int64())})

    local, shuffled = (lines.map_lines(docs, rows, "doc_id long, text string, n long", few=few) for few in (500_000, 0))
    got = sorted(map(repr, local.collect()))
    assert got == sorted(map(repr, shuffled.collect())) and sum(r.n for r in local.collect()) > 30
    assert next(r.n for r in local.collect() if r.doc_id == 92) == 0
    plan = lines.line_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_words_in_use_stay_known():
    """What the encoder keeps is bounded, and filling it up doesn't cost the words that are met again."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        encoder = pieces.PieceEncoder(pieces.Vocabulary.load(file.read()), keep=400)
    made, own = [], encoder._new_words
    encoder._new_words = lambda words: (made.extend(words), own(words))[1]
    texts = [f"the common words {' '.join(f'w{i}x{j}' for j in range(40))}" for i in range(60)]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts, rows=2)]
    assert got == sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    assert made.count("▁common") == 1 and len(made) == len(set(made))
    assert len(encoder.known) + len(encoder.before) <= 400


def test_near_copies_go_without_python_or_shuffled_texts(spark, docs):
    """While few rows go, they are left out where they are: a join with Python on both sides of it would hold twice the workers."""
    kept = similar.keep_one(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "SortMergeJoin" not in plan and kept.columns == docs.columns
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "text").collect()), key=repr)
    assert rows(kept) == rows(similar.keep_one(docs, broadcast_rows=0)) and kept.count() < docs.count()
