import corpus_pipeline
from marginalia.llm import decontam, pieces, simhash
from marginalia.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert set(got) == set(rows) and len(got) < docs.count()
    fps = [simhash.fingerprint(t.encode()) for t in rows.values()]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])
    index = decontam.build_index([(r.item_id, r.text.encode()) for r in table(spark, SF, "benchmark").collect()], 0.1, 32)
    assert not any(decontam.find_items(index, [t.encode() for t in rows.values()]))
    import numpy as np
    import public_tokenizers

    enc = pieces.PieceEncoder(pieces.Vocabulary.load(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()))
    assert all(enc.decode(np.array(got[i], "<u4").tobytes()).decode() == t for i, t in rows.items())


CLASHES = ("__keys", "__drop_id", "__stay", "side_id", "side_value", "stays", "keys", "node", "root", "fp", "key", "bands", "found", "ids", "start", "lang_pred", "batch")


def odd_documents(spark):
    """Null and empty texts, null and repeated ids, a long text with the shingles of another, clashing columns."""
    text = table(spark, SF, "documents").where("lang = 'en' and length(text) > 600").orderBy("doc_id").first().text
    rows = [(1, None, "en"), (2, "", "en"), (3, text, "en"), (3, text, "en"), (None, "a text without an identifier, of some words", None), (4, " \n\t ", None), (5, text * 40, "en"), (6, "x", "en"), (7, text[:300], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as int) as n_chars", *[f"'c' as `{c}`" for c in CLASHES])


def test_stages_keep_odd_rows(spark):
    docs = odd_documents(spark)
    want = {"language_id": {3, None, 5, 6, 7}, "line_dedup": {1, 2, 3, None, 4, 5, 6, 7}, "simhash_near_dedup": {1, 3, None, 6, 7}, "benchmark_decontamination": {1, 2, 3, None, 4, 5, 6, 7}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert {r.doc_id for r in rows} == want[name], name
        assert all(r["__keys"] == "c" and r["batch"] == "c" for r in rows)
        before = {(r.doc_id, r.text) for r in docs.collect()}
        assert {(r.doc_id, r.text) for r in rows} <= before, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(encoded) == docs.count() and {r.n_tokens for r in encoded if r.doc_id in (1, 2)} == {0}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_rejected_languages_and_repeats_go(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    more = docs.where("length(text) > 400").orderBy("doc_id").limit(1).selectExpr("cast(900001 as long) as doc_id", "text", "lang", "source", "n_chars")
    junk = spark.createDataFrame([(900002, "1234 5678 !!! " * 40, "en", "s", 1)], docs.schema)
    both = docs.unionByName(more).unionByName(junk)
    assert corpus_pipeline.language_id(spark, both, SF).where("doc_id = 900002").count() == 0
    assert corpus_pipeline.near_dedup(spark, both, SF).where("doc_id = 900001").count() == 0
