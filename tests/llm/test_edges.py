"""Every operator on odd rows and on empty tables."""

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from voxelspark.llm import ann, bpe, common, html, lm, mixing, pii, quality, rules, simhash, tokenbin

BPE = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def tokens(spark, docs):
    return tokenbin.read(tokenbin.write(docs, common.work_dir(spark, "t"), P.path("word_bpe_49k.json"), end=2))


def test_token_files(spark, odd, empty):
    rows = tokens(spark, odd).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect()
    assert len(rows) == 10 and [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8]
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    assert rows[4].n_tokens == rows[5].n_tokens == 1
    assert tokens(spark, empty).count() == 0


def test_quality(spark, odd, empty, labels):
    model = quality.train(odd, labels, "quality", quality.Settings(buckets=1 << 10, epochs=2))
    got = odd.select("doc_id", quality.score(F.col("text"), model).alias("s")).collect()
    assert len(got) == 10 and all(0 <= r.s <= 1 for r in got)
    assert len({r.s for r in got if r.doc_id in (3, 4)}) == 1
    none = quality.train(empty, labels, "quality", quality.Settings(buckets=1 << 10))
    assert {r[0] for r in odd.select(quality.score(F.col("text"), none)).collect()} == {0.5}
    assert empty.select(quality.score(F.col("text"), model)).count() == 0


def test_mixing(spark, odd, empty, labels):
    got = mixing.mix(odd, mixing.labelled(labels), mixing.WEIGHTS).rows.collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 for r in got)
    taken = mixing.take(odd, mixing.mix(odd, mixing.labelled(labels), mixing.WEIGHTS, most=1.0).rows)
    assert taken.columns == odd.columns and taken.count() <= 10
    assert mixing.mix(empty, mixing.labelled(labels), mixing.WEIGHTS).rows.count() == 0
    alone = mixing.mix(odd, mixing.labelled(labels.limit(0)), mixing.WEIGHTS).rows.collect()
    assert len(alone) == 9


def test_language_model(spark, odd, empty):
    model = lm.build(odd)
    got = odd.select("doc_id", lm.score(F.col("text"), model).alias("s")).select("doc_id", "s.*").collect()
    assert len(got) == 10 and all(r.score < 0 and r.n_known == r.n_tokens for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4)} == {1}
    none = lm.build(empty)
    assert {(r.score, r.base_score, r.n_known) for r in odd.select(lm.score(F.col("text"), none).alias("s")).select("s.*").collect()} == {(0.0, 0.0, 0)}
    assert empty.select(lm.score(F.col("text"), model)).count() == 0


def test_simhash(spark, odd, empty):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.groups(odd).collect()}
    by = {d: (fp, c) for (d, fp), c in got.items()}
    assert simhash.groups(odd).count() == 10
    assert by[3] == by[4] == (0, 3) and by[1][1] == by[2][1] == 1
    kept = simhash.keep_first(odd, simhash.groups(odd))
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 7, 8]
    assert simhash.groups(empty).count() == 0 and simhash.keep_first(empty, simhash.groups(empty)).count() == 0


def test_byte_bpe(spark, odd, empty):
    got = bpe.decode(bpe.encode(odd, *BPE), *BPE).collect()
    texts = sorted((r.text or "").encode() for r in odd.collect())
    assert sorted(bytes(r.decoded) for r in got) == texts
    assert bpe.decode(bpe.encode(empty, *BPE), *BPE).count() == 0


def test_rules(spark, odd, empty, labels):
    for docs, n in ((odd, 10), (empty, 0)):
        counted = common.stored(spark, rules.counts(docs), "c")
        got = rules.judge(counted, common.stored(spark, rules.cutoffs(counted, labels), "k")).collect()
        assert len(got) == n and all(not r.kept for r in got if r.base_failed)


def test_personal_data(spark, odd, empty):
    common.workers_import(spark)
    got = {r.doc_id: [tuple(s) for s in r.f] for r in odd.select("doc_id", pii.find(F.col("text")).alias("f")).collect()}
    assert [k for k, *_ in got[8]] == ["email", "ip", "card", "phone"] and got[3] == got[4] == got[5] == []
    texts = {r.doc_id: r.t for r in odd.select("doc_id", pii.redact(F.col("text")).alias("t")).collect()}
    assert texts[8] == "Mail <EMAIL>, call <PHONE> or <IP>; card <CARD>!" and texts[4] is None and texts[3] == ""
    assert empty.select(pii.find(F.col("text"))).count() == 0


PAGES = "page_id long, url string, html string, text string, host string"


def test_main_text(spark):
    page = "<html><body><div class=cookie>We use</div><header>H</header><main><h1>T &amp; t</h1><p>One\n two<br>three <b>fo</b>ur<p>five&nbsp;&lt;</main><aside>s</aside><script>x('</main>')</script>"
    rows = [(1, "https://a.example/1", page, "x", None), (1, "https://a.example/1", page, "x", None), (2, None, None, None, "y"), (3, "", "", None, None), (None, "no url", "plain text", None, None), (4, "https://b.example", "<p>" * 3000 + "deep", None, None)]
    got = html.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == 6 and got[0].__fields__ == ["page_id", "url", "text"]
    assert {r.text for r in got if r.page_id == 1} == {"T & t One two three four five <"}
    assert {r.text for r in got if r.page_id in (2, 3)} == {""} and [r.text for r in got if r.page_id is None] == ["plain text"]
    assert html.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_neighbours(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 9, 1.0), (20, 1, 2, 2.0), (20, 2, 1, 1.0), (20, 3, 9, 1.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_shared_folder_is_the_session_s(spark):
    class Unset:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "local[2]"

    root = spark.conf.get("spark.checkpoint.dir", None)
    assert common.work_dir(spark, "x").startswith(root or "file:///")
    assert common.shared_dir(Unset) == common.shared_dir(Unset) and common.shared_dir(Unset).startswith("file:///")


def test_pipeline_stages(spark, odd, empty, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    clashing = {c: F.lit(k) for k, c in enumerate(("extra", "copies", "_id", "_copy", "bucket", "n", "root", "component_id", "p", "rate"))}
    for docs in (odd.withColumns(clashing), empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, docs = docs, common.stored(spark, stage(spark, docs, str(tmp_path)), "s")
            assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == before.columns
            assert docs.count() <= before.count()


def test_a_repeated_id_teaches_once(spark, odd, labels):
    s = quality.Settings(buckets=1 << 10, epochs=2)
    once = odd.where("doc_id in (1, 5, 6, 8)")
    again = once.unionByName(once.where("doc_id = 5").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("x"))
    a, b = (quality.train(rows, labels, "quality", s) for rows in (once, again))
    assert a.bias == b.bias and (a.weights == b.weights).all()
