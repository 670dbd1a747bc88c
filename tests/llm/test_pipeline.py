import corpus_pipeline
from deltaloom.llm import quality, substring

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
    rows = [{r.doc_id: r for r in k.collect()} for k in kept]
    assert all(k.columns == docs.columns for k in kept[:-1])
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:], strict=False))
    base = {r.doc_id for r in quality.judged(quality.measure(docs, ["doc_id"]), quality.Rules()).filter("base_failed").collect()}
    assert not base & set(rows[1])
    toxic = {d for d, r in labels.items() if r.toxic} & set(rows[1])
    assert len(toxic & set(rows[2])) <= 0.5 * len(toxic)  # eleven labelled examples teach little
    clean = {d for d, r in labels.items() if r.quality and not r.toxic} & set(rows[1])
    assert len(clean - set(rows[2])) <= 0.05 * len(clean)
    report = {r.doc_id: r.n_removed for r in substring.repeat_report(kept[3]).collect()}
    assert all(len(substring.split_words(rows[4][d].text)) == len(substring.split_words(rows[3][d].text)) - n for d, n in report.items())
    assert all(r.n_chars == len(r.text) for r in rows[4].values())
    assert set(rows[5]) == set(rows[4])
    again = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, again.collect())) == sorted(map(key, kept[-1].collect()))
