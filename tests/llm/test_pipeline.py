def test_stages(spark, documents, tmp_path):
    import corpus_pipeline

    body = " ".join(f"word{k} of some text" for k in range(40))
    item = " ".join(f"item{k}" for k in range(11))
    rows = [(k, f"{body} number {k} with more words {k * 7} about thing {k}.\nEnd {' '.join(f'x{k}y{j}' for j in range(200))}", "en", f"s{k % 2}") for k in range(30)]
    rows += [(100, rows[3][1], "en", "s0"), (101, rows[4][1] + " tail", "en", "s0"), (102, f"clean text {item} more text " * 2, "en", "s1"), (103, "12345", "en", "s1"), (104, None, None, None)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sf_dir = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"stage{k}"))
            docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
            kept.append({r.doc_id for r in docs.collect()})
    everyone = {r[0] for r in rows}
    assert everyone - kept[0] == {103, 104}
    assert kept[0] - kept[1] == {100, 101}
    assert kept[1] - kept[2] == {102}
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r.doc_id for r in final.collect()} == kept[3] and final.count() == docs.count()
    again = lambda: sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert again() == sorted(map(tuple, final.collect()))


def test_stages_take_any_column_and_any_row(spark, documents, tmp_path):
    import corpus_pipeline

    item = " ".join(f"item{k}" for k in range(11))
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(k, text(k), "en", f"s{k % 2}") for k in range(12)] + [(3, text(3), "en", "s1"), (4, text(40), "en", "s0"), (None, text(50), "en", None), (None, text(50), "en", None), (None, text(2), "en", "s0"), (20, item, "en", "s0")]
    names = ("copy", "_id", "_times", "_copy", "row", "key", "hash", "source_size", "several", "n")
    docs = documents(rows, clash=names)
    docs.limit(0).write.parquet(str(tmp_path / "nothing"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sf_dir = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    empty = spark.read.parquet(str(tmp_path / "nothing"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, sf_dir).count() == 0
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"any{k}"))
            docs = spark.read.parquet(str(tmp_path / f"any{k}"))
        if k == 1:
            kept = sorted((str(r.doc_id), r.text[:3]) for r in docs.collect())
            # a row a document and text: one of each id, one of the two equal texts without id; text 2 stands under its id or under its hash
            assert len(kept) == 14 and sum(t == "w50" for _, t in kept) == 1 and sum(t == "w2x" for _, t in kept) == 1
        if k == 2:
            assert not docs.where("doc_id = 20").count()
