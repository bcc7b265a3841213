import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from graphloom.llm.quality import quality_rules


def test_pipeline(spark, tmp_path):
    words = [f"the w{k} a{k} b{k}" for k in range(60)]
    clean = "\n".join(words)
    near = clean.replace("b59", "other")
    item = " ".join(f"q{k}" for k in range(40))
    other = "\n".join(f"the v{k} c{k} d{k}" for k in range(60))
    tainted = "\n".join(f"the u{k} e{k} f{k}" for k in range(60)) + "\n" + item
    rows = [(1, clean, "en", "a", 1), (2, near, "en", "a", 1), (3, "short", "en", "a", 1), (4, other, "en", None, None), (5, tainted, None, "b", 1), (6, None, "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), f"t{k}")
        kept.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS), name
    assert kept == [[1, 2, 4, 5], [1, 4, 5], [1, 4, 5], [1, 4], [1, 4]]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.drop("sequence_id", "offset").collect())) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))
    assert whole.agg(F.countDistinct("sequence_id")).first()[0] == 1


def test_quality_repeated_lines(spark):
    line = lambda c, n: " ".join(["the", *(f"{c}{k}" for k in range(n - 1))])
    texts = [f"{line('a', 6)}\n{line('b', 60)}\n{line('a', 6)}", "\n".join([line("c", 10), line("d", 50), *[line("c", 10)] * 3]), f"{line('e', 60)}\n{line('f', 9)}"]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.quality(spark, docs, "").collect()) == [0, 2]
    counts = {r["doc_id"]: (r["n_dup_words"], r["base_failed"]) for r in quality_rules(docs).collect()}
    assert counts == {0: (6, False), 1: (30, False), 2: (0, False)}


def test_near_duplicates_ids(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    near = text("a").replace("a59", "other")
    rows = [
        *((1, text("a"), "en", "s", 1), (1, text("a"), "de", "s", 1), (1, near, "en", "s", 1), (1, text("b"), "en", "s", 1)),  # two of one text, a near one, an unrelated one
        *((2, text("a"), "en", "s", 1), (2, text("c"), "en", None, 1), (3, text("d"), "en", "s", 1)),  # a copy of another id's text
        *((None, text(c), "en", "s", 1) for c in "aaef"),
        *((4, "", "en", "s", 1), (4, None, "en", "s", 1), (4, None, None, "s", 1)),
    ]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    found = lambda x: sorted(map(tuple, corpus_pipeline.near_duplicates(spark, spark.createDataFrame(x, cols), "").collect()), key=repr)
    got = found(rows)
    first = [x for x in got if x[0] == 1 and x[1] != text("b")]
    assert len(first) == 1 and first[0][1:3] in ((text("a"), "de"), (near, "en"))
    rest = [rows[3], *rows[5:12], (4, None, None, "s", 1)]
    assert [x for x in got if x not in first] == sorted(rest, key=repr)
    assert found(rows[::-1]) == got
    alone = [rows[0], (2, near, "en", "s", 1), rows[6], *rows[7:11]]  # no id repeats
    assert found(alone) == sorted([rows[0], rows[6], *rows[7:11]], key=repr)


def test_entry():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline_of_nothing_and_repeats(spark, tmp_path):
    cols = "doc_id long, text string, lang string, source string, n_chars long, row string, kept int"
    text = "\n".join(f"the w{k} a{k} b{k}" for k in range(60))
    other = "\n".join(f"the v{k} c{k} d{k}" for k in range(60))
    for name, rows, want in (("none", [], []), ("some", [(1, text, "en", "a", 1, "r", 2)] * 3 + [(None, other, None, None, None, None, None)] * 2, [1, None])):
        path = tmp_path / name
        spark.createDataFrame(rows, cols).write.parquet(str(path / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
        found = corpus_pipeline.run(spark, str(path)).collect()
        # rows without an id all stay, though the passages that they share go
        assert sorted({r["doc_id"] for r in found}, key=repr) == want
        assert sum(r["doc_id"] is None for r in found) == (2 if rows else 0)
