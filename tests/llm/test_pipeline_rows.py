"""The pipeline's rows that share an id or have none."""

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def texts_of(frame):
    return {(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()}


def words(seed, n=9):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def test_exact_copies_decides_per_row(spark, frame):
    rows = [(None, words(1)), (None, words(2)), (None, words(2)), (None, None), (5, words(3)), (5, words(4)), (5, words(4) + " "), (7, words(3)), (2, words(4))]
    got = corpus_pipeline.exact_copies(spark, frame(rows), DATA)
    assert got.count() == 5
    assert texts_of(got) == {(None, words(1)), (None, words(2)), (None, None), (5, words(3)), (5, words(4) + " ")}


def test_later_stages_decide_per_row(spark, frame):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").filter("text is not null").first().text
    rows = [(None, words(i)) for i in range(4)] + [(None, item), (3, words(5)), (3, item), (4, words(6))]
    clean = {(None, words(i)) for i in range(4)} | {(3, words(5)), (4, words(6))}
    passed = corpus_pipeline.benchmark_passages(spark, frame(rows), DATA)
    assert passed.count() == 6 and texts_of(passed) == clean
    mixed = corpus_pipeline.mixture(spark, passed, DATA)
    assert mixed.count() == 6 and texts_of(mixed) == clean
    assert {r.tokens for r in mixed.select("tokens").collect()} == {9}
