from pyspark.sql import functions as F

from fernweh.operators import reading, semantic


def test_query_words_and_hints():
    assert semantic.query_terms("How do I find the Été photos of K7Q2LM?") == ["ete", "k7q2lm"]
    assert semantic.is_lookup(["k7q2lm", "12345"]) and not semantic.is_lookup(["k7q2lm", "bill"]) and not semantic.is_lookup([])
    assert semantic.kind_hints("slides and a photo") == ["image", "slides"]


def test_sentences_and_staleness():
    assert reading.sentences([("as written", 0), ("size", 1), ("all", 1200)]) == ["1 result without the size filter", "1,200 results without filters"]
    assert reading.stale(None, 0, 60) and not reading.stale(0, 10**12, 0) and reading.stale(0, 3_700_000, 60) and not reading.stale(0, 3_500_000, 60)


def test_concepts_are_near():
    v = reading.concept_vectors(["the automobile bill", "car invoice", "puppy holiday"])
    assert v[0] @ v[1] > 0.8 > v[0] @ v[2]


def test_embedding_each_prompt_once(spark):
    p = spark.createDataFrame([("a", "car"), ("a", "car"), ("b", "dog")], "hash string, prompt string")
    assert reading.embedded(p).count() == 2


def test_keys_are_found(spark):
    c = spark.createDataFrame([(1, "-----BEGIN RSA PRIVATE KEY-----\nx"), (2, "a private key"), (3, None)], "id long, data string")
    assert [r.id for r in reading.key_holders(c).collect()] == [1]


def test_retry_window(spark):
    f = spark.createDataFrame([(1, 2, "image", "OCR timed out"), (2, 2, "image", "bad"), (3, 1, "image", "timed out")], "id long, content_state int, kind string, note string")
    assert [r.id for r in reading.retry_due(f, None, 0).collect()] == [1]
    assert reading.retry_due(f, 0, 1000).count() == 0 and reading.retry_due(f, None, 0, full_walk=False).count() == 0


def test_recent_names_fold_case(spark):
    log = spark.createDataFrame([("Foo", 1), ("foo", 3), ("bar", 2), (None, 9)], "name string, at long")
    assert [r.name for r in reading.recent(log, "name", "at").collect()] == ["foo", "bar"]


def test_preview_fold(spark):
    t = spark.createDataFrame([(1, "\n".join(["x"] * 9 + ["hit"] + ["y"] * 9))], "id long, data string")
    lines = [r.line for r in reading.preview(t, lambda x: F.col("id").isNotNull() & (x == "hit"), fold=True).collect()]
    assert lines == [8, 9, 10, 11, 12]
