"""Language ID where one label is rare: it is learned whatever the sample's bounds are."""

from reelspark.llm import op5_language

COMMON = "the quick brown fox jumps over that lazy dog with nothing more than this thing".split()
RARE = "zażółć gęślą jaźń przez wszystkie szczęśliwe żółwie chrząszcz brzmi trzcinie".split()


def test_rare_label_is_learned(spark):
    text = lambda words, i, n: " ".join(words[(i * 5 + k * (1 + i % 3)) % len(words)] for k in range(n))
    rows = [(i, text(COMMON, i, 6000 if i < 20 else 30), "en") for i in range(3000)]
    rows += [(9000 + i, text(RARE, i, 25), "pl") for i in range(3)] + [(9100, "123 ...", "pl"), (9101, None, "pl"), (9102, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op5_language.train(docs, rows=60, segments=80)
    assert model.labels == ["en", "pl"]
    probe = spark.createDataFrame([(1, text(RARE, 7, 12), None), (2, text(COMMON, 7, 12), None)], docs.schema)
    assert {r.doc_id: r.lang_pred for r in op5_language.identify(probe, model, ("doc_id",)).collect()} == {1: "pl", 2: "en"}


def test_shares():
    assert op5_language.shares({"a": 1000, "b": 3, "c": 50}, 60) == {"b": 3, "a": 29, "c": 28}
    assert op5_language.shares({"a": 5, "b": 3}, 60) == {"a": 5, "b": 3}
    assert op5_language.shares({"a": 5, "b": 3, "c": 4}, 2) == {"a": 1, "b": 1, "c": 1}
