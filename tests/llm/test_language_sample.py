"""The sample that the text model is fitted on."""

from graphloom.llm import language_id


def test_every_label_and_no_copies(spark):
    """One text with most of the rows, and a label with one row in 4,000."""
    rows = [("the and of " * 5, "en")] * 3000 + [(f"the and {i} of", "en") for i in range(990)] + [(f"der die {i}", "de") for i in range(9)] + [("le la les des", "fr")]
    df = spark.createDataFrame([*rows, ("", "it"), (None, "it"), ("x", None)], "text string, lang string").repartition(4)
    got = [tuple(r) for r in language_id.sample(df, train_rows=40).collect()]
    assert len(set(got)) == len(got) <= 40 and set(got) <= set(rows)
    assert {x: sum(lang == x for _, lang in got) for x in ("en", "de", "fr")} == {"en": 13, "de": 9, "fr": 1}
    assert language_id.fit(df, train_rows=40).languages == ["de", "en", "fr"]
    assert language_id.fit(df, train_rows=1).languages == ["de", "en", "fr"]
