"""Language filters keep n-grams by one rule at every size."""

from cuesta.llm import langid


def test_single_grams_stay_above_any_count(spark):
    # about 48,000 n-grams of one word over and over, and a word that occurs once
    docs = spark.createDataFrame([("abcd " * 12000 + "wxyz", "aa"), ("efgh", "bb")], "text string, lang string")
    model = langid.fit(docs)
    names, score = model.predict(["wxyz", "efgh"])
    assert names == ["aa", "bb"]
    assert score[0] > 0.5
