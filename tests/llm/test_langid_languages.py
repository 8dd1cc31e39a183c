"""Every language of the labelled rows is learned, however rare it is."""

from quillstream.llm import langid


def test_rare_languages_are_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 20)
    rows = [(i, f"abcd eadb cabe {i}", "one") for i in range(600)] + [(1000 + i, f"zyxw vwyx {i}", "rare") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    languages, _ = langid.learn(df)
    assert languages == ["one", "rare"]


def test_sample_takes_the_smallest_hashes_of_each_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 20)
    monkeypatch.setattr(langid, "LANGUAGE_ROWS", 4)
    rows = [("one", i * 2**53) for i in range(-900, 900)] + [("rare", 7)] * 300 + [("rare", 100 + i) for i in range(9)] + [("few", 1)]
    got = langid.chosen(spark.createDataFrame(rows, "lang string, h bigint"))
    assert [h for lang, h in got if lang == "one"] == [i * 2**53 for i in range(-900, -894)]
    # repeated rows are one
    assert [h for lang, h in got if lang == "rare"] == [7, 100, 101, 102, 103, 104]
    assert [h for lang, h in got if lang == "few"] == [1]


def test_the_driver_gets_segments_of_long_texts(spark):
    rows = [(i, ("abcde " if i % 2 else "vwxyz ") * 50_000, "one" if i % 2 else "two") for i in range(6)] * 2
    languages, network = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert languages == ["one", "two"] and network is not None
