"""Words before and after seeds find identifiers that no rule and no label knows."""

from quillstream.llm import pii


def test_word_contexts_of_seeds_find_the_rest(spark):
    rows = [(i, f"row {i} his passport number a{i * 7919:07d}bcdef{i:05d}xy was seen") for i in range(12)]
    rows += [(20 + i, f"note {i}, please call me under +49 30 {5550000 + i} or write") for i in range(12)]
    rows += [(50, "some passport number X1234567 here"), (51, "call me under 0301234567 tonight")]
    rows += [(60, "the order 12345678 was late"), (61, "passport number unknown"), (62, "under 0301234599 it lies")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[50] == "secret:21:29" and got[51] == "secret:14:24"
    assert got[60] == got[61] == got[62] == ""  # no context, nothing to take, a single word
    red = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert red[50] == "some passport number [SECRET] here" and red[60] == rows[-3][1]
