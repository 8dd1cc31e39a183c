"""Labels, values and tokens of any length are found and taken whole."""

from quillstream.llm import pii


def test_long_values_labels_and_tokens_are_taken_whole(spark):
    known = [(i, f"word number {i} secret = a{i * 7919:07d}bcdef{i:05d}xy and more") for i in range(12)]
    long, label = "k9" * 700, "my-" + "very-" * 12 + "long-key"
    rows = known + [(50, f"here secret = {long} ends")]
    rows += [(60 + i, f"{label}: a{i * 6151:07d}bcdef{i:05d}yx here") for i in range(6)]
    rows += [(70 + i, "see " + "q" * 60 + f"{i:04d}" + "z7" * 120 + " now") for i in range(6)]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[50] == f"secret:14:{14 + len(long)}"
    assert all(got[60 + i] == f"secret:{len(label) + 2}:{len(label) + 22}" for i in range(6))
    assert all(got[70 + i] == "secret:4:308" for i in range(6))
    red = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert red[50] == "here secret = [SECRET] ends" and red[70] == "see [SECRET] now"


def test_labels_are_whole_runs(spark):
    texts = ["--token=abcdef1", "2abc-token: abcdef1", "x_key = 'abcdef1", "ab9-c-d=abcdef1", "-" * 9 + "a" * 30000 + "-a" * 30000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = pii.with_instances(pii.with_base(df, df["text"]), df["text"]).collect()
    got = {r["doc_id"]: [(x["start"], p) for x in r["instances"] for p in x["patterns"] if p.startswith("label")] for r in rows}
    assert got == {0: [(8, "label token =")], 1: [(12, "label abc-token :")], 2: [(9, "label x_key =")], 3: [(8, "label c-d =")], 4: []}
