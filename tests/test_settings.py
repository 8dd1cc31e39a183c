from pyspark.sql import functions as F

from quillstream.functions.numbers import argmax, fixed, kilobytes, softmax
from quillstream.operators import answer, guard, ranking, session
from quillstream.settings import ENCODER, Settings


def test_order_of_sources(spark, monkeypatch):
    monkeypatch.delenv("GOOGLE_API_KEY", raising=False)
    monkeypatch.setenv("RAG_EMBED_MODEL", "")
    assert Settings.from_session() == Settings() and Settings().encoder_model == ENCODER and Settings().generator_key is None
    monkeypatch.setenv("RAG_EMBED_MODEL", "of the environment")
    assert Settings.from_session(spark).encoder_model == "of the environment"
    spark.conf.set("spark.quillstream.encoder_model", "of the session")
    spark.conf.set("spark.quillstream.top_k", "7")
    try:
        got = Settings.from_session(spark)
        assert got.encoder_model == "of the session" and got.top_k == 7
        assert Settings.from_session(spark, top_k=3, encoder_model="given") == Settings(encoder_model="given", top_k=3)
    finally:
        spark.conf.unset("spark.quillstream.encoder_model")
        spark.conf.unset("spark.quillstream.top_k")


def test_printed_numbers(spark):
    xs = [0.01125, 0.0161290322, 1 / 60, -0.00001, 2.0, 0.12345, -4.00005, 1234.5678, 0.99995]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(fixed(F.col("x"))).collect()]
    assert got == [f"{x:.4f}" for x in xs]
    sizes = [0, 511, 512, 1024, 2559, 2560, 10**9]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in sizes], "x bigint").select(kilobytes(F.col("x"))).collect()]
    assert got == ["0KB", "0KB", "1KB", "1KB", "2KB", "3KB", "976563KB"]


def test_softmax(spark):
    row = spark.createDataFrame([([1000.0, 1001.0, 1001.0],)], "e array<double>").select(softmax(F.col("e")).alias("p")).select("p", argmax(F.col("p")).alias("k")).first()
    assert abs(sum(row["p"]) - 1) < 1e-12 and row["k"] == 1 and abs(row["p"][0] - 1 / (1 + 2 * 2.718281828459045)) < 1e-12


def test_warm_up(spark):
    def bad(c):
        raise RuntimeError("no model")

    assert guard.warm_up(spark, classifier=lambda c: F.length(c), judge=bad, silent=lambda c: F.lit(None).cast("string")) == {"classifier": True, "judge": False, "silent": False}


def test_defaults_requests_and_sessions(spark):
    df = spark.createDataFrame([(1, "t", None)], "query_id int, text string, rrf_score double")
    assert ranking.with_defaults(df).first().asDict() == {"query_id": 1, "text": "t", "rrf_score": 0.0, "retrieval_source": "unknown", "semantic_rank": -1, "keyword_rank": -1}
    h = spark.createDataFrame([([("q", "a")],), (None,)], "h array<struct<question:string,answer:string>>")
    got = [r["r"] for r in h.select(answer.request(F.lit("p"), F.col("h")).alias("r")).collect()]
    assert [(m["role"], m["parts"]) for m in got[0]["messages"]] == [("user", ["q"]), ("model", ["a"])] and got[1]["messages"] == []
    assert got[0]["system"] == answer.SYSTEM_PROMPT and got[0]["prompt"] == "p"
    made = session.created(spark.createDataFrame([("s", ["f"]), ("t", [])], "session_id string, filenames array<string>"), spark.createDataFrame([("s", 0, "q0", "a"), ("s", 1, "q1", "a")], "session_id string, turn_no int, question string, answer string"))
    assert session.session(made, "s").first().asDict() == {"session_id": "s", "filenames": ["f"], "history_turns": 2, "last_question": "q1"}
    assert session.session(made, "t").first()["history_turns"] == 0 and session.session(made, "u").count() == 0
