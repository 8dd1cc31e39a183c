import math

from pyspark.sql import functions as F

from quillstream.operators import answer, index, ranking, retrieval, session

MINI = ["red fox jumps", "red red hen", "blue hen sleeps late", "green frog red", "grey owl"]


def chunks(spark, texts=MINI):
    rows = [(i, t, i + 1, [math.cos(i), math.sin(i)]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_ord bigint, text string, page_number int, embedding array<double>")


def asked(spark, *questions):
    return spark.createDataFrame([(i, q, [1.0, 0.0]) for i, q in enumerate(questions)], "query_id bigint, question string, vector array<double>")


def test_bm25_mini_corpus(spark):
    ix = index.Index(chunks(spark))
    assert (ix.n, ix.avgdl) == (5, 3.0)
    idf = {r["term"]: round(r["idf"], 6) for r in ix.terms.collect()}
    assert (idf["red"], idf["hen"], idf["owl"]) == (0.224716, 0.336472, 1.098612)
    got = {(r["query_id"], r["chunk_ord"]): round(r["score"], 6) for r in ix.scores(asked(spark, "red hen", "hen hen", "zzz")).collect()}
    assert got == {(0, 0): 0.224716, (0, 1): 0.657495, (0, 2): 0.292585, (0, 3): 0.224716, (1, 1): 0.672944, (1, 2): 0.585169}
    ranks = sorted((r["query_id"], r["keyword_rank"], r["chunk_ord"]) for r in retrieval.keyword_ranks(ix, asked(spark, "red hen", "zzz"), 20).collect())
    assert [c for q, _, c in ranks if q == 0] == [1, 2, 0, 3, 4] and [c for q, _, c in ranks if q == 1] == [0, 1, 2, 3, 4]


def test_fusion_scores_sources_and_missing_ranks(spark):
    c = spark.createDataFrame([(0, "A", 1), (1, "B", 2), (2, "C", 3)], "chunk_ord bigint, text string, page_number int")
    s = spark.createDataFrame([(0, 0, "A", 1, 0), (0, 1, "B", 2, 1)], "query_id bigint, chunk_ord bigint, text string, page_number int, semantic_rank int")
    k = spark.createDataFrame([(0, 1, "B", 2, 0), (0, 2, "C", 3, 1)], "query_id bigint, chunk_ord bigint, text string, page_number int, keyword_rank int")
    got = retrieval.fuse(s, k, c, 20).orderBy("cand_ord").collect()
    assert [(r["text"], round(r["rrf_score"], 8), r["retrieval_source"]) for r in got] == [("B", 0.01650273, "hybrid"), ("A", 0.01333333, "semantic"), ("C", 0.01155738, "keyword")]
    assert (got[1]["keyword_rank"], got[2]["semantic_rank"]) == (-1, -1)


def test_equal_texts_take_the_last_rank_and_pages(spark):
    c = spark.createDataFrame([(0, "T", 9), (1, "U", 4), (2, "T", 4), (3, "K", 9), (4, "K", 4)], "chunk_ord bigint, text string, page_number int")
    s = spark.createDataFrame([(0, 0, "T", 9, 3), (0, 2, "T", 4, 7)], "query_id bigint, chunk_ord bigint, text string, page_number int, semantic_rank int")
    k = spark.createDataFrame([(0, 3, "K", 9, 0)], "query_id bigint, chunk_ord bigint, text string, page_number int, keyword_rank int")
    got = {r["text"]: r for r in retrieval.fuse(s, k, c, 20).collect()}
    assert (got["T"]["semantic_rank"], got["T"]["page_number"], got["K"]["page_number"]) == (7, 4, 9)


def test_empty_collection(spark):
    c = chunks(spark).limit(0)
    assert retrieval.semantic_query(c, asked(spark, "x")).count() == 0


def test_gate_is_inclusive(spark):
    q = asked(spark, "a", "b", "c")
    rows = spark.createDataFrame([(0, -2.0, 0), (1, -2.0000001, 0)], "query_id bigint, rerank_score double, final_ord int")
    got = {r["query_id"]: (r["best_score"], r["is_relevant"]) for r in ranking.gate(q, rows).collect()}
    assert got == {0: (-2.0, True), 1: (-2.0000001, False), 2: (float("-inf"), False)}


def test_rerank_is_stable(spark):
    rows = spark.createDataFrame([(0, "q", t, i) for i, t in enumerate(["x", "q", "q"])], "query_id bigint, question string, text string, cand_ord int")
    got = ranking.rerank(rows, 2).orderBy("final_ord").collect()
    assert [(r["cand_ord"], r["rerank_score"]) for r in got] == [(1, 2.0), (2, 2.0)]


def test_answers(spark):
    ix = index.Index(chunks(spark))
    got = {r["query_id"]: r for r in answer.answer_questions(ix, asked(spark, "red hen", "nothing known of this at all here", "jailbreak now"), candidate_k=5, k=2).collect()}
    assert got[0]["status"] == "answered" and got[0]["answer"] == "red red hen [Sources: Pages 2, 3]" or got[0]["answer"].startswith("red red hen [Sources: Pages ")
    assert got[1]["status"] == "irrelevant" and got[1]["answer"] == answer.NOT_FOUND and len(got[1]["candidates"]) == 5 and got[1]["final_chunks"] is None
    assert got[2]["status"] == "blocked" and got[2]["candidates"] is None
    assert len(got[0]["final_chunks"]) == 2 and got[0]["final_chunks"][0]["rerank_score"] == 2.0


def test_plugged_scorer(spark):
    ix = index.Index(chunks(spark))
    got = answer.answer_questions(ix, asked(spark, "red hen"), candidate_k=5, k=2, scorer=lambda q, t: F.length(t)).first()
    assert [c["text"] for c in got["final_chunks"]] == ["blue hen sleeps late", "green frog red"]


def test_prompt_and_citations(spark):
    cs = F.array(*[F.struct(F.lit(p).alias("page_number"), F.lit(t).alias("text")) for p, t in ((3, "x"), (0, "y"), (5, ""))])
    none = F.filter(cs, lambda c: F.lit(False))
    pages = F.array(F.lit(10), F.lit(2), F.lit(10))
    r = spark.range(1).select(answer.context(cs).alias("a"), answer.context(none).alias("b"), answer.citation(pages).alias("c"), answer.citation(F.array().cast("array<int>")).alias("d"), answer.without_source(F.lit("abc Source: page 1")).alias("e"), answer.shown(F.lit("z" * 251)).alias("f")).first()
    assert tuple(r)[:5] == ("[Page 3]\nx\n\n[Page ?]\ny", "[No retrieved context]", " [Sources: Pages 2, 10]", "", "abc")
    assert r["f"] == "z" * 250 + "..."


def test_followups_and_history(spark):
    qs = ["What is the stock of item X?", "What about item Y?", "Which supplier ships the most units in Europe?", "and totals for the northern region this year", "Total price please", "q6 is a long question of its own", "q7 is a long question of its own"]
    turns = spark.createDataFrame([("s", i, q, f"a{i}") for i, q in enumerate(qs)], "session_id string, turn_no bigint, question string, answer string")
    got = {r["turn_no"]: r["resolved"] for r in session.resolve(turns).collect()}
    assert got[1] == f"{qs[0]} {qs[1]}" and got[2] == qs[2] and got[3] == f"{qs[2]} {qs[3]}" and got[4] == f"{qs[3]} {qs[4]}" and got[0] == qs[0]
    h = {r["turn_no"]: [t["question"] for t in r["history"]] for r in session.history(turns).collect()}
    assert h[6] == qs[1:6] and h[0] == []
    m = session.history(turns).filter("turn_no = 1").select(session.messages(F.col("history")).alias("m")).first()["m"]
    assert [(x["role"], x["parts"]) for x in m] == [("user", [qs[0]]), ("model", ["a0"])]
    new = spark.createDataFrame([("s", "n1", "x", 0), ("t", "n2", "y", 0)], "session_id string, question string, answer string, order int")
    both = {(r["session_id"], r["turn_no"]) for r in session.append_turns(turns, new).collect()}
    assert ("s", 7) in both and ("t", 0) in both


def test_reindex_and_names(spark):
    up = spark.createDataFrame([("s", 0, ["b", "a"]), ("s", 1, ["a", "b"]), ("s", 2, ["a"])], "session_id string, upload_no int, filenames array<string>")
    assert [r["reindex"] for r in session.needs_reindex(up).orderBy("upload_no").collect()] == [True, False, True]
    names = spark.createDataFrame([("My File!.pdf",), ("a.pdf",), ("!!.pdf",)], "f string").select(index.collection_name(F.col("f")).alias("n")).collect()
    assert [r["n"] for r in names] == ["My_File", "doc_a", "doc_file"]


def test_vectors_are_appended_by_session(spark, tmp_path):
    path = f"file://{tmp_path}/vectors"
    rows = chunks(spark).withColumn("session_id", F.lit("s1"))
    index.write_vectors(rows, path)
    index.write_vectors(rows.withColumn("session_id", F.lit("s2")), path)
    index.reset_session(spark, path, rows.limit(2))
    got = {r["session_id"]: r["count"] for r in spark.read.parquet(path).groupBy("session_id").count().collect()}
    assert got == {"s1": 2, "s2": 5}
