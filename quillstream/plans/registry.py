"""Registered queries of the retrieval engine: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import argmax, fixed, kilobytes, softmax
from ..functions.tables import register
from ..functions.text import bind
from ..operators import answer, approximate, chunking, collection, guard, index, ranking, retrieval, session
from ..sources.documents import accepted_upload, client_accepted, item_page, item_pages, layout_pages, read_attempts, read_documents, read_files
from ..store import new_folder, tidy
from .inputs import attacked, chat_questions, corpus, corpus_texts, docx_files, in_sessions, layouts, marked, markdown, questions, table, turns
from .sql import FILES, SQL


def _index(spark, sf_dir):
    return index.Index(corpus(spark, sf_dir), texts=corpus_texts(spark, sf_dir))


def _session_index(spark, sf_dir):
    return index.Index(in_sessions(spark, sf_dir, corpus(spark, sf_dir)), texts=in_sessions(spark, sf_dir, corpus_texts(spark, sf_dir)))


def sanitize_documents(spark, sf_dir):
    df = attacked(spark, sf_dir).withColumn("z", guard.sanitize(F.col("text")))
    return df.select("doc_id", F.col("z.text").alias("text"), (F.col("z.n") > 0).alias("was_modified"))


def redaction_counts(spark, sf_dir):
    df = attacked(spark, sf_dir).select(guard.sanitize(F.col("text"))["n"].cast("long").alias("n_redactions"))
    return df.groupBy("n_redactions").agg(F.count("*").alias("n_documents"))


def normalize_text(spark, sf_dir):
    return attacked(spark, sf_dir).select("doc_id", guard.normalize(F.col("text")).alias("text"))


def guard_regex_flag(spark, sf_dir):
    df = attacked(spark, sf_dir).withColumn("reason", bind(guard.normalize(F.col("text")), lambda n: guard.regex_reason(F.col("text"), n)))
    return df.select("doc_id", F.col("reason").isNotNull().alias("is_injection"), "reason")


def guard_synonym(spark, sf_dir):
    return attacked(spark, sf_dir).select("doc_id", guard.synonym_reason(F.col("text")).alias("reason"))


def guard_subtle(spark, sf_dir):
    hits = guard.subtle_hits(F.col("text"))
    return attacked(spark, sf_dir).withColumn("h", hits).select("doc_id", F.size("h").alias("n_hits"), F.array_join("h", "|").alias("hits"))


def guard_cascade_no_ml(spark, sf_dir):
    return guard.verdicts(attacked(spark, sf_dir), "text").select("doc_id", "verdict.*")


def scan_chunks_split(spark, sf_dir):
    df = guard.scan(attacked(spark, sf_dir), "text")
    return df.groupBy("injection_flagged").agg(F.count("*").alias("n_chunks"), F.min("doc_id").alias("first_doc"), F.max(F.length("text")).alias("longest"))


def fail_open_filter(spark, sf_dir):
    # pairs: one in eight is flagged as a whole
    df = attacked(spark, sf_dir).withColumn("grp", F.floor(F.col("doc_id") / 2).cast("bigint"))
    return guard.fail_open(guard.scan(df, "text"), "grp").select("grp", "doc_id")


def validate_queries(spark, sf_dir):
    return attacked(spark, sf_dir).withColumn("v", guard.query_validity(F.col("text"))).select("doc_id", "v.ok", "v.reason")


def heading_split(spark, sf_dir):
    return markdown(spark, sf_dir).select("doc_id", F.posexplode(chunking.sections(F.col("text"))).alias("section_ord", "section"))


def block_split(spark, sf_dir):
    return heading_split(spark, sf_dir).select("doc_id", "section_ord", F.posexplode(chunking.blocks(F.col("section"))).alias("block_ord", "block"))


def table_detect(spark, sf_dir):
    df = block_split(spark, sf_dir).select(chunking.is_table(F.col("block")).alias("is_table"), F.length("block").alias("n"))
    return df.groupBy("is_table").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_chars"))


def greedy_pack(spark, sf_dir):
    long = heading_split(spark, sf_dir).filter(F.length("section") > chunking.CHUNK_SIZE)
    pieces = long.select("doc_id", "section_ord", F.posexplode(chunking.section_chunks(F.col("section"))).alias("piece_ord", "c"))
    return pieces.select("doc_id", "section_ord", "piece_ord", F.col("c.kind").alias("chunk_type"), F.col("c.text").alias("text"))


def _chunks(spark, sf_dir, cap=chunking.MAX_CHUNKS):
    pages = markdown(spark, sf_dir).select(F.col("doc_id").alias("file_ord"), F.lit(1).alias("page_number"), "text")
    return chunking.chunk_pages(pages, max_chunks=cap)


def chunk_pages(spark, sf_dir):
    return _chunks(spark, sf_dir).select(F.col("file_ord").alias("doc_id"), "chunk_ord", "chunk_type", "text")


def page_marker_split(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", F.inline(chunking.marked_pages(F.col("text"))))


def virtual_pages(spark, sf_dir):
    return markdown(spark, sf_dir).select("doc_id", F.inline(chunking.virtual_pages(F.col("text"))))


def multi_file_cap(spark, sf_dir):
    chunks = _chunks(spark, sf_dir).withColumn("session_id", F.floor(F.col("file_ord") / 20).cast("bigint"))
    return chunking.cap_files(chunks, "session_id").select("session_id", F.col("file_ord").alias("doc_id"), "chunk_ord", "text")


def bm25_terms(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def incremental_terms(spark, sf_dir):
    # every document is a file; at first a fifth has an older text and there are other files besides
    d = table(spark, sf_dir, "documents").select(F.lit("s").alias("session_id"), F.col("doc_id").cast("string").alias("file_id"), F.lit(0).alias("chunk_no"), F.lit(1).alias("page_number"), "text", F.lit(None).cast("array<float>").alias("embedding"))
    older = d.withColumn("text", F.when(F.col("file_id").cast("long") % 5 == 0, F.concat(F.lit("older words "), F.reverse("text"))).otherwise(F.col("text")))
    other = d.filter("file_id % 3 = 0").withColumns({"file_id": F.concat(F.lit("other "), F.col("file_id")), "text": F.concat("text", F.lit(" other words"))})
    stored = collection.Collection(spark, new_folder(spark, "collection"))
    stored.change(older.unionByName(other))
    stored.change(d, other)
    return stored.index().terms.select("term", "df", F.round("idf", 6).alias("idf"))


def compacted_terms(spark, sf_dir):
    # a document is a file; they come in five changes, the last of which takes the words before them away
    d = table(spark, sf_dir, "documents").select(F.lit("s").alias("session_id"), F.col("doc_id").cast("string").alias("file_id"), F.lit(0).alias("chunk_no"), F.lit(1).alias("page_number"), "text", F.lit(None).cast("array<float>").alias("embedding"))
    stored = collection.Collection(spark, new_folder(spark, "collection"))
    for k in range(4):
        stored.change(d.filter(F.col("file_id").cast("long") % 4 == k).withColumn("text", F.concat(F.lit("older words "), F.reverse("text")) if k == 3 else F.col("text")))
    stored.change(d.filter("cast(file_id AS long) % 4 = 3"))
    stored.compact()
    stored.vacuum()
    # from the postings: nothing that went is left in them
    return index.vocabulary(stored.postings()).filter("term <> ''").select("term", F.col("df").cast("bigint").alias("df"))


def bm25_topk(spark, sf_dir):
    return retrieval.keyword_ranks(_index(spark, sf_dir), questions(spark, sf_dir), 60).select("query_id", "chunk_ord", "keyword_rank")


def semantic_topk(spark, sf_dir):
    return retrieval.semantic_ranks(corpus(spark, sf_dir), questions(spark, sf_dir), 5).select("query_id", "chunk_ord", "semantic_rank")


def approximate_topk(spark, sf_dir):
    lists, asked = approximate.VectorLists(corpus(spark, sf_dir)), questions(spark, sf_dir)
    found = approximate.approximate_ranks(lists, asked, 60, approximate.tuned(lists, asked, 60))
    return found.select("query_id", "chunk_ord", "semantic_rank")


def approximate_recall(spark, sf_dir):
    chunks, asked = corpus(spark, sf_dir), questions(spark, sf_dir)
    lists = approximate.VectorLists(chunks)
    found = approximate.recall(retrieval.semantic_ranks(chunks, asked, 60), approximate.approximate_ranks(lists, asked, 60, approximate.tuned(lists, asked, 60)))
    return found.agg(F.count("*").alias("n_questions"), F.sum("n").alias("n_rows"), (F.sum("found") >= F.sum("n") * 0.9).alias("enough"))


def rrf_fusion(spark, sf_dir):
    return retrieval.hybrid_query(_index(spark, sf_dir), questions(spark, sf_dir), 5).select("query_id", "text", "retrieval_source", F.round("rrf_score", 9).alias("rrf_score"), "cand_ord")


def hybrid_query(spark, sf_dir):
    return retrieval.hybrid_query(_index(spark, sf_dir), questions(spark, sf_dir), 20).withColumn("rrf_score", F.round("rrf_score", 9))


def _final(spark, sf_dir):
    asked = questions(spark, sf_dir)
    candidates = retrieval.hybrid_query(_index(spark, sf_dir), asked, 20).join(asked.select("query_id", "question"), "query_id")
    return asked, ranking.rerank(candidates, 5)


def rerank_topk(spark, sf_dir):
    return _final(spark, sf_dir)[1].select("query_id", "text", "page_number", F.round("rerank_score", 9).alias("rerank_score"), "final_ord")


def relevance_gate(spark, sf_dir):
    out = ranking.gate(*_final(spark, sf_dir), threshold=ranking.LEXICAL_THRESHOLD)
    return out.withColumn("best_score", F.round("best_score", 9))


def followup_resolve(spark, sf_dir):
    return session.resolve(turns(spark, sf_dir)).select("session_id", "turn_no", "resolved")


def history_last5(spark, sf_dir):
    lines = F.transform("history", lambda t: F.concat(t["question"], F.lit("\n"), t["answer"]))
    return session.history(turns(spark, sf_dir)).select("session_id", "turn_no", F.size("history").alias("n_history"), F.array_join(lines, "\n").alias("history"))


def history_messages(spark, sf_dir):
    parts = F.transform(session.messages(F.col("history")), lambda m: F.concat(m["role"], F.lit("="), m["parts"][0]))
    return session.history(turns(spark, sf_dir)).select("session_id", "turn_no", F.array_join(parts, "|").alias("messages"))


def session_counts(spark, sf_dir):
    return session.sessions(turns(spark, sf_dir))


def prompt_build(spark, sf_dir):
    asked, final = _final(spark, sf_dir)
    chunks = answer.grouped(final, "final_ord", "chunks", "text", "page_number")
    empty = F.array().cast("array<struct<final_ord:int,text:string,page_number:int>>")
    rows = asked.join(chunks, "query_id", "left").withColumn("chunks", F.coalesce("chunks", empty))
    return rows.select("query_id", answer.prompt(F.col("question"), F.col("chunks")).alias("prompt"))


def source_strip(spark, sf_dir):
    said = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" Source: page "), F.col("doc_id").cast("string"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", answer.without_source(said).alias("answer"))


def source_pages(spark, sf_dir):
    pages = _final(spark, sf_dir)[1].groupBy("query_id").agg(F.collect_set("page_number").alias("p"))
    return pages.select("query_id", answer.citation(F.col("p")).alias("sources"))


def answer_pipeline(spark, sf_dir):
    return answer.answer_questions(_index(spark, sf_dir), questions(spark, sf_dir)).select("query_id", "status", "answer")


def _files(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(f) for f in FILES]), (F.col("doc_id") % len(FILES) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(name.alias("filename"))


def collection_names(spark, sf_dir):
    return _files(spark, sf_dir).withColumn("name", index.collection_name(F.col("filename"))).groupBy("filename", "name").agg(F.count("*").alias("n"))


def upload_validation(spark, sf_dir):
    name = F.col("filename")
    return _files(spark, sf_dir).withColumns({"accepted": accepted_upload(name), "client_accepted": client_accepted(name)}).groupBy("filename", "accepted", "client_accepted").agg(F.count("*").alias("n"))


def row_normalize(spark, sf_dir):
    k = F.col("doc_id") % 3
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(k == 0, F.col("text")).when(k == 1, F.lit("")).alias("text"),
        F.when(k == 1, F.concat(F.lit("  "), F.col("text"), F.lit("\t"))).otherwise(F.col("text")).alias("page_content"),
        F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 7).alias("page"),
    )
    # blank rows beside every eleventh document
    blank = rows.filter("doc_id % 11 = 0").withColumns({"text": F.lit("  \n"), "page_content": F.lit("  \n")})
    return index.normalized_chunks(rows.unionByName(blank)).select("doc_id", "text", "page_number", "chunk_id")


def api_projection(spark, sf_dir):
    final = _final(spark, sf_dir)[1]
    return final.select("query_id", "page_number", answer.shown(F.col("text")).alias("preview"), fixed(F.col("rrf_score")).alias("rrf"), fixed(F.col("rerank_score")).alias("rerank"))


def chat_requests(spark, sf_dir):
    rows = session.history(turns(spark, sf_dir))
    nothing = F.array().cast("array<struct<text:string,page_number:int>>")
    r = rows.withColumn("r", answer.request(answer.prompt(F.col("question"), nothing), F.col("history")))
    said = F.transform("r.messages", lambda m: F.concat(m["role"], F.lit("="), m["parts"][0]))
    return r.select("session_id", "turn_no", F.array_join(F.concat(said, F.array(F.concat(F.lit("user="), F.col("r.prompt")))), "|").alias("messages"))


def chat_pipeline(spark, sf_dir):
    # stands for a model: says how much it was told
    told = lambda r: F.concat(F.size(r["messages"]).cast("string"), F.lit(" messages; "), F.left(r["prompt"], F.lit(80)))
    chunks = _session_index(spark, sf_dir)
    return answer.answer_questions(chunks, chat_questions(spark, sf_dir), generator=told).select("query_id", "answer")


def session_terms(spark, sf_dir):
    return _session_index(spark, sf_dir).terms.select("session_id", "term", "df", F.round("idf", 6).alias("idf"))


def _session_questions(spark, sf_dir):
    return chat_questions(spark, sf_dir).select("query_id", "session_id", F.col("resolved").alias("question"), "vector")


def session_bm25(spark, sf_dir):
    chunks = _session_index(spark, sf_dir)
    return retrieval.keyword_ranks(chunks, _session_questions(spark, sf_dir), 60).select("query_id", "chunk_ord", "keyword_rank")


def session_hybrid(spark, sf_dir):
    rows = retrieval.hybrid_query(_session_index(spark, sf_dir), _session_questions(spark, sf_dir), 20)
    return rows.withColumn("rrf_score", F.round("rrf_score", 9))


def unknown_sessions(spark, sf_dir):
    # every second session asks a store that isn't there
    asked = _session_questions(spark, sf_dir).withColumn("session_id", F.when(F.col("session_id").cast("bigint") % 2 == 1, F.concat(F.lit("no "), "session_id")).otherwise(F.col("session_id")))
    found = retrieval.hybrid_query(_session_index(spark, sf_dir), asked, 20).groupBy("query_id").agg(F.count("*").alias("n"))
    return asked.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_candidates"))


def answer_outputs(spark, sf_dir):
    listed = lambda rows, *fields: F.array_join(F.transform(rows, lambda c: F.concat_ws(":", *[f(c) for f in fields])), " ")
    of = lambda name: lambda c: c[name].cast("string")
    out = answer.answer_questions(_index(spark, sf_dir), questions(spark, sf_dir))
    return out.select(
        "query_id",
        "status",
        F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"),
        F.coalesce(listed(F.col("final_chunks"), of("final_ord"), of("page_number"), of("retrieval_source"), lambda c: F.length(c["text"]).cast("string")), F.lit("")).alias("final_chunks"),
        F.coalesce(listed(F.col("candidates"), of("cand_ord"), of("page_number"), of("retrieval_source"), of("semantic_rank"), of("keyword_rank")), F.lit("")).alias("candidates"),
    )


def api_defaults(spark, sf_dir):
    # fields that a store didn't keep
    gone = {"page_number": F.col("query_id") % 2 == 0, "retrieval_source": F.col("final_ord") % 2 == 0, "rrf_score": F.col("query_id") % 3 == 0, "rerank_score": F.col("final_ord") == 1}
    rows = _final(spark, sf_dir)[1].withColumns({c: F.when(~when, F.col(c)) for c, when in gone.items()})
    chunk = F.struct("text", "page_number", "retrieval_source", F.round("rrf_score", 9).alias("rrf_score"), F.round("rerank_score", 9).alias("rerank_score"))
    return rows.withColumn("c", answer.api_chunk(chunk)).select("query_id", "final_ord", "c.*")


def rerank_defaults(spark, sf_dir):
    asked = questions(spark, sf_dir)
    rows = retrieval.hybrid_query(_index(spark, sf_dir), asked, 20).drop("semantic_rank", "rrf_score")
    rows = rows.withColumns({"retrieval_source": F.when(F.col("page_number") % 2 != 0, F.col("retrieval_source")), "keyword_rank": F.when(F.col("page_number") % 3 != 0, F.col("keyword_rank"))})
    out = ranking.rerank(ranking.with_defaults(rows).join(asked.select("query_id", "question"), "query_id"), 5)
    return out.select("query_id", "final_ord", "retrieval_source", "semantic_rank", "keyword_rank", "rrf_score", F.round("rerank_score", 9).alias("rerank_score"))


def guard_models(spark, sf_dir):
    # stand for the models: answer by the length of what they read; null: not there
    n = F.length
    classifier = lambda m: F.struct(F.when(n(m) % 2 == 0, "INJECTION").otherwise("SAFE").alias("label"), (n(m) % 100 / 100).alias("score"))
    judge = lambda m: F.when(n(m) % 7 == 0, F.concat(F.lit(" Unsafe\nS"), (n(m) % 10).cast("string"))).when(n(m) % 7 != 1, "safe")
    return guard.verdicts(attacked(spark, sf_dir), "text", classifier=classifier, judge=judge).select("doc_id", "verdict.*")


def docx_pages(spark, sf_dir):
    rows = read_documents(docx_files(spark, sf_dir))
    return rows.select(F.concat(F.replace("path", F.lit(".docx"), F.lit("#")), F.col("page_number").cast("string")).alias("page"), "text", F.col("n_redactions").cast("bigint").alias("n_redactions"))


def failed_files(spark, sf_dir):
    files = docx_files(spark, sf_dir)
    # beside each file one that is cut off
    cut = files.select(F.concat(F.lit("cut "), "path").alias("path"), F.substring("content", 1, 100).alias("content"))
    rows = read_attempts(files.unionByName(cut))
    return rows.groupBy("path").agg(F.count("page_number").alias("n_pages"), F.max("stage").alias("stage"), F.max("reason").alias("reason"))


def chunk_udtf(spark, sf_dir):
    register(spark)
    markdown(spark, sf_dir).select("doc_id", F.lit(1).alias("page_number"), "text").createOrReplaceTempView("markdown_pages")
    return spark.sql("SELECT doc_id, chunk_ord, chunk_type, text FROM chunk(TABLE(markdown_pages) PARTITION BY doc_id ORDER BY page_number)")


def layout_ladder(spark, sf_dir):
    return layouts(spark, sf_dir).select("doc_id", F.inline(layout_pages(F.col("items"), F.col("markdown"), F.col("pages"))))


def layout_items(spark, sf_dir):
    # lines as items whose page is told in one of four ways, or not at all
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n")).alias("item_ord", "text"))
    k, page = F.col("item_ord") % 5, F.floor(F.col("item_ord") / 10).cast("int") + 1
    told = lambda way: F.when(k == way, page)
    place = lambda first: F.struct(told(first).alias("page_no"), told(first + 1).alias("page"), F.lit(None).cast("int").alias("page_number"))
    items = lines.withColumn("item", F.struct(F.when(k < 2, F.array(place(0))).otherwise(F.array().cast("array<struct<page_no:int,page:int,page_number:int>>")).alias("prov"), place(2).alias("origin")))
    return item_pages(items.select("path", "item_ord", item_page().alias("page_number"), "text")).select(F.col("path").cast("bigint").alias("doc_id"), "page_number", "text")


def stored_files(spark, sf_dir):
    # files of fifty documents, whose parser fails on one in two and leaves it to the next
    path = new_folder(spark, "files")
    attacked(spark, sf_dir).select("text").write.option("lineSep", "\x1e").option("maxRecordsPerFile", 50).text(path)
    pages = lambda content: list(enumerate(content.decode().split("\x1e"), 1))
    even = lambda content: pages(content) if len(content) % 2 == 0 else 1 / 0
    read = read_documents(read_files(spark, path), pdf=even, pdf_fallback=pages)
    return read.groupBy(F.sha2("text", 256).alias("page")).agg(F.count("*").alias("n_pages"), F.sum("n_redactions").alias("n_redactions"))


def vector_sink(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_ord"), "text", (F.col("doc_id") % 5).cast("string").alias("session_id"))
    # stands for an encoder
    encoder = lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float"))
    path = new_folder(spark, "vectors")
    index.write_vectors(chunks.filter("session_id < '3'"), path, encoder)
    index.write_vectors(chunks.filter("session_id >= '3'"), path, encoder)
    again = chunks.filter("session_id < '2' AND chunk_ord % 3 = 0").withColumn("embedding", encoder(F.col("text")))
    index.reset_session(spark, path, again)
    kept = index.count_vectors(spark, path)
    unit = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 5) == 1
    sound = spark.read.parquet(path).filter(unit | (F.col("session_id") < 2)).groupBy(F.col("session_id").cast("string").alias("session_id")).agg(F.count("*").alias("n_kept"))
    return kept.join(sound, "session_id")


def append_turns(spark, sf_dir):
    old = turns(spark, sf_dir)
    more = old.select("session_id").distinct().select("session_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("order"))
    said = lambda w: F.concat(F.lit(w), F.col("order").cast("string"))
    return session.append_turns(old, more.select("session_id", "order", said("more ").alias("question"), said("said ").alias("answer")))


def session_info(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(f) for f in FILES]), (F.col("conv_id") % len(FILES) + 1).cast("int"))
    uploads = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), name.alias("filenames")).distinct()
    return session.created(uploads, turns(spark, sf_dir))


def reindex_flags(spark, sf_dir):
    names = F.array(F.concat(F.lit("a"), F.floor((F.col("turn") + F.col("conv_id")) / 2).cast("bigint").cast("string")), F.concat(F.lit("b"), (F.col("conv_id") % 3).cast("string")))
    uploads = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("upload_no"), names.alias("filenames"))
    return session.needs_reindex(uploads).select("session_id", "upload_no", "reindex")


def softmax_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("p", softmax(F.col("embedding"))).withColumn("label", argmax(F.col("p")).cast("int"))
    return rows.select("vec_id", "label", F.round(F.get("p", F.col("label")), 9).alias("score"))


def file_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", kilobytes(F.octet_length("text")).alias("size"))


#: Queries whose results depend on a training; tests hold them against exact search.
WITHOUT_SQL = ["approximate_topk"]


def queries() -> dict:
    # what a query has written on its way goes, but for what its result reads
    return {name: tidy(globals()[name]) for name in [*SQL, *WITHOUT_SQL]}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


