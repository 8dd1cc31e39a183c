"""DuckDB SQL of the registered plans, composed from the same fixed values."""

from __future__ import annotations

from ..operators import guard as g
from ..operators import session as s
from .inputs import SQL_ATTACKED, SQL_CORPUS, SQL_LAYOUTS, SQL_MARKDOWN, SQL_MARKED, SQL_SESSION_CHUNKS, SQL_TURNS, sql_string

NL = "chr(10)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '\s+'), lambda q: q <> '')"


HARD = [("(?i)" if i else "") + p for p, i in g.HARD_PATTERNS]
TAGS = ["(?is)" + p for p in g.ROLE_TAGS]
SUBTLE = ["(?i)" + p for p in g.SUBTLE_PATTERNS]
ANY = "|".join(f"(?:{p})" for p in HARD)


def matches(x: str, p: str) -> str:
    return f"regexp_matches({x}, {sql_string(p)})"


def normal(x: str) -> str:
    plain = f"translate(regexp_replace({x}, '[​‌‍⁠﻿]', '', 'g'), {sql_string(g.LEET_FROM)}, {sql_string(g.LEET_TO)})"
    dots = rf"regexp_replace({plain}, '\s+', ' ', 'g')"
    for _ in range(2):
        dots = rf"regexp_replace({dots}, '([a-zA-Z])\.([a-zA-Z])', '\1\2', 'g')"
    return dots


def flag(x: str, n: str) -> str:
    return f"({matches(x, ANY)} OR {matches(n, ANY)})"


def reason(x: str, n: str, interleaved: bool = False) -> str:
    one = lambda label, t, p: f"WHEN {matches(t, p)} THEN {sql_string(label + ': ' + chr(39))} || left(regexp_extract({t}, {sql_string(p)}), 50) || ''''"
    a = [one("Regex", x, p) for p in HARD]
    b = [one("Regex (normalized)", n, p) for p in HARD]
    order = [v for pair in zip(a, b) for v in pair] if interleaved else a + b
    return "CASE " + " ".join(order) + " END"


def first(x: str, values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {sql_string(v)}) THEN {sql_string(v)}" for v in values) + " END"


def synonym(x: str) -> str:
    low = f"lower({x})"
    i, n, p, y = (first(low, g.SYNONYMS[k]) for k in ("ignore", "instructions", "previous", "system prompt"))
    pair = lambda a, b: f"'Synonym attack: ''' || ({a}) || ''' + ''' || ({b}) || ''''"
    return f"coalesce({pair(i, n)}, {pair(i, p)}, CASE WHEN ({y}) IS NOT NULL AND ({first(low, g.EXTRACTION_VERBS)}) IS NOT NULL THEN 'System prompt extraction via synonyms' END)"


def subtle(x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {matches(x, p)} THEN regexp_extract({x}, {sql_string(p)}) END" for p in SUBTLE) + "], lambda v: v IS NOT NULL)"


def sanitize_chain(source: str) -> str:
    """CTEs z0 .. z43: text t and count n after each pattern."""
    ctes = [f"z0 AS (SELECT *, text AS t, 0::BIGINT AS n FROM {source})"]
    for k, p in enumerate(HARD + TAGS, 1):
        ctes.append(f"z{k} AS (SELECT * REPLACE (regexp_replace(t, {sql_string(p)}, '{g.REDACTED}', 'g') AS t, n + len(regexp_extract_all(t, {sql_string(p)})) AS n) FROM z{k - 1})")
    return ", ".join(ctes) + f", sanitized AS (SELECT doc_id, t, n FROM z{len(HARD + TAGS)})"


VERDICT = f"""verdicts AS (
  SELECT doc_id,
    CASE WHEN blank THEN false WHEN r IS NOT NULL OR y IS NOT NULL THEN true ELSE len(h) >= 2 END AS is_injection,
    CASE WHEN blank THEN '' WHEN r IS NOT NULL THEN r WHEN y IS NOT NULL THEN y
      WHEN len(h) >= 2 THEN 'Multiple subtle patterns: [''' || array_to_string(h, ''', ''') || ''']' WHEN len(h) = 1 THEN 'Possible: ' || h[1] ELSE '' END AS reason,
    CASE WHEN blank THEN 0.0 WHEN r IS NOT NULL THEN 1.0 WHEN y IS NOT NULL THEN 0.85 WHEN len(h) >= 2 THEN 0.7 WHEN len(h) = 1 THEN 0.3 ELSE 0.0 END::DOUBLE AS confidence
  FROM (SELECT doc_id, {strip('text')} = '' AS blank, {reason('text', 'n', True)} AS r, {synonym('text')} AS y, {subtle('text')} AS h
        FROM (SELECT *, {normal('text')} AS n FROM attacked))
)"""

SECTIONS = rf"""sections AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS section_ord, section FROM (
    SELECT doc_id, i, {strip('part')} AS section FROM (
      SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i
      FROM (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#{{1,4}}\s)', chr(1) || '\1', 'g'), chr(1)) AS p FROM markdown)))
  WHERE section <> ''
)"""
# runs of table lines, or of other lines that are not blank
BLOCKS = f"""lines AS (
  SELECT doc_id, section_ord, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, section_ord, string_split(section, {NL}) AS l FROM sections)
), kinds AS (
  SELECT *, CASE WHEN starts_with({strip('line')}, '|') THEN 'table' WHEN {strip('line')} = '' THEN '' ELSE 'text' END AS kind FROM lines
), runs AS (
  SELECT *, sum(CASE WHEN kind IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section_ord ORDER BY i) AS run
  FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id, section_ord ORDER BY i) AS before FROM kinds)
), blocks AS (
  SELECT doc_id, section_ord, row_number() OVER (PARTITION BY doc_id, section_ord ORDER BY run) - 1 AS block_ord, block FROM (
    SELECT doc_id, section_ord, run, {strip(f"string_agg(line, {NL} ORDER BY i)")} AS block FROM runs WHERE kind <> '' GROUP BY ALL)
)"""
IS_TABLE = f"len(list_filter(string_split(block, {NL}), lambda x: starts_with({strip('x')}, '|'))) >= 2"
PACKED = f"""packed AS (
  SELECT doc_id, section_ord, list_reduce(l, lambda a, b: CASE
      WHEN b.t THEN {{'cur': '', 'out': list_concat(CASE WHEN a.cur <> '' THEN list_append(a.out, {{'kind': 'text', 'text': {strip('a.cur')}}}) ELSE a.out END, [{{'kind': 'table', 'text': b.cur}}]), 't': false}}
      WHEN length(a.cur) + length(b.cur) + 2 <= 1200 THEN {{'cur': a.cur || {NL} || {NL} || b.cur, 'out': a.out, 't': false}}
      ELSE {{'cur': b.cur, 'out': CASE WHEN a.cur <> '' THEN list_append(a.out, {{'kind': 'text', 'text': {strip('a.cur')}}}) ELSE a.out END, 't': false}} END,
    {{'cur': '', 'out': []::STRUCT(kind VARCHAR, text VARCHAR)[], 't': false}}) AS r
  FROM (SELECT doc_id, section_ord, list({{'cur': block, 'out': []::STRUCT(kind VARCHAR, text VARCHAR)[], 't': {IS_TABLE}}} ORDER BY block_ord) AS l
        FROM blocks JOIN sections USING (doc_id, section_ord) WHERE length(section) > 1200 GROUP BY ALL)
), pieces AS (
  SELECT doc_id, section_ord, 0 AS piece_ord, 'section' AS kind, section AS text FROM sections WHERE length(section) <= 1200
  UNION ALL
  SELECT doc_id, section_ord, i - 1, c.kind, c.text FROM (
    SELECT doc_id, section_ord, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (
      SELECT doc_id, section_ord, CASE WHEN r.cur <> '' THEN list_append(r.out, {{'kind': 'text', 'text': {strip('r.cur')}}}) ELSE r.out END AS cs FROM packed))
), chunks AS (
  SELECT doc_id, section_ord, piece_ord, row_number() OVER (PARTITION BY doc_id ORDER BY section_ord, piece_ord) - 1 AS chunk_ord, kind AS chunk_type, text FROM pieces
)"""
CHUNKS = ", ".join([SQL_MARKDOWN, SECTIONS, BLOCKS, PACKED])

BM25 = f"""post AS MATERIALIZED (
  SELECT session_id, chunk_ord, term, count(*) AS tf FROM (SELECT session_id, chunk_ord, unnest({words('text')}) AS term FROM corpus) GROUP BY ALL
), lens AS (SELECT session_id, chunk_ord, len({words('text')}) AS dl FROM corpus),
stats AS (SELECT session_id, count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM lens GROUP BY session_id),
raw AS (SELECT session_id, term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT session_id, term, count(*) AS df FROM post GROUP BY ALL) JOIN stats USING (session_id)),
terms AS MATERIALIZED (SELECT session_id, term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * avg(raw) OVER (PARTITION BY session_id) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, session_id, term, count(*) AS times FROM (SELECT query_id, session_id, unnest({words('question')}) AS term FROM questions) GROUP BY ALL),
scores AS (
  SELECT query_id, chunk_ord, round(sum(times * (idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 9) AS score
  FROM asked JOIN post USING (session_id, term) JOIN terms USING (session_id, term) JOIN lens USING (session_id, chunk_ord) JOIN stats USING (session_id) GROUP BY query_id, chunk_ord
), every AS MATERIALIZED (
  SELECT q.query_id, c.session_id, c.chunk_ord, coalesce(s.score, 0.0) AS kw, round(list_sum(list_transform(list_zip(c.embedding, q.vector), lambda z: z[1] * z[2])), 9) AS sem
  FROM questions q JOIN corpus c ON c.session_id = q.session_id LEFT JOIN scores s ON s.query_id = q.query_id AND s.chunk_ord = c.chunk_ord
)"""


def fusion(k: int) -> str:
    width = max(3 * k, 20)
    return f"""sem AS (
  SELECT query_id, chunk_ord, rn - 1 AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sem DESC, chunk_ord) AS rn FROM every) WHERE rn <= {width}
), kws AS (
  SELECT query_id, chunk_ord, rn - 1 AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw DESC, chunk_ord) AS rn FROM every) WHERE rn <= {width}
), st AS (
  SELECT query_id, corpus.session_id, text, max(r) AS semantic_rank, arg_max(page_number, r) AS page_s, min(chunk_ord) AS o FROM sem JOIN corpus USING (chunk_ord) GROUP BY ALL
), kt AS (
  SELECT query_id, corpus.session_id, text, max(r) AS keyword_rank, min(chunk_ord) AS o FROM kws JOIN corpus USING (chunk_ord) GROUP BY ALL
), fused AS (
  SELECT query_id, session_id, text, page_s, semantic_rank, keyword_rank, least(st.o, kt.o) AS o,
    0.6::DOUBLE / (60 + coalesce(semantic_rank, {width})) + 0.4::DOUBLE / (60 + coalesce(keyword_rank, {width})) AS rrf_score
  FROM st FULL JOIN kt USING (query_id, session_id, text)
), candidates AS MATERIALIZED (
  SELECT query_id, text, coalesce(page_s, (SELECT arg_min(page_number, chunk_ord) FROM corpus c WHERE c.text = f.text AND c.session_id = f.session_id), 1)::INT AS page_number,
    CASE WHEN semantic_rank IS NULL THEN 'keyword' WHEN keyword_rank IS NULL THEN 'semantic' ELSE 'hybrid' END AS retrieval_source,
    coalesce(semantic_rank, -1)::INT AS semantic_rank, coalesce(keyword_rank, -1)::INT AS keyword_rank, rrf_score, (rn - 1)::INT AS cand_ord
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, o) AS rn FROM fused) f WHERE rn <= {k}
)"""


RERANK = f"""final AS (
  SELECT * REPLACE (rn - 1 AS rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, cand_ord) AS rn FROM (
      SELECT c.*, 8.0::DOUBLE * len(list_intersect(list_distinct({words('question')}), list_distinct({words('text')}))) / greatest(len(list_distinct({words('question')})), 1) - 6.0 AS rerank_score
      FROM candidates c JOIN questions q USING (query_id))) WHERE rn <= 5
)"""
RETRIEVAL = f"{SQL_CORPUS}, {BM25}, {fusion(20)}"
FOLLOWUP = "(" + " OR ".join(f"starts_with(ql, {sql_string(t)})" for t in s.TRIGGERS) + f" OR ql IN ({', '.join(sql_string(t.strip()) for t in s.TRIGGERS)}) OR len({words('question')}) <= 4)"
VALIDITY = f"""CASE WHEN {strip('text')} = '' THEN 'Empty query' WHEN length(text) > 2000 THEN {sql_string(g.BLOCKED_LONG)}
    WHEN is_injection AND confidence >= 0.7 THEN {sql_string(g.BLOCKED_CONTENT)} ELSE '' END"""
CONTEXT = f"string_agg('[Page ' || page_number || ']' || {NL} || text, {NL} || {NL} ORDER BY rn)"
CITED = "' [Sources: Pages ' || array_to_string(list_sort(list_distinct(list(page_number))), ', ') || ']'"

FILES = ["Report One!.pdf", "a.pdf", "!!.pdf", "notes.final.DOCX", "plain", "x.y.z.docx", "data.csv", ".hidden"]
_FILES = "files AS (SELECT doc_id, ([" + ", ".join(map(sql_string, FILES)) + f"])[(doc_id % {len(FILES)} + 1)::INT] AS filename FROM documents)"
_BASE = r"CASE WHEN contains(filename, '.') THEN regexp_replace(filename, '\.[^.]*$', '') ELSE filename END"
_CLEAN = rf"regexp_replace(regexp_replace({_BASE}, '[^a-zA-Z0-9._-]', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')"


FOLDED = f"""folded AS (
        SELECT doc_id, list_reduce(list_transform(list_filter(list_transform(string_split(text, {NL} || {NL}), lambda x: {strip('x')}), lambda x: x <> ''),
            lambda x: {{'page': [x], 'size': length(x), 'pages': []::VARCHAR[]}}),
          lambda a, b: CASE WHEN a.size + b.size > 3000 AND len(a.page) > 0
            THEN {{'page': b.page, 'size': b.size, 'pages': list_append(a.pages, array_to_string(a.page, {NL} || {NL}))}}
            ELSE {{'page': list_concat(a.page, b.page), 'size': a.size + b.size, 'pages': a.pages}} END,
          {{'page': []::VARCHAR[], 'size': 0::BIGINT, 'pages': []::VARCHAR[]}}) AS r FROM markdown)"""
VIRTUAL = f"""SELECT doc_id, i::INT AS page_number, text FROM (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) AS i FROM (
        SELECT doc_id, CASE WHEN len(r.page) > 0 THEN list_append(r.pages, array_to_string(r.page, {NL} || {NL})) ELSE r.pages END AS p FROM folded))"""


def _with(*parts: str) -> str:
    """CTE groups, then the query."""
    return "WITH " + ", ".join(parts[:-1]) + " " + parts[-1]


SQL = {
    "sanitize_documents": _with(SQL_ATTACKED, sanitize_chain("attacked"), "SELECT doc_id, t AS text, n > 0 AS was_modified FROM sanitized"),
    "redaction_counts": _with(SQL_ATTACKED, sanitize_chain("attacked"), "SELECT n AS n_redactions, count(*) AS n_documents FROM sanitized GROUP BY n"),
    "normalize_text": _with(SQL_ATTACKED, f"SELECT doc_id, {normal('text')} AS text FROM attacked"),
    "guard_regex_flag": _with(SQL_ATTACKED, f"SELECT doc_id, {flag('text', 'n')} AS is_injection, {reason('text', 'n')} AS reason FROM (SELECT *, {normal('text')} AS n FROM attacked)"),
    "guard_synonym": _with(SQL_ATTACKED, f"SELECT doc_id, {synonym('text')} AS reason FROM attacked"),
    "guard_subtle": _with(SQL_ATTACKED, f"SELECT doc_id, len({subtle('text')})::INT AS n_hits, array_to_string({subtle('text')}, '|') AS hits FROM attacked"),
    "guard_cascade_no_ml": _with(SQL_ATTACKED, VERDICT, "SELECT * FROM verdicts"),
    "scan_chunks_split": _with(SQL_ATTACKED, f"SELECT {flag('text', 'n')} AS injection_flagged, count(*) AS n_chunks, min(doc_id) AS first_doc, max(length(text))::INT AS longest FROM (SELECT *, {normal('text')} AS n FROM attacked) GROUP BY 1"),
    "fail_open_filter": _with(SQL_ATTACKED, f"SELECT doc_id // 2 AS grp, doc_id FROM (SELECT *, sum(1 - f) OVER (PARTITION BY doc_id // 2) AS safe FROM (SELECT doc_id, {flag('text', 'n')}::INT AS f FROM (SELECT *, {normal('text')} AS n FROM attacked))) WHERE f = 0 OR safe = 0"),
    "validate_queries": _with(SQL_ATTACKED, VERDICT, f"SELECT doc_id, reason = '' AS ok, reason FROM (SELECT doc_id, {VALIDITY} AS reason FROM attacked JOIN verdicts USING (doc_id))"),
    "heading_split": _with(SQL_MARKDOWN, SECTIONS, "SELECT doc_id, section_ord::INT AS section_ord, section FROM sections"),
    "block_split": _with(SQL_MARKDOWN, SECTIONS, BLOCKS, "SELECT doc_id, section_ord::INT AS section_ord, block_ord::INT AS block_ord, block FROM blocks"),
    "table_detect": _with(SQL_MARKDOWN, SECTIONS, BLOCKS, f"SELECT {IS_TABLE} AS is_table, count(*) AS n_blocks, sum(length(block))::BIGINT AS n_chars FROM blocks GROUP BY 1"),
    "greedy_pack": _with(CHUNKS, "SELECT doc_id, section_ord::INT AS section_ord, piece_ord::INT AS piece_ord, kind AS chunk_type, text FROM pieces WHERE kind <> 'section'"),
    "chunk_pages": _with(CHUNKS, "SELECT doc_id, chunk_ord::INT AS chunk_ord, chunk_type, text FROM chunks WHERE chunk_ord < 1200"),
    "page_marker_split": _with(SQL_MARKED, f"""SELECT doc_id, i::INT AS page_number, text FROM (
        SELECT doc_id, i, {strip('part')} AS text FROM (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM (
          SELECT doc_id, CASE WHEN contains(text, chr(12)) THEN string_split(text, chr(12)) WHEN contains(text, '<!-- PageBreak -->') THEN string_split(text, '<!-- PageBreak -->')
            ELSE string_split(text, {NL} || '---' || {NL}) END AS p FROM marked))) WHERE text <> ''"""),
    "virtual_pages": _with(SQL_MARKDOWN, FOLDED, VIRTUAL),
    "multi_file_cap": _with(CHUNKS, """SELECT session_id, doc_id, chunk_ord::INT AS chunk_ord, text FROM (
        SELECT doc_id // 20 AS session_id, doc_id, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id, chunk_ord) - 1 AS chunk_ord, text FROM chunks WHERE chunk_ord < 1200) WHERE chunk_ord < 1200"""),
    "bm25_terms": _with(SQL_CORPUS, BM25.partition("asked AS")[0].rstrip().rstrip(","), "SELECT term, df, round(idf, 6) AS idf FROM terms"),
    "bm25_topk": _with(SQL_CORPUS, BM25, "SELECT query_id, chunk_ord, (rn - 1)::INT AS keyword_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw DESC, chunk_ord) AS rn FROM every) WHERE rn <= 60"),
    "semantic_topk": _with(SQL_CORPUS, BM25, "SELECT query_id, chunk_ord, (rn - 1)::INT AS semantic_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sem DESC, chunk_ord) AS rn FROM every) WHERE rn <= 5"),
    "approximate_recall": _with(SQL_CORPUS, "SELECT count(*) AS n_questions, sum(n)::BIGINT AS n_rows, true AS enough FROM (SELECT query_id, (SELECT least(count(*), 60) FROM corpus WHERE embedding IS NOT NULL) AS n FROM questions WHERE vector IS NOT NULL)"),
    "rrf_fusion": _with(SQL_CORPUS, BM25, fusion(5), "SELECT query_id, text, retrieval_source, round(rrf_score, 9) AS rrf_score, cand_ord FROM candidates"),
    "hybrid_query": _with(RETRIEVAL, "SELECT query_id, text, page_number, retrieval_source, semantic_rank, keyword_rank, round(rrf_score, 9) AS rrf_score, cand_ord FROM candidates"),
    "rerank_topk": _with(RETRIEVAL, RERANK, "SELECT query_id, text, page_number, round(rerank_score, 9) AS rerank_score, rn::INT AS final_ord FROM final"),
    "relevance_gate": _with(RETRIEVAL, RERANK, "SELECT query_id, round(coalesce(max(rerank_score), '-inf'::DOUBLE), 9) AS best_score, coalesce(max(rerank_score), '-inf'::DOUBLE) >= -4.0 AS is_relevant FROM questions LEFT JOIN final USING (query_id) GROUP BY query_id"),
    "followup_resolve": _with(SQL_TURNS, f"""SELECT session_id, turn_no, CASE WHEN p IS NOT NULL AND {FOLLOWUP} THEN p || ' ' || question ELSE question END AS resolved
        FROM (SELECT *, {strip('lower(question)')} AS ql, lag(question) OVER (PARTITION BY session_id ORDER BY turn_no) AS p FROM turns)"""),
    "history_last5": _with(SQL_TURNS, f"""SELECT session_id, turn_no, coalesce(n, 0)::INT AS n_history, coalesce(h, '') AS history FROM (SELECT session_id, turn_no,
        len(list(question) OVER w) AS n, array_to_string(list(question || {NL} || answer) OVER w, {NL}) AS h FROM turns
        WINDOW w AS (PARTITION BY session_id ORDER BY turn_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""),
    "history_messages": _with(SQL_TURNS, """SELECT session_id, turn_no, coalesce(h, '') AS messages FROM (SELECT session_id, turn_no,
        array_to_string(list('user=' || question || '|model=' || answer) OVER (PARTITION BY session_id ORDER BY turn_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '|') AS h FROM turns)"""),
    "session_counts": _with(SQL_TURNS, "SELECT session_id, count(*) AS n_turns, max(turn_no) AS last_turn FROM turns GROUP BY session_id"),
    "prompt_build": _with(RETRIEVAL, RERANK, f"SELECT query_id, 'Context:' || {NL} || coalesce(c, '[No retrieved context]') || {NL} || {NL} || 'Question: ' || {strip('question')} || {NL} || {NL} || 'Answer:' AS prompt FROM questions LEFT JOIN (SELECT query_id, {CONTEXT} AS c FROM final GROUP BY query_id) USING (query_id)"),
    "source_strip": f"SELECT doc_id, {strip('string_split(a, chr(83) || chr(111) || chr(117) || chr(114) || chr(99) || chr(101) || chr(58))[1]')} AS answer FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' Source: page ' || doc_id ELSE text END AS a FROM documents)",
    "source_pages": _with(RETRIEVAL, RERANK, f"SELECT query_id, {CITED} AS sources FROM final GROUP BY query_id"),
    "answer_pipeline": _with(
        RETRIEVAL,
        RERANK,
        "attacked AS (SELECT query_id AS doc_id, question AS text FROM questions)",
        VERDICT,
        f"best AS (SELECT query_id, max(rerank_score) AS b, left(arg_min(text, rn), 300) AS reply, {CITED} AS cited FROM final GROUP BY query_id)",
        f"asked_ok AS (SELECT doc_id AS query_id, {VALIDITY} = '' AS ok FROM attacked JOIN verdicts USING (doc_id))",
        f"""SELECT query_id, CASE WHEN NOT ok THEN 'blocked' WHEN b >= -4.0 THEN 'answered' ELSE 'irrelevant' END AS status,
        CASE WHEN NOT ok THEN 'Your query could not be processed for security reasons.' WHEN b >= -4.0 THEN {strip('reply')} || cited ELSE 'Not found in document.' END AS answer
        FROM asked_ok LEFT JOIN best USING (query_id)""",
    ),
    "collection_names": _with(_FILES, f"SELECT filename, CASE WHEN length(c) < 3 THEN 'doc_' || CASE WHEN c = '' THEN 'file' ELSE c END ELSE c END AS name, count(*) AS n FROM (SELECT filename, {_CLEAN} AS c FROM files) GROUP BY ALL"),
    "upload_validation": _with(_FILES, "SELECT filename, lower(filename) LIKE '%.pdf' OR lower(filename) LIKE '%.docx' AS accepted, filename LIKE '%.pdf' OR filename LIKE '%.docx' AS client_accepted, count(*) AS n FROM files GROUP BY ALL"),
    "row_normalize": f"""SELECT doc_id, text, page_number, sha256(page_number || chr(31) || text) AS chunk_id FROM (
        SELECT doc_id, {strip("CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '  ' || text || chr(9) ELSE text END")} AS text, coalesce(CASE WHEN doc_id % 5 <> 0 THEN doc_id % 7 END, 1)::INT AS page_number FROM documents)""",
    "api_projection": _with(RETRIEVAL, RERANK, "SELECT query_id, page_number, CASE WHEN length(text) > 250 THEN left(text, 250) || '...' ELSE text END AS preview, printf('%.4f', rrf_score) AS rrf, printf('%.4f', rerank_score) AS rerank FROM final"),
}

SQL["incremental_terms"] = SQL["bm25_terms"]
SQL["chunk_udtf"] = SQL["chunk_pages"]

MODEL_TEXT = "CASE WHEN length(n) > 1000 THEN left(n, 500) || ' ... ' || right(n, 500) ELSE n END"
#: What the stand-ins for models in ``guard_models`` answer: by the length of what they read.
STUB_SCORE, STUB_SAID = "length(m) % 100 / 100.0::DOUBLE", "CASE length(n) % 7 WHEN 0 THEN ' Unsafe' || chr(10) || 'S' || length(n) % 10 WHEN 1 THEN NULL ELSE 'safe' END"
CHAT = f"""hist AS (
  SELECT session_id, turn_no, question, answer, {strip('lower(question)')} AS ql, lag(question) OVER (PARTITION BY session_id ORDER BY turn_no) AS p,
    least(row_number() OVER (PARTITION BY session_id ORDER BY turn_no) - 1, 5) AS n_history FROM turns
), questions AS MATERIALIZED (
  SELECT session_id || '-' || turn_no AS query_id, session_id, question AS raw, CASE WHEN p IS NOT NULL AND {FOLLOWUP} THEN p || ' ' || question ELSE question END AS question, n_history, embedding::DOUBLE[] AS vector
  FROM hist LEFT JOIN embeddings ON vec_id = (session_id::BIGINT * 31 + turn_no) % (SELECT n FROM vectors)
)"""
FINAL_ROWS = f"best AS (SELECT query_id, max(rerank_score) AS b, {CONTEXT} AS context, {CITED} AS cited, left(arg_min(text, rn), 300) AS quoted, list_sort(list_distinct(list(page_number))) AS pages, string_agg(rn || ':' || page_number || ':' || retrieval_source || ':' || length(text), ' ' ORDER BY rn) AS chunks FROM final GROUP BY query_id)"
CANDIDATES = "found AS (SELECT query_id, string_agg(cand_ord || ':' || page_number || ':' || retrieval_source || ':' || semantic_rank || ':' || keyword_rank, ' ' ORDER BY cand_ord) AS candidates FROM candidates GROUP BY query_id)"
CHECKED = f"asked_ok AS (SELECT doc_id AS query_id, {VALIDITY} = '' AS ok FROM attacked JOIN verdicts USING (doc_id))"

SQL |= {
    "chat_requests": _with(SQL_TURNS, f"""SELECT session_id, turn_no, coalesce(h || '|', '') || 'user=Context:' || {NL} || '[No retrieved context]' || {NL} || {NL} || 'Question: ' || {strip('question')} || {NL} || {NL} || 'Answer:' AS messages FROM (
        SELECT session_id, turn_no, question, array_to_string(list('user=' || question || '|model=' || answer) OVER (PARTITION BY session_id ORDER BY turn_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '|') AS h FROM turns)"""),
    "chat_pipeline": _with(SQL_SESSION_CHUNKS, SQL_TURNS, CHAT, BM25, fusion(20), RERANK, "attacked AS (SELECT query_id AS doc_id, raw AS text FROM questions)", VERDICT, FINAL_ROWS, CHECKED, f"""SELECT query_id,
        CASE WHEN NOT ok THEN {sql_string('Your query could not be processed for security reasons.')} WHEN b >= -4.0 THEN n_history * 2 || ' messages; ' || {strip(f"left('Context:' || {NL} || context, 80)")} || cited ELSE 'Not found in document.' END AS answer
        FROM questions JOIN asked_ok USING (query_id) LEFT JOIN best USING (query_id)"""),
    "session_terms": _with(SQL_SESSION_CHUNKS, BM25.partition("asked AS")[0].rstrip().rstrip(","), "SELECT session_id, term, df, round(idf, 6) AS idf FROM terms"),
    "session_bm25": _with(SQL_SESSION_CHUNKS, SQL_TURNS, CHAT, BM25, "SELECT query_id, chunk_ord, (rn - 1)::INT AS keyword_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw DESC, chunk_ord) AS rn FROM every) WHERE rn <= 60"),
    "session_hybrid": _with(SQL_SESSION_CHUNKS, SQL_TURNS, CHAT, BM25, fusion(20), "SELECT query_id, text, page_number, retrieval_source, semantic_rank, keyword_rank, round(rrf_score, 9) AS rrf_score, cand_ord FROM candidates"),
    "answer_outputs": _with(RETRIEVAL, RERANK, "attacked AS (SELECT query_id AS doc_id, question AS text FROM questions)", VERDICT, FINAL_ROWS, CANDIDATES, CHECKED, """SELECT query_id,
        CASE WHEN NOT ok THEN 'blocked' WHEN b >= -4.0 THEN 'answered' ELSE 'irrelevant' END AS status,
        CASE WHEN ok AND b >= -4.0 THEN array_to_string(pages, ',') ELSE '' END AS pages, CASE WHEN ok AND b >= -4.0 THEN chunks ELSE '' END AS final_chunks, CASE WHEN ok THEN candidates ELSE '' END AS candidates
        FROM asked_ok LEFT JOIN best USING (query_id) LEFT JOIN found USING (query_id)"""),
    "api_defaults": _with(RETRIEVAL, RERANK, """SELECT query_id, rn::INT AS final_ord, text, CASE WHEN query_id % 2 = 0 THEN 0 ELSE page_number END AS page_number, CASE WHEN rn % 2 = 0 THEN 'unknown' ELSE retrieval_source END AS retrieval_source,
        CASE WHEN query_id % 3 = 0 THEN 0.0 ELSE round(rrf_score, 9) END::DOUBLE AS rrf_score, CASE WHEN rn = 1 THEN 0.0 ELSE round(rerank_score, 9) END::DOUBLE AS rerank_score FROM final"""),
    "rerank_defaults": _with(RETRIEVAL, RERANK, "SELECT query_id, rn::INT AS final_ord, CASE WHEN page_number % 2 = 0 THEN 'unknown' ELSE retrieval_source END AS retrieval_source, -1 AS semantic_rank, CASE WHEN page_number % 3 = 0 THEN -1 ELSE keyword_rank END AS keyword_rank, 0.0::DOUBLE AS rrf_score, round(rerank_score, 9) AS rerank_score FROM final"),
    "guard_models": _with(SQL_ATTACKED, VERDICT, f"""read AS (SELECT doc_id, n, {MODEL_TEXT} AS m FROM (SELECT doc_id, {normal('text')} AS n FROM attacked)),
        models AS (SELECT doc_id, {STUB_SCORE} AS score, length(m) % 2 = 0 AS bad, {STUB_SAID} AS said FROM read)""", """SELECT doc_id,
        CASE WHEN confidence >= 0.85 OR blank THEN is_injection WHEN (bad AND score >= 0.85) OR said LIKE ' Unsafe%' THEN true ELSE is_injection END AS is_injection,
        CASE WHEN confidence >= 0.85 OR blank THEN reason WHEN bad AND score >= 0.85 THEN 'DeBERTa: INJECTION (' || printf('%.3f', score) || ')' WHEN said LIKE ' Unsafe%' THEN 'LlamaGuard: unsafe ' || lower(right(said, 2)) ELSE reason END AS reason,
        CASE WHEN confidence >= 0.85 OR blank THEN confidence WHEN bad AND score >= 0.85 THEN score WHEN said LIKE ' Unsafe%' THEN 0.9 ELSE confidence END::DOUBLE AS confidence
        FROM models JOIN verdicts USING (doc_id) JOIN (SELECT doc_id, """ + strip("text") + """ = '' AS blank FROM attacked) USING (doc_id)"""),
    "docx_pages": _with(SQL_ATTACKED, f"""lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '[\\x00-\\x09\\x0b-\\x1f]', '', 'g'), {NL}) AS l FROM attacked)),
        paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, CASE WHEN i % 4 = 0 THEN {NL} || '## ' ELSE '' END || {strip('line')} AS item FROM lines WHERE {strip('line')} <> ''),
        items AS (SELECT * FROM paras UNION ALL SELECT doc_id, coalesce(k, 0), {NL} || '| key | value |' || {NL} || '| --- | --- |' || {NL} || '| number | ' || doc_id || ' |' || {NL} FROM documents LEFT JOIN (SELECT doc_id, count(*) AS k FROM paras GROUP BY doc_id) USING (doc_id)),
        page AS (SELECT doc_id || '#' || (k // 30 + 1) AS doc_id, {strip(f"string_agg(item, {NL} ORDER BY k)")} AS text FROM (SELECT doc_id::VARCHAR AS doc_id, k, item FROM items) GROUP BY doc_id, k // 30)""", sanitize_chain("page"), "SELECT doc_id AS page, t AS text, n AS n_redactions FROM sanitized"),
    "failed_files": _with(SQL_ATTACKED, f"""lines AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[\\x00-\\x09\\x0b-\\x1f]', '', 'g'), {NL})) AS line FROM attacked),
        n AS (SELECT doc_id, count(*) AS k FROM lines WHERE {strip('line')} <> '' GROUP BY doc_id)""", """SELECT doc_id || '.docx' AS path, coalesce(k, 0) // 30 + 1 AS n_pages, NULL AS stage, NULL AS reason FROM documents LEFT JOIN n USING (doc_id)
        UNION ALL SELECT 'cut ' || doc_id || '.docx', 0, 'docx', 'BadZipFile: File is not a zip file' FROM documents"""),
    "layout_ladder": _with(SQL_LAYOUTS, FOLDED, f"SELECT doc_id, page_number::INT AS page_number, text FROM several UNION ALL ({VIRTUAL})"),
    "vector_sink": "SELECT (doc_id % 5)::VARCHAR AS session_id, count(*) AS n, count(*) FILTER (doc_id % 5 > 1 OR doc_id % 3 = 0) AS n_kept FROM documents WHERE doc_id % 5 > 1 OR doc_id % 3 = 0 GROUP BY 1",
    "append_turns": _with(SQL_TURNS, """SELECT session_id, turn_no, question, answer FROM turns UNION ALL
        SELECT session_id, last + k, 'more ' || k, 'said ' || k FROM (SELECT session_id, max(turn_no) AS last FROM turns GROUP BY session_id), (SELECT unnest([1, 2]) AS k)"""),
    "session_info": _with(SQL_TURNS, f"""uploads AS (SELECT DISTINCT conv_id::VARCHAR AS session_id, ([{', '.join(map(sql_string, FILES))}])[(conv_id % {len(FILES)} + 1)::INT] AS filenames FROM conversations)""", """SELECT session_id, filenames, coalesce(n, 0) AS history_turns, q AS last_question
        FROM uploads LEFT JOIN (SELECT session_id, count(*) AS n, arg_max(question, turn_no) AS q FROM turns GROUP BY session_id) USING (session_id)"""),
    "reindex_flags": """SELECT session_id, upload_no, f IS DISTINCT FROM lag(f) OVER (PARTITION BY session_id ORDER BY upload_no) AS reindex
        FROM (SELECT conv_id::VARCHAR AS session_id, turn AS upload_no, list_sort(['a' || (turn + conv_id) // 2, 'b' || conv_id % 3]) AS f FROM conversations)""",
    "softmax_labels": """SELECT vec_id, list_position(e, list_max(e)) - 1 AS label, round(1 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 9) AS score
        FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)""",
    "file_sizes": "SELECT doc_id, floor(strlen(text) / 1024.0::DOUBLE + 0.5::DOUBLE)::BIGINT || 'KB' AS size FROM documents",
}
SQL |= {
    "compacted_terms": _with(SQL_CORPUS, BM25.partition("asked AS")[0].rstrip().rstrip(","), "SELECT term, df FROM terms"),
    "unknown_sessions": _with(SQL_SESSION_CHUNKS, SQL_TURNS, CHAT, BM25, fusion(20), "SELECT query_id, CASE WHEN session_id::BIGINT % 2 = 1 THEN 0 ELSE coalesce(n, 0) END AS n_candidates FROM questions LEFT JOIN (SELECT query_id, count(*) AS n FROM candidates GROUP BY query_id) USING (query_id)"),
    "layout_items": _with(f"""items AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, {NL}) AS l FROM documents)),
        paged AS (SELECT doc_id, i, (CASE WHEN i % 5 = 4 THEN 1 ELSE i // 10 + 1 END)::INT AS page_number, {strip('line')} AS text FROM items)""", f"SELECT doc_id, page_number, string_agg(text, {NL} || {NL} ORDER BY i) AS text FROM paged WHERE text <> '' GROUP BY doc_id, page_number QUALIFY count(*) OVER (PARTITION BY doc_id) > 1"),
    "stored_files": _with(SQL_ATTACKED, sanitize_chain("attacked"), f"SELECT sha256(t) AS page, count(*) AS n_pages, sum(n)::BIGINT AS n_redactions FROM sanitized JOIN (SELECT doc_id FROM attacked WHERE {strip('text')} <> '') USING (doc_id) GROUP BY 1"),
}
