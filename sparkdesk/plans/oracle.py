"""DuckDB oracle SQL for every named query that SQL can express."""

from __future__ import annotations

import re

from sparkdesk.plans import queries as Q
from sparkdesk.plans.oracle_views import with_views as W

ORACLE: dict[str, str] = {}


def sql(name: str, text: str, *views: str, ctes: str = "") -> None:
    ORACLE[name] = W(text, *views, ctes=ctes)


_SEARCH = f"coalesce(regexp_matches(name, '{Q.SEARCH}', 'i'), false)"

# --- contacts: read side -------------------------------------------------
sql("growth_by_day", """
    SELECT CAST(created_at AS DATE) AS created_at, count(*) AS contacts
    FROM contacts WHERE created_at IS NOT NULL GROUP BY 1""", "contacts")
sql("event_growth_by_day", """
    SELECT CAST(ts AS DATE) AS ts, count(*) AS events FROM events WHERE ts IS NOT NULL GROUP BY 1""")
sql("contact_kpis", """
    SELECT count(*) AS total_contacts, count(DISTINCT city) AS cities,
           CAST(coalesce(max(id), 0) AS BIGINT) AS latest_id FROM contacts""", "contacts")
sql("city_counts", """
    SELECT city, count(*) AS count FROM contacts WHERE city IS NOT NULL GROUP BY city""", "contacts")
sql("city_share", """
    SELECT city, count, round(count / (SELECT CAST(count(*) AS DOUBLE) FROM contacts WHERE city IS NOT NULL), 6) AS share
    FROM (SELECT city, count(*) AS count FROM contacts WHERE city IS NOT NULL GROUP BY city)""", "contacts")
sql("city_options", f"""
    SELECT 'All' AS option, CAST(0 AS BIGINT) AS ord
    UNION ALL
    SELECT city, row_number() OVER (ORDER BY city) FROM
      (SELECT DISTINCT city FROM contacts WHERE {_SEARCH} AND city IS NOT NULL)""", "contacts")
sql("contact_search", f"SELECT * FROM contacts WHERE {_SEARCH}", "contacts")
sql("contact_search_city", f"SELECT * FROM contacts WHERE {_SEARCH} AND city = '{Q.CITY}'", "contacts")
sql("contact_labels", """
    SELECT id, CAST(id AS VARCHAR) || ' : ' || name AS label,
           CAST(id AS VARCHAR) || ' - ' || coalesce(name, 'None') AS label_fstring
    FROM contacts""", "contacts")
sql("label_ids", """
    SELECT label, TRY_CAST(trim(split_part(label, ':', 1)) AS BIGINT) AS label_id
    FROM (SELECT CAST(id AS VARCHAR) || ' : ' || name AS label FROM contacts)""",
    "contacts")
sql("contact_numbered", "SELECT row_number() OVER (ORDER BY id) AS s_no, * FROM contacts", "contacts")
sql("contact_page", f"""
    SELECT * FROM (SELECT *, row_number() OVER (ORDER BY id) AS s_no FROM contacts WHERE {_SEARCH})
    WHERE s_no BETWEEN {(Q.PAGE_NUMBER - 1) * Q.PAGE_SIZE + 1} AND {Q.PAGE_NUMBER * Q.PAGE_SIZE}""", "contacts")
sql("page_count", f"""
    SELECT rows, page_size, CAST(greatest(1, rows // page_size + 1) AS BIGINT) AS page_count,
           CAST(greatest(1, ceil(rows / page_size)) AS BIGINT) AS page_count_exact
    FROM (SELECT count(*) AS rows FROM contacts WHERE {_SEARCH}), (VALUES (5), (10), (20), (50)) s(page_size)""",
    "contacts")

# --- contacts: write side ------------------------------------------------
_RUN = f"TIMESTAMP '{Q.RUN_TS}'"
sql("contact_import", f"""
    SELECT id, name, phone, city, created_at FROM contacts
    UNION ALL
    SELECT (SELECT max(id) FROM contacts) + row_number() OVER (ORDER BY upload_pos), name, phone, city, {_RUN}
    FROM uploads u
    WHERE NOT EXISTS (SELECT 1 FROM contacts c WHERE c.name = u.name AND c.phone = u.phone)""",
    "contacts", "uploads")
sql("contact_import_all", f"""
    SELECT id, name, phone, city, created_at FROM contacts
    UNION ALL
    SELECT (SELECT max(id) FROM contacts) + row_number() OVER (ORDER BY upload_pos), name, phone, city, {_RUN}
    FROM uploads u""", "contacts", "uploads")
sql("contact_import_after_delete", f"""
    SELECT id, name, phone, city, created_at FROM kept
    UNION ALL
    SELECT (SELECT max(id) FROM contacts) + row_number() OVER (ORDER BY upload_pos), name, phone, city, {_RUN}
    FROM uploads u
    WHERE NOT EXISTS (SELECT 1 FROM kept c WHERE c.name = u.name AND c.phone = u.phone)""",
    "contacts", "uploads",
    ctes="kept AS (SELECT * FROM contacts WHERE id NOT IN (SELECT id FROM contacts ORDER BY id DESC LIMIT 10))")
sql("import_report", """
    SELECT upload_pos, name, phone, city,
      CASE WHEN name IS NULL OR name = '' OR phone IS NULL OR phone = '' OR city IS NULL OR city = '' THEN 'invalid'
           WHEN EXISTS (SELECT 1 FROM contacts c WHERE c.name = u.name AND c.phone = u.phone) THEN 'duplicate'
           ELSE 'inserted' END AS status
    FROM uploads u""", "contacts", "uploads")
sql("contact_update", """
    SELECT c.id,
           CASE WHEN l.id IS NOT NULL THEN l.name ELSE c.name END AS name,
           CASE WHEN l.id IS NOT NULL THEN l.phone ELSE c.phone END AS phone,
           CASE WHEN l.id IS NOT NULL THEN l.city ELSE c.city END AS city,
           c.created_at
    FROM contacts c LEFT JOIN
      (SELECT * FROM edits WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) l
      ON c.id = l.id""", "contacts", "edits")
sql("contact_delete", "SELECT * FROM contacts WHERE id NOT IN (SELECT id FROM deletes WHERE id IS NOT NULL)",
    "contacts", "deletes")
_CHANGED = """
    changed AS (
      SELECT c.id,
             CASE WHEN l.id IS NOT NULL THEN l.name ELSE c.name END AS name,
             CASE WHEN l.id IS NOT NULL THEN l.phone ELSE c.phone END AS phone,
             CASE WHEN l.id IS NOT NULL THEN l.city ELSE c.city END AS city, c.created_at
      FROM contacts c LEFT JOIN
        (SELECT * FROM edits WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) l
        ON c.id = l.id
      WHERE c.id NOT IN (SELECT id FROM deletes WHERE id IS NOT NULL))"""
sql("contact_changes", "SELECT * FROM changed", "contacts", "edits", "deletes", ctes=_CHANGED)
sql("contact_changes_compacted", f"""
    SELECT id, name, phone, city, created_at FROM changed
    UNION ALL
    SELECT (SELECT max(id) FROM contacts) + row_number() OVER (ORDER BY upload_pos), name, phone, city, {_RUN}
    FROM uploads u
    WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE c.name = u.name AND c.phone = u.phone)""",
    "contacts", "edits", "deletes", "uploads", ctes=_CHANGED)
sql("contact_backfill", f"""
    SELECT id, name, phone, city, coalesce(created_at, {_RUN}) AS created_at FROM contacts""", "contacts")

# --- profiling -----------------------------------------------------------
_TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in __import__(
    "sparkdesk.functions.patterns", fromlist=["MISSING_TOKENS"]).MISSING_TOKENS)
sql("profile_table", f"""
    SELECT count(*) AS rows, 5 AS columns,
      CAST(coalesce(sum(CAST(id IS NULL AS BIGINT)
        + CAST(name IS NULL OR name IN ({_TOKENS}) AS BIGINT)
        + CAST(phone IS NULL OR phone IN ({_TOKENS}) AS BIGINT)
        + CAST(city IS NULL OR city IN ({_TOKENS}) AS BIGINT)
        + CAST(created_at IS NULL AS BIGINT)), 0) AS BIGINT) AS missing,
      'id' AS numeric_columns, 'id,name,phone,city,created_at' AS column_names
    FROM contacts""", "contacts")
sql("numeric_series", "SELECT event_id AS pos, value FROM events")
sql("health_describe", """
    WITH long AS (
      SELECT 'event_id' AS metric, CAST(event_id AS DOUBLE) AS v FROM events
      UNION ALL SELECT 'user_id', CAST(user_id AS DOUBLE) FROM events
      UNION ALL SELECT 'value', value FROM events),
    c AS (SELECT metric, CASE WHEN NOT isnan(v) THEN v END AS v FROM long),
    s AS (
      SELECT metric, CAST(count(v) AS DOUBLE) AS "count", avg(v) AS "mean", stddev_samp(v) AS "std",
             min(v) AS "min", quantile_cont(v, 0.25) AS "25%", quantile_cont(v, 0.5) AS "50%",
             quantile_cont(v, 0.75) AS "75%", max(v) AS "max"
      FROM c GROUP BY metric)
    SELECT metric, stat, round(value, 6) AS value
    FROM s UNPIVOT (value FOR stat IN ("count", "mean", "std", "min", "25%", "50%", "75%", "max"))""")
sql("text_describe", """
    WITH long AS (SELECT 'event_type' AS "column", event_type AS v FROM events
                  UNION ALL SELECT 'props', props FROM events),
    f AS (SELECT "column", v, count(*) AS fr FROM long WHERE v IS NOT NULL GROUP BY ALL)
    SELECT "column", CAST(sum(fr) AS BIGINT) AS "count", count(*) AS "unique",
           arg_min(v, (-fr, v)) AS top, max(fr) AS freq
    FROM f GROUP BY "column" """)

# --- bills ---------------------------------------------------------------
from sparkdesk.functions import patterns as P  # noqa: E402


def _fields(text: str = "text") -> str:
    return f"""
      nullif(regexp_extract({text}, '{P.EMAIL}', 0), '') AS email,
      nullif(regexp_extract({text}, '{P.bounded_digits_re2("10")}', 2), '') AS phone,
      nullif(regexp_extract({text}, '{P.plan_re2()}', 0), '') AS plan,
      nullif(regexp_extract({text}, '{P.bounded_digits_re2("12,")}', 2), '') AS account_id,
      regexp_extract_all({text}, '{P.DATE}')[1] AS statement_date,
      nullif(regexp_extract({text}, '{P.PERIOD}', 0), '') AS statement_period,
      TRY_CAST(replace(nullif(regexp_extract({text}, '{P.amount_pattern()}', 1), ''), ',', '') AS DOUBLE) AS amount,
      CASE WHEN len(regexp_extract_all({text}, '{P.DATE}')) >= 2
           THEN regexp_extract_all({text}, '{P.DATE}')[-1] END AS due_date"""


_MONTHS = "[" + ", ".join(f"'{m}'" for m in P.MONTHS) + "]"
_BILLS = f"""
  bf AS (SELECT file, pos, account, {_fields()} FROM bill_text),
  bm AS (SELECT *, nullif(list_position({_MONTHS}, nullif(regexp_extract(statement_period, '{P.MONTH_OF_PERIOD}', 1), '')), 0) AS month_ord,
                nullif(regexp_extract(statement_period, '{P.YEAR_AT_END_RE2}', 1), '') AS year FROM bf),
  bm2 AS (SELECT *, CASE WHEN month_ord IS NOT NULL THEN {_MONTHS}[month_ord] END AS month,
                 last_value(amount IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur
          FROM bm),
  bm3 AS (SELECT *, lag(cur) OVER (ORDER BY pos) AS prev FROM bm2),
  be AS (SELECT *, CASE WHEN prev IS NULL OR cur IS NULL THEN NULL WHEN prev <> 0 THEN (cur / prev - 1) * 100
                        WHEN cur > 0 THEN CAST('inf' AS DOUBLE) WHEN cur < 0 THEN CAST('-inf' AS DOUBLE) END AS pct_change
         FROM bm3),
  bills AS (SELECT *, CASE WHEN pct_change > 15 THEN '{P.SPIKE_LABEL}' WHEN pct_change < -15 THEN '{P.DROP_LABEL}'
                           ELSE '{P.NORMAL_LABEL}' END AS anomaly FROM be),
  fb AS (SELECT * FROM bills WHERE month IS NOT NULL)"""


def _bills(select: str, more: str = "") -> str:
    return W(select, "bill_text", ctes=_BILLS + more)


ORACLE["bill_fields"] = W(f"SELECT file, pos, account, {_fields()} FROM bill_text", "bill_text")
ORACLE["doc_fields"] = W(f"SELECT doc_id, {_fields()} FROM docs", "docs")
ORACLE["bill_anomalies"] = _bills("""
    SELECT file, pos, account, amount, month, CAST(month_ord AS INTEGER) AS month_ord, year,
           round(pct_change, 6) AS pct_change, anomaly FROM bills""")
_BILLS_BY_ACCOUNT = _BILLS.replace(
    "OVER (ORDER BY pos ROWS BETWEEN", "OVER (PARTITION BY account ORDER BY pos ROWS BETWEEN").replace(
    "lag(cur) OVER (ORDER BY pos)", "lag(cur) OVER (PARTITION BY account ORDER BY pos)")
assert _BILLS_BY_ACCOUNT != _BILLS
ORACLE["bill_anomalies_by_account"] = W("""
    SELECT file, pos, account, amount, month, CAST(month_ord AS INTEGER) AS month_ord, year,
           round(pct_change, 6) AS pct_change, anomaly FROM bills""", "bill_text", ctes=_BILLS_BY_ACCOUNT)
ORACLE["bill_kpis"] = _bills("""
    SELECT count(*) AS bills, round(coalesce(sum(amount), 0), 2) AS total_spend,
           round(avg(amount), 6) AS avg_bill, round(max(amount), 2) AS max_bill FROM fb""")
ORACLE["bill_month_share"] = _bills("""
    SELECT month, CAST(month_ord AS INTEGER) AS month_ord, round(sum(amount), 2) AS amount,
           round(sum(amount) / (SELECT sum(amount) FROM fb), 6) AS share FROM fb GROUP BY 1, 2""")
ORACLE["bill_month_anomaly"] = _bills("""
    SELECT month, CAST(month_ord AS INTEGER) AS month_ord, anomaly, round(sum(amount), 2) AS amount,
           count(*) AS bills FROM fb GROUP BY 1, 2, 3""")
def _sql_fill(template: str, **exprs: str) -> str:
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(exprs[p] if i % 2 else "'" + p.replace("'", "''") + "'"
                       for i, p in enumerate(parts) if i % 2 or p)


ORACLE["bill_insights"] = _bills(f"""
    SELECT CAST(0 AS BIGINT) AS seq, '{P.NO_DATA_INSIGHT}' AS message FROM st WHERE nv < 2
    UNION ALL
    SELECT 0, CASE WHEN last > first THEN '{P.TREND_UP}' ELSE '{P.TREND_DOWN}' END
    FROM st WHERE nv >= 2 AND last <> first
    UNION ALL
    SELECT seq, CASE WHEN ch > 15 THEN {_sql_fill(P.SPIKE_MSG, change="format('{:.1f}', ch)", month="month")}
                     ELSE {_sql_fill(P.DROP_MSG, change="format('{:.1f}', ch)", month="month")} END
    FROM s4 WHERE ch IS NOT NULL AND abs(ch) > 15 AND (SELECT nv FROM st) >= 2
    UNION ALL
    SELECT nr + 1, {_sql_fill(P.HIGHEST_MSG, currency="'" + P.CURRENCY + "'", amount="format('{:,.2f}', hi_a)", month="hi_m")}
    FROM st WHERE nv >= 2
    UNION ALL
    SELECT nr + 2, {_sql_fill(P.LOWEST_MSG, currency="'" + P.CURRENCY + "'", amount="format('{:,.2f}', lo_a)", month="lo_m")}
    FROM st WHERE nv >= 2""",
    more=""",
    s AS (SELECT *, row_number() OVER (ORDER BY month_ord, year NULLS FIRST, pos) AS seq FROM fb),
    s2 AS (SELECT *, last_value(amount IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c2 FROM s),
    s3 AS (SELECT *, lag(c2) OVER (ORDER BY seq) AS p2 FROM s2),
    s4 AS (SELECT *, CASE WHEN p2 IS NULL OR c2 IS NULL THEN NULL WHEN p2 <> 0 THEN (c2 / p2 - 1) * 100
                          WHEN c2 > 0 THEN CAST('inf' AS DOUBLE) WHEN c2 < 0 THEN CAST('-inf' AS DOUBLE) END AS ch FROM s3),
    st AS (SELECT count(amount) AS nv, count(*) AS nr,
                  arg_min(amount, seq) FILTER (WHERE amount IS NOT NULL) AS first,
                  arg_max(amount, seq) FILTER (WHERE amount IS NOT NULL) AS last,
                  arg_max(month, (amount, -seq)) FILTER (WHERE amount IS NOT NULL) AS hi_m,
                  max(amount) AS hi_a,
                  arg_min(month, (amount, seq)) FILTER (WHERE amount IS NOT NULL) AS lo_m,
                  min(amount) AS lo_a FROM s)""")
ORACLE["bill_insights_by_account"] = _bills(f"""
    SELECT account, CAST(0 AS BIGINT) AS seq, '{P.NO_DATA_INSIGHT}' AS message FROM st WHERE nv < 2
    UNION ALL
    SELECT account, 0, CASE WHEN last > first THEN '{P.TREND_UP}' ELSE '{P.TREND_DOWN}' END
    FROM st WHERE nv >= 2 AND last <> first
    UNION ALL
    SELECT account, seq, CASE WHEN ch > 15 THEN {_sql_fill(P.SPIKE_MSG, change="format('{:.1f}', ch)", month="month")}
                     ELSE {_sql_fill(P.DROP_MSG, change="format('{:.1f}', ch)", month="month")} END
    FROM s4 WHERE ch IS NOT NULL AND abs(ch) > 15
    UNION ALL
    SELECT account, nr + 1, {_sql_fill(P.HIGHEST_MSG, currency="'" + P.CURRENCY + "'", amount="format('{:,.2f}', hi_a)", month="hi_m")}
    FROM st WHERE nv >= 2
    UNION ALL
    SELECT account, nr + 2, {_sql_fill(P.LOWEST_MSG, currency="'" + P.CURRENCY + "'", amount="format('{:,.2f}', lo_a)", month="lo_m")}
    FROM st WHERE nv >= 2""",
    more=""",
    s AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY month_ord, year NULLS FIRST, pos) AS seq FROM fb),
    s2 AS (SELECT *, last_value(amount IGNORE NULLS) OVER (PARTITION BY account ORDER BY seq
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c2 FROM s),
    s3 AS (SELECT *, lag(c2) OVER (PARTITION BY account ORDER BY seq) AS p2 FROM s2),
    s4 AS (SELECT *, CASE WHEN p2 IS NULL OR c2 IS NULL THEN NULL WHEN p2 <> 0 THEN (c2 / p2 - 1) * 100
                          WHEN c2 > 0 THEN CAST('inf' AS DOUBLE) WHEN c2 < 0 THEN CAST('-inf' AS DOUBLE) END AS ch FROM s3),
    st AS (SELECT account, count(amount) AS nv, count(*) AS nr,
                  arg_min(amount, seq) FILTER (WHERE amount IS NOT NULL) AS first,
                  arg_max(amount, seq) FILTER (WHERE amount IS NOT NULL) AS last,
                  arg_max(month, (amount, -seq)) FILTER (WHERE amount IS NOT NULL) AS hi_m,
                  max(amount) AS hi_a,
                  arg_min(month, (amount, seq)) FILTER (WHERE amount IS NOT NULL) AS lo_m,
                  min(amount) AS lo_a FROM s GROUP BY account)""")
ORACLE["first_bill_per_file"] = W("""
    SELECT file, pos, account, text FROM bill_text QUALIFY row_number() OVER (PARTITION BY file ORDER BY pos) = 1""",
                                  "bill_text")

# --- leader timeline -----------------------------------------------------


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{P.SPACE}+|{P.SPACE}+\\z', '', 'g')"


def _title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|\\P{{L}}+)'), "
            f"lambda w: upper(w[1]) || lower(w[2:])), '')")


_HOLDERS = """
    SELECT s.office, s.stmt, s.person, coalesce(l.label, 'Q' || CAST(s.person AS VARCHAR)) AS leader,
           st.value AS start_value, e.value AS end_value
    FROM statements s JOIN starts st ON s.stmt = st.stmt
    LEFT JOIN ends e ON s.stmt = e.stmt
    LEFT JOIN (SELECT qid, label FROM labels_q WHERE lang = 'en') l ON s.person = l.qid"""
_TENURE = f"""
    h AS ({_HOLDERS}),
    t AS (SELECT office, stmt, leader,
                 timezone('UTC', TRY_CAST(replace(start_value, '+', '') AS TIMESTAMPTZ)) AS start,
                 coalesce(timezone('UTC', TRY_CAST(replace(end_value, '+', '') AS TIMESTAMPTZ)), {_RUN}) AS "end"
          FROM h),
    tt AS (SELECT *, CAST(year(start) AS INTEGER) AS start_year, CAST(year("end") AS INTEGER) AS end_year,
                  CAST(year(start) AS VARCHAR) || '-' || CAST(year("end") AS VARCHAR) AS tenure_label,
                  CAST(year("end") - year(start) AS INTEGER) AS years_served
           FROM t WHERE start IS NOT NULL)"""
_TL = ("statements", "starts", "ends", "labels_q")
sql("leader_holders", _HOLDERS, *_TL)
ORACLE["leader_tenure"] = W("SELECT * FROM tt", *_TL, ctes=_TENURE)
ORACLE["leader_years"] = W("""
    SELECT office, leader, CAST(sum(years_served) AS BIGINT) AS years_served, count(*) AS terms
    FROM tt GROUP BY 1, 2""", *_TL, ctes=_TENURE)
sql("office_lookup", """
    SELECT p4.question_id, p4.question, p4.role, p4.country, p4.search_term, o.office_qid
    FROM p4 LEFT JOIN o ON lower(p4.search_term) = o.term""", "questions", "offices", ctes=f"""
    p AS (SELECT question_id, question, lower(question) AS t FROM questions),
    p2 AS (SELECT *, CASE WHEN contains(t, 'prime minister') THEN 'Prime Minister'
                          WHEN contains(t, 'president') THEN 'President' END AS r FROM p),
    p3 AS (SELECT question_id, question,
                  CASE WHEN r IS NOT NULL AND contains(t, 'of') THEN r END AS role,
                  CASE WHEN r IS NOT NULL AND contains(t, 'of')
                       THEN {_title(_strip("string_split(t, 'of')[-1]"))} END AS country FROM p2),
    p4 AS (SELECT *, role || ' of ' || country AS search_term FROM p3),
    o AS (SELECT lower(label) AS term, arg_min(qid, (rank, qid)) AS office_qid FROM offices GROUP BY 1)""")
sql("bindings_flatten", f"""
    SELECT event_id, pos,
      json_extract_string(body, '$.results.bindings[' || pos || '].personLabel.value') AS person,
      json_extract_string(body, '$.results.bindings[' || pos || '].start.value') AS start,
      coalesce(json_extract_string(body, '$.results.bindings[' || pos || '].end.value'),
               strftime({_RUN}, '%Y-%m-%dT%H:%M:%S')) AS "end"
    FROM (SELECT event_id, body,
                 unnest(range(0, CAST(json_array_length(body, '$.results.bindings') AS BIGINT))) AS pos
          FROM bindings_json)""", "bindings_json")

# --- documents and retrieval ---------------------------------------------
_STEP = P.CHUNK_SIZE - P.CHUNK_OVERLAP
_CHUNKS = f"""
    ch AS (SELECT doc_id, CAST(s // {_STEP} AS BIGINT) AS chunk_no, substring(text, s + 1, {P.CHUNK_SIZE}) AS chunk
           FROM (SELECT doc_id, text, unnest(range(0, length(text), {_STEP})) AS s FROM docs WHERE length(text) > 0))"""
sql("doc_chunks", "SELECT * FROM ch", "docs", ctes=_CHUNKS)
sql("page_text", """
    SELECT doc_id, string_agg(coalesce(text, ''), '' ORDER BY page_no) AS text, count(*) AS n_pages
    FROM pages_text GROUP BY doc_id""", "pages_text")
sql("clean_docs", f"""
    SELECT doc_id, CASE WHEN text IS NOT NULL AND {_strip('text')} <> '' THEN {_strip('text')} END AS text,
           CASE WHEN text IS NULL OR {_strip('text')} = '' THEN '{P.BLANK_TRANSCRIPT_MESSAGE}' END AS message
    FROM docs""", "docs")
_head, _rest = P.RAG_PROMPT.split("{context}")
_mid, _tail = _rest.split("{query}")


def _lit(s: str) -> str:
    return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in s.split("\n")) + ")"


_RAG = """
    el AS (SELECT label, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings),
    cm AS (SELECT label, i, CAST(avg(CAST(x AS DOUBLE)) AS FLOAT) AS m FROM el GROUP BY label, i),
    q AS (SELECT CAST(label AS BIGINT) AS query_id,
                 'Which passages are closest to label ' || CAST(label AS VARCHAR) || '?' AS question,
                 list(m ORDER BY i) AS qv FROM cm GROUP BY label),
    dist AS (SELECT q.query_id, e.vec_id,
                    list_sum(list_transform(generate_series(1, len(e.embedding)),
                             lambda j: pow(CAST(e.embedding[j] AS DOUBLE) - CAST(q.qv[j] AS DOUBLE), 2))) AS distance
             FROM q, embeddings e),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM dist
            QUALIFY rank <= 3),
    hits AS (SELECT top.query_id, top.rank, top.vec_id, top.distance, d.text FROM top JOIN documents d ON d.doc_id = top.vec_id),
    ctx AS (SELECT query_id, count(*) AS n_hits, string_agg(text, chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id),
    pr AS (SELECT q.query_id, q.question, CAST(coalesce(ctx.n_hits, 0) AS BIGINT) AS n_hits,
                  CASE WHEN coalesce(ctx.n_hits, 0) > 0 THEN 'rag' ELSE 'direct' END AS route,
                  CASE WHEN coalesce(ctx.n_hits, 0) > 0 THEN """ + _lit(_head) + " || ctx.context || " + _lit(_mid) \
    + " || q.question || " + _lit(_tail) + """ ELSE q.question END AS prompt
           FROM q LEFT JOIN ctx ON q.query_id = ctx.query_id)"""
sql("vector_topk", "SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(distance, 6) AS distance, text FROM hits",
    ctes=_RAG)
ORACLE["vector_topk_pruned"] = ORACLE["vector_topk"]
_STORED = _RAG[:_RAG.index("    dist AS")] + """
    un AS (SELECT arg_min(doc_id, (doc_id, chunk_no)) AS doc_id, arg_min(chunk_no, (doc_id, chunk_no)) AS chunk_no, chunk
           FROM ch GROUP BY chunk),
    st AS (SELECT row_number() OVER (ORDER BY doc_id, chunk_no) AS chunk_id, un.*, e.embedding
           FROM un LEFT JOIN embeddings e ON e.vec_id = un.doc_id),
    ve AS (SELECT q.query_id, e.vec_id,
                  list_sum(list_transform(generate_series(1, len(e.embedding)),
                           lambda j: pow(CAST(e.embedding[j] AS DOUBLE) - CAST(q.qv[j] AS DOUBLE), 2))) AS distance
           FROM q, embeddings e),
    top AS (SELECT ve.query_id, st.chunk_id, st.chunk AS text, ve.distance,
                   row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
            FROM ve JOIN st ON st.doc_id = ve.vec_id QUALIFY rank <= 3),
    hits AS (SELECT * FROM top WHERE distance <= """ + str(Q.RAG_MAX_DISTANCE) + "),\n" + _RAG[_RAG.index("    ctx AS"):]
sql("chunk_store_prompts", "SELECT * FROM pr", "docs", ctes=_CHUNKS + "," + _STORED)
sql("rag_prompts", "SELECT * FROM pr", ctes=_RAG)
sql("rag_routes", "SELECT query_id, n_hits, route FROM pr", ctes=_RAG)
sql("chunk_store_append", """
    SELECT chunk_id, doc_id, chunk_no, text_hash, chunk FROM store
    UNION ALL
    SELECT (SELECT max(chunk_id) FROM store) + row_number() OVER (ORDER BY doc_id, chunk_no), doc_id, chunk_no, h, chunk
    FROM b1 WHERE h NOT IN (SELECT text_hash FROM store)""", "docs", ctes=_CHUNKS + """,
    chh AS (SELECT *, sha256(chunk) AS h FROM ch),
    s1 AS (SELECT h, arg_min(doc_id, (doc_id, chunk_no)) AS doc_id, arg_min(chunk_no, (doc_id, chunk_no)) AS chunk_no,
                  any_value(chunk) AS chunk
           FROM chh WHERE doc_id IN (SELECT doc_id FROM docs WHERE lang = 'en') GROUP BY h),
    store AS (SELECT row_number() OVER (ORDER BY doc_id, chunk_no) AS chunk_id, doc_id, chunk_no, h AS text_hash, chunk FROM s1),
    b1 AS (SELECT h, arg_min(doc_id, (doc_id, chunk_no)) AS doc_id, arg_min(chunk_no, (doc_id, chunk_no)) AS chunk_no,
                  any_value(chunk) AS chunk
           FROM chh GROUP BY h)""")

# --- health measurements -------------------------------------------------
sql("health_kpis", """
    SELECT CAST(printf('%.1f', avg(heart_rate)) AS DOUBLE) AS avg_heart_rate,
           CAST(trunc(avg(steps)) AS BIGINT) AS avg_steps,
           CAST(printf('%.1f', avg(sleep_hours)) AS DOUBLE) AS avg_sleep FROM health""", "health")
_ALERTS = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(a, 6) AS average, CAST({lim} AS DOUBLE) AS \"limit\", '{msg}' AS message "
    f"FROM (SELECT avg(CAST({m} AS DOUBLE)) AS a FROM health) WHERE a {op} {lim}"
    for m, op, lim, msg in P.HEALTH_ALERTS)
sql("health_alerts", _ALERTS, "health")
sql("health_slice", f"""
    SELECT pos, date, heart_rate, steps, sleep_hours, bp_systolic
    FROM (SELECT *, row_number() OVER (ORDER BY date) - 1 AS pos FROM health)
    WHERE pos BETWEEN {Q.SLICE_START} AND {Q.SLICE_END}""", "health")
sql("health_metric_series", "SELECT date, heart_rate FROM health", "health")
sql("health_long", """
    SELECT date, variable, value FROM
      (SELECT date, CAST(heart_rate AS DOUBLE) AS heart_rate, CAST(steps AS DOUBLE) AS steps,
              CAST(sleep_hours AS DOUBLE) AS sleep_hours, CAST(bp_systolic AS DOUBLE) AS bp_systolic FROM health)
    UNPIVOT INCLUDE NULLS (value FOR variable IN (heart_rate, steps, sleep_hours, bp_systolic))""", "health")
sql("health_repair", """
    SELECT TRY_CAST(nullif(trim(p[1]), '') AS DATE) AS date, TRY_CAST(nullif(trim(p[2]), '') AS DOUBLE) AS heart_rate,
           TRY_CAST(nullif(trim(p[3]), '') AS BIGINT) AS steps, TRY_CAST(nullif(trim(p[4]), '') AS DOUBLE) AS sleep_hours,
           TRY_CAST(nullif(trim(p[5]), '') AS BIGINT) AS bp_systolic, CAST(NULL AS VARCHAR) AS error
    FROM (SELECT string_split(concat_ws(',', coalesce(CAST(date AS VARCHAR), ''), coalesce(CAST(heart_rate AS VARCHAR), ''),
                 coalesce(CAST(steps AS VARCHAR), ''), coalesce(CAST(sleep_hours AS VARCHAR), ''),
                 coalesce(CAST(bp_systolic AS VARCHAR), '')), ',') AS p FROM health)""", "health")
sql("preview", "SELECT * FROM health ORDER BY date LIMIT 5", "health")

# --- chat ----------------------------------------------------------------
sql("chat_transcript", """
    SELECT c.conv_id, c.turn, c.role, c.text FROM chat c
    JOIN (SELECT conv_id, min(turn) AS f FROM chat GROUP BY conv_id) m ON c.conv_id = m.conv_id
    WHERE NOT coalesce(c.turn = m.f AND c.role = 'system', false)""", "chat")
sql("chat_append", """
    SELECT conv_id, turn, role, text FROM chat
    UNION ALL
    SELECT n.conv_id, coalesce(l.lt, -1) + row_number() OVER (PARTITION BY n.conv_id ORDER BY n.src_turn), n.role, n.text
    FROM (SELECT conv_id, turn AS src_turn, role, 'again: ' || text AS text FROM chat WHERE role = 'user') n
    LEFT JOIN (SELECT conv_id, max(turn) AS lt FROM chat GROUP BY conv_id) l ON n.conv_id = l.conv_id""", "chat")

# --- attachments ---------------------------------------------------------
_VALID = """
    va AS (SELECT msg_id, user_id, subject, received, pos, file_name,
                  CASE WHEN lower(file_name) LIKE '%.xlsx' OR lower(file_name) LIKE '%.xls' THEN 'excel' ELSE 'csv' END AS reader
           FROM attachment_files
           WHERE contains(lower(subject), 'attachment')
             AND (lower(file_name) LIKE '%.xlsx' OR lower(file_name) LIKE '%.xls' OR lower(file_name) LIKE '%.csv'))"""
sql("latest_attachment", "SELECT * FROM va ORDER BY received DESC, msg_id, pos LIMIT 1", "attachment_files", ctes=_VALID)
sql("latest_attachment_per_user", """
    SELECT user_id, msg_id, subject, received, pos, file_name, reader FROM va
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY received DESC, msg_id, pos) = 1""",
    "attachment_files", ctes=_VALID)

# --- files, tables, streaming --------------------------------------------
sql("csv_roundtrip", "SELECT * FROM health", "health")
sql("csv_encodings", r"""
    SELECT doc_id, lang,
           CASE WHEN lang IN ('en', 'es') THEN text ELSE regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') END AS text,
           CASE WHEN lang IN ('en', 'es') THEN 'UTF-8' ELSE 'ISO-8859-1' END AS encoding FROM documents""")
sql("csv_bad_rows", """
    SELECT strftime(date, '%Y-%m-%d') AS day, day(date) % 7 = 0 AS bad FROM health""", "health")
sql("csv_text_roundtrip", r"""
    SELECT doc_id, text || chr(10) || '"a", \ "b""c"\' AS text, 'end' AS tail FROM documents""")
sql("unicode_search", f"""
    SELECT doc_id FROM documents WHERE regexp_matches(text, '{Q.UNICODE_SEARCH}', 'i')""")
sql("stream_landing", "SELECT *, true AS in_source FROM health", "health")
sql("create_table", "SELECT * FROM contacts", "contacts")
_STATS = ", ".join(f"('{s}', {i})" for i, s in enumerate(
    ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]))
sql("analysis_prompt", """
    SELECT summary, 'Analyze this data:' || chr(10) || summary AS prompt FROM (
      SELECT string_agg(metric || ' ' || stat || ' ' || coalesce(printf('%.6f', value), 'NaN'), chr(10)
                        ORDER BY metric, o) AS summary
      FROM (SELECT l.metric, l.stat, round(l.value, 6) AS value, so.o FROM
              (SELECT metric, stat, value FROM (
                 SELECT metric, CAST(count(v) AS DOUBLE) AS "count", avg(v) AS "mean", stddev_samp(v) AS "std",
                        min(v) AS "min", quantile_cont(v, 0.25) AS "25%", quantile_cont(v, 0.5) AS "50%",
                        quantile_cont(v, 0.75) AS "75%", max(v) AS "max"
                 FROM (SELECT 'heart_rate' AS metric, CAST(heart_rate AS DOUBLE) AS v FROM health
                       UNION ALL SELECT 'steps', CAST(steps AS DOUBLE) FROM health
                       UNION ALL SELECT 'sleep_hours', CAST(sleep_hours AS DOUBLE) FROM health
                       UNION ALL SELECT 'bp_systolic', CAST(bp_systolic AS DOUBLE) FROM health)
                 WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY metric)
               UNPIVOT INCLUDE NULLS (value FOR stat IN ("count", "mean", "std", "min", "25%", "50%", "75%", "max"))) l
            JOIN (VALUES """ + _STATS + """) so(s, o) ON l.stat = so.s))""", "health")

sql("csv_typed_read", """
    SELECT CAST(o_orderkey AS BIGINT) AS "order",
           CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS BIGINT) END AS customer,
           CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS price,
           CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS day,
           CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey % 2 = 0 END AS even,
           CASE WHEN o_orderkey % 17 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)
                + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL '10:20:30' ELSE INTERVAL 0 SECOND END END AS moment,
           CASE WHEN o_orderkey % 19 <> 0 THEN o_orderstatus END AS status,
           CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR)
                ELSE strftime(o_orderdate, '%Y-%m-%d') END AS mixed,
           CAST(NULL AS VARCHAR) AS nothing FROM orders""")
sql("landing_statuses", """
    SELECT 'good' AS source, 'ok' AS status, count(*) AS lines,
           CAST(sum(octet_length(encode(concat_ws(',', id, name, city))) + 1) AS BIGINT) AS line_bytes
    FROM contacts WHERE name IS NOT NULL AND city IS NOT NULL
    UNION ALL SELECT * FROM (VALUES ('header_only', 'empty', CAST(0 AS BIGINT), CAST(NULL AS BIGINT)),
        ('other', 'bad file', 0, NULL), ('blank', 'empty', 0, NULL), ('nothing', 'none found', 0, NULL))""", "contacts")
ORACLE["bill_months_seen"] = _bills("""
    SELECT month AS option, row_number() OVER (ORDER BY min(pos)) AS ord FROM bills
    WHERE month IS NOT NULL GROUP BY month""")
ORACLE["stream_first_bills"] = ORACLE["first_bill_per_file"]
_FILES = f"""
    files AS (SELECT CAST(floor(doc_id / {Q.FILE_DOCS}) AS BIGINT) AS bucket,
                     string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id, text NULLS FIRST) AS t
              FROM docs GROUP BY 1)"""
sql("whole_text_files", r"""
    SELECT 'utf8' AS encoding, bucket, 'ok' AS status, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5
    FROM files
    UNION ALL
    SELECT 'latin1', bucket, CASE WHEN bad THEN 'quarantine' ELSE 'ok' END,
           CASE WHEN NOT bad THEN CAST(length(t) AS BIGINT) END,
           CASE WHEN NOT bad THEN md5(regexp_replace(t, '[^\x{0}-\x{FF}]', '?', 'g')) END
    FROM (SELECT *, regexp_matches(t, '[\x{80}-\x{FF}]') AS bad FROM files)""", "docs", ctes=_FILES)
sql("dispatch_totals", """
    SELECT 'txt' AS kind, 'ok' AS status, CAST(count(*) AS BIGINT) AS "rows",
           CAST(sum(octet_length(encode(t))) AS BIGINT) AS bytes FROM files
    UNION ALL SELECT 'csv', 'ok', (SELECT count(*) FROM health), NULL
    UNION ALL SELECT 'unsupported', 'unsupported', NULL, NULL""", "docs", "health", ctes=_FILES)
sql("landed_sizes", """
    SELECT count(*) AS "rows", CAST(3 AS INTEGER) AS "columns", CAST(0 AS BIGINT) AS missing, 'ok' AS status,
           CAST(sum(octet_length(encode(concat_ws(',', id, name, city))) + 1) AS BIGINT) AS line_bytes
    FROM contacts WHERE name IS NOT NULL AND city IS NOT NULL""", "contacts")
_COUNTS = ", ".join(f"length(chunk) - length(replace(chunk, '{c}', ''))" for c in Q.LETTERS)
sql("letter_vectors", f"SELECT doc_id, chunk_no, concat_ws(',', {_COUNTS}) AS vector FROM ch", "docs", ctes=_CHUNKS)
