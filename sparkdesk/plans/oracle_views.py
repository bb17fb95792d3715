"""DuckDB twins of the test views in ``sparkdesk.sources.views``.

Each entry is (sql, dependencies).  ``with_views`` prefixes a query with the
CTEs it needs, in dependency order.
"""

from __future__ import annotations

from sparkdesk.functions import patterns as P

_ISO = "%Y-%m-%dT%H:%M:%SZ"

VIEWS: dict[str, tuple[str, list[str]]] = {
    "contacts": ("""
      SELECT c.c_custkey AS id,
             CASE WHEN c.c_custkey % 29 <> 0 THEN c.c_name END AS name,
             CAST(9000000000 + c.c_custkey AS VARCHAR) AS phone,
             CASE WHEN c.c_custkey % 17 <> 0 THEN n.n_name END AS city,
             CASE WHEN c.c_custkey % 13 <> 0
                  THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(c.c_custkey % 90 AS INTEGER)) END AS created_at
      FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""", []),
    "uploads": ("""
      SELECT id * 10 AS upload_pos, name, phone, city FROM contacts WHERE id % 5 = 0
      UNION ALL
      SELECT id * 10 + 1, name, CAST(8000000000 + id AS VARCHAR), city FROM contacts WHERE id % 5 = 1
      UNION ALL
      SELECT id * 10 + 2, name, CAST(8000000000 + id AS VARCHAR), city FROM contacts WHERE id % 50 = 1""",
                ["contacts"]),
    "edits": ("""
      SELECT id, 'X' || CAST(id AS VARCHAR) AS name, phone, city, 1 AS seq FROM contacts WHERE id % 7 = 0
      UNION ALL
      SELECT id, 'Y' || CAST(id AS VARCHAR), phone, city, 2 FROM contacts WHERE id % 14 = 0
      UNION ALL
      SELECT id, CAST(NULL AS VARCHAR), phone, 'EDITED', 3 FROM contacts WHERE id % 21 = 0
      UNION ALL
      SELECT id + (SELECT max(id) FROM contacts), 'Z' || CAST(id AS VARCHAR), phone, city, 1
      FROM contacts WHERE id <= 10""", ["contacts"]),
    "deletes": ("SELECT id FROM edits WHERE seq = 2", ["edits"]),
    "bill_text": (f"""
      SELECT 'bill_' || CAST(o_custkey AS VARCHAR) || '_' || CAST(year(o_orderdate) AS VARCHAR) || '.pdf' AS file,
             o_orderkey AS pos, o_custkey AS account,
             'Statement ' || strftime(CAST(o_orderdate AS DATE), '%-d %b %Y') || ' - '
               || strftime(CAST(o_orderdate AS DATE) + 30, '%-d %b %Y')
               || CASE WHEN o_orderkey % 9 <> 0 THEN ' Total {P.CURRENCY} ' || format('{{:,.2f}}', o_totalprice) ELSE '' END
               || CASE WHEN o_orderkey % 4 = 0 THEN
                    chr(10) || '{P.PLAN_PREFIX} ' || o_orderpriority || chr(10) || 'Mobile '
                    || CAST(9000000000 + o_custkey AS VARCHAR) || ' Acct '
                    || CAST(100000000000 + o_custkey AS VARCHAR) || ' mail c' || CAST(o_custkey AS VARCHAR)
                    || '@bill.example' ELSE '' END AS text
      FROM orders""", []),
    "docs": ("SELECT * FROM documents", []),
    "health": ("""
      SELECT date,
             CASE WHEN day(date) % 7 <> 0 THEN heart_rate END AS heart_rate,
             steps, sleep_hours, bp_systolic
      FROM (SELECT CAST(ts AS DATE) AS date, round(avg(value), 6) AS heart_rate,
                   count(*) AS steps, round(avg(user_id % 10), 6) AS sleep_hours,
                   max(user_id) AS bp_systolic
            FROM events GROUP BY 1)""", []),
    "statements": ("SELECT o_orderkey AS stmt, o_custkey AS person, o_orderpriority AS office FROM orders", []),
    "starts": (f"SELECT o_orderkey AS stmt, '+' || strftime(o_orderdate, '{_ISO}') AS value FROM orders", []),
    "ends": (f"""
      SELECT o_orderkey AS stmt,
             CASE WHEN o_orderkey % 97 = 0 THEN 'garbage'
                  ELSE '+' || strftime(o_orderdate + INTERVAL 900 DAY, '{_ISO}') END AS value
      FROM orders WHERE o_orderstatus <> 'O'""", []),
    "labels_q": ("""
      SELECT c_custkey AS qid, 'en' AS lang, c_name AS label FROM customer WHERE c_custkey % 10 <> 0
      UNION ALL
      SELECT c_custkey, 'de', 'DE ' || c_name FROM customer""", []),
    "offices": ("""
      SELECT 'Q' || CAST(1000 * rk + n_nationkey * 2 + r_i AS VARCHAR) AS qid,
             role || ' of ' || n_name AS label, rk AS rank
      FROM nation,
           (VALUES (0, 'Prime Minister'), (1, 'President')) r(r_i, role),
           (VALUES (1), (2)) k(rk)
      WHERE rk = 1 OR n_nationkey % 5 = 0""", []),
    "questions": ("""
      SELECT c.c_custkey AS question_id,
             CASE c.c_custkey % 4
               WHEN 0 THEN 'Prime Ministers of ' || lower(n.n_name)
               WHEN 1 THEN 'PRESIDENTS OF ' || n.n_name
               WHEN 2 THEN '  Vice President of' || chr(9) || n.n_name || ' '
               ELSE 'leaders in ' || n.n_name END AS question
      FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""", []),
    "bindings_json": (f"""
      SELECT event_id,
        '{{"results":{{"bindings":[{{"personLabel":{{"value":"user ' || CAST(user_id AS VARCHAR)
        || '"}},"start":{{"value":"+' || strftime(ts, '{_ISO}') || '"}}'
        || CASE WHEN event_id % 3 = 0 THEN ''
                ELSE ',"end":{{"value":"' || strftime(ts + INTERVAL 30 DAY, '{_ISO}') || '"}}' END
        || '}},{{"personLabel":{{"value":"' || event_type || '"}},"start":{{"value":"'
        || json_extract_string(props, '$.k') || '"}}}}]}}}}' AS body
      FROM events""", []),
    "attachment_files": ("""
      SELECT event_id AS msg_id, user_id,
             CASE WHEN event_type = 'click' THEN 'Monthly ATTACHMENT' ELSE event_type END AS subject,
             ts AS received, CAST(i AS BIGINT) AS pos,
             'f' || CAST(event_id AS VARCHAR) || '_' || CAST(i AS VARCHAR)
               || (['.xlsx', '.CSV', '.pdf', '.csv', '.XLS', ''])[CAST((event_id + i) % 6 AS INTEGER) + 1] AS file_name
      FROM events, (VALUES (0), (1)) t(i)
      WHERE event_id % 11 <> 0""", []),
    "chat": ("SELECT * FROM conversations", []),
    "pages_text": ("SELECT conv_id AS doc_id, turn AS page_no, text FROM conversations", []),
}


def with_views(sql: str, *names: str, ctes: str = "") -> str:
    """Prefix ``sql`` with the named views (and their dependencies) as CTEs,
    followed by the extra ``ctes`` text (``a AS (...), b AS (...)``)."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in VIEWS[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({VIEWS[n][0]})" for n in order]
    if ctes.strip():
        parts.append(ctes.strip().lstrip(","))
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql
