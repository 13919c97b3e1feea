"""The engine's relations as views over the star schema: runs, findings, calls, decisions, vectors and sources."""

EVENT = "CASE event_type WHEN 'error' THEN 'issue_found' WHEN 'purchase' THEN 'llm_call' WHEN 'signup' THEN 'issue_fixed' WHEN 'view' THEN 'constraint_applied' ELSE 'export_action' END"

RELATIONS = {
    "runs": """SELECT o_orderkey AS run_id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'P' THEN 'patch' WHEN 'O' THEN 'analysis' ELSE 'fixer' END AS mode,
        CASE WHEN o_custkey % 10 = 0 THEN 'failed' ELSE 'done' END AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS duration_ms, o_custkey % 7 AS issues_total, o_custkey % 5 AS issues_fixed,
        o_custkey % 3 AS issues_failed, o_orderkey % 9 AS llm_calls, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END AS user_key FROM orders""",
    "findings": """SELECT l_orderkey AS run_id, l_linenumber AS line_start, l_returnflag AS category, l_partkey AS file_key,
        CASE WHEN l_discount >= 0.08 THEN 'critical' WHEN l_discount >= 0.05 THEN 'high' WHEN l_discount >= 0.02 THEN 'medium' ELSE 'low' END AS severity,
        l_linestatus = 'F' AS is_false_positive, l_shipdate AS created_at, CAST(l_quantity AS INT) AS line_no, l_suppkey AS rule_key FROM lineitem""",
    "tel_events": f"""SELECT event_id, ts, user_id, {EVENT} AS event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events""",
    "llm_calls": """SELECT event_id AS call_id, ts, user_id AS run_id, CASE user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS provider,
        concat('model-', CAST(user_id % 5 AS STRING)) AS model, k AS prompt_tokens, CAST(floor(value) AS BIGINT) AS completion_tokens,
        CAST(floor(value * 10) AS BIGINT) AS latency_ms, CASE WHEN event_id % 20 = 0 THEN 'error' ELSE 'ok' END AS status FROM tel_events WHERE event_type = 'llm_call'""",
    "prices": """SELECT * FROM (VALUES ('alpha', 3, 15), ('beta', 1, 5), ('gamma', 2, 8)) AS t(provider, price_in, price_out)""",
    "hits": """SELECT event_id AS hit_id, ts, user_id AS run_id, concat('rule-', CAST(k % 12 AS STRING)) AS rule, CASE user_id % 4 WHEN 0 THEN 'suppress' WHEN 1 THEN 'modify' WHEN 2 THEN 'require' ELSE 'note' END AS action
        FROM tel_events WHERE event_type = 'constraint_applied'""",
    "decisions": """SELECT d.doc_id AS id, d.lang AS file_path, d.source AS issue_type, CASE WHEN l.toxic = 1 THEN 'SKIP' WHEN l.quality = 1 THEN 'FIX' WHEN d.doc_id % 3 = 0 THEN 'NEEDS_REVIEW' ELSE 'FIX_WITH_CONSTRAINTS' END AS action,
        d.n_chars AS decided_at FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "rules": """SELECT item_id AS rule_id, lower(split_part(text, ' ', 1)) AS first_word, text AS description FROM benchmark""",
    "modules": """SELECT p_partkey AS id, concat(CASE WHEN p_partkey % 17 = 0 THEN 'tb_' ELSE 'm' END, CAST(p_partkey AS STRING)) AS module, concat('rtl/d', CAST(p_partkey % 20 AS STRING), '/m', CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 0 THEN '.sv' WHEN 1 THEN '.v' WHEN 2 THEN '.svh' ELSE '.vh' END) AS file,
        p_size AS ports, CAST(floor(p_retailprice) AS INT) AS lines, p_brand AS owner, p_size % 13 AS cc, p_size % 6 AS nesting, p_partkey % 9 = 0 AS has_latch FROM part""",
    "edges": """SELECT DISTINCT parent, child FROM (SELECT p_partkey AS parent, 2 * p_partkey AS child FROM part UNION ALL SELECT p_partkey, 2 * p_partkey + 1 FROM part UNION ALL SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_suppkey < l_partkey) e
        WHERE child <= (SELECT max(p_partkey) + 20 FROM part)""",
    "include_rows": """SELECT p_partkey AS file_key, n.i AS line_no, CASE WHEN n.i = 1 THEN p_partkey / 3 WHEN n.i = 2 THEN p_partkey + 7 ELSE p_partkey * 5 END AS target, n.i = 2 AS is_package
        FROM part CROSS JOIN (VALUES (1), (2), (3)) AS n(i) WHERE p_size % 3 >= n.i - 1""",
    "hunks": """SELECT o_orderkey AS file_key, 1 + CAST(floor(o_totalprice) AS BIGINT) % 40 AS new_start, 1 + o_custkey % 6 AS new_count FROM orders""",
    "turns": """SELECT conv_id, turn, role, text FROM conversations""",
}
