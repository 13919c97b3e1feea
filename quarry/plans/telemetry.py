"""Telemetry, decisions, findings and review tables."""

S = {}

S["a20_usage_report_daily"] = """SELECT CAST(created_at AS DATE) AS report_date, count(*) AS runs, CAST(sum(issues_total) AS BIGINT) AS issues, CAST(sum(issues_fixed) AS BIGINT) AS fixed, CAST(sum(llm_calls) AS BIGINT) AS calls, avg(duration_ms) AS avg_duration FROM runs GROUP BY CAST(created_at AS DATE)"""
S["a20_usage_report_weekly"] = """SELECT CAST(date_trunc('week', created_at) AS DATE) AS week, count(*) AS runs, CAST(sum(issues_total) AS BIGINT) AS issues, CAST(sum(llm_calls) AS BIGINT) AS calls FROM runs GROUP BY 1"""
S["a20_report_top_types"] = """SELECT category, severity, count(*) AS n FROM findings GROUP BY category, severity ORDER BY n DESC, category, severity LIMIT 10"""
S["a20_report_top_files"] = """SELECT file_key, count(*) AS n FROM findings GROUP BY file_key ORDER BY n DESC, file_key LIMIT 10"""
S["a20_report_upsert"] = """WITH old AS (SELECT CAST(created_at AS DATE) AS d, mode, count(*) AS n FROM runs WHERE run_id % 2 = 0 GROUP BY 1, 2), new AS (SELECT CAST(created_at AS DATE) AS d, mode, count(*) AS n FROM runs WHERE run_id % 3 = 0 GROUP BY 1, 2)
SELECT d, mode, n FROM new UNION ALL SELECT o.d, o.mode, o.n FROM old o LEFT JOIN new n ON o.d = n.d AND o.mode = n.mode WHERE n.d IS NULL"""
S["a21_decision_upsert"] = """WITH old AS (SELECT id, action, decided_at FROM decisions WHERE id % 3 <> 0), new AS (SELECT id, 'FIX' AS action, decided_at + 1 AS decided_at FROM decisions WHERE id % 2 = 0)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.action, o.action) AS action, coalesce(n.decided_at, o.decided_at) AS decided_at FROM old o FULL OUTER JOIN new n ON o.id = n.id"""
S["a22_rule_upsert"] = """WITH old AS (SELECT rule_id, first_word FROM rules WHERE rule_id % 2 = 0), new AS (SELECT rule_id, concat(first_word, '!') AS first_word FROM rules WHERE rule_id % 3 = 0)
SELECT coalesce(n.rule_id, o.rule_id) AS rule_id, coalesce(n.first_word, o.first_word) AS first_word FROM old o FULL OUTER JOIN new n ON o.rule_id = n.rule_id"""
S["a23_summary_stats"] = """SELECT count(*) AS runs, count(*) FILTER (WHERE mode = 'analysis') AS analysis_runs, count(*) FILTER (WHERE mode = 'fixer') AS fixer_runs, count(*) FILTER (WHERE mode = 'patch') AS patch_runs, CAST(coalesce(sum(issues_total), 0) AS BIGINT) AS issues, CAST(coalesce(sum(issues_fixed), 0) AS BIGINT) AS fixed, avg(duration_ms) AS avg_duration FROM runs"""
S["a24_issues_by_severity"] = """SELECT CASE WHEN value >= 75 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM tel_events WHERE event_type = 'issue_found' GROUP BY 1"""
S["a24_top_issue_types"] = """SELECT k AS issue_type, count(*) AS n FROM tel_events WHERE event_type = 'issue_found' GROUP BY k ORDER BY n DESC, issue_type LIMIT 20"""
S["a25_runs_per_day"] = """SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM runs WHERE created_at >= (SELECT max(created_at) - INTERVAL '30' DAY FROM runs) GROUP BY 1"""
S["a26_fix_success_rate"] = """SELECT mode, CASE WHEN sum(issues_fixed + issues_failed) > 0 THEN round(100.0 * CAST(sum(issues_fixed) AS DOUBLE) / CAST(sum(issues_fixed + issues_failed) AS DOUBLE), 1) ELSE 0.0 END AS rate FROM runs GROUP BY mode"""
S["a27_llm_usage"] = """SELECT provider, model, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, avg(latency_ms) AS avg_latency FROM llm_calls GROUP BY provider, model"""
S["a28_cost_by_model"] = """SELECT c.provider, c.model, CAST(sum(c.prompt_tokens * p.price_in + c.completion_tokens * p.price_out) AS BIGINT) AS micro_cost, count(*) AS calls FROM llm_calls c JOIN prices p ON c.provider = p.provider GROUP BY c.provider, c.model"""
S["a28_cost_daily"] = """SELECT CAST(c.ts AS DATE) AS day, CAST(sum(c.prompt_tokens * p.price_in + c.completion_tokens * p.price_out) AS BIGINT) AS micro_cost FROM llm_calls c JOIN prices p ON c.provider = p.provider GROUP BY 1"""
S["a29_constraint_effect"] = """SELECT rule, action, count(*) AS hits, count(DISTINCT run_id) AS runs FROM hits GROUP BY rule, action"""
S["a29_constraint_totals"] = """SELECT count(*) AS hits, count(*) FILTER (WHERE action = 'suppress') AS suppressions FROM hits"""
S["a30_false_positive_rate"] = """SELECT category, count(*) AS n, count(*) FILTER (WHERE is_false_positive) AS false_positives, round(100.0 * CAST(count(*) FILTER (WHERE is_false_positive) AS DOUBLE) / CAST(count(*) AS DOUBLE), 2) AS rate FROM findings GROUP BY category"""
S["a31_agent_comparison"] = """SELECT mode, count(*) AS runs, count(*) FILTER (WHERE status = 'done') AS done, CAST(sum(issues_total) AS BIGINT) AS issues, avg(duration_ms) AS avg_duration, max(duration_ms) AS max_duration FROM runs GROUP BY mode"""
S["a32_decision_stats"] = """SELECT action, count(*) AS n, (SELECT count(*) FROM decisions) AS total, (SELECT count(*) FROM rules) AS n_rules FROM decisions GROUP BY action"""
S["a33_duplicate_uuids"] = """SELECT md5(text) AS uuid, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1"""
S["a34_review_summary"] = """SELECT upper(trim(severity)) AS severity, category, count(*) AS n, count(DISTINCT file_key) AS files FROM findings GROUP BY upper(trim(severity)), category"""
S["a35_audit_stats"] = """SELECT count(*) FILTER (WHERE action = 'FIX') AS fixed, count(*) FILTER (WHERE action LIKE '%REVIEW%') AS review, count(*) FILTER (WHERE action = 'SKIP') AS skipped, count(*) FILTER (WHERE action NOT IN ('FIX', 'SKIP') AND action NOT LIKE '%REVIEW%') AS other FROM decisions"""
S["a36_directive_stats"] = """SELECT issue_type, action, count(*) AS n FROM decisions GROUP BY issue_type, action"""
S["a37_execution_report"] = """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'error') AS failed FROM llm_calls"""
S["a38_latency_histogram"] = """SELECT CAST(floor(latency_ms / 100) AS BIGINT) AS bucket, count(*) AS n, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens FROM llm_calls GROUP BY 1"""
S["a40_top_issues_per_category"] = """SELECT category, file_key, n FROM (SELECT category, file_key, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, file_key) AS r FROM findings GROUP BY category, file_key) t WHERE r <= 10"""
S["o05_recent_runs"] = """SELECT run_id, created_at, mode, status FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 50"""
S["o05_run_events"] = """SELECT event_id, ts, event_type FROM tel_events WHERE user_id = 7 ORDER BY ts, event_id"""
S["o03_top_violations"] = """SELECT severity, rule_key, count(*) AS n FROM findings GROUP BY severity, rule_key ORDER BY n DESC, severity, rule_key LIMIT 10"""
S["o04_top_lint_categories"] = """SELECT category, count(*) AS n FROM findings WHERE severity IN ('critical', 'high') GROUP BY category ORDER BY n DESC, category LIMIT 5"""
S["o07_worst_first"] = """SELECT file_key, line_start, severity FROM findings WHERE severity = 'critical' ORDER BY file_key, run_id, line_start LIMIT 10"""
S["s26_run_finish"] = """SELECT r.run_id, coalesce(u.status, r.status) AS status, coalesce(u.n, 0) AS n_findings FROM runs r LEFT JOIN (SELECT run_id, 'finished' AS status, count(*) AS n FROM findings GROUP BY run_id) u ON r.run_id = u.run_id"""
S["f04_findings_filter"] = """SELECT run_id, line_start, severity, category FROM findings WHERE severity IN ('critical', 'high') AND category IN ('R', 'A')"""
S["f06_audit_counts"] = """SELECT file_path, count(*) FILTER (WHERE action = 'FIX') AS accepted, count(*) FILTER (WHERE action = 'SKIP') AS rejected, count(*) FILTER (WHERE action = 'FIX_WITH_CONSTRAINTS') AS partial FROM decisions GROUP BY file_path"""
S["f07_decision_filter"] = """SELECT id, file_path, action, decided_at FROM decisions WHERE file_path LIKE '%e%' AND action = 'FIX' ORDER BY decided_at DESC, id DESC LIMIT 200"""
S["f08_point_lookup"] = """SELECT id, issue_type, action FROM decisions WHERE issue_type = 'src3'"""
S["f13_suppression"] = """SELECT d.id, d.issue_type FROM decisions d LEFT JOIN (SELECT DISTINCT issue_type FROM decisions WHERE action = 'SKIP') s ON d.issue_type = s.issue_type WHERE s.issue_type IS NULL"""
S["f14_active_tasks"] = """SELECT action <> 'SKIP' AS active, count(*) AS n FROM decisions GROUP BY 1"""
S["f16_directives"] = """SELECT id, CASE action WHEN 'FIX' THEN 'apply' WHEN 'NEEDS_REVIEW' THEN 'review' ELSE 'apply_with_limits' END AS directive FROM decisions WHERE action <> 'SKIP'"""
S["f18_infer_action"] = """SELECT doc_id, CASE WHEN lower(text) LIKE '%skip%' OR lower(text) LIKE '%false positive%' THEN 'SKIP' WHEN lower(text) LIKE '%only%' THEN 'FIX_WITH_CONSTRAINTS' WHEN lower(text) LIKE '%review%' THEN 'NEEDS_REVIEW' ELSE 'FIX' END AS action FROM documents"""
S["f23_phase"] = """SELECT conv_id, turn, CASE WHEN lower(text) LIKE '%scan%' THEN 'scan' WHEN lower(text) LIKE '%the%' THEN 'analyse' WHEN lower(text) LIKE '%report%' THEN 'report' ELSE 'other' END AS phase FROM turns"""
S["f28_followup"] = """SELECT conv_id, turn FROM (SELECT conv_id, turn, role, concat(text, CASE WHEN turn % 3 = 1 THEN '?' ELSE '' END) AS text FROM turns) t WHERE role = 'assistant' AND (lower(text) LIKE 'could%' OR text LIKE '%?%')"""
S["j07_skip_history"] = """SELECT DISTINCT d.issue_type FROM decisions d JOIN (SELECT DISTINCT issue_type FROM decisions WHERE action = 'SKIP') s ON d.issue_type = s.issue_type"""
S["j08_new_uuids"] = """SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL"""
S["j15_new_finding_gate"] = """SELECT f.run_id, f.line_start, f.line_no FROM findings f WHERE EXISTS (SELECT 1 FROM hunks h WHERE h.file_key = f.run_id AND f.line_no BETWEEN h.new_start - 3 AND h.new_start + h.new_count - 1 + 3)"""
S["j16_fingerprint_anti"] = """WITH prints AS (SELECT run_id, line_start, concat(category, ':', severity, ':', CAST(CAST(floor(line_no / 5) AS BIGINT) * 5 AS STRING)) AS print FROM findings)
SELECT p.run_id, p.line_start, p.print FROM prints p WHERE p.run_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM prints o WHERE o.run_id = p.run_id + 1 AND o.print = p.print)"""
S["j17_in_hunk"] = """SELECT f.run_id, f.line_start FROM findings f JOIN hunks h ON h.file_key = f.run_id WHERE f.line_no BETWEEN h.new_start AND h.new_start + h.new_count - 1"""
S["j18_task_chunks"] = """SELECT f.run_id, f.line_start, c.i AS chunk FROM findings f JOIN (SELECT i, i * 10 + 1 AS a, i * 10 + 10 AS b FROM (VALUES (0), (1), (2), (3), (4)) AS t(i)) c ON f.line_no BETWEEN c.a - 5 AND c.b + 5"""
S["j20_traceability"] = """SELECT r.run_id, coalesce(a.status, f.status, 'PENDING') AS status FROM runs r LEFT JOIN (SELECT DISTINCT run_id, 'AUDITED' AS status FROM findings WHERE severity = 'critical') a ON r.run_id = a.run_id LEFT JOIN (SELECT DISTINCT run_id, 'FIXED' AS status FROM findings WHERE severity = 'low') f ON r.run_id = f.run_id"""
S["j21_candidates"] = """SELECT id, issue_type FROM decisions WHERE issue_type = 'src1' UNION SELECT id, issue_type FROM decisions WHERE file_path LIKE '%fr%'"""
S["j22_rule_applicability"] = """SELECT t.conv_id, t.turn, r.rule_id FROM turns t JOIN rules r ON lower(split_part(t.text, ' ', 1)) = r.first_word"""
S["j28_write_back"] = """SELECT d.id, coalesce(e.action, d.action) AS action FROM decisions d LEFT JOIN (SELECT file_path, issue_type, max(action) AS action FROM decisions WHERE id % 5 = 0 GROUP BY file_path, issue_type) e ON trim(d.file_path) = trim(e.file_path) AND trim(d.issue_type) = trim(e.issue_type)"""
S["w05_first_wins"] = """SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, lang"""
S["w06_last_wins"] = """SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM tel_events) t WHERE r = 1"""
S["w09_patch_offset"] = """SELECT run_id, line_start, CAST(coalesce(sum(line_no % 7 - 3) OVER (PARTITION BY run_id ORDER BY line_start, file_key, rule_key, line_no, category, created_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM findings"""
S["w10_budget"] = """SELECT source, doc_id FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) t WHERE used <= 6000"""
S["w12_rank_by_action"] = """SELECT issue_type, id, r FROM (SELECT issue_type, id, row_number() OVER (PARTITION BY issue_type ORDER BY CASE action WHEN 'FIX_WITH_CONSTRAINTS' THEN 3 WHEN 'FIX' THEN 2 WHEN 'NEEDS_REVIEW' THEN 1 ELSE 0 END DESC, decided_at DESC, id) AS r FROM decisions) t WHERE r <= 5"""
S["w13_section_ranges"] = """SELECT run_id, line_start, lead(line_start) OVER (PARTITION BY run_id ORDER BY line_start, file_key, rule_key, line_no, category, created_at) AS next_start FROM findings"""
S["w14_nearest_scope"] = """SELECT run_id, line_start, max(CASE WHEN category = 'R' THEN line_start END) OVER (PARTITION BY run_id ORDER BY line_start, file_key, rule_key, line_no, category, created_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM findings"""
S["w15_chat_context"] = """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE 'system' END AS role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM turns) t WHERE r <= 25"""
S["w17_padded_windows"] = """SELECT file_key, greatest(1, new_start - 20) AS a, least(60, new_start + new_count + 20) AS b FROM hunks"""
S["u01_union_findings"] = """SELECT severity, count(*) AS n FROM (SELECT severity FROM findings WHERE category = 'R' UNION ALL SELECT severity FROM findings WHERE category <> 'R') t GROUP BY severity"""
S["u08_union_dedup"] = """SELECT id FROM decisions WHERE action = 'FIX' UNION SELECT id FROM decisions WHERE id % 2 = 0"""
S["f10_valid_records"] = """SELECT doc_id FROM documents WHERE coalesce(text, '') <> '' OR coalesce(lang, '') <> '' OR coalesce(source, '') <> ''"""
S["f26_target_issues"] = """SELECT file_key, count(*) AS n FROM findings WHERE CAST(file_key AS STRING) LIKE '%12%' GROUP BY file_key"""
S["s21_change_detection"] = """SELECT d.doc_id, md5(d.text) AS digest FROM documents d LEFT JOIN (SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id % 2 = 0) o ON d.doc_id = o.doc_id AND md5(d.text) = o.digest WHERE o.doc_id IS NULL"""
S["s24_readme_excerpt"] = """SELECT page_id, CASE WHEN length(html) > 1000 THEN concat(substr(html, 1, 1000), '...') ELSE html END AS excerpt FROM pages"""
S["v11_documents_by_type"] = """SELECT lang AS type, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang"""
S["t04_dedup_on_ingest"] = """SELECT min(doc_id) AS doc_id, md5(text) AS uuid FROM documents GROUP BY md5(text)"""
