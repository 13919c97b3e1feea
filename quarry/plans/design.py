"""Module graphs, metrics, thresholds and scores of a design."""

S = {}

S["a01_structure_summary"] = "SELECT split_part(file, '.', 2) AS suffix, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, avg(lines) AS avg_lines FROM modules GROUP BY 1"
S["a01_source_header_ratio"] = "SELECT round(CAST(count(*) FILTER (WHERE file LIKE '%.v' OR file LIKE '%.sv') AS DOUBLE) / greatest(1, count(*) FILTER (WHERE file LIKE '%.vh' OR file LIKE '%.svh')), 4) AS ratio FROM modules"
S["a02_top_includes"] = "SELECT CAST(floor(target) AS BIGINT) AS target, count(*) AS n FROM include_rows WHERE NOT is_package GROUP BY 1 ORDER BY n DESC, target LIMIT 10"
S["a03_module_stats"] = "SELECT owner, count(*) AS n, avg(ports) AS avg_ports, max(ports) AS max_ports, min(ports) AS min_ports FROM modules GROUP BY owner"
S["a06_complexity_score"] = "SELECT owner, round(greatest(0.0, 100.0 - least(40.0, avg(cc) * 3) - least(30.0, 2.0 * count(*) FILTER (WHERE cc > 10)) - least(30.0, count(*) FILTER (WHERE nesting > 4))), 4) AS score FROM modules GROUP BY owner"
S["a16_module_metrics"] = "SELECT count(*) AS modules, CAST(sum(ports) AS BIGINT) AS ports, count(*) FILTER (WHERE ports > 30) AS over_30_ports, count(*) FILTER (WHERE lines > 800) AS over_800_lines, count(*) FILTER (WHERE has_latch) AS latches FROM modules"
S["a17_upper_median"] = "SELECT owner, cc FROM (SELECT owner, cc, row_number() OVER (PARTITION BY owner ORDER BY cc, id) - 1 AS r, count(*) OVER (PARTITION BY owner) AS n FROM modules) t WHERE r = CAST(floor(n / 2) AS BIGINT)"
S["o01_top_blocks"] = "SELECT id, cc, nesting, lines FROM modules ORDER BY cc DESC, nesting DESC, lines DESC, id LIMIT 10"
S["o02_top_files"] = "SELECT owner, round(avg(cc), 4) AS avg_cc, max(cc) AS max_cc FROM modules GROUP BY owner ORDER BY avg_cc DESC, max_cc DESC, owner LIMIT 10"
S["r11_thresholds"] = "SELECT id, CASE WHEN cc > 20 THEN 'critical' WHEN cc > 10 THEN 'high' WHEN nesting > 4 THEN 'medium' ELSE 'low' END AS severity FROM modules WHERE cc > 10 OR nesting > 4 OR ports > 50"
S["r12_module_design"] = "SELECT id, 'ports' AS rule, CASE WHEN ports > 80 THEN 'high' ELSE 'medium' END AS severity FROM modules WHERE ports > 30 UNION ALL SELECT id, 'lines', CASE WHEN lines > 800 THEN 'high' ELSE 'medium' END FROM modules WHERE lines > 300 UNION ALL SELECT id, 'latch', 'high' FROM modules WHERE has_latch"
