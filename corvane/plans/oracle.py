"""DuckDB SQL for the registered report queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from corvane.plans import standin, standin_sql, standin_typed

F = """files AS (SELECT doc_id, source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS file_path, text, n_chars,
  CAST(len(string_split_regex(text, '\\r?\\n')) AS BIGINT) AS line_count FROM documents)"""
FIND = F + """, find AS (
 SELECT 'warning' AS severity, 'components' AS category, 'high' AS confidence, 'component-large-ts' AS code, 'line_count is ' || line_count || ' (limit 8)' AS message, file_path, line_count AS measure FROM files WHERE line_count > 8
 UNION ALL SELECT 'info', 'services', 'high', 'service-large-ts', 'n_chars is ' || n_chars || ' (limit 8000)', file_path, n_chars FROM files WHERE n_chars > 8000
 UNION ALL SELECT 'warning', 'components', 'high', 'component-missing-spec', 'no labels', file_path, NULL FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
 UNION ALL SELECT 'error', 'lifecycle', 'medium', 'lifecycle-unmanaged-subscribe', 'mail address', file_path, NULL FROM files WHERE contains(text, '@'))"""
RULED = FIND + """, ruled AS (SELECT * REPLACE (CASE code WHEN 'service-large-ts' THEN 'error' ELSE severity END AS severity) FROM find WHERE code <> 'component-missing-spec')"""
BLOCKS = F + """, blocks AS (
 SELECT 'exact' AS kind, md5(text) AS hash, file_path, line_count, n_chars AS token_count FROM files
 UNION ALL SELECT 'normalized', md5(trim(regexp_replace(regexp_replace(text, '[0-9]+(\\.[0-9]+)?', '<num>', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))), file_path, line_count, n_chars FROM files),
groups AS (SELECT kind, hash, count(*) AS occurrences, arg_min(line_count, file_path) AS line_count, arg_min(token_count, file_path) AS token_count, min(file_path) AS first_file
  FROM blocks GROUP BY kind, hash HAVING count(*) >= 2 AND count(DISTINCT file_path) >= 2),
members AS (SELECT b.* FROM blocks b SEMI JOIN groups g ON b.kind = g.kind AND b.hash = g.hash),
stats AS (SELECT file_path, count(DISTINCT kind || hash) AS dup_groups, count(*) AS dup_occurrences, CAST(sum(line_count) AS BIGINT) AS dup_lines FROM members GROUP BY file_path)"""
EDGES = """strong AS (SELECT l_orderkey AS o, l_linenumber AS l, min(l_partkey) AS p FROM lineitem WHERE l_quantity >= 40 GROUP BY ALL),
edges AS (SELECT DISTINCT a.p AS src, b.p AS dst FROM strong a JOIN strong b ON a.o = b.o AND b.l = a.l + 1),
reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON r.b = e.src),
comp AS (SELECT x.a AS node, min(x.b) AS scc FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a),
cyc AS (SELECT scc, count(*) AS node_count, list_sort(list(node)) AS nodes FROM comp GROUP BY scc),
fans AS (SELECT p_partkey AS node, (SELECT count(*) FROM edges WHERE dst = p_partkey) AS fan_in, (SELECT count(*) FROM edges WHERE src = p_partkey) AS fan_out FROM part)"""
SCORES = """measures AS (
 SELECT file_path, line_count, length(text) - length(replace(text, '.', '')) AS method_count, n_chars % 97 AS ctor_param_max, length(text) - length(replace(text, ',', '')) AS branch_count FROM files),
keys AS (SELECT file_path FROM files UNION SELECT 'part/' || p_partkey FROM part),
joined AS (SELECT k.file_path, coalesce(line_count, 0) AS line_count, coalesce(method_count, 0) AS method_count, coalesce(ctor_param_max, 0) AS ctor_param_max, coalesce(branch_count, 0) AS branch_count,
  coalesce(dup_groups, 0) AS dup_groups, coalesce(dup_occurrences, 0) AS dup_occurrences, coalesce(dup_lines, 0) AS dup_lines,
  CAST(coalesce(k.file_path IN (SELECT file_path FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels)), false) AS BIGINT) AS missing_spec, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out
  FROM keys k LEFT JOIN measures m USING (file_path) LEFT JOIN stats s USING (file_path) LEFT JOIN (SELECT 'part/' || node AS file_path, fan_in, fan_out FROM fans) f USING (file_path)),
points AS (SELECT *, least(20, line_count // 50) + least(20, method_count // 5) + least(20, branch_count // 5) + least(10, ctor_param_max // 4) AS complexity,
  least(30, dup_occurrences * 5) AS duplication, missing_spec * 10 AS spec_points, least(10, fan_in // 5) AS import_fan_in, least(10, fan_out // 10) AS import_fan_out FROM joined),
scores AS (SELECT * REPLACE (CAST(complexity AS BIGINT) AS complexity, CAST(duplication AS BIGINT) AS duplication, CAST(spec_points AS BIGINT) AS spec_points, CAST(import_fan_in AS BIGINT) AS import_fan_in, CAST(import_fan_out AS BIGINT) AS import_fan_out),
  CAST(complexity + duplication + spec_points + import_fan_in + import_fan_out AS BIGINT) AS score FROM points)"""
FNV = "printf('%08x', CAST(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295::UBIGINT) AS BIGINT))"
ident = lambda prefix, parts: f"'{prefix}-' || " + FNV.format(parts)
TASKS = FIND + ", " + BLOCKS.removeprefix(F + ", ") + ", " + EDGES + ", " + SCORES + f""",
paths AS (SELECT node_count, list_transform(nodes, lambda n: 'part/' || n) AS files FROM (SELECT node_count, list_sort(list_transform(nodes, lambda n: CAST(n AS VARCHAR))) AS texts, nodes FROM cyc)),
hot AS (SELECT * FROM scores WHERE score >= 30 ORDER BY score DESC, file_path LIMIT 25),
raw AS (
 SELECT {ident("task-cycle", "array_to_string(files, '|')")} AS id, 'importCycles' AS area, 'Break import cycle of ' || node_count || ' files' AS title, files, 'high' AS impact, CASE WHEN node_count <= 3 THEN 'medium' ELSE 'large' END AS effort, files[1] || '::import-cycle' AS refs FROM paths
 UNION ALL SELECT {ident("task-lifecycle", "file_path || '::' || code")}, 'lifecycle', 'Add cleanup for long-lived subscription (' || file_path || ')', [file_path], CASE WHEN severity IN ('error', 'warning') THEN 'high' ELSE 'medium' END, 'medium', file_path || '::' || code FROM find WHERE category = 'lifecycle'
 UNION ALL SELECT {ident("task-oversize", "'component|' || file_path")}, 'oversized', 'Split large component: ' || file_path, [file_path], 'medium', CASE WHEN measure >= 16 THEN 'large' ELSE 'medium' END, file_path || '::' || code FROM find WHERE code = 'component-large-ts'
 UNION ALL SELECT {ident("task-oversize", "'service|' || file_path")}, 'oversized', 'Split large service: ' || file_path, [file_path], 'medium', CASE WHEN measure >= 16000 THEN 'large' ELSE 'medium' END, file_path || '::' || code FROM find WHERE code = 'service-large-ts'
 UNION ALL SELECT {ident("task-dup", "'dup:' || kind || ':' || hash || '|' || kind || '|' || hash")}, 'duplicates', 'Merge ' || kind || ' block of ' || line_count || ' lines in ' || occurrences || ' places', fs,
   CASE WHEN line_count >= 25 OR occurrences >= 4 THEN 'high' ELSE 'medium' END, CASE WHEN line_count >= 25 OR len(fs) >= 4 THEN 'large' ELSE 'medium' END, 'dup:' || kind || ':' || hash
   FROM groups JOIN (SELECT kind, hash, list_sort(list(DISTINCT file_path)) AS fs FROM members GROUP BY ALL) USING (kind, hash)
 UNION ALL SELECT {ident("task-spec", "file_path || '.spec'")}, 'testGaps', 'Add spec ' || file_path || '.spec', [file_path, file_path || '.spec'], 'medium', 'small', file_path || '::' || code FROM find WHERE code = 'component-missing-spec'
 UNION ALL SELECT {ident("task-hot", "file_path")}, 'hotspots', 'Reduce hotspot ' || file_path, [file_path], CASE WHEN score >= 60 THEN 'high' ELSE 'medium' END, CASE WHEN score >= 60 THEN 'large' ELSE 'medium' END, file_path FROM hot),
deps AS (SELECT r.id, string_agg(DISTINCT c.id, ',' ORDER BY c.id) AS d FROM (SELECT id, unnest(files) AS f FROM raw WHERE area <> 'importCycles') r JOIN (SELECT id, unnest(files) AS f FROM raw WHERE area = 'importCycles') c ON r.f = c.f GROUP BY r.id)"""
DAYS = """scans AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS code, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('purchase', 'signup') THEN 'warning' ELSE 'info' END AS severity FROM events),
days AS (SELECT day, count(*) AS total, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(DISTINCT code) AS codes FROM scans GROUP BY day)"""
SEV = "count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info"

SQL = {
    "line_counts": f"WITH {F} SELECT doc_id, file_path, line_count FROM files",
    "size_findings": f"WITH {RULED} SELECT severity, category, confidence, code, message, file_path FROM ruled",
    "severity_counts": f"WITH {RULED} SELECT count(*) AS total, {SEV} FROM ruled",
    "category_pivot": f"WITH {FIND} SELECT category, {SEV}, count(*) AS total FROM find GROUP BY category",
    "code_counts": f"WITH {FIND} SELECT code, count(*) AS n FROM find GROUP BY code",
    "grouped_findings": f"WITH {FIND} SELECT severity, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS severity_rank, code, count(*) AS n, min(file_path) AS first_file, max(file_path) AS last_file FROM find GROUP BY severity, code",
    "filtered_findings": f"WITH {FIND} SELECT code, message, file_path FROM find WHERE severity = 'warning' AND contains(code, 'large') AND contains(lower(message || chr(10) || file_path), 'src1')",
    "sorted_findings": f"WITH {FIND} SELECT row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, file_path, message) AS rank, severity, code, file_path FROM find WHERE category <> 'components'",
    "missing_specs": f"WITH {F} SELECT file_path, file_path || '.spec' AS expected FROM files ANTI JOIN labels USING (doc_id)",
    "concern_signals": f"WITH {F} SELECT file_path, array_to_string(s, ',') AS signals, len(s) AS n_signals FROM (SELECT file_path, list_filter([CASE WHEN regexp_matches(text, 'https?://') THEN 'http' END, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN contains(text, '|') THEN 'pipe' END, CASE WHEN contains(text, '$') OR contains(text, '€') THEN 'money' END, CASE WHEN contains(text, '#') THEN 'hash' END], lambda v: v IS NOT NULL) AS s FROM files) WHERE len(s) >= 2",
    "duplicate_groups": f"WITH {BLOCKS} SELECT 'dup:' || kind || ':' || hash AS id, kind, hash, occurrences, line_count, token_count, first_file, kind || chr(10) || lpad(CAST(occurrences AS VARCHAR), 6, '0') || chr(10) || hash AS sort_key FROM groups",
    "duplicate_occurrences": f"WITH {BLOCKS} SELECT kind, hash, file_path, line_count FROM members",
    "duplicate_file_stats": f"WITH {BLOCKS} SELECT * FROM stats",
    "duplicate_view": f"WITH {BLOCKS} SELECT row_number() OVER (ORDER BY line_count DESC, occurrences DESC, hash) AS rank, hash, line_count, occurrences FROM groups WHERE kind = 'exact' AND line_count >= 5",
    "import_edges": f"WITH RECURSIVE {EDGES} SELECT src, dst FROM edges",
    "import_fans": f"WITH RECURSIVE {EDGES} SELECT * FROM fans",
    "import_components": f"WITH RECURSIVE {EDGES} SELECT node, scc FROM comp",
    "import_cycles": f"WITH RECURSIVE {EDGES} SELECT scc, node_count, array_to_string(nodes, ',') AS nodes FROM cyc",
    "graph_summary": f"WITH RECURSIVE {EDGES} SELECT (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM cyc) AS cycles",
    "hotspot_scores": f"WITH RECURSIVE {BLOCKS}, {EDGES}, {SCORES} SELECT * FROM scores",
    "hotspot_top": f"WITH RECURSIVE {BLOCKS}, {EDGES}, {SCORES} SELECT row_number() OVER (ORDER BY score DESC, file_path) AS rank, file_path, score FROM scores QUALIFY rank <= 50",
    "health": "WITH RECURSIVE " + FIND + ", " + BLOCKS.removeprefix(F + ", ") + f", {EDGES}, {SCORES}," + """
 c AS (SELECT (SELECT count(*) FROM find WHERE severity = 'error') AS n_error, (SELECT count(*) FROM find WHERE severity = 'warning') AS n_warning, (SELECT count(*) FROM find WHERE severity = 'info') AS n_info,
  (SELECT count(*) FROM cyc) AS n_cycles, (SELECT count(*) FROM groups) AS n_groups, (SELECT count(*) FROM scores WHERE score >= 40) AS n_hot),
 h AS (SELECT *, CAST(greatest(0, least(100, 100 - 12 * n_error - 4 * n_warning - n_info - least(20, 5 * n_cycles) - least(20, n_groups // 3) - least(15, 2 * n_hot))) AS BIGINT) AS score FROM c)
 SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM h""",
    "brief_tasks": f"WITH RECURSIVE {TASKS} SELECT raw.id, area, title, array_to_string(files, ',') AS files, impact, effort, refs, coalesce(d, '') AS dependencies FROM raw LEFT JOIN deps USING (id)",
    "brief_areas": f"WITH RECURSIVE {TASKS}" + """, n AS (
 SELECT 'lifecycle' AS area, (SELECT count(*) FROM find WHERE category = 'lifecycle') AS n UNION ALL SELECT 'importCycles', (SELECT count(*) FROM cyc) UNION ALL SELECT 'oversized', (SELECT count(*) FROM raw WHERE area = 'oversized')
 UNION ALL SELECT 'duplicates', (SELECT count(*) FROM groups) UNION ALL SELECT 'testGaps', (SELECT count(*) FROM find WHERE code = 'component-missing-spec') UNION ALL SELECT 'hotspots', (SELECT coalesce(max(score), 0) FROM scores))
 SELECT area, CASE WHEN area IN ('lifecycle', 'importCycles') THEN CASE WHEN n > 0 THEN 'P0' ELSE 'P2' END
  WHEN area = 'oversized' THEN CASE WHEN n >= 10 THEN 'P0' WHEN n >= 1 THEN 'P1' ELSE 'P2' END WHEN area = 'duplicates' THEN CASE WHEN n >= 15 THEN 'P0' WHEN n >= 1 THEN 'P1' ELSE 'P2' END
  WHEN area = 'testGaps' THEN CASE WHEN n >= 20 THEN 'P1' ELSE 'P2' END ELSE CASE WHEN n >= 70 THEN 'P0' WHEN n >= 40 THEN 'P1' ELSE 'P2' END END AS priority, n,
  (SELECT count(*) FROM raw WHERE raw.area = n.area) AS tasks FROM n""",
    "scan_snapshots": f"WITH {DAYS} SELECT * FROM days",
    "scan_deltas": f"WITH {DAYS} SELECT day, total - lag(total) OVER w AS total_delta, error - lag(error) OVER w AS error_delta, warning - lag(warning) OVER w AS warning_delta, info - lag(info) OVER w AS info_delta, lag(day) OVER w AS base FROM days WINDOW w AS (ORDER BY day) QUALIFY base IS NOT NULL",
    "scan_code_deltas": f"WITH {DAYS}, c AS (SELECT code, count(*) FILTER (day = (SELECT min(day) FROM scans)) AS before, count(*) FILTER (day = (SELECT max(day) FROM scans)) AS after FROM scans GROUP BY code) SELECT *, after - before AS delta FROM c WHERE after <> before ORDER BY abs(delta) DESC, code LIMIT 12",
    "scan_history": f"WITH {DAYS} SELECT day, total, row_number() OVER (ORDER BY day DESC) AS recency FROM days QUALIFY recency <= 20",
    "folder_tree": """WITH p AS (SELECT string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS parts, length(html) AS chars FROM pages),
 up AS (SELECT array_to_string(parts[1:d], '/') AS folder, d, chars FROM p, LATERAL (SELECT unnest(range(0, len(parts))) AS d)),
 f AS (SELECT folder, CAST(d AS BIGINT) AS depth, count(*) AS files, CAST(sum(chars) AS BIGINT) AS chars FROM up GROUP BY folder, d),
 g AS (SELECT *, CASE WHEN depth = 0 THEN NULL ELSE array_to_string(string_split(folder, '/')[1:depth - 1], '/') END AS parent FROM f)
 SELECT folder, depth, parent, files, chars, (SELECT count(*) FROM g k WHERE k.parent = g.folder) AS folders FROM g""",
    "strict_props": "SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN json_extract_string(props, '$.k') END AS k_text FROM events",
    "stable_ids": f"WITH {F} SELECT file_path, {ident('file', 'file_path')} AS id, regexp_replace(file_path, '/[^/]*$', '') AS dir, string_split(file_path, '/')[-1] AS base FROM files",
    "excluded_files": f"WITH {F} SELECT file_path FROM files WHERE starts_with(file_path, 'src1/') OR starts_with(file_path, 'src2/') OR regexp_matches(file_path, '^src1[^/]*/de/.*$') OR regexp_matches(file_path, '^src[^/]/fr/[^/]*0$')",
    "unmatched_uses": """WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events) SELECT user_id, day, min(event_id) AS event_id, count(*) AS uses FROM e
 WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.day = e.day) GROUP BY user_id, day""",
    "capped_references": "SELECT l_partkey, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS INT) AS nth FROM lineitem QUALIFY nth <= 10",
    "page_links": """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages""",
    "repeated_links": """SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY ALL HAVING count(*) > 1""",
    "source_context": f"""WITH {F}, x AS (SELECT file_path, string_split_regex(text, '\r?\n') AS ls FROM files), y AS (SELECT *, least(3, len(ls)) AS h FROM x)
 SELECT file_path, CAST(h AS BIGINT) AS highlight, CAST(number AS BIGINT) AS number, ls[number] AS source FROM y, LATERAL (SELECT unnest(range(greatest(1, h - 1), least(len(ls), h + 1) + 1)) AS number)""",
    "previews": f"""WITH {F}, x AS (SELECT file_path, rtrim(array_to_string(string_split_regex(text, '\r?\n')[1:2], chr(10))) AS p, trim(string_split_regex(text, '\r?\n')[1]) AS s FROM files),
 y AS (SELECT file_path, CASE WHEN length(p) > 60 THEN substr(p, 1, 60) || '...' ELSE p END AS preview, CASE WHEN length(s) > 40 THEN substr(s, 1, 40) || '...' ELSE s END AS snippet FROM x)
 SELECT *, replace(replace(replace(replace(replace(snippet, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped FROM y""",
    "signal_matrix": f"WITH {FIND} SELECT file_path, 'unknown' AS on_destroy, 'no' AS take_until_destroyed, 'no' AS take_until, 'no' AS unsubscribe, 'no' AS cleanup FROM find WHERE category = 'lifecycle'",
    "labelled_duplicates": f"WITH {BLOCKS} SELECT kind, hash, m.file_path, coalesce('quality ' || quality, m.file_path) AS label FROM members m JOIN files f USING (file_path) LEFT JOIN labels l ON l.doc_id = f.doc_id",
    "page_counts": "WITH RECURSIVE " + FIND + ", " + BLOCKS.removeprefix(F + ", ") + f", {EDGES}, {SCORES}" + """ SELECT 'findings' AS page, (SELECT count(*) FROM find) AS n UNION ALL SELECT 'lifecycle', (SELECT count(*) FROM find WHERE category = 'lifecycle')
 UNION ALL SELECT 'cycles', (SELECT count(*) FROM cyc) UNION ALL SELECT 'duplicates', (SELECT count(*) FROM groups) UNION ALL SELECT 'hotspots', (SELECT count(*) FROM scores)""",
    "categories": f"WITH {FIND} SELECT category, row_number() OVER (ORDER BY category) AS rank FROM (SELECT DISTINCT category FROM find)",
}
SQL |= {
    "scan_records": f"WITH {DAYS}, s AS (SELECT *, code[1] AS category FROM scans), t AS (SELECT day, count(*) AS n FROM s GROUP BY day) SELECT day, t.n AS findingsTotal, 'category' AS part, category AS name, {SEV} FROM s JOIN t USING (day) GROUP BY day, t.n, category UNION ALL SELECT day, t.n, 'code', code, count(*), 0, 0 FROM s JOIN t USING (day) GROUP BY day, t.n, code",
    "scan_comparison": f"""WITH {DAYS}, p AS (SELECT a.day AS base, b.day AS after, b.total - a.total AS total, b.error - a.error AS error, b.warning - a.warning AS warning, b.info - a.info AS info FROM days a JOIN days b ON CAST(b.day AS DATE) = CAST(a.day AS DATE) + 1),
c AS (SELECT p.base, k.code, (SELECT count(*) FROM scans s WHERE s.day = p.base AND s.code = k.code) AS f, (SELECT count(*) FROM scans s WHERE s.day = p.after AND s.code = k.code) AS t FROM p, (SELECT DISTINCT code FROM scans) k),
r AS (SELECT base, code || ' ' || f || ' ' || t || ' ' || (t - f) AS x, row_number() OVER (PARTITION BY base ORDER BY abs(t - f) DESC, f = 0, code) AS k FROM c WHERE t <> f)
SELECT base, total, error, warning, info, coalesce((SELECT string_agg(x, ';' ORDER BY k) FROM r WHERE r.base = p.base AND k <= 12), '') AS codes FROM p""",
    "report_rows": """WITH d AS (SELECT doc_id AS i, coalesce(text, '')[1:9] AS t FROM documents WHERE doc_id IS NOT NULL)
SELECT CAST(i AS VARCHAR) AS document, 'class' AS part, 'c' || i AS id, t AS label, CAST(i AS DOUBLE) AS n FROM d WHERE i % 7 <> 0 AND i % 5 <> 0 AND t <> ''
UNION ALL SELECT CAST(i AS VARCHAR), 'group', 'dup:exact:' || CASE WHEN i % 6 = 0 THEN '' ELSE CAST(i AS VARCHAR) END, 'exact', CASE WHEN i % 3 = 0 THEN 0 ELSE 2 END FROM d WHERE i % 4 <> 0""",
}
SQL |= {standin.rule_name(c): standin_sql.rule(c) for c in standin.CODES} | standin_sql.SQL | standin_typed.SQL
