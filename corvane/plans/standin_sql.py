"""DuckDB SQL for the stand-in workspace: what its files hold, from the ids alone."""

from __future__ import annotations

D = """d AS (SELECT DISTINCT doc_id AS i FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT i, i % 11 AS v, (i // 11) % 2 = 0 AS fixed, (i % 11 < 6 AND (i // 11) % 2 = 0) OR i % 3 = 0 AS destroys,
  'app/c' || i || '.component.ts' AS c, 'app/services/s' || i || '.service.ts' AS s, 'app/l' || i || '.ts' AS l, 'app/u' || i || '.ts' AS u, 'app/r' || i || '.routes.ts' AS r,
  CAST(13 + (i % 4 = 0)::INT + (i % 6 = 0)::INT + (i % 2 = 0)::INT + CASE i % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 + i % 250 ELSE 0 END + (i % 7 = 0)::INT + i % 6 + i % 260 AS BIGINT) AS c_lines,
  CAST(4 + (i % 2 = 0)::INT + (i % 3 = 0)::INT + (i % 5 = 0)::INT + (i % 4 = 0)::INT + (i % 7 = 0)::INT + i % 210 AS BIGINT) AS s_lines,
  CAST(i % 12 + (i % 4 = 1)::INT AS BIGINT) AS params FROM d)"""
NODES = D + ", nodes AS (SELECT c AS f FROM x UNION ALL SELECT s FROM x UNION ALL SELECT l FROM x UNION ALL SELECT u FROM x UNION ALL SELECT r FROM x WHERE i % 10 = 0)"
EDGES = NODES + """, edges AS (
 SELECT c AS src, 'app/services/s' || (i // 2) || '.service.ts' AS dst FROM x WHERE i // 2 IN (SELECT i FROM d)
 UNION SELECT c, 'app/c' || (i + 1) || '.component.ts' FROM x WHERE i % 6 = 0 AND i + 1 IN (SELECT i FROM d)
 UNION SELECT s, 'app/c' || (2 * i) || '.component.ts' FROM x WHERE i % 5 = 0 AND 2 * i IN (SELECT i FROM d)
 UNION SELECT l, u FROM x WHERE i % 9 = 0)"""
CYCLES = "RECURSIVE " + EDGES + """, reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON r.b = e.src),
comp AS (SELECT p.a AS node, min(p.b) AS scc FROM reach p JOIN reach q ON q.a = p.b AND q.b = p.a GROUP BY p.a),
cyc AS (SELECT scc, count(*) AS node_count, array_to_string(list_sort(list(node)), ',') AS nodes FROM comp GROUP BY scc)"""
FANS = EDGES + """, fans AS (SELECT f AS node, coalesce(n, 0) AS fan_in, coalesce(m, 0) AS fan_out FROM nodes
 LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) ON dst = f LEFT JOIN (SELECT src, count(*) AS m FROM edges GROUP BY src) ON src = f)"""
METHODS = D + """, methods AS (
 SELECT c AS file_path, 'C' || i AS class_name, 'load' AS name, 'public' AS visibility, 0::BIGINT AS branch_count, 0::BIGINT AS parameter_count, 1::BIGINT AS line_count FROM x
 UNION ALL SELECT c, 'C' || i, 'm', 'private', i % 6, 1, 2 + i % 6 FROM x
 UNION ALL SELECT l, 'L' || i, 'ngOnDestroy', 'public', 0, 0, 3 FROM x WHERE destroys
 UNION ALL SELECT u, 'U' || i, 'sum', 'public', 0, 3, 16 FROM x)"""
COMPLEXITY = D + """, complexity AS (
 SELECT c AS file_path, c_lines AS line_count, 1::BIGINT AS class_count, 2::BIGINT AS method_count, params AS ctor_param_max, i % 6 AS branch_count FROM x
 UNION ALL SELECT s, s_lines, 1, 0, 0, 0 FROM x UNION ALL SELECT l, 6 + (i % 9 = 0)::INT + 3 * destroys::INT, 1, destroys::INT, 0, 0 FROM x
 UNION ALL SELECT u, 18, 1, 1, 0, 0 FROM x UNION ALL SELECT r, 4 + i % 280, 0, 0, 0, 0 FROM x WHERE i % 10 = 0)"""
SIGNALS = D + """, signals AS (SELECT c AS file_path, 'http' AS signal FROM x UNION ALL SELECT s, 'routing' FROM x WHERE i % 2 = 0 UNION ALL SELECT s, 'http' FROM x WHERE i % 3 = 0
 UNION ALL SELECT s, 'state' FROM x WHERE i % 4 = 0 UNION ALL SELECT s, 'storage' FROM x WHERE i % 7 = 0 UNION ALL SELECT l, 'state' FROM x WHERE v = 7)"""
BLOCKS = D + """, b AS (SELECT 'exact' AS kind, i % 7 AS g, u AS file_path, i FROM x UNION ALL SELECT 'normalized', 0, u, i FROM x),
groups AS (SELECT kind, g, count(*) AS occurrences, min(file_path) AS first_file, 16::BIGINT AS line_count FROM b GROUP BY kind, g HAVING count(*) > 1),
members AS (SELECT b.* FROM b SEMI JOIN groups USING (kind, g))"""
SCORES = "complexity AS (" + COMPLEXITY.split("complexity AS (", 1)[1] + """, dups AS (SELECT file_path, count(*) AS n FROM members GROUP BY file_path),
points AS (SELECT file_path, CAST(least(20, line_count // 50) + least(20, method_count // 5) + least(20, branch_count // 5) + least(10, ctor_param_max // 4) AS BIGINT) AS complexity,
  CAST(least(30, 5 * coalesce(n, 0)) AS BIGINT) AS duplication, CAST(CASE WHEN file_path IN (SELECT c FROM x WHERE i % 3 = 2 UNION ALL SELECT s FROM x WHERE i % 4 = 3) THEN 10 ELSE 0 END AS BIGINT) AS spec_points,
  CAST(least(10, fan_in // 5) AS BIGINT) AS import_fan_in, CAST(least(10, fan_out // 10) AS BIGINT) AS import_fan_out FROM complexity JOIN fans ON node = file_path LEFT JOIN dups USING (file_path)),
scores AS (SELECT *, complexity + duplication + spec_points + import_fan_in + import_fan_out AS score FROM points)"""
HOT = FANS + ", " + BLOCKS.removeprefix(D + ", ") + ", " + SCORES
LIFE = D + """, life AS (SELECT i, v, destroys, l AS file_path, CASE v WHEN 0 THEN 'lifecycle-broken-destroy-subject' WHEN 1 THEN 'lifecycle-subscription-field-not-unsubscribed' WHEN 2 THEN 'lifecycle-subscription-field-not-unsubscribed'
  WHEN 3 THEN 'lifecycle-addEventListener-no-remove' WHEN 4 THEN 'lifecycle-setInterval-no-clearInterval' WHEN 5 THEN 'lifecycle-requestAnimationFrame-no-cancelAnimationFrame' WHEN 6 THEN 'lifecycle-toSignal-manualCleanup'
  WHEN 7 THEN 'lifecycle-effect-missing-onCleanup' WHEN 8 THEN 'lifecycle-fromEvent-subscribe-no-cleanup' ELSE 'lifecycle-unmanaged-subscribe' END AS code,
  CASE WHEN v = 6 THEN 'info' ELSE 'warning' END AS severity, CASE WHEN v IN (0, 1, 8) THEN 'high' ELSE 'medium' END AS confidence FROM x WHERE NOT fixed)"""
RULES = LIFE + ", signals AS (" + SIGNALS.split("signals AS (", 1)[1] + """, n_signals AS (SELECT file_path, count(*) AS n FROM signals GROUP BY file_path),
found AS (
 SELECT 'warning' AS severity, 'components' AS category, 'high' AS confidence, 'component-large-ts' AS code, c AS file_path, c_lines AS measure FROM x WHERE c_lines > 200
 UNION ALL SELECT 'warning', 'components', 'high', 'component-large-template', 'app/c' || i || '.html', i % 230 + 1 FROM x WHERE i % 3 = 0 AND i % 230 + 1 > 200 AND i % 10 <> 5
 UNION ALL SELECT 'warning', 'components', 'high', 'component-large-template', c, i % 250 + 1 FROM x WHERE i % 3 = 1 AND i % 250 + 1 > 200
 UNION ALL SELECT 'info', 'components', 'medium', 'component-inline-template', c, i % 250 + 1 FROM x WHERE i % 3 = 1
 UNION ALL SELECT 'error', 'components', 'medium', 'component-inline-styles', c, NULL FROM x WHERE i % 7 = 0
 UNION ALL SELECT 'warning', 'components', 'high', 'component-missing-spec', c, NULL FROM x WHERE i % 3 = 2
 UNION ALL SELECT 'warning', 'components', 'high', 'component-http-calls', c, NULL FROM x WHERE i % 8 = 1
 UNION ALL SELECT 'warning', 'components', 'high', 'component-many-injections', c, params FROM x WHERE params > 8
 UNION ALL SELECT 'info', 'components', 'high', 'component-standalone-duplicate-imports', c, NULL FROM x WHERE i % 10 = 0
 UNION ALL SELECT 'warning', 'services', 'high', 'service-large-ts', s, s_lines FROM x WHERE s_lines > 200
 UNION ALL SELECT 'warning', 'services', 'high', 'service-missing-spec', s, NULL FROM x WHERE i % 4 = 3
 UNION ALL SELECT 'warning', 'services', 'medium', 'service-mixed-responsibility', s, s_lines FROM x JOIN n_signals ON file_path = s WHERE s_lines >= 120 AND n >= 3
 UNION ALL SELECT 'warning', 'routes', 'high', 'routes-large-config', r, 4 + i % 280 FROM x WHERE i % 10 = 0 AND 4 + i % 280 > 250
 UNION ALL SELECT severity, 'lifecycle', confidence, code, file_path, NULL FROM life)"""
OPEN = {name: f"WITH {sql}" for name, sql in dict(d=D, nodes=NODES, edges=EDGES, cycles=CYCLES, fans=FANS, methods=METHODS, complexity=COMPLEXITY, signals=SIGNALS, blocks=BLOCKS, hot=HOT, life=LIFE, rules=RULES).items()}
_FILE_COUNTS = """, counts AS (SELECT f AS file_path, (f NOT LIKE '%.routes.ts')::BIGINT AS classes, (SELECT count(*) FROM methods m WHERE m.file_path = f) AS methods FROM nodes)"""

SQL = {
    "ts_analyzable": OPEN["nodes"] + " SELECT f AS file_path FROM nodes UNION ALL SELECT 'lib/o' || i || '.ts' FROM d WHERE i % 50 = 0",
    "ts_projects": OPEN["nodes"] + " SELECT 'shop' AS project, 'app' AS source_root, f AS file_path FROM nodes UNION ALL SELECT 'api', 'app/services', s FROM x",
    "ts_imports": OPEN["d"] + """ SELECT c AS file_path, unnest(['@angular/core', '@angular/common/http', './services/s' || (i // 2) || '.service.js']) AS spec FROM x
 UNION ALL SELECT c, './c' || (i + 1) || '.component.ts' FROM x WHERE i % 6 = 0 UNION ALL SELECT s, '@angular/core' FROM x UNION ALL SELECT s, '@angular/router' FROM x WHERE i % 2 = 0
 UNION ALL SELECT s, '@angular/common/http' FROM x WHERE i % 3 = 0 UNION ALL SELECT s, '../c' || (2 * i) || '.component.js' FROM x WHERE i % 5 = 0 UNION ALL SELECT l, './u' || i FROM x WHERE i % 9 = 0""",
    "ts_edges": OPEN["edges"] + " SELECT src, dst FROM edges",
    "ts_fans": OPEN["fans"] + " SELECT node, fan_in, fan_out FROM fans",
    "ts_artifacts": OPEN["d"] + " SELECT 'shop' AS project, 'component' AS artifact, c AS file_path FROM x UNION ALL SELECT unnest(['shop', 'api']), 'injectable', s FROM x",
    "ts_routes": OPEN["d"] + " SELECT 'shop' AS project, r AS file_path, unnest(list_concat(['', 'deep', 'd' || i], list_transform(range(i % 280), lambda k: 'a' || k))) AS path FROM x WHERE i % 10 = 0",
    "ts_route_objects": OPEN["d"] + " SELECT r AS file_path, 2 + i % 280 AS n FROM x WHERE i % 10 = 0",
    "ts_complexity": OPEN["complexity"] + " SELECT * FROM complexity",
    "ts_signals": OPEN["signals"] + " SELECT * FROM signals",
    "ts_classes": OPEN["d"] + """ SELECT 'class:' || f || '#' || name || '@' || start_line AS id, name, f AS file_path, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line FROM (
 SELECT c AS f, 'C' || i AS name, 4 + (i % 4 = 0)::INT + (i % 6 = 0)::INT AS start_line, c_lines - i % 260 AS end_line FROM x
 UNION ALL SELECT s, 'S' || i, 2 + (i % 2 = 0)::INT + (i % 3 = 0)::INT + (i % 5 = 0)::INT, s_lines - i % 210 FROM x
 UNION ALL SELECT l, 'L' || i, 1 + (i % 9 = 0)::INT, 6 + (i % 9 = 0)::INT + 3 * destroys::INT FROM x UNION ALL SELECT u, 'U' || i, 1, 18 FROM x)""",
    "ts_methods": OPEN["methods"] + " SELECT * FROM methods",
    "ts_file_symbols": OPEN["nodes"] + " SELECT f AS file_path, 1::BIGINT AS classes FROM nodes WHERE f NOT LIKE '%.routes.ts'",
    "ts_references": OPEN["d"] + " SELECT c AS file_path, 'C' || i || '.m' AS method, CASE WHEN i % 8 = 1 THEN 'load() { this.http.get(''/x''); this.m(1); }' ELSE 'load() { return this.m(2); }' END AS snippet FROM x",
    "ts_blocks": OPEN["blocks"] + " SELECT kind, file_path, 16::BIGINT AS line_count, 'U' || i || '.sum' AS method FROM members",
    "ts_block_groups": OPEN["blocks"] + " SELECT kind, occurrences, first_file, line_count FROM groups",
    "ts_component_facts": OPEN["d"] + """ SELECT c AS file_path, 1::BIGINT AS gates, params, CASE WHEN i % 3 = 0 THEN './c' || i || '.html' END AS template_url, CASE WHEN i % 3 = 1 THEN 1 + i % 250 ELSE -1 END AS template_lines,
 (i % 7 = 0)::BIGINT AS styles, CASE WHEN i % 10 = 0 THEN 'A' END AS repeated, CASE WHEN i % 8 = 1 THEN 'get' END AS requests FROM x""",
    "ts_subscriptions": OPEN["d"] + """ SELECT l AS file_path, CASE v WHEN 8 THEN 'fromEvent' WHEN 9 THEN 'interval' WHEN 10 THEN 'longLived' ELSE 'other' END AS root, CASE WHEN v = 0 OR v >= 8 AND fixed THEN 1 ELSE 0 END::BIGINT AS ends,
 CASE v WHEN 1 THEN 'sub' END AS field, CASE v WHEN 2 THEN 'all' END AS collection FROM x WHERE v IN (0, 1, 2, 8, 9, 10)""",
    "ts_cleanups": OPEN["d"] + """ SELECT l AS file_path, unnest(CASE v WHEN 0 THEN ['take_until', 'destroy_next'] WHEN 1 THEN ['unsubscribe'] WHEN 2 THEN ['composite', 'composite_used', 'unsubscribe'] WHEN 3 THEN ['unlisten'] WHEN 4 THEN ['clearInterval'] ELSE ['cancelAnimationFrame'] END) AS kind,
 CASE v WHEN 0 THEN 'destroy$' WHEN 1 THEN 'sub' WHEN 2 THEN 'all' WHEN 3 THEN 'window::resize::this.onResize' WHEN 4 THEN 'timer' ELSE 'frame' END AS key FROM x WHERE v < 6 AND fixed
 UNION ALL SELECT l, 'take_until', 'destroy$' FROM x WHERE v = 0 AND NOT fixed UNION ALL SELECT l, unnest(['composite', 'composite_used']), 'all' FROM x WHERE v = 2 AND NOT fixed
 UNION ALL SELECT l, 'on_destroy', NULL FROM x WHERE destroys""",
    "ts_resources": OPEN["d"] + """ SELECT l AS file_path, CASE v WHEN 3 THEN 'listener' WHEN 4 THEN 'setInterval' WHEN 5 THEN 'requestAnimationFrame' WHEN 6 THEN 'to_signal' ELSE 'effect' END AS kind,
 CASE v WHEN 3 THEN 'window::resize::this.onResize' WHEN 4 THEN 'timer' WHEN 5 THEN 'frame' WHEN 7 THEN 'setInterval' END AS key, CASE WHEN v = 3 THEN 0 WHEN v = 7 THEN fixed::INT ELSE -1 END::BIGINT AS n FROM x WHERE v IN (3, 4, 5, 7) OR v = 6 AND NOT fixed""",
    "ts_summary": OPEN["d"] + " SELECT 3::BIGINT AS projects, count(*) AS components, 2 * count(*) AS services, CAST(coalesce(sum(CASE WHEN i % 10 = 0 THEN 3 + i % 280 END), 0) AS BIGINT) AS routes FROM x",
    "ts_symbol_tree": OPEN["d"] + " SELECT 'C' || i AS name, 'C' || i || '.load,C' || i || '.m' AS methods FROM x UNION ALL SELECT 'S' || i, '' FROM x UNION ALL SELECT 'L' || i, CASE WHEN destroys THEN 'L' || i || '.ngOnDestroy' ELSE '' END FROM x UNION ALL SELECT 'U' || i, 'U' || i || '.sum' FROM x",
    "ts_file_details": OPEN["hot"] + ", methods AS (" + METHODS.split("methods AS (", 1)[1] + """ SELECT file_path, 1::BIGINT AS classes, (SELECT count(*) FROM methods m WHERE m.file_path = s.file_path) AS methods, starts_with(file_path, 'app/c')::BIGINT AS references, coalesce(n, 0) AS groups, score
 FROM scores s LEFT JOIN dups USING (file_path) WHERE file_path NOT LIKE '%.routes.ts'""",
    "ts_method_details": OPEN["blocks"] + ", methods AS (" + METHODS.split("methods AS (", 1)[1] + " SELECT file_path, class_name, name, (name = 'm')::BIGINT AS references, (SELECT count(*) FROM members b WHERE b.file_path = methods.file_path AND name = 'sum') AS groups FROM methods",
    "ts_folders": OPEN["nodes"] + ", methods AS (" + METHODS.split("methods AS (", 1)[1] + _FILE_COUNTS + """, up AS (SELECT unnest(CASE WHEN starts_with(file_path, 'app/services/') THEN ['', 'app', 'app/services'] ELSE ['', 'app'] END) AS folder, * FROM counts)
 SELECT folder, CASE folder WHEN '' THEN 0 WHEN 'app' THEN 1 ELSE 2 END::BIGINT AS depth, CASE folder WHEN 'app' THEN '' WHEN 'app/services' THEN 'app' END AS parent, count(*) AS files, CAST(sum(classes) AS BIGINT) AS classes, CAST(sum(methods) AS BIGINT) AS methods, CASE folder WHEN 'app/services' THEN 0 ELSE 1 END::BIGINT AS folders FROM up GROUP BY folder""",
    "ts_hotspots": OPEN["hot"] + " SELECT file_path, complexity, duplication, spec_points, import_fan_in, import_fan_out, score FROM scores",
    "ts_hotspot_view": OPEN["hot"] + " SELECT row_number() OVER (ORDER BY score DESC, file_path) AS rank, file_path, score FROM scores WHERE contains(file_path, 'services/') AND score >= 1",
    "ts_lifecycle_matrix": OPEN["life"] + """ SELECT file_path, code, CASE WHEN destroys THEN 'yes' ELSE 'no' END AS on_destroy, CASE WHEN v >= 8 THEN 'no' ELSE 'unknown' END AS take_until_destroyed,
 CASE WHEN v = 0 THEN 'yes' WHEN v >= 8 THEN 'no' ELSE 'unknown' END AS take_until, CASE WHEN v IN (1, 2) OR v >= 8 THEN 'no' ELSE 'unknown' END AS unsubscribe, 'no' AS cleanup FROM life""",
    "ts_lifecycle_view": OPEN["life"] + " SELECT row_number() OVER (ORDER BY code, file_path) AS rank, code, file_path FROM life WHERE severity = 'warning' AND contains(file_path, 'app/l1')",
    "ts_symbol_order": OPEN["methods"] + " SELECT row_number() OVER (ORDER BY file_path, class_name, name) AS rank, file_path, name FROM methods WHERE file_path LIKE 'app/c%' OR file_path LIKE 'app/u%'",
    "ts_reference_order": OPEN["d"] + " SELECT row_number() OVER (ORDER BY c) AS rank, c AS file_path, 'C' || i || '.m' AS method FROM x",
    "ts_lifecycle_search": OPEN["rules"] + " SELECT code, file_path FROM found WHERE category = 'lifecycle' AND code = 'lifecycle-setInterval-no-clearInterval'",
    "ts_finding_order": OPEN["rules"] + " SELECT row_number() OVER (ORDER BY file_path || chr(10) || code) AS rank, file_path, code FROM found WHERE category = 'components'",
    "ts_occurrence_order": OPEN["blocks"] + " SELECT row_number() OVER (ORDER BY file_path) AS rank, file_path, 2::BIGINT AS start_line FROM members WHERE kind = 'normalized'",
    "ts_occurrence_total": OPEN["blocks"] + " SELECT count(*) AS groups, CAST(coalesce(sum(occurrences), 0) AS BIGINT) AS occurrences FROM groups",
    "ts_files_in_cycles": OPEN["cycles"] + " SELECT count(*) AS files FROM comp",
    "ts_cycles": OPEN["cycles"] + " SELECT scc, node_count, nodes FROM cyc",
    "rule_import_cycle": OPEN["cycles"] + " SELECT 'warning' AS severity, 'architecture' AS category, 'high' AS confidence, 'import-cycle' AS code, scc AS file_path, node_count AS measure FROM cyc",
}


def rule(code: str) -> str:
    return OPEN["rules"] + f" SELECT severity, category, confidence, code, file_path, CAST(measure AS BIGINT) AS measure FROM found WHERE code = '{code}'"
