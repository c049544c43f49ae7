"""What the queries of ``code_queries`` have to give for the made project, row by row, checked against the specification.

Columns with their SQL types, then rows; texts that are long stand as their MD5.
"""

from __future__ import annotations

ROWS: dict[str, tuple[str, list[tuple]]] = {
    "q_source_tree": (
        "rel VARCHAR, language VARCHAR, lines INTEGER, file_ord INTEGER",
        [
            ('app/UPPER.PY', 'python', 3, 0),
            ('app/__init__.py', 'python', 1, 1),
            ('app/broken.py', 'python', 3, 2),
            ('app/gates.py', 'python', 30, 3),
            ('app/routes.py', 'python', 27, 4),
            ('app/store.py', 'python', 17, 5),
            ('web/Panel.jsx', 'javascript', 26, 6),
            ('web/typed.ts', 'typescript', 10, 7),
        ],
    ),
    "q_source_tree_python": (
        "rel VARCHAR, file_ord INTEGER, hash VARCHAR",
        [
            ('app/__init__.py', 0, 'd41d8cd98f00b204e9800998ecf8427e'),
            ('app/broken.py', 1, '79b9d186d4a99f273246560c00b7c778'),
            ('app/build/made.py', 2, '99aaac62caaf59aa2e82aeb7280bbc77'),
            ('app/gates.py', 3, 'f594bcc646d2fba7fdd254780b52e836'),
        ],
    ),
    "q_only_files": (
        "rel VARCHAR",
        [
            ('app/routes.py',),
            ('app/store.py',),
        ],
    ),
    "q_git_snapshot": (
        "rel VARCHAR, lines INTEGER, hash VARCHAR",
        [
            ('app/UPPER.PY', 3, '26149c8ef04aa975339a9a5898d28636'),
            ('app/__init__.py', 1, 'd41d8cd98f00b204e9800998ecf8427e'),
            ('app/broken.py', 3, '79b9d186d4a99f273246560c00b7c778'),
            ('app/gates.py', 34, 'baecd32a14c816bcca0fde2d43d4ab62'),
            ('app/routes.py', 27, '4187c5b23ec96522e7d9244eaf9a73c3'),
            ('app/store.py', 17, 'a0bd9ff4f280809c446cedb93c3c41ba'),
            ('web/Panel.jsx', 26, '18a4cbd85a82cd9bdee3d8edd0d5be8e'),
            ('web/typed.ts', 10, 'ee076f732c53312d960c1604f4a1761f'),
        ],
    ),
    "q_git_diff": (
        "file VARCHAR, raw VARCHAR, part BIGINT",
        [
            ('app/gates.py', ' ', 0),
            ('app/gates.py', ' ', 0),
            ('app/gates.py', ' ', 0),
            ('app/gates.py', ' ', 0),
            ('app/gates.py', ' class Session(Base, mixins.Timed, metaclass=Meta):', 0),
            ('app/gates.py', ' def validate_name(name):', 0),
            ('app/gates.py', '+    return tidy(name)', 0),
            ('app/gates.py', '+++ b/app/gates.py', 0),
            ('app/gates.py', '-    return text.strip()', 0),
            ('app/gates.py', '-    return verify_text(tidy(name))', 0),
            ('app/gates.py', '-', 0),
            ('app/gates.py', '-', 0),
            ('app/gates.py', '--- a/app/gates.py', 0),
            ('app/gates.py', '-def verify_text(text):', 0),
            ('app/gates.py', '@@ -10,11 +10,7 @@ def check_permission(user, action):', 0),
            ('app/gates.py', 'diff --git a/app/gates.py b/app/gates.py', 0),
            ('app/routes.py', '     def inner(column):', 1),
            ('app/routes.py', '     return store.run_query(sql, [ident])', 1),
            ('app/routes.py', '     sql = "UPDATE users SET x = ?"', 1),
            ('app/routes.py', ' ', 1),
            ('app/routes.py', ' ', 1),
            ('app/routes.py', ' ', 1),
            ('app/routes.py', '+        store.run_query("SELECT " + column)', 1),
            ('app/routes.py', '+    validate_name(data), check_permission(user, "log")', 1),
            ('app/routes.py', '+++ b/app/routes.py', 1),
            ('app/routes.py', '-        store.run_query(sql, [column])', 1),
            ('app/routes.py', '-    check_permission(user, "log")', 1),
            ('app/routes.py', '--- a/app/routes.py', 1),
            ('app/routes.py', '@@ -14,8 +14,8 @@ def update(user, ident, data):', 1),
            ('app/routes.py', 'diff --git a/app/routes.py b/app/routes.py', 1),
        ],
    ),
    "q_git_worktree": (
        "diff_id VARCHAR, file VARCHAR, added BIGINT, made BIGINT",
        [
            ('staged', 'app/store.py', 1, 0),
            ('unstaged', 'app/gates.py', 1, 0),
            ('untracked', 'app/new.py', 1, 1),
        ],
    ),
    "q_commit_scores": (
        "file VARCHAR, lines_added INTEGER, lines_removed INTEGER, confidence DOUBLE, likely_ai BOOLEAN, summary VARCHAR",
        [
            ('app/gates.py', 1, 5, 0.15, True, '15% AI-generated confidence (commit_message)'),
            ('app/routes.py', 2, 2, 0.15, True, '15% AI-generated confidence (commit_message)'),
        ],
    ),
    "q_truth": (
        "ord INTEGER, id VARCHAR, file VARCHAR, category VARCHAR, line_start INTEGER, line_end INTEGER, accepted VARCHAR, provisional BOOLEAN",
        [
            (0, 'sql-find', 'app/routes.py', 'SQLi', 6, 7, 'SQLi', False),
            (1, 'auth-update', 'app/Routes.py', 'Auth Bypass', 11, 11, 'Auth Bypass,SQLi', False),
            (2, 'md5', 'store.py', 'Weak Crypto', 16, 16, 'Weak Crypto', False),
            (3, 'pickle', 'store.py', 'Insecure Deserialization', 40, 44, 'Insecure Deserialization', False),
            (4, 'maybe', 'app/gates.py', 'Auth', 20, 22, 'Auth', True),
        ],
    ),
    "q_ledger": (
        "ts VARCHAR, arm VARCHAR, run_index INTEGER, recall DOUBLE, haiku_in BIGINT, cost_usd DOUBLE, tp INTEGER",
        [
            ('t1', 'graph', 0, 0.5, 10, 0.25, None),
            ('t2', 'plain', 1, 0.75, 30, 1.5, None),
        ],
    ),
    "q_sarif": (
        "ord INTEGER, title VARCHAR, category VARCHAR, rule_id VARCHAR, cwes VARCHAR, locations VARCHAR",
        [
            (0, 'SqlInjection', 'py/sql SqlInjection py/sql SQL injection cwe-089 CWE-089 query', 'py/sql', 'cwe-089,CWE-089', 'a b.py:3,c+d.py:0'),
            (1, 'py/hash', 'py/hash py/hash weak hash  md5', 'py/hash', '', 'e.py:9'),
            (3, 'codeql-finding', '', '', '', 'f.py:0'),
        ],
    ),
    "q_tool_versions": (
        "name VARCHAR, version VARCHAR",
        [
            ('pack', '0.9'),
            ('scanner', '2.1'),
        ],
    ),
    "q_semgrep": (
        "ord INTEGER, title VARCHAR, category VARCHAR, locations VARCHAR",
        [
            (0, 'sqli', 'python.lang.sqli CWE-89 CWE-90 bad query', 'a.py:4'),
            (1, 'md5', 'md5 CWE-327 weak', 'b.py:2'),
            (2, 'bare', 'bare  ', ':0'),
        ],
    ),
    "q_bandit": (
        "ord INTEGER, title VARCHAR, category VARCHAR, locations VARCHAR",
        [
            (0, 'hardcoded_sql', 'B608 hardcoded_sql SQL injection', 'a.py:4'),
        ],
    ),
    "q_run_records": (
        "source VARCHAR, artifact VARCHAR, run_index INTEGER, arm VARCHAR, wall_clock_s DOUBLE, loc INTEGER, haiku_in BIGINT, haiku_out BIGINT, sonnet_in BIGINT, sonnet_out BIGINT, findings INTEGER, confirmed_tp INTEGER, cost_usd DOUBLE, recall DOUBLE",
        [
            ('stored', 'a.json', 0, 'graph', 4.5, 120, 7, 0, 0, 3, 5, 2, None, 0.5),
            ('stored', 'a.json', 1, 'plain', 6.0, 120, 0, 0, 0, 0, 4, 4, 0.2, 1.0),
        ],
    ),
    "q_recall_values": (
        "arm VARCHAR, n BIGINT, mean DOUBLE",
        [
            ('graph', 3, 0.75),
            ('plain', 1, 0.25),
        ],
    ),
    "q_markdown": (
        "line VARCHAR",
        [
            ('| a | 1 | 0.5 |',),
            ('| b | 2 | — |',),
            ('| name | n | share |',),
            ('|---|---|---|',),
        ],
    ),
    "q_split_answer": (
        "id INTEGER, rel VARCHAR, source VARCHAR",
        [
            (1, 'app.py', 'z = 3\n'),
            (1, 'db.py', 'y = 2\n'),
        ],
    ),
    "q_cache_merge": (
        "path VARCHAR, hash VARCHAR, v DOUBLE",
        [
            ('a', 'h1', 1.0),
            ('b', 'h3', 3.0),
            ('c', 'h4', 4.0),
        ],
    ),
    "q_contents": (
        "rel VARCHAR, hash VARCHAR",
        [
            ('app/__init__.py', 'd41d8cd98f00b204e9800998ecf8427e'),
            ('app/broken.py', '5258d46cbe5f056c29fd905f437744da'),
            ('app/gates.py', 'f594bcc646d2fba7fdd254780b52e836'),
            ('app/routes.py', '9445a4a78169847a6a8c04734039d949'),
            ('app/store.py', 'a0bd9ff4f280809c446cedb93c3c41ba'),
            ('web/Panel.jsx', '18a4cbd85a82cd9bdee3d8edd0d5be8e'),
            ('web/typed.ts', 'ee076f732c53312d960c1604f4a1761f'),
        ],
    ),
    "q_targets": (
        "kind INTEGER, label VARCHAR, id VARCHAR",
        [
            (0, 'app/gates.py', 'file:app/gates.py'),
            (0, 'app/routes.py', 'file:app/routes.py'),
            (0, 'app/store.py', 'file:app/store.py'),
            (0, 'web/Panel.jsx', 'file:web/Panel.jsx'),
            (0, 'web/typed.ts', 'file:web/typed.ts'),
            (1, 'Panel.constructor', 'func:web/Panel.jsx::Panel.constructor'),
            (1, 'Panel.refresh', 'func:web/Panel.jsx::Panel.refresh'),
            (1, 'Session.close', 'func:app/gates.py::Session.close'),
            (1, 'Session.open', 'func:app/gates.py::Session.open'),
            (1, 'check_permission', 'func:app/gates.py::check_permission'),
            (1, 'parse', 'func:web/typed.ts::parse'),
        ],
    ),
    "q_source_count": (
        "n_files BIGINT",
        [
            (6,),
        ],
    ),
    "q_count_loc": (
        "n_files BIGINT, loc BIGINT",
        [
            (6, 82),
        ],
    ),
    "q_extract_imports": (
        "rel VARCHAR, ord INTEGER, module VARCHAR, names VARCHAR, line INTEGER, is_relative BOOLEAN",
        [
            ('app/gates.py', 0, 'store', 'run_query', 1, False),
            ('app/gates.py', 1, '.helpers', 'helpers,clean,check,clean', 2, True),
            ('app/gates.py', 2, 'os.path', '', 4, False),
            ('app/routes.py', 0, 'store', '', 1, False),
            ('app/routes.py', 1, 'gates', 'check_permission,validate_name', 2, False),
            ('app/store.py', 0, 'sqlite3', '', 2, False),
            ('app/store.py', 1, 'hashlib', '', 3, False),
            ('web/Panel.jsx', 0, 'react', 'useState,useEffect,React', 2, False),
            ('web/Panel.jsx', 1, 'fs', '', 3, False),
            ('web/Panel.jsx', 2, './store', '', 4, False),
            ('web/typed.ts', 0, './rows', 'Row', 1, False),
            ('web/typed.ts', 1, './helper', 'helper', 2, False),
        ],
    ),
    "q_extract_functions": (
        "rel VARCHAR, ord INTEGER, qualified_name VARCHAR, line_start INTEGER, line_end INTEGER, params VARCHAR",
        [
            ('app/gates.py', 0, 'check_permission', 7, 9, 'user,action'),
            ('app/gates.py', 1, 'validate_name', 12, 13, 'name'),
            ('app/gates.py', 2, 'Session.open', 19, 22, 'self,user'),
            ('app/gates.py', 3, 'Session.close', 28, 29, 'self'),
            ('app/routes.py', 0, 'update', 10, 19, 'user,ident,data'),
            ('app/routes.py', 1, 'export', 22, 23, 'ident'),
            ('app/store.py', 0, 'connect', 6, 7, 'path,timeout'),
            ('app/store.py', 1, 'run_query', 10, 12, 'sql'),
            ('app/store.py', 2, 'fingerprint', 15, 16, 'value'),
            ('web/Panel.jsx', 0, 'load', 6, 9, 'req'),
            ('web/Panel.jsx', 1, 'total', 20, 22, 'rows,start'),
            ('web/Panel.jsx', 2, 'one', 23, 23, 'z'),
            ('web/Panel.jsx', 3, 'Panel.constructor', 13, 13, 'props'),
            ('web/Panel.jsx', 4, 'Panel.refresh', 14, 17, 'id,limit'),
            ('web/typed.ts', 0, 'pick', 5, 5, 'rows,at'),
            ('web/typed.ts', 1, 'parse', 4, 4, 'text: string,strict?: boolean'),
        ],
    ),
    "q_extract_classes": (
        "rel VARCHAR, ord INTEGER, name VARCHAR, line_start INTEGER, line_end INTEGER, bases VARCHAR",
        [
            ('app/gates.py', 0, 'Session', 16, 29, 'Base,mixins.Timed'),
            ('web/Panel.jsx', 0, 'Panel', 11, 18, ''),
        ],
    ),
    "q_extract_calls": (
        "rel VARCHAR, ord INTEGER, name VARCHAR, line INTEGER, bare BOOLEAN, mixed VARCHAR, inside VARCHAR, inside_params VARCHAR",
        [
            ('app/gates.py', 0, 'run_query', 8, False, '', 'check_permission', 'action,user'),
            ('app/gates.py', 1, 'bool', 9, False, '', 'check_permission', 'action,user'),
            ('app/gates.py', 2, 'tidy', 13, False, '', 'validate_name', 'name'),
            ('app/gates.py', 3, 'check_permission', 21, True, '', 'Session.open', 'self,user'),
            ('app/gates.py', 4, 'Session.close', 22, False, '', 'Session.open', 'self,user'),
            ('app/gates.py', 5, 'str', 26, False, '', 'Session.name', 'self'),
            ('app/gates.py', 6, 'self.flush', 29, False, '', 'Session.close', 'self'),
            ('app/routes.py', 0, 'app.route', 5, False, '', None, ''),
            ('app/routes.py', 1, 'store.run_query', 7, False, 'name', 'find', 'name'),
            ('app/routes.py', 2, 'check_permission', 11, True, '', 'update', 'data,ident,user'),
            ('app/routes.py', 3, 'check_permission', 12, False, '', 'update', 'data,ident,user'),
            ('app/routes.py', 4, 'store.run_query', 17, True, 'column', 'update.inner', 'column'),
            ('app/routes.py', 5, 'validate_name', 18, True, '', 'update', 'data,ident,user'),
            ('app/routes.py', 6, 'check_permission', 18, True, '', 'update', 'data,ident,user'),
            ('app/routes.py', 7, 'store.run_query', 19, False, '', 'update', 'data,ident,user'),
            ('app/routes.py', 8, 'store.run_query', 23, False, 'ident', 'export', 'ident'),
            ('app/routes.py', 9, 'validate_name', 26, True, '', None, ''),
            ('app/store.py', 0, 'sqlite3.connect', 7, False, '', 'connect', 'mode,path,timeout'),
            ('app/store.py', 1, 'connect', 11, False, '', 'run_query', 'sql'),
            ('app/store.py', 2, 'conn.cursor().execute(sql).fetchall', 12, False, '', 'run_query', 'sql'),
            ('app/store.py', 3, 'conn.cursor().execute', 12, False, '', 'run_query', 'sql'),
            ('app/store.py', 4, 'conn.cursor', 12, False, '', 'run_query', 'sql'),
            ('app/store.py', 5, 'h.md5(value.encode()).hexdigest', 16, False, '', 'fingerprint', 'value'),
            ('app/store.py', 6, 'h.md5', 16, False, '', 'fingerprint', 'value'),
            ('app/store.py', 7, 'value.encode', 16, False, '', 'fingerprint', 'value'),
            ('web/Panel.jsx', 0, 'require', 4, False, '', None, ''),
            ('web/Panel.jsx', 1, 'escape', 7, False, '', None, ''),
            ('web/Panel.jsx', 10, 'z.map', 23, False, '', None, ''),
            ('web/Panel.jsx', 11, 'new Panel(1).refresh', 24, False, '', None, ''),
            ('web/Panel.jsx', 12, '/ab(c)/.test', 25, False, '', None, ''),
            ('web/Panel.jsx', 2, 'db.query(q).then', 8, False, '', None, ''),
            ('web/Panel.jsx', 3, 'db.query', 8, False, '', None, ''),
            ('web/Panel.jsx', 4, 'r.json', 8, False, '', None, ''),
            ('web/Panel.jsx', 5, 'super', 13, False, '', None, ''),
            ('web/Panel.jsx', 6, 'fetch', 15, False, '', None, ''),
            ('web/Panel.jsx', 7, 'load', 16, False, '', None, ''),
            ('web/Panel.jsx', 8, 'sum(rows).plus', 21, False, '', None, ''),
            ('web/Panel.jsx', 9, 'sum', 21, False, '', None, ''),
            ('web/typed.ts', 0, 'Number', 4, False, '', None, ''),
            ('web/typed.ts', 1, 'helper', 5, False, '', None, ''),
            ('web/typed.ts', 2, 'create', 8, False, '', None, ''),
        ],
    ),
    "q_function_calls": (
        "rel VARCHAR, owner VARCHAR, name VARCHAR, line INTEGER",
        [
            ('app/gates.py', 'Session.close', 'self.flush', 29),
            ('app/gates.py', 'Session.open', 'Session.close', 22),
            ('app/gates.py', 'Session.open', 'check_permission', 21),
            ('app/gates.py', 'check_permission', 'bool', 9),
            ('app/gates.py', 'check_permission', 'run_query', 8),
            ('app/gates.py', 'validate_name', 'tidy', 13),
            ('app/routes.py', 'export', 'store.run_query', 23),
            ('app/routes.py', 'update', 'check_permission', 11),
            ('app/routes.py', 'update', 'check_permission', 12),
            ('app/routes.py', 'update', 'check_permission', 18),
            ('app/routes.py', 'update', 'store.run_query', 17),
            ('app/routes.py', 'update', 'store.run_query', 19),
            ('app/routes.py', 'update', 'validate_name', 18),
            ('app/store.py', 'connect', 'sqlite3.connect', 7),
            ('app/store.py', 'fingerprint', 'h.md5', 16),
            ('app/store.py', 'fingerprint', 'h.md5(value.encode()).hexdigest', 16),
            ('app/store.py', 'fingerprint', 'value.encode', 16),
            ('app/store.py', 'run_query', 'conn.cursor', 12),
            ('app/store.py', 'run_query', 'conn.cursor().execute', 12),
            ('app/store.py', 'run_query', 'conn.cursor().execute(sql).fetchall', 12),
            ('app/store.py', 'run_query', 'connect', 11),
            ('web/Panel.jsx', 'Panel.constructor', 'super', 13),
            ('web/Panel.jsx', 'Panel.refresh', 'fetch', 15),
            ('web/Panel.jsx', 'Panel.refresh', 'load', 16),
            ('web/Panel.jsx', 'load', 'db.query', 8),
            ('web/Panel.jsx', 'load', 'db.query(q).then', 8),
            ('web/Panel.jsx', 'load', 'escape', 7),
            ('web/Panel.jsx', 'load', 'r.json', 8),
            ('web/Panel.jsx', 'one', 'z.map', 23),
            ('web/Panel.jsx', 'total', 'sum', 21),
            ('web/Panel.jsx', 'total', 'sum(rows).plus', 21),
            ('web/typed.ts', 'parse', 'Number', 4),
            ('web/typed.ts', 'pick', 'helper', 5),
        ],
    ),
    "q_top_level_calls": (
        "rel VARCHAR, name VARCHAR, line INTEGER",
        [
            ('app/routes.py', 'app.route', 5),
            ('app/routes.py', 'store.run_query', 7),
            ('app/routes.py', 'validate_name', 26),
            ('web/Panel.jsx', '/ab(c)/.test', 25),
            ('web/Panel.jsx', 'new Panel(1).refresh', 24),
            ('web/Panel.jsx', 'require', 4),
            ('web/typed.ts', 'create', 8),
        ],
    ),
    "q_table_functions": (
        "rel VARCHAR, name VARCHAR, line INTEGER",
        [
            ('app/gates.py', 'check_permission', 21),
            ('app/routes.py', 'check_permission', 11),
            ('app/routes.py', 'check_permission', 18),
            ('app/routes.py', 'store.run_query', 17),
            ('app/routes.py', 'validate_name', 18),
            ('app/routes.py', 'validate_name', 26),
        ],
    ),
    "q_graph_nodes": (
        "id VARCHAR, type VARCHAR, name VARCHAR, file VARCHAR, line_start INTEGER, line_end INTEGER",
        [
            ('class:app/gates.py::Session', 'class', 'Session', 'app/gates.py', 16, 29),
            ('class:web/Panel.jsx::Panel', 'class', 'Panel', 'web/Panel.jsx', 11, 18),
            ('file:app/__init__.py', 'file', None, 'app/__init__.py', None, None),
            ('file:app/broken.py', 'file', None, 'app/broken.py', None, None),
            ('file:app/gates.py', 'file', None, 'app/gates.py', None, None),
            ('file:app/routes.py', 'file', None, 'app/routes.py', None, None),
            ('file:app/store.py', 'file', None, 'app/store.py', None, None),
            ('file:web/Panel.jsx', 'file', None, 'web/Panel.jsx', None, None),
            ('file:web/typed.ts', 'file', None, 'web/typed.ts', None, None),
            ('func:app/gates.py::Session.close', 'function', 'close', 'app/gates.py', 28, 29),
            ('func:app/gates.py::Session.open', 'function', 'open', 'app/gates.py', 19, 22),
            ('func:app/gates.py::check_permission', 'function', 'check_permission', 'app/gates.py', 7, 9),
            ('func:app/gates.py::validate_name', 'function', 'validate_name', 'app/gates.py', 12, 13),
            ('func:app/routes.py::export', 'function', 'export', 'app/routes.py', 22, 23),
            ('func:app/routes.py::update', 'function', 'update', 'app/routes.py', 10, 19),
            ('func:app/store.py::connect', 'function', 'connect', 'app/store.py', 6, 7),
            ('func:app/store.py::fingerprint', 'function', 'fingerprint', 'app/store.py', 15, 16),
            ('func:app/store.py::run_query', 'function', 'run_query', 'app/store.py', 10, 12),
            ('func:web/Panel.jsx::Panel.constructor', 'function', 'constructor', 'web/Panel.jsx', 13, 13),
            ('func:web/Panel.jsx::Panel.refresh', 'function', 'refresh', 'web/Panel.jsx', 14, 17),
            ('func:web/Panel.jsx::load', 'function', 'load', 'web/Panel.jsx', 6, 9),
            ('func:web/Panel.jsx::one', 'function', 'one', 'web/Panel.jsx', 23, 23),
            ('func:web/Panel.jsx::total', 'function', 'total', 'web/Panel.jsx', 20, 22),
            ('func:web/typed.ts::parse', 'function', 'parse', 'web/typed.ts', 4, 4),
            ('func:web/typed.ts::pick', 'function', 'pick', 'web/typed.ts', 5, 5),
        ],
    ),
    "q_graph_edges": (
        "src VARCHAR, dst VARCHAR, type VARCHAR, line INTEGER",
        [
            ('file:app/gates.py', 'class:app/gates.py::Session', 'contains', None),
            ('file:app/gates.py', 'file:app/store.py', 'imports', None),
            ('file:app/gates.py', 'func:app/gates.py::Session.close', 'contains', None),
            ('file:app/gates.py', 'func:app/gates.py::Session.open', 'contains', None),
            ('file:app/gates.py', 'func:app/gates.py::check_permission', 'contains', None),
            ('file:app/gates.py', 'func:app/gates.py::validate_name', 'contains', None),
            ('file:app/routes.py', 'file:app/gates.py', 'imports', None),
            ('file:app/routes.py', 'file:app/store.py', 'imports', None),
            ('file:app/routes.py', 'func:app/routes.py::export', 'contains', None),
            ('file:app/routes.py', 'func:app/routes.py::update', 'contains', None),
            ('file:app/store.py', 'func:app/store.py::connect', 'contains', None),
            ('file:app/store.py', 'func:app/store.py::fingerprint', 'contains', None),
            ('file:app/store.py', 'func:app/store.py::run_query', 'contains', None),
            ('file:web/Panel.jsx', 'class:web/Panel.jsx::Panel', 'contains', None),
            ('file:web/Panel.jsx', 'func:web/Panel.jsx::Panel.constructor', 'contains', None),
            ('file:web/Panel.jsx', 'func:web/Panel.jsx::Panel.refresh', 'contains', None),
            ('file:web/Panel.jsx', 'func:web/Panel.jsx::load', 'contains', None),
            ('file:web/Panel.jsx', 'func:web/Panel.jsx::one', 'contains', None),
            ('file:web/Panel.jsx', 'func:web/Panel.jsx::total', 'contains', None),
            ('file:web/typed.ts', 'func:web/typed.ts::parse', 'contains', None),
            ('file:web/typed.ts', 'func:web/typed.ts::pick', 'contains', None),
            ('func:app/gates.py::Session.open', 'func:app/gates.py::Session.close', 'calls', 22),
            ('func:app/gates.py::Session.open', 'func:app/gates.py::check_permission', 'calls', 21),
            ('func:app/gates.py::check_permission', 'func:app/store.py::run_query', 'calls', 8),
            ('func:app/routes.py::export', 'func:app/store.py::run_query', 'calls', 23),
            ('func:app/routes.py::update', 'func:app/gates.py::check_permission', 'calls', 18),
            ('func:app/routes.py::update', 'func:app/gates.py::validate_name', 'calls', 18),
            ('func:app/routes.py::update', 'func:app/store.py::run_query', 'calls', 19),
            ('func:app/store.py::run_query', 'func:app/store.py::connect', 'calls', 11),
            ('func:web/Panel.jsx::Panel.refresh', 'func:web/Panel.jsx::load', 'calls', 16),
        ],
    ),
    "q_graph_relative": (
        "src VARCHAR, dst VARCHAR",
        [
            ('file:app/gates.py', 'file:app/store.py'),
            ('file:app/routes.py', 'file:app/gates.py'),
            ('file:app/routes.py', 'file:app/store.py'),
        ],
    ),
    "q_graph_json": (
        "kind VARCHAR, json VARCHAR",
        [
            ('edge', '{"source":"file:app/gates.py","target":"class:app/gates.py::Session","type":"contains"}'),
            ('edge', '{"source":"file:app/gates.py","target":"file:app/store.py","type":"imports"}'),
            ('edge', '{"source":"file:app/gates.py","target":"func:app/gates.py::Session.close","type":"contains"}'),
            ('edge', '{"source":"file:app/gates.py","target":"func:app/gates.py::Session.open","type":"contains"}'),
            ('edge', '{"source":"file:app/gates.py","target":"func:app/gates.py::check_permission","type":"contains"}'),
            ('edge', '{"source":"file:app/gates.py","target":"func:app/gates.py::validate_name","type":"contains"}'),
            ('edge', '{"source":"file:app/routes.py","target":"file:app/gates.py","type":"imports"}'),
            ('edge', '{"source":"file:app/routes.py","target":"file:app/store.py","type":"imports"}'),
            ('edge', '{"source":"file:app/routes.py","target":"func:app/routes.py::export","type":"contains"}'),
            ('edge', '{"source":"file:app/routes.py","target":"func:app/routes.py::update","type":"contains"}'),
            ('edge', '{"source":"file:app/store.py","target":"func:app/store.py::connect","type":"contains"}'),
            ('edge', '{"source":"file:app/store.py","target":"func:app/store.py::fingerprint","type":"contains"}'),
            ('edge', '{"source":"file:app/store.py","target":"func:app/store.py::run_query","type":"contains"}'),
            ('edge', '{"source":"file:web/Panel.jsx","target":"class:web/Panel.jsx::Panel","type":"contains"}'),
            ('edge', '{"source":"file:web/Panel.jsx","target":"func:web/Panel.jsx::Panel.constructor","type":"contains"}'),
            ('edge', '{"source":"file:web/Panel.jsx","target":"func:web/Panel.jsx::Panel.refresh","type":"contains"}'),
            ('edge', '{"source":"file:web/Panel.jsx","target":"func:web/Panel.jsx::load","type":"contains"}'),
            ('edge', '{"source":"file:web/Panel.jsx","target":"func:web/Panel.jsx::one","type":"contains"}'),
            ('edge', '{"source":"file:web/Panel.jsx","target":"func:web/Panel.jsx::total","type":"contains"}'),
            ('edge', '{"source":"file:web/typed.ts","target":"func:web/typed.ts::parse","type":"contains"}'),
            ('edge', '{"source":"file:web/typed.ts","target":"func:web/typed.ts::pick","type":"contains"}'),
            ('edge', '{"source":"func:app/gates.py::Session.open","target":"func:app/gates.py::Session.close","type":"calls"}'),
            ('edge', '{"source":"func:app/gates.py::Session.open","target":"func:app/gates.py::check_permission","type":"calls"}'),
            ('edge', '{"source":"func:app/gates.py::check_permission","target":"func:app/store.py::run_query","type":"calls"}'),
            ('edge', '{"source":"func:app/routes.py::export","target":"func:app/store.py::run_query","type":"calls"}'),
            ('edge', '{"source":"func:app/routes.py::update","target":"func:app/gates.py::check_permission","type":"calls"}'),
            ('edge', '{"source":"func:app/routes.py::update","target":"func:app/gates.py::validate_name","type":"calls"}'),
            ('edge', '{"source":"func:app/routes.py::update","target":"func:app/store.py::run_query","type":"calls"}'),
            ('edge', '{"source":"func:app/store.py::run_query","target":"func:app/store.py::connect","type":"calls"}'),
            ('edge', '{"source":"func:web/Panel.jsx::Panel.refresh","target":"func:web/Panel.jsx::load","type":"calls"}'),
            ('node', '{"id":"class:app/gates.py::Session","label":"Session","type":"class","file":"app/gates.py"}'),
            ('node', '{"id":"class:web/Panel.jsx::Panel","label":"Panel","type":"class","file":"web/Panel.jsx"}'),
            ('node', '{"id":"file:app/__init__.py","label":"app/__init__.py","type":"file","file":"app/__init__.py"}'),
            ('node', '{"id":"file:app/broken.py","label":"app/broken.py","type":"file","file":"app/broken.py"}'),
            ('node', '{"id":"file:app/gates.py","label":"app/gates.py","type":"file","file":"app/gates.py"}'),
            ('node', '{"id":"file:app/routes.py","label":"app/routes.py","type":"file","file":"app/routes.py"}'),
            ('node', '{"id":"file:app/store.py","label":"app/store.py","type":"file","file":"app/store.py"}'),
            ('node', '{"id":"file:web/Panel.jsx","label":"web/Panel.jsx","type":"file","file":"web/Panel.jsx"}'),
            ('node', '{"id":"file:web/typed.ts","label":"web/typed.ts","type":"file","file":"web/typed.ts"}'),
            ('node', '{"id":"func:app/gates.py::Session.close","label":"close","type":"function","file":"app/gates.py"}'),
            ('node', '{"id":"func:app/gates.py::Session.open","label":"open","type":"function","file":"app/gates.py"}'),
            ('node', '{"id":"func:app/gates.py::check_permission","label":"check_permission","type":"function","file":"app/gates.py"}'),
            ('node', '{"id":"func:app/gates.py::validate_name","label":"validate_name","type":"function","file":"app/gates.py"}'),
            ('node', '{"id":"func:app/routes.py::export","label":"export","type":"function","file":"app/routes.py"}'),
            ('node', '{"id":"func:app/routes.py::update","label":"update","type":"function","file":"app/routes.py"}'),
            ('node', '{"id":"func:app/store.py::connect","label":"connect","type":"function","file":"app/store.py"}'),
            ('node', '{"id":"func:app/store.py::fingerprint","label":"fingerprint","type":"function","file":"app/store.py"}'),
            ('node', '{"id":"func:app/store.py::run_query","label":"run_query","type":"function","file":"app/store.py"}'),
            ('node', '{"id":"func:web/Panel.jsx::Panel.constructor","label":"constructor","type":"function","file":"web/Panel.jsx"}'),
            ('node', '{"id":"func:web/Panel.jsx::Panel.refresh","label":"refresh","type":"function","file":"web/Panel.jsx"}'),
            ('node', '{"id":"func:web/Panel.jsx::load","label":"load","type":"function","file":"web/Panel.jsx"}'),
            ('node', '{"id":"func:web/Panel.jsx::one","label":"one","type":"function","file":"web/Panel.jsx"}'),
            ('node', '{"id":"func:web/Panel.jsx::total","label":"total","type":"function","file":"web/Panel.jsx"}'),
            ('node', '{"id":"func:web/typed.ts::parse","label":"parse","type":"function","file":"web/typed.ts"}'),
            ('node', '{"id":"func:web/typed.ts::pick","label":"pick","type":"function","file":"web/typed.ts"}'),
        ],
    ),
    "q_graph_summary": (
        "files BIGINT, functions BIGINT, classes BIGINT, function_names VARCHAR, class_names VARCHAR, edge_types VARCHAR",
        [
            (7, 16, 2, 'check_permission,validate_name,open,close,update', 'Session,Panel', '{"calls":9,"contains":18,"imports":3}'),
        ],
    ),
    "q_find_nodes": (
        "asked VARCHAR, id VARCHAR",
        [
            ('exact', 'file:app/store.py'),
            ('file', 'file:app/gates.py'),
            ('function', 'func:app/store.py::run_query'),
            ('name', 'func:app/gates.py::Session.open'),
            ('qualified', 'func:app/gates.py::Session.close'),
            ('suffix', 'file:app/store.py'),
        ],
    ),
    "q_blast_report": (
        "direct BIGINT, indirect BIGINT, tree VARCHAR, prompt VARCHAR",
        [
            (2, 6, '  file:app/store.py\n  func:app/store.py::run_query\n    file:app/gates.py', '  file:app/store.py\n  func:app/store.py::run_query\n    file:app/gates.py\n    file:app/routes.py\n    func:app/gates.py::check_permission\n    func:app/routes.py::export\n    func:app/routes.py::update\n      func:app/gates.py::Session.open'),
        ],
    ),
    "q_blast_paths": (
        "node VARCHAR, depth INTEGER, path VARCHAR, direct_caller BOOLEAN",
        [
            ('func:app/gates.py::Session.open', 3, 'func:app/store.py::run_query func:app/gates.py::check_permission func:app/gates.py::Session.open', False),
            ('func:app/gates.py::check_permission', 2, 'func:app/store.py::run_query func:app/gates.py::check_permission', False),
            ('func:app/routes.py::export', 2, 'func:app/store.py::run_query func:app/routes.py::export', False),
            ('func:app/routes.py::update', 2, 'func:app/store.py::run_query func:app/routes.py::update', False),
            ('func:app/store.py::run_query', 1, 'func:app/store.py::run_query', True),
        ],
    ),
    "q_file_neighborhood": (
        "node VARCHAR",
        [
            ('file:app/gates.py',),
            ('file:app/routes.py',),
            ('file:app/store.py',),
            ('func:app/gates.py::check_permission',),
            ('func:app/gates.py::validate_name',),
            ('func:app/routes.py::update',),
            ('func:app/store.py::run_query',),
        ],
    ),
    "q_called_elsewhere": (
        "names VARCHAR",
        [
            ('check_permission (in gates.py),run_query (in store.py),validate_name (in gates.py)',),
        ],
    ),
    "q_neighbour_bodies": (
        "node VARCHAR, depth INTEGER, taken INTEGER, body VARCHAR",
        [
            ('func:app/gates.py::check_permission', 1, 3, '7: def check_permission(user, action):\n8:     rows = run_query("SELECT 1")\n9:     return bool(rows)'),
            ('func:app/gates.py::validate_name', 1, 2, '12: def validate_name(name):\n13:     return tidy(name)'),
            ('func:app/store.py::run_query', 1, 2, '10: def run_query(sql):\n11:     conn = connect("app.db")'),
        ],
    ),
    "q_edge_chain": (
        "step INTEGER, src VARCHAR, dst VARCHAR, type VARCHAR, line INTEGER",
        [
            (0, 'func:app/routes.py::update', 'func:app/store.py::run_query', 'calls', 19),
            (1, 'func:app/store.py::run_query', 'func:app/store.py::connect', 'calls', 11),
        ],
    ),
    "q_keep_relevant": (
        "id VARCHAR",
        [
            ('class:web/Panel.jsx::Panel',),
            ('file:app/store.py',),
            ('file:web/Panel.jsx',),
            ('file:web/typed.ts',),
            ('func:app/store.py::connect',),
            ('func:app/store.py::fingerprint',),
            ('func:app/store.py::run_query',),
            ('func:web/Panel.jsx::Panel.constructor',),
            ('func:web/Panel.jsx::Panel.refresh',),
            ('func:web/Panel.jsx::load',),
            ('func:web/Panel.jsx::one',),
            ('func:web/Panel.jsx::total',),
            ('func:web/typed.ts::parse',),
            ('func:web/typed.ts::pick',),
        ],
    ),
    "q_combined": (
        "node VARCHAR",
        [
            ('file:app/gates.py',),
            ('file:app/routes.py',),
            ('file:app/store.py',),
            ('func:app/store.py::connect',),
            ('func:app/store.py::fingerprint',),
            ('func:app/store.py::run_query',),
        ],
    ),
    "q_code_deletions": (
        "id VARCHAR, name VARCHAR, matched VARCHAR, called_by VARCHAR, in_degree BIGINT, text VARCHAR",
        [
            ('func:app/gates.py::verify_text', 'verify_text', 'verify', 'file:app/gates.py,func:app/gates.py::validate_name', 2, 'verify_text()  matched keywords: verify\n  Called by: file:app/gates.py, func:app/gates.py::validate_name\n  In-degree (pre): 2'),
        ],
    ),
    "q_code_broken": (
        "caller VARCHAR, missing_callee VARCHAR, edge_type VARCHAR, callers_of_caller VARCHAR, text VARCHAR",
        [
            ('file:app/gates.py', 'func:app/gates.py::verify_text', 'contains', 'file:app/routes.py', 'file:app/gates.py  →  func:app/gates.py::verify_text\n  func:app/gates.py::verify_text was deleted. file:app/gates.py is now calling nothing.\n  Exposure chain — file:app/gates.py is called by: file:app/routes.py'),
            ('func:app/gates.py::validate_name', 'func:app/gates.py::verify_text', 'calls', 'file:app/gates.py', 'func:app/gates.py::validate_name  →  func:app/gates.py::verify_text\n  func:app/gates.py::verify_text was deleted. func:app/gates.py::validate_name is now calling nothing.\n  Exposure chain — func:app/gates.py::validate_name is called by: file:app/gates.py'),
        ],
    ),
    "q_boundary_deletions": (
        "pos INTEGER, file VARCHAR, opener VARCHAR, raw VARCHAR, severity VARCHAR, trigger VARCHAR, text VARCHAR",
        [
            (15, 'app/routes.py', '"""', '-    """', 'HIGH', 'revealed code contains executable definitions/statements', 'File: app/routes.py\nDeleted delimiter: """  (Python multiline string / docstring opener)\nSeverity: HIGH\n'),
            (28, 'app/routes.py', '/*', '-/* off', 'HIGH', 'revealed code contains executable definitions/statements', 'File: app/routes.py\nDeleted delimiter: /*  (C-style block comment opener (JS/TS/Java/Go/C/C++))\nSeverity: HIGH\n'),
            (34, 'app/routes.py', '#=', '-#==== banner', 'HIGH', 'revealed code contains executable definitions/statements', 'File: app/routes.py\nDeleted delimiter: #=  (Julia block comment opener)\nSeverity: HIGH\n'),
            (5, 'app/old.py', '"""', '-"""', 'HIGH', 'revealed code calls sink `system(...)`', 'File: app/old.py\nDeleted delimiter: """  (Python multiline string / docstring opener)\nSeverity: HIGH\n'),
        ],
    ),
    "q_diff_files": (
        "file VARCHAR, n BIGINT, first INTEGER",
        [
            ('app/old.py', 11, 2),
            ('app/routes.py', 29, 13),
            (None, 2, 0),
        ],
    ),
    "q_diff_blocks": (
        "diff_id VARCHAR, file VARCHAR, text VARCHAR",
        [
            ('d', 'x', 'diff --git a/x b/x\n+3'),
            ('d', 'y', 'diff --git a/y b/y\n+2'),
            ('e', 'unknown', '+no header\n+at all'),
        ],
    ),
    "q_sql_sinks": (
        "sink VARCHAR",
        [
            ('execute',),
            ('executemany',),
            ('executescript',),
            ('run_query',),
        ],
    ),
    "q_static_rules": (
        "part INTEGER, rel VARCHAR, line INTEGER, caller VARCHAR, severity VARCHAR, category VARCHAR, subject VARCHAR, tainted VARCHAR, description VARCHAR",
        [
            (0, 'app/routes.py', 17, 'update.inner', 'CRITICAL', 'SQLi', 'run_query', 'column', "update.inner() interpolates parameter(s) ['column'] into a SQL string passed to run_query() — a SQL injection sink. Use bound parameters instead."),
            (0, 'app/routes.py', 23, 'export', 'CRITICAL', 'SQLi', 'run_query', 'ident', "export() interpolates parameter(s) ['ident'] into a SQL string passed to run_query() — a SQL injection sink. Use bound parameters instead."),
            (0, 'app/routes.py', 7, 'find', 'CRITICAL', 'SQLi', 'run_query', 'name', "find() interpolates parameter(s) ['name'] into a SQL string passed to run_query() — a SQL injection sink. Use bound parameters instead."),
            (1, 'app/store.py', 16, 'fingerprint', 'HIGH', 'Weak Crypto', 'md5', None, 'MD5 is cryptographically weak; if used for passwords or security tokens it is trivially brute-forced. Use a slow, salted KDF (bcrypt/scrypt/PBKDF2).'),
        ],
    ),
    "q_ignored_returns": (
        "rel VARCHAR, line INTEGER, caller VARCHAR, severity VARCHAR, category VARCHAR, callee VARCHAR, callee_file VARCHAR, cross_file BOOLEAN",
        [
            ('app/gates.py', 21, 'Session.open', 'HIGH', 'Auth Bypass', 'check_permission', 'app/gates.py', False),
            ('app/routes.py', 11, 'update', 'HIGH', 'Auth Bypass', 'check_permission', 'app/gates.py', True),
            ('app/routes.py', 18, 'update', 'HIGH', 'Auth Bypass', 'check_permission', 'app/gates.py', True),
            ('app/routes.py', 18, 'update', 'HIGH', 'Auth Bypass', 'validate_name', 'app/gates.py', True),
            ('app/routes.py', 26, '<module>', 'HIGH', 'Auth Bypass', 'validate_name', 'app/gates.py', True),
        ],
    ),
    "q_detector_report": (
        "part INTEGER, file_ord INTEGER, ord INTEGER, hash VARCHAR",
        [
            (0, 2, 3, 'c8dbdf75f021de1f152e96ebe8d48306'),
            (0, 3, 2, '4d0cae991cc4843f47ae6e0ebe141fcd'),
            (0, 3, 5, '41c0afb056daaa51d3a8d60be2332c05'),
            (0, 3, 6, '012dc02d05e4bebd0e9d4cf810714112'),
            (0, 3, 9, 'c4b905a98d0b59d7c9daa56d95ef04cb'),
            (1, 3, 1, '997f0ebc91ec61d9b5ea40005448ffc8'),
            (1, 3, 4, '8ea6bfdf9832040df3cbc91a37078438'),
            (1, 3, 8, '70150072fc90835231c00ca33ab3272d'),
            (2, 4, 6, '67caaae3eb342c4edaf165deda94f233'),
        ],
    ),
    "q_report_findings": (
        "run VARCHAR, ord INTEGER, severity VARCHAR, title VARCHAR, category VARCHAR, locations VARCHAR, n_raw INTEGER",
        [
            ('one', 1, 'CRITICAL', 'Query from a string', 'SQL Injection', 'app/routes.py:8,app/routes.py:8,lib/x.ts:12', 182),
            ('one', 2, 'HIGH', 'Ignored check', 'Broken access control', 'Routes.py:14', 102),
            ('one', 3, 'HIGH', 'Same check again', 'auth', 'other/ROUTES.py:12', 95),
            ('one', 4, 'LOW', 'Hash', 'secrets exposure (md5)', 'a path/with blanks/store.py:18,blanks/store.py:18', 112),
            ('one', 5, 'MEDIUM', 'Objects', 'Injection', 'store.py:46', 86),
            ('one', 6, 'MEDIUM', 'Perhaps', 'authz', 'gates.py:25', 82),
            ('one', 7, 'LOW', 'Wrong kind', 'XSS', 'store.py:40', 80),
            ('one', 8, 'LOW', 'Nowhere', 'race condition', '', 60),
            ('two', 0, 'HIGH', 'Two', 'SQLi / Auth Bypass', 'routes.py:11', 90),
            ('two', 1, 'HIGH', 'Far', 'SQLi', 'routes.py:17', 76),
        ],
    ),
    "q_report_dedupe": (
        "run VARCHAR, title VARCHAR",
        [
            ('one', 'Hash'),
            ('one', 'Ignored check'),
            ('one', 'Nowhere'),
            ('one', 'Objects'),
            ('one', 'Perhaps'),
            ('one', 'Query from a string'),
            ('one', 'Wrong kind'),
            ('two', 'Far'),
            ('two', 'Two'),
        ],
    ),
    "q_report_matches": (
        "run VARCHAR, f INTEGER, id VARCHAR, dist BIGINT, agree BOOLEAN",
        [
            ('one', 1, 'sql-find', 1, True),
            ('one', 3, 'auth-update', 1, True),
            ('one', 4, 'md5', 2, True),
            ('one', 5, 'pickle', 2, True),
            ('one', 6, 'maybe', 3, True),
            ('one', 7, 'pickle', None, False),
            ('two', 0, 'auth-update', 0, True),
        ],
    ),
    "q_report_outcome": (
        "run VARCHAR, tp BIGINT, fp BIGINT, fn BIGINT, n_provisional BIGINT, caught VARCHAR, missed VARCHAR, precision DOUBLE, recall DOUBLE, f1 DOUBLE",
        [
            ('none', 0, 0, 4, 0, '', 'auth-update,md5,pickle,sql-find', 0.0, 0.0, 0.0),
            ('one', 4, 3, 0, 1, 'auth-update,md5,pickle,sql-find', '', 0.571429, 1.0, 0.727273),
            ('two', 1, 1, 3, 0, 'auth-update', 'md5,pickle,sql-find', 0.5, 0.25, 0.333333),
        ],
    ),
    "q_tool_scores": (
        "run VARCHAR, n_raw BIGINT, n_deduped BIGINT, tp BIGINT, fp BIGINT, fn BIGINT, loc_tp BIGINT",
        [
            ('none', 0, 0, 0, 0, 4, 0),
            ('one', 8, 7, 4, 2, 0, 4),
            ('two', 2, 2, 1, 1, 3, 2),
        ],
    ),
    "q_self_test": (
        "run VARCHAR, tp BIGINT, fp BIGINT, fn BIGINT, precision DOUBLE, recall DOUBLE, f1 DOUBLE",
        [
            ('self-test', 4, 0, 0, 1.0, 1.0, 1.0),
        ],
    ),
    "q_normalized_runs": (
        "run VARCHAR, tokens_per_kloc DOUBLE, seconds_per_kloc DOUBLE, seconds_per_vuln DOUBLE",
        [
            ('a', 12500.0, 75.0, 10.0),
            ('b', 2000.0, 30.0, None),
        ],
    ),
    "q_arm_difference": (
        "metric VARCHAR, mean_a DOUBLE, mean_b DOUBLE, delta_pp DOUBLE",
        [
            ('precision', 0.75, 0.25, 50.0),
            ('recall', 0.75, 0.5, 25.0),
        ],
    ),
    "q_deletion_recall": (
        "kind VARCHAR, n BIGINT, caught BIGINT",
        [
            ('comment', 2, 1),
            ('control', 1, 1),
        ],
    ),
    "q_specificity": (
        "n_findings BIGINT, loc BIGINT, per_kloc DOUBLE",
        [
            (0, 82, 0.0),
        ],
    ),
    "q_heldout_gate": (
        "n_safe BIGINT, categories VARCHAR, lacking VARCHAR, passed BOOLEAN",
        [
            (0, 'Auth Bypass,SQLi,Weak Crypto', '', True),
        ],
    ),
    "q_file_scores": (
        "rel VARCHAR, lines_added INTEGER, confidence DOUBLE, likely_ai BOOLEAN, summary VARCHAR",
        [
            ('app/gates.py', 29, 0.394118, False, '39% AI-generated confidence (complete_functions, missing_edge_cases, bulk_addition)'),
            ('app/routes.py', 26, 0.405882, False, '40% AI-generated confidence (complete_functions, missing_edge_cases, bulk_addition)'),
            ('app/store.py', 16, 0.382353, False, '38% AI-generated confidence (boilerplate_density, complete_functions, uniform_style)'),
            ('web/Panel.jsx', 25, 0.094118, False, '9% AI-generated confidence (bulk_addition)'),
            ('web/typed.ts', 9, 0.0, False, '0% AI-generated confidence ()'),
        ],
    ),
    "q_human_study": (
        "project VARCHAR, n BIGINT, shipped BIGINT, code_only BIGINT",
        [
            ('p', 2, 1, 2),
            ('q', 1, 0, 0),
        ],
    ),
    "q_stage_records": (
        "run VARCHAR, stage VARCHAR, seconds DOUBLE",
        [
            ('r', 'graph', 2.0),
            ('r', 'scan', 7.0),
        ],
    ),
    "q_usage_totals": (
        "run VARCHAR, haiku_in BIGINT, haiku_out BIGINT, sonnet_in BIGINT, sonnet_out BIGINT, calls BIGINT",
        [
            ('r', 15, 3, 100, 50, 3),
            ('t', 0, 0, 7, 7, 1),
        ],
    ),
    "q_fresh_records": (
        "benchmark VARCHAR, run_index INTEGER, source VARCHAR, wall_clock_s DOUBLE, files BIGINT, loc BIGINT, haiku_in BIGINT, haiku_out BIGINT, sonnet_in BIGINT, sonnet_out BIGINT, findings BIGINT, confirmed_tp BIGINT, cost_usd DOUBLE",
        [
            ('made', 0, 'fresh', 12.5, 6, 82, 10, 2, 100, 50, 7, 3, 0.4),
        ],
    ),
    "q_triage": (
        "id INTEGER, files VARCHAR, severity VARCHAR, reasoning VARCHAR",
        [
            (0, 'a.py', 'high', 'x {y}'),
            (1, '', None, 'no json here'),
            (2, '', None, '{broken'),
            (3, '', None, 'only'),
            (4, '', None, '{not: json}'),
        ],
    ),
    "q_scan_off": (
        "part INTEGER, rel VARCHAR, at BIGINT, text VARCHAR",
        [
            (1, 'app/routes.py', 1, '\n[scanning app/routes.py:1-12]\n544 ## File `app/routes.py` (lines 1-12 of 26)'),
            (1, 'app/routes.py', 11, '\n[scanning app/routes.py:11-22]\n587 ## File `app/routes.py` (lines 11-22 of 26)'),
            (1, 'app/routes.py', 21, '\n[scanning app/routes.py:21-26]\n355 ## File `app/routes.py` (lines 21-26 of 26)'),
        ],
    ),
    "q_scan_note": (
        "part INTEGER, rel VARCHAR, at BIGINT, hash VARCHAR",
        [
            (0, '0000', 6442450946, '4d0cae991cc4843f47ae6e0ebe141fcd'),
            (0, '0000', 6442450949, '41c0afb056daaa51d3a8d60be2332c05'),
            (0, '0000', 6442450950, '012dc02d05e4bebd0e9d4cf810714112'),
            (0, '0000', 6442450953, 'c4b905a98d0b59d7c9daa56d95ef04cb'),
            (0, '0001', 6442450945, '997f0ebc91ec61d9b5ea40005448ffc8'),
            (0, '0001', 6442450948, '8ea6bfdf9832040df3cbc91a37078438'),
            (0, '0001', 6442450952, '70150072fc90835231c00ca33ab3272d'),
            (1, 'app/routes.py', 1, 'd3eb81c90901a6967ecad33510c4e44e'),
            (1, 'app/routes.py', 11, '696fc15d613ef3d76939e56ad8c3037e'),
            (1, 'app/routes.py', 21, '552ce68f0ae6b9277fe8e874ca33952c'),
        ],
    ),
    "q_scan_subgraph": (
        "part INTEGER, rel VARCHAR, at BIGINT, text VARCHAR",
        [
            (1, 'app/routes.py', 1, '\n[scanning app/routes.py:1-12]\n1292 ## File `app/routes.py` (lines 1-12 of 26)'),
            (1, 'app/routes.py', 11, '\n[scanning app/routes.py:11-22]\n1335 ## File `app/routes.py` (lines 11-22 of 26)'),
            (1, 'app/routes.py', 21, '\n[scanning app/routes.py:21-26]\n1103 ## File `app/routes.py` (lines 21-26 of 26)'),
        ],
    ),
    "q_context_parts": (
        "part INTEGER, rel VARCHAR, text VARCHAR",
        [
            (0, '', '## Dependency Graph\ntold'),
            (1, '', '\n## Source Files\n'),
            (2, 'long.py', '### long.py\n```\nl0\nl1\nl2\nl3\n\n... (2 lines truncated)\n```\n'),
            (2, 'short.py', '### short.py\n```\nx\ny\n```\n'),
            (3, '', '\n## Additional Context\nmore'),
        ],
    ),
    "q_orient_parts": (
        "rel VARCHAR, text VARCHAR",
        [
            ('app/__init__.py', '### app/__init__.py\n```\n\n```\n'),
            ('app/broken.py', '### app/broken.py\n```\ndef half(:\n    return run(\n\n```\n'),
            ('app/gates.py', '### app/gates.py\n```\nfrom store import run_query\nfrom .helpers import clean as tidy, check\nfrom __future__ import annotations\n... (27 more lines)\n```\n'),
            ('app/routes.py', '### app/routes.py\n```\nimport store\nfrom gates import check_permission, validate_name\n\n... (24 more lines)\n```\n'),
            ('app/store.py', '### app/store.py\n```\n"""Storage."""\nimport sqlite3, os\nimport hashlib as h\n... (14 more lines)\n```\n'),
            ('web/Panel.jsx', '### web/Panel.jsx\n```\n// panel\nimport React, { useState as state, useEffect } from \'react\';\nimport * as fs from "fs";\n... (23 more lines)\n```\n'),
            ('web/typed.ts', "### web/typed.ts\n```\nimport type { Row } from './rows';\nimport helper from './helper';\n\n... (7 more lines)\n```\n"),
        ],
    ),
    "q_debug_parts": (
        "part INTEGER, rel VARCHAR, hash VARCHAR",
        [
            (0, '', '0efb7820564fa9ae70b2ca8e92465564'),
            (1, '', 'd7a950997dab882e2d05d601492b48a1'),
            (2, 'app/store.py', '54d1cd3d5927a38f1a7eb66a2e9c7d7f'),
        ],
    ),
    "q_change_report": (
        "part INTEGER, key VARCHAR, hash VARCHAR",
        [
            (0, 'app/old.py 00000000000000000005', '5479f44b65c0811f73fc16b2f047c6b8'),
            (0, 'app/routes.py 00000000000000000015', '8b5b3debc7b281af471c0f828c1cc996'),
            (0, 'app/routes.py 00000000000000000028', '744cc44078fd2cd24c5426f3b608c2ef'),
            (0, 'app/routes.py 00000000000000000034', 'b7cc9bea0ae00aaa965a185baf1955b6'),
            (1, 'func:app/gates.py::verify_text', '937f6ece551a5709a6b6cf647eeff45f'),
            (2, 'file:app/gates.py func:app/gates.py::verify_text', 'b7101498b2438b34c81428e6ccde2aea'),
            (2, 'func:app/gates.py::validate_name func:app/gates.py::verify_text', '0af3590d23e7f350165d62c7eb5cde02'),
            (4, '0 0000000003 0000000002', '4d0cae991cc4843f47ae6e0ebe141fcd'),
            (4, '0 0000000003 0000000005', '41c0afb056daaa51d3a8d60be2332c05'),
            (4, '0 0000000003 0000000006', '012dc02d05e4bebd0e9d4cf810714112'),
            (4, '0 0000000003 0000000009', 'c4b905a98d0b59d7c9daa56d95ef04cb'),
            (4, '1 0000000003 0000000001', '997f0ebc91ec61d9b5ea40005448ffc8'),
            (4, '1 0000000003 0000000004', '8ea6bfdf9832040df3cbc91a37078438'),
            (4, '1 0000000003 0000000008', '70150072fc90835231c00ca33ab3272d'),
        ],
    ),
    "q_experiment": (
        "arm VARCHAR, run_index INTEGER, tp BIGINT, fp BIGINT, fn BIGINT, caught VARCHAR",
        [
            ('graph', 0, 4, 2, 0, 'auth-update,md5,pickle,sql-find'),
            ('graph', 1, 4, 2, 0, 'auth-update,md5,pickle,sql-find'),
            ('plain', 0, 1, 1, 3, 'auth-update'),
            ('plain', 1, 1, 1, 3, 'auth-update'),
        ],
    ),
    "q_spend_first": (
        "ord INTEGER, estimate DOUBLE, spent DOUBLE, allowed BOOLEAN",
        [
            (1, 0.5, 0.5, True),
            (2, 0.4, 0.9, True),
            (3, 0.4, 1.3, False),
        ],
    ),
    "q_stream_budget": (
        "arm VARCHAR, ord BIGINT, estimate DOUBLE, allowed BOOLEAN",
        [
            ('a', 1, 0.5, True),
            ('a', 2, 0.6, False),
            ('a', 3, 0.2, True),
            ('b', 1, 2.0, False),
        ],
    ),
    "q_stream_authorship": (
        "file VARCHAR, lines_added INTEGER, confidence DOUBLE, summary VARCHAR",
        [
            ('a.py', 60, 0.617647, '61% AI-generated confidence (bulk_addition, boilerplate_density, complete_functions)'),
        ],
    ),
    "q_stream_spend": (
        "start VARCHAR, model VARCHAR, cost_usd DOUBLE, calls BIGINT",
        [
            ('00:00', 'haiku', 0.3, 2),
            ('01:00', 'sonnet', 1.0, 1),
        ],
    ),
    "q_snapshot_pair": (
        "rel VARCHAR, added INTEGER, removed INTEGER",
        [
            ('app/gates.py', 1, 3),
            ('app/routes.py', 2, 2),
            ('app/store.py', 10, 1),
        ],
    ),
    "q_pooled_runs": (
        "k INTEGER, n_findings BIGINT, tp BIGINT, fp BIGINT, caught VARCHAR",
        [
            (1, 2, 1, 1, 'auth-update'),
            (2, 7, 3, 3, 'auth-update,md5,pickle'),
            (3, 7, 3, 3, 'auth-update,md5,pickle'),
        ],
    ),
    "q_git_changed": (
        "file VARCHAR",
        [
            ('app/gates.py',),
            ('app/routes.py',),
        ],
    ),
    "q_prune": (
        "id VARCHAR",
        [
            ('file:app/store.py',),
            ('file:web/typed.ts',),
            ('func:app/store.py::connect',),
            ('func:app/store.py::fingerprint',),
            ('func:app/store.py::run_query',),
            ('func:web/typed.ts::parse',),
            ('func:web/typed.ts::pick',),
        ],
    ),
    "q_scan_report": (
        "severity VARCHAR, category VARCHAR, n BIGINT",
        [
            ('CRITICAL', 'SQLi', 3),
            ('HIGH', 'Auth Bypass', 4),
        ],
    ),
}


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v).lower() if isinstance(v, bool) else repr(v)


def sql(name: str) -> str:
    """The rows as a query."""
    columns, rows = ROWS[name]
    named = [c.split(" ", 1) for c in columns.split(", ")]
    chosen = ", ".join(f"CAST(c{i} AS {kind}) AS {c}" for i, (c, kind) in enumerate(named))
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT {chosen} FROM (VALUES {values}) AS v({', '.join(f'c{i}' for i in range(len(named)))})"
