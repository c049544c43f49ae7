"""A small project with planted flaws, as texts: what the registered queries on source code read.

Written for this library. Two versions: in ``BEFORE`` queries are bound and checks count; ``AFTER`` takes a validator
away, opens a commented block and builds queries from strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = "rel string, language string, source string, lines int, file_ord int"

STORE = '''"""Storage."""
import sqlite3, os
import hashlib as h


def connect(path, timeout=5, *flags, mode: str = "r", **more):
    return sqlite3.connect(path)


def run_query(sql):
    conn = connect("app.db")
    return conn.cursor().execute(sql).fetchall()


def fingerprint(value):
    return h.md5(value.encode()).hexdigest()
'''

GATES = '''from store import run_query
from .helpers import clean as tidy, check
from __future__ import annotations
from os.path import *


def check_permission(user, action):
    rows = run_query("SELECT 1")
    return bool(rows)


def validate_name(name):
    return tidy(name)


class Session(Base, mixins.Timed, metaclass=Meta):
    limit = 3

    def open(self, user):
        self.user = user
        check_permission(user, "open")
        return Session.close(self)

    @property
    def name(self):
        return str(self.user)

    async def close(self):
        await self.flush()
'''

ROUTES = '''import store
from gates import check_permission, validate_name


@app.route("/find")
def find(name):
    return store.run_query(f"SELECT * FROM users WHERE name = '{name}'")


def update(user, ident, data):
    check_permission(user, "update")
    if not check_permission(user, "write"):
        return None
    sql = "UPDATE users SET x = ?"

    def inner(column):
        store.run_query("SELECT " + column)
    validate_name(data), check_permission(user, "log")
    return store.run_query(sql, [ident])


def export(ident):
    return store.run_query("SELECT * FROM t WHERE id = %s" % ident)


validate_name("start")
'''

PANEL = """// panel
import React, { useState as state, useEffect } from 'react';
import * as fs from "fs";
const db = require('./store');

export function load(req, res = {}) {
  const q = `SELECT ${escape(req.q)} -- (not a call)`;
  return db.query(q).then(r => r.json());
}

export default class Panel extends React.Component {
  size = 1;
  constructor(props) { super(props); this.size = 2; }
  async refresh(id, limit) {
    if (limit) { await fetch(`/x/${id}`); }
    return load(id);
  }
}

export const total = async (rows, start) => {
  return sum(rows).plus(start);
};
const one = z => z.map(total)
new Panel(1).refresh(2);
/ab(c)/.test("x");
"""

TYPED = """import type { Row } from './rows';
import helper from './helper';

export const parse = (text: string, strict?: boolean): number => Number(text);
export function pick<T>(rows: T[], at: number): T { return helper<T>(rows, at); }
abstract class Store {
  private rows: Row[] = [];
  static make(path: string): Store { return create(path); }
}
"""

BROKEN = "def half(:\n    return run(\n"

AFTER = {
    "app/__init__.py": "",
    "app/broken.py": BROKEN,
    "app/gates.py": GATES,
    "app/routes.py": ROUTES,
    "app/store.py": STORE,
    "web/Panel.jsx": PANEL,
    "web/typed.ts": TYPED,
}
OTHER = {"app/notes.txt": "not code\n", "node_modules/x/index.js": "skipped()\n", "app/build/made.py": "skipped()\n", "app/UPPER.PY": "x = 1\r\ny = 2\r"}

BEFORE = {
    **AFTER,
    "app/routes.py": ROUTES.replace("validate_name(data), ", "").replace('"SELECT " + column', "sql, [column]"),
    "app/gates.py": GATES.replace("def validate_name(name):\n    return tidy(name)\n", "def validate_name(name):\n    return verify_text(tidy(name))\n\n\ndef verify_text(text):\n    return text.strip()\n"),
}

#: The change of one file in which an opener goes.
OPENED = '''diff --git a/app/old.py b/app/old.py
index 1111111..2222222 100644
--- a/app/old.py
+++ /dev/null
@@ -1,6 +1,5 @@
-"""
 x = "a" """b"""
 os.system(command)
 """
 y = 1
diff --git a/app/routes.py b/app/routes.py
index 3333333..4444444 100644
--- a/app/routes.py
+++ b/app/routes.py
@@ -10,7 +10,6 @@ def find(name)
-    """
     query = "SELECT * FROM users WHERE id = " + ident
-    kept = 1
+    name = 2
     """
     cursor.execute(query)
@@ -30,4 +30,3 @@
-\'\'\'
 only words, and a # sign
 # call(this)
 \'\'\'
-"""closed on its line"""
 run(x)
-/* off
 total => 1
 */
--- [[ a header, not a line
---[[
 lua()
-#==== banner
 print(1)
 =# end
 eval(2)
-<!-- note
index stops here
 system(3)
'''


def frame(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """The files as the source readers give them."""
    from ..sources.tree import row

    rows = [row(rel, text.encode(), i) for i, (rel, text) in enumerate(sorted(files.items(), key=lambda x: x[0].split("/")))]
    return spark.createDataFrame(rows, FILES)


def on_disk(spark: SparkSession, files: dict[str, str]) -> str:
    """Writes the files into a fresh folder that executors share; returns its address."""
    from ..sources.tree import opened
    from .lineage import shared_folder

    root = shared_folder(spark, "fixture")
    store, base = opened(root)
    for rel, text in files.items():
        store.create_dir(f"{base}/{rel}".rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(f"{base}/{rel}") as f:
            f.write(text.encode())
    return root


def repository(spark: SparkSession) -> str:
    """A git repository with the two versions as commits, in a fresh folder that executors share."""
    import os
    import subprocess

    root = on_disk(spark, {**BEFORE, **OTHER}).removeprefix("file://")
    same = {"GIT_AUTHOR_DATE": "2020-01-02T03:04:05Z", "GIT_COMMITTER_DATE": "2020-01-02T03:04:05Z", "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@example.org", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@example.org"}

    def git(*args: str) -> None:
        subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, env={**os.environ, **same})

    git("init", "-q", "-b", "main")
    git("add", "-A")
    git("commit", "-q", "-m", "First version")
    for rel, text in AFTER.items():
        with open(f"{root}/{rel}", "w", encoding="utf-8") as f:
            f.write(text)
    git("commit", "-q", "-a", "-m", "Update queries\n\nCo-Authored-By: Copilot")
    return root
