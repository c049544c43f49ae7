"""Git repositories as tables (S5-S9): formats ``git_snapshot``, ``git_diff`` and ``git_commits``.

The driver asks git for names; executors read blobs and diff files, each task its own. The repository has to be in a
folder that executors reach. Nothing is written and no work tree is touched.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .. import spec
from .tree import FILES, Chunk, chunks, decoded, kind, row, skipped


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    """What a git command says; RuntimeError where it fails, as for a folder that is no repository."""
    got = subprocess.run(["git", "-c", "core.quotePath=false", "-C", repo.removeprefix("file://"), *args], input=data, capture_output=True, check=False)
    if got.returncode:
        raise RuntimeError(f"git {args[0]}: {got.stderr.decode('utf-8', 'replace').strip()}")
    return got.stdout


def listed(raw: bytes) -> list[str]:
    return [x.decode("utf-8", "replace") for x in raw.split(b"\0") if x]


def parent_of(repo: str, head: str = "HEAD") -> str:
    """What a commit is compared with: its first parent; the empty tree for a first commit or a detached head."""
    detached = head == "HEAD" and subprocess.run(["git", "-C", repo.removeprefix("file://"), "symbolic-ref", "-q", "HEAD"], capture_output=True, check=False).returncode != 0
    first = len(git(repo, "rev-list", "--parents", "-n", "1", head).split()) < 2
    return spec.EMPTY_TREE if detached or first else f"{head}~1"


class GitSnapshot(DataSource):
    """The supported files of a commit. Options: path, commit (HEAD), maxfiles."""

    @classmethod
    def name(cls) -> str:
        return "git_snapshot"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return SnapshotReader(dict(self.options))


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.commit = options["path"], options.get("commit", "HEAD")
        self.most = int(options.get("maxfiles", spec.MAX_FILES))

    def partitions(self) -> list[Chunk]:
        found = []
        for line in listed(git(self.repo, "ls-tree", "-r", "-z", self.commit)):
            head, rel = line.split("\t", 1)
            mode, what, blob = head.split()
            if what == "blob" and kind(rel) and not skipped(rel.split("/")):
                found.append((rel.split("/"), rel, blob))
        return chunks([(rel, blob, i) for i, (_, rel, blob) in enumerate(sorted(found)[: self.most])])

    def read(self, part: Chunk):
        if not part.items:
            return
        raw = git(self.repo, "cat-file", "--batch", data="".join(f"{blob}\n" for _, blob, _ in part.items).encode())
        at = 0
        for rel, _, place in part.items:
            end = raw.index(b"\n", at)
            size = int(raw[at:end].split()[-1])
            yield row(rel, raw[end + 1 : end + 1 + size], place)
            at = end + size + 2


class GitDiff(DataSource):
    """One row a line of a unified diff, ordered by pos over all files. Options: path; base (the parent) and head, or
    changes: staged, unstaged, untracked or all."""

    @classmethod
    def name(cls) -> str:
        return "git_diff"

    def schema(self) -> str:
        return "diff_id string, file string, pos long, raw string"

    def reader(self, schema) -> DataSourceReader:
        return DiffReader(dict(self.options))


class DiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.changes = options["path"], options.get("changes", "")
        self.head = options.get("head", "HEAD")
        self.base = options.get("base") or ("" if self.changes else parent_of(self.repo, self.head))

    def sides(self) -> dict[str, list[str]]:
        """Arguments of git diff for each part asked for."""
        if not self.changes:
            return {f"{self.base}..{self.head}": [self.base, self.head]}
        every = {"staged": ["--cached"], "unstaged": [], "untracked": None}
        return every if self.changes == "all" else {self.changes: every[self.changes]}

    def partitions(self) -> list[Chunk]:
        items = []
        for diff_id, args in self.sides().items():
            names = listed(git(self.repo, "ls-files", "--others", "--exclude-standard", "-z") if args is None else git(self.repo, "diff", "--name-only", "-z", *args))
            items += [(diff_id, args, n) for n in names]
        return chunks([(*x, i) for i, x in enumerate(items)])

    def read(self, part: Chunk):
        for diff_id, args, name, place in part.items:
            if args is None:
                try:
                    with open(f"{self.repo.removeprefix('file://')}/{name}", "rb") as f:
                        rows = decoded(f.read()).splitlines()
                except OSError:
                    continue
                rows = [f"diff --git a/{name} b/{name}", "new file mode 100644", "--- /dev/null", f"+++ b/{name}", f"@@ -0,0 +1,{len(rows)} @@", *(f"+{x}" for x in rows)]
            else:
                rows = git(self.repo, "diff", *args, "--", name).decode("utf-8", "replace").removesuffix("\n").split("\n")
            for k, raw in enumerate(rows):
                yield diff_id, name, (place << 32) + k, raw


class GitCommits(DataSource):
    """One row a commit, newest first. Options: path, head (HEAD), most (0: all)."""

    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self) -> str:
        return "sha string, ord int, n_parents int, author string, at timestamp, message string"

    def reader(self, schema) -> DataSourceReader:
        return CommitReader(dict(self.options))


class CommitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.head, self.most = options["path"], options.get("head", "HEAD"), int(options.get("most", 0))

    def partitions(self) -> list[Chunk]:
        limit = [f"--max-count={self.most}"] if self.most else []
        return chunks([(sha.decode(), i) for i, sha in enumerate(git(self.repo, "rev-list", *limit, self.head).split())])

    def read(self, part: Chunk):
        import datetime

        for sha, i in part.items:
            parents, author, at, message = git(self.repo, "log", "-1", "--format=%P%x00%an%x00%ct%x00%B", sha).decode("utf-8", "replace").split("\0", 3)
            yield sha, i, len(parents.split()), author, datetime.datetime.fromtimestamp(int(at), datetime.UTC), message.removesuffix("\n")


def read_diff(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    return spark.read.format("git_diff").options(**options).load(repo)


def changed_files(diff: DataFrame) -> DataFrame:
    return diff.select("file").distinct()


def as_text(diff: DataFrame, by: list[str]) -> DataFrame:
    """The lines of each diff (or of each file of it) as one text."""
    return diff.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n").alias("diff"))


def commit_diffs(spark: SparkSession, repo: str, sha: str = "HEAD") -> DataFrame:
    """What a commit did to each file, against its first parent: file, diff (hunks only), message."""
    base = spec.EMPTY_TREE if len(git(repo, "rev-list", "--parents", "-n", "1", sha).split()) < 2 else f"{sha}~1"
    text = as_text(read_diff(spark, repo, base=base, head=sha), ["file"])
    message = git(repo, "log", "-1", "--format=%B", sha).decode("utf-8", "replace").removesuffix("\n")
    return text.select("file", F.regexp_extract("diff", r"(?s)(?:^|\n)(@@.*)$", 1).alias("diff"), F.lit(message).alias("message"))
