"""Where rows come from and go to: source trees, git repositories, reports of other tools, ledgers."""

from .git import GitCommits, GitDiff, GitSnapshot
from .tree import SourceTree

ALL = (SourceTree, GitSnapshot, GitDiff, GitCommits)


def register(spark) -> None:
    """Makes the formats source_tree, git_snapshot, git_diff and git_commits known to a session."""
    for source in ALL:
        spark.dataSource.register(source)
