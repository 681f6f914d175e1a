"""Git repositories as tables: a Python data source that reads commits, parents, changes and hunks in parallel.

``spark.read.format("githistory").option("path", repo).option("table", "commits").load()``.
The driver lists the commits once, parents before children; tasks read slices of them
through ``git`` itself. Nothing but ``git`` plumbing is run, without hooks or pagers.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "commits": "oid string, position long, commit_time long, subject string, body string",
    "parents": "oid string, position int, parent_oid string",
    "changes": "oid string, ordinal long, status string, old_path binary, new_path binary, old_blob string, new_blob string, old_mode string, new_mode string",
    "hunks": "oid string, ordinal long, hunk long, text binary",
    "tree": "revision string, path binary, mode string, blob string",
}
SLICE = 256


def git(repo: str, *args: str, stdin: bytes | None = None) -> bytes:
    """Output of a git command, with the user's configuration out of the way."""
    env = {**os.environ, "GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_SYSTEM": os.devnull, "GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C"}
    done = subprocess.run(["git", "-C", repo, "--no-pager", "-c", "core.quotePath=false", *args], input=stdin, capture_output=True, env=env)
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout


def graph(repo: str, tips: list[str]) -> list[str]:
    """All commits reachable from the tips, parents first."""
    return git(repo, "rev-list", "--reverse", "--topo-order", *tips, "--").decode().split()


def parse_commit(raw: bytes) -> tuple[list[str], int, str, str]:
    """Parents in order, committer time, subject and body of a commit object."""
    head, _, message = raw.partition(b"\n\n")
    lines = head.split(b"\n")
    parents = [x[7:].decode() for x in lines if x.startswith(b"parent ")]
    committer = [x for x in lines if x.startswith(b"committer ")][-1]
    text = message.decode("utf-8", "replace")
    subject, _, body = text.partition("\n")
    return parents, int(committer.split()[-2]), subject.rstrip("\r"), body


def read_objects(repo: str, oids: list[str]) -> Iterator[tuple[str, bytes]]:
    out, at = git(repo, "cat-file", "--batch", stdin="".join(f"{o}\n" for o in oids).encode()), 0
    while at < len(out):
        end = out.index(b"\n", at)
        head = out[at:end].split()
        if head[-1] == b"missing":
            at = end + 1
            continue
        size = int(head[2])
        yield head[0].decode(), out[end + 1 : end + 1 + size]
        at = end + 2 + size


def raw_changes(repo: str, oids: list[str]) -> Iterator[tuple]:
    """Rows of ``changes``: each commit against its first parent, renames found."""
    for oid in oids:
        parts = git(repo, "diff-tree", "--root", "-r", "-M", "--raw", "-z", "--full-index", "--no-commit-id", "-m", "--first-parent", oid).split(b"\0")
        at, ordinal = 0, 0
        while at < len(parts) - 1:
            old_mode, new_mode, old_blob, new_blob, status = parts[at].decode().lstrip(":").split()
            two = status[0] in "RC"
            old, new = parts[at + 1], parts[at + 2] if two else parts[at + 1]
            yield (oid, ordinal, status, None if status[0] == "A" else old, None if status[0] == "D" else new, old_blob, new_blob, old_mode, new_mode)
            at, ordinal = at + 2 + two, ordinal + 1


def raw_hunks(repo: str, oids: list[str], context: int = 3) -> Iterator[tuple]:
    """Rows of ``hunks``: text from the ``@@`` line on. A change of type is one change with two diffs."""
    for oid in oids:
        patch = git(repo, "diff-tree", "--root", "-r", "-M", "-p", f"-U{context}", "--no-commit-id", "-m", "--first-parent", "--no-ext-diff", "--no-textconv", oid)
        ordinal, hunk, rows, seen = -1, 0, [], None
        for line in [*patch.split(b"\n")[:-1], b"diff --git end"]:
            opens = line.startswith(b"diff --git ")
            if (opens or line.startswith(b"@@ ")) and rows:
                yield (oid, ordinal, hunk, b"\n".join(rows) + b"\n")
                hunk, rows = hunk + 1, []
            if opens:
                if line != seen:
                    ordinal, hunk = ordinal + 1, 0
                seen = line
            elif line.startswith(b"@@ ") or rows:
                rows.append(line)


class _Slice(InputPartition):
    def __init__(self, start: int, oids: list[str]) -> None:
        self.start, self.oids = start, oids


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.repo, self.name = options["path"], options.get("table", "commits")
        self.tips = options.get("tips", "HEAD").split()
        self.size = int(options.get("slice", SLICE))
        self.exclude = set(options.get("known", "").split())

    def partitions(self) -> list[_Slice]:
        if self.name == "tree":
            return [_Slice(0, self.tips)]
        oids = graph(self.repo, self.tips)
        return [_Slice(k, oids[k : k + self.size]) for k in range(0, len(oids), self.size)]

    def read(self, part: _Slice) -> Iterator[tuple]:
        mine = [o for o in part.oids if o not in self.exclude]
        if self.name == "tree":
            for revision in part.oids:
                for row in git(self.repo, "ls-tree", "-r", "-z", "--full-tree", revision).split(b"\0")[:-1]:
                    meta, path = row.split(b"\t", 1)
                    mode, _, blob = meta.decode().split()
                    yield revision, path, mode, blob
        elif self.name in ("commits", "parents"):
            place = {o: part.start + k for k, o in enumerate(part.oids)}
            for oid, raw in read_objects(self.repo, mine):
                parents, time, subject, body = parse_commit(raw)
                if self.name == "commits":
                    yield oid, place[oid], time, subject, body
                else:
                    yield from ((oid, k, p) for k, p in enumerate(parents))
        else:
            yield from (raw_changes if self.name == "changes" else raw_hunks)(self.repo, mine)


class GitHistory(DataSource):
    """Options: ``path``; ``table`` of ``SCHEMAS``; ``tips``, revisions; ``known``, commits to leave out; ``slice``, commits a task."""

    @classmethod
    def name(cls) -> str:
        return "githistory"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> GitReader:
        return GitReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitHistory)


def version(repo: str = ".") -> tuple[int, ...]:
    return tuple(int(x) for x in git(repo, "version").decode().split()[2].split(".")[:2])


def can_replay_merges(repo: str = ".") -> bool:
    """Merges are replayed by ``merge-tree --write-tree``, which git has from 2.40 on."""
    return version(repo) >= (2, 40)
