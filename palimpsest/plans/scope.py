"""Historical query scopes: revision ranges, times and paths as lazy predicates and semi joins."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.graph import Chains, chains

#: Paths that one scope may name.
MOST_PATHS = 447


class ScopeError(ValueError):
    """A scope that the user has to correct."""


def time_bound(text: str, *, until: bool = False) -> int:
    """Epoch seconds of a bound: a date is a whole UTC day, an instant needs an offset.

    A lower bound with a fraction of a second is the next whole one, an upper one the last.
    """
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        day = datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=timezone.utc)
        return calendar.timegm(((day + timedelta(days=1)) if until else day).timetuple()) - (1 if until else 0)
    found = re.fullmatch(r"(\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2})", text)
    if not found:
        raise ScopeError(f"not a date or an instant with an offset: {text}")
    whole, part, offset = found.groups()
    at = datetime.fromisoformat(whole.upper().replace(" ", "T") + ("+00:00" if offset in "Zz" else offset))
    more = part is not None and part.strip(".0") != ""
    return calendar.timegm(at.utctimetuple()) + (1 if more and not until else 0)


def safe_path(path: str) -> str:
    """A path relative to the root, without dots that leave it."""
    clean = path.replace("\\", "/")
    if clean.startswith("/") or re.match(r"^[A-Za-z]:", clean) or ".." in clean.split("/"):
        raise ScopeError(f"not a path within the repository: {path}")
    return clean.removeprefix("./").rstrip("/") or "."


def directory_prefix(prefix: str) -> str:
    """A directory below the root as a report takes it: unlike a path of a scope it may have no ``.`` and no empty part."""
    clean = prefix.replace("\\", "/").rstrip("/")
    if not clean or clean.startswith("/") or re.match(r"^[A-Za-z]:", clean) or "\0" in clean or {"", ".", ".."} & set(clean.split("/")):
        raise ScopeError(f"not a directory within the repository: {prefix}")
    return clean


@dataclass(frozen=True)
class Scope:
    """What a query may look at: reachable from ``to`` but not from ``from_``, within times, touching ``paths``.

    Revisions are given as numbers or, if they may be many, as a table of one column.
    """

    to: tuple[int, ...] | DataFrame = ()
    from_: tuple[int, ...] | DataFrame = ()
    since: str | None = None
    until: str | None = None
    paths: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        low, high = self.times()
        if low is not None and high is not None and low > high:
            raise ScopeError("since lies after until")
        if len(self.paths) > MOST_PATHS:
            raise ScopeError(f"more than {MOST_PATHS} paths")

    def times(self) -> tuple[int | None, int | None]:
        return (time_bound(self.since) if self.since else None, time_bound(self.until, until=True) if self.until else None)

    def apply(self, commits: DataFrame, parents: DataFrame, touched: DataFrame | None = None, graph: Chains | None = None) -> DataFrame:
        """The commits in scope: time predicates reach the scan, ranges and paths are semi and anti joins. ``graph``: a layout that is kept."""
        low, high = self.times()
        out = commits
        if low is not None:
            out = out.where(F.col("commit_time") >= low)
        if high is not None:
            out = out.where(F.col("commit_time") <= high)
        given = lambda ids: isinstance(ids, DataFrame) or bool(ids)
        if given(self.to) or given(self.from_):
            graph = graph or chains(parents)
        if given(self.to):
            out = out.join(graph.ancestors(self.to), "commit_id", "left_semi")
        if given(self.from_):
            out = out.join(graph.ancestors(self.from_), "commit_id", "left_anti")
        if touched is not None and self.paths and "." not in map(safe_path, self.paths):
            out = out.join(touched.where(under_any(F.col("path"), self.paths)).select("commit_id").distinct(), "commit_id", "left_semi")
        return out


def under_any(path: Column, roots: tuple[str, ...]) -> Column:
    """Whether ``path`` is one of ``roots`` or lies below one, byte for byte."""
    found = F.lit(False)
    for r in map(safe_path, roots):
        found = found | (path == r) | path.startswith(f"{r}/") if r != "." else F.lit(True)
    return found
