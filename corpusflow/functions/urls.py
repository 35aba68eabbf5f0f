"""Columns on URLs. Rules known when the plan is made become CASE expressions, so no join is needed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)"


def authority(url: Column) -> Column:
    """Host with user and port as written."""
    return F.regexp_extract(url, _PARTS, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def host_root(url: Column) -> Column:
    """Scheme and authority: what a robots file holds for."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def doc_path(url: Column) -> Column:
    """Host and path as a file name: a directory gets `_index`, other characters become `_`; query and fragment go."""
    whole = F.concat(authority(url), path(url))
    named = F.when(F.endswith(whole, F.lit("/")), F.concat(whole, F.lit("_index"))).otherwise(whole)
    named = F.when(path(url) == "", F.concat(authority(url), F.lit("/_index"))).otherwise(named)
    return F.regexp_replace(F.regexp_replace(named, r"[^A-Za-z0-9._/-]", "_"), "^/+|/+$", "")


def without_trailing_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def wanted(url: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Some include pattern is found (if there are any) and no exclude pattern is."""
    keep = reduce(lambda a, b: a | b, [url.rlike(p) for p in include]) if include else F.lit(True)
    return reduce(lambda a, b: a & b, [~url.rlike(p) for p in exclude], keep)


def section_of(url: Column, sections: Mapping[str, str]) -> Column:
    """Label of the longest prefix of the path, or null."""
    at = path(url)
    chain = None
    for prefix in sorted(sections, key=len, reverse=True):
        hit, label = F.startswith(at, F.lit(prefix)), F.lit(sections[prefix])
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return F.lit(None).cast("string") if chain is None else chain


def top_folders(url: Column, depth: int = 3) -> Column:
    """The first `depth` segments after the host."""
    return F.concat_ws("/", F.slice(F.split(url, "/"), 4, depth))
