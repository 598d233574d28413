"""Columns on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_fold


def scheme(url: Column) -> Column:
    return ascii_fold(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def host(url: Column) -> Column:
    """Lower-case host without user and port, empty for a relative URL."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return ascii_fold(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def covers(rule_host: str, rule_path: str, url: Column) -> Column:
    """Whether a rule (a host and a path prefix) covers a URL. Ambiguous separators in the path are refused."""
    p = path(url)
    ambiguous = p.rlike(r"(?i)%2f|%5c|\\|/\.\.?(/|$)")
    prefix = rule_path.rstrip("/")
    inside = (p == prefix) | F.startswith(p, F.lit(prefix + "/"))
    return (host(url) == rule_host) & inside & ~ambiguous


def registrable(host_: Column, suffixes: Column) -> Column:
    """The label before the longest public suffix, with it; ``suffixes`` is an array of suffixes."""
    labels = F.split(host_, r"\.")
    tails = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(i.alias("i"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("tail")),
    )
    first = F.array_min(F.transform(F.filter(tails, lambda t: F.array_contains(suffixes, t["tail"])), lambda t: t["i"]))
    return F.when(first > 1, F.array_join(F.slice(labels, first - 1, F.size(labels)), "."))


def request_target(url: Column) -> Column:
    """What is asked of a host: path (at least /) and query; null for a url with a fragment, which is refused."""
    bare = F.regexp_replace(F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), "^$|^(?=[?])", "/")
    return F.when(~F.contains(url, F.lit("#")), bare)


def within_limits(scopes: dict[str, list[str]], most_rules: int = 8, most_origins: int = 4) -> bool:
    """Whether a scope of several origins (origin to its path rules) is small enough to be granted."""
    return 0 < len(scopes) <= most_origins and all(scopes.values()) and sum(map(len, scopes.values())) <= most_rules
