"""From a regular expression to a boolean query over trigrams that holds for every text it matches (Cox, 2012).

The planner walks Python's own syntax tree of the pattern, carrying for each part what is known about its matches: the
exact strings, or their prefixes and suffixes, whether it can be empty, and the query that must hold. The query is a
superset filter: it never decides a match, and a pattern that says nothing gives ALL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _parser as sre_parse
except ImportError:
    import sre_parse

MAX_EXACT, MAX_AFFIX, MAX_CLASS = 7, 20, 100
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Query:
    """ALL, NONE, a trigram, or a conjunction or disjunction of queries."""

    kind: str
    gram: str = ""
    parts: tuple[Query, ...] = ()

    def grams(self) -> set[str]:
        return {self.gram} if self.kind == "gram" else set().union(*(p.grams() for p in self.parts))

    def holds(self, grams: set[str]) -> bool:
        if self.kind == "gram":
            return self.gram in grams
        if self.kind == "and":
            return all(p.holds(grams) for p in self.parts)
        if self.kind == "or":
            return any(p.holds(grams) for p in self.parts)
        return self.kind == "all"

    def column(self, grams: Column) -> Column:
        """The query as a predicate on an array of trigrams."""
        if self.kind == "gram":
            return F.array_contains(grams, self.gram)
        if self.kind in ("and", "or"):
            out = self.parts[0].column(grams)
            for p in self.parts[1:]:
                out = out & p.column(grams) if self.kind == "and" else out | p.column(grams)
            return out
        return F.lit(self.kind == "all")


ALL, NONE = Query("all"), Query("none")


def _join(kind: str, parts) -> Query:
    zero, one = (NONE, ALL) if kind == "and" else (ALL, NONE)
    flat: dict[Query, None] = {}
    for p in parts:
        if p == zero:
            return zero
        for q in p.parts if p.kind == kind else (p,):
            if q != one:
                flat[q] = None
    if not flat:
        return one
    ordered = tuple(sorted(flat, key=lambda q: (q.kind, q.gram, repr(q.parts))))
    return ordered[0] if len(ordered) == 1 else Query(kind, parts=ordered)


def conj(*parts: Query) -> Query:
    return _join("and", parts)


def disj(*parts: Query) -> Query:
    return _join("or", parts)


def of_string(s: str) -> Query:
    return conj(*(Query("gram", s[i : i + 3]) for i in range(len(s) - 2)))


def of_strings(strings) -> Query:
    """What holds when one of the strings occurs; a short one says nothing."""
    return disj(*(of_string(s) for s in strings)) if strings else NONE


@dataclass
class Info:
    empty: bool
    exact: set[str] | None
    prefix: set[str]
    suffix: set[str]
    match: Query


def _any(empty: bool = True) -> Info:
    return Info(empty, None, {""}, {""}, ALL)


def _strings(found: set[str]) -> Info:
    return Info("" in found, found, set(), set(), ALL)


def _tidy(i: Info) -> Info:
    """Give up sets that are too large, keeping what they say as trigrams, prefixes and suffixes."""
    if i.exact is not None:
        shortest = min(map(len, i.exact), default=0)
        if len(i.exact) > MAX_EXACT or shortest >= 4:
            return _tidy(Info(i.empty, None, {s[:3] for s in i.exact}, {s[-3:] for s in i.exact}, conj(i.match, of_strings(i.exact))))
        return i

    def fewer(found: set[str], cut):
        n = 3
        found = {cut(s, n) for s in found}
        while len(found) > MAX_AFFIX and n:
            n -= 1
            found = {cut(s, n) for s in found}
        return found

    match = i.match
    for found in (i.prefix, i.suffix):
        if found and min(map(len, found)) >= 3:
            match = conj(match, of_strings(found))
    return Info(
        i.empty, None, fewer(i.prefix, lambda s, n: s[:n]), fewer(i.suffix, lambda s, n: s[-n:] if n else ""), match
    )


def _cross(a: set[str], b: set[str]) -> set[str]:
    return {x + y for x in a for y in b}


def _concat(x: Info, y: Info) -> Info:
    match = conj(x.match, y.match)
    if x.exact is not None and y.exact is not None:
        return _tidy(Info(x.empty and y.empty, _cross(x.exact, y.exact), set(), set(), match))
    px, sy = x.exact if x.exact is not None else x.prefix, y.exact if y.exact is not None else y.suffix
    sx, py = x.exact if x.exact is not None else x.suffix, y.exact if y.exact is not None else y.prefix
    prefix = _cross(x.exact, py) if x.exact is not None else (px | py if x.empty else px)
    suffix = _cross(sx, y.exact) if y.exact is not None else (sy | sx if y.empty else sy)
    if x.exact is None and y.exact is None and len(sx) * len(py) <= MAX_AFFIX:
        seam = _cross(sx, py)
        if seam and min(map(len, seam)) >= 3:
            match = conj(match, of_strings(seam))
    return _tidy(Info(x.empty and y.empty, None, prefix, suffix, match))


def _either(x: Info, y: Info) -> Info:
    if x.exact is not None and y.exact is not None and x.match == y.match == ALL:
        return _tidy(Info(x.empty or y.empty, x.exact | y.exact, set(), set(), ALL))

    def open_(i: Info) -> Info:
        return i if i.exact is None else Info(i.empty, None, i.exact, i.exact, conj(i.match, of_strings(i.exact)))

    x, y = open_(x), open_(y)
    return _tidy(Info(x.empty or y.empty, None, x.prefix | y.prefix, x.suffix | y.suffix, disj(x.match, y.match)))


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out.add(chr(arg).translate(_FOLD))
        elif name == "RANGE":
            if arg[1] - arg[0] + 1 > MAX_CLASS:
                return None
            out |= {chr(c).translate(_FOLD) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MAX_CLASS else None


def _walk(tree) -> Info:
    out = _strings({""})
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            part = _strings({chr(arg).translate(_FOLD)})
        elif name == "IN":
            found = _class(arg)
            part = _any(False) if found is None else _tidy(_strings(found))
        elif name == "BRANCH":
            infos = [_walk(b) for b in arg[1]]
            part = infos[0]
            for i in infos[1:]:
                part = _either(part, i)
        elif name == "SUBPATTERN":
            part = _walk(arg[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            one = _walk(inner)
            if low == 0:
                part = _either(one, _strings({""})) if high == 1 else _any()
            else:
                part = one
                for _ in range(min(low, 4) - 1):
                    part = _concat(part, one)
                if high != low or low > 4:
                    part = _concat(part, _any())
        elif name == "AT":
            part = _strings({""})
        else:
            part = _any(name not in ("ANY", "NOT_LITERAL"))
        out = _concat(out, part)
    return out


def plan(pattern: str) -> Query:
    """The query of a pattern. Trigrams are folded (A-Z), so it serves case-insensitive matching as well."""
    unsupported(pattern)
    info = _walk(sre_parse.parse(pattern))
    if info.exact is not None:
        return conj(info.match, of_strings(info.exact))
    out = info.match
    for found in (info.prefix, info.suffix):
        out = conj(out, of_strings(found) if found else ALL)
    return out


def unsupported(pattern: str) -> None:
    """Refuse what automaton engines can't do: lookaround, backreferences and possessive or atomic groups."""
    if re.search(r"\(\?(<?[=!]|>|P=)|\\[1-9]|[*+?}]\+", pattern):
        raise ValueError("lookaround, backreferences and possessive quantifiers are not supported")
