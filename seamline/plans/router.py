"""Query shapes, their lanes and weights, and token variants; all of it runs on the driver."""

from __future__ import annotations

import re

#: Weights (lexical, semantic) of a shape, and the constant of rank fusion.
WEIGHTS = {
    "identifier": (0.8, 0.2),
    "short": (0.8, 0.2),
    "code_literal": (0.9, 0.1),
    "log_excerpt": (0.9, 0.1),
    "path": (0.9, 0.1),
    "natural_language": (0.4, 0.6),
    "regex": (1.0, 0.0),
}
#: Weights (lexical, semantic) of the older kinds, and whether the lexical lane is used at all.
KIND_WEIGHTS = {
    "identifier": (0.8, 0.2, True),
    "path": (0.9, 0.1, True),
    "error_code": (0.9, 0.1, True),
    "natural_language": (0.4, 0.6, False),
    "mixed": (0.6, 0.4, True),
    "regex": (1.0, 0.0, False),
}
RRF_K = 60
DEPTHS = (200, 400, 800, 1600, 3200)
LEAST_PROSE_TOKENS = 4

_STAMP = re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}|\b\d{2}:\d{2}:\d{2}\b|\[\d{2,7}\]|\bpid[=: ]\d+", re.I)
_REGEX = re.compile(r"\\[bBdDsSwW]|\.\*|\.\+|\[[^\]]+\][*+?]|\(\?:|^\^|[^\\]\$$|\w\|\w")
_PATH = re.compile(r"^[\w.@-]*(/[\w.@-]+)+/?$|^[\w-]+\.(ts|tsx|js|py|rs|go|java|c|h|cpp|md|json|toml|yaml|yml)$")
_LEVEL = re.compile(r"(?<!\S)(INFO|WARN|ERROR|DEBUG|TRACE|PANICKED)(?!\S)", re.I)
_CODE = re.compile(r"[(){}\[\]<>=!|&]|[,;](?!\s)|\\.", re.S)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'|`[^`]*`")
_IDENTIFIER = re.compile(r"^(\w+(::|\.)\w+((::|\.)\w+)*|[A-Za-z]\w*_\w+|_\w+|[a-z]+[A-Z]\w*|[A-Z][a-z0-9]+[A-Z]\w*)$")
_KEBAB = re.compile(r"^[A-Za-z0-9]+(-[A-Za-z0-9]+)+$")


def tokens(query: str) -> list[str]:
    """Words of a query; what stands in quotes is one token."""
    return [a or b or c for a, b, c in re.findall(r'"([^"]*)"|\'([^\']*)\'|(\S+)', query)]


def is_identifier(token: str) -> bool:
    return bool(_IDENTIFIER.match(token)) or len(token) >= 12 and bool(_KEBAB.match(token))


def classify(query: str) -> str:
    """The first shape that fits: regex, log excerpt, path, code literal, identifier, then prose or short."""
    query = query.strip()
    ts = tokens(query)
    if _REGEX.search(query):
        return "regex"
    if len(ts) >= 3 and (_STAMP.search(query) or _LEVEL.search(query)):
        return "log_excerpt"
    if len(ts) == 1 and _PATH.match(ts[0]):
        return "path"
    quoted = _QUOTED.search(query)
    if quoted and (len(ts) <= 3 or quoted[0] == query) or _CODE.search(_QUOTED.sub("", query)) and (not quoted or len(ts) <= 3):
        return "code_literal"
    if len(ts) == 1 and is_identifier(ts[0]):
        return "identifier"
    return "natural_language" if len(ts) >= LEAST_PROSE_TOKENS else "short"


def lanes(shape: str, *, lexical: bool = True, semantic: bool = True) -> list[tuple[str, float]]:
    """Lanes with weights for a shape, without those whose index isn't ready."""
    lex, sem = WEIGHTS[shape]
    first = {"log_excerpt": ["anchored"], "regex": ["pattern"]}.get(shape, ["exact"])
    out = [(name, 0.0) for name in first]
    if lexical and lex:
        out.append(("lexical", lex))
    if semantic and sem:
        out.append(("semantic", sem))
    return out


def lanes_or_next(shape: str, ready: dict[str, bool]) -> list[tuple[str, float]]:
    """The lanes of a shape that are ready; if none of those with a weight is, those of the next plainer shape."""
    walk = [shape, *(s for s in ("natural_language", "short") if s != shape)]
    for s in walk:
        got = [(name, w) for name, w in lanes(s) if ready.get(name, False)]
        if any(w for _, w in got):
            return got
    return [(name, w) for name, w in lanes(shape) if ready.get(name, False)]


def split_lanes(ready: dict[str, bool]) -> list[str]:
    """Lanes of a query in two parts, prose and a pattern: no exact lane runs on the prose."""
    return [name for name in ("lexical", "semantic", "pattern_definition", "pattern_mention") if ready.get(name, False)]


def split_words(token: str) -> list[str]:
    token = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", token)
    token = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", token)
    return [w for w in re.split(r"[\s_\-./]+", token) if w]


def variants(token: str, most: int = 6) -> list[str]:
    """Other spellings of a token, the first of each kept: snake, kebab, camel, Pascal, upper snake, plural toggled."""
    token = token.lstrip("#")
    ws = [w.lower() for w in split_words(token)]
    if not ws:
        return []
    camel = ws[0] + "".join(w.capitalize() for w in ws[1:])
    made = ["_".join(ws), "-".join(ws), camel, "".join(w.capitalize() for w in ws), "_".join(ws).upper()]
    made += [re.sub(r"([a-z])(\d)", r"\1_\2", "_".join(ws)), token[:-1] if token.endswith("s") else token + "s"]
    return [v for v in dict.fromkeys(made) if v and v != token][:most]


def depth_tier(position: int) -> int:
    """The depth block that a lane position (from 0) falls in."""
    return next((d for d in DEPTHS if position < d), DEPTHS[-1])
