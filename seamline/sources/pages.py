"""References of web pages: attributes, srcset candidates, inline CSS and links, in document order."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_CSS = re.compile(r"""/\*.*?(?:\*/|\Z)|@import\s+(?:"([^"]*)"|'([^']*)')|url\(\s*(?:"([^"]*)"|'([^']*)'|([^)"'\s]+))\s*\)""", re.S | re.I)
REFERENCE = T.ArrayType(T.StructType([T.StructField("raw", T.StringType()), T.StructField("kind", T.StringType())]))


def css_references(text: str) -> list[str]:
    """Targets of url() and @import, outside comments."""
    return [next(g for g in m.groups() if g is not None) for m in _CSS.finditer(text) if any(g is not None for g in m.groups())]


def srcset_urls(value: str) -> list[str]:
    """URLs of the candidates: white space and commas before, a descriptor after, commas within parentheses kept."""
    out, i, n = [], 0, len(value)
    while i < n:
        while i < n and (value[i].isspace() or value[i] == ","):
            i += 1
        start = i
        while i < n and not value[i].isspace():
            i += 1
        url = value[start:i]
        if not url:
            break
        bare = url.rstrip(",")
        if bare:
            out.append(bare)
        if len(bare) == len(url):
            depth = 0
            while i < n and (value[i] != "," or depth):
                depth += (value[i] == "(") - (value[i] == ")" and depth > 0)
                i += 1
    return out


def html_references(text: str | None) -> list[tuple[str, str]]:
    """(raw, kind) of src, srcset, stylesheet and icon links, inline styles and the first base."""
    out: list[tuple[str, str]] = []
    base = False
    s, at = text or "", 0
    while m := _TAG.search(s, at):
        at = m.end()
        if m[2] is None or m[1]:
            continue
        tag = m[2].lower()
        attrs: dict[str, str] = {}
        for name, value in _ATTR.findall(m[3]):
            attrs.setdefault(name.lower(), html.unescape(value.strip("\"'") if value[:1] in "\"'" else value))
        if tag == "base" and "href" in attrs and not base:
            out.append((attrs["href"], "base"))
            base = True
        if "src" in attrs and tag != "base":
            out.append((attrs["src"], "src"))
        if "srcset" in attrs:
            out += [(u, "srcset") for u in srcset_urls(attrs["srcset"])]
        if tag == "link" and "href" in attrs and {"stylesheet", "icon"} & set(attrs.get("rel", "").lower().split()):
            out.append((attrs["href"], "link"))
        if "style" in attrs:
            out += [(u, "style") for u in css_references(attrs["style"])]
        if tag in ("style", "script"):
            end = re.compile(rf"</{tag}", re.I).search(s, at)
            stop = end.start() if end else len(s)
            if tag == "style":
                out += [(u, "style") for u in css_references(s[at:stop])]
            at = stop
    return out


def references(pages: DataFrame) -> DataFrame:
    """(page_id, pos, raw, kind) of every reference."""

    @F.pandas_udf(REFERENCE)
    def scan(texts):
        return texts.map(lambda t: [{"raw": r, "kind": k} for r, k in html_references(t)])

    return pages.select("page_id", F.posexplode(scan("html")).alias("pos", "r")).select("page_id", "pos", "r.raw", "r.kind")


def links(page: Column) -> Column:
    """Targets of href attributes in double quotes, in order."""
    return F.regexp_extract_all(page, F.lit('href="([^"]*)"'), F.lit(1))


def json_members(doc: Column) -> Column:
    """Top-level member names of a JSON object, null if it isn't one."""
    return F.json_object_keys(doc)


def issue_rows(docs: DataFrame, column: str = "doc") -> DataFrame:
    """(number, title, author, kind, at, by, body) of issue documents in JSON: the issue, then its comments in order."""
    person = "struct<login:string>"
    schema = (
        f"struct<number:bigint,title:string,body:string,createdAt:string,author:{person},"
        f"comments:struct<nodes:array<struct<body:string,createdAt:string,author:{person}>>>>"
    )
    d = docs.select(F.from_json(column, schema).alias("d")).select("d.*")
    first = d.select("number", "title", F.lit(-1).alias("pos"), F.lit("issue").alias("kind"), F.col("createdAt").alias("at"), F.col("author.login").alias("by"), "body")
    later = d.select("number", "title", F.posexplode("comments.nodes").alias("pos", "c")).select(
        "number", "title", "pos", F.lit("comment").alias("kind"), F.col("c.createdAt").alias("at"), F.col("c.author.login").alias("by"), F.col("c.body").alias("body")
    )
    return first.unionByName(later)
