"""Column functions on text: folding, lines, trigrams, masks, markers and cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKERS = ("TODO", "FIXME", "HACK", "XXX", "BUG")


def ascii_fold(c: Column) -> Column:
    """A-Z to a-z only; other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def line_count(c: Column) -> Column:
    """Line feeds plus one, so an empty text has one line."""
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def lines(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """A row for each line: keys, line_no from 1, line."""
    return docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(
        *keys, (F.col("p") + 1).alias("line_no"), "line"
    )


def trigrams(c: Column) -> Column:
    """The distinct folded character trigrams of a short string, empty below three characters."""
    folded = ascii_fold(c)
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(folded, i, F.lit(3)))
    return F.when(F.length(c) >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def positions(c: Column) -> Column:
    """(trigram, next) structs of a short string; next is null at the end."""
    folded = ascii_fold(c)
    grams = F.transform(
        F.sequence(F.lit(1), F.length(c) - 2),
        lambda i: F.struct(
            F.substring(folded, i, F.lit(3)).alias("trigram"), F.nullif(F.substring(folded, i + 3, F.lit(1)), F.lit("")).alias("next")
        ),
    )
    none = F.array().cast("array<struct<trigram:string,next:string>>")
    return F.when(F.length(c) >= 3, grams).otherwise(none)


def next_bit(ch: Column) -> Column:
    """One of eight bits for the character that follows a trigram; none for a null."""
    return F.coalesce(F.call_function("shiftleft", F.lit(1), F.pmod(F.ascii(ch) * 31, F.lit(8)).cast("int")), F.lit(0))


def strip_ansi(c: Column) -> Column:
    """Without terminal control sequences: CSI up to its final byte, and two-byte escapes."""
    return F.regexp_replace(c, "\x1b(\\[[^\\x40-\\x7e]*[\\x40-\\x7e]|[\\x40-\\x5a\\x5c-\\x5f])", "")


def mask_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]+", "#")


def shape_key(c: Column) -> Column:
    """What entries of one shape have in common: digits masked, white space collapsed."""
    return F.trim(F.regexp_replace(mask_digits(c), r"\s+", " "))


def marker_of(line: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """The first marker word in a line, null if none."""
    return F.nullif(F.regexp_extract(line, rf"\b({'|'.join(markers)})\b", 1), F.lit(""))


def marker_text(line: Column, marker: Column, most: int = 200) -> Column:
    """What follows the marker, without a colon, at most ``most`` characters."""
    rest = F.substr(line, F.instr(line, marker) + F.length(marker))
    return F.substring(F.trim(F.regexp_replace(rest, r"^\s*:?", "")), 1, most)


def middle_truncate(c: Column, most: int) -> Column:
    """Head and tail of a text over ``most`` characters, with a marker of what was left out."""
    half = most // 2
    left = F.length(c) - 2 * half
    marked = F.concat(F.substring(c, 1, half), F.lit("...<"), left.cast("string"), F.lit(" chars>..."), F.right(c, F.lit(half)))
    return F.when(F.length(c) > most, marked).otherwise(c)


def snippet(line: Column, needle: str, lead: int = 80, most: int = 240) -> Column:
    """A window on a line, ``lead`` characters before the needle, with ellipses where it is cut."""
    at = F.instr(line, needle)
    start = F.greatest(at - lead, F.lit(1))
    part = F.substr(line, start, F.lit(most))
    return F.concat(
        F.when(start > 1, F.lit("…")).otherwise(F.lit("")), part,
        F.when(start + most <= F.length(line), F.lit("…")).otherwise(F.lit("")),
    )


def words_of(c: Column) -> Column:
    """Lower-case words of an identifier: case boundaries, acronyms, and _ - . / split it."""
    split = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(F.lower(split), r"[_\-./\s]+"), lambda w: w != "")


def word_similarity(a: Column, b: Column) -> Column:
    """Jaccard of word sets in thousandths, rounded down."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0)).otherwise(F.floor(both * 1000 / either)).cast("int")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less edit distance over the longer length, in thousandths, rounded down."""
    longer = F.greatest(F.length(a), F.length(b))
    same = F.floor((longer - F.levenshtein(a, b)) * 1000 / longer)
    return F.when(longer == 0, F.lit(1000)).otherwise(same).cast("int")


def approximate_tokens(c: Column, bytes_per_token: float = 3.5) -> Column:
    return F.ceil(F.octet_length(c) / F.lit(bytes_per_token)).cast("long")


def normalise_path(c: Column) -> Column:
    """Forward slashes, no doubled ones, no ./ parts, no trailing slash."""
    p = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"/(\./)+", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), r"/{2,}", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


#: File extension to language.
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "rs": "rust", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "hpp": "cpp", "cs": "csharp", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "rb": "ruby",
    "php": "php", "lua": "lua", "pl": "perl", "pm": "perl", "swift": "swift", "sh": "bash", "bash": "bash", "html": "html",
    "htm": "html", "css": "css", "scss": "scss", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "md": "markdown", "sql": "sql", "vue": "vue", "zig": "zig", "r": "r", "sol": "solidity",
}


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return known[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def is_data_file(path: Column, text: Column, least_bytes: int = 8192, line_bytes: int = 256) -> Column:
    """JSON-like files that are large or have a long line; package manifests are not."""
    json = F.lower(path).rlike(r"\.(json|jsonl|ndjson|geojson)$")
    manifest = F.regexp_extract(path, "([^/]*)$", 1).isin("package.json", "tsconfig.json", "composer.json", "deno.json")
    big = (F.octet_length(text) >= least_bytes) | F.exists(F.split(text, "\n"), lambda x: F.octet_length(x) >= line_bytes)
    return json & ~manifest & big


def html_decoded(c: Column) -> Column:
    """Character references decoded, in Arrow batches; no built-in function knows their names."""
    import html

    @F.pandas_udf("string")
    def decode(texts):
        return texts.map(html.unescape, na_action="ignore")

    return decode(c)


def xxhash32(c: Column, seed: int = 0) -> Column:
    """xxHash32 of a string's UTF-8 bytes, as a long."""

    @F.pandas_udf("long")
    def tag(texts):
        import xxhash

        return texts.map(lambda t: xxhash.xxh32_intdigest(t.encode(), seed=seed), na_action="ignore")

    return tag(c)


def bpe_tokens(c: Column, ranks_path: str, pattern: str) -> Column:
    """Tokens of a byte-pair vocabulary in a file of ``base64 rank`` lines, after a pre-tokeniser pattern."""

    @F.pandas_udf("long")
    def count(texts):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return texts.map(lambda t: len(encoding.encode_ordinary(t)), na_action="ignore")

    return count(c)
