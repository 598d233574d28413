"""Secret handling as column functions: placeholders, every spelling of a key, and redaction."""

from __future__ import annotations

import base64
import json
import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Form of a placeholder, least bytes of a key.
PLACEHOLDER = r"\{\{ck-secret:([A-Za-z0-9][A-Za-z0-9_.-]{0,62})\}\}"
MIN_KEY_BYTES = 16


def placeholders(text: Column) -> Column:
    """Labels of the well-formed placeholders, in order."""
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1))


def admissible(key: Column) -> Column:
    return F.octet_length(key) >= MIN_KEY_BYTES


def spellings(key: str) -> list[str]:
    """Patterns of a key's raw, base64 (three offsets), percent, hex and JSON spellings."""
    raw = key.encode()
    if len(raw) < MIN_KEY_BYTES:
        raise ValueError(f"a key has at least {MIN_KEY_BYTES} bytes")
    out = [re.escape(key)]
    for url_safe in (False, True):
        for offset in range(3):
            code = (base64.urlsafe_b64encode if url_safe else base64.b64encode)(b"\0" * offset + raw).decode().rstrip("=")
            # Only characters that the key alone decides.
            first = -(-offset * 8 // 6)
            last = (offset + len(raw)) * 8 // 6
            out.append(re.escape(code[first:last]))
    out.append("(?i:" + raw.hex() + ")")
    out.append("".join(f"(?:{re.escape(quote(chr(b), safe=''))}|(?i:%{b:02x}))" for b in raw))
    out.append(re.escape(json.dumps(key)[1:-1]))
    return list(dict.fromkeys(out))


def scrub(text: Column, key: str, label: str) -> Column:
    """``text`` with every spelling of ``key`` replaced by its placeholder."""
    pattern = "|".join(sorted(spellings(key), key=len, reverse=True)).replace("\\-", "-")
    return F.regexp_replace(text, pattern, "{{ck-secret:" + label + "}}")


def redact_tokens(text: Column, pattern: str = r"[0-9a-f]{40}", mark: str = "<redacted>") -> Column:
    return F.regexp_replace(text, pattern, mark)


def redirect_verdicts(chains, rules: list[tuple[str, str]]):
    """(chain, hop, url, allowed) of chains (chain, hops): each hop is judged anew, and after a refused one none is."""
    from pyspark.sql import Window

    from .urls import covers

    ok = F.lit(False)
    for host, path in rules:
        ok = ok | covers(host, path, F.col("url"))
    hops = chains.select("chain", F.posexplode("hops").alias("hop", "url")).withColumn("ok", ok)
    w = Window.partitionBy("chain").orderBy("hop").rowsBetween(Window.unboundedPreceding, 0)
    return hops.withColumn("allowed", F.min("ok").over(w)).drop("ok")


def audit_lines(records, key: str):
    """(line) with each record as JSON; a record that holds the key in any spelling is left out."""
    line = F.to_json(F.struct(*records.columns))
    return records.select(line.alias("line")).where(~F.col("line").rlike("|".join(spellings(key))))
