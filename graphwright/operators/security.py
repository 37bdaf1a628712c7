"""Scans of texts for attempts at injection and for secrets."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes of threats and their patterns.
PATTERNS = {
    "prompt_injection": [
        r"(?i)(ignore|disregard|forget)\s+(previous|all|above|prior)\s+(instructions?|rules?|prompts?)",
        r"(?i)you\s+are\s+now\s+",
        r"(?i)system\s*:\s*",
    ],
    "command_injection": [
        r";\s*(rm\s+-rf|del\s+/s|format\s+:|shutdown|reboot|chmod\s+777|chown\s+root)",
        r"\|\s*(bash|sh|zsh|cmd|powershell)\s+-c\s*['\"]",
        r"\$\(['\"]\s*(rm|del|format|curl|wget)",
    ],
    "data_exfiltration": [
        r"(?i)(curl|wget)\s+(-d|--data|-F|--form)\s+.*['\"]?(password|secret|token|key|credential)",
        r"(?i)(upload|send|transmit|exfil)\s+.*\s+(password|secret|token|api[_-]?key)",
    ],
    "path_traversal": [
        r"\.\./\.\./\.\./",
        r"/etc/(passwd|shadow|hosts)",
    ],
    "credential_exposure": [
        r"(?i)(api[_-]?key|password|secret|token)\s*=\s*['\"][a-zA-Z0-9]{20,}['\"]",
    ],
}
ZERO_WIDTH = r"[\u200b-\u200f\u2028-\u202f\u205f-\u206f\ufeff]"


def group(pattern: str) -> int:
    """The group that a pattern's match shows: the first, or the whole of it if it has none."""
    return min(1, re.compile(pattern).groups)


def normalise(text: Column) -> Column:
    """NFC, without zero-width characters, every run of white space one blank, trimmed. ASCII texts skip the NFC function's work."""

    def compose(column: pd.Series) -> pd.Series:
        return column.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    compose.__annotations__ = {"column": pd.Series, "return": pd.Series}
    composed = F.pandas_udf(compose, "string")(text)
    return F.trim(F.regexp_replace(F.regexp_replace(composed, ZERO_WIDTH, ""), "\\s+", " "))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", normalised: bool = True) -> DataFrame:
    """(id, threat_type, pattern, match): the first match of each pattern in each text.

    All patterns are tried in one pass over a text; rows without a match never leave it. Patterns always run; a review by other means can follow.
    """
    text = normalise(F.col(text_column)) if normalised else F.col(text_column)
    tries = F.array(*[F.struct(F.lit(kind).alias("threat_type"), F.lit(i).alias("pattern"), F.regexp_extract(F.col("_text"), p, group(p)).alias("match")) for kind, patterns in PATTERNS.items() for i, p in enumerate(patterns)])
    rows = docs.select(F.col(id_column).alias("id"), text.alias("_text"))
    return rows.select("id", F.explode(F.filter(tries, lambda x: x["match"] != "")).alias("x")).select("id", "x.*")


def check(docs: DataFrame, review=None, skip: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_threats, threats, passed) of every text: one without a match passes; one with a match passes only if the review says so.

    review: a function of texts and threats (a pandas Series each) to whether they are safe, called in batches of texts with a match only. Without one, or where it gives no answer
    or fails, such a text doesn't pass. `skip` passes everything unlooked at.
    """
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    if skip:
        return texts.select("id", F.lit(0).cast("long").alias("n_threats"), F.array().cast("array<string>").alias("threats"), F.lit(True).alias("passed"))
    found = scan(docs, id_column, text_column).groupBy("id").agg(F.count("*").alias("n_threats"), F.array_sort(F.collect_set("threat_type")).alias("threats"))
    rows = texts.join(found, "id", "left").withColumns({"n_threats": F.coalesce("n_threats", F.lit(0)), "threats": F.coalesce("threats", F.array().cast("array<string>"))})
    clean = F.col("n_threats") == 0
    if review is None:
        return rows.select("id", "n_threats", "threats", clean.alias("passed"))

    def batch(text: pd.Series, threats: pd.Series) -> pd.Series:
        out = pd.Series(False, index=text.index)
        some = threats.map(len) > 0
        if some.any():
            try:
                out[some] = [bool(x) if x is not None else False for x in review(text[some], threats[some])]
            except Exception:  # noqa: BLE001  a review that fails lets nothing pass
                pass
        return out

    batch.__annotations__ = {"text": pd.Series, "threats": pd.Series, "return": pd.Series}
    return rows.select("id", "n_threats", "threats", (clean | F.pandas_udf(batch, "boolean")("text", "threats")).alias("passed"))


def audit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shown: int = 50) -> DataFrame:
    """(id, threat_type, match): what an audit of documents shows of each, the first `shown` characters of a match."""
    return scan(docs, id_column, text_column).select("id", "threat_type", F.substring("match", 1, shown).alias("match"))
