"""Text functions, as column expressions except where Spark has none (NFKC)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blanks inside a line, and marks that end a sentence.
SPACES = "[ \\t\\x0B\\f\\u00A0\\u2000-\\u200A\\u202F\\u205F\\u3000]+"
SENTENCE_ENDS = "。；！？.!?"


def truncate(s: Column, n: int, trim: bool = True) -> Column:
    t = F.trim(s) if trim else s
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit("...")))


def prefer_filled(*options: Column) -> Column:
    """The first option that is neither null nor blank, or ""."""
    return F.coalesce(*[F.when(F.trim(o) != "", o) for o in options], F.lit(""))


def contains_any(text: Column, markers, ignore_case: bool = False) -> Column:
    text = F.lower(text) if ignore_case else text
    out = F.lit(False)
    for m in markers:
        out = out | text.contains(m.lower() if ignore_case else m)
    return F.coalesce(out, F.lit(False))


def extract_json(raw: Column) -> Column:
    """From the first opening to the last closing brace; {} where there is no such span."""
    return F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit("")), F.lit("{}"))


def strict_true(json: Column, field: str) -> Column:
    """True only for the JSON boolean true; the string "true" and malformed text are false."""
    return F.coalesce(F.get_json_object(json, f"$.{field}") == "true", F.lit(False)) & json.rlike(rf'"{field}"\s*:\s*true\b')


def capture(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean_lines(text: Column, compatibility: bool = True) -> Column:
    """What ``clean`` does inside lines, which is the same for a text and for each of its lines."""
    t = nfkc(text) if compatibility else text
    t = F.regexp_replace(F.regexp_replace(t, "\\r\\n", "\n"), "\\r", "\n")
    t = F.regexp_replace(t, "[\\p{Cntrl}&&[^\\r\\n\\t]]", "")
    return F.regexp_replace(F.regexp_replace(t, SPACES, " "), "(?m)^ +| +$", "")


def clean(text: Column, compatibility: bool = True) -> Column:
    """Line ends to LF, control characters out, runs of blanks in a line to one, blank lines to one.

    compatibility adds NFKC first, for which a vectorised Python function is needed.
    """
    t = F.regexp_replace(clean_lines(text, compatibility), "(\\n\\s*){2,}", "\n\n")
    return F.coalesce(F.btrim(t, F.lit(" \n\t")), F.lit(""))


def sentences(text: Column) -> Column:
    """Text cut after each sentence mark, trimmed, without blank parts."""
    parts = F.split(F.coalesce(text, F.lit("")), f"(?<=[{SENTENCE_ENDS}])")
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" \n\t\r"))), lambda s: s != "")


def token_count(text: Column) -> Column:
    """A deterministic stand-in for a model's tokenizer: half the characters, 1 at least, 0 for none."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 2))).cast("int")


def tokens_by(load: Callable[[], Callable[[list[str]], list[int]]]) -> Callable[[Column], Column]:
    """Token counts by a tokenizer of the caller's: load() gives, once a worker's batch stream, a function
    from texts to their numbers of tokens. Null texts have none."""

    @F.pandas_udf(T.IntegerType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = load()
        for texts in batches:
            yield pd.Series(count([t or "" for t in texts]), dtype="int32")

    return run


def recency(created: Column, as_of: Column) -> Column:
    """Weight by age in whole days of 24 hours."""
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(created)) / 86400)
    return F.when(created.isNull(), 1.0).when(days <= 7, 1.5).when(days <= 90, 1.2).when(days <= 365, 0.8).otherwise(0.3)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits; ideographs one by one."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([\\u4e00-\\u9fa5]|[\\p{L}\\p{N}&&[^\\u4e00-\\u9fa5]]+)"), 1)
