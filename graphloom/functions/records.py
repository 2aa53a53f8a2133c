"""Values of extracted records: names, dates, phones, countries, JSON properties, chunks, similarity."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

# Internal properties; date formats, day first; calling code of the default region.
INTERNAL = ("props", "evidence_ids", "label", "created_at", "updated_at")
DATE_FORMATS = ("yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/M/d")
CALLING_CODE = "91"
CHUNK, OVERLAP = 16_000, 500


def person_name(c: Column) -> Column:
    """Blanks collapsed, each word capitalised; two-character initials with a dot in upper case."""
    words = F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    one = lambda w: F.when((F.length(w) == 2) & w.endswith("."), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    return F.array_join(F.transform(words, one), " ")


def date(c: Column) -> Column:
    """An ISO date, read day first in one of DATE_FORMATS, or null."""
    t = F.trim(c)
    return F.date_format(F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS]), "yyyy-MM-dd")


def phone(c: Column, calling_code: str = CALLING_CODE) -> Column:
    """E.164 by rule: 8 to 15 digits after + or 00, else a national number of 10 digits (a 0 before it goes). Otherwise null.

    No numbering plans: the public metadata isn't installed.
    """
    d = F.regexp_replace(c, r"[\s().\-]", "")
    d = F.when(d.startswith("00"), F.concat(F.lit("+"), F.substring(d, 3, 40))).otherwise(d)
    national = F.regexp_replace(d, "^0", "")
    return F.when(d.rlike(r"^\+[1-9]\d{7,14}$"), d).when(national.rlike(r"^[1-9]\d{9}$"), F.concat(F.lit(f"+{calling_code}"), national))


def properties(json: Column, internal: tuple[str, ...] = ()) -> Column:
    """A JSON object as a map of strings without empty values; unreadable text gives an empty map."""
    m = F.coalesce(F.from_json(json, "map<string,string>"), F.expr("map()").cast("map<string,string>"))
    return F.map_filter(m, lambda k, v: v.isNotNull() & ~v.isin("", "[]", "{}", "null") & ~k.isin(*internal, "\0"))


def merged_properties(columns: Column, json: Column) -> Column:
    """Columns and their JSON, which prevails, as one map without the internal names."""
    over = properties(json)
    kept = F.map_filter(columns, lambda k, v: v.isNotNull() & (v != "") & ~F.array_contains(F.map_keys(over), k))
    return F.map_filter(F.map_concat(kept, over), lambda k, _: ~k.isin(*INTERNAL))


def json_object(answer: Column) -> Column:
    """The JSON object in a model's answer: inside a code fence, else from the first { to the last }."""
    fence = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.trim(fence) != "", fence).otherwise(answer)
    return F.when(body.contains("{"), F.regexp_extract(body, r"(?s)(\{.*\})", 1))


def chunks_of(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Slices of a text between line ends, of `size` characters and the rest of the last line.

    A slice begins at the first line end of the last `overlap` characters (an eighth of
    `size` at most) of the one before. Each begins behind the one before, so all texts end.
    """
    if len(text) <= size:
        return [text]
    ends = np.cumsum([0, *map(len, text.splitlines(keepends=True))])
    spans, first = [(0, 0)], 0
    while spans[-1][1] < len(text):
        last = min(int(np.searchsorted(ends, ends[first] + size)), len(ends) - 1)
        spans.append((ends[first], ends[last]))
        first = max(first + 1, int(np.searchsorted(ends, ends[last] - min(overlap, size // 8))))
    return [text[a:b] for a, b in spans[1:]]


def halves(text: str) -> tuple[str, str]:
    """A text cut at the last line end of its first half, else the first one behind, else in the middle: for answers that got too long."""
    middle, breaks = len(text) // 2, [m.start() for m in re.finditer(r"(?!\A)\n", text)]
    cut = max((b for b in breaks if b <= middle), default=min(breaks, default=middle))
    return text[:cut], text[cut:]


@F.pandas_udf(ArrayType(StringType()))
def chunks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: chunks_of(t or ""))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine-integer row at a time."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_sort_similarity(a: str, b: str) -> float:
    """1 less the share of insertions and deletions between the sorted words of both."""
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 2 * _lcs(x, y) / (len(x) + len(y)) if x or y else 1.0


@F.pandas_udf(DoubleType())
def token_sort_ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([token_sort_similarity(x or "", y or "") for x, y in zip(a, b, strict=True)])


def confidence_tone(c: Column) -> Column:
    return F.when(c >= 0.7, "strong").when(c >= 0.35, "moderate").otherwise("weak")


def humanize(c: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(c, "_", " ")))


STAGES = ("parsed", "extracted", "resolved", "written", "enriched")


def stage_index(status: Column) -> Column:
    """Place of a status among the stages from 0, or -1."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STAGES]), status), F.lit(0)).cast("int") - 1


def failed_stage(error: Column) -> Column:
    return F.when(error.contains(":"), F.split_part(error, F.lit(":"), F.lit(1)))
