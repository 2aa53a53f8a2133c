"""Text files as evidence rows."""

from __future__ import annotations

import mimetypes
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions that are text, how much of a file is evidence, and how much of a table.
TEXT = ("txt", "md", "log")
MAX_CHARS, MAX_ROWS, MAX_TABLE_CHARS = 120_000, 500, 60_000

# A table's line and what is said of the table.
LINE, HINT = ("[row ", "] ", "=", "; "), ("CSV with columns: ", ". ", " rows parsed. Each line is one record; treat repeated values across rows as the same entity.")

#: Readers of other kinds of file: extension to a function from bytes to text, run where the file is.
#: A kind without a reader is refused; PDF, DOCX and image readers need libraries that aren't part of this one.
READERS: dict[str, Callable[[bytes], str]] = {}


def source_type(filename: str, readers: dict = READERS) -> str:
    """text for what is read as text, a reader's extension, else ValueError."""
    extension = filename.rsplit(".", 1)[-1].lower() if "." in filename else ""
    if extension in readers:
        return extension
    guess = mimetypes.guess_type(filename)[0] or ""
    if extension in TEXT or guess.startswith("text/"):
        return "text"
    raise ValueError(f"unsupported file type: {filename}")


def read_files(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    """source, kind, text, error of each file: text, or what the extension's reader makes of it. Files that can't be read have an error.

    Texts are whole unless max_chars (such as MAX_CHARS) is given.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    readers = dict(READERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    kind = source_type(name, readers)
                    text = content.decode("utf-8", "replace") if kind == "text" else readers[kind](content)
                    rows.append((name, kind, text[:max_chars], None))
                except Exception as error:  # one file's fault
                    rows.append((name, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["source", "kind", "text", "error"])

    return f.mapInPandas(run, "source string, kind string, text string, error string")


def table_texts(rows: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """part, text, hint of a table of strings with _row: a line "[row n] column=value; ..." for each row, without blanks.

    A text has the lines of max_rows rows, so that all rows are in some text and none grows with the table.
    """
    names = [c for c in rows.columns if c != "_row"]
    cell = lambda c: F.when(F.trim(F.col(f"`{c}`")) != "", F.concat(F.lit(c + LINE[2]), F.col(f"`{c}`")))
    line = F.concat(F.lit(LINE[0]), F.col("_row").cast("string"), F.lit(LINE[1]), F.concat_ws(LINE[3], *[cell(c) for c in names]))
    part = F.floor((F.col("_row") - 1) / max_rows).cast("long").alias("part")
    parts = rows.select(part, "_row", line.alias("line")).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("_row", "line"))).alias("lines"))
    said = F.concat(F.lit(f"{HINT[0]}{names}{HINT[1]}"), F.size("lines").cast("string"), F.lit(HINT[2]))
    return parts.select("part", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"), said.alias("hint"))


def table_text(rows: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_TABLE_CHARS) -> DataFrame:
    """text, hint of the first max_rows rows of a table, max_chars of them: what a prompt takes. `table_texts` has all rows."""
    first = table_texts(rows.where(F.col("_row") <= max_rows), max_rows)
    return first.select(F.substring("text", 1, max_chars).alias("text"), "hint")


def read_texts(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    """source, text of each text file; bytes that aren't UTF-8 are replaced. Other kinds of file are left out.

    Texts are whole unless max_chars is given.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    text = F.col("content").cast("string")
    return f.where(kind.isin(*TEXT)).select(F.col("path").alias("source"), (text if max_chars is None else F.substring(text, 1, max_chars)).alias("text"))


def records(rows: DataFrame, source: str) -> DataFrame:
    """record_id (source and the row's number from 1), entity_type and a map of the row's values, from rows with _row."""
    names = [c for c in rows.columns if c != "_row"]
    kind = F.lower(F.trim("entity_type")) if "entity_type" in names else F.lit(None).cast("string")
    raw = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"`{n}`").cast("string"))])
    return rows.select(F.concat(F.lit(f"{source}:"), F.col("_row")).alias("record_id"), F.coalesce(F.when(kind != "", kind), F.lit("unknown")).alias("entity_type"), raw.alias("raw"))
