"""Tables in files of several kinds as records, with an encoding ladder, a row cap, and a dead letter for each file that can't be read."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.files import ROW_CAP, reader_of, xlsx_rows

# Encodings in the order in which they are tried; the last reads any bytes.
ENCODINGS = ("utf-8", "utf-8-sig", "latin-1", "cp1252")
_BROKEN = (ValueError, KeyError, IndexError, OSError, EOFError, NotImplementedError, RuntimeError, zipfile.BadZipFile, zlib.error, ElementTree.ParseError)
_RECORDS = "path string, reader string, part string, n int, record map<string, string>, encoding string, truncated boolean, error string"
_NAMES = [c.split()[0] for c in _RECORDS.replace("map<string, string>", "map").split(", ")]


def decoded_bytes(content: bytes) -> tuple[str, str]:
    """The text of a file's bytes, and the encoding that reads them; a mark at the start goes."""
    for name in ENCODINGS:
        try:
            text = content.decode(name)
        except UnicodeDecodeError:
            continue
        return (text[1:], "utf-8-sig") if text.startswith("﻿") else (text, name)
    return content.decode("utf-8", "replace"), "utf-8"


def _delimited(content: bytes, sep: str, cap: int) -> tuple[list[dict], str, bool]:
    text, encoding = decoded_bytes(content)
    if "\x00" in text:
        raise ValueError("the file holds NUL")
    rows = pd.read_csv(io.StringIO(text), sep=sep, dtype=str, keep_default_na=False, nrows=cap + 1) if text.strip() else pd.DataFrame()
    return rows.head(cap).to_dict("records"), encoding, len(rows) > cap


def _sheets(content: bytes, cap: int) -> Iterator[tuple[str, list[dict], bool]]:
    """Records of each sheet, whose first row has the names."""
    sheets: dict[str, list[list[str]]] = {}
    for sheet, _, cells in xlsx_rows(content):
        held = sheets.setdefault(sheet, [])
        if len(held) <= cap + 1:
            held.append(cells)
    for sheet, (names, *rows) in sheets.items():
        yield sheet, [{k or f"column {i}": v for i, (k, v) in enumerate(zip(names, r, strict=False))} for r in rows[:cap]], len(rows) > cap


def parsed(path: str, reader: str, content: bytes, cap: int) -> list[tuple]:
    """Rows of ``_RECORDS`` of one file: its records, or one row that says why there are none. Members of an archive that are tables are read,
    the others are named; a broken member doesn't hide the others."""
    out: list[tuple] = []

    def add(part: str | None, records: list[dict], encoding: str | None, truncated: bool) -> None:
        out.extend((path, reader, part, i, {str(k): str(v) for k, v in r.items()}, encoding, truncated, None) for i, r in enumerate(records))

    def read(part: str | None, kind: str, blob: bytes) -> None:
        if kind in ("csv", "tsv"):
            add(part, *_delimited(blob, "," if kind == "csv" else "\t", cap))
        elif kind == "xlsx":
            for sheet, records, truncated in _sheets(blob, cap):
                add(sheet if part is None else f"{part}/{sheet}", records, None, truncated)

    try:
        if reader == "zip":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in z.infolist():
                    kind = info.filename.rsplit(".", 1)[-1].lower()
                    try:
                        if kind in ("csv", "tsv", "xlsx"):
                            read(info.filename, kind, z.read(info))
                        elif not info.is_dir():
                            add(info.filename, [{"name": info.filename, "size": info.file_size}], None, False)
                    except _BROKEN as e:
                        out.append((path, reader, info.filename, None, None, None, None, f"{kind.upper()} parse error: {e}"))
        else:
            read(None, reader, content)
    except _BROKEN as e:
        return [(path, reader, None, None, None, None, None, f"{reader.upper()} parse error: {e}")]
    return out


def read_records(spark: SparkSession, path: str, cap: int = ROW_CAP) -> DataFrame:
    """(path, reader, part, n, record, encoding, truncated, error) of all CSV, TSV, XLSX and ZIP files below a path.

    A record maps names to texts; ``part`` is a sheet or an archive's member. Files are read by Spark's own reader, many small
    ones to a task, so any store will do; a task holds one file at a time. A table gives its first ``cap`` rows (a caller's
    limit) and says whether there are more. A file that can't be read is one row with an error and no record. Empty files and
    tables without rows give none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", reader_of(F.col("path")).alias("reader"), "content")
    files = files.where(F.col("reader").isin("csv", "tsv", "xlsx", "zip"))

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, r, b in zip(batch["path"], batch["reader"], batch["content"], strict=True):
                rows = parsed(p, r, b, cap)
                for a in range(0, len(rows), 5000):
                    yield pd.DataFrame(rows[a : a + 5000], columns=_NAMES).astype({"n": "Int32", "truncated": "boolean"})

    return files.mapInPandas(f, _RECORDS)


def dead_letters(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good records, dead letters): the letters are (path, stage, reader, part, error), one for each file or member that failed."""
    bad = records.where("error is not null").select("path", F.lit("parse").alias("stage"), "reader", "part", "error")
    return records.where("error is null").drop("error"), bad
