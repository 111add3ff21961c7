"""Texts to chunks: estimates, sentence-aware accumulation with overlap, islands of numeric lines, verbalised rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.expressions import clean_null, sentences

#: Estimated tokens a chunk aims at and needs, share of its last words that the next one begins with, and tokens above which it is told of.
TARGET, LEAST, OVERLAP, HARD_MOST = 500, 300, 0.15, 800
# What marks a sentence with measurements, tables or ranges, which is never put together with others beyond the target.
DENSE = (
    r"(?i)([0-9]+\s*[-–]\s*[0-9]+"
    r"|[0-9]+\.?[0-9]*\s*(?:mg|mL|mcg|µg|IU|mmol|mEq|kg|g|L|dL|µL|U/L|pg|ng|nmol|mmHg|bpm|%|sec|min|ms|ug|meq|mosm|mOsm|mEq/L|g/dL|ng/mL|µmol/L|pmol)\b"
    r"|\bTable\s+[0-9]+|\|\s*\w|[0-9]+\.[0-9]+\s+\w{2,})"
)
_DENSE = re.compile(DENSE)
NUMERIC = r"(?i)[0-9]+(?:\.[0-9]+)?\s*(?:mg|g|kg|ml|l|mmol|umol|µmol|mcg|ng|iu|u|%|mm|cm|bpm)\b|[0-9]+(?:\.[0-9]+)?\s*[-–]\s*[0-9]+"


def estimate(text: str) -> int:
    return max(1, int(len(text.split()) * 1.3))


def accumulate(parts: list[str], target: int = TARGET, least: int = LEAST, overlap: float = OVERLAP) -> list[str]:
    """Sentences gathered until the next would pass the target; a flushed chunk lends its last words to the next.

    A chunk is flushed only from ``least`` on, so it may pass the target before that. A sentence with measurements that
    passes the target by itself is a chunk alone, and what was gathered before it another; neither lends words.
    """
    out: list[str] = []
    held: list[str] = []
    size = fresh = 0
    for s in parts:
        n = estimate(s)
        if n > target and _DENSE.search(s):
            out += [" ".join(held)] * bool(fresh) + [s]
            held, size, fresh = [], 0, 0
            continue
        if held and size + n > target and size >= least:
            chunk = " ".join(held)
            out.append(chunk)
            words = chunk.split()
            tail = words[len(words) - int(len(words) * overlap) :] if int(len(words) * overlap) else []
            held, size, fresh = ([" ".join(tail)], estimate(" ".join(tail)), 0) if tail else ([], 0, 0)
        held.append(s)
        size += n
        fresh += 1
    if fresh:
        out.append(" ".join(held))
    return out


def chunk_bodies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, chunk_id, text, tokens, warning): the chunks of each text, and what is to be said of one above HARD_MOST tokens.
    Sentences are cut natively; the scan over them is per text."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), sentences(F.col(text_col)).alias("parts"))

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, n, c, estimate(c)) for i, parts in zip(batch["id"], batch["parts"], strict=True) for n, c in enumerate(accumulate(list(parts)))]
            yield pd.DataFrame(out, columns=["id", "n", "text", "tokens"])

    chunks = rows.mapInPandas(f, "id string, n int, text string, tokens int")
    warning = F.when(F.col("tokens") > HARD_MOST, F.format_string("chunk %d: %d tokens (numeric block hard-max exceeded, kept atomic)", "n", "tokens"))
    return chunks.select("id", "n", F.concat("id", F.lit("__c"), F.col("n").cast("string")).alias("chunk_id"), "text", "tokens", warning.alias("warning"))


def numeric_islands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, island, first_line, lines): runs of lines that hold measurements; blank lines don't end a run. Each text's lines are
    walked inside its row, so nothing is shuffled."""
    zero = F.struct(F.array().cast("array<struct<first_line:int,lines:bigint>>").alias("runs"), F.lit(False).alias("on"))

    def step(s: Column, x: Column) -> Column:
        last = F.element_at(s["runs"], -1)
        grown = F.concat(F.slice(s["runs"], 1, F.size(s["runs"]) - 1), F.array(F.struct(last["first_line"].alias("first_line"), (last["lines"] + 1).alias("lines"))))
        new = F.concat(s["runs"], F.array(F.struct(x["i"].alias("first_line"), F.lit(1).cast("long").alias("lines"))))
        return F.struct(F.when(x["on"] & s["on"], grown).when(x["on"], new).otherwise(s["runs"]).alias("runs"), x["on"].alias("on"))

    lines = F.filter(F.transform(F.split(text_col, "\n"), lambda t, i: F.struct(i.alias("i"), F.trim(t).alias("t"))), lambda x: x["t"] != "")
    marked = F.transform(lines, lambda x: F.struct(x["i"].alias("i"), x["t"].rlike(NUMERIC).alias("on")))
    runs = F.aggregate(marked, zero, step, lambda s: s["runs"])
    out = docs.where(F.col(text_col).rlike(NUMERIC)).select(F.col(id_col).alias("id"), F.posexplode(runs).alias("n", "run"))
    return out.select("id", (F.col("n") + 1).cast("long").alias("island"), "run.first_line", "run.lines")


def verbalise(fields: list[tuple[str, Column]], least: int = 2, skip: tuple[str, ...] = ("Unnamed", "CID")) -> Column:
    """``name: value`` of the fields that say something, joined by full stops; null with fewer than ``least``."""
    said = [F.when(clean_null(v.cast("string")) != "", F.concat(F.lit(f"{k}: "), clean_null(v.cast("string")))) for k, v in fields if not k.startswith(skip)]
    kept = F.array_compact(F.array(*said))
    return F.when(F.size(kept) >= least, F.concat(F.array_join(kept, ". "), F.lit(".")))
