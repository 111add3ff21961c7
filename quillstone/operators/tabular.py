"""Tables of documents: fields by header, rows said as sentences, measurements found in cells, chunks put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.expressions import clean_null, let, token_estimate
from quillstone.operators.chunking import chunk_bodies

#: Estimated tokens from which a generic sentence is cut, and a body with said tables counts as their dump; bytes of a body
#: above which a document isn't chunked.
LONGEST, DENSE, LARGEST = 500, 800, 50 * 1024 * 1024
# Categories whose tables are said row by row.
SAID = ["lab_reference", "drug", "disease", "guideline", "textbook", "research_paper"]
CHUNK = "doc_id string, chunk_id string, chunk_type string, text string, tokens int, page int"


def present(value: Column) -> Column:
    """A cell that says something, else null."""
    return let(value, lambda v: F.nullif(clean_null(v), F.lit("")))


def field(headers: Column, cells: Column, *names: str) -> Column:
    """The cell under the first of some headers that says something. Of repeated headers the last counts; ragged rows are read
    as far as they go."""
    own = F.slice(headers, 1, F.least(F.size(headers), F.size(cells)))

    def one(name: str) -> Column:
        at = F.array_position(F.reverse(own), name)
        return F.when(at > 0, present(F.get(cells, (F.size(own) - at).cast("int"))))

    return F.coalesce(*[one(n) for n in names])


def fields(headers: Column, cells: Column, names: list[str]) -> Column:
    """A struct of ``field`` for each name, f0, f1 and so on: the headers are turned round once for all."""

    def each(r: Column) -> Column:
        at = lambda name: F.array_position(r["h"], name)
        return F.struct(*[F.when(at(n) > 0, present(F.get(r["c"], (F.size(r["h"]) - at(n)).cast("int")))).alias(f"f{i}") for i, n in enumerate(names)])

    own = F.slice(headers, 1, F.least(F.size(headers), F.size(cells)))
    return let(F.struct(F.reverse(own).alias("h"), cells.alias("c")), each)


def joined(sep: str, *parts: Column) -> Column:
    """The parts that aren't null, joined; null if there is none."""
    return let(F.concat_ws(sep, *parts), lambda s: F.nullif(s, F.lit("")))


def _with(prefix: str, *parts: Column) -> Column:
    """``prefix`` and the parts, spaced; null without the first of them."""
    return F.when(parts[0].isNotNull(), F.concat(F.lit(prefix), F.concat_ws(" ", *parts)))


def said_critical(headers: Column, cells: Column) -> Column:
    """A row of a table of critical values as a sentence; null without a test's name or any bound."""
    names = ["Normal Low", "Normal High", "Unit", "Category", "Specimen", "Critical Low", "Critical High", "Age Group", "Gender", "Test Name", "Clinical Interpretation"]

    def said(r: Column) -> Column:
        low, high, unit, category, specimen, critical_low, critical_high, age, gender, test, means = (r[f"f{i}"] for i in range(len(names)))
        both = F.when(high.isNotNull(), F.concat(F.lit("normal range "), low, F.lit("–"), F.concat_ws(" ", high, unit)))
        normal = F.coalesce(both, _with("normal low ", low, unit), _with("normal high ", high, unit))
        bounds = joined("; ", normal, _with("critical low ", critical_low, unit), _with("critical high ", critical_high, unit))
        head = F.concat(test, F.coalesce(F.concat(F.lit(" ("), joined(", ", category, specimen), F.lit(")")), F.lit("")))
        rest = let(bounds, lambda b: F.when(b.isNotNull(), F.concat_ws("; ", b, F.concat(F.lit("for "), joined(", ", age, gender)))))
        return F.concat(head, F.lit(": "), rest, F.lit("."), F.coalesce(F.concat(F.lit(" "), means), F.lit("")))

    return let(fields(headers, cells, names), said)


def said_loinc(headers: Column, cells: Column) -> Column:
    """A row of a table of reference intervals as a sentence; null without a test's name or anything to say of it."""
    names = [
        "Specimen", "Gender-specific", "Age group-specific", "Women-related condition", "Other condition", "LOINC", "Lab Test", "SI Units", "SI Reference Interval", "Types of reference range",
        "Traditional Reference Interval", "Traditional Units",
    ]

    def said(r: Column) -> Column:
        specimen, gender, age, women, other, loinc, test, si_units, si_interval, kind, interval, units = (r[f"f{i}"] for i in range(len(names)))
        code = F.coalesce(F.concat(F.lit(" (LOINC: "), loinc, F.lit(")")), F.lit(""))
        head = F.concat(test, code, F.coalesce(F.concat(F.lit(" ("), joined(", ", specimen, gender, age, F.coalesce(women, other)), F.lit(")")), F.lit("")))
        si = F.when(si_units.isNotNull(), _with("SI interval ", si_interval, si_units))
        says = joined("; ", _with("reference type: ", kind), _with("reference interval ", interval, units), si)
        return F.concat(head, F.lit(": "), says, F.lit("."))

    return let(fields(headers, cells, names), said)


def said_generic(headers: Column, cells: Column, most: int = LONGEST) -> Column:
    """``header: cell`` of the cells that say something, two at least; cut at ``most`` estimated tokens."""
    n = F.least(F.size(headers), F.size(cells))
    pairs = F.zip_with(F.slice(headers, 1, n), F.slice(cells, 1, n), lambda h, c: F.when((h != "") & ~h.contains("Unnamed") & ~h.contains("CID"), F.concat(h, F.lit(": "), present(c))))
    kept = F.array_compact(pairs)

    def cut(s: Column) -> Column:
        return F.when(token_estimate(s) > most, F.concat(F.array_join(F.slice(F.split(s, r"\s+"), 1, int(most / 1.3)), " "), F.lit("…"))).otherwise(s)

    return let(kept, lambda k: F.when(F.size(k) >= 2, let(F.concat(F.array_join(k, "; "), F.lit(".")), cut)))


def said_row(headers: Column, cells: Column) -> Column:
    """By its headers: critical values, reference intervals, or any other table."""
    has = lambda h: F.array_contains(headers, h)
    return F.when(has("Critical Low") | has("Critical High"), said_critical(headers, cells)).when(has("LOINC") & has("Traditional Reference Interval"), said_loinc(headers, cells)).otherwise(said_generic(headers, cells))


def said_tables(tables: DataFrame) -> DataFrame:
    """(doc_id, table, n, text, tokens) of each row of (doc_id, table, headers, rows): text null where a row says too little."""
    rows = tables.where((F.size("headers") > 0) & (F.size("rows") > 0)).select("doc_id", "table", "headers", F.posexplode("rows").alias("n", "cells"))
    said = rows.select("doc_id", "table", "n", said_row(F.col("headers"), F.col("cells")).alias("text"))
    return said.withColumn("tokens", F.when(F.col("text").isNotNull(), token_estimate(F.col("text"))))


def said_counts(said: DataFrame) -> DataFrame:
    """(doc_id, table, chunks, skipped) of ``said_tables``."""
    return said.groupBy("doc_id", "table").agg(F.count("text").alias("chunks"), F.count_if(F.col("text").isNull()).alias("skipped"))


def branches(docs: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds to (doc_id, category, abstract, body, figures): too_large, said (rows said) and chunk_body, what of a document becomes chunks.

    A lab reference whose rows are said has its body left out if that is their dump, by its length."""
    said = said_counts(said_tables(tables)).groupBy("doc_id").agg(F.sum("chunks").alias("_said"))
    out = docs.join(said, "doc_id", "left")
    size = F.octet_length(F.coalesce("body", F.lit("")))
    rows = F.when(F.col("category").isin(SAID), F.coalesce("_said", F.lit(0))).otherwise(0)
    out = out.withColumn("too_large", size > LARGEST).withColumn("said", F.when(F.col("too_large"), 0).otherwise(rows)).drop("_said")
    dump = (F.col("said") > 0) & (F.col("category") == "lab_reference") & (token_estimate(F.col("body")) > DENSE)
    return out.withColumn("chunk_body", ~F.col("too_large") & (F.trim(F.coalesce("body", F.lit(""))) != "") & ~dump)


def document_chunks(docs: DataFrame, tables: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, chunk_id, chunk_type, text, tokens, page, and the document's own ``keep``): abstract, said rows, body, figures.

    ``docs`` has doc_id, category, abstract, body and figures (an array of (ocr_text, page_number))."""
    b = branches(docs, tables).where("not too_large")
    i = F.col("doc_id").cast("string")
    none = F.lit(None).cast("int")
    part = lambda df, key, kind, text, page=none: df.select(
        "doc_id", F.concat(i, F.lit("__"), key).alias("chunk_id"), F.lit(kind).alias("chunk_type"), text.alias("text"), token_estimate(text).alias("tokens"), page.alias("page")
    )
    abstract = part(b.where(F.trim(F.coalesce("abstract", F.lit(""))) != ""), F.lit("abs"), "abstract", F.trim("abstract"))
    said = said_tables(tables).where("text is not null").join(b.where("said > 0").select("doc_id"), "doc_id", "left_semi")
    rows = part(said, F.concat_ws("_", F.concat(F.lit("row"), F.col("n").cast("string")), F.nullif(F.col("table").cast("string"), F.lit("0"))), "structured_row", F.col("text"))
    body = chunk_bodies(b.where("chunk_body"), "doc_id", "body").select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "chunk_id", F.lit("body").alias("chunk_type"), "text", "tokens", none.alias("page"))
    seen = b.select("doc_id", F.posexplode("figures").alias("n", "f")).withColumn("ocr", F.trim(F.coalesce("f.ocr_text", F.lit("")))).where("ocr <> ''")
    figures = part(seen, F.concat(F.lit("fig"), F.col("n").cast("string")), "figure", F.col("ocr"), F.col("f.page_number"))
    out = reduce(DataFrame.unionByName, [abstract, rows, body, figures])
    return out.join(docs.select("doc_id", *keep), "doc_id") if keep else out


# ---------------------------------------------------------------- measurements in cells and texts

NUMBER = r"^[+-]?[0-9]+(?:\.[0-9]+)?$"


def is_header(cells: Column) -> Column:
    """Whether a row names columns: it holds ``test name``, or ``reference range``, or both ``result`` and ``unit``."""
    row = F.lower(F.array_join(cells, " ", ""))
    return row.contains("test name") | row.contains("reference range") | (row.contains("result") & row.contains("unit"))


def measured(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Adds test_name, value_text, value, unit, range of rows with a name in the first cell and a number in a later one: the first
    number counts, and the two cells after it. Header rows and rows without go."""
    c = F.transform(F.col(cells), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    later = F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    at = F.array_position(F.transform(later, lambda x: x.rlike(NUMBER)), True)
    found = rows.withColumns({"_c": c, "_at": at}).where(~is_header(F.col(cells)) & (F.size(cells) >= 2) & (F.length(F.get("_c", F.lit(0))) >= 2) & (F.col("_at") > 0))
    cell = lambda k: F.coalesce(F.get("_c", (F.col("_at") + k).cast("int")), F.lit(""))
    out = found.withColumns({"test_name": F.get("_c", F.lit(0)), "value_text": cell(0), "value": cell(0).cast("double"), "unit": cell(1), "range": cell(2)})
    return out.drop("_c", "_at")


def range_bounds(text: Column) -> Column:
    """struct(low, high) of a range's text: its first two numbers, one number is the high bound, none is 0 to 9999."""
    return let(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+\.?[0-9]*)"), F.lit(1)),
        lambda n: F.struct(
            F.when(F.size(n) >= 2, F.get(n, F.lit(0)).try_cast("double")).otherwise(0.0).alias("low"),
            F.when(F.size(n) >= 2, F.get(n, F.lit(1)).try_cast("double")).when(F.size(n) == 1, F.get(n, F.lit(0)).try_cast("double")).otherwise(9999.0).alias("high"),
        ),
    )


def report_date(text: Column, default: Column) -> Column:
    """The date after ``Date:``, else the first ISO date, else ``default``."""
    part = lambda p: F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1), F.lit(""))
    return F.coalesce(part(r"(?i)Date[:\s]+([0-9]{4}-[0-9]{2}-[0-9]{2})"), part(r"([0-9]{4}-[0-9]{2}-[0-9]{2})"), default)


def pdf_date(text: Column) -> Column:
    """``D:YYYYMMDD…`` as YYYY-MM-DD; other texts as they are, trimmed; blank ones null."""
    t = F.trim(text)
    return F.nullif(F.regexp_replace(t, r"(?s)^D:([0-9]{4})([0-9]{2})([0-9]{2}).*$", "$1-$2-$3"), F.lit(""))


def listed_strings(text: Column, key: str = "sub_questions", most: int = 5) -> Column:
    """Strings of a JSON object's list: the whole text, else its fenced block, else quoted strings of 10 to 120 characters (two at least)."""
    kind = f"struct<{key}:array<string>>"
    clean = lambda a: F.filter(F.transform(a, lambda s: F.trim(s)), lambda s: s != "")
    whole = F.from_json(text, kind)[key]
    block = F.from_json(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit("")), kind)[key]
    quoted = F.transform(F.regexp_extract_all(text, F.lit(r'"([^"\n\r]{10,120})"'), F.lit(1)), lambda s: F.trim(s))
    quoted = F.filter(quoted, lambda s: ~F.lower(s).startswith(key) & (F.length(s) > 10))
    none = F.array().cast("array<string>")
    return F.coalesce(F.slice(clean(whole), 1, most), F.slice(clean(block), 1, most), F.when(F.size(quoted) >= 2, F.slice(quoted, 1, most)), none)


def paired(text: Column, pattern: str, names: tuple[str, str]) -> Column:
    """array<struct> of a pattern's two groups, over all its matches: tables inside a printed structure."""
    one = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    return F.zip_with(one(1), one(2), lambda a, b: F.struct(a.alias(names[0]), b.alias(names[1])))
