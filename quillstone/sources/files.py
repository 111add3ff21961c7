"""Readers: folders of mixed files, delimited and JSON tables, pages, archives; each a DataFrame with what it couldn't read beside it."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.operators.intake import skip_reason

#: Rows of a table that a reader takes at most (one more is looked at, to say so).
ROW_CAP = 100_000
# Which reader an extension goes to.
READERS = {
    "csv": "csv", "tsv": "tsv", "tab": "tsv", "parquet": "parquet", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "xlsx": "xlsx", "xml": "xml", "nxml": "xml", "html": "html", "htm": "html",
    "txt": "text", "md": "text", "rrf": "pipe", "owl": "owl", "zip": "zip", "pdf": "pdf",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def reader_of(path: Column, content: Column | None = None) -> Column:
    """The reader of a file by extension; one without any is empty (holds NUL), piped (a pipe in its first 4 096 bytes) or text."""
    known = F.create_map(*[F.lit(x) for kv in READERS.items() for x in kv])
    by_ext = F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown"))
    if content is None:
        return by_ext
    head = F.substring(content, 1, 4096)
    sniffed = F.when(F.position(F.lit(b"\x00"), head) > 0, "empty").when(F.position(F.lit(b"|"), head) > 0, "pipe").otherwise("text")
    return F.when(extension(path) == "", sniffed).otherwise(by_ext)


def discover(spark: SparkSession, root: str, folder: str | None = None) -> DataFrame:
    """(path, relative, folder, length, modified, reader, skip_reason) of every file below a root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    base = re.sub(r"^[a-z]+:/+", "/", root.rstrip("/")) + "/"
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + re.escape(base), "")
    files = files.withColumn("relative", relative).withColumn("folder", F.element_at(F.split("relative", "/"), 1))
    files = files.where(~F.col("folder").startswith(".") & (F.col("folder") != "normalized"))
    if folder:
        files = files.where(F.col("folder") == folder)
    return files.withColumns({"reader": reader_of(F.col("path")), "skip_reason": skip_reason(F.col("relative"))})


def read_delimited(
    spark: SparkSession, path: str, sep: str = ",", header: bool = True, cap: int | None = None, encoding: str = "UTF-8", comment: str | None = None, strings: bool = False,
    schema: StructType | None = None, multi_line: bool = True,
) -> DataFrame:
    """Rows of a delimited table: all, or the first ``cap`` if the caller sets one (ROW_CAP is a common choice). Without
    ``multi_line`` no field may hold a line end, and a large file is many tasks' work."""
    r = spark.read.option("sep", sep).option("header", header).option("encoding", encoding).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("inferSchema", not strings and schema is None)
    if comment:
        r = r.option("comment", comment)
    df = (r.schema(schema) if schema else r).csv(path)
    return df if cap is None else df.limit(cap)


def truncated(df_all: DataFrame, cap: int = ROW_CAP) -> bool:
    """Whether a table has more rows than the cap; looks at one more only."""
    return df_all.limit(cap + 1).count() > cap


def read_pipes(spark: SparkSession, path: str, names: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """Pipe-delimited rows without a header; the empty field after the last pipe goes. Every column is a string."""
    rows = spark.read.text(path).where("value <> ''").withColumn("f", F.split("value", r"\|"))
    rows = rows.withColumn("f", F.when(F.col("value").endswith("|"), F.slice("f", 1, F.size("f") - 1)).otherwise(F.col("f")))
    rows = rows if cap is None else rows.limit(cap)
    if names is None:
        return rows.select(F.col("f").alias("fields"))
    return rows.select(*[F.try_element_at("f", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines); with ``strict`` one broken line fails the read. Blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path), lines.limit(0)
    kind = schema if isinstance(schema, str) else schema.simpleString()
    parsed = lines.withColumn("_p", F.from_json("value", kind if not kind.startswith("struct<") else schema, {"mode": "PERMISSIVE"})).withColumn("_bad", F.try_parse_json("value").isNull())
    return parsed.where("not _bad").select("_p.*"), parsed.where("_bad").select("value")


def read_json_documents(spark: SparkSession, path: str, strings_only: bool = False) -> DataFrame:
    """(path, title, abstract, body): whole JSON files, with the first title and abstract that are there; numbers count as
    texts, unless ``strings_only``."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"), F.try_parse_json("value").alias("v"))

    def one(key: str) -> Column:
        value = F.try_variant_get("v", f"$.{key}", "string")
        return F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{key}", "variant")) == "STRING", value) if strings_only else value

    first = lambda *keys: F.coalesce(*[one(k) for k in keys])
    return docs.select("path", first("title", "Title", "TITLE").alias("title"), first("abstract", "Abstract", "abstractText", "ABSTRACT").alias("abstract"), "body")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, text): the title is the first line that isn't empty, without # marks, at most 200 characters."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    line = F.regexp_extract("text", r"^\s*([^\n]*)", 1)
    return docs.select("path", F.trim(F.substring(F.regexp_replace(line, r"^#+\s*", ""), 1, 200)).alias("title"), "text")


def read_array_rows(spark: SparkSession, path: str) -> DataFrame:
    """(fields): rows of a giant JSON that has one array a line; broken rows are left out."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r",\s*$", "").alias("value")).where(F.col("value").startswith("["))
    return lines.select(F.from_json("value", "array<string>").alias("fields")).where("fields is not null")


def read_owl_lines(spark: SparkSession, path: str) -> DataFrame:
    """(kind, n): functional-syntax lines by what they declare."""
    v = F.trim("value")
    kind = F.when(v.startswith("Prefix("), "prefix").when(v.startswith("Ontology("), "ontology").when(v.startswith("Declaration("), "declaration").when(v.startswith("AnnotationAssertion("), "annotation").when(v.startswith("SubClassOf("), "subclass").otherwise("other")
    return spark.read.text(path).where(v != "").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def read_owl_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, declarations, annotations, lines) of each ontology, in functional syntax or RDF/XML, counted line by line: what it
    declares under a name, and its labels, comments and definitions."""
    v = F.trim("value")
    functional = v.startswith("Prefix(") | v.startswith("Ontology(") | v.startswith("Declaration(")
    declared = v.startswith("Declaration(") | v.rlike(r"<owl:(Class|ObjectProperty|DatatypeProperty|AnnotationProperty|NamedIndividual)\b[^>]*\brdf:(about|ID)=")
    annotated = v.startswith("AnnotationAssertion(") | v.rlike(r"<(rdfs:label|rdfs:comment|skos:definition)\b")
    lines = spark.read.text(path).where(v != "").select(F.col("_metadata.file_path").alias("path"), functional.alias("f"), declared.alias("d"), annotated.alias("a"))
    kind = F.when(F.max("f"), "functional").otherwise("rdf/xml")
    return lines.groupBy("path").agg(kind.alias("format"), F.count_if("d").alias("declarations"), F.count_if("a").alias("annotations"), F.count(F.lit(1)).alias("lines"))


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


_SHEETS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def xlsx_rows(blob: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of a workbook, out of the package's XML."""
    ns = _SHEETS
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            for i, row in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{ns}row")):
                cells = []
                for c in row.iter(f"{ns}c"):
                    v = c.find(f"{ns}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{ns}t"))
                    cells.append((shared[int(v.text)] if c.get("t") == "s" else v.text or "").strip() if v is not None else inline.strip())
                yield name.split("/")[-1][:-4], i, cells


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells, error): every sheet's rows as strings; a workbook that can't be read is one row with what is wrong."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, b in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(p, *r, None) for r in xlsx_rows(b)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, OSError, zlib.error) as e:
                    rows = [(p, None, None, None, f"XLSX parse error: {e}")]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells", "error"])

    return _binary(spark, path).mapInPandas(f, "path string, sheet string, row int, cells array<string>, error string")


def read_archive_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size, error) of the members of ZIP files; one that can't be read is one row with what is wrong."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, b in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(p, i.filename, i.file_size, None) for i in zipfile.ZipFile(io.BytesIO(b)).infolist()]
                except (zipfile.BadZipFile, OSError, ValueError) as e:
                    rows = [(p, None, None, f"ZIP parse error: {e}")]
                yield pd.DataFrame(rows, columns=["path", "name", "size", "error"]).astype({"size": "Int64"})

    return _binary(spark, path).mapInPandas(f, "path string, name string, size long, error string")


def read_xml_records(spark: SparkSession, path: str, tag: str, schema: StructType | None = None, most: int | None = None) -> DataFrame:
    """One row per element ``tag``, whatever its namespace, streamed by the built-in reader; attributes are _name, text is _VALUE, repeated
    children are arrays. ``most`` is a caller's limit of rows, None for all."""
    r = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True)
    rows = (r.schema(schema) if schema else r).load(path)
    return rows if most is None else rows.limit(most)


def _article(content: bytes) -> tuple[str | None, str | None, str | None, str | None]:
    """Title, abstract, body and error of an XML document; only articles have the first two, other documents are body as a whole."""
    try:
        root = ElementTree.fromstring(content)
    except (ElementTree.ParseError, ValueError, LookupError) as e:
        return None, None, None, f"XML parse error: {e}"
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rsplit("}", 1)[-1]
    words = lambda e: " ".join("".join(e.itertext()).split())
    texts = lambda e: "\n".join(t for t in (" ".join(x.split()) for x in e.itertext()) if t)
    if root.tag != "article":
        return None, None, texts(root), None
    title, abstract, body = (root.find(at) for at in ("front/article-meta/title-group/article-title", "front/article-meta/abstract", "body"))
    said = [] if abstract is None else [words(p) for p in abstract.iter("p")] or [words(abstract)]
    return title is not None and words(title) or None, " ".join(x for x in said if x) or None, texts(root if body is None else body), None


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, abstract, body, error) of whole XML files: an article's title, its abstract's paragraphs and its body's texts in
    order, a line each; the file's name where there is no title. Broken files have an error only."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, *_article(bytes(c))) for p, c in zip(batch["path"], batch["content"], strict=True)], columns=["path", "title", "abstract", "body", "error"])

    found = _binary(spark, path).mapInPandas(f, "path string, title string, abstract string, body string, error string")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return found.withColumn("title", F.when(F.col("error").isNull(), F.coalesce("title", name)))


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, table, row, cells) of the tables of pages."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, h in zip(batch["id"], batch["html"], strict=True):
                p = _Tables()
                p.feed(h or "")
                out += [(i, t, r, cells) for t, rows in enumerate(p.tables) for r, cells in enumerate(rows)]
            yield pd.DataFrame(out, columns=["id", "table", "row", "cells"])

    return pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html")).mapInPandas(f, "id string, table int, row int, cells array<string>")
