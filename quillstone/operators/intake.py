"""What comes in: categories and formats of files, texts of any encoding, links, duplicate contents, phases that are done."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes above which a file isn't cut into chunks.
LARGEST = 50 * 1024 * 1024
# Categories of folders, and of folders' formats where they differ.
CATEGORIES = {
    "BioASQ": "evidence_qa",
    "clinical_manuals": "clinical_reference",
    "Clinical_practice_guidlines": "guideline",
    "datasets--openlifescienceai--medmcqa": "qa_benchmark",
    "Disease_knowledge": "disease",
    "Drug_database": "drug",
    "Lab_rev_data": "lab_reference",
    "Medical_books": "textbook",
    "Medical_ontologies": "ontology",
    "MedQA-USMLE": "qa_benchmark",
    "PubMedQA": "qa_benchmark",
    "Research_papers": "research_paper",
    "UMLS Output": "ontology",
}
OVERRIDES = {
    "Research_papers": (["json", "xml", "csv", "pdf"], "research_paper"),
    "Clinical_practice_guidlines": (["json", "csv", "html", "pdf", "jsonl"], "guideline"),
    "BioASQ": (["json"], "evidence_qa"),
    "Disease_knowledge": (["xml"], "disease"),
    "Medical_ontologies": (["txt", "json", "owl"], "ontology"),
    "Drug_database": (["tsv", "xml", "rrf", "txt"], "drug"),
    "Medical_books": (["jsonl", "txt"], "textbook"),
    "Lab_rev_data": (["csv", "txt", "owl", "xlsx"], "lab_reference"),
    "datasets--openlifescienceai--medmcqa": (["parquet"], "qa_benchmark"),
    "MedQA-USMLE": (["parquet"], "qa_benchmark"),
    "PubMedQA": (["parquet"], "qa_benchmark"),
}


# Files that are scaffolding rather than data, in the order in which they are tested.
SKIP_PATHS = (
    "/blobs/", "/refs/", "/.huggingface/", "/snapshots/", "/UMLS Output/LEX/DOCS/", "/UMLS Output/LEX/LEX_PGMS/", "/UMLS Output/LEX/LEX_DB/", "/UMLS Output/LEX/MISC/", "/UMLS Output/LEX/NUMBERS/",
    "/UMLS Output/LEX/VERB_COMPLEMENTS/",
)
SKIP_DIRS = (".cache", ".git", ".huggingface", "__pycache__", "blobs", "refs")
SKIP_EXTENSIONS = (
    ".py", ".pyc", ".sh", ".bat", ".cmd", ".exe", ".dll", ".so", ".dylib", ".o", ".a", ".ipynb", ".sfv", ".crc", ".md5", ".sha1", ".sha256",
    ".sha512", ".sig", ".asc", ".lock", ".toml", ".cfg", ".ini", ".yml", ".yaml", ".css", ".js", ".ts", ".map", ".svg", ".png", ".jpg", ".jpeg",
    ".gif", ".ico", ".webp", ".woff", ".woff2", ".ttf", ".eot", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".ctl", ".xsd", ".dtd", ".sql", ".log",
    ".xslt", ".crlf", ".cff",
)
SKIP_STEMS = ("readme", "license", "licence", "citation")
SKIP_NAMES = (".gitattributes", ".gitignore", ".ds_store", "thumbs.db", "dataset_info.json", "dataset_dict.json", "config.json")
SKIP_METADATA = ("removed_files.csv", "removed_files_20260720_155732.csv", "download_failed.csv", "download_success.csv", "CACHEDIR.TAG")
SKIP_REVIEW = ("open_guidelines.jsonl", "summary.json")


def skip_reason(path: Column) -> Column:
    """Why a file isn't read, null if it is: path pattern, directory, extension, stem, name, metadata, review list."""
    name = F.element_at(F.split(path, "/"), -1)
    parts, extension = F.split(path, "/"), F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))
    stem = F.lower(F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", ""))
    reason = F.when(F.lit(False), F.lit(""))
    for p in SKIP_PATHS:
        reason = reason.when(path.contains(p), f"skip_huggingface:{p}")
    for d in SKIP_DIRS:
        reason = reason.when(F.array_contains(parts, d), f"skip_dir:{d}")
    reason = reason.when(extension.isin(*SKIP_EXTENSIONS), F.concat(F.lit("skip_extension:"), extension))
    reason = reason.when(stem.isin(*SKIP_STEMS), F.concat(F.lit("skip_stem:"), stem)).when(F.lower(name).isin(*SKIP_NAMES), F.concat(F.lit("skip_filename:"), name))
    return reason.when(name.isin(*SKIP_METADATA), F.concat(F.lit("skip_metadata:"), name)).when(name.isin(*SKIP_REVIEW), F.concat(F.lit("skip_review:"), name))


def categorised(spark: SparkSession, files: DataFrame, folder: str = "folder", extension: str = "extension") -> DataFrame:
    """Adds category: of the folder and format if there is one, else of the folder, else ``unknown``. The tables are fixed and small."""
    own = F.broadcast(spark.createDataFrame([(f, e, c) for f, (es, c) in OVERRIDES.items() for e in es], f"{folder} string, {extension} string, _own string"))
    general = F.broadcast(spark.createDataFrame(list(CATEGORIES.items()), f"{folder} string, _general string"))
    out = files.join(own, [folder, extension], "left").join(general, folder, "left")
    return out.withColumn("category", F.coalesce("_own", "_general", F.lit("unknown"))).drop("_own", "_general")


def shown_format(extension: Column, tool: Column) -> Column:
    """The extension; without one, what the tool that read the file says."""
    return F.when(extension != "", extension).when(tool == "csv+pipe", "rrf").when(tool == "text", "txt").otherwise("")


def first_url(text: Column) -> Column:
    """The first http address of a text whose line ends may cut addresses after a hyphen."""
    whole = F.regexp_replace(text, r"-\s*\n\s*", "-")
    return F.nullif(F.regexp_extract(whole, r"(?i)https?://[^\s<>\"'),;\]]+", 0), F.lit(""))


def capitalised(text: Column) -> Column:
    """The first letter in upper case, the others in lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1_000_000_000)))


def decoded(content: Column) -> Column:
    """struct(text, encoding) of a file's bytes: UTF-8 with or without a mark, UTF-16 by its mark, else Latin-1, which reads any bytes."""
    made = lambda text, name: F.struct(text.alias("text"), F.lit(name).alias("encoding"))
    head = F.hex(F.substring(content, 1, 3))
    utf8 = F.decode(content, "UTF-8")
    return (
        F.when(head.startswith("FFFE") | head.startswith("FEFF"), made(F.decode(content, "UTF-16"), "UTF-16"))
        .when((head == "EFBBBF") & F.is_valid_utf8(content.cast("string")), made(F.regexp_replace(utf8, "^﻿", ""), "UTF-8"))
        .when(F.is_valid_utf8(content.cast("string")), made(utf8, "UTF-8"))
        .otherwise(made(F.decode(content, "ISO-8859-1"), "ISO-8859-1"))
    )


def first_contents(df: DataFrame, id_col: str, *parts: str) -> DataFrame:
    """(id, content, copies): for each different content (its parts without case and runs of white space), the first id by code point."""
    clean = [F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(p).cast("string"), F.lit(""))), r"\s+", " ")) for p in parts]
    hashed = df.select(F.col(id_col).cast("string").alias("id"), F.sha2(F.concat_ws("\x1f", *clean), 256).alias("content"))
    return hashed.groupBy("content").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def may_read(user: Column, destination: Column, path_user: Column) -> Column:
    """Whether a user may read a destination: what is global, their own, or a path that is theirs."""
    return F.coalesce((destination == "global") | (destination == user) | (path_user == user), F.lit(False))


def run_phases(spark: SparkSession, root: str, phases: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]]) -> dict[str, DataFrame]:
    """Tables of phases by name, each a function of those before it, written below ``root``; a phase whose table is whole is read, not run
    again. A phase is written beside and renamed when it is done, so one cut short leaves nothing that looks whole."""
    done: dict[str, DataFrame] = {}
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for name, phase in phases:
        to = path(f"{root}/{name}")
        store = to.getFileSystem(conf)
        if not store.exists(path(to, "_SUCCESS")):
            part = path(f"{root}/_{name}-{uuid.uuid4().hex}")
            phase(done).write.parquet(part.toString())
            store.delete(to, True)
            store.rename(part, to)
        done[name] = spark.read.parquet(to.toString())
    return done
