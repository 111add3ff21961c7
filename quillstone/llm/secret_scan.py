"""Secret scans over an incremental ledger of blobs: each content is scanned once per rule version."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import Stage, arrow_map, as_struct, broadcast_if_small, from_struct

#: Raise it when a rule changes: contents scanned under another version are scanned anew.
RULE_VERSION = 4

_KEYWORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
#: Kind, pattern, the group whose length counts, least length; in the order of kinds in a digest. A run of a class is
#: matched whole, so that a least length in the pattern drops the same matches as one tested afterwards.
RULES: list[tuple[str, str, int, int]] = [
    ("assign", rf"({_KEYWORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1),
    ("platform", r"\bgh[pousr]_[A-Za-z0-9]{36,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|\bAIza[A-Za-z0-9_-]{35}|\bsk_(?:live|test)_[A-Za-z0-9]{16,}", 0, 1),
    ("jwt", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?=(\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+))", 1, 1),
    ("url_password", r"(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]*+://[^\s/:@]++:[^\s/:@]++@)", 1, 1),
]
#: Where a token starts in the first run that the jwt rule finds.
_TOKEN = re.compile(r"\beyJ(?=[A-Za-z0-9_-]{8})")
BASE = ("assign", "access", "hex")
_COMPILED = [(kind, re.compile(p), group, least) for kind, p, group, least in RULES]
#: What a text must hold for any rule to match: one of these strings in lower case, or a run of 24 hex digits. A text
#: without is known clean before any Python runs.
SCREEN = [*"password passwd secret token apikey api_key akia ghp_ gho_ ghu_ ghs_ ghr_ xox aiza sk_live_ sk_test_ eyj ://".split(), "private key"]


def screened(text: Column) -> Column:
    low = F.lower(text)
    found = text.rlike("[0-9a-f]{24}")
    for x in SCREEN:
        found = found | low.contains(x)
    return found


def _matches(kind: str, pattern: re.Pattern, group: int, least: int, text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in pattern.finditer(text):
        if kind == "jwt":  # a run is read once, however often it could start a token
            if m.start() >= last and (t := _TOKEN.search(text, m.start(), m.end())):
                last = m.end(group)
                yield t.start(), last
        elif m.end(group) - m.start(group) >= least:
            yield (m.start(group) if kind == "url_password" else m.start()), m.end()


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) in code points, by start and then kind; in time linear in the text's length."""
    return sorted((a, k, b) for k, rule in enumerate(_COMPILED) for a, b in _matches(*rule, text))


def joined(spans: list[tuple[int, int, int]], names: list[str]) -> str:
    return ",".join([f"{names[k]}:{a}:{b}" for a, k, b in spans])


def _scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    names, out = [r[0] for r in RULES], []
    for blob, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        s = spans_of(text or "")
        base = [x for x in s if x[1] < len(BASE)]
        n = [sum(k == i for _, k, _ in base) for i in range(len(BASE))]
        out.append((blob, *n, hashlib.sha256(joined(base, names).encode()).hexdigest(), joined(s, names)))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


_FINDINGS = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
#: What a text without a finding has.
CLEAN = {"n_assign": 0, "n_access": 0, "n_hex": 0, "base_sha256": hashlib.sha256(b"").hexdigest(), "spans": ""}


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_unseen(spark: SparkSession, versions: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION, blob_col: str = "blob", text_col: str = "text") -> DataFrame:
    """Ledger rows (blob, rule_version, findings) for contents that ``ledger`` lacks under ``rule_version``.

    ``versions`` holds every historical version of every path, contents repeated. Only screened contents come in; each
    blob is scanned once, however many versions have it.
    """
    new = versions.select(F.col(blob_col).alias("blob"), F.col(text_col).alias("text"))
    if ledger is not None:
        new = new.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    once = new.groupBy("blob").agg(F.first("text").alias("text"))
    return arrow_map(once, _scan, _FINDINGS).withColumn("rule_version", F.lit(rule_version))


def secret_scan(
    spark: SparkSession, docs: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(findings per row of ``docs``, new ledger rows to append).

    A row has its id, blob (SHA-256 of the text), n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end in
    code points, end exclusive, by start and then kind). A native screen finds the texts that could match at all;
    their distinct contents that the ledger lacks are scanned, and the findings go back to all rows with the content.
    Contents that the screen clears are clean under every ledger and never stored.

    Texts of any length are scanned whole. A null text is an empty one and clean. A ledger may hold a blob more than once. Repeated rows and null ids are kept, each with its content's findings. An
    empty table gives no rows. Other columns are ignored.
    """
    stage = Stage(spark, "secret-scan")
    rows = docs.select(F.col(id_col).alias("rid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("rid", blob_of(F.col("text")).alias("blob"), F.when(screened(F.col("text")), F.col("text")).alias("text"))
    rows = stage.cut(rows, "screened")
    flagged = rows.where("text is not null")
    new = stage.cut(scan_unseen(spark, flagged, ledger, rule_version), "ledger")
    if ledger is not None:  # two runs at once may have added a blob twice
        held = ledger.where(F.col("rule_version") == rule_version).select(new.columns).dropDuplicates(["blob"])
    known = new if ledger is None else new.unionByName(held)
    hit = flagged.select("rid", "blob").join(known.drop("rule_version"), "blob")
    clean = rows.where("text is null").select("rid", "blob")
    clean = clean.select("*", *[F.lit(v).cast("long" if isinstance(v, int) else "string").alias(k) for k, v in CLEAN.items()])
    return hit.select(clean.columns).unionByName(clean).withColumnRenamed("rid", id_col), new


def redact(spark: SparkSession, docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (overlapping spans by one), n_chars set where there is such a column.

    Findings belong to contents, so they are joined by blob: a row's id, null or repeated, doesn't matter."""
    hits = findings.where("spans <> ''").select("blob", "spans").dropDuplicates(["blob"])
    hits = Stage(spark, "redact").cut(hits, "hits")
    hits = broadcast_if_small(hits, hits.count(), 100_000)
    own, text = as_struct(docs), F.col("_d").getField(text_col)  # docs may have columns of any name
    out = own.withColumn("_blob", blob_of(text)).join(hits, F.col("_blob") == F.col("blob"), "left")
    parts = F.transform(F.split("spans", ","), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("a"), F.split(s, ":")[2].cast("int").alias("b")))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        kept = F.when(span["a"] >= state["at"], F.concat(state["text"], F.substring(text, state["at"] + 1, span["a"] - state["at"]), F.lit(mark))).otherwise(state["text"])
        return F.struct(kept.alias("text"), F.greatest(state["at"], span["b"]).alias("at"))

    clean = F.aggregate(parts, start, step, lambda s: F.concat(s["text"], F.substring(text, s["at"] + 1, F.length(text))))
    out = out.withColumn("_new", F.when(F.col("spans").isNotNull(), clean))
    return from_struct(out, docs, {text_col: F.coalesce("_new", text)} | ({"n_chars": F.coalesce(F.length("_new"), F.col("_d.n_chars"))} if "n_chars" in docs.columns else {}))


def kept_secret_scan(spark: SparkSession, docs: DataFrame, path: str, **options) -> DataFrame:
    """``secret_scan`` with the ledger kept as a table at ``path``: read if it is there, and appended to before the
    findings are returned. A run over contents seen before, under the same rules, scans nothing."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    findings, new = secret_scan(spark, docs, spark.read.parquet(path) if exists else None, **options)
    new.write.mode("append").parquet(path)
    return findings
