"""Sequential rules against plain Python, goldens of reports, readers, sinks and streams."""

import json
import random
import re
import time
import zipfile
from collections import Counter

from pyspark.sql import functions as F

from quillstone.functions.expressions import any_of, clean_null, safe_float, sentences, token_estimate
from quillstone.operators.chunking import DENSE, accumulate, chunk_bodies, estimate
from quillstone.operators.dedup import alias_fold, settle
from quillstone.operators.fusion import canonical_id
from quillstone.operators.graph import query_terms
from quillstone.operators.intake import decoded, run_phases
from quillstone.operators.lab import RANGES, assessed, missing_checks, normalised, report_lines, trends
from quillstone.operators.ranking import category_caps, within_budget
from quillstone.operators.tabular import listed_strings, measured, pdf_date, range_bounds, report_date, said_tables
from quillstone.operators.vectors import CellIndex, exact_topk
from quillstone.operators.verification import choice, upper_median, verdict
from quillstone.plans import library
from quillstone.sources import files, sinks
from quillstone.streaming.flows import file_stream, running_trend, to_table


def test_caps_and_budget_are_the_sequential_scans(spark):
    rnd = random.Random(1)
    rows = [(q, i, rnd.choice("abc"), rnd.randint(0, 9), rnd.randint(1, 400)) for q in range(20) for i in range(40)]
    df = spark.createDataFrame(rows, "q long, i long, c string, s long, cost long")
    caps = {"a": 3, "b": 5}
    got = {(r.q, r.i) for r in category_caps(df, "q", "c", [F.desc("s"), F.asc("i")], caps, 30, 12).collect()}
    want = set()
    for q in range(20):
        n, seen = 0, {}
        for _, i, c, s, _ in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1])):
            if n < 12 and seen.get(c, 0) < caps.get(c, 30):
                seen[c] = seen.get(c, 0) + 1
                n += 1
                want.add((q, i))
    assert got == want
    got = {(r.q, r.i) for r in within_budget(df, "q", "i", "cost", 1000, 50, 10).collect()}
    want = set()
    for q in range(20):
        total = 50
        for n, r in enumerate(sorted(r for r in rows if r[0] == q)):
            total += r[4]
            if n >= 10 or (n and total > 1000):
                break
            want.add((q, r[1]))
    assert got == want


def test_hash_or_id_is_the_ordered_scan(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randint(0, 60), rnd.randint(0, 60)) for i in range(150)]
    got = {r.o for r in settle(spark.createDataFrame(rows, "o long, h long, d long"), "h", "d", "o").collect()}
    hashes, ids, want = set(), set(), set()
    for o, h, d in rows:
        if h not in hashes and d not in ids:
            hashes.add(h), ids.add(d), want.add(o)
    assert got == want


def test_alias_fold(spark):
    rows = [("c", "A", 1, 1), ("c", "B", 1, 2), ("c", "D", 3, 3), ("c", "A", 1, 4), ("c", "B", 0, 5)]
    r = alias_fold(spark.createDataFrame(rows, "k string, t string, p int, o long"), "k", "t", "p", "o").first()
    assert (r.term, r.aliases) == ("D", ["B", "A"])


def test_accumulate_keeps_order_and_overlap():
    parts = [" ".join(f"w{i}_{j}" for j in range(40)) + "." for i in range(60)]
    chunks = accumulate(parts)
    assert all(estimate(c) <= 600 for c in chunks) and len(chunks) > 4
    for a, b in zip(chunks, chunks[1:]):
        n = int(len(a.split()) * 0.15)
        assert b.split()[:n] == a.split()[-n:]
    assert accumulate([]) == [] and accumulate(["one."]) == ["one."]


def test_trend_golden(spark):
    """Two reports 94 days apart."""
    first = [("Creatinine", 1.1, "mg/dL"), ("Hemoglobin A1c", 6.9, "%"), ("Potassium", 4.2, "mmol/L"), ("Sodium", 140.0, "mmol/L"), ("Glucose", 110.0, "mg/dL")]
    second = [("Creatinine", 1.9, "mg/dL"), ("Hemoglobin A1c", 7.8, "%"), ("Potassium", 4.3, "mmol/L"), ("Sodium", 139.0, "mmol/L"), ("Glucose", 145.0, "mg/dL")]
    rows = [(1, "2026-05-10", i, *t) for i, t in enumerate(first)] + [(1, "2026-08-12", 10 + i, *t) for i, t in enumerate(second)]
    v = normalised(spark, spark.createDataFrame(rows, "user_id long, day string, ord long, test_name string, value double, unit string"))
    ranges = spark.createDataFrame(RANGES, "canonical string, ref_low double, ref_high double, c_low double, c_high double").drop("c_low", "c_high")
    t = trends(v.join(ranges, "canonical", "left").withColumn("critical", F.lit(False)), "user_id", "canonical", "value_norm", "day", "ord")
    got = {r.canonical: (r.delta, r.rate_per_month, r.direction, r.significant) for r in t.collect()}
    assert got["Creatinine"] == (70.72, 22.8994, "worsening", True)
    assert got["Hemoglobin A1c"] == (0.9, 0.2914, "worsening", True)
    assert got["Potassium"] == (0.1, 0.0324, "stable", False)
    assert got["Sodium"] == (-1.0, -0.3238, "stable", False)
    assert got["Glucose"] == (1.9425, 0.629, "worsening", True)


def test_care_gaps_and_conversion_golden(spark):
    tests = spark.createDataFrame([(1, n) for n in ("Hemoglobin A1c", "Fasting Glucose", "Potassium", "Sodium")], "user_id long, test_name string")
    got = {(r.condition, r.check) for r in missing_checks(spark, tests).collect()}
    assert got == {("Type 2 Diabetes Mellitus", "Creatinine"), ("Type 2 Diabetes Mellitus", "Urine Albumin"), ("Hypertension", "Creatinine")}
    rows = [("Creatinine", 4.0, "mg/dL"), ("Glucose", 90.0, "mg/dL"), ("Hemoglobin", 13.0, "g/dL"), ("Fasting Glucose", 180.0, "mg/dL"), ("Vitamin Q", 2.0, "IU")]
    v = normalised(spark, spark.createDataFrame(rows, "test_name string, value double, unit string"))
    a = assessed(v.withColumns({"ref_low": F.lit(None).cast("double"), "ref_high": F.lit(None).cast("double")}), spark.createDataFrame(RANGES, "canonical string, low double, high double, critical_low double, critical_high double"))
    got = {r.test_name: (r.value_norm, r["class"]) for r in a.collect()}
    assert got == {"Creatinine": (353.6, "high"), "Glucose": (4.995, "normal"), "Hemoglobin": (130.0, "normal"), "Fasting Glucose": (9.99, "high"), "Vitamin Q": (2.0, "uninterpretable")}


def test_report_lines(spark):
    lines = ["WBC Count: 14.5 10^9/L (4.0-11.0)", "Hemoglobin: 8.0 g/dL (12.0-16.0)", "just prose"]
    got = [(r.test_name, r.value, r.ref_low, r.ref_high) for r in report_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    assert got == [("WBC Count", 14.5, 4.0, 11.0), ("Hemoglobin", 8.0, 12.0, 16.0)]


def test_expressions(spark):
    df = spark.createDataFrame([("Hb rose. It fell (a bit). 3 left.\n\nEnd", "≤ 4.5", "None"), (None, "4d", " x ")], "t string, n string, z string")
    a, b = df.select(sentences(F.col("t")), safe_float(F.col("n")), clean_null(F.col("z")), token_estimate(F.col("t")), any_of(F.col("t"), ["fell"])).collect()
    assert list(a) == [["Hb rose.", "It fell (a bit).", "3 left.", "End"], 4.5, "", 11, True]
    assert list(b) == [[], None, "x", 1, False]
    spaced = " 00 begins. 1 and 2. 33 ends 3 "  # a sentence's place is no set of characters to trim
    assert spark.createDataFrame([(spaced,)], "t string").select(sentences(F.col("t"))).first()[0] == ["00 begins.", "1 and 2.", "33 ends 3"]
    r = spark.createDataFrame([("What does INR of DVT mean",)], "t string").select(query_terms(F.col("t")).alias("x")).first().x
    assert r == ["inr dvt", "inr", "international normalized ratio", "warfarin", "dvt", "deep vein thrombosis"]
    ids = [r[0] for r in spark.createDataFrame([("a/PMC12_x",), ("b/PMID_7",), ("c/d/e",)], "d string").select(canonical_id(F.col("d"))).collect()]
    assert ids == ["PMC12", "PMID_7", "e"]
    v = [r[0] for r in spark.createDataFrame([("unsupported",), ("Supported",), (None,), ("contradicted",)], "v string").select(verdict(F.col("v"))).collect()]
    assert v == ["not_mentioned", "supported", "not_mentioned", "contradicted"]
    assert spark.createDataFrame([("The answer is B. Consult a doctor.",), ("Please consult a doctor.",)], "a string").select(choice(F.col("a"))).collect() == [("B",), (None,)]


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t.csv").write_text("# made\n# Date: 2026-05-10\nTest Name,Result\nSodium,140\n")
    (tmp_path / "a" / "r.rrf").write_text("C1|ENG|x|\nC2|GER||\n")
    (tmp_path / "a" / "l.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    (tmp_path / "a" / "d.json").write_text(json.dumps({"Title": "T", "abstract": 3}))
    (tmp_path / "a" / "n.md").write_text("\n\n# Head\nbody\n")
    (tmp_path / "a" / "rows.big").write_text('[\n["x", "1"],\n["y", "2"],\nbroken\n]\n')
    (tmp_path / "a" / "README.md").write_text("x")
    with zipfile.ZipFile(tmp_path / "a" / "z.zip", "w") as z:
        z.writestr("in.txt", "hello")
    p = str(tmp_path / "a")
    assert [tuple(r) for r in files.read_delimited(spark, f"{p}/t.csv", comment="#", strings=True).collect()] == [("Sodium", "140")]
    assert [tuple(r) for r in files.read_pipes(spark, f"{p}/r.rrf", ["id", "lang", "s"]).collect()] == [("C1", "ENG", "x"), ("C2", "GER", "")]
    good, bad = files.read_json_lines(spark, f"{p}/l.jsonl", "a long")
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.value for r in bad.collect()] == ["not json"]
    r = files.read_json_documents(spark, f"{p}/d.json").first()
    assert (r.title, r.abstract) == ("T", "3")
    assert files.read_texts(spark, f"{p}/n.md").first().title == "Head"
    assert [r.fields for r in files.read_array_rows(spark, f"{p}/rows.big").collect()] == [["x", "1"], ["y", "2"]]
    assert [(r.name, r["size"]) for r in files.read_archive_listing(spark, f"{p}/z.zip").collect()] == [("in.txt", 5)]
    found = {r.relative: (r.reader, r.skip_reason) for r in files.discover(spark, str(tmp_path)).collect()}
    assert found["a/README.md"] == ("text", "skip_stem:readme") and found["a/t.csv"] == ("csv", None) and found["a/r.rrf"][0] == "pipe"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, source string")
    sinks.write_documents(df, str(tmp_path / "d"))
    sinks.write_documents(df.where("source = 'a'").withColumn("id", F.lit(9).cast("long")), str(tmp_path / "d"))
    assert {(r.id, r.source) for r in spark.read.parquet(str(tmp_path / "d")).collect()} == {(9, "a"), (2, "b")}
    key = F.lit(b"0123456789abcdef")
    assert spark.range(1).select(sinks.decrypted(sinks.encrypted(F.lit("secret"), key), key)).first()[0] == "secret"


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    src = str(tmp_path / "in")
    events.orderBy("event_id").limit(300).write.parquet(src)
    stream = file_stream(spark, src, events.schema)
    q = running_trend(stream).writeStream.format("memory").queryName("series").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {(r.user_id, r.event_type): (r.points, r.earliest, r.latest) for r in spark.table("series").collect()}
    few = events.orderBy("event_id").limit(300)
    want = few.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min_by("value", "ts").alias("a"), F.max_by("value", "ts").alias("b")).collect()
    assert got == {(r.user_id, r.event_type): (r.n, r.a, r.b) for r in want}
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        to_table(file_stream(spark, src, events.schema), out, str(tmp_path / "c2")).start().awaitTermination(120)
    assert spark.read.parquet(out).count() == 300


def split_sentences(text):
    return [s.strip() for p in re.split(r"\n{2,}", text or "") for s in re.split(r"(?<=[.!?])\s+(?=[A-Z\-0-9\"(])", p) if s.strip(" ")]


def chunked(text):
    """The chunks of a text by the rule as it is written: flush before a sentence that passes the target, from the least size on."""
    size = lambda t: max(1, int(len(t.split()) * 1.3))
    chunks, held, total, own = [], [], 0, False
    for s in split_sentences(text):
        if size(s) > 500 and re.search(DENSE, s):
            chunks += [" ".join(held)] * own + [s]
            held, total, own = [], 0, False
            continue
        if held and total + size(s) > 500 and total >= 300:
            words = " ".join(held).split()
            chunks.append(" ".join(held))
            tail = words[len(words) - int(len(words) * 0.15) :]
            held, total, own = ([" ".join(tail)], size(" ".join(tail)), False) if tail else ([], 0, False)
        held.append(s)
        total, own = total + size(s), True
    return chunks + [" ".join(held)] * own


def test_long_measurements_are_chunks_alone(spark):
    plain, dense = "Plain words go on here. ", "Doses of 5 mg were " + "given again and " * 300 + "so on."
    text = plain * 30 + dense + " " + plain * 10
    parts = chunked(text)
    assert dense in parts and len(parts) == 3 and estimate(dense) > 800
    rows = chunk_bodies(spark.createDataFrame([(1, text), (2, dense), (3, "words " * 900), (4, None)], "doc_id long, text string")).orderBy("id", "n").collect()
    got = {i: [r.text for r in rows if r.id == str(i)] for i in (1, 2, 3, 4)}
    assert got[1] == parts and got[2] == [dense] and len(got[3]) == 1 and got[4] == []
    assert [r.warning for r in rows if r.id == "1"] == [None, f"chunk 1: {estimate(dense)} tokens (numeric block hard-max exceeded, kept atomic)", None]


def test_chunk_queries_are_the_rules(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    q = library.queries()
    got = {(r.id, r.n): r.text for r in q["chunk_body"](spark, sf_dir).collect()}
    norm = lambda t: t.replace("\xa0", " ")
    assert {k: norm(v) for k, v in got.items()} == {(str(i), n): norm(c) for i, t in texts.items() for n, c in enumerate(chunked(t))}
    chunks = q["chunk_documents"](spark, sf_dir).collect()
    assert len({c.chunk_id for c in chunks}) == len(chunks)
    kinds = Counter((c.doc_id, c.chunk_type) for c in chunks)
    flags = {r.doc_id: r for r in q["chunk_branches"](spark, sf_dir).collect()}
    for i, t in texts.items():
        assert kinds[i, "abstract"] == (i % 3 == 0 and bool(t[:60].strip(" "))) and kinds[i, "figure"] == (i % 5 == 0) and kinds[i, "structured_row"] == flags[i].said
        assert kinds[i, "body"] == (len(chunked(t)) if flags[i].chunk_body else 0)


def test_settled_orders_are_the_ordered_scan(spark, sf_dir):
    keys = sorted(r.o_orderkey for r in spark.read.parquet(f"{sf_dir}/orders.parquet").collect())
    hashes, ids, want = set(), set(), set()
    for k in keys:
        h, i = k * 7919 % 400_001, k * 104_729 % 500_003
        if h not in hashes and i not in ids:
            hashes.add(h), ids.add(i), want.add(k)
    assert {r.ord for r in library.queries()["document_dedup_hash_or_id"](spark, sf_dir).collect()} == want


def test_long_chains_of_conflicts_settle(spark):
    rows = [(i, i // 2, (i + 1) // 2) for i in range(60)]  # each row shares a key with the next
    got = {r.o for r in settle(spark.createDataFrame(rows, "o long, h long, d long"), "h", "d", "o").collect()}
    assert got == {i for i in range(60) if i % 2 == 0}


def test_a_chain_of_a_hundred_thousand_rows_settles_in_few_rounds(spark):
    """Row k shares its hash with the row before or its id, by turns, so every other row stays."""
    n = 100_000
    rows = spark.range(n).selectExpr("id as o", "cast((id + 1) div 2 as long) as h", "cast(id div 2 as long) as d")
    began = time.time()
    got = settle(rows, "h", "d", "o")
    assert got.count() == n // 2 and got.where("o % 2 = 1").isEmpty() and time.time() - began < 240
    assert str(got._jdf.queryExecution().optimizedPlan().toString()).count("Relation") == 1


def test_settle_is_the_ordered_scan_on_tangles(spark):
    rnd = random.Random(9)
    for keys in (6, 40, 150):
        rows = [(k, rnd.randint(0, keys), rnd.randint(0, keys)) for k in range(300)]
        rnd.shuffle(rows)
        hashes, ids, want = set(), set(), set()
        for o, h, d in sorted(rows):
            if h not in hashes and d not in ids:
                hashes.add(h), ids.add(d), want.add(o)
        for plain in (0, 2):
            assert {r.o for r in settle(spark.createDataFrame(rows, "o long, h long, d long"), "h", "d", "o", plain).collect()} == want


def test_upper_median_with_outliers_and_heavy_values(spark):
    """One value of 1e12 leaves no part with more than its share; a value that is half of all rows is a part of its own."""
    rnd = random.Random(3)
    groups = {
        "outlier": [rnd.random() for _ in range(6000)] + [1e12], "heavy": [7.0] * 5000 + [rnd.uniform(0, 20) for _ in range(3000)], "one": [3.0] * 4000, "few": [2.0, 1.0],
        "powers": [10.0 ** rnd.uniform(-200, 200) for _ in range(5000)], "below": [-1e300] * 10 + [rnd.gauss(0, 1) for _ in range(4001)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None)]
    got = {r.g: (r.median, r.n) for r in upper_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", most=200, splitters=8).collect()}
    assert got == {g: (sorted(vs)[len(vs) // 2], len(vs)) for g, vs in groups.items()}


def test_upper_median_on_odd_groups(spark):
    rnd = random.Random(3)
    rows = [("a", float(rnd.randint(0, 5))) for _ in range(101)] + [("b", 7.0)] * 4 + [("c", None)] + [("d", x) for x in (-1e9, 0.0, 1e-9, 2e-9, 1e9)] + [("e", rnd.random() ** 9) for _ in range(500)]
    got = {r.g: (r.median, r.n) for r in upper_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    want = {}
    for g in "abde":
        v = sorted(x for k, x in rows if k == g)
        want[g] = (v[len(v) // 2], len(v))
    assert got == want


def test_tables_said(spark):
    headers = ["Test Name", "Unit", "Critical Low", "Normal Low", "Normal High", "Test Name"]
    rows = [["A", "g", "1", "2", "3"], ["A", "g", "1", "2", "3", "B"], ["A", "nan", "", "", "9"], ["", "g", "1"], ["A", "g", "None", "", ""], [], ["A"]]
    df = spark.createDataFrame([(1, 0, headers, rows), (2, 0, ["x", "Unnamed: 1", "y"], [["1", "2", "3"], ["1"], ["w " * 600, "q", "z"]]), (3, 0, [], [["a"]])], "doc_id long, table int, headers array<string>, rows array<array<string>>")
    got = {(r.doc_id, r.n): r.text for r in said_tables(df).collect()}
    assert [got[1, i] for i in range(7)] == ["A: normal range 2–3 g; critical low 1 g.", "B: normal range 2–3 g; critical low 1 g.", "A: normal high 9.", None, None, None, None]
    assert got[2, 0] == "x: 1; y: 3." and got[2, 1] is None and got[2, 2].endswith("…") and len(got[2, 2].split()) == 384 and (3, 0) not in got


def test_measurements_dates_and_lists(spark):
    cells = [["Glucose", "n/a", "5.5", "mmol/L", "3.9-5.6"], ["Test Name", "Result"], ["Result", "Unit", "1"], ["K", "1"], ["Na+", "x", "140"], [None, "3"], ["Only"], ["Iron", "-2.5", None]]
    got = [tuple(r) for r in measured(spark.createDataFrame([(c,) for c in cells], "cells array<string>")).select("test_name", "value", "unit", "range").collect()]
    assert got == [("Glucose", 5.5, "mmol/L", "3.9-5.6"), ("Na+", 140.0, "", ""), ("Iron", -2.5, "", "")]
    df = spark.createDataFrame([("3.9 - 5.6",), ("<7.",), ("none",), (None,)], "r string")
    assert [tuple(r.b) for r in df.select(range_bounds(F.col("r")).alias("b")).collect()] == [(3.9, 5.6), (0.0, 7.0), (0.0, 9999.0), (0.0, 9999.0)]
    df = spark.createDataFrame([("DATE: 2020-01-02 2019-01-01", "D:20241016000000Z"), ("on 2019-01-01", "2024-1"), (None, " ")], "t string, p string")
    assert [tuple(r) for r in df.select(report_date(F.col("t"), F.lit("d")), pdf_date(F.col("p"))).collect()] == [("2020-01-02", "2024-10-16"), ("2019-01-01", "2024-1"), ("d", None)]
    replies = ['{"sub_questions": [" a ", "", "b"]}', 'x ```json\n{"sub_questions": ["c"]}\n``` y', 'say "first question" or "other question"', 'only "one question"', "{", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in replies], "t string").select(listed_strings(F.col("t"))).collect()]
    assert got == [["a", "b"], ["c"], ["first question", "other question"], [], [], []]


def test_encodings_and_strings_only(spark, tmp_path):
    texts = {"u": "naïve €".encode(), "b": b"\xef\xbb\xbfx", "l": "naïve".encode("latin-1"), "w": "naïve".encode("utf-16"), "e": b""}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in texts.items()], "k string, c binary")
    assert {r.k: (r.d.text, r.d.encoding) for r in df.select("k", decoded(F.col("c")).alias("d")).collect()} == {"u": ("naïve €", "UTF-8"), "b": ("x", "UTF-8"), "l": ("naïve", "ISO-8859-1"), "w": ("naïve", "UTF-16"), "e": ("", "UTF-8")}
    (tmp_path / "d.json").write_text(json.dumps({"title": 7, "Title": "T", "abstract": 3, "abstractText": "A"}))
    r = files.read_json_documents(spark, str(tmp_path / "d.json"), strings_only=True).first()
    assert (r.title, r.abstract) == ("T", "A")


def test_phases_resume(spark, tmp_path):
    ran = []

    def phase(name, f):
        def go(done):
            ran.append(name)
            return f(done)

        return name, go

    phases = [phase("a", lambda d: spark.range(5)), phase("b", lambda d: d["a"].where("id > 2"))]
    assert run_phases(spark, str(tmp_path / "p"), phases[:1])["a"].count() == 5
    out = run_phases(spark, str(tmp_path / "p"), phases)
    assert out["b"].count() == 2 and ran == ["a", "b"]
    assert run_phases(spark, str(tmp_path / "p"), phases)["b"].count() == 2 and ran == ["a", "b"]


def test_top_k_over_many_batches(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = {(r.query_id, r.item_id) for r in exact_topk(spark, df.where("vec_id % 1000 = 0"), df, 7).collect()}
    want = {(q, i) for q in range(0, 6000, 1000) for _, i in sorted((-sum(a * b for a, b in zip(rows[q][1], v, strict=True)), i) for i, v in rows)[:7]}
    assert got == want


def test_topk_in_blocks_is_topk_by_broadcast(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    some = e.where("vec_id % 3 = 0")
    rows = lambda df: sorted((r.query_id, r.item_id, round(r.score, 9), r.rank) for r in df.collect())
    assert rows(exact_topk(spark, some, e, 4, block=20)) == rows(exact_topk(spark, some, e, 4))
    none = e.where("vec_id < 0")
    assert rows(exact_topk(spark, none, e, 4)) == rows(exact_topk(spark, some, none, 4, block=20)) == rows(exact_topk(spark, some, none, 4)) == []


def test_saved_index_finds_the_same(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index, few = CellIndex.fit(spark, e, cells=8), e.where("vec_id % 40 = 0")
    index.save(str(tmp_path / "index"))
    saved = CellIndex.load(spark, str(tmp_path / "index"))
    rows = lambda df: sorted((r.query_id, r.item_id, round(r.score, 9), r.rank) for r in df.collect())
    assert rows(index.search(few, 5, nprobe=2)) == rows(saved.search(few, 5, nprobe=2)) != []
    plan = saved.search(few.limit(1), 5, nprobe=1)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*\(cell#\d+ = \d\)", plan)  # the one cell that is probed


def test_xml_readers(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.xml").write_text(
        "<article xmlns='urn:j'><front><article-meta><title-group><article-title>Iron <i>and</i> blood</article-title></title-group>"
        "<abstract><title>Aim</title><p>One.</p><p>Two <b>three</b>.</p></abstract></article-meta></front>"
        "<body><sec><title>Intro</title><p>First <i>part</i> here.</p></sec><p>Last &amp; least.</p></body></article>"
    )
    (tmp_path / "x" / "b.xml").write_text("<list><item>x</item><item/><item> y z </item></list>")
    (tmp_path / "x" / "c.xml").write_text("<article><body>")
    (tmp_path / "x" / "d.xml").write_text("<article><front/></article>")
    got = {r.path[-5:]: (r.title, r.abstract, r.body, r.error is None) for r in files.read_articles(spark, str(tmp_path / "x")).collect()}
    assert got == {
        "a.xml": ("Iron and blood", "One. Two three.", "Intro\nFirst\npart\nhere.\nLast & least.", True),
        "b.xml": ("b", None, "x\ny z", True),
        "c.xml": (None, None, None, False),
        "d.xml": ("d", None, "", True),
    }
    (tmp_path / "drugs.xml").write_text("<n:db xmlns:n='urn:d'>" + "".join(f"<n:drug id='{i}'><n:name>d{i}</n:name></n:drug>" for i in range(4)) + "</n:db>")
    drugs = files.read_xml_records(spark, str(tmp_path / "drugs.xml"), "drug", most=3)
    assert {(r._id, r.name) for r in drugs.collect()} < {(i, f"d{i}") for i in range(4)} and drugs.count() == 3
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "f.owl").write_text("Prefix(:=<x>)\nOntology(<x>\n\nDeclaration(Class(:A))\nDeclaration(Class(:B))\nAnnotationAssertion(rdfs:label :A \"a\")\n)\n")
    (tmp_path / "o" / "r.owl").write_text('<rdf:RDF>\n<owl:Class rdf:about="#A">\n<rdfs:label>a</rdfs:label>\n<rdfs:subClassOf rdf:resource="#B"/>\n</owl:Class>\n</rdf:RDF>\n')
    got = {r.path[-5:]: tuple(r)[1:] for r in files.read_owl_files(spark, str(tmp_path / "o")).collect()}
    assert got == {"f.owl": ("functional", 2, 1, 6), "r.owl": ("rdf/xml", 1, 1, 6)}
