"""Text retrieval, containment and typed paths against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone.operators import evidence, lexical
from quillstone.operators.containment import contains_join
from quillstone.operators.paths import Hop, chunk_heads, entity_chunks
from quillstone.plans import library


def scores(docs, question):
    """BM25 in millionths of every document that shares a term."""
    words = {i: [w.lower() for w in re.findall(r"[^\W_]+", t or "")] for i, t in docs}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    out = Counter()
    for t in {w.lower() for w in re.findall(r"[^\W_]+", question or "")}:
        df = sum(t in w for w in words.values())
        for i, w in words.items():
            if tf := w.count(t):
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                out[i] += math.floor(idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))) * 1_000_000 + 0.5)
    return out


def corpus(seed=1, n=400):
    rnd = random.Random(seed)
    common, rare = ["the", "of", "and"], [f"w{i}" for i in range(300)]
    text = lambda k: " ".join(rnd.choice(common) if rnd.random() < 0.5 else rare[int(rnd.paretovariate(0.6)) % 300] for _ in range(k))
    docs = [(i, text(rnd.choice([1, 5, 40, 200]))) for i in range(n)]
    return rnd, docs + [(n + i, docs[7][1]) for i in range(60)] + [(n + 100, None), (n + 101, ""), (n + 102, "the " * 5000), (n + 103, "Straße ÉTÉ w1")]


@pytest.mark.parametrize(("block", "k"), [(4, 5), (256, 12)])
def test_bm25_is_exact(spark, tmp_path, block, k):
    rnd, docs = corpus()
    df = spark.createDataFrame([*docs, (None, "the w1")], "doc_id long, text string").repartition(4)
    asked = [(f"q{i}", " ".join(rnd.choice(["the", "of", f"w{rnd.randint(0, 60)}", "nowhere"]) for _ in range(rnd.randint(1, 9)))) for i in range(40)]
    asked += [("same", docs[7][1]), ("none", "nothing of_this"), ("null", None), ("empty", ""), ("eté", "été STRASSE straße"), ("the", "the")]
    index = lexical.inverted_index(df, block=block)
    assert index.lists.select(F.max(F.size("postings"))).first()[0] <= 4 * block  # dealt by hash, so about a block
    index.save(str(tmp_path))
    index = lexical.InvertedIndex.load(spark, str(tmp_path))
    got = {}
    for r in lexical.bm25_top_k(index, spark.createDataFrame([*asked, asked[0], (None, "the")], "query_id string, text string"), k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    for q, text in asked:
        want = sorted(((-s, i) for i, s in scores(docs, text).items()))[:k]
        assert sorted(got.get(q, [])) == [(j + 1, i, -s) for j, (s, i) in enumerate(want)], q


def test_nothing_to_search(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    index = lexical.inverted_index(empty)
    assert lexical.bm25_top_k(index, spark.createDataFrame([("a", "b")], "query_id string, text string"), 3).count() == 0
    index = lexical.inverted_index(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert lexical.bm25_top_k(index, spark.createDataFrame([], "query_id string, text string"), 3).count() == 0


def test_contains_join(spark):
    rnd = random.Random(3)
    names = [("".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 14))), i) for i in range(300)] + [(None, 900), ("", 901), ("ab" * 5000, 902), ("abc", 903), ("abc", 904)]
    needles = [("".join(rnd.choice("abcé ") for _ in range(rnd.randint(1, 6))), i) for i in range(120)] + [(None, 900), ("", 901), ("zzz", 902), ("ab", 903), ("ab", 903), ("a", 904), ("é", 905)]
    got = contains_join(spark.createDataFrame(needles, "needle string, k int"), spark.createDataFrame(names, "name string, id int")).collect()
    want = Counter((w, k, t, i) for w, k in needles for t, i in names if w and t and w in t)
    assert Counter((r.needle, r.k, r.name, r.id) for r in got) == want
    df = contains_join(spark.createDataFrame(needles, "needle string, k int"), spark.createDataFrame(names, "name string, id int"))
    assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
    assert contains_join(spark.createDataFrame([], "needle string, k int"), spark.createDataFrame(names, "name string, id int")).count() == 0


def test_paths_keep_what_led_to_them(spark):
    rnd = random.Random(5)
    mentions = [(rnd.randint(0, 9), rnd.randint(0, 30), "DOCUMENT_MENTIONS") for _ in range(120)]
    chunks = [(d, d * 100 + c) for d in range(25) for c in range(rnd.randint(1, 9))]  # documents 25 to 30 have none
    names = [(i, f"d{i}") for i in range(10)]
    edges = [(rnd.randint(0, 3), rnd.randint(0, 12), rnd.choice(["CAUSES", "TREATS"])) for _ in range(60)]
    m = spark.createDataFrame(mentions, "entity long, document long, kind string")
    c = spark.createDataFrame(chunks, "document long, chunk long")
    heads = chunk_heads(m, c, 4)
    want = {e: sorted({(d, ch) for x, d, _ in mentions if x == e for y, ch in chunks if y == d})[:4] for e in range(10)}
    got = {}
    for r in heads.collect():
        got.setdefault(r.entity, []).append((r.document, r.chunk))
    assert {e: sorted(v) for e, v in got.items()} == {e: v for e, v in want.items() if v}
    d = spark.createDataFrame(names, "entity long, name string")
    drugs = spark.createDataFrame([(i, f"x{i}") for i in range(4)], "entity long, name string")
    hop = Hop(spark.createDataFrame(edges, "src long, dst long, kind string"), "Disease", d)
    rows = entity_chunks(heads, "Drug", drugs, hop, 4).orderBy("entity", "n").collect()
    for s in range(4):
        through = {v: min(k for a, b, k in edges if (a, b) == (s, v)) for a, v, _ in edges if a == s and want.get(v)}
        paths = sorted((v, doc, ch) for v in through for doc, ch in want[v])[:4]
        mine = [r for r in rows if r.entity == str(s)]
        assert [(r.document, r.chunk) for r in mine] == [(doc, ch) for _, doc, ch in paths]
        assert [list(r.path) for r in mine] == [[through[v], "DOCUMENT_MENTIONS", "HAS_CHUNK"] for v, _, _ in paths]
        assert [[tuple(e) for e in r.entities] for r in mine] == [[("Drug", str(s), f"x{s}"), ("Disease", str(v), f"d{v}")] for v, _, _ in paths]
        assert all(r.score == 0.85 and r.text.startswith(f"Drug(x{s}) -[{through[v]}]-> Disease(d{v}) -[") for r, (v, _, _) in zip(mine, paths, strict=True))


def test_overall_class(spark):
    cases = {"a": ("none", ["none", "none"]), "b": ("strong", ["strong", "strong"]), "c": ("strong", ["strong", "partial"]), "d": ("partial", ["strong", "none"]), "e": ("partial", ["partial", "none"]), "f": ("partial", ["partial"])}
    df = spark.createDataFrame([(k, c) for k, (_, cs) in cases.items() for c in cs], "k string, coverage string")
    assert {r.k: r.overall for r in evidence.overall(df, ["k"]).collect()} == {k: v for k, (v, _) in cases.items()}


def test_answers_without_evidence_and_without_graph(spark):
    docs = spark.createDataFrame([(1, "aspirin lowers fever", "s", "book", "lib/PMC1_a"), (2, "aspirin again", "s", "guideline", "lib/PMC1_b"), (3, "warfarin", "s", "book", "lib/x")], "doc_id long, text string, source string, category string, path string")
    held = evidence.Corpus(docs, lexical.inverted_index(docs), "Drug", spark.createDataFrame([("warfarin", "warfarin")], "entity string, name string"), spark.createDataFrame([("warfarin", 3, "DOCUMENT_MENTIONS")], "entity string, document long, kind string"))
    asked = spark.createDataFrame([("a", "aspirin"), ("w", "warfarin"), ("n", "nothing")], "query string, question string")
    both = {(r["query"], r.doc_id): r.found_by for r in evidence.retrieve(held, asked).collect()}
    assert both == {("a", 2): "vector", ("w", 3): "both"}  # one hit of a paper; the shorter text scores more
    alone = evidence.retrieve(held, asked, graph=False)
    assert {(r["query"], r.doc_id): r.found_by for r in alone.collect()} == {("a", 2): "vector", ("w", 3): "vector"}
    out = {r["query"]: r for r in evidence.answers(asked, alone, lambda q, p: F.concat(q, F.lit(":"), p)).collect()}
    assert out["n"].citations == [] and out["n"].tier == "low" and out["n"].answer.startswith("nothing:") and out["a"].citations == ["2"]
    assert all("not medical advice" in r.answer for r in out.values())
    cited = {(r["query"], r.place): r.document_id for r in evidence.guideline_citations(asked, alone).collect()}
    assert cited[("n", 1)].startswith("guideline_") and cited[("w", 1)] == "3"
    assert {r["query"]: r.coverage for r in evidence.covered(asked, evidence.retrieve(held, asked)).collect()} == {"a": "none", "w": "partial", "n": "none"}


def test_bm25_makes_no_row_for_a_pair(spark, monkeypatch):
    """Questions and documents that all share a term meet in blocks: no join has a row for each pair; blocks don't change the answer, nor does an index of the terms asked for."""
    rnd, docs = corpus(3, 120)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(f"q{i}", "the of and w%d" % i) for i in range(60)], "query_id string, text string")
    monkeypatch.setattr(lexical, "ASKED_BLOCK", 40)
    monkeypatch.setattr(lexical, "POSTINGS_BLOCK", 100)
    only = asked.select(F.explode(lexical.terms(F.col("text"))).alias("term"))
    small, whole = lexical.inverted_index(df, only=only), lexical.inverted_index(df)
    assert small.terms.count() < whole.terms.count()
    found = lexical.bm25_top_k(small, asked, 5)
    rows = lambda x: sorted((r.query_id, r["rank"], r.id, r.score) for r in x.collect())
    assert rows(found) == rows(lexical.bm25_top_k(whole, asked, 5))
    for i in (0, 59):
        want = sorted((-s, d) for d, s in scores(docs, "the of and w%d" % i).items())[:5]
        assert [x[2:] for x in rows(found) if x[0] == f"q{i}"] == [(d, -s) for s, d in want]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroupedMap" in plan or "FlatMapCoGroupsIn" in plan


def test_a_weight_of_nothing_still_counts():
    postings = lexical.pd.DataFrame({"t": [0, 0, 1], "id": [5, 3, 3], "w": [0, 0, 7]})
    questions = lexical.pd.DataFrame({"_q": ["a", "b", "c"], "ts": [[0], [0, 1], []]})
    got = lexical._best_documents(questions, postings, 2)
    assert list(got.itertuples(index=False, name=None)) == [("a", 3, 0), ("a", 5, 0), ("b", 3, 7), ("b", 5, 0)]


def test_texts_meet_the_best_only(spark):
    """What ranks documents has no text in it: texts are joined to the rows that stay, and documents of one id are told apart."""
    docs = spark.createDataFrame([(i % 50, f"aspirin {'x' * (i % 7)} {i}", "s", "book", f"lib/{i}") for i in range(60)], "doc_id long, text string, source string, category string, path string")
    held = evidence.Corpus(docs, lexical.inverted_index(docs.where("path not in ('lib/50', 'lib/51')")))
    hits = evidence.retrieve(held, spark.createDataFrame([("a", "aspirin")], "query string, question string"), top=60, graph=False)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "text#" in plan
    got = [(r.doc_id, r.canonical, r.text.split()[-1]) for r in hits.collect()]
    assert len(got) == len(set(got)) == 60 and all(c == t for _, c, t in got) and {d for d, _, _ in got} == set(range(50))


def test_counted_terms_agree(spark, monkeypatch):
    """Counts by document give what lists by term give, in blocks too."""
    rnd, docs = corpus(4, 300)
    df = spark.createDataFrame([*docs, (None, "the w1")], "doc_id long, text string").repartition(3)
    asked = [(f"q{i}", " ".join(rnd.choice(["the", "of", f"w{rnd.randint(0, 60)}", "nowhere"]) for _ in range(rnd.randint(1, 9)))) for i in range(40)]
    asked = spark.createDataFrame([*asked, asked[0], ("none", "nowhere"), ("null", None), ("the", "the"), (None, "the"), ("eté", "été STRASSE straße")], "query_id string, text string")
    only = asked.select(F.explode(lexical.terms(F.col("text"))).alias("term"))
    want = lexical.bm25_top_k(lexical.inverted_index(df), asked, 70)
    rows = lambda x: sorted((r.query_id, r["rank"], r.id, r.score) for r in x.collect())
    assert rows(lexical.bm25_top_k(lexical.counted_terms(df, only), asked, 70)) == rows(want)
    for name, n in (("ASKED_TERMS", 40), ("COUNTED_TERMS", 300)):
        monkeypatch.setattr(lexical, name, n)
    index = lexical.counted_terms(df, only)
    assert rows(lexical.bm25_top_k(index, asked, 5)) == [r for r in rows(want) if r[1] <= 5]
    assert sorted((r.term, r.id) for r in index.mentions(spark.createDataFrame([("été",), ("nowhere",)], "term string")).collect()) == [("été", 403)]
    monkeypatch.setattr(lexical, "VOCABULARY", 2)
    assert lexical.counted_terms(df, only) is None


def test_parts_of_documents_and_weights_of_nothing(monkeypatch):
    """Documents scored in parts give what they give at once; those whose weights are nothing still count."""
    rnd = random.Random(6)
    has = [sorted(rnd.sample(range(12), rnd.randint(1, 6))) for _ in range(400)]
    ints = lexical.pa.list_(lexical.pa.int32())
    docs = lexical.pa.table({"id": rnd.sample(range(1000), 400), "len": lexical.pa.array([rnd.randint(6, 40) for _ in has], "int32"), "ts": lexical.pa.array(has, ints), "tfs": lexical.pa.array([[rnd.randint(1, 3) for _ in x] for x in has], ints)})
    asked = lexical.pa.table({"_q": ["a", "b", "c"], "ts": lexical.pa.array([[0, 3, 5], [11], [12]], ints)})
    for idf in ([0.5 + i / 7 for i in range(13)], [0.0] * 13):
        whole = lexical._best_counted(asked, docs, lexical.np.array(idf), 9.0, 20).to_pylist()
        assert [r["_q"] for r in whole] == ["a", "b"] and [len(r["ids"]) for r in whole] == [20, 20]
        first = sorted(i for i, x in zip(docs["id"].to_pylist(), has, strict=True) if 11 in x)[:20]
        assert idf[0] or (whole[1]["ids"] == first and set(whole[1]["scores"]) == {0})
        with monkeypatch.context() as m:
            m.setattr(lexical, "DOCUMENTS", 33)
            assert lexical._best_counted(asked, docs, lexical.np.array(idf), 9.0, 20).to_pylist() == whole


def test_sub_questions_of_every_turn(spark, sf_dir):
    """Coverage is told of all sub-questions, not of those of some conversations."""
    queries = library.queries()
    parts = {(r.conv_id, r.turn) for r in queries["question_parts"](spark, sf_dir).collect()}
    got = [(r.conv_id, r.turn) for r in queries["sub_question_coverage"](spark, sf_dir).select("conv_id", "turn").collect()]
    assert set(got) == parts and len(got) == 2 * len(parts) and any(c % 20 for c, _ in got)
    assert "conv_id %" not in library.oracle_sql()["sub_question_coverage"]


def test_hits_of_a_block_are_one_row(spark):
    """What documents' blocks give is shuffled by question as one row with its best, not as a row for each hit."""
    df = spark.createDataFrame([(i, f"the w{i % 9}") for i in range(200)], "doc_id long, text string")
    asked = spark.createDataFrame([(f"q{i}", f"the w{i}") for i in range(9)], "query_id string, text string")
    index = lexical.counted_terms(df, asked.select(F.explode(lexical.terms(F.col("text"))).alias("term")))
    found = lexical.bm25_top_k(index, asked, 5)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [next(i for i, line in enumerate(plan) if name in line) for name in ("Window", "Generate inline", "Exchange", "CoGroup")]
    assert at == sorted(at) and not any("Exchange" in line for line in plan[at[0] : at[1]])
    assert found.count() == 45
