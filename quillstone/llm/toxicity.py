"""Toxicity: a logistic classifier on hashed words, trained so that swapping identity terms doesn't move its score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillstone.llm.shared import BETWEEN, arrow_map, passes, prefix_sums, span_hashes, words

#: Rows of each class that the classifier is fitted on at most, in the order of a hash of their ids.
SAMPLE = 2500
BUCKETS = 1 << 20
#: Prefixes (bytes) of a word that are features beside the word: inflected and compounded forms share them.
PREFIXES = (4, 5, 6)
HOLD_OUT = 5

# Neutral terms for groups of people, by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS = [
    "woman man girl boy female male lesbian gay straight bisexual transgender nonbinary queer",
    "women men girls boys females males lesbians gays",
    "muslim christian jewish hindu buddhist sikh catholic protestant atheist",
    "muslims christians jews hindus buddhists sikhs catholics protestants atheists",
    "black white asian african american european latino hispanic arab indigenous immigrant refugee",
    "deaf blind disabled elderly young old autistic",
    "frau mann mädchen junge lesbisch schwul muslimisch christlich jüdisch",
    "femme homme fille garçon lesbienne musulman chrétien juif noir blanc arabe",
    "mujer hombre niña niño lesbiana musulmán cristiano judío negro blanco árabe",
]
_OTHER = {t: [x for x in row.split() if x != t] for row in IDENTITY_TERMS for t in row.split()}
_TERM = re.compile(r"(?<![^\W_])(" + "|".join(sorted(map(re.escape, _OTHER), key=len, reverse=True)) + r")(?![^\W_])", re.IGNORECASE)
_ALL_TERMS = sorted(_OTHER)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row of each feature, its bucket); repeats are left in."""
    for a, b, data, offsets in passes(column):
        starts, ends, bounds = words(data, offsets, BETWEEN)
        sums, doc = prefix_sums(data), np.repeat(np.arange(b - a), np.diff(bounds))
        rows, buckets = [doc], [span_hashes(sums, starts, ends)]
        for n in PREFIXES:
            some = ends - starts > n
            rows.append(doc[some])
            buckets.append(span_hashes(sums, starts[some], starts[some] + n))
        yield a, b, np.concatenate(rows), (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int64)


def feature_lists(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct buckets."""
    out: list[np.ndarray] = []
    for a, b, rows, buckets in features(pa.array(texts, pa.string())):
        key = np.unique(rows * BUCKETS + buckets)
        out += np.split(key % BUCKETS, np.searchsorted(key // BUCKETS, np.arange(1, b - a)))
    return out


def counterfactual(text: str, seed: int) -> str:
    """The text with every identity term swapped for another of its kind; one without any gets one of them added."""
    if not _TERM.search(text):
        return f"{text} {_ALL_TERMS[seed % len(_ALL_TERMS)]}"
    return _TERM.sub(lambda m: (o := _OTHER[m.group().lower()])[(seed + m.start()) % len(o)] if m.group().lower() in _OTHER else m.group(), text)


def _examples(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, 200):
        part = batch.slice(a, 200)
        texts = [t or "" for t in part.column(2).to_pylist()]
        x = feature_lists(texts)
        y = feature_lists([counterfactual(t, i) for t, i in zip(texts, part.column(0).to_pylist(), strict=True)])
        gone, come = [np.setdiff1d(v, w, True) for v, w in zip(x, y, strict=True)], [np.setdiff1d(w, v, True) for v, w in zip(x, y, strict=True)]
        packed = [pa.array([v.astype("<i4").tobytes() for v in z], pa.binary()) for z in (x, gone, come)]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *packed], ["id", "toxic", "x", "gone", "come"])


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Of each row of a string column: the logistic of the bias and the weights of its distinct features."""
        total = np.full(len(column), self.bias)
        for a, _, rows, buckets in features(column):
            some = self.weights[buckets] != 0
            key = np.unique((rows[some] + a) * BUCKETS + buckets[some])
            np.add.at(total, key // BUCKETS, self.weights[key % BUCKETS])
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists]), np.concatenate(lists) if lists else np.zeros(0, np.int32)


def fit(x: list[np.ndarray], gone: list[np.ndarray], come: list[np.ndarray], y: np.ndarray, weight: np.ndarray, fairness: float = 1.0, sparsity: float = 5e-6, keep: int = 20_000, steps: int = 800) -> Classifier:
    """Weighted logistic loss + fairness * mean (score of a text - score of its counterfactual)^2 + sparsity * |w|.

    ``gone`` and ``come`` are the features that a text's counterfactual loses and gains. Scores in the penalty are before the logistic. Only the ``keep`` features most telling of the class (by G^2) and
    those that swaps change get a weight. Accelerated proximal gradient steps; no randomness.
    """
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)) if len(y) else 1e-6
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Classifier(np.zeros(BUCKETS), bias)
    row, col = _flat(x)
    toxic = y[row] == 1
    n1, n0 = np.bincount(col[toxic], minlength=BUCKETS), np.bincount(col[~toxic], minlength=BUCKETS)
    del toxic
    t1, t0 = (y == 1).sum(), (y == 0).sum()
    p = (n1 + n0) / (t1 + t0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = sum(np.nan_to_num(n * np.log(n / (t * p))) + np.nan_to_num((t - n) * np.log((t - n) / (t * (1 - p)))) for n, t in ((n1, t1), (n0, t0)))
    chosen = np.zeros(BUCKETS, dtype=bool)
    top = np.argsort(-g, kind="stable")[:keep]
    chosen[top[g[top] > 2]] = True
    (r1, c1), (r2, c2) = _flat(gone), _flat(come)
    chosen[c1] = chosen[c2] = True
    del n1, n0, p, g
    number = np.full(BUCKETS, -1, dtype=np.int32)
    number[chosen] = np.arange(chosen.sum(), dtype=np.int32)
    m, n = int(chosen.sum()), len(y)
    some = chosen[col]
    row, col = row[some], number[col[some]]
    dr, dc, ds = np.concatenate([r1, r2]), number[np.concatenate([c1, c2])], np.concatenate([np.ones(len(r1)), -np.ones(len(r2))])
    weight = weight / weight.sum()
    w, v, t, b = np.zeros(m), np.zeros(m), 1.0, bias
    vb = b
    busiest = np.bincount(row, minlength=n)
    rate = 1.0 / (0.25 * (weight * (busiest + 1)).max() * n / 8 + 0.25 * (weight * (busiest + 1)).sum() + 2 * fairness * 4)
    for _ in range(steps):
        z = np.bincount(row, v[col], n) + vb
        d = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        change = np.bincount(dr, ds * v[dc], n)
        grad = np.bincount(col, d[row], m) + 2 * fairness / n * np.bincount(dc, ds * change[dr], m)
        new = v - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate * sparsity, 0)
        nb = vb - rate * d.sum()
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / u * (new - w), nb + (t - 1) / u * (nb - b)
        w, b, t = new, nb, u
    out = np.zeros(BUCKETS)
    out[chosen] = w
    return Classifier(out, b)


def known_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(id, toxic) of each labelled id that may be learned from: one row per id, 1 if any of its labels is."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("id").cast("string")) % HOLD_OUT != 0))
    return known.groupBy("id").agg(F.max("toxic").alias("toxic"))


def training_rows(docs: DataFrame, known: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, toxic, x, and what the counterfactual loses and gains) of at most ``sample`` labelled ids a class; of an id with
    several texts, the first in order counts, so there is one row per id."""
    order = [F.xxhash64("id"), F.col("id")]
    few = known.where("toxic = 1").orderBy(*order).limit(sample).unionByName(known.where("toxic = 0").orderBy(*order).limit(sample))  # at most 2 * sample rows: that bound allows the broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(few), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    return arrow_map(rows, _examples, "id long, toxic int, x binary, gone binary, come binary")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Classifier:
    """Fitted on at most 2 * sample rows, each of at most BUCKETS features."""
    known = known_labels(labels, id_col, label_col)
    rows = training_rows(docs, known, sample, id_col, text_col).toPandas().sort_values("id")
    lists = [[np.frombuffer(v, dtype="<i4") for v in rows[c]] for c in ("x", "gone", "come")]
    y = rows["toxic"].to_numpy(dtype=np.float64)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = np.array([counts[int(v)] / max(1, (y == v).sum()) for v in y]) if len(y) else np.zeros(0)
    return fit(*lists, y, weight, **options)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: its id (and the columns ``keep``), held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    The classifier reads words and word prefixes of the whole text and nothing else. It is fitted on at most ``sample``
    labelled rows a class (those whose crc32 of the id is not divisible by 5), weighted to the classes' true shares, with
    a penalty on the score change between each text and its counterfactual. The sample's features reach the driver; its
    bound is the parameter. Every text is scored where it is read; nothing of ``docs`` is shuffled.

    A null or empty text gets the bias's score. Null ids are kept, not held out. Of an id with several texts the first in order is learned from. Labels other than 0 and 1 are
    left out; an id labelled both ways counts as 1. Without labels of both classes every score is the (smoothed) share
    of 1. Repeated rows are kept. Other columns are ignored. An empty table gives no rows.
    """
    held = spark.sparkContext.broadcast(train(docs, labels, sample, id_col, text_col, label_col))  # BUCKETS weights

    passed = docs.select(*dict.fromkeys([id_col, text_col, *(keep or [])]))
    names = [c for c in passed.columns if c != text_col or text_col in (keep or [])]

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        score = pa.array(held.value.scores(batch.column("_text")))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), score], [*names, "score"])

    rows = passed.select(*names, F.col(text_col).cast("string").alias("_text"))
    schema = StructType([*(rows.schema[c] for c in names), StructField("score", DoubleType())])
    scored = arrow_map(rows, f, schema)
    return scored.select(*names, F.coalesce(F.crc32(F.col(id_col).cast("string")) % HOLD_OUT == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
