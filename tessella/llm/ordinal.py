"""Toxicity by cumulative-link ordinal regression over sparse text features.

Grades run from 0 (clean) to `GRADES` - 1. P(grade > k | x) = sigmoid(w.x - theta_k) with one weight vector
for all thresholds theta_0 < theta_1 < ...; the operator gives out these probabilities, their sum (the
expected severity) and the verdict: toxic if the expected severity is at least `REJECT`.

Features of a text are its words (letters and digits, A-Z lowered) and their first 4, 5 and 6 characters; a
feature weighs 1 plus a quarter of the logarithm of its occurrences. Labels say only toxic or not: grades
above 0 divide the toxic training texts at the quantiles of their evidence, the summed weights of features
that are found almost only in toxic texts.

Training uses at most about `TRAIN_ROWS` labelled rows, chosen by a hash of the id, one of each text. All features of at least
`LEAST_TEXTS` of these texts whose chi-squared statistic is significant are fitted, at a level at which one feature without meaning is expected to pass among all
that are tested; the bounded sample bounds their number and the driver's input. Scoring runs over whole texts of all rows, without a shuffle.

Defined results. Null, empty or blank text: severity 0, kept. Labels missing, null, or of one class only:
no model, all kept at severity 0. A label row repeated or contradicted: the largest value counts. Repeated
rows and null ids: scored each by its text. Empty table: no rows. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import byte_table, coded, durable, fresh, text_slices, words

GRADES = 4
REJECT = 0.5
TRAIN_ROWS = 6000
#: A feature is tested if so many of the training texts have it, whatever their number.
LEAST_TEXTS = 3
#: Ids fall evenly into so many classes; a share of them is the sample.
HASHES = 1 << 62
PREFIXES = (4, 5, 6)
#: A feature counts as evidence of severity if this share of its training texts, at least, is toxic.
EVIDENCE = 0.9
#: Features without meaning that are expected among the significant ones.
BY_CHANCE = 1.0
STEPS, RATE, PENALTY = 1000, 0.1, 5e-6

_ALPHANUMERIC = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()), lower=True)


def _keys(word: bytes) -> list[str]:
    text = word.decode()
    return [text, *(f"^{text[:n]}" for n in PREFIXES if len(text) > n)]


def _counted(column: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """For each row: distinct words and how often each occurs."""
    first, _, _, found = words(column, _ALPHANUMERIC)
    codes, distinct = coded(found)
    spelled = distinct.to_pylist()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own, times = np.unique(codes[a:b], return_counts=True)
        yield [spelled[c] for c in own.tolist()], times


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            keys, values = [], []
            for own, times in _counted(part.column("text")):
                total: dict[str, int] = {}
                for w, t in zip(own, times.tolist(), strict=True):
                    for k in _keys(w):
                        total[k] = total.get(k, 0) + t
                keys.append(list(total)), values.append(list(total.values()))
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), pa.array(keys, pa.list_(pa.string())), pa.array(values, pa.list_(pa.int64()))],
                names=["toxic", "keys", "times"],
            )


def _weight(times: np.ndarray) -> np.ndarray:
    return 1 + np.log(times) / 4


@dataclass
class Model:
    """weights by feature; thresholds in rising order (none: no model)."""

    weights: dict[str, float]
    thresholds: list[float]

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score (rows) and threshold (columns)."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - scores[:, None], -50, 50)))


def fit_cumulative_link(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the proportional-odds model for a sparse matrix, by Adam on the penalised likelihood."""
    n = len(grades)
    share = np.array([(grades > k).mean() for k in range(n_grades - 1)]).clip(0.5 / n, 1 - 0.5 / n)
    theta0 = np.log((1 - share) / share)
    parameters = np.concatenate([np.zeros(n_features), theta0[:1], np.log(np.maximum(np.diff(theta0), 0.05))])
    one, two = np.zeros_like(parameters), np.zeros_like(parameters)
    above = (grades[:, None] == np.arange(n_grades)[None, :]).argmax(axis=1)
    for step in range(1, STEPS + 1):
        w, theta = parameters[:n_features], np.concatenate([parameters[n_features : n_features + 1], parameters[n_features] + np.cumsum(np.exp(parameters[n_features + 1 :]))])
        score = np.bincount(rows, values * w[columns], minlength=n)
        upper = 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -50, 50)))  # P(grade <= k)
        cdf = np.concatenate([np.zeros((n, 1)), upper, np.ones((n, 1))], axis=1)
        density = np.concatenate([np.zeros((n, 1)), upper * (1 - upper), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        mass = np.maximum(cdf[at, above + 1] - cdf[at, above], 1e-12)
        to_upper, to_lower = density[at, above + 1] / mass, density[at, above] / mass
        d_score = (to_upper - to_lower) / n  # of the negative log likelihood
        d_w = np.bincount(columns, values * d_score[rows], minlength=n_features) + PENALTY * w
        d_theta = np.array([(-(to_upper * (above == k)) + to_lower * (above == k + 1)).sum() / n for k in range(n_grades - 1)])
        rises = np.exp(parameters[n_features + 1 :])
        gradient = np.concatenate([d_w, [d_theta.sum()], [d_theta[k + 1 :].sum() * rises[k] for k in range(n_grades - 2)]])
        one = 0.9 * one + 0.1 * gradient
        two = 0.999 * two + 0.001 * gradient**2
        parameters = parameters - RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    theta = np.concatenate([parameters[n_features : n_features + 1], parameters[n_features] + np.cumsum(np.exp(parameters[n_features + 1 :]))])
    return parameters[:n_features], theta


def least_statistic(tested: int) -> float:
    """The chi-squared statistic that `BY_CHANCE` of so many features without meaning reach."""
    return NormalDist().inv_cdf(1 - min(0.5, BY_CHANCE / (2 * max(1, tested)))) ** 2


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, least_texts: int = LEAST_TEXTS) -> Model:
    """Fit on at most about `train_rows` labelled documents, by features of at least `least_texts` of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(HASHES)) < int(HASHES * min(1.0, train_rows / max(n, 1))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(chosen), "doc_id")  # bounded by train_rows
    sample = sample.groupBy(F.xxhash64("text").alias("copy")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    featured = durable(sample.select("text", "toxic").mapInArrow(_featured, "toxic int, keys array<string>, times array<long>").withColumn("row", F.monotonically_increasing_id()))
    counts = featured.agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")).first()
    n, n_toxic = counts["n"], counts["toxic"] or 0
    if not n or n_toxic in (0, n):
        return Model({}, [])
    seen = featured.select("toxic", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("df"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("hits"))
    df, hits = F.col("df").cast("double"), F.col("hits").cast("double")
    squared = n * F.pow(hits * n - df * n_toxic, F.lit(2.0)) / (df * (n - df + 1) * n_toxic * (n - n_toxic))
    tested = durable(seen.where(F.col("df") >= least_texts).select("key", "df", "hits", squared.alias("squared")))
    telling = tested.where(F.col("squared") >= least_statistic(tested.count()))
    features = telling.orderBy("key").collect()  # from at most train_rows texts
    if not features:
        return Model({}, [])
    # The sample's texts as sparse rows.
    entries = featured.select("row", F.explode(F.arrays_zip("keys", "times")).alias("e")).select("row", "e.*").join(F.broadcast(telling.select(F.col("key").alias("keys"))), "keys")
    table = entries.toPandas()
    heads = featured.select("row", "toxic").toPandas().sort_values("row")
    place = {r: i for i, r in enumerate(heads["row"])}
    toxic = heads["toxic"].to_numpy() > 0
    index = {r["key"]: i for i, r in enumerate(features)}
    rows, columns = table["row"].map(place).to_numpy(np.int64), table["keys"].map(index).to_numpy(np.int64)
    values = _weight(table["times"].to_numpy(np.float64))
    evidence = np.array([r["hits"] >= EVIDENCE * r["df"] for r in features], bool)[columns]
    shown = np.bincount(rows[evidence], values[evidence], minlength=len(heads))
    cuts = np.quantile(shown[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grades = np.where(toxic, 1 + np.searchsorted(cuts, shown, side="right"), 0)
    weights, thresholds = fit_cumulative_link(rows, columns, values, grades, len(index))
    return Model({k: float(weights[i]) for k, i in index.items()}, [float(x) for x in thresholds])


def _scorer(model: Model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.weights
        for batch in batches:
            for part in text_slices(batch):
                scores = np.zeros(part.num_rows)
                first, _, _, found = words(part.column("text"), _ALPHANUMERIC)
                codes, distinct = coded(found)
                # (distinct word, feature) pairs that the model knows, then their places in the texts.
                pairs = [(c, k) for c, w in enumerate(distinct.to_pylist()) for k in _keys(w) if k in known]
                if pairs:
                    names = sorted({k for _, k in pairs})
                    number = {k: i for i, k in enumerate(names)}
                    weight = np.array([known[k] for k in names])
                    hit = np.zeros(len(distinct), bool)
                    hit[[c for c, _ in pairs]] = True
                    at = np.flatnonzero(hit[codes])
                    rows = np.searchsorted(first, at, side="right") - 1
                    of_word: dict[int, list[int]] = {}
                    for c, k in pairs:
                        of_word.setdefault(c, []).append(number[k])
                    fans = [of_word[c] for c in codes[at].tolist()]
                    sizes = np.fromiter(map(len, fans), np.int64, len(fans))
                    cell = np.repeat(rows, sizes) * len(names) + np.array([k for f in fans for k in f], np.int64)
                    cells, times = np.unique(cell, return_counts=True)
                    scores = np.bincount(cells // len(names), weight[cells % len(names)] * _weight(times), minlength=part.num_rows)
                p = model.probabilities(scores)
                p[np.diff(first) == 0] = 0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(p.round(6)), pa.list_(pa.float64()))], names=[*part.schema.names, name])

    return run


def scored(docs: DataFrame, model: Model, name: str = "p_above") -> DataFrame:
    """docs with one more column of that name: the probabilities of exceeding each grade but the last."""
    if not model.thresholds:
        return docs.withColumn(name, F.array_repeat(F.lit(0.0), GRADES - 1))
    schema = docs.withColumn(name, F.array(F.lit(0.0))).schema
    return docs.mapInArrow(_scorer(model, name), schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_above_0 to p_above_2, expected_severity, toxic and kept for each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(texts, train(docs, labels), "above")
    severity = F.round(F.aggregate("above", F.lit(0.0), lambda s, p: s + p), 6)
    return out.select("doc_id", *(F.element_at("above", k + 1).alias(f"p_above_{k}") for k in range(GRADES - 1)), severity.alias("expected_severity"), (severity >= REJECT).alias("toxic"), (severity < REJECT).alias("kept"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose expected severity is below `REJECT`."""
    (above,) = fresh(docs, "above")
    out = scored(docs.withColumn("text", F.col("text").cast("string")), train(docs, labels), above)
    return out.where(F.round(F.aggregate(above, F.lit(0.0), lambda s, p: s + p), 6) < REJECT).drop(above)
