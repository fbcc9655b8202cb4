"""Quality classification from positive and unlabelled texts.

The classifier minimises the non-negative unbiased risk: with prior p of good text, p * (loss of trusted positives as
positive) + max(0, (loss of unlabelled as negative) - p * (loss of positives as negative)). Where the second part turns
negative the classifier has begun to learn the unlabelled texts by heart, and the step goes up that part instead. The
prior is estimated from the labels of a sample. It is fitted on the driver, on bounded samples; scoring runs where the
texts are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import eased, lean, raw, schema_of

NAMES = (
    "log_bytes upper lower digit space newline high sentence_marks pipes brackets other_marks control "
    "mean_word long_words one_letter distinct_words top_word top_three distinct_pairs marked_words "
    "bare_marks capitalised mean_line distinct_lines words_in_top_line letters_per_word"
).split()

_byte = np.arange(256)
_CLASSES = np.stack([
    (_byte >= 65) & (_byte <= 90),
    (_byte >= 97) & (_byte <= 122),
    (_byte >= 48) & (_byte <= 57),
    _byte == 32,
    _byte == 10,
    _byte >= 128,
    np.isin(_byte, list(b".,;:!?'\"-")),
    _byte == ord("|"),
    np.isin(_byte, list(b"()[]{}<>/\\=_")),
    np.isin(_byte, list(b"#$%&*+@^`~")),
    (_byte < 32) & ~np.isin(_byte, [9, 10, 13]) | (_byte == 127),
]).astype(float)
_MARKS = bytes(i for i in range(33, 127) if not chr(i).isalnum())


def features(text: bytes) -> np.ndarray:
    """The features of NAMES, of the whole text; zeros for an empty one."""
    out = np.zeros(len(NAMES))
    words = text.split()
    if not words:
        return out
    n, total = len(words), len(text)
    out[0] = np.log1p(total)
    out[1:12] = _CLASSES @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / total
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    top = counts.most_common(3)
    plain = [w.strip(_MARKS) for w in words]
    lines = [x for x in text.split(b"\n") if x.strip()]
    top_line, times = Counter(lines).most_common(1)[0]
    stripped = np.fromiter(map(len, plain), np.int64, n)
    out[12:] = (
        min(sizes.mean(), 50),
        (sizes > 20).mean(),
        (sizes == 1).mean(),
        len(counts) / n,
        top[0][1] / n,
        sum(x[1] for x in top) / n,
        len(set(zip(words, words[1:]))) / max(n - 1, 1),
        (sizes - stripped >= 2).mean(),
        (stripped == 0).mean(),
        sum(w[:1].isupper() for w in words) / n,
        np.log1p(n / len(lines)),
        len(set(lines)) / len(lines),
        times * len(top_line) / total if times > 1 else 0.0,
        min(stripped.mean(), 50),
    )
    return out


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]

    def margins(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        w1, b1, w2, b2 = self.layers
        return np.tanh(z @ w1 + b1) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, units: int = 16, epochs: int = 120, batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimises the non-negative risk of a network with one hidden layer by Adam."""
    rng = np.random.default_rng(seed)
    centre = np.median(unlabelled, 0)
    scale = np.maximum(np.quantile(unlabelled, 0.9, 0) - np.quantile(unlabelled, 0.1, 0), 1e-3)
    model = Model(centre, scale, [rng.normal(0, positive.shape[1] ** -0.5, (positive.shape[1], units)), np.zeros(units), rng.normal(0, units**-0.5, units), np.zeros(1)])
    first, second = [np.zeros_like(p) for p in model.layers], [np.zeros_like(p) for p in model.layers]
    mean = [np.zeros_like(p) for p in model.layers]
    zp, zu = (np.clip((x - centre) / scale, -6, 6) for x in (positive, unlabelled))
    step = averaged = 0
    for epoch in range(epochs):
        order_p, order_u = rng.permutation(len(zp)), rng.permutation(len(zu))
        for k in range(0, len(zu), batch):
            u = zu[order_u[k : k + batch]]
            p = zp[order_p[np.arange(k, k + len(u)) % len(zp)]]
            x = np.concatenate((p, u))
            w1, b1, w2, b2 = model.layers
            hidden = np.tanh(x @ w1 + b1)
            g = np.clip(hidden @ w2 + b2[0], -30, 30)
            s = 1 / (1 + np.exp(-g))
            m = len(p)
            negative = np.logaddexp(0, g)  # the logistic loss of calling a text negative
            rest = negative[m:].mean() - prior * negative[:m].mean()
            d = np.zeros(len(x))
            if rest >= 0:
                d[:m] = prior * (s[:m] - 1) / m - prior * s[:m] / m
                d[m:] = s[m:] / len(u)
            else:
                d[:m] = prior * s[:m] / m
                d[m:] = -s[m:] / len(u)
            back = np.outer(d, w2) * (1 - hidden**2)
            grads = [x.T @ back + decay * w1, back.sum(0), hidden.T @ d + decay * w2, np.array([d.sum()])]
            step += 1
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                model.layers[i] = model.layers[i] - rate * (1 - epoch / epochs) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        if epoch >= epochs // 2:
            averaged += 1
            mean = [a + (b - a) / averaged for a, b in zip(mean, model.layers)]
    model.layers = mean
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t or b"").tolist() for t in raw(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(rows, pa.list_(pa.float64()))], ["kind", "x"])


def _draw(key: str, most: int, of: int) -> Column:
    """True for about `most` of `of` rows at most, by a hash of the key."""
    return F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < F.lit(int(min(1.0, most / max(of, 1)) * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000) -> Model | None:
    """A model from labels (doc_id, quality) and the texts of docs; both hold training rows only. About `positives` trusted
    and `unlabelled` unlabelled texts are used at most. None if there is no positive label or no text."""
    spark = lean(docs).sparkSession
    counts = labels.where("quality is not null and doc_id is not null").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good")).first()
    n_docs = docs.count()
    if not counts["good"] or not n_docs:
        return None
    prior = min(max(counts["good"] / counts["n"], 0.02), 0.98)
    trusted = labels.where("quality = 1").where(_draw("doc_id", positives, counts["good"])).select("doc_id").distinct()
    ids = [r["doc_id"] for r in trusted.collect()]  # about `positives` rows
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("doc_id", labels.schema["doc_id"].dataType)])))
    texts = docs.select("doc_id", "text")
    good = texts.join(chosen, "doc_id", "left_semi").select(F.lit(1).alias("kind"), "text")
    others = texts.where(_draw("doc_id", unlabelled, n_docs)).select(F.lit(0).alias("kind"), "text")
    found = good.union(others).mapInArrow(_featured, "kind int, x array<double>").toArrow()
    kinds = found.column("kind").to_numpy()
    x = np.array(found.column("x").to_pylist()).reshape(len(kinds), len(NAMES))
    order = np.lexsort(x.T)
    kinds, x = kinds[order], x[order]
    if not (kinds == 1).any() or not (kinds == 0).any():
        return None
    return fit(x[kinds == 1], x[kinds == 0], prior)


def scored(docs: DataFrame, model: Model | None, to: str = "quality_score") -> DataFrame:
    """docs with a column `to`, 0 to 1, of the whole text; null texts count as empty; 0.5 without a model."""
    given = lean(docs).sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())])

    @eased
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if given.value is None:
                scores = np.full(batch.num_rows, 0.5)
            elif batch.num_rows:
                scores = given.value.scores(np.stack([features(t or b"") for t in raw(batch.column("text"))]))
            else:
                scores = np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, to])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted (1 from the threshold on). Learns only from rows, of
    both tables, for which held_out, a column of doc_id, is false; scores read the text alone. A document without doc_id
    is never learned from. Equal rows score alike; empty tables give no rows or an even score."""
    model = train(docs.where(~held_out), labels.where(~held_out))
    out = scored(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
    return out.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
