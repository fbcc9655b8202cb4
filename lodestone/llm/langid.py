"""Language identification in two steps: the family first, then one-versus-one linear support vector machines inside it.

Texts are hashed counts of their 2- to 4-byte strings, damped and of unit length. Machines are trained on the driver on a
bounded sample of labelled documents; prediction runs where the texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lean, schema_of

#: Families of languages by code. A language that is in none is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg"],
}
FEATURES = 4096
_OTHERS = bytes(32 if b < 128 and not 97 <= b <= 122 else b for b in range(256))
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is of a Unicode category of letters; numerals such as a half or a raised two are not."""
    return any(m.group().isalpha() for m in _WORDLIKE.finditer(text))


#: Bytes hashed at a time.
SEGMENT = 1 << 20


def features(text: str) -> np.ndarray | None:
    """The unit vector of a text; None if it has no letter."""
    data = text.lower().encode().translate(_OTHERS)
    if not data.strip() or not (re.search(rb"[a-z]", data) or has_letter(text)):
        return None
    out = np.zeros(FEATURES)
    for s in range(0, len(data), SEGMENT):
        x = np.frombuffer(b" " * (s == 0) + data[s : s + SEGMENT + 3] + b" " * (s + SEGMENT >= len(data)), np.uint8).astype(np.uint32)
        h = x
        for n in (2, 3, 4):
            h = h[:-1] * np.uint32(0x01000193) + x[n - 1 :]
            own = h[: SEGMENT + (s == 0)]
            out += np.bincount(((own * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64), minlength=FEATURES)
            if len(h) < 2:
                break
    out = np.sqrt(out)
    return (out / np.linalg.norm(out)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias with the least |w|**2 / 2 + c * mean squared hinge loss, classes weighted to be equal; y is -1 or 1."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    at, at_b, rate = w.copy(), b, 1 / (1 + 4 * c)
    for t in range(steps):
        gap = np.maximum(0, 1 - y * (x @ at + at_b)) * weight * y
        new, new_b = at - rate * (at - 2 * c * (gap @ x)), at_b + rate * 2 * c * gap.sum()
        k = t / (t + 3)
        at, at_b = new + k * (new - w), new_b + k * (new_b - b)
        w, b = new, float(new_b)
    return w, b


@dataclass
class Model:
    families: list[list[str]]
    family_machines: list[tuple[np.ndarray, float]] = field(default_factory=list)
    machines: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language, and the confidence: the family's share times the mean certainty of the won comparisons."""
        if len(self.families) > 1:
            s = np.array([x @ w + b for w, b in self.family_machines])
            p = np.exp(3 * (s - s.max()))
            best = int(p.argmax())
            share = float(p[best] / p.sum())
        else:
            best, share = 0, 1.0
        own = self.families[best]
        sure = {a: [] for a in own}
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                w, bias = self.machines[a, b]
                p = 1 / (1 + float(np.exp(-3 * (x @ w + bias))))
                sure[a].append(p)
                sure[b].append(1 - p)
        won = max(own, key=lambda a: (sum(p > 0.5 for p in sure[a]), sum(sure[a])))
        return won, share * (sum(sure[won]) / len(sure[won]) if sure[won] else 1.0)


def fit(rows: list[tuple[str, np.ndarray]], families: dict[str, list[str]] = FAMILIES) -> Model | None:
    """None without rows."""
    if not rows:
        return None
    langs, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    named = {lang: name for name, own in families.items() for lang in own}
    groups: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        groups.setdefault(named.get(lang, f"alone: {lang}"), []).append(str(lang))
    model = Model([groups[k] for k in sorted(groups)])
    if len(model.families) > 1:
        model.family_machines = [linear_svm(x, np.where(np.isin(langs, own), 1, -1).astype(np.float32)) for own in model.families]
    for own in model.families:
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                at = (langs == a) | (langs == b)
                model.machines[a, b] = linear_svm(x[at], np.where(langs[at] == a, 1, -1).astype(np.float32))
    return model


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(lang, v.tobytes()) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text")) if (v := features(t.as_py())) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary())], ["lang", "vector"])


def train(docs: DataFrame, rows: int = 2400) -> Model | None:
    """A model from the labelled rows of docs (text, lang, doc_id); about `rows` of them at most are used, as many of each
    language as there are, up to an equal share; which, a hash of doc_id decides."""
    labelled = lean(docs).where("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = rows / len(counts)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, share / n))))
    sample = labelled.where(draw < part[F.col("lang")]).select("lang", "text")
    found = sample.mapInArrow(_vectors, "lang string, vector binary").toArrow()
    return fit(sorted(((a, np.frombuffer(b, np.float32)) for a, b in zip(found.column("lang").to_pylist(), found.column("vector").to_pylist())), key=lambda x: (x[0], x[1].tobytes())))


def identify(docs: DataFrame, model: Model | None, held_out: Column) -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score. `und` with score 0 for a text that is null or has no
    letter, or without a model. Letters are what Unicode's categories L* name. Only doc_id and text are read, and of these
    only the text is predicted from. Equal rows get equal results; an empty table gives no rows; texts of any length are
    read whole, a segment at a time; of languages that win as many comparisons the surer one is taken, then the first by
    name."""
    given = lean(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [m.predict(v) if (m := given.value) and (v := features(t.as_py() or "")) is not None else ("und", 0.0) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, schema_of(docs, "held_out boolean, lang_pred string, score double"))
