"""Language identification by hierarchical discrimination.

First the language family is predicted, then one-versus-one linear support vector machines separate the
languages within it; families are told apart one-versus-one as well.  Features: hashed counts of
2- and 3-grams of the lower-cased text's UTF-8 bytes, square-rooted and scaled to length 1.

The machines are fitted on the driver with at most ``PER_LANGUAGE`` labelled rows a language (a bounded
sample, spread by a hash of doc_id); what comes to the driver are fixed-size vectors.  Prediction reads
whole texts and needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import batches
from .columns import set_aside

PER_LANGUAGE = 300  # labelled rows a language that a model is fitted on
WINDOWS = 3  # parts of such a row, spread over its text, that count as short examples
WINDOW_CHARS = (40, 160)
BITS = 11
UNKNOWN = "und"
MIN_SCORE = 0.55  # the pipeline rejects texts below

#: Language families.  A language that is in none is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def features(text: str) -> np.ndarray:
    """The vector of a whole text; zeros for an empty one."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    size = 1 << BITS
    x = np.zeros(size)
    for order, factors in ((2, (2654435761, 40503)), (3, (2246822519, 3266489917, 668265263))):
        if len(b) >= order:
            h = np.zeros(len(b) - order + 1, np.uint32)
            for k, f in enumerate(factors):
                h += b[k : len(b) - order + 1 + k] * np.uint32(f)
            x += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(2654435769) >> np.uint32(32 - BITS), minlength=size)
    x = np.sqrt(x)
    norm = np.sqrt(x @ x)
    return (x / norm if norm else x).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, steps: int = 250) -> tuple[np.ndarray, float]:
    """Weights of a linear machine with squared hinge loss, y in -1 and 1, by accelerated gradient steps, and the
    slope that turns a margin into a probability.  The last feature is 1, its weight the bias."""
    x1 = x
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x1.dtype)  # both sides count alike
    y = y.astype(x1.dtype)  # else every product would copy x1 as doubles
    step = 1.0 / (4.0 + strength)  # of the loss's curvature: 2 * |x|^2, where |x|^2 is 2
    w = v = np.zeros(x1.shape[1], x1.dtype)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        new = v - x1.dtype.type(step) * (x1.dtype.type(strength) * v - 2 * ((weight * y * slack) @ x1))
        w, v = new, new + x1.dtype.type(t / (t + 3)) * (new - w)
    margin, slope = y * (x1 @ w), 1.0
    for _ in range(50):  # Newton on the logistic loss, held at 20 where the sides are apart
        p = 1 / (1 + np.exp(-np.clip(slope * margin, -30, 30)))
        slope += (weight * margin * (1 - p)).sum() / max((weight * margin**2 * p * (1 - p)).sum(), 1e-9)
        slope = min(max(slope, 0.5), 20.0)
    return w.astype(np.float32), slope


@dataclass
class OneVersusOne:
    """Linear machines for each pair of ``names``; few names, so few machines."""

    names: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, (1 << BITS) + 1), np.float32))
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> OneVersusOne:
        names, made = sorted(set(labels)), []
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                own = (labels == a) | (labels == b)
                made.append(fit_svm(x if own.all() else x[own], np.where(labels[own] == a, 1.0, -1.0)))
        return cls(names, np.array([w for w, _ in made]), np.array([s for _, s in made])) if made else cls(names)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The name with most probability over its pairs, and the mean of that; ties go by name."""
        n = len(self.names)
        if n == 1:
            return self.names[0], 1.0
        p = 1 / (1 + np.exp(-np.clip(self.slopes * (self.weights[:, :-1] @ x + self.weights[:, -1]), -30, 30)))
        votes, k = np.zeros(n), 0
        for i in range(n):
            for j in range(i + 1, n):
                votes[i] += p[k]
                votes[j] += 1 - p[k]
                k += 1
        best = int(votes.argmax())
        return self.names[best], float(votes[best] / (n - 1))


@dataclass
class LanguageModel:
    """Families, then the languages of each."""

    families: OneVersusOne | None
    languages: dict[str, OneVersusOne]

    @classmethod
    def fit(cls, x: np.ndarray, langs: np.ndarray) -> LanguageModel:
        """x: a row of features an example, and a last column of ones."""
        if not len(langs):
            return cls(None, {})
        families = np.array([family_of(v) for v in langs])
        return cls(OneVersusOne.fit(x, families), {f: OneVersusOne.fit(x[families == f], langs[families == f]) for f in sorted(set(families))})

    def predict(self, text: str | None) -> tuple[str, float]:
        if self.families is None or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        x = features(text)
        family, p = self.families.predict(x)
        lang, q = self.languages[family].predict(x)
        return lang, min(max(p * q, 0.0), 1.0)


def _examples(text: str) -> list[np.ndarray]:
    """The whole text and some windows over it, at places that its length alone decides."""
    out, rng = [features(text)], np.random.default_rng(len(text))
    for _ in range(WINDOWS):
        long = int(rng.integers(*WINDOW_CHARS))
        at = int(rng.integers(0, max(1, len(text) - long)))
        part = text[at : at + long]
        if any(map(str.isalpha, part)):
            out.append(features(part))
    return out


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model from rows with text and non-null lang (doc_id, text, lang); other rows are left out.

    Two passes: counts by language over doc_id and lang alone, then the rows whose hash of doc_id is
    low enough that about 1.5 * per_language of each language are left, of which the first
    per_language by that hash are taken.  With no labelled rows the model answers ``und``.
    """
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    span = 1 << 30
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return LanguageModel(None, {})
    limit = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(span, int(span * (1.5 * per_language + 20) / n)))])
    chosen = rows.withColumn("spread", spread).where(F.col("spread") < F.element_at(limit, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("spread", "doc_id", "text")
    chosen = chosen.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language)

    def vectors(parts):
        schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("i", pa.int32()), ("x", pa.binary())])
        for batch in parts:
            for at, n in batches.parts(batch["text"], limit=batches.SLICE // 16):
                made = [{"lang": r["lang"], "k": r["k"], "i": i, "x": x.tobytes()} for r in batch.slice(at, n).to_pylist() for i, x in enumerate(_examples(r["text"]))]
                yield pa.RecordBatch.from_pylist(made, schema)

    batches.use(labelled.sparkSession)
    got = chosen.select("lang", "k", "text").mapInArrow(vectors, "lang string, k int, i int, x binary").toPandas()
    got = got.sort_values(["lang", "k", "i"])
    if got.empty:
        return LanguageModel(None, {})
    x = np.ones((len(got), (1 << BITS) + 1), np.float32)
    for i, own in enumerate(got.x):
        x[i, :-1] = np.frombuffer(own, np.float32)
    langs = got.lang.to_numpy(str)
    del got
    model = LanguageModel.fit(x, langs)
    del x
    batches.release()  # this runs on the driver
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced); only ``text`` is read.

    Null texts, and texts without a letter, get ``und`` and 0.  Equal texts get equal answers.
    """

    @F.arrow_udf("lang_pred string, score double")
    def predicted(texts: pa.Array) -> pa.Array:
        told = [dict(zip(("lang_pred", "score"), model.predict(t), strict=True)) for some in batches.texts(texts) for t in some]
        batches.release()
        return pa.array(told, pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    batches.use(docs.sparkSession)
    kept, back = set_aside(docs.drop("lang_pred", "score"), ["_lang"])
    return back(kept.withColumn("_lang", predicted("text")).select(*[F.col(f"`{c}`") for c in kept.columns], "_lang.lang_pred", "_lang.score"))
