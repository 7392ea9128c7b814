"""Language identification in two steps: the family first, then one-versus-one linear
support vector machines between the languages of that family."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_name, without

#: Families of language codes; a code that is not here is a family of its own.
FAMILIES = {
    "de": "germanic", "en": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
}

#: Hashed features: byte pairs and byte triples of the text.
FEATURES = 1 << 12
#: The bound of the training sample: at most this many labelled documents of each language.
SAMPLE_PER_LANGUAGE = 600
#: The bound of the whole sample: with more languages than 16, each gets an even part of it (16 KiB a document on the driver).
SAMPLE_TOTAL = 9600
_CHUNK = 1 << 20
_MAYBE_LETTER = re.compile(r"[^\W\d_]")  # also matches numerals such as ½, which are no letters
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32  # A-Z to a-z
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD[48:58] = 48


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _MAYBE_LETTER.finditer(text))


def featurise(text: str) -> np.ndarray:
    """Square roots of hashed byte n-gram counts over the whole text, of length 1."""
    counts = np.zeros(FEATURES, np.float64)
    raw = text.encode("utf-8", "surrogatepass")
    for at in range(0, max(1, len(raw)), _CHUNK):  # two bytes of overlap: every n-gram once
        b = _FOLD[np.frombuffer(b" " + raw[:_CHUNK] if at == 0 else raw[at - 2 : at + _CHUNK], np.uint8)]
        pairs, triples = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B), None
        if len(b) > 2:
            triples = pairs[:-1] * np.uint32(0xC2B2AE35) + b[2:] * np.uint32(0x27D4EB2F)
            counts += np.bincount(triples >> np.uint32(20), minlength=FEATURES)
        own = pairs if at == 0 else pairs[1:]
        counts += np.bincount((own * np.uint32(0x165667B1)) >> np.uint32(20), minlength=FEATURES)
    out = np.sqrt(counts)
    return (out / max(1e-12, float(np.linalg.norm(out)))).astype(np.float32)


def _fit_svm(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, rounds: int = 40, penalty: float = 1e-4, seed: int = 9) -> np.ndarray:
    """A linear SVM (squared hinge, averaged stochastic steps) of some ``rows``; the last weight is the bias.

    Only a step's rows are copied, so memory stays that of ``x``.
    """
    rows = np.arange(len(x)) if rows is None else rows
    w, bias, rng = np.zeros(x.shape[1]), 0.0, np.random.default_rng(seed)
    total, total_bias, steps = np.zeros_like(w), 0.0, 0
    own = y[rows]
    weight = np.where(own > 0, 0.5 / max(1, (own > 0).sum()), 0.5 / max(1, (own < 0).sum())) * len(own)
    for k in range(rounds):
        rate = 2.0 / (1.0 + 0.1 * k)
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            some = x[rows[at]].astype(np.float64)
            pull = 2.0 * np.maximum(0.0, 1.0 - own[at] * (some @ w + bias)) * own[at] * weight[at] / len(at)
            w -= rate * (penalty * w - pull @ some)
            bias -= rate * (penalty * bias - pull.sum())
            if k >= rounds // 2:
                total, total_bias, steps = total + w, total_bias + bias, steps + 1
    return np.append(total, total_bias) / max(1, steps)


@dataclass
class LanguageModel:
    """Linear machines: one for each family against the rest, one for each pair within a family."""

    languages: list[str] = field(default_factory=list)
    families: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str], families: dict[str, str] = FAMILIES) -> LanguageModel:
        model = cls(languages=sorted(set(langs)))
        for lang in model.languages:
            model.families.setdefault(families.get(lang, f"only {lang}"), []).append(lang)
        own = np.array(langs, dtype=object)
        family = np.array([families.get(lang, f"only {lang}") for lang in langs], dtype=object)
        if len(model.families) > 1:
            model.family_weights = np.stack([_fit_svm(x, np.where(family == f, 1.0, -1.0)) for f in model.families])
        for members in model.families.values():
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    rows = np.flatnonzero((own == a) | (own == b))
                    model.pair_weights[a, b] = _fit_svm(x, np.where(own == a, 1.0, -1.0), rows)
        return model

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        x = np.append(featurise(text), 1.0)
        names, sure = list(self.families), 1.0
        if self.family_weights is not None:
            margins = self.family_weights @ x
            best = int(np.argmax(margins))
            sure, members = _logistic(margins[best]), self.families[names[best]]
        else:
            members = self.families[names[0]]
        if len(members) == 1:
            return members[0], sure
        votes = dict.fromkeys(members, 0.0)
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                p = _logistic(self.pair_weights[a, b] @ x)
                votes[a] += p
                votes[b] += 1.0 - p
        lang = max(members, key=votes.__getitem__)
        return lang, float(sure * votes[lang] / (len(members) - 1))


def _logistic(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-4.0 * np.clip(margin, -50, 50))))


def held_out():
    """Documents that training never sees: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, families: dict[str, str] = FAMILIES, at_most: int = SAMPLE_TOTAL) -> LanguageModel:
    """Fit on at most ``per_language`` labelled documents of each language and ``at_most`` of all (two of each at least).

    Reads ``doc_id, text, lang``; rows with a null label, without a letter in the text or in
    the held-out part are not learned from. The sample is the documents with the smallest
    hashes of ids and texts, found by a threshold from the counts of the labels, and only their
    feature vectors reach the driver. Rows without an id are drawn by their texts; of rows that
    agree in id, text and label one is learned from.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.where(F.col("lang").isNotNull() & ~held_out() & (F.col("lang") != "und"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return LanguageModel()
    per_language = max(2, min(per_language, at_most // len(counts)))
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, (1.3 * per_language + 30) / n))])
    key = F.xxhash64(F.lit("language"), "doc_id", "text")
    draw = F.pmod("key", F.lit(1 << 30)) / float(1 << 30)
    first = Window.partitionBy("lang").orderBy("draw", "key")
    drawn = labelled.withColumn("key", key).withColumn("draw", draw).where((F.col("draw") < F.element_at(share, F.col("lang"))) & F.col("text").isNotNull())
    sample = drawn.dropDuplicates(["lang", "key"])  # each task sends a repeated row once

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = b[[has_letter(t) for t in b["text"]]]
            yield pd.DataFrame({"key": keep["key"], "lang": keep["lang"], "draw": keep["draw"], "x": [featurise(t).tobytes() for t in keep["text"]]})

    rows = sample.select("key", "lang", "draw", "text").mapInPandas(features, "key long, lang string, draw double, x binary")
    rows = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language).orderBy("lang", "rank").select("lang", "x").collect()
    if not rows:
        return LanguageModel()
    return LanguageModel.fit(np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), [r["lang"] for r in rows], families)


def _predictor(spark: SparkSession, model: LanguageModel):
    shared = spark.sparkContext.broadcast(model)  # a few vectors of FEATURES weights

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        return pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(F.col("text").cast("string"))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to all columns of ``docs``, from the whole ``text`` alone.

    A null text, an empty one or one without a letter is ``und`` with score 0; so is every
    text if the model learned no language. Repeated rows get the same answer; columns of
    these names are replaced; an empty table stays empty.
    """
    docs, found = without(docs, "lang_pred", "score"), scratch_name(docs, "found")
    marked = docs.withColumn(found, _predictor(docs.sparkSession, model))
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{found}.lang_pred").alias("lang_pred"), F.col(f"{found}.score").alias("score"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which a language is found; ``und`` goes.

    Without any label to learn from, the documents with a letter stay.
    """
    model = train(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    found = scratch_name(docs, "found")
    return docs.withColumn(found, _predictor(docs.sparkSession, model)).where(F.col(f"{found}.lang_pred") != "und").drop(found)
