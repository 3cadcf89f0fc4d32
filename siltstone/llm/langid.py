"""Language identification by error-correcting output codes.

Every language gets a codeword of bits; for each bit a binary linear classifier over hashed character n-grams predicts
+1 or -1. A text is decoded to the codeword with the least summed logistic loss. It is flagged as ambiguous when the runner-up is
nearly as close or the predicted bits lie outside the radius that the code corrects.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from siltstone.llm.common import map_texts

#: Hashed n-gram space, longest n-gram, labelled rows of one language that training may take (the bound of the sample).
SPACE, LONGEST, ROWS_PER_LANG = 2048, 3, 600
#: Languages that are learned (the most frequent labels), and labelled rows in all: two more bounds of the sample.
LANGS, ROWS = 100, 12_000
#: Longest exhaustive code; beyond it columns are drawn at random. Steps and rate of the training.
EXHAUSTIVE, RANDOM_BITS, STEPS, RATE, DECAY = 5, 31, 150, 0.5, 1e-5
#: A winner whose probability is below this is ambiguous.
CLEAR = 0.6
LETTER = re.compile(r"[^\W\d_]")


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: all splits of the languages for a few, else random splits with the best least distance of many draws."""
    if k < 2:
        return np.ones((k, 1), np.float32)
    if k <= EXHAUSTIVE:
        columns = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(columns, np.float32).T
    rng, best, least = np.random.default_rng(7), None, -1
    for _ in range(200):
        m = rng.choice((-1.0, 1.0), (k, RANDOM_BITS + k)).astype(np.float32)
        m = m[:, np.abs(m.sum(axis=0)) < k]
        apart = ((m.shape[1] - m @ m.T) / 2 + np.eye(k) * 1e9).min()
        if apart > least:
            best, least = m, apart
    return best


def features(texts: list[str | None]) -> np.ndarray:
    """Square roots of the shares of hashed 1- to LONGEST-grams of code points, over whole texts. Runs of non-letters count as one blank."""
    out = np.zeros((len(texts), SPACE), np.float32)
    for i, text in enumerate(texts):
        c = np.frombuffer(re.sub(r"[\W\d_]+", " ", f" {text or ''} ".lower()).encode("utf-32-le"), np.uint32)
        h, total = np.zeros(len(c), np.uint32), np.zeros(SPACE, np.int64)
        for n in range(LONGEST):
            if len(c) <= n:
                break
            h = h[: len(c) - n] * np.uint32(0x01000193) + c[n:] + np.uint32(n)
            total += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(21), minlength=SPACE)
        out[i] = np.sqrt(total / max(1, total.sum()))
    return out


class Model:
    """Languages, codewords and the weights of the bit classifiers; plain arrays, so that it travels in a closure."""

    def __init__(self, langs: list[str], codes: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.codes, self.weights, self.bias = langs, codes, weights, bias

    def decode(self, texts: list[str | None]) -> dict:
        found = [bool(t) and LETTER.search(t) is not None for t in texts]
        if not self.langs:
            return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "ambiguous": [True] * len(texts)}
        margins = features(texts) @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None, :, :]).sum(axis=2)
        chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
        chance /= chance.sum(axis=1, keepdims=True)
        best = chance.argmax(axis=1)
        wrong = (np.where(margins >= 0, 1, -1) != self.codes[best]).sum(axis=1)
        apart = (self.codes.shape[1] - self.codes @ self.codes.T) / 2 + np.eye(len(self.langs)) * 1e9
        radius = (apart.min() - 1) // 2 if len(self.langs) > 1 else self.codes.shape[1]
        score = chance[np.arange(len(texts)), best]
        vague = (score < CLEAR) & (wrong > radius) | (score < CLEAR / 1.5)
        return {
            "lang_pred": [self.langs[b] if f else "und" for b, f in zip(best, found)],
            "score": [float(s) if f else 0.0 for s, f in zip(score, found)],
            "ambiguous": [bool(v) or not f for v, f in zip(vague, found)],
        }


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """Train all bit classifiers together by full-batch logistic regression with momentum."""
    langs = sorted(set(labels))
    codes = codewords(len(langs))
    if not langs:
        return Model([], codes, np.zeros((SPACE, 1), np.float32), np.zeros(1, np.float32))
    row = {lang: i for i, lang in enumerate(langs)}
    y = codes[[row[lab] for lab in labels]]
    share = np.bincount([row[lab] for lab in labels], minlength=len(langs))
    weight = (1 / share[[row[lab] for lab in labels]] / len(langs)).astype(np.float32)[:, None]
    w, b = np.zeros((SPACE, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS):
        g = -y * weight / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        vw, vb = 0.9 * vw + x.T @ g + DECAY * w, 0.9 * vb + g.sum(axis=0)
        w, b = w - 20 * RATE * vw, b - RATE * vb
    return Model(langs, codes, w.astype(np.float32), b.astype(np.float32))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG, langs: int = LANGS, rows_in_all: int = ROWS, id_col: str = "doc_id") -> Model:
    """Fit on at most ``rows_per_lang`` rows of each language, chosen by a hash of text and id; rows without text or label are left out.

    The row with the least hash of each language is always among those looked at, so a language is learned whatever its rows,
    even if they all are the same one. ``id_col`` may be missing.

    Of many labels the ``langs`` most frequent are learned, ties in their order, each from its share of ``rows_in_all``
    rows at most. Features are computed in Spark; the driver gets one short vector of each chosen row. No labelled row
    gives a model without languages. Equal texts are taken as often as they stand there.
    """
    of_row = [F.col(f"`{text_col}`"), *([F.col(f"`{id_col}`")] if id_col in labelled.columns else [])]
    rows = labelled.select(F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").alias("_lang"), F.xxhash64(*of_row).alias("_dice")).where("_text is not null and _lang is not null")
    sizes = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("count"), F.min("_dice").alias("least")).orderBy(F.desc("count"), "_lang").limit(langs).collect()
    per_lang = min(rows_per_lang, rows_in_all // max(1, len(sizes)))
    fields = [rows.schema["_lang"], T.StructField("count", T.LongType()), T.StructField("least", T.LongType())]
    known = labelled.sparkSession.createDataFrame([tuple(r) for r in sizes], T.StructType(fields))
    share = F.pmod("_dice", F.lit(1 << 20)) / F.lit(float(1 << 20))
    near = rows.join(F.broadcast(known), "_lang").where((share < F.lit(2.0 * per_lang) / F.col("count")) | (F.col("_dice") == F.col("least")))  # ``langs`` rows at most
    chosen = near.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy("_dice", "_text"))).where(F.col("_rank") <= per_lang)

    def make():
        return lambda texts: {"x": [v.astype(np.float16).tobytes() for v in features(texts)]}

    got = map_texts(chosen, ["_lang"], "_text", make, T.StructType([T.StructField("x", T.BinaryType(), False)])).toArrow().to_pydict()
    order = sorted(range(len(got["_lang"])), key=lambda i: (got["_lang"][i], bytes(got["x"][i])))
    x = np.stack([np.frombuffer(got["x"][i], np.float16) for i in order]).astype(np.float32) if order else np.zeros((0, SPACE), np.float32)
    return fit(x, [got["_lang"][i] for i in order])


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``ambiguous``. Only the text is an input of the prediction.

    Null texts and texts without a letter are ``und`` with score 0 and ambiguous. If nothing was learned all are. Texts of
    any length count whole; repeated rows get equal results; languages that are equally near go to the first in order; an
    empty table gives an empty result. A kept column with the name of an added one gives way to it.
    """
    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return map_texts(docs, keep, text_col, lambda: model.decode, added)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; null for a null id, which is neither learned from nor held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def op3(docs: DataFrame) -> DataFrame:
    model = train(docs.where(fold() != 1))
    found = identify(docs.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
