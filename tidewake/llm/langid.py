"""Language identification: a family first, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ngrams
from .batches import map_batches, whole_texts

# Language families by code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "af", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "indic": ("hi", "bn", "mr", "ne", "ur", "pa", "gu"),
}
BITS = 13
ORDERS = (1, 2, 3)
#: The models are fitted on at most this many labelled rows, shared evenly by the languages (see fit). All
#: other work covers every row.
TRAIN_ROWS = 1200
UNDETERMINED = "und"


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), "=" + lang)


def _slots(text: str) -> np.ndarray:
    return ngrams.hashed(text.lower(), BITS, ORDERS)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model:
    """Linear weights over n-gram shares: softmax over families, hinge-loss margins for pairs of languages.

    x (a row a text, a column a slot) is overwritten."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs = langs
        self.families = sorted({family_of(v) for v in langs})
        self.members = {f: [i for i, v in enumerate(langs) if family_of(v) == f] for f in self.families}
        scale = np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + np.float32(1e-5)
        z = np.divide(x, scale, out=x)
        in_family = np.array([self.families.index(family_of(v)) for v in langs])[y]
        columns, biases = [], []
        w, b = _softmax_fit(z, in_family, len(self.families))
        columns += list(w.T)
        biases += list(b)
        self.pairs: list[tuple[int, int]] = []
        for f in self.families:
            for i, j in combinations(self.members[f], 2):
                rows = (y == i) | (y == j)
                w, b = _svm_fit(z[rows], np.where(y[rows] == i, 1.0, -1.0))
                self.pairs.append((i, j))
                columns.append(w)
                biases.append(b)
        self.weights = (np.stack(columns, 1) / scale[:, None]).astype(np.float32)
        self.bias = np.array(biases)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return UNDETERMINED, 0.0
        slots = _slots(text)
        total = np.zeros(self.weights.shape[1])
        for at in range(0, len(slots), 65536):
            total += self.weights[slots[at : at + 65536]].sum(0, dtype=np.float64)
        out = total / max(1, len(slots)) + self.bias
        k = len(self.families)
        p = np.exp(out[:k] - out[:k].max())
        p /= p.sum()
        best = int(p.argmax())
        members = self.members[self.families[best]]
        if len(members) == 1:
            return self.langs[members[0]], float(p[best])
        votes, sure = dict.fromkeys(members, 0), dict.fromkeys(members, 1.0)
        for (i, j), margin in zip(self.pairs, out[k:]):
            if i in votes:
                won = float(1 / (1 + np.exp(-2 * np.clip(margin, -20, 20))))
                votes[i if margin >= 0 else j] += 1
                sure[i], sure[j] = min(sure[i], won), min(sure[j], 1 - won)
        lang = max(members, key=lambda i: (votes[i], sure[i], -i))
        return self.langs[lang], float(p[best] * sure[lang])


def _softmax_fit(z: np.ndarray, y: np.ndarray, k: int, steps: int = 60, rate: float = 2.0, decay: float = 1e-4):
    w, b, one_hot = np.zeros((z.shape[1], k), z.dtype), np.zeros(k, z.dtype), np.eye(k, dtype=z.dtype)[y]
    rate /= max(1e-9, float(np.vdot(z, z)) / len(z))
    weight = (1 / (np.bincount(y, minlength=k)[y] * k)).astype(z.dtype)
    for _ in range(steps if k > 1 else 0):
        s = z @ w + b
        s = np.exp(s - s.max(1, keepdims=True))
        g = (s / s.sum(1, keepdims=True) - one_hot) * weight[:, None] * k
        w -= rate * (z.T @ g + decay * w) * 20
        b -= rate * g.sum(0)
    return w, b


def _svm_fit(z: np.ndarray, y: np.ndarray, steps: int = 80, decay: float = 1e-3):
    """Squared hinge loss with an L2 penalty, by full gradients with momentum."""
    y = y.astype(z.dtype)
    w, b, vw, vb = np.zeros(z.shape[1], z.dtype), 0.0, 0.0, 0.0
    rate = 0.5 / max(1e-9, float(np.vdot(z, z)) / len(z))
    for _ in range(steps):
        g = -y * np.maximum(0, 1 - y * (z @ w + b)) / len(y)
        vw = 0.9 * vw + z.T @ g + decay * w / len(y)
        vb = 0.9 * vb + g.sum()
        w, b = w - rate * vw, b - rate * vb
    return w, b


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on text and lang of labelled rows (null texts, null langs and texts without letters are left out).

    Of each language the same number of texts is drawn, at most `rows` in all (one a language at least): those
    of the least hashes of doc_id and text, so that null or repeated doc_ids are drawn like any others, and a
    repeated row once. n-grams of the drawn whole texts are counted on the executors; only these counts come to
    the driver. None if nothing is labelled."""
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    known = labelled.select(lang.alias("lang"), text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text, F.lit("train")).alias("draw"))
    known = known.filter("lang is not null and text is not null")
    with_letter = known.filter(F.col("text").rlike(r"\p{L}"))
    counts = with_letter.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()  # a row a language
    if not counts:
        return None
    each = max(1, rows // len(counts))
    # a few times as many as needed come near the least hashes; of these the least are taken
    share = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, (4 * each + 40) / max(1, r["n"]))) for r in counts], "lang string, share double")
    some = with_letter.join(F.broadcast(share), "lang").filter(F.pmod("draw", F.lit(1 << 30)) < F.col("share") * (1 << 30)).groupBy("lang", "draw").count()
    least = Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 30)), "draw")
    drawn = some.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= each).select("lang", "draw")  # at most rows, or one a language
    picked = with_letter.join(F.broadcast(drawn), ["lang", "draw"]).groupBy("lang", "draw").agg(F.first("text").alias("text"))

    def features(lang, texts):
        out = [np.unique(_slots(t), return_counts=True) if has_letter(t) else (np.empty(0, int), np.empty(0, int)) for t in texts]
        return lang, [s.tolist() for s, _ in out], [n.tolist() for _, n in out]

    table = map_batches(picked.select("lang", "text"), features, "lang string, slots array<int>, n array<int>").toArrow()
    found = [(v, s.values.to_numpy(), n.values.to_numpy()) for v, s, n in zip(table["lang"].to_pylist(), table["slots"], table["n"]) if len(s)]
    langs = sorted({v for v, _, _ in found})
    if not langs:
        return None
    found.sort(key=lambda r: (r[0], r[1].astype(">u4").tobytes(), r[2].astype(">u4").tobytes()))  # as lists of numbers
    x, y = np.zeros((len(found), 1 << BITS), dtype=np.float32), np.empty(len(found), dtype=int)
    for i, (lang, slots, n) in enumerate(found):
        x[i, slots] = n / n.sum()
        y[i] = langs.index(lang)
    return Model(langs, x, y)


def predict_languages(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of each whole text; score (0 to 1) is the family's probability times
    the surest pairwise decision that the language had to win.

    A null text, and one without a letter, gets `und` and 0; so does every row if there is no model.
    Only doc_id and text are read. A null doc_id and repeated rows come through. No shuffle."""

    def predict(ids, texts):
        out = [model.predict(t) if model else (UNDETERMINED, 0.0) for t in texts]
        return ids, [v for v, _ in out], [s for _, s in out]

    return map_batches(whole_texts(docs), predict, "doc_id long, lang_pred string, score double")


def label_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """All rows and columns of docs, with the prediction from the whole text in place of lang."""
    names = docs.columns
    text, lang = names.index("text"), names.index("lang")

    def label(*columns):
        out = list(columns)
        out[lang] = [model.predict(t)[0] if model else UNDETERMINED for t in columns[text]]
        return out

    return map_batches(docs, label, docs.schema)


def held_out(doc_id) -> "F.Column":
    """Whether crc32 of doc_id as text has remainder 2 by 4 (a null doc_id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return predict_languages(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
