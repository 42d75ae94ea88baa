"""Toxicity scores by a classifier that is trained not to react to who is named.

A logistic regression over words and their beginnings.  Each training sentence
that names a group is paired with the same sentence naming another group of the
same kind, and the squared change of the score between the two is added to the
loss: what a sentence says counts, whom it says it about does not.

Training reads a bounded sample of labelled rows (``max_train``, chosen by a
hash of the id); scoring is a map over all documents and shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import Remembered, bound_batches, materialize

#: Labelled rows that a classifier is fitted on at most.
MAX_TRAIN = 8_000
FEATURES = 4096
STEMS = (4, 5, 6, 7)
BLOCK = 64
#: Words that name groups of people; words of a line stand for each other.
IDENTITY = [
    "women men girls boys",
    "woman man girl boy",
    "female male transgender nonbinary",
    "gay lesbian bisexual straight queer",
    "muslim christian jewish hindu buddhist atheist",
    "muslims christians jews hindus buddhists atheists",
    "black white asian latino indigenous",
    "african american european indian mexican chinese arab",
    "immigrants refugees foreigners natives",
    "disabled blind deaf autistic",
    "old young elderly teenage",
    # French
    "femmes hommes filles garçons",
    "femme homme fille garçon",
    "lesbienne bisexuelle hétérosexuelle transgenre",
    "homosexuel bisexuel hétérosexuel",
    "musulman chrétien juif hindou bouddhiste athée",
    "musulmane chrétienne juive",
    "musulmans chrétiens juifs hindous bouddhistes athées",
    "musulmanes chrétiennes juives",
    "noir blanc asiatique métis",
    "noirs blancs asiatiques",
    "africain américain européen indien mexicain chinois arabe",
    "africains américains européens indiens mexicains arabes",
    "immigrés réfugiés étrangers autochtones",
    "handicapé aveugle sourd autiste",
    "handicapés aveugles sourds autistes",
    "vieux jeunes âgés adolescents",
    # German
    "frauen männer mädchen jungen",
    "frau mann",
    "weiblich männlich transgeschlechtlich nichtbinär",
    "schwul lesbisch bisexuell heterosexuell",
    "schwule lesben heterosexuelle",
    "muslimisch christlich jüdisch hinduistisch buddhistisch atheistisch",
    "muslime christen juden buddhisten atheisten",
    "muslimin christin jüdin",
    "schwarze weiße asiatische indigene",
    "afrikaner amerikaner europäer inder mexikaner chinesen araber",
    "afrikanisch amerikanisch europäisch indisch mexikanisch chinesisch arabisch",
    "einwanderer flüchtlinge ausländer einheimische",
    "behinderte blinde gehörlose autisten",
    "alte junge ältere jugendliche",
    # Spanish
    "mujeres hombres niñas niños",
    "mujer hombre niña niño",
    "femenina masculina transgénero",
    "lesbiana homosexual heterosexual",
    "lesbianas bisexuales heterosexuales homosexuales",
    "musulmán cristiano judío hindú budista ateo",
    "musulmana cristiana judía",
    "musulmanas cristianos judíos hindúes budistas ateos",
    "negro blanco asiático indígena",
    "negros blancos asiáticos indígenas",
    "africano americano europeo indio mexicano chino árabe",
    "africanos americanos europeos indios mexicanos chinos árabes",
    "inmigrantes refugiados extranjeros nativos",
    "discapacitado ciego sordo autista",
    "discapacitados ciegos sordos autistas",
    "viejos jóvenes ancianos adolescentes",
]
_WORD = re.compile(r"[^\W\d_]+")
_SWAPS = {w: [v for v in line.split() if v != w] for line in IDENTITY for w in line.split()}


def _word_features(word: str) -> tuple[int, ...]:
    parts = [f"={word}"] + [f"^{word[:n]}" for n in STEMS if len(word) >= n]
    return tuple(xxhash.xxh32_intdigest(p) & 0x7FFFFFFF for p in parts)


_known = Remembered(_word_features)


def features(text: str | None) -> np.ndarray:
    """The distinct hashed features of a text, sorted."""
    words = set(_WORD.findall(text.lower())) if text else ()
    return np.unique(np.fromiter((f for w in words for f in _known[w]), np.int64))


def swapped(text: str | None) -> str | None:
    """The text with every word for a group replaced by another of its kind; null if it names none."""
    lowered = text.lower() if text else ""
    if not any(w in _SWAPS for w in set(_WORD.findall(lowered))):
        return None
    return _WORD.sub(lambda m: _SWAPS[m[0]][len(m[0]) % len(_SWAPS[m[0]])] if m[0] in _SWAPS else m[0], lowered)


@dataclass
class Classifier:
    """Weights of the kept features (sorted) and the bias."""

    kept: np.ndarray
    weights: np.ndarray
    bias: float

    def margin(self, own: np.ndarray) -> float:
        at = np.searchsorted(self.kept, own)
        at = at[(at < len(self.kept))]
        own = own[: len(at)]
        return float(self.weights[at[self.kept[at] == own]].sum() + self.bias)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(features(text)), -30, 30))))


def _spread(sets: list[np.ndarray], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the features that are kept."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cols = np.concatenate([*sets, np.zeros(0, np.int64)])
    at = np.searchsorted(kept, cols)
    ok = at < len(kept)
    ok[ok] = kept[at[ok]] == cols[ok]
    return rows[ok], at[ok]


def chosen_features(names: np.ndarray, pos: np.ndarray, all_: np.ndarray, n: int, n_pos: int, tried: int, keep: int) -> np.ndarray:
    """The features (sorted) whose labels surprise most, of those that stand in three texts or more.

    The measure is the likelihood ratio, held against what the largest of
    ``tried`` features would have by chance.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = pos / all_, n_pos / n
        g2 = 2 * all_ * (np.where(p > 0, p * np.log(p / q), 0) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - q)), 0))
    strength = np.where((all_ >= 3) & (g2 > 2 * np.log(max(tried, 2))), np.round(g2, 6), 0)
    best = np.lexsort((names, -strength))[:keep]
    return np.sort(names[best[strength[best] > 0]])


def fit(
    sets: list[np.ndarray],
    labels: np.ndarray,
    pairs: list[tuple[np.ndarray, np.ndarray]] = (),
    counterfactual: float = 4.0,
    keep: int = FEATURES,
) -> Classifier:
    """Choose features and fit on feature sets and 0/1 labels; ``pairs`` are sentences and their counterparts."""
    y = np.asarray(labels, np.float64)
    kept = np.zeros(0, np.int64)
    if len(y) and y.min() < y.max():
        names, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        pos, all_ = np.bincount(inverse, weights=np.repeat(y, [len(s) for s in sets])), np.bincount(inverse)
        kept = chosen_features(names, pos, all_, len(y), int(y.sum()), int((all_ >= 3).sum()), keep)
    return fit_chosen(sets, y, pairs, kept, counterfactual)


def fit_chosen(
    sets: list[np.ndarray],
    y: np.ndarray,
    pairs: list[tuple[np.ndarray, np.ndarray]],
    kept: np.ndarray,
    counterfactual: float = 4.0,
    ridge: float = 1e-3,
    steps: int = 300,
) -> Classifier:
    """Fit weights of the chosen features. With one label only, or none, the score is constant."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y) or y.min() == y.max():
        return Classifier(np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate))))
    rows, cols = _spread(sets, kept)
    r1, c1 = _spread([p[0] for p in pairs], kept)
    r2, c2 = _spread([p[1] for p in pairs], kept)
    w, bias = np.zeros(len(kept)), float(np.log(rate / (1 - rate)))
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max(len(y) - y.sum(), 1))
    m, v, t = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), 0
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=len(y)) + bias
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(cols, weights=d[rows], minlength=len(kept)) + ridge * w
        if len(pairs):
            k = len(pairs)
            s1 = 1 / (1 + np.exp(-np.clip(np.bincount(r1, weights=w[c1], minlength=k) + bias, -30, 30)))
            s2 = 1 / (1 + np.exp(-np.clip(np.bincount(r2, weights=w[c2], minlength=k) + bias, -30, 30)))
            # The change is penalised on the margin, whose slope does not vanish for scores near 0 and 1.
            z1 = np.log(s1 / (1 - s1 + 1e-12) + 1e-12) - np.log(s2 / (1 - s2 + 1e-12) + 1e-12)
            e = counterfactual * z1 / k
            g += np.bincount(c1, weights=e[r1], minlength=len(kept)) - np.bincount(c2, weights=e[r2], minlength=len(kept))
        g = np.append(g, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return Classifier(kept, w, float(bias))


def train_classifier(
    docs: DataFrame,
    labels: DataFrame,
    max_train: int = MAX_TRAIN,
    counterfactual: float = 4.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Classifier:
    """Fit on at most ``max_train`` labelled rows whose crc32(id) mod 3 is not 1.

    The rows are those with the smallest hash of the id (ties: the smallest id).
    Rows without an id or a label are left out; an id with several labels counts
    with the largest, and every row of documents with it is read, its text whole.
    Without rows, or with one label only, the score is constant.
    """
    bound_batches(docs.sparkSession)
    id_ = F.col(f"`{id_col}`")
    chosen = (
        labels.select(id_.cast("long").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__y"))
        .filter(F.col("__id").isNotNull() & F.col("__y").isNotNull() & ~held_out("__id"))
        .groupBy("__id")
        .agg(F.max("__y").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_train)
    )
    # At most max_train rows of two numbers: small enough to broadcast whatever the tables' size.
    rows = docs.select(id_.cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text")).join(F.broadcast(chosen), "__id")

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How many of a batch's texts hold a feature, and how many of these are toxic; feature -1 is every text."""
        try:
            for part in parts:
                for at in range(0, len(part), 500):
                    some = part.iloc[at : at + 500]
                    sets = [np.append(features(t), -1) for t in some["__text"]]
                    names, inverse = np.unique(np.concatenate(sets), return_inverse=True)
                    y = np.repeat(some["__y"].to_numpy(np.float64), [len(s) for s in sets])
                    yield pd.DataFrame({"f": names, "pos": np.bincount(inverse, weights=y).astype(np.int64), "n": np.bincount(inverse)})
        finally:
            _known.clear()

    stats = rows.mapInPandas(counted, "f long, pos long, n long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    stats = materialize(stats.filter((F.col("n") >= 3) | (F.col("f") < 0)), "features")
    total = stats.filter("f < 0").first()
    n, n_pos = (total["n"], total["pos"]) if total else (0, 0)
    kept = np.zeros(0, np.int64)
    if 0 < n_pos < n:
        tried = stats.filter("f >= 0").count()
        p, q = F.col("pos") / F.col("n"), n_pos / n
        part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
        g2 = 2 * F.col("n") * (part(p, F.lit(q)) + part(1 - p, F.lit(1 - q)))
        likely = stats.filter("f >= 0").withColumn("g2", g2).filter(F.col("g2") > 2 * float(np.log(max(tried, 2))) - 0.01)
        best = likely.orderBy(F.desc("g2"), "f").limit(2 * FEATURES).toPandas()  # a fixed number of rows
        kept = chosen_features(best["f"].to_numpy(np.int64), best["pos"].to_numpy(np.float64), best["n"].to_numpy(np.int64), n, n_pos, tried, FEATURES)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Texts and their counterparts as the chosen features alone."""
        try:
            for part in parts:
                out = []
                for i, t, y in zip(part["__id"], part["__text"], part["__y"], strict=True):
                    other = swapped(t)
                    out.append((i, y, np.intersect1d(features(t), kept), None if other is None else np.intersect1d(features(other), kept)))
                yield pd.DataFrame(out, columns=["i", "y", "f", "c"])
        finally:
            _known.clear()

    found = rows.mapInPandas(read, "i long, y int, f array<long>, c array<long>").toPandas().sort_values("i", kind="stable")
    sets = [np.asarray(x, np.int64) for x in found["f"]]
    pairs = [(s, np.asarray(c, np.int64)) for s, c in zip(sets, found["c"], strict=True) if c is not None]
    return fit_chosen(sets, found["y"].to_numpy(np.float64), pairs, kept, counterfactual)


def held_out(id_col: str):
    """Whether a row is kept from training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def score_toxicity(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1, higher: likelier toxic), in place of one of that name.

    Null and empty texts get the score of a text without words.  Only the text is
    read for it, whole, whatever its length; equal texts score alike, and no rows
    give no rows.  Other columns are passed on, whatever their names.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in parts:
                yield pd.Series([classifier.score(t) for t in texts], dtype="float64")
        finally:
            _known.clear()

    bound_batches(docs.sparkSession)
    return docs.withColumn("score", score(F.col(f"`{text_col}`")))
