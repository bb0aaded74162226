"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over densities of character pieces of words (how many words hold one, in so many words of longer texts, as a logarithm) is trained in numpy from confirmed toxic
texts (P) and unlabelled ones (U) alone; a label 0 is never used as a negative. With
the class prior pi, the risk is

    pi * E_P[l(g, +1)] + max(0, E_U[l(g, -1)] - pi * E_P[l(g, -1)])

and where the bracket falls below zero, by more than ``slack``, its gradient is ascended
instead, so that the model can't fit the unlabelled toxic texts as clean ones. The bias starts at the prior's log-odds.

Training reads a bounded sample, chosen by a hash of the id: at most ``max_positive`` and
``max_unlabelled`` texts of at most ``max_train_chars`` characters, none from the held-out fold.
Scoring reads every whole text, without a shuffle; the model (at most ``max_features``
weights) travels in the function's closure.

Defined results: null, empty and wordless texts get the score of the bias alone; without any
positive text every score is 0; a null id is in no training set and not held out; equal
texts get equal scores; an empty table gives an empty result. Ids, languages and sources are
never inputs of a score. Input columns other than the named ones are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Collection, Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_written, fresh, held_out, materialize, table, written

LETTERS = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3
#: Words that a Python worker remembers the features of; then it starts afresh.
KEPT_WORDS = 100_000


@dataclass(frozen=True)
class Settings:
    """Chosen by ``cross_validate``, that is by labels of the learned fold alone: of what lies within one standard error of the best, the strictest."""

    #: Characters of a piece.
    size: int = 5
    #: Words in which pieces are counted: longer texts are scaled to as many.
    window: int = 200
    #: Of so many pieces one is independent evidence: pieces of a word and its forms come together.
    alike: int = 20


DEFAULT = Settings()


def pieces(word: str, size: int = 5) -> set[str]:
    """The word between marks, and its runs of ``size`` characters, marks included."""
    marked = f"^{word}$"
    return {marked, *[marked[i : i + size] for i in range(len(marked) - size + 1)]}


_NONE: frozenset[str] = frozenset()


def text_words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def text_pieces(text: str, size: int = 5) -> set[str]:
    """Pieces of the text's words."""
    return set().union(*(pieces(w, size) for w in set(text_words(text))))


def density(n: float, words: int, window: int = 200) -> float:
    """The value of a piece that ``n`` of a text's words hold: the logarithm of how many of them, in texts of more words than ``window`` of how many in as many."""
    return math.log2(1 + n * min(1.0, window / max(words, 1)))


def features(text: str, known: Collection[str], seen: dict[str, frozenset[str]], settings: Settings = DEFAULT) -> dict[str, float]:
    """Values of the pieces in ``known``; ``seen`` remembers words."""
    words = text_words(text)
    n: Counter[str] = Counter()
    if len(seen) > KEPT_WORDS:
        seen.clear()
    for w, times in Counter(words).items():
        if (found := seen.get(w)) is None:
            found = seen[w] = frozenset(x for x in pieces(w, settings.size) if x in known) or _NONE
        for x in found:
            n[x] += times
    return {x: density(k, len(words), settings.window) for x, k in n.items()}


class Model:
    """Weights of pieces and a bias."""

    def __init__(self, weights: dict[str, float], bias: float, settings: Settings = DEFAULT) -> None:
        self.weights, self.bias, self.settings = weights, bias, settings
        self._seen: set[str] = set()
        self._telling: dict[str, list[str]] = {}

    def __getstate__(self):
        return (self.weights, self.bias, self.settings)

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def margin(self, text: str | None) -> float:
        every = text_words(text)
        words = set(every)
        if len(self._seen) > KEPT_WORDS:
            self._seen.clear()
            self._telling.clear()
        new = words - self._seen
        for w in new:
            if found := [p for p in pieces(w, self.settings.size) if p in self.weights]:
                self._telling[w] = found
        self._seen |= new
        telling = words & self._telling.keys()
        if not telling:
            return self.bias
        n: Counter[str] = Counter()
        for w, times in Counter(w for w in every if w in telling).items():
            for x in self._telling[w]:
                n[x] += times
        return self.bias + math.fsum(self.weights[x] * density(k, len(every), self.settings.window) for x, k in n.items())

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        return _sigmoid(np.array([self.margin(t) for t in texts], float))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Rows:
    """Sparse rows: columns and values of each."""

    def __init__(self, rows: Iterable[dict[int, float]], width: int) -> None:
        at, value, sizes = array("q"), array("d"), array("q")
        for r in rows:
            at.extend(r)
            value.extend(r.values())
            sizes.append(len(r))
        self.at, self.value, size = np.array(at, np.int64), np.array(value, float), np.array(sizes, np.int64)
        self.row = np.repeat(np.arange(len(size)), size)
        self.n, self.width = len(size), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at] * self.value, self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, g[self.row] * self.value, self.width)


def risk(w: np.ndarray, b: float, p: _Rows, u: _Rows, prior: float) -> tuple[float, float]:
    """The two terms of the risk: that of the positive as positive, and the bracket before it is cut at zero."""
    on_p, on_u = p.dot(w) + b, u.dot(w) + b
    return prior * float(np.logaddexp(0, -on_p).mean()), float(np.logaddexp(0, on_u).mean()) - prior * float(np.logaddexp(0, on_p).mean())


def descent(w: np.ndarray, b: float, p: _Rows, u: _Rows, prior: float, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """The direction to go down: the risk's gradient, or minus the bracket's where that is below zero."""
    s_p, s_u = _sigmoid(p.dot(w) + b), _sigmoid(u.dot(w) + b)
    # d softplus(g) = sigmoid(g); d softplus(-g) = sigmoid(g) - 1
    g_u, g_p = s_u / u.n, -prior * s_p / p.n
    if risk(w, b, p, u, prior)[1] >= -slack:
        g_p = g_p + prior * (s_p - 1) / p.n
    else:
        g_u, g_p = -g_u, -g_p
    return u.back(g_u) + p.back(g_p), float(g_u.sum() + g_p.sum())


def telling(p_count: Mapping[str, int], u_count: Mapping[str, int], n_p: int, n_u: int, max_features: int = 5_000, alike: int = DEFAULT.alike) -> list[str]:
    """The pieces that are features, those with the most evidence first.

    ``p_count`` and ``u_count``: how many of ``n_p`` different positive and ``n_u`` unlabelled texts hold a piece. A piece must be over-represented among the
    positive with more evidence (a Poisson log-likelihood ratio) than chance gives the best of all pieces.
    """
    chance = np.log(max(2.0, len(p_count) / alike))
    due = {x: n_p * max(u_count.get(x, 0), 0.5) / max(n_u, 1) for x in p_count}
    evidence = {x: n * np.log(n / due[x]) - (n - due[x]) for x, n in p_count.items() if n > due[x]}
    return sorted((x for x, e in evidence.items() if e > chance), key=lambda x: (-evidence[x], x))[:max_features]


def settle(kept: list[str], p: _Rows, u: _Rows, prior: float, *, steps: int = 300, rate: float = 0.05, l2: float = 2e-3, slack: float = 0.0, settings: Settings = DEFAULT) -> Model:
    """The model over the features ``kept``.

    Which of them speak for toxicity, and which against it, the risk alone decides: weights start at zero and have either sign. They
    are averaged over the second half of the steps, as ascents and descents alternate there. If the unlabelled hold more of what the fitted model takes for
    toxic than ``prior`` allows, it is fitted again with that larger prior.
    """
    w, b = minimise(p, u, prior, steps, rate, l2, slack)
    if (more := share_alike(p.dot(w) + b, u.dot(w) + b)) > prior:
        w, b = minimise(p, u, min(more, 0.9), steps, rate, l2, slack)
    return Model({x: float(w[i]) for i, x in enumerate(kept)}, b, settings)


def train(positive: Iterable[str], unlabelled: Iterable[str], prior: float, *, max_features: int = 5_000, min_texts: int = 5, settings: Settings = DEFAULT, **descent) -> Model:
    """Fit the classifier to texts at hand; ``fit`` does the same over tables.

    Its features are densities of pieces in ``min_texts`` positive texts at least that are ``telling``; texts count once there, so that copies don't weigh.
    """
    positive, unlabelled = sorted(positive), sorted(unlabelled) or [""]
    if not positive:
        return Model({}, -40.0, settings)
    p_once, u_once = set(positive), set(unlabelled)
    p_count = Counter(x for t in p_once for x in text_pieces(t, settings.size))
    p_count = {x: n for x, n in p_count.items() if n >= min(min_texts, len(p_once))}
    seen: dict[str, frozenset[str]] = {}
    u_count = Counter(x for t in u_once for x in features(t, p_count, seen, settings))
    kept = telling(p_count, u_count, len(p_once), len(u_once), max_features, settings.alike)
    at, seen = {x: i for i, x in enumerate(kept)}, {}
    p, u = (_Rows(sorted_rows({at[x]: v for x, v in features(t, at, seen, settings).items()} for t in texts), len(kept)) for texts in (positive, unlabelled))
    return settle(kept, p, u, prior, settings=settings, **descent)


def sorted_rows(rows: Iterable[dict[int, float]]) -> list[dict[int, float]]:
    """Sparse rows in an order of their own, so that sums don't depend on where they come from."""
    return [dict(r) for r in sorted(sorted(r.items()) for r in rows)]


def share_alike(on_p: np.ndarray, on_u: np.ndarray) -> float:
    """An upper bound of the positive share of the unlabelled: the least ratio of what exceeds a margin, over those that half of the positive exceed."""
    on_p, on_u = np.sort(on_p), np.sort(on_u)
    levels = on_p[: len(on_p) // 2 + 1]
    above = lambda x: 1 - np.searchsorted(x, levels, "left") / len(x)
    return float((above(on_u) / above(on_p)).min())


def minimise(p: _Rows, u: _Rows, prior: float, steps: int, rate: float, l2: float, slack: float) -> tuple[np.ndarray, float]:
    """Weights and bias, averaged over the second half of the steps of Adam."""
    w, b, half = np.zeros(p.width), float(np.log(prior / (1 - prior))), steps // 2
    m, v, mean = (np.zeros(p.width + 1) for _ in range(3))
    for step in range(1, steps + 1):
        g_w, g_b = descent(w, b, p, u, prior, slack)
        grad = np.append(g_w + l2 * w, g_b)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - float(move[-1])
        if step > half:
            mean += np.append(w, b) / (steps - half)
    return mean[:-1], float(mean[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    prior: float | None = None,
    max_positive: int = 2_000,
    max_unlabelled: int = 6_000,
    max_train_chars: int = 50_000,
    max_features: int = 5_000,
    min_texts: int = 5,
    settings: Settings = DEFAULT,
    seed: int = 42,
) -> Model:
    """Train on a bounded sample of rows outside the held-out fold.

    ``prior`` is the share of toxic texts; if None, that among the fold's labels, over all rows. The sample is drawn among ids,
    a repeated one counting once with its least text. Executors read the texts: a task adds up how many hold a piece, and then gives the
    values of the features that were chosen; counts of the positive texts' frequent pieces and at most ``max_positive + max_unlabelled`` sparse rows come to the driver.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull())
    ids = ids.where(~held_out(F.col("id")))
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y"))
    marked = marked.where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    if prior is None:
        prior = marked.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
    order = F.xxhash64("id", F.lit(seed))
    lot = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)

    def sample(rows: DataFrame, n: int) -> list[int]:
        # Far more ids than are wanted go no further than their task; a busy id is one row there.
        few = rows.where(lot < min(1.0, 4 * (n + 50) / max(1, rows.count())))
        return [r[0] for r in few.groupBy("id").agg(F.min(order).alias("h")).orderBy("h", "id").limit(n).collect()]

    spark = docs.sparkSession
    p_ids = sample(marked.where("y = 1").select("id"), max_positive)
    if not p_ids:
        return Model({}, -40.0, settings)
    picked = spark.createDataFrame([(i, True) for i in p_ids] + [(i, False) for i in sample(ids.select("id"), max_unlabelled)], "id long, p boolean")
    texts = ids.where(F.length("text") <= max_train_chars).join(F.broadcast(picked), "id").groupBy("p", "id").agg(F.min("text").alias("text"))  # at most both bounds' rows
    since, tasks = len(written), min(64, 4 * spark.sparkContext.defaultParallelism)  # the sample is small, its texts take long
    texts = materialize(texts.repartition(tasks, "p", "id"), "toxic-sample")
    once = materialize(texts.select("p", "text").distinct().repartition(tasks), "toxic-texts")
    sizes = {r.p: r["count"] for r in once.groupBy("p").count().collect()}
    if not sizes.get(True):
        delete_written(spark, since=since)
        return Model({}, -40.0, settings)

    def counts(rows: DataFrame, known: Collection[str] | None, least: int) -> dict[str, int]:
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n: Counter[str] = Counter()
            seen: dict[str, frozenset[str]] = {}
            for batch in batches:
                for t in batch["text"]:
                    n.update(text_pieces(t, settings.size) if known is None else features(t, known, seen, settings).keys())
            yield pd.DataFrame({"piece": list(n), "n": list(n.values())}).astype({"piece": object, "n": "int64"})

        summed = rows.mapInPandas(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
        return dict(zip(summed["piece"], summed["n"].tolist(), strict=True))

    p_count = counts(once.where("p").select("text"), None, min(min_texts, sizes[True]))
    u_count = counts(once.where("NOT p").select("text"), frozenset(p_count), 1)
    kept = telling(p_count, u_count, sizes[True], max(sizes.get(False, 0), 1), max_features, settings.alike)
    at = {x: i for i, x in enumerate(kept)}

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, frozenset[str]] = {}
        for batch in batches:
            found = [sorted((at[x], v) for x, v in features(t, at, seen, settings).items()) for t in batch["text"]]
            yield pd.DataFrame({"p": batch["p"], "at": [[i for i, _ in r] for r in found], "value": [[v for _, v in r] for r in found]})

    sparse: dict[bool, list[dict[int, float]]] = {True: [], False: []}
    for r in texts.select("p", "text").mapInPandas(rows_of, "p boolean, at array<int>, value array<double>").toLocalIterator():
        sparse[r.p].append(dict(zip(r["at"], r["value"], strict=True)))
    delete_written(spark, since=since)
    p, u = (_Rows(sorted_rows(sparse[x] or [{}]), len(kept)) for x in (True, False))
    return settle(kept, p, u, min(max(prior, 1e-4), 0.9), settings=settings)


def cross_validate(docs: DataFrame, labels: DataFrame, choices: Iterable[Settings], *, folds: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> list[tuple[Settings, float, float]]:
    """(settings, share of toxic labels caught, share of other labels flagged), by labels outside the held-out fold.

    Each part of the learned fold is scored by a model that saw none of its labels and texts; the held-out fold is not looked at.
    """
    part = F.floor(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) / 4) % folds
    learned = lambda df: df.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col).cast("long"))).withColumn("_part", part)
    d, y = learned(docs.select(id_col, text_col)), learned(labels.select(id_col, label_col))
    out = []
    for settings in choices:
        n = Counter()
        for k in range(folds):
            model = fit(d.where(F.col("_part") != k), y.where(F.col("_part") != k), id_col=id_col, text_col=text_col, label_col=label_col, settings=settings, **options)
            asked = d.where(F.col("_part") == k).join(y.where(F.col("_part") == k).select(id_col, label_col), id_col)
            flagged = (F.col("_score") >= THRESHOLD).cast("int")
            for r in score(asked.select(text_col, label_col), model, text_col=text_col, out_col="_score").groupBy(label_col).agg(F.count("*").alias("n"), F.sum(flagged).alias("f")).collect():
                n[r[label_col], "n"] += r.n
                n[r[label_col], "f"] += r.f
        out.append((settings, n[1, "f"] / max(1, n[1, "n"]), n[0, "f"] / max(1, n[0, "n"])))
    return out


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text in ``out_col`` (replaced if there)."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.scores(batch))

    return docs.withColumn(out_col, scored(F.col(text_col)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, all columns as they were."""
    cols = docs.columns
    name = fresh("_score", cols)
    return score(docs, fit(docs, labels), out_col=name).where(F.col(name) < threshold).select(*cols)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
