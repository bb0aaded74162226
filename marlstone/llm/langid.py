"""Language identification by mixtures of languages.

Every language has a smoothed distribution over hashed character trigrams. A document is taken
as a mixture: expectation-maximisation estimates the languages' proportions from the
likelihoods of its trigrams, until none moves by more than ``SETTLED``, in ``ROUNDS`` rounds at most. The set of languages is chosen by penalised likelihood,
log-likelihood less ``penalty`` times half the log of the number of trigrams per language: from the likeliest language alone, the
one that adds most is taken in as long as it adds more than its price; then any that adds less beside the others is left out.
The log-likelihood is concave in the proportions, so a language adds at most its slope where it is absent; only those whose slope
exceeds the price are tried. The prediction is the largest proportion, which is also the score.

Trigram counts come from a bounded sample: at most ``per_language`` texts of each language, chosen
by a hash of the id, outside the held-out fold, of at most ``max_train_chars`` characters.
Prediction reads every whole text, without a shuffle; the model (languages x ``BINS`` floats)
travels in the function's closure.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every
text if nothing was learned; ties go to the language first in code-point order; null ids are not
held out and not learned from; repeated ids are sampled once, by their least text of a language; very long texts are counted whole; an empty
table gives an empty result. Input columns other than the named
ones are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import held_out, local_table, table

BINS = 1 << 15
UNKNOWN = "und"
#: Rounds of expectation-maximisation, and the move of a proportion that ends it.
ROUNDS, SETTLED = 200, 1e-4


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigrams(text: str | None) -> np.ndarray:
    """Bins of the trigrams of the lower-case words, each word between single marks."""
    if not text:
        return np.zeros(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, np.int64)
    code = np.where(letter, code, 0)
    code = np.concatenate([[0], code, [0]])
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)  # one mark between words
    code = code[keep]
    a, b, c = code[:-2], code[1:-1], code[2:]
    bins = ((a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) >> 7) % BINS
    return bins[b != 0]


def settle(n: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``like`` by expectation-maximisation, and their log-likelihood."""
    theta, total = np.full(len(like), 1 / len(like)), n.sum()
    for _ in range(ROUNDS if len(like) > 1 else 0):
        old, theta = theta, theta * (like @ (n / (theta @ like))) / total
        if np.abs(theta - old).max() < SETTLED:
            break
    return theta, float(n @ np.log(theta @ like))


class Model:
    """Log-likelihoods of trigram bins by language, languages in code-point order."""

    def __init__(self, languages: list[str], prob: np.ndarray, penalty: float = 3.0) -> None:
        self.languages, self.prob, self.penalty = languages, prob, penalty

    @classmethod
    def train(cls, rows: list[tuple[str, str]], smoothing: float = 0.1, penalty: float = 3.0) -> Model:
        """From (language, text) rows."""
        return cls.from_counts([(x, int(b), int(n)) for x, text in rows for b, n in zip(*np.unique(trigrams(text), return_counts=True), strict=True)], {x for x, _ in rows}, smoothing, penalty)

    @classmethod
    def from_counts(cls, counted: Iterable[tuple[str, int, int]], languages: Iterable[str], smoothing: float = 0.1, penalty: float = 3.0) -> Model:
        """From (language, trigram bin, count); counts of one bin are added."""
        languages = sorted(languages)
        counts = np.full((len(languages), BINS), smoothing)
        at = {x: i for i, x in enumerate(languages)}
        for language, b, n in counted:
            counts[at[language], b] += n
        prob = counts / counts.sum(axis=1, keepdims=True) if languages else counts
        return cls(languages, prob.astype(np.float32), penalty)

    def price(self, trigram_count: float) -> float:
        """What a language costs in log-likelihood."""
        return self.penalty * 0.5 * float(np.log(trigram_count + 1))

    def mixture(self, text: str | None) -> dict[str, float]:
        """The chosen languages and their proportions, empty if the text has no letter."""
        bins = trigrams(text)
        if not len(bins) or not self.languages:
            return {}
        count = np.bincount(bins, minlength=BINS)
        at = np.flatnonzero(count)
        n, like = count[at].astype(np.float64), self.prob[:, at].astype(np.float64)
        total = n.sum()
        price = self.price(total)

        alone = np.log(like) @ n
        chosen, theta = [int(np.argmax(alone))], np.ones(1)
        fit = float(alone[chosen[0]])
        while len(chosen) < len(like):
            slope = (like / (theta @ like[chosen])) @ n - total
            slope[chosen] = -np.inf
            best = max((settle(n, like[[*chosen, b]])[::-1] + (-int(b),) for b in np.flatnonzero(slope > price)), key=lambda x: (x[0], x[2]), default=None)
            if best is None or best[0] - fit <= price:
                break
            fit, theta = best[0], best[1]
            chosen.append(-best[2])
        while len(chosen) > 1:
            less = [settle(n, like[chosen[:k] + chosen[k + 1 :]]) for k in range(len(chosen))]
            k = max(range(len(chosen)), key=lambda k: less[k][1])
            if fit - less[k][1] > price:
                break
            (theta, fit), chosen = less[k], chosen[:k] + chosen[k + 1 :]
        return {self.languages[i]: float(x) for i, x in sorted(zip(chosen, theta / theta.sum(), strict=True))}

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.mixture(text)
        if not found:
            return UNKNOWN, 0.0
        best = max(found.values())
        return next(k for k in sorted(found) if found[k] == best), min(1.0, best)


def fit(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 400,
    max_train_chars: int = 20_000,
    max_languages: int = 500,
    seed: int = 42,
) -> Model:
    """Learn from texts with a language, outside the held-out fold; more than ``max_languages`` is an error."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")) & (F.length("text") <= max_train_chars))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    # Far more ids than are wanted go no further than their task; of the rest the first by hash are taken.
    shares = [(r.lang, min(1.0, 4 * (per_language + 50) / r.n)) for r in counts]
    share = local_table(docs.sparkSession, {"lang": pa.string(), "share": pa.float64()}, shares)
    lot = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    few = rows.select("lang", "id").join(share, "lang").where(lot < F.col("share"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    ids = few.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_language)
    picked = ids.select("lang", "id").distinct().collect()
    if not picked:
        return Model.train([])
    small = docs.sparkSession.createDataFrame([(r.lang, r.id) for r in picked], "lang string, id long")
    own = rows.join(F.broadcast(small), ["lang", "id"])  # at most max_languages * per_language ids
    texts = own.groupBy("lang", "id").agg(F.min("text").alias("text"))  # one text each, however often an id is there

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, text in zip(batch["lang"], batch["text"], strict=True):
                if language not in sums:
                    sums[language] = np.zeros(BINS, np.int64)
                sums[language] += np.bincount(trigrams(text), minlength=BINS)
        for language, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": language, "bin": at, "n": n[at]})

    # A task adds up its texts; at most languages x BINS numbers come to the driver.
    counted = texts.mapInPandas(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    return Model.from_counts(zip(counted["lang"], counted["bin"].tolist(), counted["n"].tolist(), strict=True), {r.lang for r in picked})


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, languages`` (all chosen languages with their proportions)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [model.mixture(t) for t in rows["text"]]
            best = [min(((-v, k) for k, v in f.items()), default=(0.0, UNKNOWN)) for f in found]
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"],
                    "lang_pred": [k for _, k in best],
                    "score": [min(1.0, -v) for v, _ in best],
                    "languages": [list(f.items()) for f in found],
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang: string, share: double>>"
    )


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
