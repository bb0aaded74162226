"""Fitted models as versions of a store: fit once, score in other runs.

A version is complete or not seen (``marlstone.store``), so a run that is cut off while it saves leaves the model before it in place. Models come back bit by bit:
numbers are stored as they are. Loading a name that was never saved gives None.
"""

from __future__ import annotations

import numpy as np

from ..store import Store
from . import langid, toxicity

TOXICITY, LANGUAGES = "toxicity-model", "language-model"


def save_toxicity(store: Store, model: toxicity.Model) -> int:
    """The version under which it was saved."""
    rows = store.spark.createDataFrame(sorted(model.weights.items()), "piece string, weight double")
    s = model.settings
    store.put(rows, TOXICITY, bias=repr(model.bias), size=str(s.size), window=str(s.window), alike=str(s.alike))
    return store.versions(TOXICITY)[-1]


def load_toxicity(store: Store) -> toxicity.Model | None:
    """The newest model."""
    facts = store.facts(TOXICITY)
    if facts is None:
        return None
    settings = toxicity.Settings(int(facts["size"]), int(facts["window"]), int(facts["alike"]))
    return toxicity.Model({r.piece: r.weight for r in store.get(TOXICITY).orderBy("piece").collect()}, float(facts["bias"]), settings)


def save_languages(store: Store, model: langid.Model) -> int:
    """The version under which it was saved; a row per language."""
    rows = [(language, row.tolist()) for language, row in zip(model.languages, model.prob, strict=True)]
    store.put(store.spark.createDataFrame(rows, "language string, prob array<float>"), LANGUAGES, penalty=repr(model.penalty))
    return store.versions(LANGUAGES)[-1]


def load_languages(store: Store) -> langid.Model | None:
    """The newest model."""
    facts = store.facts(LANGUAGES)
    if facts is None:
        return None
    rows = sorted(store.get(LANGUAGES).collect())
    prob = np.array([r.prob for r in rows], np.float32).reshape(len(rows), langid.BINS)
    return langid.Model([r.language for r in rows], prob, float(facts["penalty"]))
