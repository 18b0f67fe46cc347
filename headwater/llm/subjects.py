"""Subject areas of documents: one-versus-rest linear classifiers on hashed word n-grams.

Documents are read as units (lines, sentences, clauses of statements). A unit's features are its words and pairs of
neighbouring words, with identifiers taken apart and all words reduced to their consonants, so that "freight bill",
FreightBill, FREIGHT_BILL and frght_bll agree. Hand labels say which subjects a document has, not where; so they are weak
labels of its units, refined in rounds: a unit keeps those of its document's labels that the model finds in it, and labels that
no unit supports are given up as wrong. Section titles are weak labels too: a first model reads those of documents without hand
labels, and a second one learns from their other lines as well, if that is better on hand labels. As asides occur in documents of all other subjects, the classifiers learn the phrases
that introduce them as evidence against every subject. A document has a subject if several of its units reach a threshold, or
one of them a higher one; each subject's thresholds are calibrated on labelled documents that the classifiers weren't fitted on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.scratch import Scratch

#: Hashed features; the model has so many weights per subject.
DIM = 1 << 18
#: Bounds of the labelled sample that the model is fitted on: documents, characters of one, units taken from one.
MAX_DOCS, MAX_CHARS, MAX_UNITS = 6_000, 20_000, 60
#: Bound of the documents with titles and without hand labels that are learnt from besides.
MAX_TITLED = 1_000
#: Score from which a title names a subject, and the lines that are titles.
TITLE_SCORE = 2.0
#: Weight of a document with titles for the subjects that they do not name.
WEAK = 0.3
TITLE = re.compile(r"^#+[ \t]+(\S[^\n]*)", re.M)
#: Subjects that one model may have; each takes a megabyte.
MAX_SUBJECTS = 500
#: Every so many labelled documents are kept for calibration.
HELD_OUT = 5
#: Labels that calibration needs, and that a subject needs for thresholds of its own.
FEW, FEW_OWN = 20, 40
#: Rounds, passes in each of them (few to many, so that there are STEPS in all), units a step and rate of learning.
ROUNDS, EPOCHS, STEPS, BATCH, RATE = 3, (2, 12), 300, 256, 0.35
#: Tokens scored at once, which bounds a worker's memory.
CHUNK = 150_000
#: Thresholds tried for a subject that several units have, and for one that a single unit has.
SEVERAL, SINGLE = (0.5, 1.0, 1.5, 2.0, 2.5), (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)

TOKEN = re.compile(r"[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+|[\n;]|[.?!](?=\s|$)")
VOWEL = re.compile(r"(?<=.)[aeiouáàâäéèêëíìîïóòôöúùûü]")
BREAKS = frozenset("\n;.?!")


class Words(dict):
    """Hashes of the words in a piece of text between spaces, by their consonants; -1 for what ends a unit."""

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = tuple(-1 if w in BREAKS else zlib.crc32(VOWEL.sub("", w.lower()).encode()) for w in TOKEN.findall(piece))
        if len(piece) <= 40:
            if len(self) >= 400_000:
                self.clear()
            self[piece] = found
        return found

    def row(self, text: str) -> chain:
        """The hashes of a whole text, ended by -1."""
        return chain(chain.from_iterable(map(self.__getitem__, text.replace("\n", " \n ").split(" "))), (-1,))


def features(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a row of word hashes: feature and unit of each, units ascending."""
    unit = np.cumsum(ids < 0)
    word = ids >= 0
    ids, unit = ids[word], unit[word]
    if not len(ids):
        return ids, unit
    pair = unit[1:] == unit[:-1]
    second = (ids[:-1] * 1_000_003 + ids[1:] * 7_919) % DIM
    slot = np.zeros((len(ids), 2), dtype=np.int64)
    slot[:, 0] = ids % DIM
    slot[1:, 1] = np.where(pair, second, -1)
    slot[0, 1] = -1
    flat, units = slot.ravel(), np.repeat(unit, 2)
    real = flat >= 0
    return flat[real], units[real]


@dataclass
class Model:
    subjects: list[str]
    weights: np.ndarray  # subjects x DIM
    bias: np.ndarray
    several: np.ndarray | float = 1.0  # for all subjects or for each
    single: np.ndarray | float = 4.0

    def unit_scores(self, feature: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units and their scores. A unit's score is a sum over its features, scaled by the root of their number."""
        start = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        n = np.diff(np.r_[start, len(unit)])
        # Subject by subject, for a row of weights stays in the processor's cache.
        s = np.stack([np.add.reduceat(w.take(feature), start) for w in self.weights], axis=1)
        return unit[start], s / np.sqrt(n)[:, None] + self.bias

    def decide(self, top: np.ndarray, count: np.ndarray) -> np.ndarray:
        return ((top > self.several) & (count >= 2)) | (top > self.single)


def fit(docs: list[tuple[str, dict[str, int]]], descriptions: dict[str, str], titled: list[str] | None = None, seed: int = 7) -> Model:
    """A model from labelled documents (text, subject -> number of raters), the subjects' descriptions and documents with titles.

    Without labelled documents, the descriptions alone are learnt. The thresholds are set on the documents kept out of fitting; where
    those have too few labels, each document is kept out of one of several fits. Documents with titles are used if the documents
    kept out are then classified better.
    """
    if len(descriptions) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    first, f1 = _calibrated(docs, [], descriptions, seed)
    weak = [(t, found) for t in titled or [] if (found := _titles(first, t))]
    if not weak or not docs:
        return first
    second, better = _calibrated(docs, weak, descriptions, seed)
    return second if better > f1 else first


def _titles(model: Model, text: str) -> dict[str, int]:
    """Subjects that a text's titles name."""
    row = np.fromiter(Words().row("\n".join(TITLE.findall(text))), dtype=np.int64)
    _, top, _ = doc_scores(model, row, [len(row)])
    return {model.subjects[k]: 1 for k in np.flatnonzero(top[0] > TITLE_SCORE)} if len(top) else {}


def _calibrated(docs: list[tuple[str, dict[str, int]]], weak: list[tuple[str, dict[str, int]]], descriptions: dict[str, str], seed: int) -> tuple[Model, float]:
    model, *kept = _fit(docs, weak, descriptions, seed, HELD_OUT - 1)
    if kept[2].sum() < FEW:
        more = [_fit(docs, weak, descriptions, seed, k)[1:] for k in range(HELD_OUT - 1)]
        kept = [np.concatenate(x) for x in zip(kept, *more)]
    calibrate(model, *kept)
    found, truth = model.decide(*kept[:2]), kept[2]
    return model, 2 * (found & truth).sum() / max(1, found.sum() + truth.sum())


def _fit(docs: list[tuple[str, dict[str, int]]], weak: list[tuple[str, dict[str, int]]], descriptions: dict[str, str], seed: int, fold: int) -> tuple[Model, np.ndarray, np.ndarray, np.ndarray]:
    """A model without one of HELD_OUT parts of the labelled documents; best score, number of units and labels of that part, over whole
    documents. Of weak documents only the subjects given are learnt; that they lack others is not known."""
    n_hand, docs = len(docs), docs + weak
    subjects = sorted(descriptions)
    column = {s: i for i, s in enumerate(subjects)}
    rng, words = np.random.default_rng(seed), Words()
    feats, starts, owner = [], [], []
    labels = np.zeros((len(docs) + len(subjects), len(subjects)), np.float32)
    texts = [t for t, _ in docs] + [descriptions[s] or "" for s in subjects]
    total = 0
    for d, text in enumerate(texts):
        f, u = features(np.fromiter(words.row(text or ""), dtype=np.int64))
        bounds = np.r_[np.flatnonzero(np.r_[True, u[1:] != u[:-1]]), len(u)] if len(u) else np.zeros(1, np.int64)
        chosen = range(len(bounds) - 1)
        if len(bounds) - 1 > MAX_UNITS:
            chosen = np.sort(rng.choice(len(bounds) - 1, MAX_UNITS, replace=False))
        for k in chosen:
            feats.append(f[bounds[k] : bounds[k + 1]])
            starts.append(total)
            owner.append(d)
            total += bounds[k + 1] - bounds[k]
    for d, (_, given) in enumerate(docs):
        for s in given:
            if s in column:
                labels[d, column[s]] = 1
    for s in subjects:
        labels[len(docs) + column[s], column[s]] = 1
    if not total:
        none = np.zeros((0, len(subjects)))
        return Model(subjects, np.zeros((len(subjects), DIM), np.float32), np.full(len(subjects), -2, np.float32)), none, none, none > 0
    flat, start, owner = np.concatenate(feats), np.array(starts), np.array(owner)
    size = np.diff(np.r_[start, total])
    # Only features seen twice are learnt; the others stay at 0 and are put into one slot.
    seen, slot, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    n_learnt = int(rank[-1]) + 1 if len(rank) else 0
    slot = np.where(times[slot] > 1, rank[slot], n_learnt)
    held = np.arange(len(texts)) % HELD_OUT == fold
    held[n_hand:] = False
    w, b = np.zeros((n_learnt + 1, len(subjects)), np.float32), np.full(len(subjects), -2, np.float32)
    gain, gain_b = np.full_like(w, 1e-2), np.full_like(b, 1e-2)
    scale = (1 / np.sqrt(size)).astype(np.float32)
    training = np.flatnonzero(~held[owner])
    given = labels[owner]
    target = given.copy()
    unsure = (owner >= n_hand) & (owner < len(docs))
    known = np.where(unsure[:, None] & (given == 0), WEAK, 1).astype(np.float32)
    epochs = min(max(EPOCHS[0], -(-STEPS * BATCH // max(1, ROUNDS * len(training)))), EPOCHS[1])

    def scores() -> np.ndarray:
        return np.add.reduceat(w[slot], start, axis=0) * scale[:, None] + b

    for _ in range(ROUNDS):
        for _ in range(epochs):
            order = rng.permutation(training)
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                n = size[rows]
                first = np.cumsum(n) - n
                inside = np.arange(n.sum()) + np.repeat(start[rows] - first, n)
                s, k = slot[inside], np.repeat(np.arange(len(rows)), n)
                p = np.add.reduceat(w[s], first, axis=0) * scale[rows, None] + b
                err = (1 / (1 + np.exp(-p)) - target[rows]) * known[rows]
                by_slot = np.argsort(s, kind="stable")
                ss = s[by_slot]
                head = np.flatnonzero(np.r_[True, ss[1:] != ss[:-1]])
                grad = np.add.reduceat((err * scale[rows, None])[k[by_slot]], head, axis=0)
                which = ss[head]
                gain[which] += grad**2
                w[which] -= RATE * grad / np.sqrt(gain[which])
                g = err.sum(0)
                gain_b += g**2
                b -= RATE * g / np.sqrt(gain_b)
                w[n_learnt] = 0
        s = scores()
        top = np.full(labels.shape, -99, np.float32)
        np.maximum.at(top, owner, s)
        sure = np.zeros(labels.shape, np.int32)
        np.add.at(sure, owner, (s > 2.2).astype(np.int32))
        best = np.where(given > 0, s, -99).max(axis=1, keepdims=True)
        target = ((given > 0) & (s >= best - 1) & (top[owner] > -1)).astype(np.float32)
        # Labels are incomplete: a subject that several units are sure of counts as given, in those units.
        target[(s > 2.2) & (sure[owner] >= 3)] = 1
        target[owner >= len(docs)] = given[owner >= len(docs)]
    weights = np.zeros((DIM, len(subjects)), np.float32)
    learnt = times > 1
    weights[seen[learnt]] = w[rank[learnt]]
    model = Model(subjects, np.ascontiguousarray(weights.T), b)
    top, count = np.full(labels.shape, -99, np.float32), np.zeros(labels.shape, np.int32)
    for d in np.flatnonzero(held):  # all units, as in classify
        row = np.fromiter(words.row(texts[d] or ""), dtype=np.int64)
        _, best, n = doc_scores(model, row, [len(row)])
        if len(best):
            top[d], count[d] = best[0], n[0]
    return model, top[held], count[held], labels[held] > 0


def calibrate(model: Model, top: np.ndarray, count: np.ndarray, truth: np.ndarray) -> Model:
    """Sets the thresholds to those with the best F1 on held-out documents; of equal ones, the highest.

    They are set for all subjects together first, and then for each subject that has labels enough, where other thresholds do better.
    """
    if truth.sum() < FEW:
        return model

    def best(rows: np.ndarray, at: tuple[float, float] | None) -> tuple[float, float]:
        most, chosen = -1.0, at
        pairs = [(several, single) for several in SEVERAL for single in SINGLE if single >= several]
        for model.several, model.single in [*pairs, *([at] if at else [])]:
            found = model.decide(top[:, rows], count[:, rows])
            f1 = 2 * (found & truth[:, rows]).sum() / max(1, found.sum() + truth[:, rows].sum())
            if f1 >= most:
                most, chosen = f1, (model.several, model.single)
        return chosen

    common = best(np.arange(truth.shape[1]), None)
    own = [best(np.array([k]), common) if n >= FEW_OWN else common for k, n in enumerate(truth.sum(axis=0))]
    model.several, model.single = (np.array(x, np.float32) for x in zip(*own))
    return model


def doc_scores(model: Model, row: np.ndarray, ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents with features of a run of documents (one row of hashes, the end of each document in it): number, best score, number of units."""
    feature, unit = features(row)
    if not len(feature):
        none = np.zeros((0, len(model.subjects)), np.float32)
        return np.zeros(0, np.int64), none, none
    doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    is_word = row >= 0
    doc_of_unit = np.zeros(int(len(row) - is_word.sum()) + 1, dtype=np.int64)
    doc_of_unit[np.cumsum(~is_word)[is_word]] = doc[is_word]
    units, s = model.unit_scores(feature, unit)
    owner = doc_of_unit[units]
    head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return owner[head], np.maximum.reduceat(s, head, axis=0), np.add.reduceat((s > 0).astype(np.int32), head, axis=0)


def subjects_of(model: Model, row: np.ndarray, ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Subjects of a run of documents, given as one row of hashes and the end of each document in it: document, subject number."""
    owner, top, count = doc_scores(model, row, ends)
    at, subject = np.nonzero(model.decide(top, count))
    return owner[at], subject


def classify(docs: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """Subjects of each document: key, subject; none for null and empty texts. Each whole text is read once, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"key {dict(docs.dtypes)[key]}, subject string"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, words = shared.value, Words()
        names = np.array(model.subjects, dtype=object)
        for batch in batches:
            keys = batch["key"].to_numpy()
            first, ids, ends = 0, [], []
            for i, text in enumerate(batch["text"]):
                ids.extend(words.row(text))
                ends.append(len(ids))
                if len(ids) >= CHUNK or i == len(keys) - 1:
                    doc, subject = subjects_of(model, np.array(ids, dtype=np.int64), ends)
                    yield pd.DataFrame({"key": keys[first + doc], "subject": names[subject]})
                    first, ids, ends = i + 1, [], []

    some = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & (F.length("text") > 0))
    return some.mapInPandas(score, schema).withColumnRenamed("key", key)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str) -> tuple[list[tuple[str, dict[str, int]]], list[str]]:
    """The sample to fit on: labelled documents with their labels, and texts of documents with titles and without labels.

    Both are chosen by a hash of the key before any text is read: MAX_DOCS labelled ones, MAX_TITLED of those with titles, of at most
    MAX_CHARS characters each; longer ones of those chosen are left out.
    """
    per_doc = labels.select(key, "subject").dropna().groupBy(key, "subject").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("subject", "n"))).alias("given"))
    per_doc = Scratch(docs.sparkSession, "labels").save(per_doc)
    pick = F.xxhash64(key)
    chosen = per_doc.orderBy(pick, key).limit(MAX_DOCS)
    texts = docs.select(key, F.col(text).alias("_text")).filter(F.char_length("_text").between(1, MAX_CHARS))
    titled = texts.filter(F.col("_text").rlike(r"(?m)^#+[ \t]+\S")).select(key).join(per_doc.select(key), key, "left_anti").orderBy(pick, key).limit(MAX_TITLED)
    wanted = chosen.unionByName(titled, allowMissingColumns=True)  # at most MAX_DOCS + MAX_TITLED rows
    rows = texts.join(F.broadcast(wanted), key).orderBy(pick, key).select("_text", "given").toLocalIterator()
    hand, other = [], []
    for r in rows:
        if r["given"] is None:
            other.append(r["_text"])
        else:
            hand.append((r["_text"], r["given"]))
    return hand, other
