"""Toxicity: a second-order factorization machine over hashed words."""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.language import held_out
from wavegrid.llm.scan import map_batches, slices, sorted_unique, utf8, whole_row

#: Hashed terms, factors of each, and passes over the sample.
TERMS = 1 << 18
FACTORS = 8
EPOCHS = 12
SEED = 20_240_201
#: Most labelled rows that the model is fitted on; the ones with the smallest hash of their id.
SAMPLE = 8_192
#: Words whose term a worker remembers.
WORDS = 100_000
#: Chi-squared of a term's presence and the label from which the term gets weights, and of a pair's presence among the texts
#: with either of its terms from which both get them.
LEAST_CHI2 = 20.0
PAIR_CHI2 = 30.0
#: Terms of the sample, the most frequent, whose pairs are looked at, and how many of them at once.
PAIRED = 1024
PAIRED_AT_ONCE = 512
#: Bytes of the word beginnings that are terms.
BEGINNINGS = (4, 5)

#: Separators: ASCII characters that are neither letters nor digits; letters go to lower case.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))

_models: dict[str, tuple] = {}


class _Terms(dict):
    """A word's terms: its own and those of its beginnings, which stand for its inflected and joined forms."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        parts = (word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) >= n))
        found = tuple(xxhash.xxh64_intdigest(x, SEED) % TERMS for x in parts)
        if len(self) < WORDS:  # frequent words come early
            self[word] = found
        return found


_terms = _Terms()


def terms(text: bytes | None) -> np.ndarray:
    """The different terms of a text, sorted."""
    words = set((text or b"").translate(_WORD_BYTES).split())
    return sorted_unique(np.fromiter(chain.from_iterable(map(_terms.__getitem__, words)), np.int64))


def _term_rows(batches):
    for batch in slices(batches):
        found = [terms(x).astype(np.int32) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], ["y", "terms"])
    _terms.clear()  # the worker lives on for other tasks


@dataclass
class Machine:
    """bias + sum of the weights of a text's terms + sum over pairs of its terms of the product of their factors."""

    index: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray


def _chi_squared(both: np.ndarray, term: np.ndarray, toxic: float, n: int) -> np.ndarray:
    """Of 2 x 2 tables: texts with the term and toxic, with the term, toxic, and all."""
    expected = term * toxic / max(n, 1)
    spread = expected * (1 - toxic / max(n, 1)) * (1 - term / max(n, 1))
    return (both - expected) ** 2 / np.maximum(spread, 1e-9)


def _paired(labels: np.ndarray, rows: list[np.ndarray], counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which terms tell the label together with another one, beyond what either tells alone, whatever they tell alone.

    For a pair, the toxic among the texts with both are held against the rate among the texts with the one and with the
    other; both must be far off.
    """
    most = np.sort(np.argsort(-counts, kind="stable")[:PAIRED])
    place = np.full(len(counts), -1)
    place[most] = np.arange(len(most))
    has = np.zeros((len(rows), len(most)), np.float32)
    for i, r in enumerate(rows):
        has[i, (own := place[r])[own >= 0]] = 1
    rate = np.clip(toxic[most] / np.maximum(counts[most], 1), 1e-3, 1 - 1e-3)
    found = np.zeros(len(counts), bool)
    for at in range(0, len(most), PAIRED_AT_ONCE):
        own = slice(at, at + PAIRED_AT_ONCE)
        both, bad = has[:, own].T @ has, (has[:, own] * labels[:, None].astype(np.float32)).T @ has
        far = [(bad - both * r) ** 2 / np.maximum(both * r * (1 - r), 1e-9) for r in (rate[own, None], rate[None, :])]
        # a term without the other ones of a pair says nothing about it, so texts with just one are needed too
        apart = np.minimum(counts[most][own, None] - both, counts[most][None, :] - both) >= PAIR_CHI2 / 4
        found[most[own]] |= ((np.minimum(*far) >= PAIR_CHI2) & apart).any(axis=1)
    return found


def fit(labels: np.ndarray, texts: list[np.ndarray], factors: int = FACTORS, epochs: int = EPOCHS, least: float = LEAST_CHI2) -> Machine:
    """Adagrad on the logistic loss, one text at a time in a fixed shuffled order; both classes weigh the same.

    Terms get weights if their presence goes with the label (chi-squared of at least ``least``), or that of a pair which they
    are part of does: the many others can't be told from chance, and in long texts they would drown the few that count.
    """
    rng = np.random.default_rng(SEED)
    every = np.concatenate([np.empty(0, np.int32), *texts])
    index, where, counts = np.unique(every, return_inverse=True, return_counts=True)
    toxic = np.bincount(where, weights=np.repeat(labels, [len(t) for t in texts]), minlength=len(index))
    ends = np.cumsum([len(t) for t in texts]) if texts else np.empty(0, np.int64)
    numbers = np.split(where, ends[:-1]) if texts else []
    index = index[(_chi_squared(toxic, counts, float(labels.sum()), len(labels)) >= least) | _paired(labels, numbers, counts, toxic)]
    machine = Machine(index, 0.0, np.zeros(len(index)), rng.normal(0, 0.01, (len(index), factors)))
    positive = float(labels.sum())
    if not len(index) or positive in (0.0, float(len(labels))):
        machine.bias = float(np.log((positive + 1) / (len(labels) - positive + 2)))  # under one half without labels
        return machine
    share = {1: 0.5 * len(labels) / positive, 0: 0.5 * len(labels) / (len(labels) - positive)}
    rows = [np.flatnonzero(np.isin(index, t, assume_unique=True)) for t in texts]
    sum_w, sum_v, sum_b, rate, shrink = np.full(len(index), 1e-1), np.full((len(index), factors), 1e-1), 1e-1, 0.2, 2e-4
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = machine.factor[r]
            total = v.sum(axis=0)
            z = machine.bias + machine.weight[r].sum() + 0.5 * ((total * total).sum() - (v * v).sum())
            g = share[int(labels[i])] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i])
            sum_b += g * g
            machine.bias -= rate * g / np.sqrt(sum_b)
            if len(r):
                gw = g + shrink * machine.weight[r]
                sum_w[r] += gw * gw
                machine.weight[r] -= rate * gw / np.sqrt(sum_w[r])
                gv = g * (total - v) / max(1.0, np.sqrt(len(r))) + shrink * v
                sum_v[r] += gv * gv
                machine.factor[r] -= 0.25 * rate * gv / np.sqrt(sum_v[r])
    return machine


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most ``sample`` labelled rows of the other folds.

    The sample is the ids of smallest hash, so it is the same in any run; only it is sent to the readers of
    ``df``, and only its terms come back, of the rows of one id those of the first by order.
    """
    ids = (
        labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out("_id", folds, fold))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
    )
    # the first by hash lie under this share of all hashes, unless they are fewer: then no row is left out before the sort
    share = min(1.0, 2 * sample / max(1, ids.count()))
    if share < 1:
        under = ids.where(F.xxhash64("_id") < int(-(2**63) + share * 2**64))
        ids = under if under.count() >= sample else ids
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = df.select(F.col(id_col).cast("long").alias("_id"), utf8(text_col).alias("_text")).join(F.broadcast(ids), "_id").select(F.struct("_id", "_y").alias("y"), "_text")
    found = map_batches(rows, _term_rows, "y struct<_id:long,_y:int>, terms binary").groupBy("y").agg(F.min("terms").alias("terms")).collect()
    found = sorted((r.y["_y"], bytes(r.terms)) for r in found)
    return fit(np.array([y for y, _ in found], np.float64), [np.frombuffer(t, np.int32) for _, t in found])


def _dense(machine: Machine) -> tuple:
    """The machine's tables by term, unknown terms 0."""
    weight, factor = np.zeros(TERMS, np.float32), np.zeros((TERMS, machine.factor.shape[1]), np.float32)
    weight[machine.index], factor[machine.index] = machine.weight, machine.factor
    return machine.bias, weight, factor


def _probability(text: bytes | None, model: tuple) -> float:
    bias, weight, factor = model
    rows = terms(text)
    rows = rows[weight[rows] != 0]  # other terms have no factors either
    v = factor[rows].astype(np.float64)
    total = v.sum(axis=0)
    z = bias + float(weight[rows].sum(dtype=np.float64)) + 0.5 * float((total * total).sum() - (v * v).sum())
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _score(batches, shared, key: str):
    if key not in _models:
        _models.clear()
        _models[key] = _dense(pickle.loads(shared.value))
    model = _models[key]
    for batch in slices(batches):
        found = [_probability(x, model) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["row", "score"])
    _terms.clear()


def scores(df: DataFrame, machine: Machine, row: Column, text_col: str = "text") -> DataFrame:
    """``row`` of each row of ``df`` and score, the probability that the text is toxic; a null text is an empty one.

    Nothing is shuffled; the machine sent to the workers holds the terms of at most SAMPLE texts.
    """
    context = df.sparkSession.sparkContext
    packed = pickle.dumps(machine)
    work = df.select(row.alias("row"), utf8(text_col).alias("text"))
    schema = work.select("row", F.lit(0.0).alias("score")).schema
    key = f"{context.applicationId}:{hashlib.sha256(packed).hexdigest()}"
    return map_batches(work, partial(_score, shared=context.broadcast(packed), key=key), schema)


def score_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> DataFrame:
    """Per row: id, held_out, score and predicted (1 from 0.5 on).

    Labels of rows whose crc32 of the id, as text, is ``fold`` modulo ``folds`` are never used; a null id is not
    held out and has no label. Ids labelled twice count with the higher label, and of an id's repeated rows one is learned
    from. Without labels, or with labels of one kind, all texts get one score. Whole texts are scored, of any length; texts
    of the same words get the same score, and an empty table gives no rows. Other columns are ignored.
    """
    machine = learn(df, labels, id_col, text_col, label_col, folds, fold, sample)
    row = F.struct(F.col(id_col).cast("long").alias("id"), held_out(id_col, folds, fold).alias("held_out"))
    return scores(df, machine, row, text_col).select("row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(df: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``df``, all columns, that score under ``threshold``; a null text is an empty one, repeated rows stay or go together.

    Without any label no row goes, and an empty table stays empty.
    """
    machine = learn(df, labels, **options)
    return scores(df, machine, whole_row(df), options.get("text_col", "text")).where(F.col("score") < threshold).select("row.*")
