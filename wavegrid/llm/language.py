"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

import hashlib
import pickle
from codecs import getincrementaldecoder
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.scan import map_batches, slices, utf8
from wavegrid.session import ensure_checkpoint_dir

#: Letters are space, a to z and this many classes of other letters, by code point.
OTHERS = 37
LETTERS = 1 + 26 + OTHERS
NGRAM = 3
DIMENSIONS = 2048
SEED = 20_240_131
#: Most languages of a model, those of the most text, ties by name: what is sent to the workers is their table of LETTERS^3
#: numbers each, 200 MB at most. Texts of any further language are judged as the nearest of these.
LANGUAGES = 200
#: Code points whose letter class a worker remembers, one byte each.
POINTS = 0x110000
#: Bytes decoded at once; n-grams over the cuts are counted like any other.
PIECE = 1 << 20

_classes: list[np.ndarray] = []
_models: dict[str, tuple] = {}


def letter_classes() -> np.ndarray:
    """The class of every code point: 0 unless it is a letter, case aside."""
    if not _classes:
        found = np.zeros(POINTS, np.uint8)
        for c in range(POINTS):
            if (s := chr(c)).isalpha():
                low = s.lower()[0]
                found[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % OTHERS
        _classes.append(found)
    return _classes[0]


def gram_pieces(text: bytes) -> Iterator[np.ndarray]:
    """Numbers of the text's letter n-grams, piece by piece; runs of other characters are one space, and spaces stand around it."""
    decode, held = getincrementaldecoder("utf-8")("replace").decode, np.zeros(1, np.int64)
    for at in range(0, max(1, len(text)), PIECE):
        last = at + PIECE >= len(text)
        points = np.frombuffer(decode(text[at : at + PIECE], last).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.concatenate((held, letter_classes()[points], [0] if last else [])).astype(np.int64)
        letters = letters[np.r_[True, (letters[1:] != 0) | (letters[:-1] != 0)]]
        grams = letters[: max(0, len(letters) - NGRAM + 1)].copy()
        for k in range(1, NGRAM):
            grams = grams * LETTERS + letters[k : len(grams) + k]
        held = letters[-(NGRAM - 1) :]
        yield grams


def ngrams(text: bytes) -> np.ndarray:
    """All of a text's n-grams in order."""
    return np.concatenate([*gram_pieces(text)])


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Bound vectors of n-grams: the product of the letters' random +-1 vectors, each rotated by its place."""
    base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), size=(LETTERS, dimensions))
    out = np.ones((len(grams), dimensions), np.int8)
    for k in range(NGRAM):
        letter = grams // LETTERS ** (NGRAM - 1 - k) % LETTERS
        out *= np.roll(base, NGRAM - 1 - k, axis=1)[letter]
    return out


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = counts.setdefault(lang, np.zeros(LETTERS**NGRAM, np.int64))
            for grams in gram_pieces(text):
                if len(grams) * 8 > LETTERS**NGRAM:
                    own += np.bincount(grams, minlength=len(own))
                else:
                    np.add.at(own, grams, 1)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["lang", "gram", "n"])


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their profiles' inner products with every n-gram vector, and the profiles' lengths.

    All rows with a text and a language are counted. A language's profile is the sum of its n-gram vectors;
    what reaches the driver is a count for each of LANGUAGES languages and n-gram, summed over all rows, some thousand
    each and 64^3 at most, whatever the number of rows. The mean profile is taken from each, so that what
    languages share does not count.
    """
    rows = df.select(F.col(lang_col).cast("string").alias("lang"), utf8(text_col).alias("text")).where("lang is not null and text is not null")
    ensure_checkpoint_dir(df.sparkSession)
    counts = map_batches(rows, _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).checkpoint()
    said = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    found = counts.join(F.broadcast(said.select("lang")), "lang").toPandas()
    names = sorted(found["lang"].unique())
    profiles = np.zeros((len(names), dimensions))
    sizes = np.zeros(len(names))
    where = {n: i for i, n in enumerate(names)}
    for i, own in found.groupby(found["lang"].map(where)):
        grams, n = own["gram"].to_numpy(), own["n"].to_numpy(np.float64)
        sizes[i] = np.sqrt((n**2).sum())
        for at in range(0, len(grams), 8192):
            profiles[i] += n[at : at + 8192] @ gram_vectors(grams[at : at + 8192], dimensions)
    if len(names):
        profiles /= np.maximum(sizes[:, None], 1)
    if len(names) > 1:
        profiles -= profiles.mean(axis=0)
    table = np.zeros((LETTERS**NGRAM, max(1, len(names))), np.float32)
    for at in range(0, len(table), 8192):
        grams = np.arange(at, min(at + 8192, len(table)))
        table[grams, : len(names)] = gram_vectors(grams, dimensions).astype(np.float32) @ profiles.T.astype(np.float32)
    return names, table, np.linalg.norm(profiles, axis=1)


def cosines(text: bytes, table: np.ndarray, norms: np.ndarray, dimensions: int) -> np.ndarray | None:
    """Cosine of the text's bundled n-gram vector with each profile; None without a letter.

    The bundle's inner product with a profile is the sum of its n-grams' products, which is exact. Its
    length takes different n-gram vectors as orthogonal, which random ones nearly are, and is the same
    for all languages, so that it does not change which is first.
    """
    total, counts, some = np.zeros(table.shape[1]), None, False
    for grams in gram_pieces(text):
        some = some or bool((grams % LETTERS > 0).any() or (grams // LETTERS % LETTERS > 0).any())
        total += table[grams].sum(axis=0, dtype=np.float64)
        if len(text) <= PIECE:
            grams = np.sort(grams)
            counts = np.diff(np.r_[np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]), len(grams)]) if len(grams) else grams
        else:
            own = np.bincount(grams, minlength=LETTERS**NGRAM)
            counts = own if counts is None else counts + own
    if not some:
        return None
    n = np.asarray(counts, np.float64)
    return total / np.maximum(norms * np.sqrt((n**2).sum() * dimensions), 1e-12)


def _predict(batches, shared, key: str, dimensions: int):
    if key not in _models:
        _models.clear()
        _models[key] = pickle.loads(shared.value)
    names, table, norms = _models[key]
    for batch in slices(batches):
        langs, scores = [], []
        for text in batch.column(2).to_pylist():
            found = cosines(text, table, norms, dimensions) if text and names else None
            if found is None:
                langs.append("und")
                scores.append(0.0)
                continue
            weights = np.exp(8 * (found[: len(names)] - found.max()))
            best = int(np.argmax(weights))
            langs.append(names[best])
            scores.append(float(weights[best] / weights.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, dimensions: int = DIMENSIONS) -> DataFrame:
    """Per row: id, held_out, lang_pred and score.

    Profiles come from the rows whose crc32 of the id, as text, is not ``fold`` modulo ``folds``; rows with a
    null id are not held out. Predictions see the text only. The score is the best language's share of the
    exponentials of eight times the cosines; ties go to the first name. A text that is null or has no
    letter is ``und`` with score 0, as all are if there is nothing to learn from. Learning and predicting take the same
    n-grams of whole texts, however long. Repeated rows are learned from and predicted each. An empty table gives no rows.
    Other columns are ignored; nothing but n-gram counts is shuffled.
    """
    spark = df.sparkSession
    kept_out = held_out(id_col, folds, fold)
    names, table, norms = learn(df.where(~kept_out), text_col, lang_col, dimensions)
    packed = pickle.dumps((names, table, norms))
    rows = df.select(F.col(id_col).cast("long").alias("id"), kept_out.alias("held_out"), utf8(text_col).alias("text"))
    key = f"{spark.sparkContext.applicationId}:{hashlib.sha256(packed).hexdigest()}"
    return map_batches(rows, partial(_predict, shared=spark.sparkContext.broadcast(packed), key=key, dimensions=dimensions), "id long, held_out boolean, lang_pred string, score double")
