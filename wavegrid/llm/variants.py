"""Spelling variants: words that differ by one inserted, deleted or replaced letter meet by hashes of their deletions."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.llm.buckets import groups
from wavegrid.llm.scan import map_batches, slices, small_or_plain, utf8
from wavegrid.session import stored_tables

#: Runs of A-Z, a-z and U+00C0 to U+00FF, as UTF-8 once A-Z are in lower case.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One in so many pairs of document and word has a letter deleted.
MISTYPED = 97
#: Different words that a task counts before it passes the counts on.
COUNTED = 200_000
#: Letters whose deletion keys are made at once, unless a single word has more.
LETTERS = 1 << 18
#: The base of the polynomial hashes: odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
#: Kinds of keys: one letter replaced at a place, a word without a letter, the word itself.
REPLACED, LONGER, OWN = 0, 1, 2
RADIX_BITS = 16


def mistyped(doc: bytes, run: bytes) -> bytes:
    """The run, without one letter if 97 divides the CRC-32 of ``doc`` (an id and a colon) and the run."""
    h = zlib.crc32(run, zlib.crc32(doc))
    if h % MISTYPED:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _counted(batches):
    total: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        words = [(w, n) for w, n in total.items() if len(w) >= LEAST_LETTERS and len(w.decode()) >= LEAST_LETTERS]
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], ["word", "n"])

    for batch in slices(batches):
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            doc = (name or b"") + b":"
            for run, n in Counter(RUN.findall((text or b"").lower())).items():
                total[mistyped(doc, run)] += n
        if len(total) >= COUNTED:
            yield rows()
            total.clear()
    yield rows()


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of all words of at least five letters that occur at least ``least`` times."""
    rows = df.select(utf8(f"`{id_col}`").alias("id"), utf8(f"`{text_col}`").alias("text"))
    counts = map_batches(rows, _counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers spread over all places."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, kind, letter, word) of all words, the last as its place in the list.

    With polynomial sums over a word's letters, prefix and suffix sums give the hash of the word without letter i: the sum
    before i, and the one after it over the base. A word has one key for each letter to be replaced, with the letter's place in
    it, one for each different word that it becomes without a letter, and its own.
    """
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(letters)) - first[word]
    term = _mixed(letters + np.uint64(1)) * _powers(int(size.max(initial=0)))[place]
    upto = np.cumsum(term, dtype=np.uint64)
    before = np.r_[np.uint64(0), upto]
    prefix = before[:-1] - before[first[word]]
    whole = before[first + size] - before[first]
    suffix = whole[word] - prefix - term
    without = _mixed(prefix + suffix * np.uint64(pow(BASE, -1, 1 << 64)))
    other = np.r_[True, (letters[1:] != letters[:-1]) | (place[1:] == 0)][: len(letters)]
    key = np.r_[_mixed(without + place.astype(np.uint64) + np.uint64(1)), without[other], _mixed(whole)]
    kind = np.repeat(np.array([REPLACED, LONGER, OWN], np.int8), [len(letters), int(other.sum()), len(words)])
    return key.view(np.int64), kind, np.r_[place, place[other], np.full(len(words), -1)], np.r_[word, word[other], np.arange(len(words))]


def _keys(batches):
    for batch in slices(batches):
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        sizes = np.cumsum([len(w) for w in words])
        for own in np.split(np.arange(len(words)), np.flatnonzero(np.diff(sizes // LETTERS)) + 1):
            if len(own):
                key, kind, letter, word = deletion_keys([words[i] for i in own])
                for at in range(0, len(key), LETTERS):
                    part = slice(at, at + LETTERS)
                    yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(kind[part]), pa.array(letter[part], pa.int32()), pa.array(ids[own][word[part]])], ["key", "kind", "letter", "id"])


def _shared(batches):
    """Of rows sorted by key, those of keys that can link two words: one replaced letter of several, or a word and others without a letter."""
    for columns in groups(batches, 4):
        key, kind = columns[0].to_numpy(), columns[1].to_numpy()
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        useful = (size > 1) & np.logical_or.reduceat(kind != LONGER, start) if len(start) else size > 1
        own = pa.array(np.repeat(useful, size))
        yield from pa.table(columns, ["key", "kind", "letter", "id"]).filter(own).to_batches()


def near_words(words: DataFrame) -> DataFrame:
    """``(id, n_near, best)`` of the words that have near ones; ``words`` (id, word, n) is stored and its ids differ.

    ``best`` (m, word, id) is the near word of largest n, m being -n, ties by code points. Keys are dealt to tasks by their
    leading bits and sorted; those with a single word go before any string travels. The words of the others are fetched, and only
    words that are the same without their letter are near. A key has at most one word for each letter of the alphabet and place.
    """
    keys = map_batches(words.select("id", "word"), _keys, "key long, kind byte, letter int, id long")
    radix = F.shiftrightunsigned("key", 64 - RADIX_BITS)
    dealt = keys.withColumn("radix", radix).repartition("radix").sortWithinPartitions("key").select("key", "kind", "letter", "id")
    met = map_batches(dealt, _shared, "key long, kind byte, letter int, id long")
    rows = met.join(small_or_plain(words, F.octet_length("word")), "id")
    rest = F.when(F.col("kind") == OWN, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, letter)"), F.expr("substring(word, letter + 2)")))
    slot = F.when(F.col("kind") == REPLACED, F.col("letter")).otherwise(-1)
    rows = rows.select("key", slot.alias("slot"), rest.alias("rest"), "id", (F.col("kind") == OWN).alias("own"), F.struct((-F.col("n")).alias("m"), "word", "id").alias("me"))
    group = Window.partitionBy("key", "slot", "rest")
    ranked = group.orderBy(F.desc("own"), "me").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"size": F.count(F.lit(1)).over(group), "first": F.first(F.struct("own", "me")).over(ranked), "second": F.nth_value("me", 2).over(ranked)})
    mine = F.col("id") == F.col("first.me.id")
    linked = (F.col("size") > 1) & ((F.col("slot") >= 0) | F.col("first.own"))
    near = F.when((F.col("slot") >= 0) | F.col("own"), F.col("size") - 1).otherwise(1)
    return rows.where(linked).select("id", near.alias("near"), F.when(mine, F.col("second")).otherwise(F.col("first.me")).alias("best")).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame, most: int, store) -> DataFrame:
    """(id, to) with ``to`` moved to the end of its chain. A form has at least twice the count, so that chains have at most
    log2(most) links, and every round halves them."""
    for _ in range(max(0, most.bit_length() - 1).bit_length()):
        ahead = forms.select(F.col("id").alias("at"), F.col("to").alias("next"))
        forms = store(forms.join(small_or_plain(ahead), F.col("to") == F.col("at"), "left").select("id", F.coalesce("next", "to").alias("to")))
    return forms


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``df``'s texts.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, of five letters or more, that occur at least
    ``least`` times; where 97 divides the CRC-32 of id, colon and run, the run is counted without one letter. Two words are near
    if one letter inserted, deleted or replaced makes one the other. ``form`` is the near word of largest ``n`` (ties: the
    smallest by code points) if that is at least twice the word's, else null; ``root`` follows forms to the last.

    Null and empty texts have no words; a null id counts as an empty one; repeated rows count each time; a table without
    words gives no rows. Runs may be of any length. Other columns are ignored. Counts are partial before they are shuffled.
    """
    spark = df.sparkSession
    with stored_tables(spark) as store:
        words = store(word_counts(df, id_col, text_col, least).withColumn("id", F.monotonically_increasing_id()))
        near = store(near_words(words))
        best = F.col("best")
        held = F.when(-best["m"] >= 2 * F.col("n"), best)
        found = store(words.join(small_or_plain(near, F.octet_length("best.word")), "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), held.alias("form")))
        most = words.agg(F.max("n")).first()[0] or 0
        forms = _roots(store(found.where("form IS NOT NULL").select("id", F.col("form.id").alias("to"))), most, store)
        named = words.select(F.col("id").alias("to"), F.col("word").alias("root"))
        ends = forms.join(small_or_plain(named, F.octet_length("root")), "to").select("id", "root")
        out = found.join(small_or_plain(store(ends), F.octet_length("root")), "id", "left")
        return out.select("word", F.col("form.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("form.m")).alias("form_n")).checkpoint()
