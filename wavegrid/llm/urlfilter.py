"""URL filters: rules by host and path, host word segmentation and naive Bayes for the rest."""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from wavegrid.llm.scan import hot_join, map_batches, slices
from wavegrid.session import ensure_checkpoint_dir

# The rules, as verdict, host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Words that count as seen on SEED_PAGES more unwanted pages each, a prior that pages under rules outweigh.
SEEDS = ("adult", "ads", "bet", "bets", "betting", "casino", "cheap", "dating", "escort", "farm", "gambling", "jackpot", "loan", "loans", "lottery", "payday", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx")

#: Bytes of words, or of tokens' weights, that may be sent to the workers, where each counts ENTRY besides its letters. Where there are
#: more, runs of letters and pages are joined with the whole tables instead, to the same result.
MODEL_BYTES = 8 << 20
ENTRY = 100
SEED_PAGES = 8
#: One page in so many, by a hash of its host and path, is left out of learning, and such pages set the odds from which a page is
#: blocked: those that at most this share of the ones that rules allow exceeds.
FOLD, FALSE_SHARE = 5, 0.05
#: Longest word of the lexicon; a longer one is known by its parts.
LONGEST = 24
#: Host names whose words a worker remembers.
HOSTS = 20_000

_models: dict[str, Segmenter | dict] = {}
_PARTS = re.compile(r"[^a-z\x80-\U0010ffff]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first ``://`` and the first ``/``, ``?`` or ``#``, A-Z in lower case; from there up to ``?`` or ``#``. Both empty without ``://``."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(found, whole, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(found, whole, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text without the path's first slash doubled, and its verdict; nulls if none fits."""
    rule = verdict = None
    for says, on, below in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == on) | F.endswith(host, F.lit(f".{on}"))) & F.startswith(path, F.lit(below))
        rule = F.when(fits, on + below) if rule is None else rule.when(fits, on + below)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


class Segmenter:
    """Unigram Viterbi: the split of a run of letters into words of highest product of probabilities."""

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(total)
        self.seen: dict[str, tuple[str, ...]] = {}

    def split(self, run: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(run) + 1):
            # an unknown word costs more with each letter than any known one
            best.append(min((best[start][0] + self.cost.get(run[start:end], self.unknown + 3.0 * (end - start)), start) for start in range(max(0, end - LONGEST), end)))
        words, end = [], len(run)
        while end:
            start = best[end][1]
            words.append(run[start:end])
            end = start
        return words[::-1]

    def host(self, host: str) -> tuple[str, ...]:
        if host not in self.seen:
            if len(self.seen) >= HOSTS:
                self.seen.clear()
            self.seen[host] = tuple(w for run in _PARTS.split(host) if run for w in self.split(run))
        return self.seen[host]


def _model(shared, key: str):
    if key not in _models:
        if len(_models) > 1:
            _models.clear()
        held, total = pickle.loads(shared.value)
        _models[key] = Segmenter(held, total) if total is not None else held
    return _models[key]


def _segmented(batches, shared, key: str):
    segmenter = _model(shared, key)
    for batch in slices(batches):
        found = [[list(segmenter.host(h)) for h in batch.column(c).to_pylist()] for c in ("named", "view")]
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f, pa.list_(pa.string())) for f in found)], [*batch.schema.names, "words", "own"])


def _split_runs(batches, total: int):
    for batch in slices(batches):
        known = batch.column("known").to_pylist()
        words = [Segmenter({k["word"]: k["n"] for k in own or []}, total).split(run) for run, own in zip(batch.column("run").to_pylist(), known, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("n"), pa.array(words, pa.list_(pa.string()))], ["run", "n", "words"])


def _with_tokens(batches):
    """Words of the host's view, and runs of letters of the path's."""
    for batch in slices(batches):
        found = [[*(f"h:{w}" for w in own), *(f"p:{w}" for w in _PARTS.split(path.lower()) if w)] for own, path in zip(batch.column("own").to_pylist(), batch.column("way").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "tokens"])


def _scored(batches, shared, key: str):
    weights = _model(shared, key)
    for batch in slices(batches):
        odds = [sum(weights.get(t, 0.0) for t in tokens) for tokens in batch.column("tokens").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds, pa.float64())], [*batch.schema.names, "odds"])


def _fits(df: DataFrame, name: str, limit: int) -> bool:
    return (df.agg(F.sum(F.octet_length(name) + ENTRY)).first()[0] or 0) <= limit


def _sent(spark: SparkSession, held: dict, total: int | None = None) -> dict:
    packed = pickle.dumps((held, total))
    return {"shared": spark.sparkContext.broadcast(packed), "key": f"{spark.sparkContext.applicationId}:{hashlib.sha256(packed).hexdigest()}"}


def _more(df: DataFrame, **columns: str) -> StructType:
    return StructType([*df.schema.fields, *(StructField(n, ArrayType(StringType()) if t == "words" else DoubleType()) for n, t in columns.items())])


def view(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """What is left of a host and a path without all that a rule may have looked at, so that pages which rules judge and others are seen alike.

    The host loses its last label and before it those that a rule names; the path loses as many first directories as a rule's has, whatever they are.
    """
    labels = sorted({re.escape(x) for _, on, _ in rules for x in on.split(".")})
    deep = max((below.count("/") - 1 for *_, below in rules), default=0)
    return F.regexp_replace(host, rf"(?:(?:^|\.)(?:{'|'.join(labels) or '(?!)'}))*(?:^|\.)[^.]*$", ""), F.regexp_replace(path, rf"^(?:/[^/]*(?=/)){{0,{max(0, deep)}}}", "")


def segmented(rows: DataFrame, words: DataFrame, total: int, limit: int = MODEL_BYTES) -> DataFrame:
    """``rows`` with the words of their ``named`` and ``view`` hosts, as ``words`` and ``own``; the first labels of ``named`` are those of ``view``.

    A lexicon (word, n) within ``limit`` is sent to the workers. A larger one is joined with all short parts of the different
    runs of letters, so that each run is split by the words that it holds; hosts and runs are split once, however many rows have them.
    """
    if _fits(words, "word", limit):
        sent = _sent(rows.sparkSession, {r.word: r.n for r in words.collect()}, total)
        return map_batches(rows, partial(_segmented, **sent), _more(rows, words="words", own="words"))
    parts = lambda c: F.filter(F.split(c, r"[^a-z\x{80}-\x{10ffff}]+"), lambda x: x != "")
    hosts = rows.groupBy("named", "view").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    runs = hosts.select(F.explode(parts("named")).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    at = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    subs = at.select("run", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("run") - F.col("i") + 1)), lambda k: F.substring("run", F.col("i"), k))).alias("word")).distinct().checkpoint()
    needed = words.join(subs.groupBy("word").agg(F.count(F.lit(1)).alias("many")), "word").checkpoint()
    known = hot_join(subs, needed, ["word"], "many").groupBy("run").agg(F.collect_list(F.struct("word", F.col("n"))).alias("known"))
    split = map_batches(runs.join(known, "run", "left").select("run", "n", "known"), partial(_split_runs, total=total), "run string, n long, words array<string>").checkpoint()
    each = hosts.select("named", "view", F.posexplode(parts("named")).alias("at", "run"))
    found = hot_join(each, split, ["run"], "n").groupBy("named", "view").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("w"))
    flat = lambda w: F.coalesce(F.flatten(F.transform(w, lambda x: x["words"])), F.array().cast("array<string>"))
    named = hosts.join(found, ["named", "view"], "left").select("named", "view", "n", flat(F.col("w")).alias("words"), flat(F.slice("w", F.lit(1), F.size(parts("view")))).alias("own")).checkpoint()
    return hot_join(rows, named, ["named", "view"], "n").select(*rows.columns, "words", "own")


def lexicon(df: DataFrame, url_col: str, html_col: str | None) -> DataFrame:
    """(word, n) of words of pages, of what follows hosts in URLs and of parts of host labels with hyphens, over all rows.

    Other host labels are what the segmenter splits, so they don't count as words.
    """
    url = F.lower(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    labels = F.filter(F.split(host_and_path(url)[0], r"\."), lambda x: F.contains(x, F.lit("-")))
    rest = F.regexp_replace(url, r"(?s)^.*?://[^/?#]*", "")
    url_words = F.split(F.concat_ws(" ", rest, F.array_join(labels, " ")), r"[^a-z]+")
    page_words = F.split(F.lower(F.coalesce(F.col(html_col).cast("string"), F.lit(""))), r"[^\p{L}]+") if html_col else F.array().cast("array<string>")
    words = df.select(F.explode(F.concat(url_words, page_words)).alias("word")).where(F.length("word").between(2, LONGEST))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).checkpoint()


@dataclass(frozen=True)
class Model:
    """Words and their counts, their total, tokens with their log-odds for block against allow, and the log-odds of the classes."""

    words: DataFrame
    total: int
    weights: DataFrame
    bias: float


def _tokenised(df: DataFrame, host: Column, path: Column, carried: list[Column], words: DataFrame, total: int, rules, limit: int) -> DataFrame:
    seen, way = view(host, path, rules)
    rows = segmented(df.select(*carried, _registered(host).alias("named"), seen.alias("view"), way.alias("way")), words, total, limit)
    return map_batches(rows, _with_tokens, _more(rows, tokens="words"))


def _place(host: Column, rules=RULES) -> Column:
    """The longest host of a rule that a host is or lies under; null without one."""
    found = F.lit(None).cast("string")
    for on in sorted({on for _, on, _ in rules}, key=lambda x: (len(x), x)):
        found = F.when((host == on) | F.endswith(host, F.lit(f".{on}")), on).otherwise(found)
    return found


def _left_out(host: Column, path: Column, fold: int = FOLD) -> Column:
    """Whether a page is one of those left out."""
    return F.pmod(F.xxhash64(host, path), F.lit(fold)) == 0 if fold else F.lit(False)


def learn(df: DataFrame, url_col: str, html_col: str | None, rules=RULES, limit: int = MODEL_BYTES, held: Column | None = None, fold: int = FOLD) -> Model:
    """Naive Bayes of the pages that rules block and allow.

    A page that a rule blocks counts as block, one that a rule allows as allow; ``held`` rows, one page in ``fold`` and pages
    without a rule are not learned from. Nor are pages under a rule's host where rules give one verdict alone, as long as there
    are pages under one with both: there, the place decided, whatever the words. Tokens are those of ``view``, which
    tell no rule from another. Token counts are over all such pages, added up
    before they are shuffled, and none is dropped; each token counts once more in each class, seeds SEED_PAGES times more as block.
    """
    ensure_checkpoint_dir(df.sparkSession)
    words = lexicon(df, url_col, html_col)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    host, path = host_and_path(F.col(url_col).cast("string"))
    says = rule_for(host, path, rules)[1]
    used = (~F.coalesce(held, F.lit(False)) if held is not None else F.lit(True)) & ~_left_out(host, path, fold)
    pages = df.select(says.alias("says"), host.alias("host"), path.alias("path"), used.alias("used")).where("used AND says IS NOT NULL").withColumn("place", _place(F.col("host"), rules))
    mixed = [r.place for r in pages.groupBy("place").agg(F.countDistinct("says").alias("kinds")).where("kinds > 1").collect()]
    pages = pages.where(F.col("place").isin(mixed)) if mixed else pages
    tokens = _tokenised(pages, F.col("host"), F.col("path"), [F.col("says")], words, total, rules, limit)
    each = tokens.select(F.explode(F.array_append("tokens", F.lit(""))).alias("token"), (F.col("says") == "block").alias("block"))
    by = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("block").alias("b")).checkpoint()
    pages_of = by.where("token = ''").select("n", "b").first() or (0, 0)
    by = by.where("token <> ''")
    every, blocked, kinds = by.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0)), F.count(F.lit(1))).first()
    seeds = df.sparkSession.createDataFrame([(f"{part}:{w}", 0, 0) for w in SEEDS for part in "hp"], "token string, n long, b long")
    both = by.unionByName(seeds).groupBy("token").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    prior = 1 + SEED_PAGES * F.substring("token", 3, 1 << 30).isin(*SEEDS).cast("int")
    weight = F.log((F.col("b") + prior) / (blocked + kinds + 1)) - F.log((F.col("n") - F.col("b") + 1) / (every - blocked + kinds + 1))
    return Model(words, total, both.select("token", weight.alias("weight")).checkpoint(), math.log((pages_of[1] + 1) / (pages_of[0] - pages_of[1] + 1)))


def _registered(host: Column) -> Column:
    """Without the last label, which says where a host is registered."""
    return F.regexp_replace(host, r"\.[^.]*$", "")


def with_odds(rows: DataFrame, weights: DataFrame, limit: int = MODEL_BYTES) -> DataFrame:
    """``rows`` with ``odds``: the sum of the weights (token, weight) of their ``tokens``, one without a weight counting 0."""
    if _fits(weights, "token", limit):
        return map_batches(rows, partial(_scored, **_sent(rows.sparkSession, {r.token: r.weight for r in weights.collect()})), _more(rows, odds="double"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    each = rows.select("_row", F.explode("tokens").alias("token"))
    needed = weights.join(each.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token").checkpoint()
    summed = hot_join(each, needed, ["token"], "n").groupBy("_row").agg(F.sum("weight").alias("odds"))
    return rows.join(summed, "_row", "left").drop("_row").withColumn("odds", F.coalesce("odds", F.lit(0.0)))


#: Hundredths of log-odds that a threshold may reach.
MOST_ODDS = 10_000


def _threshold(allowed: DataFrame) -> float:
    """The least hundredth, from 0, that at most FALSE_SHARE of the rows' log_odds exceed; 0 without rows."""
    step = F.least(F.greatest(F.ceil(F.col("log_odds") * 100), F.lit(0)), F.lit(MOST_ODDS)).cast("int")
    counts = {r.step: r.n for r in allowed.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}
    every, over, least = sum(counts.values()), 0, 0
    for k in sorted(counts, reverse=True):
        if over + counts[k] > FALSE_SHARE * every:
            least = k
            break
        over += counts[k]
    return least / 100


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", rules=RULES, limit: int = MODEL_BYTES, held: Column | None = None, fold: int = FOLD) -> DataFrame:
    """Per row: id, host, path, rule, verdict, host_words and log_odds.

    The longest rule that fits decides; where none does, naive Bayes over the words of the segmented host and
    of the path does, learned from the pages that rules block and allow (but not from ``held`` ones): block at log-odds over a threshold, in
    hundredths and at least 0, which FALSE_SHARE of the allowed pages that were left out of learning exceed at most.
    The same ``view`` of host and path is learned from and judged. The whole host is
    segmented, whatever its length, in time linear in it. Odds of a token that no such page has are even. Null URLs and
    such without ``://`` have an empty host and path and only the classes' odds; so have all pages if no rule fits any, and
    without blocked or without allowed pages tokens still weigh, by their one class and the seeds.
    Repeated rows and null ids give a row each; ties between splits of a host go to the longer last word, and an empty table
    gives no rows. Other columns are ignored. ``limit`` changes how the tables travel and never the result.
    """
    model = learn(df, url_col, html_col, rules, limit, held, fold)
    host, path = host_and_path(F.col(url_col).cast("string"))
    work = df.select(F.col(id_col).cast("long").alias("id"), host.alias("full"), path.alias("path"))
    work = _tokenised(work, F.col("full"), F.col("path"), [F.col("id"), F.col("full"), F.col("path")], model.words, model.total, rules, limit)
    work = with_odds(work, model.weights, limit).withColumn("log_odds", F.col("odds") + model.bias).drop("tokens", "named", "view", "way", "own").checkpoint()
    rule, says = rule_for(F.col("full"), F.col("path"), rules)
    least = _threshold(work.where((says == "allow") & _left_out(F.col("full"), F.col("path"), fold)))
    verdict = F.coalesce(says, F.when(F.col("log_odds") > least, "block").otherwise("allow"))
    return work.select("id", F.col("full").alias("host"), "path", rule.alias("rule"), verdict.alias("verdict"), F.array_join("words", " ").alias("host_words"), "log_odds")
