"""Exact duplicates by a tree of merges: runs of digests meet in rounds until one merged run, spread over all tasks, is left."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.scan import hot_join
from wavegrid.session import ensure_checkpoint_dir

#: Runs that are merged into one in a round.
FAN_IN = 4
#: Values of a digest's leading bits that a merged run is spread by.
SLICES = 1 << 16


def normalised(text: Column) -> Column:
    """A text with A-Z in lower case and all else as it is; null counts as empty."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower())


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, sha, bytes)`` of every row: the leading 63 bits of the SHA-256 of its normalised text, all of it, and the text's length."""
    text = normalised(F.col(f"`{text_col}`"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.octet_length(text).alias("bytes"))
    return rows.withColumn("digest", F.shiftrightunsigned(F.conv(F.hex(F.substring("sha", 1, 8)), 16, -10).cast("long"), 1))


def merge_runs(runs: DataFrame, rounds: int, fan_in: int = FAN_IN) -> DataFrame:
    """(digest, sha, bytes, id, n) from runs (run, digest, sha, bytes, id, n): the largest id and all rows of each digest.

    In a round ``fan_in`` neighbouring runs become one. A merged run is sliced by the leading bits of its digests, so that
    as many tasks as before share it, and each task merges its slices sorted by digest, in the memory of one digest. Digests are
    one only if the whole SHA-256 and the length of the text agree. After ``rounds`` rounds one run is left.
    """
    for _ in range(rounds):
        sliced = runs.withColumns({"run": F.floor(F.col("run") / fan_in).cast("int"), "slice": F.shiftrightunsigned("digest", 63 - int(math.log2(SLICES)))})
        dealt = sliced.repartition("run", "slice").sortWithinPartitions("run", "slice", "digest", "sha", "bytes")
        # a struct keeps the merge sort-based, on the order that is there
        runs = dealt.groupBy("run", "slice", "digest", "sha", "bytes").agg(F.max(F.struct("id")).alias("best"), F.sum("n").alias("n")).select("run", "digest", "sha", "bytes", "best.id", "n")
    return runs.drop("run")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """``(id, keep, size, kept, sha)`` of every row: ``keep`` is the largest id of the rows of equal text, ``size`` their number.

    Texts are equal if they are identical once A-Z are in lower case; null is the empty text. ``kept`` says whether the row has
    that largest id, so repeated rows of a kept id are all kept. Null ids come last: a row without one is kept only
    where no equal text has an id, and its ``keep`` is null there. An empty table gives no rows. Other columns are ignored.

    Texts are read once, where they lie; then only an id, a digest and two counts of a row travel. Each task first merges its own
    rows, so that a text's many copies are one entry a task before any exchange, and at every level again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = digests(df, id_col, text_col).checkpoint()
    rows = rows.withColumn("run", F.spark_partition_id())
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    own = rows.groupBy("run", "digest", "sha", "bytes").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    rounds = max(1, math.ceil(math.log(max(2, runs), fan_in)))
    merged = merge_runs(own, rounds, fan_in).select("digest", "sha", "bytes", F.col("id").alias("keep"), F.col("n").alias("size")).checkpoint()
    found = hot_join(rows.drop("run"), merged, ["digest", "sha", "bytes"], "size")
    return found.select("id", "keep", "size", F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("sha")).alias("sha"))


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose id is the largest of their text's; null ids as in ``exact_duplicates``."""
    from wavegrid.llm.scan import small_or_plain, whole_row

    drop = exact_duplicates(df, id_col, text_col).where("NOT kept").select(F.struct("id", "sha").alias("gone")).distinct().checkpoint()
    sha = F.sha2(normalised(F.col(f"`{text_col}`")).cast("binary"), 256)
    rows = df.select(whole_row(df).alias("row"), F.struct(F.col(f"`{id_col}`").cast("long").alias("id"), sha.alias("sha")).alias("gone"))
    return rows.join(small_or_plain(drop), "gone", "left_anti").select("row.*")
