"""What one text says and another does not, for texts of any length: hashed runs of words, a row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import text as T

#: Words of a run.
RUN = 8


def runs(text: Column, n: int = RUN) -> Column:
    """Hashes of the runs of n words of a text; a shorter text is one run, an empty or null one has none."""
    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
        return F.when(F.size(w) >= n, each).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return T.bind(T.words(text), of)


def only_share(pairs: DataFrame, n: int = RUN) -> DataFrame:
    """pairs(id, before, after) -> (id, only_share, runs): the share of the distinct runs of `after` that `before` lacks, and their number.

    A run is a row of its own once it is hashed, and meets the same run of the other text by id and hash: no
    task holds two texts, or all runs of one. Runs are told apart by 64 bits within a pair. A pair without
    runs in `after` has the share 0. id identifies a row.
    """
    def side(c: str, flag: int) -> DataFrame:
        return pairs.select("id", F.explode(runs(F.col(c), n)).alias("run"), F.lit(flag).alias("side"))

    met = side("before", 1).unionAll(side("after", 2)).groupBy("id", "run").agg(F.bit_or("side").alias("sides"))
    g = met.where("sides >= 2").groupBy("id").agg(F.count_if(F.col("sides") == 2).alias("own"), F.count("*").alias("runs"))
    out = pairs.select("id").join(g, "id", "left")
    zero = F.lit(0).cast("long")
    return out.select("id", F.round(F.coalesce(F.try_divide("own", "runs"), F.lit(0.0)), 3).alias("only_share"), F.coalesce("runs", zero).alias("runs"))
