"""The set of alias keys that best explains a target's message total and ratio.

The candidate at position i of n is bit n - 1 - i of a mask. A message id becomes the OR of
the bits of the keys that it belongs to, and ids with one mask are counted together: the
search only sees a histogram of masks, whose size depends on n and not on the messages.
Of equal width, a larger mask is earlier in lexicographic order.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headmint.operators.keys import RECEIVED, SENT

MAX_KEYS = 24  # the kernel holds 2**n counts a side
JOIN_KEYS = 12  # up to here subsets meet the histogram in a join
EPSILON = 1e-9
PLACES = 9  # scores are compared after rounding

BEST_SCHEMA = "name string, picked bigint, sent bigint, received bigint, score double"


def histogram(cands: DataFrame, pairs: DataFrame) -> DataFrame:
    """name, side, mask, ids: how many ids belong to exactly the keys of mask."""
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), n - 1 - position)")
    masks = pairs.join(cands, "search_key").groupBy("name", "side", "id").agg(F.bit_or(bit).alias("mask"))
    return masks.groupBy("name", "side", "mask").agg(F.count(F.lit(1)).alias("ids"))


def score(sent: Column, received: Column, total: Column, ratio: Column) -> Column:
    """Relative error of the total plus the log error of the ratio; null without a received id."""
    log = F.abs(F.ln((sent / F.nullif(received, F.lit(0)) + EPSILON) / ratio))
    return F.abs(sent + received - total) / total + log


def _join_search(goals: DataFrame, hist: DataFrame) -> DataFrame:
    sets = goals.withColumn("picked", F.explode(F.sequence(F.lit(1).cast("bigint"), F.expr("shiftleft(CAST(1 AS BIGINT), n) - 1")))).filter(F.bit_count("picked") <= F.col("width"))
    met = sets.join(hist, "name").filter(F.col("picked").bitwiseAND(F.col("mask")) != 0)
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("ids")).otherwise(0))
    sums = met.groupBy("name", "total_emails", "ratio", "picked").agg(side(SENT).alias("sent"), side(RECEIVED).alias("received"))
    scored = sums.withColumn("score", F.round(score(F.col("sent"), F.col("received"), F.col("total_emails"), F.col("ratio")), PLACES)).filter(F.col("score").isNotNull())
    first = F.row_number().over(Window.partitionBy("name").orderBy("score", F.bit_count("picked"), F.desc("picked")))
    return scored.withColumn("place", first).filter("place = 1").select("name", "picked", "sent", "received", "score")


def hits(masks: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """For every set of n keys, how many ids belong to any of its keys (sums over subsets of the rest)."""
    inside = np.bincount(masks, weights=ids, minlength=1 << n)
    for b in range(n):
        view = inside.reshape(-1, 2, 1 << b)
        view[:, 1] += view[:, 0]
    return np.rint(ids.sum() - inside[::-1]).astype(np.int64)  # the complement of g is 2**n - 1 - g


def _scores(sent: np.ndarray, received: np.ndarray, total: float, ratio: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.abs(sent + received - total) / total + np.abs(np.log((sent / received + EPSILON) / ratio))
    return np.where(received > 0, np.round(s, PLACES), np.inf)


def _kernel(key, goal: pd.DataFrame, hist: pd.DataFrame) -> pd.DataFrame:
    out = []
    for g in goal.itertuples():
        n = int(g.n)
        if n > MAX_KEYS:
            raise ValueError(f"{g.name}: {n} candidates; at most {MAX_KEYS} can be searched")
        side = {s: hist[hist["side"] == s] for s in (SENT, RECEIVED)}
        sent, received = (hits(side[s]["mask"].to_numpy(np.int64), side[s]["ids"].to_numpy(np.float64), n) for s in (SENT, RECEIVED))
        picked = np.arange(1 << n, dtype=np.int64)
        width = np.bitwise_count(picked)
        good = np.flatnonzero((width >= 1) & (width <= g.width) & (received > 0))
        if len(good):
            s = _scores(sent[good], received[good], g.total_emails, g.ratio)
            k = good[np.lexsort((-picked[good], width[good], s))[0]]
            out.append((g.name, int(k), int(sent[k]), int(received[k]), float(s.min())))
    return pd.DataFrame(out, columns=["name", "picked", "sent", "received", "score"])


def goals_of(targets: DataFrame, cands: DataFrame) -> DataFrame:
    """Targets that have candidates, with n and width."""
    return targets.select("name", "total_emails", "ratio").join(cands.groupBy("name").agg(F.first("n").alias("n"), F.first("width").alias("width")), "name")


def best_subset(targets: DataFrame, cands: DataFrame, pairs: DataFrame, method: str = "auto") -> DataFrame:
    """name, picked (mask), sent, received, score of each target's best set of keys.

    Sets have 1 to width keys. The lowest score wins; ties go to fewer keys, then to the
    lexicographically first. A target for which no set has a received id has no row.
    method: "join" meets all sets with the histogram in a join; "kernel" sums over subsets in
    numpy, one task a target; "auto" takes the kernel for more than JOIN_KEYS candidates.
    """
    goals, hist = goals_of(targets, cands), histogram(cands, pairs)
    if method == "join":
        return _join_search(goals, hist)
    if method == "kernel":
        return goals.groupBy("name").cogroup(hist.groupBy("name")).applyInPandas(_kernel, BEST_SCHEMA)
    few, many = goals.filter(F.col("n") <= JOIN_KEYS), goals.filter(F.col("n") > JOIN_KEYS)
    kernel = many.groupBy("name").cogroup(hist.join(many.select("name"), "name", "left_semi").groupBy("name")).applyInPandas(_kernel, BEST_SCHEMA)
    return _join_search(few, hist).unionByName(kernel)


def _extras(n: Column, base: Column) -> Column:
    """Masks of 0 to 3 of the keys outside base."""

    def bits(size: int) -> Column:
        one = F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.shiftleft(F.lit(1).cast("bigint"), 0) * F.pow(F.lit(2.0), i).cast("bigint")), lambda m: m.bitwiseAND(base) == 0)
        if size == 1:
            return one
        smaller = bits(size - 1)
        return F.flatten(F.transform(smaller, lambda s: F.transform(F.filter(one, lambda m: m > s), lambda m: s.bitwiseOR(m))))

    return F.concat(F.array(F.lit(0).cast("bigint")), bits(1), bits(2), bits(3))


def directional_best(targets: DataFrame, cands: DataFrame, pairs: DataFrame, base: DataFrame) -> DataFrame:
    """name, picked, sender_extras, recipient_extras, sent, received, score for targets that ask for it.

    Up to three further keys count for one direction only. They replace the shared set only
    where the score is strictly lower; then sender_extras and recipient_extras are their
    masks, else 0. Two small tables, one a side, meet by target.
    """
    hist = histogram(cands, pairs)
    goal = targets.filter("directional").select("name", "total_emails", "ratio").join(cands.groupBy("name").agg(F.first("n").alias("n")), "name").join(base.select("name", "picked"), "name")
    choice = goal.select("name", "picked", F.explode(_extras(F.col("n"), F.col("picked"))).alias("extra"))

    def side(kind: str, mask: str, count: str) -> DataFrame:
        h = hist.filter(F.col("side") == kind)
        hit = F.sum(F.when(F.col("mask").bitwiseAND(F.col("picked").bitwiseOR(F.col("extra"))) != 0, F.col("ids")).otherwise(0))
        met = choice.join(h, "name", "left").groupBy("name", "extra").agg(F.coalesce(hit, F.lit(0)).cast("bigint").alias(count))
        return met.withColumnRenamed("extra", mask)

    both = side(SENT, "sender_extras", "sent").join(side(RECEIVED, "recipient_extras", "received"), "name").filter("sender_extras <> 0 OR recipient_extras <> 0")
    scored = both.join(goal, "name").withColumn("score", F.round(score(F.col("sent"), F.col("received"), F.col("total_emails"), F.col("ratio")), PLACES)).filter(F.col("score").isNotNull())
    s, r = F.col("sender_extras"), F.col("recipient_extras")
    first = F.row_number().over(Window.partitionBy("name").orderBy("score", F.bit_count(s), s.desc(), F.bit_count(r), r.desc()))
    better = scored.withColumn("place", first).filter("place = 1").select("name", "sender_extras", "recipient_extras", F.col("sent").alias("d_sent"), F.col("received").alias("d_received"), F.col("score").alias("d_score"))
    met = base.join(targets.filter("directional").select("name"), "name").join(better, "name", "left")
    wins = F.coalesce(F.col("d_score") < F.col("score"), F.lit(False))
    pick = lambda a, b: F.when(wins, F.col(a)).otherwise(b)
    zero = F.lit(0).cast("bigint")
    return met.select("name", "picked", pick("sender_extras", zero).alias("sender_extras"), pick("recipient_extras", zero).alias("recipient_extras"), pick("d_sent", F.col("sent")).alias("sent"), pick("d_received", F.col("received")).alias("received"), pick("d_score", F.col("score")).alias("score"))


def brute_force(keys: dict[str, tuple[set, set]], order: list[str], width: int, total: int, ratio: float) -> tuple | None:
    """The search by enumeration, for tests: (keys, sent, received, score)."""
    best = None
    for w in range(1, min(width, len(order)) + 1):
        for c in combinations(order, w):
            sent, received = (len(set().union(*(keys[k][side] for k in c))) for side in (0, 1))
            if received:
                s = round(abs(sent + received - total) / total + abs(float(np.log((sent / received + EPSILON) / ratio))), PLACES)
                if best is None or s < best[3]:
                    best = (c, sent, received, s)
    return best
