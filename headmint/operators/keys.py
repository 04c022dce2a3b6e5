"""Identity keys, the focus account, and ranked candidate keys for each target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headmint.functions import address
from headmint.functions.patterns import RECIPIENT_ROLES
from headmint.functions.text import contains_any, staged

SENT, RECEIVED = "sent", "received"


def with_keys(parsed: DataFrame) -> DataFrame:
    """parsed with search_key: the name's letters, or else the address's."""
    return staged(parsed, {"search_key": address.search_key(F.col("display_name"), F.col("email"))})


def is_focus(emails: list[str], aliases: list[str]) -> Column:
    return F.coalesce(F.col("email").isin(emails), F.lit(False)) | F.coalesce(F.col("search_key").isin(aliases), F.lit(False))


def focus_ids(keyed: DataFrame, emails: list[str], aliases: list[str]) -> DataFrame:
    """id, from_focus, to_focus: messages that the focus account sent, and those it got; one pass."""
    sender, recipient = F.col("address_role") == "sender", F.col("address_role").isin(*RECIPIENT_ROLES)
    hit = keyed.filter(is_focus(emails, aliases) & (sender | recipient))
    return hit.groupBy("id").agg(F.bool_or(sender).alias("from_focus"), F.bool_or(recipient).alias("to_focus"))


def exchanged(keyed: DataFrame, focus: DataFrame) -> DataFrame:
    """Distinct (search_key, side, id): sent is a key's message to the focus account, received
    one from it."""
    role = F.col("address_role")
    met = keyed.filter(F.col("search_key").isNotNull() & (role != "account_email")).join(focus, "id")
    side = F.when((role == "sender") & F.col("to_focus"), F.lit(SENT)).when(role.isin(*RECIPIENT_ROLES) & F.col("from_focus"), F.lit(RECEIVED))
    return met.select("search_key", side.alias("side"), "id").filter(F.col("side").isNotNull()).distinct()


def key_stats(keyed: DataFrame, pairs: DataFrame) -> DataFrame:
    """search_key, len (address rows of any role), sender_count, recipient_count (distinct ids)."""
    total = keyed.filter(F.col("search_key").isNotNull()).groupBy("search_key").agg(F.count(F.lit(1)).alias("len"))
    sides = pairs.groupBy("search_key").agg(F.count_if(F.col("side") == SENT).alias("sender_count"), F.count_if(F.col("side") == RECEIVED).alias("recipient_count"))
    return total.join(sides, "search_key", "left").fillna(0, ["sender_count", "recipient_count"])


def targets_with_rules(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """Targets and their rules. A target without a rule set is an error, as is one with two."""
    counted = rules.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("name")))
    met = targets.join(counted, "name", "left")
    none = F.raise_error(F.concat(F.lit("no rules for target "), F.col("name"))).cast("boolean")
    several = F.raise_error(F.concat(F.lit("several rule sets for target "), F.col("name"))).cast("boolean")
    checked = F.when(F.col("found").isNull(), none).when(F.col("found") > 1, several).otherwise(F.lit(True))
    return met.filter(checked).drop("found")


def candidates(stats: DataFrame, targets: DataFrame) -> DataFrame:
    """name, search_key, position (from 0), n, width: ranked candidate keys of each target.

    targets: name, include, exclude, prefer (arrays), min_evidence, cap, width. A key is a
    candidate if it holds an include token and no exclude token, and its evidence exceeds
    min_evidence or it is preferred. Preferred keys come first, in their order; then by len,
    ties by key. Targets and keys meet by a nested loop, in which Spark broadcasts the side that it
    measures as small; keys are scanned once.
    """
    key = F.col("search_key")
    preferred = F.array_position("prefer", key)
    met = stats.join(targets, contains_any(key, F.col("include")) & ~contains_any(key, F.col("exclude")))
    enough = (F.col("sender_count") + F.col("recipient_count") > F.col("min_evidence")) | (preferred > 0)
    order = Window.partitionBy("name").orderBy(F.when(preferred > 0, preferred).asc_nulls_last(), F.desc("len"), key)
    ranked = met.filter(enough).withColumn("position", F.row_number().over(order) - 1).filter(F.col("position") < F.col("cap"))
    n = F.count(F.lit(1)).over(Window.partitionBy("name")).cast("int")
    return ranked.withColumn("n", n).select("name", "search_key", "position", "n", F.least("width", "n").alias("width"))
