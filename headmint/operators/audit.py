"""Data-quality audit of message columns.

Each check is a predicate. A column family's predicates become one aggregation, turned into
rows (column_name, issue, count); checks with a count of zero are left out. The full report
makes one aggregation of all families, and one pass finds all examples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headmint.functions import patterns as P
from headmint.functions.text import count_char, extract, or_empty, staged, truncate


def blank(c: Column) -> Column:
    return F.rlike(c, F.lit(P.BLANK))


def _common(c: Column) -> dict[str, Column]:
    """Checks that senders and recipient items share; a null has none of these faults."""
    s = or_empty(c)
    return {
        "ocr_markup_tags": F.rlike(s, F.lit(P.TAG)),
        "unmatched_angle_brackets": count_char(s, "<") != count_char(s, ">"),
        "multiple_at_signs_or_merged_addresses": count_char(s, "@") > 1,
        "whitespace_artifacts": F.rlike(s, F.lit(P.STRAY_SPACE)),
    }


def masked(c: Column) -> Column:
    return F.rlike(F.lower(or_empty(c)), F.lit(P.MASK))


def without_address(c: Column) -> Column:
    return c.isNotNull() & ~blank(c) & ~F.contains(c, F.lit("@"))


def sender_checks(c: Column) -> dict[str, Column]:
    return {"missing_or_blank": c.isNull() | blank(c), "no_email_address_present": without_address(c), "redacted_or_masked": masked(c), **_common(c)}


def list_checks(c: Column) -> dict[str, Column]:
    s = or_empty(c)
    return {"null_rows": c.isNull(), "empty_list_rows": F.rlike(s, F.lit(P.EMPTY_LIST)), "rows_containing_empty_string_items": F.rlike(s, F.lit(P.EMPTY_STRING_LIST))}


def item_checks(c: Column) -> dict[str, Column]:
    return {"recipient_items_without_email_address": without_address(c), "redacted_or_masked_items": masked(c), "empty_string_items": c.isNotNull() & blank(c), **_common(c)}


def account_checks(c: Column) -> dict[str, Column]:
    return {"missing_or_blank": c.isNull() | blank(c), "non_email_tokens": without_address(c)}


def participant_checks(c: Column) -> dict[str, Column]:
    s = or_empty(c)
    return {
        "placeholder_only_rows": F.rlike(s, F.lit(P.PLACEHOLDERS)),
        "contains_raw_empty_list_tokens": F.rlike(s, F.lit(P.EMPTY_TOKEN)),
        "leading_or_trailing_whitespace": F.rlike(s, F.lit(P.EDGE_SPACE)),
        "whitespace_artifacts": F.rlike(s, F.lit(P.STRAY_SPACE)),
        "lowercased_lossy_representation": ~F.rlike(s, F.lit("[A-Z]")),
    }


def counted(df: DataFrame, column: str, checks: dict[str, Column], extra: dict[str, Column] | None = None) -> DataFrame:
    """(column_name, issue, count) of one aggregation, without zeros. count_if is 0 on no rows."""
    totals = {k: F.count_if(v) for k, v in checks.items()} | (extra or {})
    row = df.agg(*(v.cast("bigint").alias(k) for k, v in totals.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("issue"), F.col(k).alias("count")) for k in totals)))
    return row.select(F.lit(column).alias("column_name"), pairs.alias("p")).select("column_name", "p.issue", "p.count").filter("count > 0")


def mailbox_variants(messages: DataFrame, column: str = "sender") -> DataFrame:
    """mailbox, variant_count: mailboxes written in more than one way."""
    mailbox = F.lower(extract(F.when(F.contains(F.col(column), F.lit("@")), F.col(column)), P.MAILBOX))
    found = messages.select(mailbox.alias("mailbox"), column).filter(F.col("mailbox").isNotNull())
    return found.groupBy("mailbox").agg(F.count_distinct(column).alias("variant_count")).filter("variant_count > 1")


def audit_sender(messages: DataFrame, column: str = "sender") -> DataFrame:
    variants = mailbox_variants(messages, column).agg(F.count(F.lit(1)).alias("count")).filter("count > 0")
    return counted(messages, column, sender_checks(F.col(column))).unionByName(variants.select(F.lit(column).alias("column_name"), F.lit("same_mailbox_with_multiple_sender_variants").alias("issue"), "count"))


def recipient_items(messages: DataFrame, column: str) -> DataFrame:
    """id, item of a JSON list column. Empty lists give no row: no check holds for a null item."""
    return messages.select("id", F.explode(F.from_json(column, "array<string>", {"mode": "PERMISSIVE"})).alias("item"))


def audit_recipients(messages: DataFrame, column: str) -> DataFrame:
    rows = counted(messages, column, list_checks(F.col(column)))
    return rows.unionByName(counted(recipient_items(messages, column), column, item_checks(F.col("item"))))


def audit_account(messages: DataFrame, column: str = "account_email") -> DataFrame:
    return counted(messages, column, account_checks(F.col(column)), {"distinct_non_null_values": F.count_distinct(column)})


def audit_participants(messages: DataFrame, column: str = "all_participants") -> DataFrame:
    return counted(messages, column, participant_checks(F.col(column)))


def examples(df: DataFrame, value: str, checks: dict[str, Column], limit: int = 3, key: str = "id") -> DataFrame:
    """(issue, position, example): the first `limit` non-null values of each check, by key, then value.

    One pass: a row becomes as many rows as checks it fails, and Spark keeps the first few
    of each check in every task before they meet.
    """
    failed = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in checks.items())), lambda x: x.isNotNull())
    hits = df.filter(F.col(value).isNotNull()).select(key, value, F.explode(failed).alias("issue"))
    first = F.row_number().over(Window.partitionBy("issue").orderBy(key, value))
    return hits.withColumn("position", first).filter(F.col("position") <= limit).select("issue", "position", truncate(F.col(value)).alias("example"))


def top_variants(messages: DataFrame, limit: int = 3, column: str = "sender") -> DataFrame:
    return mailbox_variants(messages, column).orderBy(F.desc("variant_count"), "mailbox").limit(limit)


def smallest_values(messages: DataFrame, column: str = "account_email", limit: int = 5) -> DataFrame:
    return messages.select(column).dropna().distinct().orderBy(column).limit(limit)


VARIANTS, VALUES = "same_mailbox_with_multiple_sender_variants", "distinct_non_null_values"


def _row_checks() -> dict[str, dict[str, Column]]:
    """Checks of whole values, by column."""
    lists = {c: list_checks(F.col(c)) for c in P.RECIPIENT_ROLES}
    return {"sender": sender_checks(F.col("sender")), **lists, "account_email": account_checks(F.col("account_email")), "all_participants": participant_checks(F.col("all_participants"))}


def _with_items(messages: DataFrame) -> DataFrame:
    """messages with the items of each JSON list, none for a list that is null or can't be read."""
    items = {f"{c}_items": F.coalesce(F.from_json(c, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>")) for c in P.RECIPIENT_ROLES}
    return staged(messages, items)


def _fails(issue: str) -> Callable[[Column], Column]:
    return lambda item: item_checks(item)[issue]


def full_report(messages: DataFrame) -> DataFrame:
    """The issue report of all audited columns: column_name, issue, count. One aggregation of all
    checks, items' included, and one of mailbox variants."""
    totals = {(c, k): F.count_if(v) for c, checks in _row_checks().items() for k, v in checks.items()}
    for c in P.RECIPIENT_ROLES:
        for k in item_checks(F.lit("")):
            totals[c, k] = F.coalesce(F.sum(F.size(F.filter(f"{c}_items", _fails(k)))), F.lit(0))
    totals["account_email", VALUES] = F.count_distinct("account_email")
    row = _with_items(messages).agg(*(v.cast("bigint").alias(f"{c}:{k}") for (c, k), v in totals.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("issue"), F.col(f"`{c}:{k}`").alias("count")) for c, k in totals)))
    variants = mailbox_variants(messages).agg(F.count(F.lit(1)).alias("count"))
    out = row.select(pairs.alias("p")).select("p.*").unionByName(variants.select(F.lit("sender").alias("column_name"), F.lit(VARIANTS).alias("issue"), "count"))
    return out.filter("count > 0")


def all_examples(messages: DataFrame, limit: int = 3) -> DataFrame:
    """(column_name, issue, position, example) of all checks, whole values and items, in one pass."""
    hit = lambda column, issue, bad, value: F.when(bad & value.isNotNull(), F.struct(F.lit(column).alias("column_name"), F.lit(issue).alias("issue"), value.alias("value")))
    rows = F.array(*(hit(c, k, v, F.col(c)) for c, checks in _row_checks().items() for k, v in checks.items()))
    of_item = lambda c: lambda i: F.array(*(hit(c, k, v, i) for k, v in item_checks(i).items()))
    items = [F.flatten(F.transform(f"{c}_items", of_item(c))) for c in P.RECIPIENT_ROLES]
    found = _with_items(messages).select("id", F.explode(F.filter(F.concat(rows, *items), lambda x: x.isNotNull())).alias("hit")).select("id", "hit.*")
    first = F.row_number().over(Window.partitionBy("column_name", "issue").orderBy("id", "value"))
    return found.withColumn("position", first).filter(F.col("position") <= limit).select("column_name", "issue", "position", truncate(F.col("value")).alias("example"))
