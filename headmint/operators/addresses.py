"""From messages to one row per address, and what is read off those rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headmint.functions import address, text
from headmint.functions.patterns import RECIPIENT_ROLES


def keep_regular(messages: DataFrame) -> DataFrame:
    """Messages known not to be promotional; those with a null flag go too."""
    return messages.filter(F.col("is_promotional") != F.lit(True)).drop("is_promotional")


def json_list(c: Column) -> Column:
    """A JSON array of strings. What doesn't parse is null (see unparsed_lists); null is empty."""
    return F.from_json(F.coalesce(c, F.lit("[]")), "array<string>", {"mode": "PERMISSIVE"})


def unparsed_lists(messages: DataFrame) -> DataFrame:
    """column_name, rows whose list isn't valid JSON: json_list reads those as null."""
    counts = messages.agg(*(F.count_if(json_list(F.col(c)).isNull()).alias(c) for c in RECIPIENT_ROLES)).select(F.explode(F.create_map(*(x for c in RECIPIENT_ROLES for x in (F.lit(c), F.col(c))))).alias("column_name", "rows"))
    return counts


def normalized_messages(messages: DataFrame) -> DataFrame:
    """Messages with each address column beside its normalised form."""
    m = keep_regular(messages)
    lists = {f"{c}_normalized": F.transform(json_list(F.col(c)), text.normalize_text) for c in RECIPIENT_ROLES}
    m = m.withColumns({"sender_normalized": text.normalize_text(F.col("sender")), "account_email_normalized": text.normalize_text(F.col("account_email")), **lists})
    return m.select("id", "sender", "sender_normalized", *(x for c in RECIPIENT_ROLES for x in (c, f"{c}_normalized")), "account_email", "account_email_normalized")


def _unpivoted(messages: DataFrame, made: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """id, address_role, address_index, normalized_value and the columns made from it.

    One scan and one generator for all five roles. What is made is worked out inside the
    array, so the generator hands on values, not expressions to be repeated.
    """
    m = keep_regular(messages)
    none = F.lit(None).cast("bigint")

    def one(role: str) -> Column:
        return F.struct(F.lit(role).alias("address_role"), none.alias("address_index"), F.col(role).alias("value"))

    def many(role: str) -> Column:
        return F.transform(json_list(F.col(role)), lambda v, i: F.struct(F.lit(role).alias("address_role"), i.cast("bigint").alias("address_index"), v.alias("value")))

    empty = F.array().cast("array<struct<address_role:string,address_index:bigint,value:string>>")
    rows = F.concat(F.array(one("sender"), one("account_email")), *(F.coalesce(many(r), empty) for r in RECIPIENT_ROLES))
    clean = F.transform(rows, lambda r: F.struct(r["address_role"], r["address_index"], text.normalize_text(r["value"]).alias("normalized_value")))
    found = F.filter(clean, lambda r: r["normalized_value"].isNotNull())
    if made:
        found = F.transform(found, lambda r: F.struct(r["address_role"], r["address_index"], r["normalized_value"], *(f(r["normalized_value"]).alias(k) for k, f in made.items())))
    # outer, as an inner explode would be preceded by a filter that works all of it out once more
    return m.select("id", F.explode_outer(found).alias("a")).filter("a IS NOT NULL").select("id", "a.*")


def address_rows(messages: DataFrame) -> DataFrame:
    """id, address_role, address_index, normalized_value of every address that isn't empty.

    address_index counts from 0 within a recipient list and is null for sender and account_email.
    """
    return _unpivoted(messages, {})


def parsed_addresses(messages: DataFrame) -> DataFrame:
    """address_rows with display_name and email. raw_value is the normalised value, as always."""
    a = _unpivoted(messages, {"display_name": address.display_name, "email": address.email})
    return a.select("id", "address_role", "address_index", F.col("normalized_value").alias("raw_value"), "normalized_value", "display_name", "email")


def distinct_emails(parsed: DataFrame) -> DataFrame:
    return parsed.select("email").filter(F.col("email").isNotNull()).distinct().orderBy("email")


def sender_domains(parsed: DataFrame) -> DataFrame:
    senders = parsed.filter(F.col("address_role") == "sender").select(address.domain_part(F.col("email")).alias("domain"))
    return senders.filter(F.col("domain").isNotNull()).distinct().orderBy("domain")


def parse_rates(parsed: DataFrame) -> DataFrame:
    """address_role, addresses, with_email, with_name."""
    return parsed.groupBy("address_role").agg(F.count(F.lit(1)).alias("addresses"), F.count("email").alias("with_email"), F.count("display_name").alias("with_name"))
