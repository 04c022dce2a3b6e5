"""The engine's three jobs end to end: address tables, audit report, correspondent matching."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headmint.operators import addresses, audit, keys, repair, report, subset
from headmint.sources.scratch import fresh_folder, stored
from headmint.sources.tables import write_csv, write_parquet


def build_addresses(messages: DataFrame, folder: str, include_scalar_roles: bool = False) -> dict[str, DataFrame]:
    """Write messages_normalized and addresses (Parquet), all_emails and sender_domains (CSV) to folder.

    Addresses are parsed once, repaired, and written before the two lists are read off them.
    """
    spark = messages.sparkSession
    scratch = fresh_folder(spark)
    normalized = addresses.normalized_messages(messages)
    write_parquet(normalized, f"{folder}/messages_normalized")
    parsed = stored(addresses.parsed_addresses(messages), f"{scratch}/parsed")
    write_parquet(repair.fuzzy_repair(parsed, include_scalar_roles), f"{folder}/addresses")
    done = spark.read.parquet(f"{folder}/addresses")
    write_csv(addresses.distinct_emails(done), f"{folder}/all_emails", ["email"])
    write_csv(addresses.sender_domains(done), f"{folder}/sender_domains", ["domain"])
    return {"messages_normalized": spark.read.parquet(f"{folder}/messages_normalized"), "addresses": done}


def audit_report(messages: DataFrame) -> DataFrame:
    """column_name, issue, count, examples of every audited column of the regular messages.

    Four scans: all counts, all examples, mailbox variants (counted and shown), account values.
    """
    m = addresses.keep_regular(messages)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("position", "example"))), lambda x: x["example"])  # a few of each issue
    few = audit.all_examples(m).groupBy("column_name", "issue").agg(in_order.alias("examples"))
    one = lambda df, column, issue, value: df.agg(F.array_sort(F.collect_list(value)).alias("examples")).select(F.lit(column).alias("column_name"), F.lit(issue).alias("issue"), "examples")
    few = few.unionByName(one(audit.top_variants(m), "sender", audit.VARIANTS, "mailbox")).unionByName(one(audit.smallest_values(m), "account_email", audit.VALUES, "account_email"))
    out = audit.full_report(m).join(few, ["column_name", "issue"], "left")
    return out.select("column_name", "issue", "count", F.coalesce("examples", F.array().cast("array<string>")).alias("examples")).orderBy("column_name", F.desc("count"), "issue")


def report_lines(rows: DataFrame) -> Iterable[str]:
    """Lines of text of an audit report or of metrics; both are short."""
    for r in rows.toLocalIterator():
        if "metric" in rows.columns:
            yield f"METRIC {r['metric']}={r['value']}"
        else:
            yield f"{r['column_name']}.{r['issue']}: {r['count']}" + "".join(f"\n    {x}" for x in r["examples"])


def match_correspondents(parsed: DataFrame, targets: DataFrame, rules: DataFrame, focus_emails: list[str], focus_aliases: list[str], folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(report, metrics) of all targets; the report is also written as CSV if a folder is given.

    targets: name, ratio, total_emails. rules: name, include, exclude, prefer, min_evidence,
    cap, width, directional; a target without rules is an error.
    """
    scratch = fresh_folder(parsed.sparkSession)
    goals = stored(keys.targets_with_rules(targets, rules), f"{scratch}/targets")
    k = stored(keys.with_keys(parsed).select("id", "address_role", "email", "search_key"), f"{scratch}/keyed")
    pairs = stored(keys.exchanged(k, keys.focus_ids(k, focus_emails, focus_aliases)), f"{scratch}/pairs")
    cands = stored(keys.candidates(keys.key_stats(k, pairs), goals), f"{scratch}/candidates")
    base = stored(subset.best_subset(goals, cands, pairs), f"{scratch}/base")
    own = subset.directional_best(goals, cands, pairs, base)
    zero = F.lit(0).cast("bigint")
    rest = base.join(goals.filter("NOT directional").select("name"), "name").withColumns({"sender_extras": zero, "recipient_extras": zero})
    best = stored(own.unionByName(rest), f"{scratch}/best")
    out = stored(report.match_report(goals, best, cands), f"{scratch}/report")
    if folder is not None:
        ordered = out.withColumn("_rank", -F.col("target_total"))
        ordered.repartition(1).sortWithinPartitions("_rank", "name").drop("_rank").write.mode("overwrite").option("header", True).csv(f"{folder}/matched")
    return out.orderBy(F.desc("target_total"), "name"), report.match_metrics(out)
