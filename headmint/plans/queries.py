"""Named queries of the engine over the driver's tables. Each takes (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headmint.functions import address, text
from headmint.functions import patterns as P
from headmint.operators import addresses, audit, cards, keys, relational, repair, report, subset
from headmint.plans import jobs
from headmint.sources.mail_view import messages
from headmint.sources.scratch import fresh_folder, stored
from headmint.sources.tables import read_csv, read_parquet, table, write_csv, write_parquet

Query = Callable[[SparkSession, str], DataFrame]

# The focus account, targets and rules of the derived view: synthetic identities.
FOCUS_EMAILS = ["hubmain@gmail.com"]
FOCUS_ALIASES = ["userhubmain", "hubmaingmailcom"]
TARGETS = [
    ("alder", 0.5, 120, ["ubxyz", "ucxyz", "udxyz"], ["ubcxyz"], ["userubxyz"], 0, 8, 5, True),
    ("birch", 1.25, 260, ["ubaxyz", "ubbxyz", "ubcxyz"], [], [], 1, 9, 6, False),
    ("cedar", 0.9, 75, ["uexyz", "ufxyz"], ["yahoo"], ["ufxyzgmailcom", "userufxyz"], 0, 6, 4, True),
    ("doum", 2.0, 400, ["ucaxyz", "ucbxyz", "uccxyz", "ucdxyz"], ["nothing"], [], 1, 10, 9, False),
]
TARGET_SCHEMA = "name string, ratio double, total_emails bigint, include array<string>, exclude array<string>, prefer array<string>, min_evidence int, cap int, width int, directional boolean"

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def joined(c: str | F.Column, sep: str = "|") -> F.Column:
    """An array as one string, nulls shown."""
    return F.array_join(c, sep, "<null>")


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.parsed_addresses(messages(spark, folder))


def kept(df: DataFrame) -> DataFrame:
    """df written once, for plans that read it several times."""
    return stored(df, f"{fresh_folder(df.sparkSession)}/table")


def regular(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.keep_regular(messages(spark, folder))


# ------------------------------------------------------------------ messages and addresses


@query
def promo_filter_null(spark: SparkSession, folder: str) -> DataFrame:
    return regular(spark, folder).agg(F.count(F.lit(1)).alias("kept"), F.count("sender").alias("with_sender"))


@query
def normalize_sender(spark: SparkSession, folder: str) -> DataFrame:
    return regular(spark, folder).select("id", text.normalize_text(F.col("sender")).alias("sender_normalized"))


@query
def normalize_recipients(spark: SparkSession, folder: str) -> DataFrame:
    m = addresses.normalized_messages(messages(spark, folder))
    return m.select("id", *(joined(f"{c}_normalized").alias(f"{c}_normalized") for c in P.RECIPIENT_ROLES))


@query
def addresses_long(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.address_rows(messages(spark, folder))


@query
def parse_email(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(spark, folder).select("id", "address_role", "address_index", "raw_value", "email")


@query
def display_name(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(spark, folder).select("id", "address_role", "address_index", "display_name")


@query
def distinct_emails(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.distinct_emails(parsed(spark, folder))


@query
def sender_domains(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.sender_domains(parsed(spark, folder))


@query
def parse_rates(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.parse_rates(parsed(spark, folder))


@query
def json_parse_failures(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.unparsed_lists(messages(spark, folder))


# ------------------------------------------------------------------ audit


@query
def audit_sender(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_sender(regular(spark, folder))


@query
def audit_to(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_recipients(regular(spark, folder), "to_recipients")


@query
def audit_cc(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_recipients(regular(spark, folder), "cc_recipients")


@query
def audit_bcc(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_recipients(regular(spark, folder), "bcc_recipients")


@query
def audit_account(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_account(regular(spark, folder))


@query
def audit_participants(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_participants(regular(spark, folder))


@query
def audit_examples(spark: SparkSession, folder: str) -> DataFrame:
    out = audit.examples(regular(spark, folder), "sender", audit.sender_checks(F.col("sender")))
    return out.withColumn("position", F.col("position").cast("bigint"))


@query
def audit_item_examples(spark: SparkSession, folder: str) -> DataFrame:
    items = audit.recipient_items(regular(spark, folder), "to_recipients")
    out = audit.examples(items, "item", audit.item_checks(F.col("item")))
    return out.withColumn("position", F.col("position").cast("bigint"))


@query
def mailbox_variants_topk(spark: SparkSession, folder: str) -> DataFrame:
    return audit.top_variants(regular(spark, folder))


@query
def account_smallest_values(spark: SparkSession, folder: str) -> DataFrame:
    return audit.smallest_values(regular(spark, folder))


@query
def audit_all_examples(spark: SparkSession, folder: str) -> DataFrame:
    return audit.all_examples(regular(spark, folder)).withColumn("position", F.col("position").cast("bigint"))


@query
def audit_report(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.audit_report(messages(spark, folder)).withColumn("examples", joined("examples"))


# ------------------------------------------------------------------ repair


@query
def known_addresses(spark: SparkSession, folder: str) -> DataFrame:
    return repair.known_addresses(parsed(spark, folder))


@query
def suspicious_addresses(spark: SparkSession, folder: str) -> DataFrame:
    return repair.suspicious_addresses(parsed(spark, folder)).select("id", "address_role", "address_index", "normalized_value")


@query
def repair_seed(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_seeds(parsed(spark, folder)).select("id", "address_role", "address_index", "candidate", "direct", "domain", F.col("compare").alias("seed"))


@query
def fuzzy_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(spark, folder).select("id", "address_role", "address_index", "normalized_value", "email")


@query
def repair_margin(spark: SparkSession, folder: str) -> DataFrame:
    """Names of parts, damaged in four ways, against the whole ones: near ties are refused."""
    known = table(spark, folder, "part").groupBy(F.regexp_replace("p_name", "[^a-z]", "").alias("compare")).agg(F.count(F.lit(1)).alias("len"))
    known = known.select(F.concat("compare", F.lit("@gmail.com")).alias("email"), F.lit("gmail.com").alias("domain"), "compare", "len")
    damaged = ("substr(compare, 1, 1) || substr(compare, 3)", "substr(compare, 1, length(compare) - 1)", "substr(compare, 4)", "reverse(compare)")
    return repair.best_known(known.select("domain", F.explode(F.array(*map(F.expr, damaged))).alias("compare")), known)


def repaired(spark: SparkSession, folder: str) -> DataFrame:
    return repair.fuzzy_repair(kept(parsed(spark, folder)))


@query
def repaired_emails(spark: SparkSession, folder: str) -> DataFrame:
    """The list of addresses as the address job writes it: after repair."""
    return addresses.distinct_emails(repaired(spark, folder))


@query
def repaired_sender_domains(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.sender_domains(repaired(spark, folder))


# ------------------------------------------------------------------ keys and matching


def keyed(spark: SparkSession, folder: str) -> DataFrame:
    return keys.with_keys(parsed(spark, folder))


@query
def search_keys(spark: SparkSession, folder: str) -> DataFrame:
    return keyed(spark, folder).select("id", "address_role", "address_index", "search_key")


@query
def focus_ids(spark: SparkSession, folder: str) -> DataFrame:
    return keys.focus_ids(keyed(spark, folder), FOCUS_EMAILS, FOCUS_ALIASES)


def _exchange(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    k = kept(keyed(spark, folder).select("id", "address_role", "email", "search_key"))
    return k, keys.exchanged(k, keys.focus_ids(k, FOCUS_EMAILS, FOCUS_ALIASES))


@query
def key_stats(spark: SparkSession, folder: str) -> DataFrame:
    return keys.key_stats(*_exchange(spark, folder))


def _targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TARGETS, TARGET_SCHEMA)


@query
def target_rules(spark: SparkSession, folder: str) -> DataFrame:
    t = _targets(spark)
    both = keys.targets_with_rules(t.select("name", "ratio", "total_emails"), t.drop("ratio", "total_emails"))
    return both.withColumns({c: joined(c) for c in ("include", "exclude", "prefer")})


def _candidates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, pairs = _exchange(spark, folder)
    pairs = kept(pairs)
    return _targets(spark), kept(keys.candidates(keys.key_stats(k, pairs), _targets(spark))), pairs


@query
def candidates_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder)[1]


@query
def alias_subset_best(spark: SparkSession, folder: str) -> DataFrame:
    return subset.best_subset(*_candidates(spark, folder), method="join")


@query
def alias_subset_kernel(spark: SparkSession, folder: str) -> DataFrame:
    return subset.best_subset(*_candidates(spark, folder), method="kernel")


def _both(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets, candidates, and the best masks after the directional pass."""
    targets, cands, pairs = _candidates(spark, folder)
    base = kept(subset.best_subset(targets, cands, pairs, method="kernel"))
    own = kept(subset.directional_best(targets, cands, pairs, base))
    rest = base.join(targets.filter("NOT directional").select("name"), "name")
    zero = F.lit(0).cast("bigint")
    return targets, cands, own.unionByName(rest.withColumns({"sender_extras": zero, "recipient_extras": zero}))


@query
def alias_directional_best(spark: SparkSession, folder: str) -> DataFrame:
    targets, cands, pairs = _candidates(spark, folder)
    return subset.directional_best(targets, cands, pairs, subset.best_subset(targets, cands, pairs, method="kernel"))


@query
def match_report(spark: SparkSession, folder: str) -> DataFrame:
    targets, cands, best = _both(spark, folder)
    return report.match_report(targets, best, cands)


@query
def match_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return report.match_metrics(match_report(spark, folder))


# ------------------------------------------------------------------ pages, real texts, files


@query
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return cards.page_links(table(spark, folder, "pages"))


@query
def person_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Cards rendered from the nation table, ten a page, with a gap after page 1; read back."""
    n = table(spark, folder, "nation")
    card = F.format_string('<a class="email-row x" href="/person/%s"><span class="sender-name"> %s &amp; co </span><p class="preview">of <b>region</b> %d</p><time class="email-date" title="%s emails">t</time></a>', F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), "n_name", "n_regionkey", F.format_number(F.col("n_nationkey") * 1234 + 7, 0))
    page = F.when(F.col("n_nationkey") < 20, F.floor(F.col("n_nationkey") / 10)).otherwise(F.lit(3))
    pages = n.select(page.cast("bigint").alias("page"), card.alias("card")).groupBy("page").agg(F.concat(F.lit("<html>"), F.array_join(F.array_sort(F.collect_list("card")), "\n")).alias("html"))
    empty = spark.createDataFrame([(2, "<html>no cards</html>")], "page bigint, html string")
    return cards.person_cards(pages.unionByName(empty))


@query
def doc_email_mentions(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", F.when(F.contains("text", F.lit("@")), F.regexp_extract_all("text", F.lit(P.EMAIL), F.lit(1))).alias("found"))
    return d.select("doc_id", F.explode("found").alias("mention")).select("doc_id", address.email(F.col("mention")).alias("email")).groupBy("doc_id", "email").agg(F.count(F.lit(1)).alias("mentions"))


@query
def doc_entity_decode(spark: SparkSession, folder: str) -> DataFrame:
    title = text.extract(F.col("html"), "<title>([^<]*)</title>")
    return table(spark, folder, "pages").select("page_id", text.normalize_text(title).alias("title"))


@query
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    path = f"{fresh_folder(spark)}/nation"
    write_csv(n, path, order_by=["n_nationkey"])
    return read_csv(spark, path, n.schema)


@query
def parquet_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{fresh_folder(spark)}/region"
    write_parquet(table(spark, folder, "region"), path)
    return read_parquet(spark, path, ["r_regionkey", "r_name"])


@query
def parquet_columns(spark: SparkSession, folder: str) -> DataFrame:
    """A scan of two columns with a filter that reaches the files."""
    li = read_parquet(spark, f"{folder}/lineitem.parquet", ["l_orderkey", "l_quantity"])
    return li.filter("l_quantity >= 45").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("l_orderkey").alias("orders"))


# ------------------------------------------------------------------ single operators


@query
def left_join_null_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A null key matches nothing, on either side."""
    o = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("k"))
    c = table(spark, folder, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("k"), "c_mktsegment")
    return o.join(c, "k", "left").select("o_orderkey", "k", "c_mktsegment")


@query
def dedup_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return relational.dedup_keep_first(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query
def union_by_name_relaxed(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").cast("int").alias("key"), F.col("s_name").alias("name"))
    return relational.union_relaxed(c, s)


@query
def explode_empty_lists(spark: SparkSession, folder: str) -> DataFrame:
    m = messages(spark, folder).select("id", addresses.json_list(F.col("to_recipients")).alias("items"))
    return relational.explode_outer_items(m, "items")


@query
def explode_with_index(spark: SparkSession, folder: str) -> DataFrame:
    m = messages(spark, folder).select("id", addresses.json_list(F.col("cc_recipients")).alias("items"))
    return m.select("id", F.size("items").cast("bigint").alias("n"), F.posexplode("items").alias("position", "item")).withColumn("position", F.col("position").cast("bigint"))


@query
def semi_join_ids(spark: SparkSession, folder: str) -> DataFrame:
    big = table(spark, folder, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.semi_join_ids(table(spark, folder, "customer"), big, "c_custkey").select("c_custkey", "c_mktsegment")


@query
def any_horizontal_tokens(spark: SparkSession, folder: str) -> DataFrame:
    hit = relational.any_of([F.contains("p_name", F.lit(t)) for t in ("1", "22", "3")])
    none = relational.any_of([])
    return table(spark, folder, "part").select("p_partkey", hit.alias("hit"), none.alias("none"))


@query
def conditional_counts(spark: SparkSession, folder: str) -> DataFrame:
    value = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    checks = {"no_value": value.isNull(), "large": value > 50, "click_or_large": (F.col("event_type") == "click") | (value > 50), "not_click": ~(F.col("event_type") == "click")}
    return relational.conditional_counts(table(spark, folder, "events"), checks)


@query
def kleene_logic(spark: SparkSession, folder: str) -> DataFrame:
    """AND, OR and NOT over a nullable flag; a filter keeps what is true."""
    m = messages(spark, folder).select("id", F.col("is_promotional").alias("p"), (F.col("id") % 2 == 0).alias("q"))
    logic = {"both": F.col("p") & F.col("q"), "either": F.col("p") | F.col("q"), "not_p": ~F.col("p"), "ne_true": F.col("p") != F.lit(True)}
    return m.select("id", *(v.cast("bigint").alias(k) for k, v in logic.items()))


@query
def group_having_distinct(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("len"), F.count_distinct("l_partkey").alias("parts")).filter("len > parts")


@query
def global_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return c.agg(F.round(F.sum("c_acctbal"), 2).alias("total"), F.round(F.sum(F.abs("c_acctbal")), 2).alias("total_abs"), F.max("c_acctbal").alias("largest"), F.count_distinct("c_mktsegment").alias("segments"), F.count(F.lit(1)).alias("height"))


@query
def top_per_group(spark: SparkSession, folder: str) -> DataFrame:
    """Preferred values first in list order, then by price; a cap a group."""
    prefer = F.array_position(F.array(F.lit("1-URGENT"), F.lit("5-LOW")), F.col("o_orderpriority"))
    o = table(spark, folder, "orders").withColumn("prefer", F.when(prefer > 0, prefer))
    out = relational.top_per_group(o, ["o_orderstatus"], [F.asc_nulls_last("prefer"), F.desc("o_totalprice"), "o_orderkey"], 12)
    return out.select("o_orderstatus", F.col("place").cast("bigint").alias("place"), "o_orderkey", "o_orderpriority")


@query
def sorted_head(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)


@query
def argmin_argmax(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"), F.max_by("o_orderkey", F.struct("o_totalprice", F.col("o_orderkey"))).alias("dearest"))


@query
def string_functions(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, folder, "part").select(
        "p_partkey",
        F.lower(n).alias("low"),
        F.char_length(n).cast("bigint").alias("chars"),
        F.regexp_count(n, F.lit("[aeiou]")).cast("bigint").alias("vowels"),
        text.extract(n, "([0-9]+)").alias("digits"),
        F.regexp_replace(n, "([a-z])([0-9])", "$1_$2").alias("marked"),
        text.truncate(F.repeat(n, 20)).alias("short"),
        F.nullif(F.trim(F.regexp_replace(n, "[a-z0-9]", " ")), F.lit("")).alias("blank"),
        F.substring_index(n, " ", 1).alias("first_word"),
    )


@query
def number_functions(spark: SparkSession, folder: str) -> DataFrame:
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    return table(spark, folder, "customer").select("c_custkey", F.abs(b).alias("size"), F.round(F.ln(F.abs(b) + 1e-9 + 1), 6).alias("log"), F.greatest(F.lit(2).cast("bigint"), F.expr("c_custkey div 3")).alias("band"), F.least(k, F.lit(9).cast("bigint")).alias("capped"), (k - F.lit(100)).alias("delta"), F.round(b / F.nullif(k % 4, F.lit(0)), 6).alias("quotient"))


@query
def fill_null_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers are filled; strings stay null."""
    o = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderpriority").alias("priority"))
    c = table(spark, folder, "customer").select("c_custkey")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "orders", "priority").fillna(0)


@query
def cross_product(spark: SparkSession, folder: str) -> DataFrame:
    """Two tables of fixed size, all combinations but the empty one."""
    r = table(spark, folder, "region").select(F.col("r_regionkey").cast("bigint").alias("a"))
    return r.crossJoin(F.broadcast(r.select(F.col("a").alias("b")))).filter("a <> 0 OR b <> 0")


@query
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")))).alias("r"), F.array_sort(F.collect_set(F.col("l_linenumber"))).alias("all_lines"))
    return li.select("l_orderkey", F.size(F.array_union("r", "all_lines")).cast("bigint").alias("either"), F.size(F.array_intersect("r", "all_lines")).cast("bigint").alias("both"), F.array_join(F.array_except("all_lines", "r"), ",").alias("rest"))


@query
def json_lists(spark: SparkSession, folder: str) -> DataFrame:
    """JSON object fields and array items; what isn't valid is null."""
    e = table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return e.select("event_id", F.try_to_number("k", F.lit("999999")).cast("bigint").alias("k"))
