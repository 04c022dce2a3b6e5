"""Fuzzy repair of damaged addresses against known ones of the same domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headmint.functions import address
from headmint.functions import patterns as P
from headmint.functions.similarity import letter_bound, sequence_ratio, shared_letters_bound
from headmint.functions.text import extract, staged

ACCEPT, CERTAIN, MARGIN = 0.82, 0.995, 0.08  # fixed thresholds of the decision
MIN_SEED = 4


def _compare_form(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z0-9]", "")


def known_addresses(parsed: DataFrame, least: int = 2) -> DataFrame:
    """email, domain (canonical), compare (letters and digits of the local part), len: seen `least` times or more."""
    e = F.col("email")
    counts = parsed.filter(e.isNotNull()).groupBy("email").agg(F.count(F.lit(1)).alias("len")).filter(F.col("len") >= least)
    local, domain = address.local_part(e), address.domain_part(e)
    return counts.select("email", address.canonical_domain(domain).alias("domain"), _compare_form(address.canonical_local(local)).alias("compare"), "len")


def suspicious_addresses(parsed: DataFrame) -> DataFrame:
    """Rows without an address whose text looks like a damaged one."""
    return parsed.filter(F.col("email").isNull() & F.rlike(F.lower("normalized_value"), F.lit(P.SUSPICIOUS)))


def repair_seeds(parsed: DataFrame) -> DataFrame:
    """Suspicious rows with what repair needs: candidate, direct (an address that stands by
    itself in it, canonical), domain and compare (of the seed before a webmail domain)."""
    c, found, spot = F.col("candidate"), F.col("found"), F.col("spot")
    s = staged(suspicious_addresses(parsed), {"candidate": address.repair_candidate(F.col("normalized_value"))})
    s = staged(s, {"found": F.when(F.contains(c, F.lit("@")), extract(c, P.EMAIL)), "host": extract(c, P.WEBMAIL_DOMAIN)})
    s = staged(s, {"spot": F.instr(c, found)})  # the leftmost match begins where its text is first found
    left, right = F.substring(c, spot - 1, F.lit(1)), F.substring(c, spot + F.char_length(found), F.lit(1))
    apart = ((spot == 1) | F.contains(F.lit(P.LEFT_OF_ADDRESS), left)) & ((right == "") | F.contains(F.lit(P.RIGHT_OF_ADDRESS), right))
    seed = F.regexp_replace(F.expr("substring_index(candidate, host, 1)"), "^[^a-z0-9]+", "")
    seed = F.regexp_replace(F.regexp_replace(seed, r"[^a-z0-9._%+\-/=]+", ""), r"[.@]+\z", "")
    s = staged(s, {"direct": F.when(found.isNotNull() & apart, address.canonical_email(found)), "seed": seed})
    usable = F.col("direct").isNull() & (F.char_length("seed") >= MIN_SEED)
    s = staged(s, {"form": F.when(usable, _compare_form(address.canonical_local(F.col("seed"))))})
    compare = F.when(F.char_length("form") >= MIN_SEED, F.col("form"))
    domain = F.when(F.char_length("form") >= MIN_SEED, address.canonical_domain(F.col("host")))
    return s.select("id", "address_role", "address_index", "candidate", "direct", domain.alias("domain"), compare.alias("compare"))


def best_known(seeds: DataFrame, known: DataFrame) -> DataFrame:
    """domain, compare, repaired: for each distinct seed the known address that it is taken for.

    Seeds are distinct before they meet candidates, and meet only those of the same domain
    and of a length within the band: the join is on (domain, length), so one webmail host
    spreads over many tasks. Of the rest, pairs whose lengths, or whose counts of each letter,
    rule out any influence on the decision are dropped before the similarity is computed.
    """
    band = F.greatest(F.lit(2), F.floor(F.char_length("compare") / 3))
    n = F.char_length("compare")
    s = seeds.filter(F.col("compare").isNotNull()).select("domain", "compare").distinct()
    s = s.withColumn("length", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), n - band), n + band)))
    k = known.select("domain", F.col("compare").alias("known_form"), F.char_length("compare").cast("bigint").alias("length"), F.col("email").alias("known_email"), "len")
    pairs = s.join(k, ["domain", "length"]).filter(letter_bound(F.col("compare"), F.col("known_form")) >= ACCEPT - MARGIN)
    forms = pairs.select("compare", "known_form").distinct()
    forms = forms.filter(shared_letters_bound(F.col("compare"), F.col("known_form")) >= ACCEPT - MARGIN)
    forms = forms.withColumn("score", sequence_ratio(F.col("compare"), F.col("known_form")))
    scored = pairs.join(forms, ["compare", "known_form"])
    order = Window.partitionBy("domain", "compare").orderBy(F.desc("score"), F.desc("len"), "known_email")
    top = scored.withColumns({"place": F.row_number().over(order), "second": F.coalesce(F.lead("score").over(order), F.lit(0.0))}).filter("place = 1")
    sure = (F.col("score") >= ACCEPT) & ((F.col("score") >= CERTAIN) | (F.col("score") - F.col("second") >= MARGIN))
    return top.filter(sure).select("domain", "compare", address.canonical_email(F.col("known_email")).alias("repaired"))


def repairs(parsed: DataFrame) -> DataFrame:
    """id, address_role, address_index, email_repaired: one for each place, the smallest of several."""
    seeds = repair_seeds(parsed)
    direct = seeds.filter(F.col("direct").isNotNull()).select("id", "address_role", "address_index", F.col("direct").alias("email_repaired"))
    found = seeds.join(best_known(seeds, known_addresses(parsed)), ["domain", "compare"]).select("id", "address_role", "address_index", F.col("repaired").alias("email_repaired"))
    return direct.unionByName(found).groupBy("id", "address_role", "address_index").agg(F.min("email_repaired").alias("email_repaired"))


def fuzzy_repair(parsed: DataFrame, include_scalar_roles: bool = False) -> DataFrame:
    """parsed with repaired emails. An address that was read is never changed.

    By default only recipient lists are repaired: sender and account_email have a null
    address_index, and a null never equals another in a join. include_scalar_roles=True
    compares nulls as equal and repairs those too.
    """
    found = repairs(parsed).select(F.col("id").alias("r_id"), F.col("address_role").alias("r_role"), F.col("address_index").alias("r_index"), "email_repaired")
    index = F.col("address_index").eqNullSafe(F.col("r_index")) if include_scalar_roles else F.col("address_index") == F.col("r_index")
    met = parsed.join(found, (F.col("id") == F.col("r_id")) & (F.col("address_role") == F.col("r_role")) & index, "left")
    return met.withColumn("email", F.coalesce("email_repaired", "email")).select(*parsed.columns)
