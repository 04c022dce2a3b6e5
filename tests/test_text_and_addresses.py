import pytest
from pyspark.sql import functions as F

from headmint.functions import address, text


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("&amp;lt;", "&lt;"),
        ("   ", None),
        ("<u></u>", None),
        (None, None),
        ("", None),
        ("a ​b\r\n\tc", "a b c"),
        ("‘a’ “b” ‹c› 【d】 ＜e＞", "'a' \"b\" <c> [d] <e>"),
        ("<change>x</change> <b>y</b>", "x <b>y</b>"),
        ("  a    b ", "a b"),
        ("&nbsp;x&quot;&#39;&gt;", "x\"'>"),
    ],
)
def test_normalize(spark, value, expected):
    assert one(spark, text.normalize_text, value) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("A.B@Other.org", "ab@other.org"),
        ("x@googlemail.com", "x@googlemail.com"),
        ("a" * 65 + "@x.org", None),
        ("a" * 64 + "@x.org", "a" * 64 + "@x.org"),
        ("Name <joe=40gmail=2ecom>", "joe@gmail.com"),
        ("<joe#gmail.com>", "joe@gmail.com"),
        ("joe§example.org", "joe@example.org"),
        ("joe#example.zz", None),
        ("joe@grnail.com", "joe@gmail.com"),
        ("joe@x.corn", "joe@x.com"),
        ("joe@x.con", "joe@x.com"),
        ("joe@x.con and more", "joe@x.com"),
        ("gmail.com", None),
        (None, None),
        ("a@b", None),
    ],
)
def test_email(spark, value, expected):
    assert one(spark, address.email, value) == expected


@pytest.mark.parametrize(("value", "expected"), [("Joe Doe <joe@x.org>", "Joe Doe"), ("joe@x.org", None), (" , [Joe] (x); -", "Joe x"), (None, None), ("'Joe'", "Joe")])
def test_display_name(spark, value, expected):
    assert one(spark, address.display_name, value) == expected


@pytest.mark.parametrize(("value", "expected"), [("x.y@googlemail.com", "xy@gmail.com"), ("x.y@A.org", "xy@a.org"), ("none", None), (None, None), ("a@b@c.org", "a@b@c.org")])
def test_canonical(spark, value, expected):
    assert one(spark, address.canonical_email, value) == expected


@pytest.mark.parametrize(("value", "expected"), [("R&D Team 42", "randdteam"), ("42", None), ("mailto:joe joe@x.org", "joe"), (None, None), ("Éa", "a")])
def test_name_key(spark, value, expected):
    assert one(spark, address.name_key, value) == expected


@pytest.mark.parametrize(("n", "expected"), [(100, "x" * 100), (101, "x" * 97 + "..."), (0, "")])
def test_truncate(spark, n, expected):
    assert one(spark, text.truncate, "x" * n) == expected


def test_repair_candidate_rewrites_before_extraction(spark):
    assert one(spark, address.repair_candidate, "Joe#Gmail.com x.CON") == "joe@gmail.com x.com"
    assert one(spark, address.email_key, "Joe.1@X.org") == "joexorg"


# ------------------------------------------------------------------ fixed values, spelled out once more

HOSTS = "gmail googlemail yahoo hotmail outlook icloud me mac msn live gmx aol protonmail ymail rocketmail".split()
ENDS = "com net org edu gov mil int co io ai me tv us uk ru fr de ch it nl se no es br ca mx".split()


def several(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v string").select("k", f(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows)]


def test_every_webmail_host_and_ending_counts(spark):
    """A hash sign before a webmail host, or before a domain of a known ending, is an at sign; before others it isn't."""
    assert several(spark, address.email, [f"joe#{h}.com" for h in HOSTS]) == [f"joe@{h}.com" for h in HOSTS]
    assert several(spark, address.email, [f"joe§x-y.{e}" for e in ENDS]) == [f"joe@x-y.{e}" for e in ENDS]
    assert several(spark, address.email, ["joe#x-y.xyz", "joe#x-y.info", "joe§fastmail.pl"]) == [None] * 3


def test_every_webmail_domain_gives_a_seed(spark):
    from headmint.operators.repair import repair_seeds

    values = [f"longname = {h}.com" for h in HOSTS] + ["longname = fastmail.com"]
    rows = spark.createDataFrame([(k, "to_recipients", 0, v, v, None, None) for k, v in enumerate(values)], "id bigint, address_role string, address_index bigint, raw_value string, normalized_value string, display_name string, email string")
    got = {r["id"]: r["domain"] for r in repair_seeds(rows).collect()}
    assert [got[k] for k in range(len(HOSTS))] == ["gmail.com" if h in ("gmail", "googlemail") else f"{h}.com" for h in HOSTS] and got[len(HOSTS)] is None


def test_what_is_suspicious(spark):
    from headmint.operators.repair import suspicious_addresses

    yes = ["a§b", "a#b", "a=b", "joe grnail", "joe gmall", "joe smail", "TMAIL", "popcorn", "record", "x.con", "x.con y"]
    no = ["a b", "x.cone", "joe gmail", "x con", "c.o.n"]
    rows = spark.createDataFrame([(v, None) for v in yes + no], "normalized_value string, email string")
    assert {r["normalized_value"] for r in suspicious_addresses(rows).collect()} == set(yes)
