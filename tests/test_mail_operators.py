from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from headmint.operators import addresses, audit, cards, relational, repair
from headmint.sources.mail_view import messages

SCHEMA = "id bigint, sender string, to_recipients string, cc_recipients string, bcc_recipients string, account_email string, all_participants string, is_promotional boolean"


def mail(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_promotional_and_unknown_messages_go(spark):
    m = mail(spark, (1, "a@b.org", None, None, None, None, None, True), (2, "a@b.org", None, None, None, None, None, None), (3, "a@b.org", None, None, None, None, None, False))
    assert [r["id"] for r in addresses.keep_regular(m).collect()] == [3]


def test_address_rows(spark):
    m = mail(spark, (1, " A@b.org ", '["x@y.org","",null,"<u>z</u>"]', "[]", None, "", None, False), (2, None, "not json", '[1,{"k":2}]', None, None, None, False))
    rows = sorted((tuple(r) for r in addresses.address_rows(m).collect()), key=repr)
    assert rows == sorted([(1, "sender", None, "A@b.org"), (1, "to_recipients", 0, "x@y.org"), (1, "to_recipients", 3, "z"), (2, "cc_recipients", 0, "1"), (2, "cc_recipients", 1, '{"k":2}')], key=repr)
    assert {r["column_name"]: r["rows"] for r in addresses.unparsed_lists(m).collect()} == {"to_recipients": 1, "cc_recipients": 0, "bcc_recipients": 0}


def test_raw_value_is_normalised_too(spark):
    p = addresses.parsed_addresses(mail(spark, (1, "<u>A</u> &lt;a@b.org&gt;", None, None, None, None, None, False))).first()
    assert (p["raw_value"], p["normalized_value"], p["display_name"], p["email"]) == ("A <a@b.org>", "A <a@b.org>", "A", "a@b.org")


def test_view_counts(spark, small):
    m = messages(spark, small)
    assert m.count() == 1500 and addresses.keep_regular(m).count() == 1200
    nulls = m.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in ("sender", "to_recipients", "cc_recipients", "bcc_recipients", "account_email", "all_participants"))).first()
    assert tuple(nulls) == (94, 215, 300, 0, 167, 188)


def test_audit_on_no_rows_reports_nothing(spark):
    assert audit.full_report(mail(spark)).count() == 0


def test_audit_counts_and_examples(spark):
    m = mail(spark, (1, None, None, None, None, None, None, False), (2, "  ", '[""]', "[ ]", None, "Unknown", "[] []", False), (3, "X <a@b.org", '["a@@b"," y"]', None, None, "u@v.org", "A", False), (4, "a@b.org", None, None, None, None, "x ", False))
    got = {(r["column_name"], r["issue"]): r["count"] for r in audit.full_report(m).collect()}
    assert got["sender", "missing_or_blank"] == 2 and got["sender", "same_mailbox_with_multiple_sender_variants"] == 1
    assert got["sender", "unmatched_angle_brackets"] == 1 and got["sender", "whitespace_artifacts"] == 1
    assert got["to_recipients", "null_rows"] == 2 and got["to_recipients", "rows_containing_empty_string_items"] == 1 and got["to_recipients", "empty_string_items"] == 1
    assert got["to_recipients", "multiple_at_signs_or_merged_addresses"] == 1 and got["to_recipients", "recipient_items_without_email_address"] == 1
    assert got["cc_recipients", "empty_list_rows"] == 1 and got["account_email", "non_email_tokens"] == 1 and got["account_email", "distinct_non_null_values"] == 2
    assert got["all_participants", "placeholder_only_rows"] == 1 and got["all_participants", "lowercased_lossy_representation"] == 3
    long = mail(spark, *((k, "y" * (100 + k), None, None, None, None, None, False) for k in range(5)))
    ex = audit.examples(long, "sender", audit.sender_checks(F.col("sender"))).filter("issue = 'no_email_address_present'").orderBy("position").collect()
    assert [r["example"] for r in ex] == ["y" * 100, "y" * 97 + "...", "y" * 97 + "..."]


def repair_by_hand(parsed):
    """The decision of the fuzzy step in plain Python over collected rows, for seeds already cut."""
    known = {}
    for r in parsed["known"]:
        known.setdefault(r["domain"], []).append((r["compare"], r["email"], r["len"]))
    out = {}
    for r in parsed["seeds"]:
        c = r["compare"]
        if c is None:
            continue
        scored = sorted(((SequenceMatcher(None, c, k).ratio(), n, e) for k, e, n in known.get(r["domain"], []) if abs(len(k) - len(c)) <= max(2, len(c) // 3)), key=lambda x: (-x[0], -x[1], x[2]))
        if scored and scored[0][0] >= 0.82 and (scored[0][0] >= 0.995 or scored[0][0] - (scored[1][0] if len(scored) > 1 else 0) >= 0.08):
            local, domain = scored[0][2].rsplit("@", 1)
            out[r["id"], r["address_role"], r["address_index"]] = local.replace(".", "") + "@" + ("gmail.com" if domain == "googlemail.com" else domain)
        # else: not sure enough
    return out


def test_fuzzy_repair_equals_plain_python(spark, small):
    parsed = addresses.parsed_addresses(messages(spark, small)).cache()
    seeds = repair.repair_seeds(parsed)
    want = repair_by_hand({"known": repair.known_addresses(parsed).collect(), "seeds": seeds.filter("direct IS NULL").collect()})
    before = {(r["id"], r["address_role"], r["address_index"]): r["email"] for r in parsed.collect()}
    after = {(r["id"], r["address_role"], r["address_index"]): r["email"] for r in repair.fuzzy_repair(parsed).collect()}
    changed = {k: v for k, v in after.items() if v != before[k]}
    assert changed and changed == {k: v for k, v in want.items() if k[2] is not None}
    assert all(before[k] is None for k in changed)
    scalar = {(r["id"], r["address_role"], r["address_index"]): r["email"] for r in repair.fuzzy_repair(parsed, include_scalar_roles=True).collect()}
    assert any(k[1] == "sender" and scalar[k] != before[k] for k in scalar) and all(scalar[k] == want[k] for k in want)


def test_repair_seed_edges(spark):
    def seeds(value):
        rows = spark.createDataFrame([(1, "to_recipients", 0, value, value, None, None)], "id bigint, address_role string, address_index bigint, raw_value string, normalized_value string, display_name string, email string")
        return [(r["direct"], r["domain"], r["compare"]) for r in repair.repair_seeds(rows).collect()]

    assert seeds("john= acme.com") == [(None, "me.com", "johnac")]
    assert seeds("abc= gmail.com") == [(None, None, None)]
    assert seeds("gmail.com") == []
    assert seeds("hotmail.com") == [(None, None, None)]  # tmail is suspicious, nothing is left as a seed
    for before in ("", "\0", "\0 \0"):  # a character of no meaning changes no place
        assert seeds(f"{before}<joe@gmail.corn>") == [("joe@gmail.corn", None, None)]
    long = "a" * 70 + "@x.con"
    assert seeds(long) == [("a" * 70 + "@x.com", None, None)]


def test_cards_stop_at_an_empty_page(spark):
    card = '<a class="email-row" href="/person/{0}"><b class="sender-name"> N &amp; {0}</b><i class="preview">d</i><u class="email-date" title="1,234 emails"></u></a>'
    pages = spark.createDataFrame([(1, card.format("x")), (2, "none"), (3, card.format("y")), (4, None)], "page bigint, html string")
    assert [tuple(r) for r in cards.person_cards(pages, "https://example.org").collect()] == [("x", "N & x", "d", 1234, "https://example.org/person/x")]


def test_relational_rules(spark):
    a = spark.createDataFrame([(1, "x"), (1, "a"), (2, None)], "k int, v string")
    assert sorted(tuple(r) for r in relational.dedup_keep_first(a, ["k"], [F.asc_nulls_last("v")]).collect()) == [(1, "a"), (2, None)]
    lists = spark.createDataFrame([(1, []), (2, None), (3, ["p", "q"])], "k int, l array<string>")
    assert sorted((tuple(r) for r in relational.explode_outer_items(lists, "l").collect()), key=repr) == sorted([(1, None), (2, None), (3, "p"), (3, "q")], key=repr)
    wide = relational.union_relaxed(a, spark.createDataFrame([(5, 2.5)], "k bigint, w double"))
    assert wide.columns == ["k", "v", "w"] and dict(wide.dtypes)["k"] == "bigint" and wide.count() == 4
    assert a.filter(relational.any_of([])).count() == 0


@pytest.mark.parametrize("pair", [("tide", "diet"), ("diet", "tide"), ("", ""), ("abc", ""), ("user", "usre")])
def test_sequence_ratio(spark, pair):
    from headmint.functions.similarity import letter_bound, sequence_ratio, shared_letters_bound

    a, b = F.col("a"), F.col("b")
    r = spark.createDataFrame([pair], "a string, b string").select(sequence_ratio(a, b).alias("r"), letter_bound(a, b).alias("u"), shared_letters_bound(a, b).alias("v")).first()
    assert r["r"] == SequenceMatcher(None, *pair).ratio() and r["u"] >= r["v"] >= r["r"]
