from headmint.plans import jobs, queries
from headmint.sources.mail_view import messages
from headmint.sources.tables import TARGETS, read_csv, write_csv


def test_address_job(spark, small, tmp_path):
    out = jobs.build_addresses(messages(spark, small), f"file://{tmp_path}")
    assert out["messages_normalized"].count() == 1200
    want = queries.QUERIES["fuzzy_repair"](spark, small)
    assert sorted(map(tuple, out["addresses"].select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    lines = [x for p in sorted((tmp_path / "all_emails").glob("part-*")) for x in p.read_text().splitlines()]
    emails = {r["email"] for r in out["addresses"].collect() if r["email"]}
    assert lines[0] == "email" and lines[1:] == sorted(emails) and len(list((tmp_path / "all_emails").glob("part-*"))) == 1
    assert (next((tmp_path / "sender_domains").glob("part-*"))).read_text().splitlines() == ["domain", "gmail.com", "yahoo.com"]


def test_audit_job(spark, small):
    rows = jobs.audit_report(messages(spark, small))
    got = {(r["column_name"], r["issue"]): (r["count"], r["examples"]) for r in rows.collect()}
    assert got["account_email", "distinct_non_null_values"] == (3, ["", "Unknown", "hubmain@gmail.com"])
    assert got["to_recipients", "null_rows"][1] == [] and len(got["sender", "redacted_or_masked"][1]) == 3
    assert len(list(jobs.report_lines(rows))) == len(got)


def test_audit_job_scans(spark, small):
    """Counts, examples, variants and account values: a scan each, and one exchange of variants used twice."""
    out = jobs.audit_report(messages(spark, small))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") - plan.count("ReusedExchange") <= 4 and "Python" not in plan


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from headmint.sources.scratch import fresh_folder

    context = SimpleNamespace(master="spark://there:7077", getConf=lambda: {})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        fresh_folder(SimpleNamespace(sparkContext=context))


def test_matching_job(spark, small, tmp_path):
    t = spark.createDataFrame(queries.TARGETS, queries.TARGET_SCHEMA)
    write_csv(t.select("name", "ratio", "total_emails"), f"file://{tmp_path}/targets", ["name"])
    goals = read_csv(spark, f"file://{tmp_path}/targets", TARGETS)
    rules = t.drop("ratio", "total_emails")
    report, metrics = jobs.match_correspondents(queries.parsed(spark, small), goals, rules, queries.FOCUS_EMAILS, queries.FOCUS_ALIASES, f"file://{tmp_path}")
    assert [tuple(r) for r in report.collect()] == [tuple(r) for r in queries.QUERIES["match_report"](spark, small).collect()]
    lines = list(jobs.report_lines(metrics))
    assert lines[-1] == "METRIC matched_rows=4.0" and len(lines) == 5
    text = next((tmp_path / "matched").glob("part-*")).read_text().splitlines()
    assert text[0].startswith("name,target_ratio,matched_ratio") and len(text) == 5 and text[1].startswith("doum,")
