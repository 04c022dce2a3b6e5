"""A message table derived from orders, in expressions that Spark and DuckDB share (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headmint.sources.tables import spread, table


def _label(number: str) -> str:
    return f"CASE WHEN ({number}) = -1 THEN 'hubmain' ELSE 'u' || translate(CAST(({number}) AS VARCHAR(9)), '0123456789', 'abcdefghij') || 'xyz' END"


#: Sender S and recipients R1, R2 of order k of customer c.
PEOPLE = {
    "S": _label("CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey % 40 END"),
    "R1": _label("CASE WHEN o_orderkey % 3 = 1 THEN -1 ELSE (o_custkey * 7 + o_orderkey) % 40 END"),
    "R2": _label("(o_custkey * 11 + o_orderkey) % 40"),
}

COLUMNS = {
    "id": "o_orderkey",
    "sender": """CASE o_orderkey % 16 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'Redacted' WHEN 3 THEN 'User ' || S
        WHEN 4 THEN 'User ' || S || ' <' || S || '@grnail.com>' WHEN 5 THEN S || '@yahoo.con'
        WHEN 6 THEN 'User ' || S || ' &lt;' || S || '@gmail.com&gt;' WHEN 7 THEN '<u>' || S || '@gmail.com</u>'
        WHEN 8 THEN substr(S, 1, 1) || '.' || substr(S, 2) || '@gmail.com' WHEN 9 THEN S || '=40gmail.com'
        WHEN 10 THEN '<' || S || '#gmail.com>' WHEN 11 THEN 'User' || chr(160) || ' ' || S || '  <' || S || '@gmail.com>'
        WHEN 12 THEN S || '= gmail.com' ELSE 'User ' || S || ' <' || S || '@gmail.com>' END""",
    "to_recipients": """CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN '[""]'
        WHEN 3 THEN '["' || R1 || '= gmail.com","User ' || R2 || '"]'
        WHEN 4 THEN '["User ' || R1 || ' <' || R1 || '@gmail.com>","' || R2 || '@yahoo.com"]' ELSE '["' || R1 || '@gmail.com"]' END""",
    "cc_recipients": """CASE o_orderkey % 5 WHEN 0 THEN '["' || R2 || '@gmail.com","<u>User ' || R1 || '</u>"]' WHEN 1 THEN NULL ELSE '[]' END""",
    "bcc_recipients": """CASE WHEN o_orderkey % 11 = 0 THEN '["hubmain@gmail.com"]' ELSE '[]' END""",
    "account_email": """CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Unknown' ELSE 'hubmain@gmail.com' END""",
    "all_participants": """CASE o_orderkey % 8 WHEN 0 THEN '[]' WHEN 1 THEN ' [] []' WHEN 2 THEN NULL WHEN 3 THEN 'User ' || S
        ELSE lower(S || '@gmail.com ' || R1 || '@gmail.com') END""",
    "is_promotional": """CASE o_orderkey % 10 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END""",
}

SQL = f"SELECT {', '.join(f'{e} AS {c}' for c, e in COLUMNS.items())} FROM (SELECT o_orderkey, {', '.join(f'{e} AS {c}' for c, e in PEOPLE.items())} FROM orders)"


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """The derived message table; only two columns of orders are read."""
    people = spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey")).selectExpr("o_orderkey", *(f"{e} AS {c}" for c, e in PEOPLE.items()))
    return people.selectExpr(*(f"{e} AS {c}" for c, e in COLUMNS.items()))
