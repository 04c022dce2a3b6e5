"""Person cards and links read from pages of HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headmint.functions import patterns as P
from headmint.functions.text import collapse_space, extract, replace_each

CARD = r'(?s)<a\b[^>]*class="[^"]*\bemail-row\b[^"]*"[^>]*>.*?</a>'  # fixed: the card element's class
HREF = r'href="/person/([^"]*)"'
ENTITIES = P.ENTITIES[:6]  # the named and numbered ones
LINK = r'<a\b[^>]*\bhref="([^"]*)"[^>]*>([^<]*)</a>'


def plain_text(html: Column) -> Column:
    """Text of a fragment: without tags, entities decoded once, white space collapsed and trimmed."""
    return F.trim(collapse_space(replace_each(F.regexp_replace(html, "<[^>]*>", ""), ENTITIES)))


def element(card: Column, css_class: str) -> Column:
    """Inner HTML of the first element of a class (no element of the same name inside it); null without one."""
    return extract(card, rf'(?s)<(\w+)\b[^>]*class="[^"]*\b{css_class}\b[^"]*"[^>]*>(.*?)</\1>', 2)


def person_cards(pages: DataFrame, base_url: str = "") -> DataFrame:
    """slug, name, description, email_count, url of each card in pages(page, html).

    Reading stops at the smallest page without a card: later pages don't count. A count is
    the first word of the date element's title, with thousands separators.
    """
    cards = F.filter(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(f"({CARD})"), F.lit(1)), lambda c: F.rlike(c, F.lit(HREF)))
    found = pages.select("page", cards.alias("cards"))
    end = found.filter(F.size("cards") == 0).agg(F.min("page").alias("end"))
    c = F.col("card")
    rows = found.join(F.broadcast(end), F.col("end").isNull() | (F.col("page") < F.col("end"))).select(F.explode("cards").alias("card"))
    count = F.replace(extract(c, r'class="[^"]*\bemail-date\b[^"]*"[^>]*title="([0-9,]+)'), F.lit(","), F.lit(""))
    slug = extract(c, HREF)
    return rows.select(slug.alias("slug"), plain_text(element(c, "sender-name")).alias("name"), plain_text(element(c, "preview")).alias("description"), count.cast("bigint").alias("email_count"), F.concat(F.lit(f"{base_url}/person/"), slug).alias("url"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, position, href, label of each plain link in pages(page_id, html)."""
    h = F.coalesce("html", F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(h, F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all(h, F.lit(LINK), F.lit(2)).alias("label"))
    rows = pages.select("page_id", F.posexplode(pairs).alias("position", "link"))
    return rows.select("page_id", F.col("position").cast("bigint").alias("position"), F.col("link.href").alias("href"), plain_text(F.col("link.label")).alias("label"))
