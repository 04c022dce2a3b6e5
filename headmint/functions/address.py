"""Addresses, display names and identity keys from normalised header text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headmint.functions import patterns as P
from headmint.functions.text import collapse_space, extract, let, null_if_empty, or_empty, replace_each


def _unquote(c: Column) -> Column:
    return replace_each(c, [*P.QUOTED, *((b, "") for b in P.QUOTED_BLANKS)])


def _hash_as_at(c: Column) -> Column:
    c = F.regexp_replace(c, P.HASH_WEBMAIL, "$1$2@$3.")
    return F.regexp_replace(c, P.HASH_DOMAIN, "$1$2@$3")


def _misread(c: Column) -> Column:
    c = replace_each(c, [(h, "@gmail.") for h in P.MISREAD_HOSTS])
    for p in P.MISREAD_COM:
        c = F.regexp_replace(c, p, ".com")
    return c


def local_part(email: Column) -> Column:
    return extract(email, "^([^@]+)@")


def domain_part(email: Column) -> Column:
    return extract(email, r"@(.+)\z")


def email(c: Column) -> Column:
    """The first address in a text, cleaned: quoted remains decoded, misread hosts repaired,
    no dots in the local part (of any domain), null beyond the length limits."""

    def found(plain: Column) -> Column:  # the address pattern is only tried where it can match
        return _misread(F.when(F.contains(plain, F.lit("@")), extract(plain, P.EMAIL)))

    def parts(f: Column) -> Column:
        return F.struct(F.replace(local_part(f), F.lit("."), F.lit("")).alias("local"), domain_part(f).alias("domain"))

    def whole(p: Column) -> Column:
        n, m = F.char_length(p["local"]), F.char_length(p["domain"])
        fits = (n + m + 1 <= P.MAX_ADDRESS) & (n <= P.MAX_LOCAL) & (m <= P.MAX_DOMAIN)
        return F.when(fits, F.concat(p["local"], F.lit("@"), p["domain"]))

    return let(_hash_as_at(_unquote(F.lower(c))), lambda plain: let(found(plain), lambda f: let(parts(f), whole)))


def display_name(c: Column) -> Column:
    """What is left of a text without addresses, brackets and quotes; case is kept."""
    c = or_empty(c)
    c = let(c, lambda x: F.when(F.contains(x, F.lit("@")), F.regexp_replace(x, P.EMAIL, " ")).otherwise(x))
    c = collapse_space(F.regexp_replace(c, r"""[<>\[\]\(\)"']""", " "))
    edge = f"[,;:\\-\\t-\\r\\x{{85}}\\p{{Z}}]+"
    return null_if_empty(F.regexp_replace(c, f"^{edge}|{edge}\\z", ""))


def repair_candidate(c: Column) -> Column:
    """A suspicious text with the repairs of email() applied before any extraction."""
    return _hash_as_at(_misread(_unquote(F.lower(c))))


def canonical_domain(domain: Column) -> Column:
    d = F.lower(domain)
    return F.when(d == "googlemail.com", F.lit("gmail.com")).otherwise(d)


def canonical_local(local: Column) -> Column:
    return F.replace(local, F.lit("."), F.lit(""))


def canonical_email(c: Column) -> Column:
    """Dots out of the local part, googlemail.com as gmail.com; null without an @."""
    local, domain = F.regexp_extract(c, "^(.*)@", 1), F.substring_index(c, "@", -1)
    return F.when(F.contains(c, F.lit("@")), F.concat(canonical_local(local), F.lit("@"), canonical_domain(domain)))


def name_key(c: Column) -> Column:
    """Letters a-z of a display name, without addresses; & is read as and; empty is null."""
    c = let(F.lower(c), lambda x: F.when(F.contains(x, F.lit("@")), F.regexp_replace(x, P.EMAIL, " ")).otherwise(x))
    c = replace_each(c, [("&", "and"), ("mailto:", " ")])
    return null_if_empty(F.regexp_replace(c, "[^a-z]", ""))


def email_key(c: Column) -> Column:
    return null_if_empty(F.regexp_replace(F.lower(c), "[^a-z]", ""))


def search_key(name: Column, address: Column) -> Column:
    return F.coalesce(name_key(name), email_key(address))
