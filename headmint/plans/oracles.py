"""DuckDB SQL for the named queries, composed from the same fixed values."""

from __future__ import annotations

from functools import reduce

from headmint.functions import patterns as P
from headmint.operators.audit import VALUES, VARIANTS
from headmint.operators.cards import ENTITIES, LINK
from headmint.operators.repair import ACCEPT, CERTAIN, MARGIN
from headmint.operators.subset import EPSILON, PLACES
from headmint.plans.queries import FOCUS_ALIASES, FOCUS_EMAILS, TARGETS
from headmint.sources.mail_view import SQL as MAIL


def s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rewrite(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {s(pattern)}, {s(to)}, 'g')"


def literal(x: str, pairs) -> str:
    return reduce(lambda a, p: f"replace({a}, {s(p[0])}, {s(p[1])})", pairs, x)


def extract(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {s(pattern)}, {group}), '')"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {s(pattern)})"


def normalize(x: str) -> str:
    return f"nullif(trim({rewrite(rewrite(literal(x, P.ENTITIES), P.MARKUP, ''), P.SPACE + '+', ' ')}), '')"


def unquote(x: str) -> str:
    return literal(x, [*P.QUOTED, *((b, "") for b in P.QUOTED_BLANKS)])


def hash_as_at(x: str) -> str:
    return rewrite(rewrite(x, P.HASH_WEBMAIL, r"\1\2@\3."), P.HASH_DOMAIN, r"\1\2@\3")


def misread(x: str) -> str:
    return reduce(lambda a, p: rewrite(a, p, ".com"), P.MISREAD_COM, literal(x, [(h, "@gmail.") for h in P.MISREAD_HOSTS]))


def display_name(x: str) -> str:
    edge = r"[,;:\-\t-\r\x{85}\p{Z}]+"
    bare = rewrite(rewrite(rewrite(f"coalesce({x}, '')", P.EMAIL, " "), r"""[<>\[\]\(\)"']""", " "), P.SPACE + "+", " ")
    return f"nullif({rewrite(bare, f'^{edge}|{edge}\\z', '')}, '')"


def truncated(x: str) -> str:
    return f"CASE WHEN length({x}) > 100 THEN substr({x}, 1, 97) || '...' ELSE {x} END"


def ctes(*names: str) -> str:
    """The named common tables and all that they build on, in order."""
    need, order = set(), []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, ()):
            add(d)
        if n not in need:
            need.add(n)
            order.append(n)

    for n in names:
        add(n)
    return ("WITH RECURSIVE " if "block" in need else "WITH ") + ", ".join(f"{n} AS ({TABLES[n]})" for n in order) + " "


def json_items(c: str) -> str:
    return f"from_json(coalesce({c}, '[]'), '[\"VARCHAR\"]')"


_found = misread(extract(hash_as_at(unquote("lower(normalized_value)")), P.EMAIL))
_address = " UNION ALL ".join(
    [f"SELECT id, '{r}' AS address_role, CAST(NULL AS BIGINT) AS address_index, {r} AS v FROM base" for r in ("sender", "account_email")]
    + [f"SELECT id, '{r}' AS address_role, i - 1 AS address_index, l[i] AS v FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, {json_items(r)} AS l FROM base))" for r in P.RECIPIENT_ROLES]
)
_candidate = hash_as_at(misread(unquote("lower(normalized_value)")))
_one_seed = rewrite(rewrite(rewrite("split_part(candidate, host, 1)", "^[^a-z0-9]+", ""), r"[^a-z0-9._%+\-/=]+", ""), r"[.@]+\z", "")
_left, _right = s(P.LEFT_OF_ADDRESS), s(P.RIGHT_OF_ADDRESS)


def canonical(x: str) -> str:
    local, domain = f"regexp_extract({x}, '^(.*)@', 1)", f"lower(regexp_extract({x}, '@([^@]*)$', 1))"
    return f"CASE WHEN contains({x}, '@') THEN replace({local}, '.', '') || '@' || CASE WHEN {domain} = 'googlemail.com' THEN 'gmail.com' ELSE {domain} END END"


_name_key = rewrite(literal(rewrite("lower(display_name)", P.EMAIL, " "), [("&", "and"), ("mailto:", " ")]), "[^a-z]", "")
_in = lambda xs: "(" + ", ".join(s(x) for x in xs) + ")"
_list = lambda xs: "[" + ", ".join(s(x) for x in xs) + "]::VARCHAR[]"
_roles = _in(P.RECIPIENT_ROLES)
_focus = f"(coalesce(email IN {_in(FOCUS_EMAILS)}, FALSE) OR coalesce(search_key IN {_in(FOCUS_ALIASES)}, FALSE))"
_score = lambda sent, received: f"round(abs({sent} + {received} - total_emails) / CAST(total_emails AS DOUBLE) + abs(ln((CAST({sent} AS DOUBLE) / {received} + {EPSILON}) / ratio)), {PLACES})"

#: The longest common block of x and y: its length k, the place of each end counted down (-1, -2, ...) so that the leftmost is largest.
_common_prefix = "coalesce(list_max(list_filter(range(1, least(length(x) - i, length(y) - j) + 2), lambda k: substr(x, i, k) = substr(y, j, k))), 0)"
_block = f"list_sort(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, length(y) + 1), lambda j: {{'k': {_common_prefix}, 'i': -i, 'j': -j}}))), 'DESC')[1]"

TABLES = {
    "mail": MAIL,
    "base": "SELECT * FROM mail WHERE is_promotional <> TRUE",
    "address": f"SELECT id, address_role, CAST(address_index AS BIGINT) AS address_index, normalized_value FROM (SELECT id, address_role, address_index, {normalize('v')} AS normalized_value FROM ({_address})) WHERE normalized_value IS NOT NULL",
    "found": f"SELECT *, {_found} AS f FROM address",
    "parts": "SELECT *, replace(regexp_extract(f, '^([^@]+)@', 1), '.', '') AS lp, regexp_extract(f, '@(.+)$', 1) AS dp FROM found",
    "parsed": f"SELECT id, address_role, address_index, normalized_value, {display_name('normalized_value')} AS display_name, CASE WHEN f IS NOT NULL AND length(lp || '@' || dp) <= {P.MAX_ADDRESS} AND length(lp) <= {P.MAX_LOCAL} AND length(dp) <= {P.MAX_DOMAIN} THEN lp || '@' || dp END AS email FROM parts",
    "keyed": f"SELECT *, coalesce(nullif({_name_key}, ''), nullif({rewrite('lower(email)', '[^a-z]', '')}, '')) AS search_key FROM parsed",
    "focus": f"SELECT id, bool_or(address_role = 'sender') AS from_focus, bool_or(address_role IN {_roles}) AS to_focus FROM keyed WHERE {_focus} AND address_role <> 'account_email' GROUP BY id",
    "exchange": f"SELECT DISTINCT search_key, side, id FROM (SELECT search_key, id, CASE WHEN address_role = 'sender' AND to_focus THEN 'sent' WHEN address_role IN {_roles} AND from_focus THEN 'received' END AS side FROM keyed JOIN focus USING (id) WHERE search_key IS NOT NULL AND address_role <> 'account_email') WHERE side IS NOT NULL",
    "stats": "SELECT search_key, len, coalesce(sender_count, 0) AS sender_count, coalesce(recipient_count, 0) AS recipient_count FROM (SELECT search_key, count(*) AS len FROM keyed WHERE search_key IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT search_key, count(*) FILTER (WHERE side = 'sent') AS sender_count, count(*) FILTER (WHERE side = 'received') AS recipient_count FROM exchange GROUP BY 1) USING (search_key)",
    "goal": " UNION ALL ".join(f"SELECT {s(n)} AS name, CAST({r} AS DOUBLE) AS ratio, CAST({t} AS BIGINT) AS total_emails, {_list(i)} AS include, {_list(e)} AS exclude, {_list(p)} AS prefer, {m} AS min_evidence, {c} AS cap, {w} AS width, {str(d).upper()} AS directional" for n, r, t, i, e, p, m, c, w, d in TARGETS),
    "ranked": "SELECT name, search_key, row_number() OVER (PARTITION BY name ORDER BY nullif(coalesce(list_position(prefer, search_key), 0), 0) ASC NULLS LAST, len DESC, search_key) - 1 AS position, cap, width FROM stats, goal WHERE len(list_filter(include, lambda t: contains(search_key, t))) > 0 AND len(list_filter(exclude, lambda t: contains(search_key, t))) = 0 AND (sender_count + recipient_count > min_evidence OR list_contains(prefer, search_key))",
    "cand": "SELECT name, search_key, CAST(position AS INTEGER) AS position, CAST(count(*) OVER (PARTITION BY name) AS INTEGER) AS n, CAST(least(width, count(*) OVER (PARTITION BY name)) AS INTEGER) AS width FROM ranked WHERE position < cap",
    "hist": "SELECT name, side, mask, count(*) AS ids FROM (SELECT name, side, id, bit_or(CAST(1 AS BIGINT) << (n - 1 - position)) AS mask FROM cand JOIN exchange USING (search_key) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3",
    "subsets": "SELECT * FROM (SELECT name, total_emails, ratio, width, unnest(range(CAST(1 AS BIGINT), CAST(1 AS BIGINT) << n)) AS picked FROM goal g JOIN (SELECT name, max(n) AS n, max(width) AS w FROM cand GROUP BY 1) USING (name)) WHERE bit_count(picked) <= width",
    "sums": "SELECT name, total_emails, ratio, picked, CAST(sum(CASE WHEN side = 'sent' THEN ids ELSE 0 END) AS BIGINT) AS sent, CAST(sum(CASE WHEN side = 'received' THEN ids ELSE 0 END) AS BIGINT) AS received FROM subsets JOIN hist USING (name) WHERE (picked & mask) <> 0 GROUP BY 1, 2, 3, 4",
    "best": f"SELECT name, picked, sent, received, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score, bit_count(picked), picked DESC) AS k FROM (SELECT *, {_score('sent', 'received')} AS score FROM sums WHERE received > 0)) WHERE k = 1",
    "extra": "SELECT name, picked, extra FROM (SELECT name, picked, unnest(range(CAST(0 AS BIGINT), CAST(1 AS BIGINT) << n)) AS extra FROM best JOIN (SELECT name, max(n) AS n FROM cand GROUP BY 1) USING (name) JOIN goal USING (name) WHERE directional) WHERE bit_count(extra) <= 3 AND (extra & picked) = 0",
    "oneside": "SELECT e.name, e.extra, CAST(coalesce(sum(CASE WHEN side = 'sent' AND (mask & (picked | extra)) <> 0 THEN ids END), 0) AS BIGINT) AS sent, CAST(coalesce(sum(CASE WHEN side = 'received' AND (mask & (picked | extra)) <> 0 THEN ids END), 0) AS BIGINT) AS received FROM extra e LEFT JOIN hist h ON h.name = e.name GROUP BY 1, 2",
    "two": f"SELECT a.name, a.extra AS se, b.extra AS re, a.sent, b.received, {_score('a.sent', 'b.received')} AS score FROM oneside a JOIN oneside b ON a.name = b.name JOIN goal ON goal.name = a.name WHERE b.received > 0 AND (a.extra <> 0 OR b.extra <> 0)",
    "twobest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score, bit_count(se), se DESC, bit_count(re), re DESC) AS k FROM two) WHERE k = 1",
    "directed": "SELECT b.name, b.picked, CASE WHEN t.score < b.score THEN se ELSE 0 END AS sender_extras, CASE WHEN t.score < b.score THEN re ELSE 0 END AS recipient_extras, CASE WHEN t.score < b.score THEN t.sent ELSE b.sent END AS sent, CASE WHEN t.score < b.score THEN t.received ELSE b.received END AS received, CASE WHEN t.score < b.score THEN t.score ELSE b.score END AS score FROM best b JOIN goal g ON g.name = b.name AND directional LEFT JOIN twobest t ON t.name = b.name",
    "final": "SELECT * FROM directed UNION ALL SELECT b.name, picked, 0, 0, sent, received, score FROM best b JOIN goal g ON g.name = b.name AND NOT directional",
    "label": "SELECT f.name, string_agg(search_key, ', ' ORDER BY position) FILTER (WHERE (picked & bit) <> 0) AS shared, string_agg('from+: ' || search_key, ', ' ORDER BY position) FILTER (WHERE (sender_extras & bit) <> 0) AS sx, string_agg('to+: ' || search_key, ', ' ORDER BY position) FILTER (WHERE (recipient_extras & bit) <> 0) AS rx FROM final f JOIN (SELECT *, CAST(1 AS BIGINT) << (n - 1 - position) AS bit FROM cand) c ON c.name = f.name GROUP BY 1",
    "report": f"SELECT g.name, g.ratio AS target_ratio, round(CAST(sent AS DOUBLE) / received, {PLACES}) AS matched_ratio, round(abs(ln((CAST(sent AS DOUBLE) / received + {EPSILON}) / g.ratio)), {PLACES}) AS ratio_log_error, g.total_emails AS target_total, sent + received AS matched_total, sent + received - g.total_emails AS delta_total, round(abs(sent + received - g.total_emails) / CAST(g.total_emails AS DOUBLE), {PLACES}) AS total_error, f.score AS person_error, sent AS sent_to_focus, received AS received_from_focus, CASE WHEN sx IS NULL AND rx IS NULL THEN shared ELSE concat_ws(', ', 'shared: ' || shared, sx, rx) END AS picked_keys FROM goal g LEFT JOIN final f ON f.name = g.name LEFT JOIN label l ON l.name = g.name",
    "suspect": f"SELECT * FROM parsed WHERE email IS NULL AND {matches('lower(normalized_value)', P.SUSPICIOUS)}",
    "seed0": f"SELECT *, {_candidate} AS candidate FROM suspect",
    "seed1": f"SELECT *, {extract('candidate', P.EMAIL)} AS found, {extract('candidate', P.WEBMAIL_DOMAIN)} AS host FROM seed0",
    "seed2": "SELECT *, CASE WHEN found IS NOT NULL THEN instr(candidate, found) END AS spot FROM seed1",
    "seed3": f"SELECT *, CASE WHEN found IS NOT NULL AND (spot = 1 OR contains({_left}, substr(candidate, spot - 1, 1))) AND (spot + length(found) > length(candidate) OR contains({_right}, substr(candidate, spot + length(found), 1))) THEN {canonical('found')} END AS direct, {_one_seed} AS part FROM seed2",
    "known": "SELECT email, CASE WHEN d = 'googlemail.com' THEN 'gmail.com' ELSE d END AS domain, regexp_replace(regexp_extract(email, '^([^@]+)@', 1), '[^a-z0-9]', '', 'g') AS compare, len FROM (SELECT email, lower(regexp_extract(email, '@(.+)$', 1)) AS d, count(*) AS len FROM parsed WHERE email IS NOT NULL GROUP BY 1) WHERE len >= 2",
    "wanted": "SELECT *, CASE WHEN host = 'googlemail.com' THEN 'gmail.com' ELSE host END AS domain FROM seed WHERE seed IS NOT NULL",
    "pair": "SELECT w.domain, seed, compare, email, len FROM (SELECT DISTINCT domain, seed FROM wanted) w JOIN known k ON k.domain = w.domain AND abs(length(compare) - length(seed)) <= greatest(2, length(seed) // 3)",
    # longest common blocks, the leftmost first, then what lies left and right of each
    "block": f"SELECT seed, compare, x, y, {_block} AS m FROM (SELECT DISTINCT seed, compare, seed AS x, compare AS y FROM pair) UNION ALL SELECT seed, compare, x, y, {_block} AS m FROM (SELECT seed, compare, part.x AS x, part.y AS y FROM (SELECT seed, compare, unnest([{{'x': substr(x, 1, -m.i - 1), 'y': substr(y, 1, -m.j - 1)}}, {{'x': substr(x, m.k - m.i), 'y': substr(y, m.k - m.j)}}]) AS part FROM block WHERE m.k > 0)) WHERE x <> '' AND y <> ''",
    "alike": "SELECT seed, compare, 2.0::DOUBLE * sum(coalesce(m.k, 0)) / (length(seed) + length(compare)) AS score FROM block GROUP BY 1, 2",
    "placed": "SELECT *, row_number() OVER (PARTITION BY domain, seed ORDER BY score DESC, len DESC, email) AS place, coalesce(lead(score) OVER (PARTITION BY domain, seed ORDER BY score DESC, len DESC, email), 0) AS second FROM pair JOIN alike USING (seed, compare)",
    "taken": f"SELECT domain, seed, {canonical('email')} AS repaired FROM placed WHERE place = 1 AND score >= {ACCEPT} AND (score >= {CERTAIN} OR score - second >= {MARGIN})",
    "repair": "SELECT id, address_role, address_index, min(repaired) AS repaired FROM (SELECT id, address_role, address_index, direct AS repaired FROM seed WHERE direct IS NOT NULL UNION ALL SELECT id, address_role, address_index, repaired FROM wanted JOIN taken USING (domain, seed)) GROUP BY 1, 2, 3",
    "repaired": "SELECT p.id, p.address_role, p.address_index, p.normalized_value, coalesce(r.repaired, p.email) AS email FROM parsed p LEFT JOIN repair r ON r.id = p.id AND r.address_role = p.address_role AND r.address_index = p.address_index",
    "seed": "SELECT id, address_role, address_index, candidate, direct, CASE WHEN direct IS NULL AND length(part) >= 4 AND length(regexp_replace(part, '[^a-z0-9]', '', 'g')) >= 4 THEN regexp_replace(part, '[^a-z0-9]', '', 'g') END AS seed, host FROM seed3",
}
DEPENDS = {
    "base": ["mail"], "address": ["base"], "found": ["address"], "parts": ["found"], "parsed": ["parts"], "keyed": ["parsed"], "focus": ["keyed"], "exchange": ["focus"],
    "stats": ["exchange"], "ranked": ["stats", "goal"], "cand": ["ranked"], "hist": ["cand"], "subsets": ["cand"], "sums": ["subsets", "hist"], "best": ["sums"], "extra": ["best"],
    "oneside": ["extra"], "two": ["oneside"], "twobest": ["two"], "directed": ["twobest"], "final": ["directed"], "label": ["final"], "report": ["label"],
    "suspect": ["parsed"], "seed0": ["suspect"], "seed1": ["seed0"], "seed2": ["seed1"], "seed3": ["seed2"], "seed": ["seed3"],
    "known": ["parsed"], "wanted": ["seed"], "pair": ["wanted", "known"], "block": ["pair"], "alike": ["block"], "placed": ["alike"], "taken": ["placed"], "repair": ["taken"], "repaired": ["repair"],
}


# ------------------------------------------------------------------ audit


def _common(x: str) -> dict[str, str]:
    c = f"coalesce({x}, '')"
    count = lambda ch: f"(length({c}) - length(replace({c}, {s(ch)}, '')))"
    return {"ocr_markup_tags": matches(c, P.TAG), "unmatched_angle_brackets": f"{count('<')} <> {count('>')}", "multiple_at_signs_or_merged_addresses": f"{count('@')} > 1", "whitespace_artifacts": matches(c, P.STRAY_SPACE)}


def _blank(x: str) -> str:
    return matches(x, P.BLANK)


def _no_at(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT {_blank(x)} AND NOT contains({x}, '@'))"


def _masked(x: str) -> str:
    return matches(f"lower(coalesce({x}, ''))", P.MASK)


def sender_checks(x: str) -> dict[str, str]:
    return {"missing_or_blank": f"({x} IS NULL OR {_blank(x)})", "no_email_address_present": _no_at(x), "redacted_or_masked": _masked(x), **_common(x)}


def item_checks(x: str) -> dict[str, str]:
    return {"recipient_items_without_email_address": _no_at(x), "redacted_or_masked_items": _masked(x), "empty_string_items": f"({x} IS NOT NULL AND {_blank(x)})", **_common(x)}


def counted(source: str, column: str, checks: dict[str, str], extra: dict[str, str] | None = None) -> str:
    totals = {k: f"count(*) FILTER (WHERE {v})" for k, v in checks.items()} | (extra or {})
    rows = " UNION ALL ".join(f"SELECT {s(column)} AS column_name, {s(k)} AS issue, CAST({v} AS BIGINT) AS count FROM {source}" for k, v in totals.items())
    return f"SELECT * FROM ({rows}) WHERE count > 0"


_variants = f"SELECT mailbox, count(DISTINCT sender) AS variant_count FROM (SELECT sender, lower({extract('sender', P.MAILBOX)}) AS mailbox FROM base) WHERE mailbox IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sender) > 1"


def list_checks(c: str) -> dict[str, str]:
    v = f"coalesce({c}, '')"
    return {"null_rows": f"{c} IS NULL", "empty_list_rows": matches(v, P.EMPTY_LIST), "rows_containing_empty_string_items": matches(v, P.EMPTY_STRING_LIST)}


def _items(c: str) -> str:
    return f"(SELECT id, unnest(from_json({c}, '[\"VARCHAR\"]')) AS item FROM base)"


def _counts(c: str) -> str:
    return f"{counted('base', c, list_checks(c))} UNION ALL {counted(_items(c), c, item_checks('item'))}"


def _recipients(c: str) -> str:
    return ctes("base") + _counts(c)


def _examples(source: str, value: str, checks: dict[str, str]) -> str:
    hits = " UNION ALL ".join(f"SELECT id, {value} AS v, {s(k)} AS issue FROM {source} WHERE {value} IS NOT NULL AND {p}" for k, p in checks.items())
    return f"SELECT issue, position, {truncated('v')} AS example FROM (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY id, v) AS position FROM ({hits})) WHERE position <= 3"


_participants = {
    "placeholder_only_rows": matches("coalesce(all_participants, '')", P.PLACEHOLDERS),
    "contains_raw_empty_list_tokens": matches("coalesce(all_participants, '')", P.EMPTY_TOKEN),
    "leading_or_trailing_whitespace": matches("coalesce(all_participants, '')", P.EDGE_SPACE),
    "whitespace_artifacts": matches("coalesce(all_participants, '')", P.STRAY_SPACE),
    "lowercased_lossy_representation": "NOT " + matches("coalesce(all_participants, '')", "[A-Z]"),
}
_account = {"missing_or_blank": f"(account_email IS NULL OR {_blank('account_email')})", "non_email_tokens": _no_at("account_email")}


def _joined(c: str) -> str:
    return f"array_to_string(list_transform({json_items(c)}, lambda v: coalesce({normalize('v')}, '<null>')), '|') AS {c}_normalized"


def _plain(x: str) -> str:
    return f"trim({rewrite(literal(rewrite(x, '<[^>]*>', ''), ENTITIES), P.SPACE + '+', ' ')})"


_mention = misread(extract(hash_as_at(unquote("lower(mention)")), P.EMAIL))
_metric = lambda name, e: f"SELECT {s(name)} AS metric, round(coalesce(CAST({e} AS DOUBLE), 0), 6) AS value FROM report"

_top_variants = f"SELECT * FROM ({_variants}) ORDER BY variant_count DESC, mailbox LIMIT 3"
_values = "SELECT DISTINCT account_email FROM base WHERE account_email IS NOT NULL ORDER BY 1 LIMIT 5"
_sender_counts = counted("base", "sender", sender_checks("sender")) + f" UNION ALL SELECT 'sender', '{VARIANTS}', count(*) FROM ({_variants}) HAVING count(*) > 0"
_account_counts = counted("base", "account_email", _account, {VALUES: "count(DISTINCT account_email)"})
_issues = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (_sender_counts, *map(_counts, P.RECIPIENT_ROLES), _account_counts, counted("base", "all_participants", _participants)))
_shown = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, * FROM ({_examples(source, value, checks)})"
    for c, source, value, checks in [
        ("sender", "base", "sender", sender_checks("sender")),
        *((c, "base", c, list_checks(c)) for c in P.RECIPIENT_ROLES),
        *((c, _items(c), "item", item_checks("item")) for c in P.RECIPIENT_ROLES),
        ("account_email", "base", "account_email", _account),
        ("all_participants", "base", "all_participants", _participants),
    ]
)

ORACLES: dict[str, str] = {
    "promo_filter_null": ctes("base") + "SELECT count(*) AS kept, count(sender) AS with_sender FROM base",
    "normalize_sender": ctes("base") + f"SELECT id, {normalize('sender')} AS sender_normalized FROM base",
    "normalize_recipients": ctes("base") + f"SELECT id, {', '.join(map(_joined, P.RECIPIENT_ROLES))} FROM base",
    "addresses_long": ctes("address") + "SELECT id, address_role, address_index, normalized_value FROM address",
    "parse_email": ctes("parsed") + "SELECT id, address_role, address_index, normalized_value AS raw_value, email FROM parsed",
    "display_name": ctes("parsed") + "SELECT id, address_role, address_index, display_name FROM parsed",
    "distinct_emails": ctes("parsed") + "SELECT DISTINCT email FROM parsed WHERE email IS NOT NULL ORDER BY 1",
    "sender_domains": ctes("parsed") + "SELECT DISTINCT regexp_extract(email, '@(.+)$', 1) AS domain FROM parsed WHERE email IS NOT NULL AND address_role = 'sender' ORDER BY 1",
    "parse_rates": ctes("parsed") + "SELECT address_role, count(*) AS addresses, count(email) AS with_email, count(display_name) AS with_name FROM parsed GROUP BY 1",
    "json_parse_failures": ctes("mail") + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE NOT json_valid(coalesce({c}, '[]'))) AS rows FROM mail" for c in P.RECIPIENT_ROLES),
    "audit_sender": ctes("base") + _sender_counts,
    "audit_to": _recipients("to_recipients"),
    "audit_cc": _recipients("cc_recipients"),
    "audit_bcc": _recipients("bcc_recipients"),
    "audit_account": ctes("base") + _account_counts,
    "audit_participants": ctes("base") + counted("base", "all_participants", _participants),
    "audit_examples": ctes("base") + _examples("base", "sender", sender_checks("sender")),
    "audit_item_examples": ctes("base") + _examples(_items("to_recipients"), "item", item_checks("item")),
    "audit_all_examples": ctes("base") + f"SELECT * FROM ({_shown})",
    "audit_report": ctes("base") + f"SELECT column_name, issue, count, coalesce(examples, '') AS examples FROM ({_issues}) LEFT JOIN (SELECT column_name, issue, string_agg(example, '|' ORDER BY position) AS examples FROM ({_shown}) GROUP BY 1, 2 UNION ALL SELECT 'sender', '{VARIANTS}', (SELECT string_agg(mailbox, '|' ORDER BY mailbox) FROM ({_top_variants})) UNION ALL SELECT 'account_email', '{VALUES}', (SELECT string_agg(account_email, '|' ORDER BY account_email) FROM ({_values}))) USING (column_name, issue)",
    "mailbox_variants_topk": ctes("base") + _top_variants,
    "account_smallest_values": ctes("base") + _values,
    "known_addresses": ctes("known") + "SELECT * FROM known",
    "suspicious_addresses": ctes("suspect") + "SELECT id, address_role, address_index, normalized_value FROM suspect",
    "repair_seed": ctes("seed") + "SELECT id, address_role, address_index, candidate, direct, CASE WHEN seed IS NOT NULL THEN CASE WHEN host = 'googlemail.com' THEN 'gmail.com' ELSE host END END AS domain, seed FROM seed",
    "repair_margin": f"WITH RECURSIVE known AS (SELECT compare, 'gmail.com' AS domain, compare || '@gmail.com' AS email, count(*) AS len FROM (SELECT regexp_replace(p_name, '[^a-z]', '', 'g') AS compare FROM part) GROUP BY 1), wanted AS (SELECT domain, unnest([substr(compare, 1, 1) || substr(compare, 3), substr(compare, 1, length(compare) - 1), substr(compare, 4), reverse(compare)]) AS seed FROM known), {', '.join(f'{t} AS ({TABLES[t]})' for t in ('pair', 'block', 'alike', 'placed', 'taken'))} SELECT domain, seed AS compare, repaired FROM taken",
    "fuzzy_repair": ctes("repaired") + "SELECT * FROM repaired",
    "repaired_emails": ctes("repaired") + "SELECT DISTINCT email FROM repaired WHERE email IS NOT NULL",
    "repaired_sender_domains": ctes("repaired") + "SELECT DISTINCT regexp_extract(email, '@(.+)$', 1) AS domain FROM repaired WHERE email IS NOT NULL AND address_role = 'sender'",
    "target_rules": ctes("goal") + "SELECT name, ratio, total_emails, array_to_string(include, '|') AS include, array_to_string(exclude, '|') AS exclude, array_to_string(prefer, '|') AS prefer, min_evidence, cap, width, directional FROM goal",
    "search_keys": ctes("keyed") + "SELECT id, address_role, address_index, search_key FROM keyed",
    "focus_ids": ctes("focus") + "SELECT * FROM focus",
    "key_stats": ctes("stats") + "SELECT * FROM stats",
    "candidates_ranked": ctes("cand") + "SELECT * FROM cand",
    "alias_subset_best": ctes("best") + "SELECT * FROM best",
    "alias_subset_kernel": ctes("best") + "SELECT * FROM best",
    "alias_directional_best": ctes("directed") + "SELECT * FROM directed",
    "match_report": ctes("report") + "SELECT * FROM report",
    "match_metrics": ctes("report") + " UNION ALL ".join([_metric("combined_error", "sum(person_error)"), _metric("total_abs_delta", "sum(abs(delta_total))"), _metric("ratio_log_error", "sum(ratio_log_error)"), _metric("worst_person_error", "max(person_error)"), _metric("matched_rows", "count(*)")]),
    "page_links": f"SELECT page_id, k - 1 AS position, href[k] AS href, {_plain('label[k]')} AS label FROM (SELECT *, unnest(range(1, len(href) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), {s(LINK)}, 1) AS href, regexp_extract_all(coalesce(html, ''), {s(LINK)}, 2) AS label FROM pages))",
    "person_cards": "SELECT lower(replace(n_name, ' ', '-')) AS slug, trim(n_name) || ' & co' AS name, 'of region ' || n_regionkey AS description, CAST(n_nationkey * 1234 + 7 AS BIGINT) AS email_count, '/person/' || lower(replace(n_name, ' ', '-')) AS url FROM nation WHERE n_nationkey < 20",
    "doc_email_mentions": f"SELECT doc_id, replace(regexp_extract(f, '^([^@]+)@', 1), '.', '') || '@' || regexp_extract(f, '@(.+)$', 1) AS email, count(*) AS mentions FROM (SELECT doc_id, {_mention} AS f FROM (SELECT doc_id, unnest(regexp_extract_all(text, {s(P.EMAIL)}, 1)) AS mention FROM documents)) GROUP BY 1, 2",
    "doc_entity_decode": f"SELECT page_id, {normalize('t')} AS title FROM (SELECT page_id, {extract('html', '<title>([^<]*)</title>')} AS t FROM pages)",
    "csv_roundtrip": "SELECT * FROM nation",
    "parquet_roundtrip": "SELECT r_regionkey, r_name FROM region",
    "parquet_columns": "SELECT l_quantity, count(*) AS lines, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_quantity >= 45 GROUP BY 1",
    "left_join_null_keys": "SELECT o_orderkey, o.k, c_mktsegment FROM (SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS k FROM orders) o LEFT JOIN (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS k, c_mktsegment FROM customer) c ON o.k = c.k",
    "dedup_keep_first": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
    "union_by_name_relaxed": "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS nation FROM customer UNION ALL SELECT CAST(s_suppkey AS BIGINT), s_name, NULL, s_nationkey FROM supplier",
    "explode_empty_lists": ctes("mail") + f"SELECT id, unnest(CASE WHEN len(l) = 0 THEN [NULL]::VARCHAR[] ELSE l END) AS item FROM (SELECT id, {json_items('to_recipients')} AS l FROM mail)",
    "explode_with_index": ctes("mail") + f"SELECT id, len(l) AS n, k - 1 AS position, l[k] AS item FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT id, {json_items('cc_recipients')} AS l FROM mail))",
    "semi_join_ids": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "any_horizontal_tokens": "SELECT p_partkey, (contains(p_name, '1') OR contains(p_name, '22') OR contains(p_name, '3')) AS hit, FALSE AS none FROM part",
    "conditional_counts": "SELECT count(*) FILTER (WHERE v IS NULL) AS no_value, count(*) FILTER (WHERE v > 50) AS large, count(*) FILTER (WHERE event_type = 'click' OR v > 50) AS click_or_large, count(*) FILTER (WHERE NOT event_type = 'click') AS not_click FROM (SELECT event_type, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)",
    "kleene_logic": ctes("mail") + "SELECT id, CAST(p AND q AS BIGINT) AS both, CAST(p OR q AS BIGINT) AS either, CAST(NOT p AS BIGINT) AS not_p, CAST(p <> TRUE AS BIGINT) AS ne_true FROM (SELECT id, is_promotional AS p, id % 2 = 0 AS q FROM mail)",
    "group_having_distinct": "SELECT l_suppkey, count(*) AS len, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1 HAVING count(*) > count(DISTINCT l_partkey)",
    "global_aggregates": "SELECT round(sum(c_acctbal), 2) AS total, round(sum(abs(c_acctbal)), 2) AS total_abs, max(c_acctbal) AS largest, count(DISTINCT c_mktsegment) AS segments, count(*) AS height FROM customer",
    "top_per_group": "SELECT o_orderstatus, place, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 2 END ASC NULLS LAST, o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 12",
    "sorted_head": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
    "argmin_argmax": "SELECT o_orderpriority, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY 1",
    "string_functions": f"SELECT p_partkey, lower(p_name) AS low, length(p_name) AS chars, len(regexp_extract_all(p_name, '[aeiou]')) AS vowels, {extract('p_name', '([0-9]+)')} AS digits, {rewrite('p_name', '([a-z])([0-9])', r'\1_\2')} AS marked, {truncated('repeat(p_name, 20)')} AS short, nullif(trim({rewrite('p_name', '[a-z0-9]', ' ')}), '') AS blank, split_part(p_name, ' ', 1) AS first_word FROM part",
    "number_functions": "SELECT c_custkey, abs(c_acctbal) AS size, round(ln(abs(c_acctbal) + 1e-9 + 1), 6) AS log, greatest(2, c_custkey // 3) AS band, least(c_custkey, 9) AS capped, c_custkey - 100 AS delta, round(c_acctbal / nullif(c_custkey % 4, 0), 6) AS quotient FROM customer",
    "fill_null_frame": "SELECT c_custkey, coalesce(orders, 0) AS orders, priority FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders, max(o_orderpriority) AS priority FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "cross_product": "SELECT CAST(a.r_regionkey AS BIGINT) AS a, CAST(b.r_regionkey AS BIGINT) AS b FROM region a, region b WHERE a.r_regionkey <> 0 OR b.r_regionkey <> 0",
    "set_operations": "SELECT l_orderkey, count(DISTINCT l_linenumber) AS either, count(DISTINCT l_linenumber) FILTER (WHERE r) AS both, coalesce(string_agg(DISTINCT CASE WHEN NOT r THEN l_linenumber END, ',' ORDER BY CASE WHEN NOT r THEN l_linenumber END), '') AS rest FROM (SELECT *, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, l_linenumber) = 1 AS r FROM lineitem) GROUP BY 1",
    "json_lists": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}
