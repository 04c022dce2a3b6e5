"""Secret scans with DataFrame functions only, through a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams: an OR of clauses, each
an AND of trigrams that any match must contain. The index holds, for each trigram that
some query asks for, the rows whose text (in lower case) contains it. A clause's postings
are intersected by counting its trigrams row by row, so no posting list is ever gathered.
Rows that satisfy a clause are candidates and are verified by the expression itself; a
rule without a mandatory trigram is run over every text.

Positions come without a user function: a text split by the expression gives what lies
between the matches, and running lengths give the offsets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headmint.llm.common import shared_dir, stored

BROADCAST_BYTES = 64 << 20  # of candidates, at KEY_BYTES each; more of them are joined by a shuffle
KEY_BYTES = 24  # a row's key and its rules, with what a hash table adds


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    min_length: int = 0  # of the whole match, in characters
    group: int = 0  # whose length must be min_group at least
    min_group: int = 0
    java: str | None = None  # an equivalent form that finds no match that fails the lengths


#: Base rules; their patterns are fixed. Order is the order of kinds.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, min_group=8),
    Rule("access", r"AKIA[A-Z0-9]+", min_length=16, java=r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]+", min_length=32, java=r"(?<![0-9a-f])[0-9a-f]{32,}"),
)
#: Further kinds, after the base ones: public formats of keys.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE
MAX_STRINGS = 32  # alternatives followed before a query gives up on being exact


# ------------------------------------------------------------------ trigram queries


@dataclass(frozen=True)
class Chars:
    """One character: any of these, in lower case; None if they are too many to list."""

    of: frozenset[str] | None


@dataclass(frozen=True)
class Choice:
    """Any of several sequences."""

    of: tuple[tuple, ...]


@dataclass(frozen=True)
class Repeat:
    """An item from low to high times; None: without end."""

    item: object
    low: int
    high: int | None


EMPTY = Choice(((),))  # what matches without taking a character
CONTROL = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "v": "\v", "a": "\a"}


class Parser:
    """Reads what rules use of regular expressions: literals, classes, groups, alternatives and counts."""

    def __init__(self, pattern: str):
        re.compile(pattern)  # what isn't an expression is refused here
        self.s, self.i = pattern, 0

    def take(self, text: str) -> bool:
        if self.s.startswith(text, self.i):
            self.i += len(text)
            return True
        return False

    def choice(self) -> Choice:
        out = [self.sequence()]
        while self.take("|"):
            out.append(self.sequence())
        return Choice(tuple(out))

    def sequence(self) -> tuple:
        out = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            out.append(self.counted(self.item()))
        return tuple(out)

    def counted(self, item):
        low, high = 1, 1
        m = re.compile(r"\{(\d*)(,?)(\d*)\}").match(self.s, self.i)
        if self.take("?"):
            low = 0
        elif self.take("*"):
            low, high = 0, None
        elif self.take("+"):
            high = None
        elif m and (m[1] or m[2]):
            low = int(m[1] or 0)
            high = low if not m[2] else int(m[3]) if m[3] else None
            self.i = m.end()
        else:
            return item
        if not self.take("?"):  # lazy or possessive: the same strings
            self.take("+")
        return Repeat(item, low, high)

    def item(self):
        if self.take("("):
            around = re.compile(r"\?<?[=!]").match(self.s, self.i)
            if m := re.compile(r"\?(<?[=!]|P<\w+>|>|[a-zA-Z]*(-[a-zA-Z]+)?[:)])").match(self.s, self.i):
                self.i = m.end()
                if m[1].endswith(")"):  # flags alone
                    return EMPTY
            inner = self.choice()
            self.take(")")
            return EMPTY if around else inner
        if self.take("["):
            return self.members()
        if self.take("."):
            return Chars(None)
        if self.take("^") or self.take("$"):
            return EMPTY
        return self.escape() if self.take("\\") else self.literal()

    def literal(self) -> Chars:
        self.i += 1
        return Chars(frozenset(self.s[self.i - 1].lower()))

    def escape(self):
        c = self.s[self.i]
        self.i += 1
        if c in "xu":
            n = 2 if c == "x" else 4
            self.i += n
            return Chars(frozenset(chr(int(self.s[self.i - n : self.i], 16)).lower()))
        if c in CONTROL:
            return Chars(frozenset(CONTROL[c]))
        if c in "bBAZ":
            return EMPTY
        return Chars(None) if c.isalnum() else Chars(frozenset(c))  # a class such as \\d, or a reference

    def members(self) -> Chars:
        no = self.take("^")
        out: set[str] | None = None if no else set()
        first = True
        while first or not self.take("]"):
            first = False
            a = self.escape().of if self.take("\\") else self.literal().of
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                b = self.escape().of if self.take("\\") else self.literal().of
                low, high = (ord(*x) if x else 0 for x in (a, b))
                a = frozenset(chr(c).lower() for c in range(low, high + 1)) if b and high - low < MAX_STRINGS else None
            out = None if out is None or a is None else out | a
        return Chars(frozenset(out) if out is not None and len(out) <= 8 else None)


def _strings(item) -> set[str] | None:
    """All strings that an item can match, in lower case; None if they are too many."""
    if isinstance(item, Chars):
        return None if item.of is None else set(item.of)
    if isinstance(item, Choice):
        parts = [_all(b) for b in item.of]
        if any(p is None for p in parts):
            return None
        out = set().union(*parts)
        return out if len(out) <= MAX_STRINGS else None
    if item.high is None or item.high > 3 or (one := _strings(item.item)) is None:
        return None
    out, power = (set() if item.low else {""}), {""}
    for k in range(1, item.high + 1):
        power = {a + b for a in power for b in one}
        if len(power) > MAX_STRINGS:
            return None
        if k >= item.low:
            out |= power
    return out


def _all(sequence: tuple) -> set[str] | None:
    """All strings of a sequence."""
    out = {""}
    for item in sequence:
        s = _strings(item)
        if s is None or len(out) * len(s) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in s}
    return out


def trigrams(s: str) -> frozenset[str]:
    """Trigrams that cover a string end to end: fewer postings, and any text with s has them all."""
    last = len(s) - 3
    return frozenset(s[i : i + 3] for i in {*range(0, last + 1, 3), max(last, 0)} if last >= 0)


def _simplest(clauses: set[frozenset[str]]) -> set[frozenset[str]]:
    """Without clauses that a weaker one implies."""
    return {c for c in clauses if not any(d < c for d in clauses)}


def trigram_query(pattern: str) -> set[frozenset[str]]:
    """An OR of ANDs of trigrams (of lower-cased text) that every match satisfies.

    {frozenset()} asks for nothing: the rule has no mandatory trigram.
    """
    query: set[frozenset[str]] = {frozenset()}

    def require(strings: set[str]) -> None:
        nonlocal query
        clauses = {trigrams(s) for s in strings if not any(o != s and o in s for o in strings)}  # a text with s has o
        if clauses and len(query) * len(clauses) <= 256:
            query = _simplest({a | b for a in query for b in clauses})

    def walk(sequence: tuple) -> None:
        run = {""}
        for item in sequence:
            s = _strings(item)
            if s is not None and len(run) * len(s) <= MAX_STRINGS:
                run = {a + b for a in run for b in s}
                continue
            require(run)
            run = s if s is not None else {""}
            if s is None:
                if isinstance(item, Repeat) and item.low >= 1:
                    walk((item.item,))
                elif isinstance(item, Choice) and len(item.of) == 1:
                    walk(item.of[0])
        require(run)

    walk((Parser(pattern).choice(),))
    return query


def clauses_of(rules: tuple[Rule, ...]) -> list[tuple[str, int, list[str]]]:
    """(kind, clause number, its trigrams) of the rules that have mandatory trigrams."""
    out = []
    for r in rules:
        query = trigram_query(r.pattern)
        if frozenset() not in query:
            out += [(r.kind, k, sorted(c)) for k, c in enumerate(sorted(query, key=sorted))]
    return out


# ------------------------------------------------------------------ index and search


def row_key(id_col: Column, text: Column) -> Column:
    return F.xxhash64(id_col, text)


COMMON = " etaoinshrdlcumwfgypbvkjxqz"  # letters by falling frequency


def rarest_first(grams: list[str]) -> list[str]:
    """By the letters, the least likely trigram first."""
    place = lambda c: COMMON.index(c) if c in COMMON else len(COMMON)
    return sorted(grams, key=lambda t: (-sum(map(place, t)), t))


def trigram_index(docs: DataFrame, clauses: list[tuple[str, int, list[str]]]) -> DataFrame:
    """Postings (trigram, row) of docs(row, text) for the trigrams of the clauses.

    A clause's trigrams are looked for rarest first, each only where those before it are: what
    is left out can't be in the clause's intersection.
    """
    has = lambda t: F.contains("low", F.lit(t))
    after: dict[str, set[tuple[str, ...]]] = {}
    for _, _, grams in clauses:
        order = rarest_first(grams)
        for k, t in enumerate(order):
            after.setdefault(t, set()).add(tuple(order[:k]))
    there = [reduce(or_, (reduce(and_, [*map(has, before), has(t)]) for before in sorted(befores))) for t, befores in sorted(after.items())]
    found = F.array_remove(F.array(*(F.when(c, F.lit(t)).otherwise(F.lit("")) for t, c in zip(sorted(after), there, strict=True))), "")
    return docs.select("row", F.lower("text").alias("low")).select("row", found.alias("found")).filter(F.size("found") > 0).select(F.explode("found").alias("trigram"), "row")


def candidates(index: DataFrame, clauses: list[tuple[str, int, list[str]]], kinds: list[str]) -> DataFrame:
    """(row, found): rows in the intersection of all postings of some clause; found has a bit for each of kinds."""
    rows = [F.struct(F.lit(1 << kinds.index(kind)).cast("bigint").alias("bit"), F.lit(k).alias("clause"), F.lit(t).alias("trigram"), F.lit(len(ts)).alias("needed")) for kind, k, ts in clauses for t in ts]
    asked = index.sparkSession.range(1).select(F.inline(F.array(*rows)))
    counted = index.join(F.broadcast(asked), "trigram").groupBy("row", "bit", "clause").agg(F.count_distinct("trigram").alias("n"), F.first("needed").alias("needed"))
    return counted.filter("n >= needed").groupBy("row").agg(F.bit_or("bit").alias("found"))


SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of a rule in a text: leftmost, non-overlapping, those that pass its lengths."""
    pattern = rule.java or rule.pattern
    # the whole match as group 1; the rule's own groups move up by one
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    inner = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(rule.group + 1))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.transform(gaps, lambda g: F.char_length(g).cast("bigint")).alias("gap"), F.transform(found, lambda m: F.char_length(m).cast("bigint")).alias("size"), F.transform(inner, lambda m: F.char_length(m).cast("bigint")).alias("part"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        good = (x["size"] >= rule.min_length) & (x["part"] >= rule.min_group)
        span = F.struct(a.alias("start"), (a + x["size"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((a + x["size"]).alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.filter(zipped, lambda x: x["size"].isNotNull()), start, step)["out"]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = (), spans_col: str = "spans") -> DataFrame:
    """One row per document: id, spans (start, end, kind; code points, end exclusive) by start,
    then the rules' order; and the columns of docs named in keep.

    Null and empty texts have no spans. Rows of equal id and text get equal spans, each its
    own row; a null id is an id like any other. Other columns are ignored.
    """
    kept = [f"keep_{c}" for c in keep]
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    d = d.withColumn("row", row_key(F.col("id"), F.col("text")))
    clauses = clauses_of(rules)
    full = [r for r in rules if r.kind not in {c[0] for c in clauses}]
    none = F.array().cast(SPANS)
    spans = [F.when(F.rlike("text", F.lit(r.java or r.pattern)), rule_spans(F.col("text"), r)).otherwise(none) for r in full]
    if clauses:
        folder = shared_dir(docs.sparkSession)
        index = stored(trigram_index(d.select("row", "text"), clauses), f"{folder}/trigrams")
        kinds = list(dict.fromkeys(c[0] for c in clauses))
        found = stored(candidates(index, clauses, kinds), f"{folder}/candidates")
        if found.count() * KEY_BYTES <= BROADCAST_BYTES:  # then texts stay where they were read
            found = F.broadcast(found)
        d = d.join(found, "row", "left")
        spans += [F.when(F.col("found").bitwiseAND(F.lit(1 << kinds.index(r.kind))) > 0, rule_spans(F.col("text"), r)).otherwise(none) for r in rules if r not in full]
    rank = F.map_from_arrays(F.array(*(F.lit(r.kind) for r in rules)), F.array(*(F.lit(k) for k in range(len(rules)))))
    ranked = F.transform(F.concat(*spans), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(ranked), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return d.select(F.col("id").alias(id_col), ordered.alias(spans_col), *(F.col(c).alias(c[5:]) for c in kept))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each stretch of overlapping or touching spans replaced by mark; columns stay."""
    spans = "_".join(["spans", *docs.columns])  # no column of docs has this name
    found = secret_spans(docs, id_col, text_col, rules, tuple(c for c in docs.columns if c != id_col), spans)
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] > acc["at"]
        between = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        first = F.size(acc["out"]) == 0
        grown = F.when(apart | first, F.concat(acc["out"], F.array(F.when(apart, between).otherwise(F.lit("")), F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), grown.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, cut).otherwise(text)).select(*docs.columns)
