"""Personal data in texts: exact base patterns, and more found by a linear-chain CRF.

Base spans follow four fixed patterns. A conditional random field over word shapes and the
words around adds spans that they miss, such as telephone numbers without a plus sign: after
"tel" or "call" ten digits are a number to ring, after "ISBN" or "order" they aren't. It is
trained from a small labelled table of sentences (`LABELLED`) and decoded by Viterbi in numpy
batches.

The field's chains are runs of neighbouring words with a digit or an @; other words are
outside by rule and reach the field as features: the BEFORE words before a run and the one
after it. That makes runs independent of each other and the decoding of long texts cheap and
exact. Words are found in numpy over the bytes of a slice; only texts with a digit or an @
are looked at as strings.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headmint.llm.common import split_words, text_slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)

# The patterns' fixed parts. The possessive and look-behind forms match what the plain
# ones do and stay linear on long runs.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return s.replace(" ", "").replace("-", "")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind and start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# ------------------------------------------------------------------ the random field


#: Words of the labelled sentences: what comes before a number to ring, and before other numbers.
CALLING = ("call", "tel", "tel.", "telephone", "phone", "mobile", "cell", "fax", "ring", "dial", "text me", "reach me at", "call me on", "phone number", "my number is", "contact", "hotline", "whatsapp", "phone is", "or call")
COUNTING = ("isbn", "order", "order number", "invoice", "ref", "reference", "serial", "serial number", "part number", "tracking", "ticket", "case", "scores", "sizes", "lot", "item", "sku", "id", "account", "code", "article", "batch", "version", "page", "numbers", "total of", "about", "the", "draws", "in")
CARRYING = ("card", "card number", "visa", "pay with", "credit card", "charged to")
AFTER = ("", "now", "today", "please", "and", "for", "or", "was", "is")


def _labelled() -> list[tuple[list[str], list[tuple[str, str]], str]]:
    """The labelled table: words before, a run of words with digits or @ and their labels, the word
    after. Sentences are written out by rule."""
    rows: list[tuple[list[str], list[tuple[str, str]], str]] = []

    def add(before: str, number: str, label: str, after: str = "") -> None:
        rows.append((before.split(), [(w, label) for w in number.split()], after))

    for k in range(10):
        d = [str((k * 7919 + j * 104729 + 12345) % 10**9 + 10**8) for j in range(4)]
        a, b, c, e = d[0][:3], d[1][:3], d[2][:4], d[3][:4]
        calling = [CALLING[(k + j * 7) % len(CALLING)] for j in range(4)]
        counting = [COUNTING[(k + j * 11) % len(COUNTING)] for j in range(6)]
        after = [AFTER[(k + j * 2) % len(AFTER)] for j in range(6)]
        # numbers that look like ones to ring wherever they are
        for phone in (f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"+{k % 9 + 1} ({a}) {b}-{c}", f"+{k % 9 + 1} {a} {b} {c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}", f"+{k % 9 + 1}-{a}-{b}-{c}"):
            rows.append(([], [(w, "phone") for w in phone.split()], ""))
            rows.append(([], [(w + ",", "phone") if w == phone.split()[-1] else (w, "phone") for w in phone.split()], ""))
            add(calling[k % 4], phone, "phone", after[0])
        # numbers that only the words around tell apart
        plain = (f"0{a[:2]} {c} {e}", f"0{c} {a}{b}", f"0{k % 9 + 1} {a[:2]} {b[:2]} {c[:2]} {e[:2]}", f"0{c} {a} {b}", f"{a}{b}{c}", f"0{a}{b}{c}", f"{a} {b} {c}", f"{a[:2]} {b[:2]} {c[:2]} {e[:2]}", f"{a} {c}{e}")
        for j, number in enumerate(plain):
            add(calling[j % 4], number, "phone", after[j % 6])
            add(calling[(j + 1) % 4] + ":", number + ",", "phone")
            add(counting[j % 6], number, "other", after[(j + 3) % 6])
            add(counting[(j + 2) % 6] + ":", number + ".", "other")
            add(["we counted", "there were", "with", "of", "", "a list of"][(j + k) % 6], number, "other", after[j % 6])
        add("isbn", f"978-{k % 10}-{a[:2]}-{b}{c[:3]}-{k % 10}", "other")
        add("isbn", f"{k % 10}-{a}-{b}{c[:2]}-{k % 10}", "other", "in")
        add("isbn:", f"979-{k % 10}-{c}-{e}-{k % 9}", "other")
        add(counting[0], f"{a}-{b}-{c}-{k % 10}", "other")
        add("born", f"19{k + 60}-0{k % 9 + 1}-1{k % 9}", "other")
        add(calling[1], f"{k + 1}", "other", "times")
        add(calling[2], f"{k + 1} {k % 7 + 2}", "other", "days")
        rows.append(([], [(f"{a}{b}{c}{e}{b}"[:16], "card")], ""))
        rows.append(([], [(f"{a}{b}{c}{e}{b}"[:16], "card"), (f"{c}{e}{e}{c}", "card")], ""))
        rows.append(([], [(w, "card") for w in (c, e, c, e)], ""))
        rows.append(([], [(f"{c}-{e}-{c}-{e}", "card")], ""))
        for j, number in enumerate((f"{c}{e}{e}{c}", f"{c} {e} {c} {e}", f"{c}-{e}-{c}-{e}")):
            add(CARRYING[(k + j) % len(CARRYING)], number, "card", after[j])
        rows.append(([], [(f"{int(a) % 256}.{int(b) % 256}.{k}.{k + 9}", "ip")], ""))
        rows.append(([], [(f"user.{k}@mail{k}.example.com", "email")], ""))
        rows.append(([], [(f"<ab{k}@example.org>,", "email")], ""))
        # what isn't personal data
        for j, other in enumerate((f"{k}.{k + 1}.", f"{a}", f"{c}", f"20{k:02d}-0{k % 9 + 1}-1{k % 9}", f"1{k % 9}:3{k % 9}", f"{a},{b}", f"{a}.{c[:2]}", f"{a}{b}{c}", f"v{k}.{k + 1}.{k + 2}", f"{k}%", f"{a}x{b}", f"AKIA{a}AB{b}CD", f"password={a}ab{b}cd{c}", f"{a}/{b}", f"{k}th", f"@{'abcdefgh'[k % 8]}b", f"{a}-{b}", f"#{c}", f"{c}-{e}", f"0x{a}f{b}", f"{a}ab{b}cd{c}ef{e}0a")):
            rows.append(([], [(other, "other")], ""))
            add(counting[j % 6], other, "other", after[j % 6])
        rows.append(([], [(f"{a}", "other"), (f"{b}", "other")], ""))
        rows.append(([], [(f"{c}", "other"), (f"{a},{b}", "other"), (f"{k}", "other")], ""))
    return rows


LABELLED = _labelled()
TRIM = "\"'`,;:!?*#$%&<>[]{}|~=_^\\/"


@lru_cache(maxsize=1 << 16)
def shape(word: str) -> str:
    """A word's shape: digits 9, letters a, runs of four and more cut to four, edges trimmed."""
    s = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", word.strip(TRIM).rstrip(".")))
    return re.sub(r"(.)\1{3,}", r"\1\1\1\1", s)


LONG = 64  # characters; a longer word is cut around its digits and @
CHUNK = re.compile(r"[A-Za-z0-9@.()+-]++")
NUMBER = re.compile(r"[0-9.()+-]++")


def pieces(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """What the field reads of a word: the word, or of a long one (prose without blanks, joined
    fields) the parts with a digit or an @ between other letters and punctuation."""
    if len(text[start:end].strip(TRIM)) <= LONG:
        return [(start, end)]
    out = []
    for m in CHUNK.finditer(text, start, end):
        short = m.end() - m.start() <= LONG or "@" in m[0]
        out += [p.span() for p in ([m] if short else NUMBER.finditer(text, *m.span())) if re.search("[0-9@]", p[0])]
    return out


BEFORE = 4  # words before a run that are its features
CONTEXT = 24  # characters that a word has at most that is a feature; the table's are shorter


def plain_word(word: str) -> str:
    return word.strip(TRIM + ".()-").lower()


Run = tuple[list[str], list[str], str]  # plain words before, shapes, plain word after


def features(run: Run, k: int) -> list[str]:
    """Of a word of a run: its shape and its neighbours', what it is made of, and the words around the run."""
    before, shapes, after = run
    s = shapes[k]
    n = sum(c == "9" for c in s)
    own = [f"s:{s}", f"p:{shapes[k - 1] if k else '^'}|{s}", f"n:{s}|{shapes[k + 1] if k + 1 < len(shapes) else '$'}", f"d:{min(n, 12)}", f"@:{'@' in s}", f"+:{s[:1] == '+'}", "c:" + "".join(sorted(set(s) - {"9", "a"}))]
    near = dict.fromkeys(w for w in before[-BEFORE:] if w)
    return own + [f"b:{w}" for w in near] + [f"l:{before[-1] if before else ''}", f"a:{after}", f"r:{len(shapes)}"]


MOST_FEATURES = 7 + BEFORE + 3


class ChainField:
    """Weights of a linear-chain conditional random field over the features above."""

    def __init__(self, table: list[tuple[list[str], list[tuple[str, str]], str]], rounds: int = 80, rate: float = 0.3):
        runs = [(([plain_word(w) for w in before], [shape(w) for w, _ in r], plain_word(after)), [LABELS.index(y) for _, y in r]) for before, r, after in table]
        self.number: dict[str, int] = {}
        times = Counter((tuple(tuple(self.number.setdefault(f, len(self.number)) for f in features(run, k)) for k in range(len(run[1]))), tuple(y)) for run, y in runs)
        coded, golds, weight = [c for c, _ in times], [y for _, y in times], np.array([*times.values()], float)[:, None, None]  # rows that look alike count as often as they are there
        n, k = len(self.number), len(LABELS)
        # the last row stands for no feature and stays zero
        self.emit, self.move, self.begin, self.end = np.zeros((n + 1, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k)
        long = max(map(len, coded), default=0)
        ids = np.full((len(coded), long, MOST_FEATURES), n)
        gold = np.zeros((len(coded), long), np.int64)
        size = np.array([len(c) for c in coded])
        for i, (c, y) in enumerate(zip(coded, golds, strict=True)):
            gold[i, : len(y)] = y
            for t, f in enumerate(c):
                ids[i, t, : len(f)] = f
        there = np.arange(long) < size[:, None]
        rows, last = np.arange(len(coded)), size - 1
        flat = (np.repeat(ids.reshape(-1, MOST_FEATURES), k, axis=0) * k + np.tile(np.arange(k), len(coded) * long)[:, None]).ravel()
        sq = [np.full_like(a, 1e-3) for a in (self.emit, self.move, self.begin, self.end)]
        for _ in range(rounds):
            scores = self.emit[ids].sum(axis=2)
            forward, backward = np.zeros_like(scores), np.zeros_like(scores)
            forward[:, 0] = self.begin + scores[:, 0]
            for t in range(1, long):
                step = _lse(forward[:, t - 1, :, None] + self.move, 1) + scores[:, t]
                forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
            total = _lse(forward[:, -1] + self.end, 1)
            backward[:, -1] = self.end
            for t in range(long - 2, -1, -1):
                step = _lse((self.move + (scores[:, t + 1] + backward[:, t + 1])[:, None, :]), 2)
                backward[:, t] = np.where(there[:, t + 1, None], step, self.end)
            post = np.exp(forward + backward - total[:, None, None]) * there[:, :, None]
            want = np.eye(k)[gold] * there[:, :, None]
            diff = (want - post) * weight
            g_emit = np.bincount(flat, weights=np.repeat(diff.reshape(-1), MOST_FEATURES), minlength=(n + 1) * k).reshape(n + 1, k)
            g_emit[n] = 0
            g_move = np.zeros_like(self.move)
            for t in range(1, long):
                pair = np.exp(forward[:, t - 1, :, None] + self.move + (scores[:, t] + backward[:, t])[:, None, :] - total[:, None, None]) * there[:, t, None, None]
                g_move += ((want[:, t - 1, :, None] * want[:, t, None, :] - pair) * weight).sum(axis=0)
            g_begin, g_end = diff[:, 0].sum(axis=0), diff[rows, last].sum(axis=0)
            for a, g, s in zip((self.emit, self.move, self.begin, self.end), (g_emit, g_move, g_begin, g_end), sq, strict=True):
                g -= 0.05 * a
                s += g * g
                a += rate * g / np.sqrt(s)

    def scores(self, run: Run) -> np.ndarray:
        out = np.zeros((len(run[1]), len(LABELS)))
        for k in range(len(run[1])):
            ids = [i for f in features(run, k) if (i := self.number.get(f)) is not None]
            out[k] = self.emit[ids].sum(axis=0)
        return out

    def viterbi(self, runs: list[Run]) -> list[np.ndarray]:
        """Best labels of each run; runs of like length are decoded together."""
        out: list[np.ndarray | None] = [None] * len(runs)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i][1]))
        a = 0
        while a < len(order):
            longest, b = len(runs[order[a]][1]), a + 1
            while b < len(order) and len(runs[order[b]][1]) <= 1.25 * longest and (b - a) * len(runs[order[b]][1]) < 200_000:
                b += 1
            part = order[a:b]
            size = np.array([len(runs[i][1]) for i in part])
            s = np.zeros((len(part), size.max(), len(LABELS)))
            for k, i in enumerate(part):
                s[k, : size[k]] = self.scores(runs[i])
            best = self.begin + s[:, 0]
            back = np.zeros(s.shape, np.int8)
            for t in range(1, s.shape[1]):
                step = best[:, :, None] + self.move
                back[:, t] = step.argmax(axis=1)
                best = np.where((t < size)[:, None], step.max(axis=1) + s[:, t], best)
            label = (best + self.end).argmax(axis=1)
            path = np.zeros(s.shape[:2], np.int64)
            for t in range(s.shape[1] - 1, -1, -1):
                path[:, t] = label
                label = np.where(t < size, back[np.arange(len(part)), t, label], label)
            for k, i in enumerate(part):
                out[i] = path[k, : size[k]]
            a = b
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def plausible(kind: str, s: str) -> bool:
    """What a span that the field adds must have."""
    n = sum("0" <= c <= "9" for c in s)
    if kind == "phone":
        return 7 <= n <= 15 and any(c in s for c in "-(). ") or 9 <= n <= 12 and len(s) == n
    if kind == "card":
        return 13 <= n <= 19 and luhn("".join(c for c in s if "0" <= c <= "9"))
    if kind == "ip":
        return len(p := s.split(".")) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in p)
    return s.count("@") == 1 and 0 < s.index("@") and "." in s[s.index("@") :]


SPAN_WORDS = 19  # of a span: each has a digit, and a card has 19 at most


def split_run(kind: str, text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of plausible numbers in neighbouring words of one label, which may hold several numbers.

    Among the ways to cut, those that cover the most digits count; of them, those that join
    the least across punctuation such as a comma, line ends and tabs, plus signs, opening
    brackets and whole numbers; then the fewest and the most even spans.
    """
    n = len(words)
    pure = TRIM + "."
    whole = [trimmed(kind, text, *w) is not None for w in words]
    soft = [0] * n
    for k in range(1, n):
        digits = sum("0" <= c <= "9" for c in text[words[k - 1][0] : words[k - 1][1]])
        apart = text[words[k - 1][1] - 1] in pure or text[words[k][0]] in pure + "+"
        soft[k] = 4 * apart + 2 * (set(text[words[k - 1][1] : words[k][0]]) != {" "}) + (whole[k - 1] and whole[k]) + 3 * (text[words[k][0]] == "(" and digits > 2)
    best: list[tuple[tuple[int, int, int, int], int, tuple[int, int] | None]] = [((0, 0, 0, 0), 0, None)]
    for j in range(1, n + 1):
        top = (best[j - 1][0], j - 1, None)  # the last word is in no span
        cost = 0
        for i in range(j - 1, max(-1, j - 1 - SPAN_WORDS), -1):
            if i < j - 1:
                cost += soft[i + 1]
            if span := trimmed(kind, text, words[i][0], words[j - 1][1]):
                digits = sum("0" <= c <= "9" for c in text[span[0] : span[1]])
                more = (digits, -cost, -1, -digits * digits)
                value = tuple(a + b for a, b in zip(best[i][0], more, strict=True))
                if value > top[0]:
                    top = (value, i, span)
        best.append(top)
    out, j = [], n
    while j:
        _, i, span = best[j]
        if span:
            out.append(span)
        j = i
    return out[::-1]


def _spans(field: ChainField):
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def of_slice(buf: np.ndarray, off: np.ndarray) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(off) - 1)]
        marked = ((buf >= 48) & (buf <= 57)) | (buf == 64)
        count = np.concatenate([[0], np.cumsum(marked)])
        if not count[-1]:
            return out
        w = split_words(buf, off)
        hit = np.flatnonzero(count[w.end] > count[w.start])
        # runs of words with a digit or an @, next to each other in a text
        new = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(w.row[hit]) != 0)])
        begin = np.flatnonzero(new)
        chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        texts: dict[int, str] = {}
        starts: dict[int, list[int]] = {}  # of base spans, and how far those up to each reach
        reach: dict[int, list[int]] = {}
        for r in np.unique(w.row[hit]).tolist():
            texts[r] = buf[off[r] : off[r + 1]].tobytes().decode()
            out[r] = [{"kind": k, "start": a, "end": b, "base": True} for k, a, b in base_spans(texts[r])]
            at = sorted((s["start"], s["end"]) for s in out[r])
            starts[r], reach[r] = [a for a, _ in at], list(accumulate((b for _, b in at), max))
        at = [(r, int(chars[s] - chars[off[r]]), int(chars[e] - chars[off[r]])) for r, s, e in zip(w.row[hit].tolist(), w.start[hit].tolist(), w.end[hit].tolist(), strict=True)]
        runs: list[list[tuple[int, int, int]]] = []
        around: list[tuple[list[str], str]] = []

        def plain(k: int) -> str:
            return plain_word(buf[w.start[k] : w.end[k]].tobytes().decode()) if w.end[k] - w.start[k] <= CONTEXT else ""

        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(at)], strict=True):
            open_run = False
            first, final = int(hit[a]), int(hit[b - 1])
            low = max(first - BEFORE, int(np.searchsorted(w.row, w.row[first])))
            before = [plain(k) for k in range(low, first)]
            after = plain(final + 1) if final + 1 < len(w.row) and w.row[final + 1] == w.row[final] else ""
            for r, start, end in at[a:b]:
                for x, y in pieces(texts[r], start, end) if end - start > LONG else ((start, end),):
                    if open_run and (end - start <= LONG and not long or not any(c.isalnum() for c in texts[r][runs[-1][-1][2] : x])):
                        runs[-1].append((r, x, y))
                    else:
                        runs.append([(r, x, y)])
                        around.append((before, after))
                    open_run = True
                long = end - start > LONG
        labels = field.viterbi([(before, [shape(texts[r][a:b]) for r, a, b in run], after) for run, (before, after) in zip(runs, around, strict=True)])
        for run, label in zip(runs, labels, strict=True):
            k = 0
            r = run[0][0]
            taken = [label[i] and bool(reach[r]) and (m := bisect_left(starts[r], b)) > 0 and reach[r][m - 1] > a for i, (_, a, b) in enumerate(run)]  # by a base span
            while k < len(run):
                j = k + 1
                while j < len(run) and label[j] == label[k] and not taken[j] and not taken[k] and LABELS[label[k]] in ("card", "phone"):
                    j += 1
                if label[k] and not taken[k]:
                    for start, end in split_run(LABELS[label[k]], texts[r], [(a, b) for _, a, b in run[k:j]]):
                        out[r].append({"kind": LABELS[label[k]], "start": start, "end": end, "base": False})
                k = j
        for spans in out:
            spans.sort(key=lambda s: (KINDS.index(s["kind"]), s["start"], s["end"]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column(1)):
                yield pa.record_batch({"id": b.column(0).slice(lo, hi - lo), "spans": pa.array(of_slice(buf, off), pa.list_(kind))})

    return run


def trimmed(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The span without punctuation at its ends, where it is plausible."""
    cut = TRIM + "." + ("" if kind == "phone" else "()+-")
    while start < end and text[start] in cut:
        start += 1
    while start < end and text[end - 1] in cut:
        end -= 1
    return (start, end) if start < end and plausible(kind, text[start:end]) else None


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: ChainField | None = None) -> DataFrame:
    """One row per document: id, spans (kind, start, end in code points, base).

    Spans are ordered by kind (email, ip, card, phone), then start; end is exclusive. Spans
    of the field never overlap base ones. Null and empty texts have none. Ids may be null or
    repeat: rows are independent of each other. Other columns are ignored.
    """
    t = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = t.mapInArrow(_spans(field or ChainField(LABELLED)), f"id {t.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    return out.withColumnRenamed("id", id_col)
