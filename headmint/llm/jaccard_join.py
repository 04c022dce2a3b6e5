"""N-gram Jaccard join: which documents reach a Jaccard similarity of their shingle sets.

The join is exact up to hashes: texts are told apart by 128 bits, shingles by 64, so that only
a collision among the shingles of the two sets compared could change a link. Four steps, each
of which moves numbers in blocks:

1. Distinct texts are dealt once, by hash, to groups of about GROUP_BYTES. Copies of a text are
   dropped in the task that reads them and where they meet, so they don't gather.
2. Shared shingles. A group sends its distinct shingles, cut by hash range, with the number of
   its sets that hold each; nothing else, so a shingle costs the same however many ranges there
   are, and one that all sets share arrives once a group. The range answers in the same order
   with document frequencies. A set that links to another shares ceil(threshold * size)
   shingles with it, so one with more unshared ones than the rest leaves. First half the hash
   space is asked for all sets, which is enough to see nearly all of them leave; then all of it
   for those that stay. By rising frequency, the first size - ceil(threshold * size) + 1
   shingles of a set form its prefix, and sets that link have a prefix shingle in common.
3. Neighbourhoods. Sets of a prefix shingle's list are linked to the first of their size
   class, and classes next to each other by their firsts (a list of n gives fewer than 2 n
   edges, not n * n pairs, and no list is gathered); connected components hold all links.
4. T-occurrence search (DivideSkip) over the inverted lists of a neighbourhood: the longest
   lists are set aside, the short ones are heap-merged, sets seen often enough are probed for
   in the long lists by binary search. Every set that no earlier search found is searched
   for, then those outside the largest component; two sets that are in one component already
   need no comparison, so thousands of near copies cost few searches.
   A neighbourhood of more than BLOCK_SETS sets is cut into blocks, one task each. One set for
   each component of a block goes on to meet those of other blocks, until that joins no more;
   then sets outside the largest component search the other blocks that hold one of their
   prefix shingles.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import partial
from itertools import count, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headmint.llm.common import lower_ascii, mix, pack_varints, parts, runs, shared_dir, split_words, stored, text_slices, unpack_varints, windows
from headmint.llm.components import components

GROUP_BYTES = 6 << 20  # distinct text of a group
RANGE_BYTES = 12 << 20  # text whose shingles one reducer gets
BLOCK_SETS = 256  # sets of a block of a neighbourhood
BLOCK_SHINGLES = 4_000_000  # and their shingles
PROBE_WEIGHT = 0.004  # DivideSkip: what a probe costs against a step of the merge
PROBE_LISTS = 24  # long lists probed at once, before candidates are dropped
SEEN_TEXTS = 1_000_000  # hashes of texts by which a task knows copies, before it starts anew
NODE_BITS = 28  # of a set's number within its group
BROADCAST_BYTES = 64 << 20  # of ids to drop, at KEY_BYTES each; more of them meet the texts by a shuffle
KEY_BYTES = 24  # an id, with what a hash table adds


def need(size: int | np.ndarray, num: int, den: int):
    """Least intersection of a set of this size with any set that it links to."""
    return -(-num * size // den)


def linked(common: int, a: int, b: int, num: int, den: int) -> bool:
    return den * common >= num * (a + b - common)


# ------------------------------------------------------------------ shingles


def slice_sets(buf: np.ndarray, off: np.ndarray, words_per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle) sorted and distinct, and of each row its set size."""
    n = len(off) - 1
    w = split_words(lower_ascii(buf), off)
    first, sh = windows(w, n, words_per)
    row = w.row[first]
    count = np.bincount(w.row, minlength=n)
    few = np.flatnonzero((count > 0) & (count < words_per))
    if len(few):  # the whole sequence is the one shingle
        at = np.searchsorted(w.row, few)
        h = np.array([_fold(w.hash[a : a + c]) for a, c in zip(at, count[few], strict=True)], np.uint64)
        row, sh = np.concatenate([row, few]), np.concatenate([sh, mix(h)])
    order = np.lexsort((sh, row))
    row, sh = row[order], sh[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    row, sh = row[new], sh[new]
    return row, sh, np.bincount(row, minlength=n)


def _fold(h: np.ndarray) -> np.uint64:
    out = len(h)
    for x in h.tolist():
        out = (out * 0xD6E8FEB86659FD93 + x) & (2**64 - 1)
    return np.uint64(out)


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, text) without texts that the task has already passed on."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        keep = []
        for i, k in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            if k not in seen:
                seen.add(k)
                keep.append(i)
        if len(seen) > SEEN_TEXTS:
            seen.clear()
        yield b if len(keep) == b.num_rows else b.take(pa.array(keep, pa.int64()))


def distinct_texts(text: DataFrame, groups: int) -> DataFrame:
    """(part, k1, k2, text): one row a text, dealt to groups by hash. text: (k1, k2, text)."""
    first = text.mapInArrow(_first_copies, "k1 bigint, k2 bigint, text string")
    dealt = first.withColumn("part", F.pmod("k1", F.lit(groups)).cast("int")).repartition("part")
    return dealt.groupBy("part", "k1", "k2").agg(F.first("text").alias("text"))


Group = tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]


def sets_of_texts(t: pa.Table, words_per: int) -> Group:
    """A group in order of its keys; (row, shingle), sorted and distinct, and the sets' sizes."""
    t = t.sort_by([("k1", "ascending"), ("k2", "ascending")])
    rows, shingles, sizes = [], [], []
    for lo, _, buf, off in text_slices(t.column("text")):
        row, sh, size = slice_sets(buf, off, words_per)
        rows.append(lo + row)
        shingles.append(sh)
        sizes.append(size)
    join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
    return t, join(rows, np.int64), join(shingles, np.uint64), join(sizes, np.int64)


def sets_that_stay(t: pa.Table) -> Group:
    """The same of a group of sets that bring their shingles along."""
    t = t.sort_by("set_key")
    sh = _unpack(t.column("shingles").to_pylist())
    return t, np.repeat(np.arange(len(sh)), [len(x) for x in sh]), np.concatenate([np.zeros(0, np.uint64), *sh]), t.column("n").to_numpy().astype(np.int64)


def in_half(sh: np.ndarray) -> np.ndarray:
    return sh < np.uint64(1 << 63)


def _by_range(distinct: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct shingles by hash range, and where each range begins."""
    to = ((distinct >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(ranges + 1))


def _held(read: Callable[[pa.Table], Group], ranges: int, half: bool):
    """Distinct shingles of a group by hash range, with the number of its sets that hold each."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        sh = read(t)[2]
        sh, sets = np.unique(sh[in_half(sh)] if half else sh, return_counts=True)
        order, cut = _by_range(sh, ranges)
        sh, sets = sh[order], sets[order]
        data, ends = pack_varints(sets)
        at = np.concatenate([[0], ends])[cut]
        has = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
        return pa.table(
            {
                "range": pa.array(has, pa.int32()),
                "part": pa.array([key[0].as_py()] * len(has), pa.int32()),
                "shingles": pa.array([sh[cut[r] : cut[r + 1]].tobytes() for r in has], pa.binary()),
                "sets": pa.array([data[at[r] : at[r + 1]].tobytes() for r in has], pa.binary()),
            }
        )

    return run


HELD_SCHEMA = "range int, part int, shingles binary, sets binary"
ANSWER_SCHEMA = "part int, range int, df binary"
ALL_SCHEMA = "part int, set_key bigint, k1 bigint, k2 bigint, n int, shingles binary"
SET_SCHEMA = "set_key bigint, n int, shingles binary, prefix binary"


def _frequencies(t: pa.Table) -> pa.Table:
    """Reducer of a hash range: of each shingle in how many sets it is, in the order it came in."""
    sh = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
    sets = np.concatenate([unpack_varints(x) for x in t.column("sets").to_pylist()]).astype(np.int64)
    ends = np.cumsum([0, *map(len, sh)])
    order = np.argsort(np.concatenate(sh), kind="stable")
    start, end = runs(np.concatenate(sh)[order])
    df = np.empty(len(order), np.int64)
    df[order] = np.repeat(np.add.reduceat(sets[order], start), end - start)
    data, at = pack_varints(df)
    at = np.concatenate([[0], at])[ends]
    return pa.table({"part": t.column("part"), "range": t.column("range"), "df": pa.array([data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())})


def _answered(sh: np.ndarray, answers: pa.Table, ranges: int) -> np.ndarray:
    """Document frequencies of a group's shingles, in any order, from the answers to _held."""
    distinct, at = np.unique(sh, return_inverse=True)
    order, cut = _by_range(distinct, ranges)
    df = np.zeros(len(distinct), np.int64)
    for r, x in zip(answers.column("range").to_pylist(), answers.column("df").to_pylist(), strict=True):
        df[order[cut[r] : cut[r + 1]]] = unpack_varints(x)
    return df[at]


def _pieces(x: np.ndarray, count: np.ndarray, good: np.ndarray, most: np.ndarray | None = None) -> pa.Array:
    """The runs of x of these lengths as bytes (most: of at most so many numbers each); null where not good."""
    begin = np.cumsum(count) - count
    size = count if most is None else np.minimum(count, most)
    return pa.array([x[a : a + n].tobytes() if g else None for a, n, g in zip(begin.tolist(), size.tolist(), good.tolist(), strict=True)], pa.binary())


def _after_half(read: Callable[[pa.Table], Group], ranges: int, num: int, den: int):
    """All sets of a group; the shingles of those whose unshared ones leave room for a link."""

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py() if t.num_rows else 0
        t, row, sh, size = read(t)
        m = in_half(sh)
        alone = np.bincount(row[m][_answered(sh[m], answers, ranges) == 1], minlength=len(size))
        stays = (size > 0) & (alone <= size - need(size, num, den))
        return pa.table(
            {
                "part": pa.array(np.full(len(size), part), pa.int32()),
                "set_key": pa.array((part << NODE_BITS) + np.arange(len(size))),
                "k1": t.column("k1"),
                "k2": t.column("k2"),
                "n": pa.array(size, pa.int32()),
                "shingles": _pieces(sh, size, stays),
            }
        )

    return run


def _shared(ranges: int, num: int, den: int):
    """Sets of a group that share enough with others that stay: their shared shingles and their prefix."""

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        t, row, sh, size = sets_that_stay(t)
        df = _answered(sh, answers, ranges)
        m = df > 1
        row, sh, df = row[m], sh[m], df[m]
        live = np.bincount(row, minlength=len(size))
        good = live >= need(size, num, den)
        rare = sh[np.lexsort((sh, df, row))]
        prefix = np.maximum(size - need(size, num, den) + 1 - (size - live), 0)
        out = pa.table({"set_key": t.column("set_key"), "n": t.column("n"), "shingles": _pieces(sh, live, good), "prefix": _pieces(rare, live, good, prefix)})
        return out.filter(pa.array(good))

    return run


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.column(1).to_numpy()
        sh = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
        at = np.repeat(np.arange(len(sh)), [len(x) for x in sh])
        if len(at):
            yield pa.record_batch({"shingle": pa.array(np.concatenate(sh)), "set_key": pa.array(b.column(0).to_numpy()[at]), "n": pa.array(n[at])})


# ------------------------------------------------------------------ T-occurrence search


class InvertedLists:
    """Inverted lists over sets numbered 0, 1, ...: sorted set numbers for each shingle."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes
        sh = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(sh, kind="stable")
        sh, self.at = sh[order], at[order]
        self.start, self.end = runs(sh)
        self.shingle = sh[self.start]
        self.n = len(sets)
        # list number and set number as one ascending key: all lists are probed by one binary search
        self.key = np.repeat(np.arange(len(self.start)), self.end - self.start) * self.n + self.at

    def lists(self, query: np.ndarray) -> np.ndarray:
        """Numbers of the query's lists, shortest first."""
        k = np.searchsorted(self.shingle, query)
        k = np.minimum(k, max(len(self.shingle) - 1, 0))
        k = k[self.shingle[k] == query] if len(self.shingle) else k[:0]
        return k[np.argsort(self.end[k] - self.start[k], kind="stable")]

    def merged(self, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(set, number of lists that hold it), ascending, by a heap over the lists' fronts."""
        pairs = [(s, sum(1 for _ in hits)) for s, hits in groupby(heapq.merge(*(x.tolist() for x in lists)))]
        return np.array([s for s, _ in pairs], np.int64), np.array([c for _, c in pairs], np.int64)

    def search(self, query: np.ndarray, size: int, skip: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
        """DivideSkip: (set, overlap) of sets that link to the query; skip marks sets of no interest."""
        least = int(need(size, num, den))
        k = self.lists(query)
        if len(k) < least:
            return
        longest = int(self.end[k[-1]] - self.start[k[-1]])
        aside = min(least - 1, int(least / (PROBE_WEIGHT * np.log2(longest + 1) + 1)))
        short, long = k[: len(k) - aside], k[len(k) - aside :]
        cand, seen = self.merged([self.at[a:b] for a, b in zip(self.start[short].tolist(), self.end[short].tolist(), strict=True)])
        good = (seen >= least - aside) & ~skip[cand]
        cand, seen = cand[good], seen[good]
        if not len(cand):
            return
        for a in range(0, len(long), PROBE_LISTS):
            probe = (long[a : a + PROBE_LISTS, None] * self.n + cand).ravel()
            at = np.minimum(np.searchsorted(self.key, probe), len(self.key) - 1)
            seen = seen + (self.key[at] == probe).reshape(-1, len(cand)).sum(axis=0)
            alive = seen + max(0, len(long) - a - PROBE_LISTS) >= least  # the others can't reach the bound
            cand, seen = cand[alive], seen[alive]
            if not len(cand):
                return
        yield from ((s, c) for s, c in zip(cand.tolist(), seen.tolist(), strict=True) if linked(c, size, int(self.sizes[s]), num, den))


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)


def block_components(sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Label of each set: the smallest number that links reach within the block.

    First every set that no search has found so far searches the index for all its links. What
    was found but is outside the largest component then searches too, for sets that it isn't
    in one component with. So of any two sets that link, one has searched for the other, or
    both are in the largest component.
    """
    n = len(sets)
    u = Union(n)
    if n > 1:
        index = InvertedLists(sets, sizes)
        asked, found = np.zeros(n, bool), np.zeros(n, bool)  # what has searched needn't be found
        for i in range(n):
            if not found[i]:
                asked[i] = True
                for j, _ in index.search(sets[i], int(sizes[i]), asked, num, den):
                    u.join(i, j)
                    found[j] = True
        label = u.labels()
        for i in np.flatnonzero(~asked & (label != np.bincount(label, minlength=n).argmax())).tolist():
            asked[i] = True
            for j, _ in index.search(sets[i], int(sizes[i]), asked | (label == label[i]), num, den):
                u.join(i, j)
    return u.labels()


def _unpack(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column]


def _in_block(num: int, den: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("set_key")
        label = block_components(_unpack(p["shingles"]), p["n"].to_numpy(), num, den)
        key = p["set_key"].to_numpy()
        return pd.DataFrame({"u": key, "v": key[label]})

    return run


def _against_block(num: int, den: int):
    """Searches of sets outside the largest component in one block of their neighbourhood."""

    def run(key, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(block):
            index, comp, keys = InvertedLists(_unpack(block["shingles"]), block["n"].to_numpy()), block["component"].to_numpy(), block["set_key"].to_numpy()
            for k, n, c, sh in zip(queries["set_key"], queries["n"], queries["component"], _unpack(queries["shingles"]), strict=True):
                out += [(k, keys[j]) for j, _ in index.search(sh, int(n), comp == c, num, den)]
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return run


def _blocked(placed: DataFrame, block_sets: int, block_shingles: int) -> DataFrame:
    """(set_key, near, block): sets of a neighbourhood dealt evenly to blocks of bounded size."""
    blocks = placed.groupBy("near").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("size") / block_shingles)).cast("int").alias("n"))
    return placed.join(blocks, "near").select("set_key", "near", F.pmod(F.xxhash64("set_key"), "n").cast("int").alias("block"), "n")


def links(sets: DataFrame, folder: str, num: int, den: int, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Edges u, v (set keys) that span the same components as all links do. sets: (set_key, n, shingles, prefix)."""
    prefix = sets.select("set_key", "n", "prefix").mapInArrow(_prefix_rows, "shingle bigint, set_key bigint, n int")
    # sets of one size class meet at its smallest key, classes next to each other at theirs
    step = math.log(den / num) * (1 + 1e-9)  # sets that link are at most a class apart
    listed = prefix.withColumn("class", F.floor(F.log("n") / step).cast("int"))
    first = listed.groupBy("shingle", "class").agg(F.min("set_key").alias("v"))
    stars = listed.join(first, ["shingle", "class"]).filter("set_key <> v").select(F.col("set_key").alias("u"), "v")
    above = first.select("shingle", (F.col("class") + 1).alias("class"), F.col("v").alias("u"))
    chain = stars.unionByName(first.join(above, ["shingle", "class"]).select("u", "v"))
    near = stored(components(chain, f"{folder}/near"), f"{folder}/neighbourhoods")
    size = (F.octet_length("shingles") / 8).cast("bigint") + 16  # small sets count for their row too
    placed = sets.select("set_key", size.alias("size")).join(near.select(F.col("node").alias("set_key"), F.col("component").alias("near")), "set_key")
    cut = stored(_blocked(placed, block_sets, block_shingles), f"{folder}/blocks")
    plain = sets.drop("prefix")
    first = stored(plain.join(cut.drop("n"), "set_key").groupBy("near", "block").applyInPandas(_in_block(num, den), "u bigint, v bigint"), f"{folder}/in_block")
    out = first.filter("u <> v")
    cut = cut.filter("n > 1").drop("n")  # neighbourhoods of several blocks
    if cut.isEmpty():
        return out
    # a set for each component so far meets the others', in ever fewer blocks
    of = cut.join(first.select(F.col("u").alias("set_key"), F.col("v").alias("component")), "set_key")
    sized = placed.select(F.col("set_key").alias("component"), "size")
    known, alone = None, False
    for k in count():
        of = stored(of, f"{folder}/of{k}")
        leads = of.select("near", "component").distinct()
        n = leads.count()
        if alone or (known is not None and 2 * n > known):  # all have met, or too few were joined for another round to pay
            break
        known = n
        lead = _blocked(leads.join(sized, "component").withColumnRenamed("component", "set_key"), block_sets, block_shingles)
        met = stored(plain.join(lead.drop("n"), "set_key").groupBy("near", "block").applyInPandas(_in_block(num, den), "u bigint, v bigint").filter("u <> v"), f"{folder}/met{k}")
        out = out.unionByName(met)
        alone = lead.filter("n > 1").isEmpty()
        of = of.join(met.select(F.col("u").alias("component"), "v"), "component", "left").select("set_key", "near", "block", F.coalesce("v", "component").alias("component"))
    # what is outside the largest component searches the other blocks that hold one of its prefix shingles
    counts = of.groupBy("near", "component").count()
    top = counts.groupBy("near").agg(F.max_by("component", F.struct("count", "component")).alias("top"))
    rest = of.join(top, "near").filter("component <> top").select("set_key", F.col("near").alias("q_near"), F.col("block").alias("own"))
    asks = prefix.select("shingle", "set_key").join(rest, "set_key")
    holds = prefix.select("shingle", "set_key").join(of, "set_key").select("shingle", F.col("near").alias("q_near"), F.col("block").alias("q_block")).distinct()
    route = asks.join(holds, ["shingle", "q_near"]).filter("q_block <> own").select("set_key", "q_near", "q_block").distinct()
    route = stored(route.join(placed.select("set_key", "size"), "set_key"), f"{folder}/route")
    # many searches of one block are dealt to several tasks
    each = route.groupBy("q_near", "q_block").agg(F.ceil(F.sum("size") / block_shingles).cast("int").alias("n"))
    asked = route.join(each, ["q_near", "q_block"]).withColumn("q_deal", F.pmod(F.xxhash64("set_key", F.lit(1)), "n").cast("int")).drop("size", "n")
    asked = asked.join(of.select("set_key", "component"), "set_key").join(plain, "set_key")
    asked = asked.select(*(F.col(c).alias(c, metadata={"of": "query"}) for c in asked.columns))
    full = plain.join(of, "set_key").join(each.select(F.col("q_near").alias("near"), F.col("q_block").alias("block"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("deal")), ["near", "block"])
    cross = asked.groupBy("q_near", "q_block", "q_deal").cogroup(full.groupBy("near", "block", "deal")).applyInPandas(_against_block(num, den), "u bigint, v bigint")
    return out.unionByName(stored(cross, f"{folder}/cross"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per: int = 5, threshold: tuple[int, int] = (75, 100), block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id that links reach).

    A-Z are lower-cased; words are runs of bytes other than space and \\t to \\r. The set of
    a text with fewer than words_per words is its whole sequence. Null and empty texts have
    no shingles, link with nothing and are their own component. Rows with a null id are
    kept, take part, and never give a component its name; a component without any id has
    null. Repeated rows are kept; rows of equal id count as separate documents with
    one name. Other columns of docs are ignored. threshold is a fraction (num, den).
    """
    num, den = threshold
    spark = docs.sparkSession
    folder = shared_dir(spark)
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = text.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    wordy = F.col("text").rlike("[^ \\t-\\r]")
    named = stored(text.select("doc_id", "k1", "k2", F.octet_length("text").alias("bytes"), wordy.alias("wordy")), f"{folder}/named")
    by_text = stored(named.filter("wordy").groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.first("bytes").cast("bigint").alias("bytes")), f"{folder}/by_text")
    n = by_text.agg(F.sum("bytes")).first()[0] or 0
    groups, ranges = parts(spark, n, GROUP_BYTES), parts(spark, n, RANGE_BYTES)
    texts = distinct_texts(text.filter(wordy).select("k1", "k2", "text"), groups)
    read = partial(sets_of_texts, words_per=words_per)
    held = texts.groupBy("part").applyInArrow(_held(read, ranges, True), HELD_SCHEMA)
    answers = held.groupBy("range").applyInArrow(_frequencies, ANSWER_SCHEMA)
    sets = texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_after_half(read, ranges, num, den), ALL_SCHEMA)
    sets = stored(sets, f"{folder}/sets")
    stay = sets.filter("shingles IS NOT NULL").select("part", "set_key", "n", "shingles")
    ranges = parts(spark, 8 * (stay.agg(F.sum("n")).first()[0] or 0), RANGE_BYTES)
    held = stay.groupBy("part").applyInArrow(_held(sets_that_stay, ranges, False), HELD_SCHEMA)
    answers = held.groupBy("range").applyInArrow(_frequencies, ANSWER_SCHEMA)
    shared = stay.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_shared(ranges, num, den), SET_SCHEMA)
    comp = components(links(stored(shared, f"{folder}/shared"), folder, num, den, block_sets, block_shingles), f"{folder}/components")
    # a text's documents are linked by being equal; then texts by components
    comp = comp.select(F.col("node").alias("set_key"), "component")
    grouped = sets.drop("part", "shingles").join(comp, "set_key", "left").withColumn("component", F.coalesce("component", "set_key")).join(by_text, ["k1", "k2"])
    grouped = stored(grouped.select("k1", "k2", "n", "component", "low"), f"{folder}/grouped")
    least = stored(grouped.groupBy("component").agg(F.min("low").alias("component_id")), f"{folder}/least")  # stored, so that a hot component's rows can be split
    of_text = grouped.join(least, "component").select("k1", "k2", F.col("n").cast("bigint").alias("n_shingles"), "component_id")
    found = named.filter("wordy").join(of_text, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    blank = named.filter("NOT wordy").select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(blank).withColumnRenamed("doc_id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """docs with one document of each group of linked ones: that of the smallest id.

    Of repeated rows (equal id and text) one stays; rows of equal id and different texts
    that are first of their group both stay, as do rows with a null id."""
    found = ngram_jaccard_join(docs, id_col, text_col, **names).filter(F.col(id_col).isNotNull())
    first = F.col(id_col) == F.col("component_id")
    by_id = found.groupBy(F.col(id_col).alias("of_id")).agg(F.count_if(first).alias("firsts"))
    by_id = stored(by_id, f"{shared_dir(docs.sparkSession)}/by_id")
    gone = by_id.filter("firsts = 0").select("of_id")
    if gone.count() * KEY_BYTES <= BROADCAST_BYTES:  # then texts stay where they are
        gone = F.broadcast(gone)
    out = docs.join(gone, docs[id_col] == gone["of_id"], "left_anti")
    if by_id.filter("firsts > 1").isEmpty():
        return out
    return out.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]).unionByName(docs.filter(docs[id_col].isNull()))
