"""Benchmark decontamination with DataFrame functions only.

Test items become word windows. Their distinct strings are the hash set: it is broadcast
when its measured size is within `broadcast_bytes`, and shuffled otherwise. A document's
windows are scanned row by row: a signature of three of a window's words is looked up
first where the set is small enough to be written into the plan, and only windows that
pass become strings, which the join verifies in full. One aggregation by row follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headmint.llm.common import shared_dir, stored

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # fixed: what isn't in a word, once A-Z are lower
PIECES = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIGNATURES = 100_000  # that are written into the plan
BROADCAST_BYTES = 64 << 20


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def lower_az(text: Column) -> Column:
    """A-Z in lower case, nothing else; texts of ASCII alone take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of a text in lower case; none for null."""
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def signature(w: Column, i: Column, size: int) -> Column:
    return F.xxhash64(F.get(w, i), F.get(w, i + size // 2), F.get(w, i + size - 1))


def positions(w: Column, size: int) -> Column:
    return F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))


def string(w: Column, i: Column, size: int) -> Column:
    return F.array_join(F.slice(w, i + 1, size), " ")


def item_windows(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, size, sig, gram): a window of `size` words each, or the whole of a shorter item."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    full = w.filter(F.size("w") >= size).select("item_id", F.lit(size).alias("size"), "w", F.explode(positions(F.col("w"), size)).alias("i"))
    full = full.select("item_id", "size", signature(F.col("w"), F.col("i"), size).alias("sig"), string(F.col("w"), F.col("i"), size).alias("gram"))
    n = F.size("w")
    short = w.filter(n < size).select("item_id", n.alias("size"), F.xxhash64(F.get("w", F.lit(0)), F.get("w", (n / 2).cast("int")), F.get("w", n - 1)).alias("sig"), F.array_join("w", " ").alias("gram"))
    return full.unionByName(short).distinct()


def _candidates(w: Column, size: int, sigs: list[int] | None) -> Column:
    at = positions(w, size)
    if sigs is not None:
        at = F.filter(at, lambda i: signature(w, i, size).isin(sigs))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(size).alias("size"), string(w, i, size).alias("gram")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted ids as strings), hit (word numbers
    from 0), row_key (a hash of id and text).

    A-Z are lower-cased; words are runs of 0-9, a-z and what lies beyond ASCII. A window is
    `size` consecutive words of an item; an item of fewer words, but not none, is one window.
    Words inside any occurrence of a window are hit. Null and empty texts, of documents or
    items, have no words. Items with a null id count for hits and are not listed. Repeated
    rows are judged each by itself. Other columns are ignored.
    """
    grams = item_windows(benchmark, size, item_col, item_text_col)
    by_gram = grams.groupBy("gram", "size").agg(F.collect_set("item_id").alias("item_ids"))
    extent = grams.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("gram") + F.octet_length("item_id") + 64).alias("bytes")).collect()
    total, n = sum(r["bytes"] or 0 for r in extent), sum(r["n"] for r in extent)
    if total <= broadcast_bytes:
        by_gram = F.broadcast(by_gram)
    sigs: dict[int, list[int] | None] = {r["size"]: None for r in extent}
    if n <= SIGNATURES:
        for r in grams.select("size", "sig").distinct().collect():
            sigs[r["size"]] = [*(sigs[r["size"]] or []), r["sig"]]
    found = lambda w: F.concat(*(_candidates(w, k, v) for k, v in sorted(sigs.items()))) if sigs else F.array().cast("array<struct<pos:int,size:int,gram:string>>")
    scan = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_key"), words(F.col(text_col)).alias("w"))
    scan = scan.select("row", "id", "row_key", let(F.col("w"), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), found(w).alias("c"))).alias("s"))
    rows = scan.select("row", "id", "row_key", F.col("s.n_words").alias("n_words"), F.explode_outer("s.c").alias("c")).select("row", "id", "row_key", "n_words", "c.*")
    rows = stored(rows, f"{shared_dir(docs.sparkSession)}/candidates")  # a row's number stays what it is, whatever is run again
    met = rows.join(by_gram.withColumnRenamed("size", "of_size").withColumnRenamed("gram", "of_gram"), (F.col("gram") == F.col("of_gram")) & (F.col("size") == F.col("of_size")), "left")
    hit = F.when(F.col("of_gram").isNotNull(), F.struct("pos", "size"))
    by_row = met.groupBy("row").agg(F.first("id").alias("id"), F.first("row_key").alias("row_key"), F.first("n_words").alias("n_words"), F.collect_set(hit).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["pos"], h["pos"] + h["size"] - 1)))))
    out = by_row.select(F.col("id").alias(id_col), "n_words", "items", covered.alias("hit"), "row_key")
    return out.withColumn("n_hit", F.size("hit").cast("bigint"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: str = "documents", **names) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words, and what
    separates them from the next word, cut out of their texts. Columns stay as they are."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    found = contamination(docs, benchmark, id_col, text_col, **names).filter("n_hit > 0").select(F.col("row_key").alias("hit_key"), F.col("hit").alias("hit_words")).dropDuplicates(["hit_key"])
    key = F.xxhash64(docs[id_col], docs[text_col])  # rows of equal id and text are judged alike
    if remove == "documents":
        return docs.join(found, key == found["hit_key"], "left_anti")
    met = docs.join(found, key == found["hit_key"], "left")
    pieces = F.regexp_extract_all(docs[text_col], F.lit(f"({PIECES})"), F.lit(1))
    lead = F.regexp_extract(docs[text_col], "^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*", 0)
    cut = F.concat(lead, F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains(found["hit_words"], i)), ""))
    return met.select(*(F.when(found["hit_key"].isNotNull(), cut).otherwise(docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns))
