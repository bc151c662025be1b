"""Benchmark decontamination: a prefix-filtered set join with positional bounds.

An item's words give windows of ``width`` consecutive words (an item of fewer words is one
window). Containment of a whole window needs every one of its words, so one necessary word is
enough for the prefix: the one that is rarest over all documents. Document words are joined
with these prefix words; the word's place in the window fixes where the window would start,
which must lie inside the document (positional and length bounds); the document's words there
are then compared one by one with the window (exact verification). What meets a prefix word
goes to its document by the document's hash, a group that the document's length bounds.

Windows are joined in blocks of at most ``BLOCK`` so that what is broadcast has a fixed bound;
more windows mean more scans.

Edge cases: null text has no words; an item without words has no window; equal windows of
several items count for each; repeated rows of documents give repeated results; null ids are
kept; empty tables give no rows, or rows without hits. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, unused

WIDTH = 10
BLOCK = 1_000_000
#: Everything but digits, letters and non-ASCII characters.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words as they stand in the text; case is dealt with where words are compared."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK), lambda w: w != "")


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """window (lower-cased words), items (ids as strings): distinct windows of all items."""
    words = items.select(F.col("item_id").cast("string").alias("item"), words_of(ascii_lower(F.col("text"))).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    each = words.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), width).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items"))


def with_prefix(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds key, at: the rarest word over all documents and its place in the window."""
    places = windows.select("window", F.posexplode("window").alias("at", "word")).withColumn("key", F.lower("word"))
    vocabulary = places.select("key").distinct()
    said = docs.select(F.explode(words_of(F.col("text"))).alias("word")).select(F.lower("word").alias("key"))
    counts = reduce(DataFrame.unionByName, [said.join(F.broadcast(block), "key").groupBy("key").count() for block in _blocks(vocabulary, "key")])
    rank = Window.partitionBy("window").orderBy(F.coalesce("count", F.lit(0)), "at")
    rarest = places.join(counts, "key", "left").withColumn("rank", F.row_number().over(rank)).where("rank = 1")
    return windows.join(rarest.select("window", "key", "at"), "window")


def _blocks(df: DataFrame, key: str) -> list[DataFrame]:
    n = -(-df.count() // BLOCK) or 1
    return [df] if n == 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def _checked(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """__leak_key, __leak_hits, __leak_items: one row for each distinct row of docs with any hit.

    Written once: a filter on the result must not be carried into the word by word comparison,
    where the optimizer would split the text again for each candidate."""
    windows = cut(with_prefix(cut(item_windows(items, width), "leaks-windows"), docs), "leaks-prefixes")
    rows = docs.select(F.col("text").alias("__text"), _row_key().alias("__leak_key"))
    # only the row's key goes along with each word: what is carried is copied for each of them
    each = rows.select("__leak_key", F.posexplode(words_of(F.col("__text"))).alias("pos", "word"))
    start = F.col("pos") - F.col("at")
    met = [each.join(F.broadcast(block), F.lower("word") == block["key"]).where(start >= 0).select("__leak_key", F.struct(start.alias("start"), "window", "items").alias("__met")) for block in _blocks(windows, "window")]
    met = reduce(DataFrame.unionByName, met).groupBy("__leak_key").agg(F.collect_set("__met").alias("__met"))
    rows = rows.join(met, "__leak_key").select("__leak_key", words_of(F.col("__text")).alias("__words"), "__met")

    def fits(m):
        there = F.slice("__words", m["start"] + 1, F.size(m["window"]))
        return (m["start"] + F.size(m["window"]) <= F.size("__words")) & (F.transform(there, ascii_lower) == m["window"])

    rows = cut(rows.select("__leak_key", F.filter("__met", fits).alias("__met")), "leaks-checked")
    hits = F.array_distinct(F.transform("__met", lambda m: F.struct(m["start"].alias("start"), F.size(m["window"]).alias("length"))))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform("__met", lambda m: m["items"]))))
    return rows.where(F.size("__met") > 0).select("__leak_key", hits.alias("__leak_hits"), found.alias("__leak_items")).dropDuplicates(["__leak_key"])


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def find_leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs, n_words, hits (array of start, length), items (array of ids as strings): one row
    for each row of docs. A kept column with the name of one of these three is left out."""
    keep = [k for k in keep if k not in ("n_words", "hits", "items")]
    found = _checked(docs, items, width)
    rows = docs.select(*keep, F.size(words_of(F.col("text"))).alias("n_words"), _row_key().alias("__leak_key")).join(found, "__leak_key", "left")
    none = lambda col, like: F.coalesce(col, F.array().cast(like))
    return rows.select(*keep, "n_words", none(F.col("__leak_hits"), "array<struct<start:int,length:int>>").alias("hits"), none(F.col("__leak_items"), "array<string>").alias("items"))


def without_leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no window of any item."""
    key = unused(docs, "__leak_key")
    hit = _checked(docs, items, width).select(F.col("__leak_key").alias(key))
    return docs.withColumn(key, _row_key()).join(hit, key, "left_anti").select(*docs.columns)


def n_hit_words(hits: Column) -> Column:
    covered = F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))
    return F.size(F.array_distinct(F.flatten(covered)))
