"""Benchmark decontamination with a distributed positional inverted index.

The index holds a posting (term, document, position) for every occurrence in
the training texts of a term of the benchmark's vocabulary. It is sharded by
document: each input partition writes its own postings, sorted by term, so
building it moves no posting between machines, and a term's list is read by
pruning on the sorted column.

A phrase is looked up from its rarest terms. The postings of its rarest term,
shifted by the term's offset in the phrase, are the candidate starts; they are
intersected with the shifted postings of the next rarest term, and what is
left with all other terms at once. A proximity search intersects the same way
but lets each term stray by ``slop`` positions.

Documents are keyed by (doc_id, checksum of the text), so repeated ids are
told apart and repeated rows share one result. Only DataFrame functions are
used; no table is broadcast by hint.

Defined cases: a null text has no words; items without words have no windows;
an item shorter than a window is one window; null ids are an id of their own
(a null item_id is listed as the empty string); an empty benchmark leaves every
document clean; other columns are ignored or, in the filter, passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop_written, written

#: Words are maximal runs of lower-case a-z, digits and everything outside ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.array_remove(parts, "")


def _doc_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(
        "_t", (F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")) - F.lit(1 << 31)).cast("int"))


def windows_of(items: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (wid, words) of the items, and which item has
    which (wid, item_id)."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    w = w.select("item_id", F.explode(F.expr(
        f"transform(sequence(0, greatest(size(w) - {n}, 0)), s -> slice(w, s + 1, {n}))")).alias("words")).distinct()
    seen = w.select("words").distinct().withColumn("wid", F.monotonically_increasing_id())
    windows = written(seen.select("wid", "words"), "windows")
    return windows, written(w.join(windows, "words").select("wid", "item_id"), "window-items")


def vocabulary(windows: DataFrame) -> DataFrame:
    """(word, term): the windows' distinct words, numbered."""
    terms = windows.select(F.explode("words").alias("word")).distinct()
    return written(terms.select("word", F.monotonically_increasing_id().alias("term")), "terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, _k, _t, pos) of all of ``docs``, written sorted by term
    within each input partition."""
    tokens = _doc_key(docs.select("doc_id", "text")).select("_k", "_t", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    postings = tokens.join(terms, "word").select("term", "_k", "_t", "pos")
    return written(postings.sortWithinPartitions("term", "_k", "pos"), "postings")


def _plan(windows: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """(wid, n, rank, term, off): each window's terms, the rarest first. A
    window with a term that no document has can't occur and is left out."""
    freq = index.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    parts = windows.select("wid", F.size("words").alias("n"), F.posexplode("words").alias("off", "word"))
    parts = parts.join(terms, "word").join(written(freq, "frequencies"), "term", "left")
    ranked = (parts.groupBy("wid", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "off", "term"))).alias("p"))
              .filter(~F.exists("p", lambda x: x["freq"].isNull())))
    return written(ranked.select("wid", "n", F.posexplode("p").alias("rank", "p"))
                   .select("wid", "n", "rank", "p.term", "p.off"), "window-terms")


def exact_matches(index: DataFrame, windows: DataFrame, terms: DataFrame) -> DataFrame:
    """(wid, n, _k, _t, start): every place where a window's words stand in
    a document one after the other."""
    plan = _plan(windows, terms, index)
    # small tables of their own, so that the planner sees their size
    rarest = written(plan.filter("rank = 0").select("wid", "n", "term", "off"), "rarest")
    second = written(plan.filter("rank = 1").select("wid", "term", "off"), "second")
    second_terms = written(second.select("term").distinct(), "second-terms")
    place = (F.col("start") + F.col("off")).alias("pos")
    found = index.join(rarest, "term").select("wid", "n", "_k", "_t", (F.col("pos") - F.col("off")).alias("start"))
    found = found.filter("start >= 0")
    # the second rarest term's list, shifted, must hold the same start
    lists = index.join(second_terms, "term", "left_semi")
    kept = (found.filter("n > 1").join(second, "wid").select("wid", "n", "_k", "_t", "start", "term", place)
            .join(lists, ["term", "_k", "_t", "pos"], "left_semi").select("wid", "n", "_k", "_t", "start"))
    kept = written(found.filter("n = 1").unionByName(kept).distinct(), "candidates")
    rest = plan.filter("rank > 1").select("wid", "term", "off")
    asked = kept.filter("n > 2").join(rest, "wid").select("wid", "n", "_k", "_t", "start", "term", place)
    docs = written(kept.filter("n > 2").select("_k", "_t").distinct(), "candidate-docs")
    lists = index.join(docs, ["_k", "_t"], "left_semi")
    whole = (asked.join(lists, ["term", "_k", "_t", "pos"], "left_semi").groupBy("wid", "n", "_k", "_t", "start")
             .agg(F.count(F.lit(1)).alias("got")).filter("got = n - 2").drop("got"))
    return written(kept.filter("n <= 2").unionByName(whole), "matches")


def proximity_matches(index: DataFrame, windows: DataFrame, terms: DataFrame, slop: int = 3) -> DataFrame:
    """(wid, n, _k, _t, start): starts, given by the rarest term, from which
    every term of the window stands within ``slop`` positions of its place."""
    plan = _plan(windows, terms, index)
    width = 2 * slop + 1
    found = index.join(plan.filter("rank = 0").select("wid", "n", "term", "off"), "term").select(
        "wid", "n", "_k", "_t", (F.col("pos") - F.col("off")).alias("start"))
    asked = (found.join(plan.filter("rank > 0").select("wid", "rank", "term", "off"), "wid")
             .withColumn("goal", F.col("start") + F.col("off"))
             .withColumn("cell", F.explode(F.expr(f"array_distinct(array(floor((goal - {slop}) / {width}), "
                                                  f"floor((goal + {slop}) / {width})))"))))
    lists = index.select("term", "_k", "_t", "pos", F.floor(F.col("pos") / width).alias("cell"))
    near = asked.join(lists, ["term", "_k", "_t", "cell"]).filter(F.abs(F.col("pos") - F.col("goal")) <= slop)
    whole = (near.select("wid", "n", "_k", "_t", "start", "rank").distinct().groupBy("wid", "n", "_k", "_t", "start")
             .agg(F.count(F.lit(1)).alias("got")).filter("got = n - 1").drop("got"))
    return whole.unionByName(found.filter("n = 1").distinct())


def document_hits(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """(_k, _t, n_hit, items) for the documents with a window in them."""
    windows, owners = windows_of(items, n)
    terms = vocabulary(windows)
    index = build_index(docs, terms)
    matches = exact_matches(index, windows, terms)
    spots = (matches.select("_k", "_t", "start", "n").distinct()
             .select("_k", "_t", F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos")).distinct()
             .groupBy("_k", "_t").agg(F.count(F.lit(1)).alias("n_hit")))
    named = (matches.select("_k", "_t", "wid").distinct().join(owners, "wid").select("_k", "_t", "item_id").distinct()
             .groupBy("_k", "_t").agg(F.sort_array(F.collect_list(F.coalesce("item_id", F.lit("")))).alias("items")))
    hits = written(spots.join(named, ["_k", "_t"]), "document-hits")
    drop_written(index)  # as large as all other tables together
    return hits


def contamination(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """One row per row of ``docs``: its words, how many a benchmark window
    covers, and the items whose windows occur."""
    hits = document_hits(docs, items, n)
    rows = _doc_key(docs.select("doc_id", "text")).select("doc_id", "_k", "_t", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(hits, ["_k", "_t"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(listed, ","), "UTF-8"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window."""
    hits = document_hits(docs, items, n).select("_k", "_t")
    rows = _doc_key(docs.select("doc_id", "text", F.struct("*").alias("_row")))
    return rows.join(hits, ["_k", "_t"], "left_anti").select("_row.*")
