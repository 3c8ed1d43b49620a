"""Benchmark decontamination over a distributed positional inverted index.

The index stores postings (term, document, position) of the training text for those terms that test windows are looked up by.
A window is ``window`` consecutive words of an item (all of a shorter item).  Terms are ranked by their count over the whole
corpus; each window is looked up by its rarest and next rarest word.  The two posting lists are shifted by the words' offsets in
the item and intersected: what is left is (document, item, shift).  Those places are then matched word by word, which gives the
exact occurrences, and proximity matches read the same index with a slack between shifts.

Everything is a DataFrame expression.  Tables made from the test set are counted before they are broadcast; above the bound the
joins shuffle on the term, where a frequent term's list is cut by skew splitting.  Candidate lists are grouped by document, so
nothing gathers the documents of a frequent passage in one task.

Defined results: a null or empty text has no words, no hits and is not contaminated; a null or wordless item matches nothing;
rows that share an id get one result each; an empty table on either side gives rows without hits, or no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_counted, cut_lineage, stored, text_key, words_of


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, iw): the words of every item that has any; ``item`` is its id with a key of its text, as ids may repeat."""
    item = F.struct(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"))
    return items.filter(F.col(id_col).isNotNull()).select(item.alias("item"), words_of(F.col(text_col)).alias("iw")).filter(F.size("iw") > 0).distinct()


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """Corpus count of each of ``terms`` (term); words are summed before anything is shuffled."""
    found = docs.select(F.explode(words_of(F.col(text_col))).alias("term")).join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of ``terms``: (term, id, tkey, pos), pos from 0."""
    return (docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tkey"), F.posexplode(words_of(F.col(text_col))).alias("pos", "term"))
            .join(terms, "term"))


def window_keys(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item, t1, o1, t2, o2): for each window of an item the offsets of its rarest two words, once per distinct pair.

    A one-word window repeats its word.  A window over the item's words holds ``window`` of them, however long the item."""
    ranked = items.select("item", F.size("iw").alias("size"), F.posexplode("iw").alias("off", "term")).join(counts, "term")
    ahead = Window.partitionBy("item").orderBy("off").rowsBetween(0, window - 1)
    rare = F.slice(F.array_sort(F.collect_list(F.struct("n", "term", "off")).over(ahead)), 1, 2)
    starts = ranked.withColumn("r", rare).filter(F.col("off") <= F.greatest(F.col("size") - window, F.lit(0)))
    return (starts.select("item", F.col("r")[0]["term"].alias("t1"), F.col("r")[0]["off"].alias("o1"),
                          F.element_at("r", -1)["term"].alias("t2"), F.element_at("r", -1)["off"].alias("o2")).distinct())


def candidate_shifts(index: DataFrame, keys: DataFrame, n_keys: int, slack: int = 0) -> DataFrame:
    """(id, tkey, item, shift): places where a window's two rarest words stand in the item's distance, or within ``slack`` of it."""
    sides = [index.join(broadcast_counted(keys.select(F.col(f"t{k}").alias("term"), "item", "o1", "o2", F.col(f"o{k}").alias("own")), n_keys), "term")
             .select("id", "tkey", "item", "o1", "o2", (F.col("pos") - F.col("own")).alias("shift"), F.lit(k).alias("list")) for k in (1, 2)]
    if slack:
        near = sides[1].select("id", "tkey", "item", "o1", "o2", F.explode(F.sequence(F.col("shift") - slack, F.col("shift") + slack)).alias("shift"), "list")
        sides[1] = near
    both = (sides[0].unionByName(sides[1]).groupBy("id", "tkey", "item", "o1", "o2", "shift")
            .agg(F.bit_or("list").alias("lists")).filter(F.col("lists") == 3))
    return both.select("id", "tkey", "item", "shift").distinct()


def build(docs: DataFrame, items: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"):
    """(item words, window keys, their count, stored index) for a corpus and a test set."""
    words = cut_lineage(item_words(items, item_col, item_text))
    vocabulary = cut_lineage(words.select(F.explode("iw").alias("term")).distinct())
    counts = term_counts(docs, broadcast_counted(vocabulary, vocabulary.count()), text_col)
    keys = cut_lineage(window_keys(words, counts, window))
    terms = cut_lineage(keys.select(F.explode(F.array("t1", "t2")).alias("term")).distinct())
    return words, keys, keys.count(), stored(postings(docs, broadcast_counted(terms, terms.count()), id_col, text_col), "postings")


def proximity_matches(docs: DataFrame, items: DataFrame, window: int = 13, slack: int = 3, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, shift): where the rarest two words of some window stand within ``slack`` words of their distance in the item."""
    _, keys, n_keys, index = build(docs, items, window, id_col, text_col, item_col, item_text)
    return candidate_shifts(index, keys, n_keys, slack).select("id", F.col("item.id").alias("item"), "shift").distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans).  rows: ``row`` (the ``carry`` columns of the input row, else all), id, tkey, n_words.  spans: id, tkey, item, start, stop: maximal runs of document
    words (positions from 0, both ends in) along one shift, each at least a window long."""
    words, keys, n_keys, index = build(docs, items, window, id_col, text_col, item_col, item_text)
    shifts = candidate_shifts(index, keys, n_keys)
    n_items, n_words = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("iw")), F.lit(0))).first()
    shifts = shifts.join(broadcast_counted(words.select("item", F.size("iw").alias("len")), n_items), "item")
    places = shifts.groupBy("id", "tkey").agg(F.collect_list(F.struct("item", "shift", "len")).alias("places")).withColumnsRenamed({"id": "pid", "tkey": "pkey"})
    texts = docs.select(F.struct(*(carry or ["*"])).alias("row"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("body"))
    met = (texts.join(places, F.col("id").eqNullSafe(F.col("pid")) & (F.col("tkey") == F.col("pkey")), "left")
           .select("row", "id", "tkey", "places", words_of(F.col("body")).alias("words")))
    cut = F.transform("places", lambda p: F.struct(p["item"].alias("item"), p["shift"].alias("shift"),
                                                   F.slice("words", F.greatest(p["shift"], F.lit(0)) + 1, p["len"] + F.least(p["shift"], F.lit(0))).alias("dw")))
    rows = stored(met.select("row", "id", "tkey", F.size("words").cast("long").alias("n_words"), cut.alias("cut")), "places")
    at = F.greatest(-F.col("shift"), F.lit(0))
    placed = (rows.select("id", "tkey", F.explode("cut").alias("c")).select("id", "tkey", "c.*").distinct()
              .join(broadcast_counted(words, n_items, n_words), "item"))
    same = F.zip_with("dw", F.slice("iw", at + 1, F.size("iw")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    equal = (placed.select("id", "tkey", "item", "shift", F.least(F.size("iw"), F.lit(window)).alias("least"), at.alias("at"), F.posexplode(same).alias("k", "hit"))
             .filter("hit").select("id", "tkey", "item", "shift", "least", (F.col("k") + F.col("at")).alias("off")))
    w = Window.partitionBy("id", "tkey", "item", "shift").orderBy("off")
    spans = (equal.withColumn("run", F.col("off") - F.row_number().over(w)).groupBy("id", "tkey", "item", "shift", "run")
             .agg(F.min("off").alias("a"), F.max("off").alias("b"), F.first("least").alias("least"))
             .filter(F.col("b") - F.col("a") + 1 >= F.col("least"))
             .select("id", "tkey", "item", (F.col("a") + F.col("shift")).alias("start"), (F.col("b") + F.col("shift")).alias("stop")))
    return rows.drop("cut"), spans


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns: row (the input row, or its ``carry`` columns), n_words, n_hit, n_items, items (ids as sorted strings), contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    rows, spans = phrase_matches(docs, items, window, id_col, text_col, item_col, item_text, carry)
    by_doc = (spans.groupBy("id", "tkey").agg(F.array_sort(F.collect_set(F.col("item.id").cast("string"))).alias("items"),
                                              F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
              .withColumnsRenamed({"id": "sid", "tkey": "skey"}))
    covered = F.aggregate("spans", F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n")),
                          lambda a, s: F.struct(F.greatest(a["end"], s["stop"]).alias("end"),
                                                (a["n"] + F.greatest(s["stop"] - F.greatest(s["start"] - 1, a["end"]), F.lit(0))).alias("n")),
                          lambda a: a["n"])
    n_hit = F.coalesce(covered, F.lit(0)).cast("long")
    return (rows.join(by_doc, F.col("id").eqNullSafe(F.col("sid")) & (F.col("tkey") == F.col("skey")), "left")
            .select("row", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
            .select("row", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
                    ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")))
