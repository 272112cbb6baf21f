"""Benchmark decontamination by a positional inverted index of the training text.

Test items are cut into windows of ``window`` consecutive words (an item of
fewer words is one window). The index is a stored table of postings (term,
document, position) of the training words that any window has; other words can
take part in no match. The rarest term of each window gives the places where the
window could begin; the lists of the next rarest, shifted by their offsets, are
intersected with them, and what is left is intersected with the lists of all the
window's terms in the documents that are left. ``slop`` lets every term stand
that many words away from its place: proximity matches.

Everything is DataFrame functions, and the texts are read once. Lists are joined
on (term, document, position), so a frequent term or a large document is spread;
nothing is gathered but a document's matched items. What is broadcast is counted
first. Terms are 64-bit hashes of the windows' words.

Null texts have no words. Rows that repeat an id are told apart by their texts;
null ids take part. Items without words match nothing, as do all if none is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plan_alloc.llm.common import keep, lower_ascii, small

#: Fixed value: what words are not made of.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAREST = 3  # terms of a window that are looked up one after another
DOC = ["id", "copy"]


def _cut(text: Column) -> Column:
    """Lower-cased (A-Z) words; the first and the last part may be empty."""
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN)


def windows_of(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """item, words, phrase (a hash of the words): the different windows of every item."""
    cut = items.select(F.col(id_col).cast("string").alias("item"), F.filter(_cut(F.col(text_col)), lambda w: w != "").alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    each = cut.select("item", F.explode(F.transform(starts, lambda s: F.slice("all", s + 1, window))).alias("words"))
    return each.select("item", "words", F.xxhash64("words").alias("phrase")).distinct()


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Store the postings (id, copy, at, term) of the words in ``vocabulary``
    (word, term); a row without a term for each document holds its word count."""
    cut = docs.select(*DOC, _cut(F.col("text")).alias("cut"))
    cut = cut.select(*DOC, (F.col("cut")[0] == "").cast("int").alias("lead"), (F.element_at("cut", -1) == "").cast("int").alias("tail"), F.concat("cut", F.array(F.lit(None).cast("string"))).alias("cut"))
    each = cut.select(*DOC, "lead", "tail", F.posexplode("cut").alias("at", "word"))
    found = each.join(small(vocabulary), "word", "left").where("term is not null or word is null")
    at = F.when(F.col("word").isNull(), F.greatest(F.col("at") - F.col("lead") - F.col("tail"), F.lit(0))).otherwise(F.col("at") - F.col("lead"))
    return keep(found.select(*DOC, at.alias("at"), "term"), "postings")


def _spread(at: str, slop: int) -> Column:
    """The places within ``slop`` words of a place."""
    return F.explode(F.sequence(F.col(at) - slop, F.col(at) + slop))


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["copy"] == b["copy"])


def intersect(terms: DataFrame, postings: DataFrame, slop: int = 0) -> DataFrame:
    """phrase, id, copy, start: where windows occur.

    ``terms``: phrase, offset, term of every window."""
    postings = postings.where("term is not null")
    counts = keep(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term_counts")
    ranked = terms.join(small(counts), "term", "left").groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("all"))
    # A window with a term that no document has can't occur; a repeated term is looked up once.
    ranked = ranked.where(F.col("all")[0]["n"] > 0)
    once = F.filter("all", lambda x, i: ~F.exists(F.slice("all", 1, i), lambda y: y["term"] == x["term"]))
    asked = keep(ranked.select("phrase", F.posexplode(F.slice(once, 1, RAREST)).alias("rank", "t")).select("phrase", "rank", "t.offset", "t.term"), "asked_terms")
    lists = postings.join(small(asked.select("term").distinct()), "term").select("term", *DOC, "at")
    lists = keep(lists.repartitionByRange("term", "id", "copy", "at").sortWithinPartitions("term", "id", "copy", "at"), "index")
    rarest = asked.where("rank = 0").select("phrase", "offset", "term")
    found = lists.join(small(rarest), "term").select("phrase", *DOC, (F.col("at") - F.col("offset")).alias("start"))
    if slop:
        found = found.withColumn("start", _spread("start", slop)).distinct()
    found = found.where("start >= 0")
    for rank in range(1, RAREST):
        more = found.join(small(asked.where(F.col("rank") == rank).select("phrase", "offset", "term")), "phrase", "left")
        # Windows of fewer different terms have no list left to intersect with.
        through = more.where("term is null").select("phrase", *DOC, "start")
        more = more.where("term is not null").withColumn("place", F.col("start") + F.col("offset"))
        if slop:
            more = more.withColumn("place", _spread("place", slop))
        met = more.join(lists, (more["term"] == lists["term"]) & _same_doc(more, lists) & (more["place"] == lists["at"]), "left_semi")
        met = met.select("phrase", *DOC, "start")
        found = (met.distinct() if slop else met).unionAll(through)
    found = keep(found.distinct(), "candidates")
    # All terms, in the documents that are left.
    left = found.select(*DOC).distinct()
    near = postings.join(small(left), _same_doc(postings, left), "left_semi").select(*DOC, "at", "term")
    every = found.join(small(terms), "phrase").select("phrase", *DOC, "start", "offset", "term", (F.col("start") + F.col("offset")).alias("place"))
    if slop:
        every = every.withColumn("place", _spread("place", slop))
    met = every.join(near, _same_doc(every, near) & (every["place"] == near["at"]) & (every["term"] == near["term"]), "left_semi")
    sizes = terms.groupBy("phrase").agg(F.count(F.lit(1)).alias("size"))
    counted = met.select("phrase", *DOC, "start", "offset").distinct().groupBy("phrase", *DOC, "start").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(small(sizes), "phrase").where("n = size").select("phrase", *DOC, "start", "size")


def matches(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, slop: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches (id, copy, start, size, phrase), windows (item, words, phrase) and
    documents (id, copy, n_words), one row for each row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    rows = rows.withColumn("copy", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    windows = keep(windows_of(items, id_col=item_col, text_col=item_text_col, window=window), "windows")
    placed = windows.select("phrase", "words").distinct().select("phrase", F.posexplode("words").alias("offset", "word"))
    terms = keep(placed.withColumn("term", F.xxhash64("word")), "window_terms")
    postings = build_index(rows, terms.select("word", "term").distinct())
    found = keep(intersect(terms.select("phrase", "offset", "term"), postings, slop), "matches")
    return found, windows, postings.where("term is null").select(*DOC, F.col("at").cast("long").alias("n_words"))


def judge(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **columns) -> DataFrame:
    """Per row: id, copy, n_words, n_hit, items (sorted ids as strings), contaminated.

    A word inside any occurrence of a window is hit. ``columns``: as for ``matches``."""
    found, windows, counted = matches(docs, items, id_col=id_col, **columns)
    hit = found.select(*DOC, F.explode(F.sequence("start", (F.col("start") + F.col("size") - 1).cast("int"))).alias("at")).distinct()
    hit = hit.groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_hit"))
    owned = found.select(*DOC, "phrase").distinct().join(small(windows.select("item", "phrase")), "phrase").select(*DOC, "item").distinct()
    owned = owned.groupBy(*DOC).agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = hit.join(owned, _same_doc(hit, owned)).select(hit["id"].alias("hid"), hit["copy"].alias("hcopy"), "n_hit", "items")
    out = counted.join(both, counted["id"].eqNullSafe(both["hid"]) & (counted["copy"] == both["hcopy"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "copy", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))
