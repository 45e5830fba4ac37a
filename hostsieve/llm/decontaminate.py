"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations alone.

One pass over the corpus stores the postings (term, document, position) of every term that the benchmark has. Postings
counted per term order each benchmark window's terms from the rarest on. A posting's position less its term's offset in a
window is where the window would have to start: the rarest term's list gives the candidates, the next term's list, adjusted
by its offset, is intersected with them, and the few that are left have to stand in the lists of all other terms. A
phrase occurs where all lists agree. Proximity matches intersect the lists of terms within a distance in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostsieve.llm.common import ascii_lower, stored

#: Fixed value: what separates words, before letters are put in lower case.
SEPARATORS = r"[\x00-/:-@\[-`{-\x7F]+"
#: Rows of windows, terms or documents up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
#: The posting at a text's end, whose position is the number of words; no word holds this character.
END = "\x00"
DOC = ["doc_id", "text_key"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(benchmark: DataFrame, length: int) -> DataFrame:
    """The distinct windows: w, terms in order, size, and the items that hold it."""
    items = benchmark.select("item_id", words(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    items = items.withColumn("terms", F.transform("terms", ascii_lower)).withColumn("size", F.least(F.size("terms"), F.lit(length)))
    starts = F.explode(F.sequence(F.lit(1), F.size("terms") - F.col("size") + 1))
    cut = items.withColumn("at", starts).select("item_id", "size", F.expr("slice(terms, at, size)").alias("terms"))
    cut = cut.groupBy("terms", "size").agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("items"))
    return stored(cut.withColumn("w", F.monotonically_increasing_id()))


def build_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Stores the postings of the given terms (column term, A-Z in lower case): term, doc_id, text_key, pos from 0.

    documents: doc_id, text_key and text; each row has a posting END as well, at its number of words. Words meet terms in
    lower case as Spark has it, which is quick, and are then compared as A-Z alone asks: a term of ASCII by its length in
    bytes, which no other letter's lower case keeps, and any other term by itself.
    """
    known = terms.select("term").distinct().unionByName(terms.sparkSession.range(1).select(F.lit(END).alias("term")))
    known = known.select("term", F.lower("term").alias("low"), F.octet_length("term").alias("bytes"), F.col("term").rlike(r"^[\x00-\x7f]*$").alias("plain"))
    tokens = F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("pos", "t")
    hits = documents.select("doc_id", "text_key", tokens).join(small(known), F.lower("t") == F.col("low"))
    same = F.when(F.col("plain"), F.octet_length("t") == F.col("bytes")).otherwise(ascii_lower(F.col("t")) == F.col("term"))
    return stored(hits.where(same).select("term", "doc_id", "text_key", "pos"))


def ranked(wins: DataFrame, index: DataFrame) -> DataFrame:
    """The windows whose terms all have postings, with `lists`: their terms from the rarest on, each with its offset."""
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    placed = wins.select("w", F.posexplode("terms").alias("offset", "term")).join(counts, "term")
    lists = placed.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("lists"))  # a window's terms
    return stored(wins.join(lists, "w").where(F.size("lists") == F.col("size")).select("w", "size", "items", "lists"))


def of_terms(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of some terms."""
    return index.join(small(terms.select("term").distinct()), "term", "left_semi")


def phrase_matches(index: DataFrame, wins: DataFrame) -> DataFrame:
    """doc_id, text_key, start, w: every place where a window stands; wins as ranked() gives them."""
    nth = lambda k: wins.where(F.size("lists") > k).select("w", F.get("lists", F.lit(k))["term"].alias("term"), F.get("lists", F.lit(k))["offset"].alias("offset"))
    first = index.join(small(nth(0)), "term").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
    first = first.select(*DOC, "start", "w")
    asked = first.join(small(nth(1)), "w").withColumn("pos", F.col("start") + F.col("offset"))
    two = stored(asked.join(of_terms(index, nth(1)), [*DOC, "term", "pos"], "left_semi").select(*DOC, "start", "w"))
    rest = wins.where(F.size("lists") > 2).select("w", (F.size("lists") - 2).alias("more"), F.inline(F.expr("slice(lists, 3, size(lists))")))
    asked = two.join(small(rest.select("w", "more", "term", "offset")), "w").withColumn("pos", F.col("start") + F.col("offset"))
    held = index.join(small(two.select("doc_id").distinct()), "doc_id", "left_semi")
    asked = asked.join(held.select(*DOC, "term", "pos"), [*DOC, "term", "pos"])
    whole = asked.groupBy(*DOC, "start", "w").agg(F.max("more").alias("more"), F.count_distinct("offset").alias("found")).where("found = more")
    short = wins.select("w", "size")
    one = first.join(small(short.where("size = 1").select("w")), "w", "left_semi")
    pair = two.join(small(short.where("size = 2").select("w")), "w", "left_semi")
    return whole.select(*DOC, "start", "w").unionByName(one).unionByName(pair).distinct()


def proximity_matches(index: DataFrame, terms: list[str], distance: int) -> DataFrame:
    """doc_id, text_key, pos: postings of the rarest of the terms with all others at most `distance` words away.

    A term that has no postings leaves no match; of terms that are equally rare, the first in order of text counts.
    """
    terms = sorted(set(terms))
    counts = {r.term: r.n for r in index.where(F.col("term").isin(terms)).groupBy("term").agg(F.count("*").alias("n")).collect()}
    order = sorted(terms, key=lambda t: (counts.get(t, 0), t))
    found = index.where(F.col("term") == order[0]).select(*DOC, "pos").distinct()
    for term in order[1:]:
        near = index.where(F.col("term") == term).select(*DOC, F.col("pos").alias("other"))
        reach = found.withColumn("other", F.explode(F.expr(f"sequence(pos - {distance}, pos + {distance})")))
        found = reach.join(near, [*DOC, "other"], "left_semi").select(*DOC, "pos").distinct()
    return found


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id (the smallest long for null), text_key and text."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return documents.select(key.alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def decontaminate(documents: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of documents.

    A window is `length` consecutive words of an item, or all words of a shorter one; an item without words has none. A
    word inside any occurrence of a window is hit. Null and empty texts have no words. Each row is judged by its own
    text, also where doc_ids repeat or are null. Only doc_id and text, item_id and text are read. Null item_ids count as
    the empty string. Empty tables give no hits or no rows. Texts of any length are read whole.
    """
    wins = windows(benchmark, length)
    index = build_index(keyed(documents), wins.select(F.explode("terms").alias("term")))
    wins = ranked(wins, index)
    hits = stored(phrase_matches(index, wins).join(small(wins.select("w", "size", "items")), "w"))
    at = F.explode(F.expr("sequence(start, start + size - 1)")).alias("pos")
    hit_words = hits.select(*DOC, at).distinct().groupBy(*DOC).agg(F.count("*").alias("n_hit"))
    items = hits.select(*DOC, F.explode("items").alias("item")).distinct()
    items = items.groupBy(*DOC).agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = index.where(F.col("term") == END).select(*DOC, F.col("pos").cast("long").alias("n_words"))
    rows = rows.join(hit_words.join(items, DOC), DOC, "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
