"""Filter interaction audit: what each of five text filters removes, in every order of them.

A document comes down to a mask of the filters that it fails, and documents to counts of the masks in each part of the
corpus: 32 cells, whatever the corpus' size. A walk over the 32 subsets of filters in Gray-code order switches one filter
at a time; each mask cell keeps the number of its failures that are switched on, and the survivors are a running sum of
the cells without any. The survivors of all subsets are stored, and each step of each order is the difference of two.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostsieve.sources.shared import stored

FILTERS = "ABCDE"
#: A pattern of the white space between words, of which there are six characters.
BLANK = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def masked(documents: DataFrame) -> DataFrame:
    """doc_id, part, mask of the first four filters, and the text's SHA-256, for each row.

    A fails under 200 words, B where under half of the words are distinct, C where over 3 of 100 characters are A-Z, D
    where one of six signs occurs.
    """
    text, words = F.col("text"), F.filter(F.split("text", BLANK), lambda w: w != "")
    rows = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", words).withColumns({"n": F.size("words"), "d": F.size(F.array_distinct("words"))})
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [F.col("n") < 200, F.col("d") * 100 < F.col("n") * 50, capitals * 100 > F.length(text) * 3, text.rlike(r"[#$%&*|]")]
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", bits.alias("mask"), F.sha2("text", 256).alias("code"))


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit k: filter k of FILTERS fails), n, good and toxic: documents in each cell, and those with label 1.

    E needs each text's smallest doc_id in the whole table. Rows are counted by doc_id first, which the join with the
    labels has brought together; equal texts then meet as one row for each part, mask and label, so a text that a third of
    the corpus repeats is a few rows.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = masked(documents).join(known, "doc_id", "left").na.fill(0, ["good", "toxic"])
    kinds = ["code", "part", "mask", "good", "toxic"]
    own = rows.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    some = own.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("anon"), first.alias("first"))
    some = stored(some)
    least = some.groupBy("code").agg(F.min("first.doc_id").alias("least"))
    some = some.join(least, "code")
    fresh = F.col("anon") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)  # these don't fail E
    split = F.inline(F.array(F.struct(F.col("mask").alias("m"), fresh.alias("k")), F.struct((F.col("mask") + 16).alias("m"), (F.col("n") - fresh).alias("k"))))
    some = some.select("part", "good", "toxic", split)
    return some.groupBy("part", F.col("m").alias("mask")).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("good")).alias("good"), F.sum(F.col("k") * F.col("toxic")).alias("toxic"))


def walk(counts: np.ndarray) -> np.ndarray:
    """Survivors of each of the 32 subsets of filters, a row each; counts: a row for each mask."""
    filters = len(FILTERS)
    masks, active = np.arange(1 << filters), np.zeros(1 << filters, int)
    out, running, subset = np.zeros_like(counts), counts.sum(0), 0
    out[0] = running
    for step in range(1, 1 << filters):
        k = (step & -step).bit_length() - 1  # the filter that the Gray code switches here
        failing = (masks >> k & 1).astype(bool)
        subset ^= 1 << k
        if subset >> k & 1:
            running = running - counts[failing & (active == 0)].sum(0)
            active[failing] += 1
        else:
            active[failing] -= 1
            running = running + counts[failing & (active == 0)].sum(0)
        out[subset] = running
    return out


def audit_part(part: str, counts: np.ndarray) -> pd.DataFrame:
    """The rows of one part from its 32 x 3 counts (all, good, toxic)."""
    states, masks = walk(counts), np.arange(32)
    fails = [int(counts[(masks >> k & 1).astype(bool), 0].sum()) for k in range(5)]
    rows, shapley = [], [0] * 5
    for order in permutations(range(5)):
        subset = 0
        for step, k in enumerate(order, 1):
            lost = states[subset] - states[subset | 1 << k]
            subset |= 1 << k
            shapley[k] += int(lost[0])
            rows.append((part, "".join(FILTERS[f] for f in order), step, int(states[subset][0]), int(lost[0]), fails[k] - int(lost[0]), int(counts[1 << k, 0]), int(lost[1]), int(lost[2]), k))
    return pd.DataFrame([(*r[:9], shapley[r[9]]) for r in rows], columns=["part", "filter_order", "step", *COUNTS])


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (language), each of the 120 orders of the filters, and each step.

    Null texts are empty, and so are null languages, which share the part of empty ones. A document that has several label
    rows counts as good or toxic if one of them says so; one without labels is neither. Rows that repeat a doc_id are rows
    of their own, none a copy of the other; a null doc_id is neither smaller nor greater than others, so such a row never
    fails E nor makes others fail, and it has no labels. An empty table gives no rows. Only the columns doc_id, text and lang are read.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((32, 3), np.int64)
        counts[frame["mask"]] = frame[["n", "good", "toxic"]]
        return audit_part(frame["part"].iloc[0], counts)

    return cells(documents, labels).groupBy("part").applyInPandas(run, RESULT)
