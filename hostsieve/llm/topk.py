"""Exact top-k search by inner product, in three phases with a uniform threshold.

A vector's dimensions are dealt to a few lists, and a score is the sum of a vector's entries in the lists, an entry being
the inner product over the list's dimensions. Rows and queries meet in blocks, so each list is kept in parts.

1. Each part sends a query its highest entries in order, the head of its local score list. The rows that lead a list over
   all parts are resolved, and the k-th best of their scores is a safe cutoff.
2. The cutoff goes to every part with the query. A row of at least that score has an entry of at least cutoff / lists in
   some list. A head that ends below this holds all such entries; only longer lists are read on.
3. The scores of the rows collected so are resolved exactly, part by part, and the k best kept.

No group grows with the table, and nothing is broadcast. Two lists are the default: of 10,256 vectors of 64 dimensions,
3.1 % of the scores were resolved with two lists and heads of 24, and 25 % with three lists and heads of 5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostsieve.llm.common import stored

ROW_BLOCK, QUERY_BLOCK = 2048, 2048
HEADS = "query_id long, qb int, l int, rb int, ids array<long>, entries array<double>, more boolean"


def integers(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, the vector of floor(scale * x), for usable vectors; of rows with equal vec_id, the smallest vector."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("double")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    flat = column.combine_chunks().flatten() if len(column) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def entries(rows: pa.Table, queries: pa.Table) -> np.ndarray:
    """The entry of each query (one a row) and row of a part; a query's own row has none."""
    out = matrix(queries["qv"]) @ matrix(rows["v"]).T
    out[queries["query_id"].to_numpy()[:, None] == rows["vec_id"].to_numpy()[None, :]] = -np.inf
    return out


def empty(names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})


IDS, SCORES = pa.list_(pa.int64()), pa.list_(pa.float64())


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5, lists: int = 2, scale: int = 256, head: int = 24) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products with the other rows.

    is_query: a condition on vec_id. Vectors that are null or hold a null or non-finite component take no part; a shorter
    vector counts as filled with zeros. Rows with a query's vec_id are the query itself; repeated rows count once. Ties
    go to the smaller vec_id. With fewer than k others all are returned. An empty table gives an empty result. Only
    vec_id and embedding are read. head: entries of a part's list that the first phase reads, at least k are.
    """
    found = search(embeddings, is_query, k, lists, scale, max(head, k))[0]
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))


def search(embeddings: DataFrame, is_query: Column, k: int, lists: int, scale: int, head: int) -> tuple[DataFrame, DataFrame]:
    """The k best rows of each query, and what was collected to find them: query_id, qb, rb and the ids of each part."""
    rows = integers(embeddings, scale)
    n, width = embeddings.count(), rows.agg(F.max(F.size("v"))).first()[0] or 0
    lists = max(1, min(lists, width))
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-embeddings.where(is_query).count() // QUERY_BLOCK))
    block = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))
    rows = stored(rows.select("vec_id", filled.alias("v"), block(row_blocks).alias("rb")))
    asked = stored(rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), block(query_blocks).alias("qb")))
    cuts = np.linspace(0, width, lists + 1).astype(int).tolist()

    def parts(df: DataFrame, v: str) -> DataFrame:
        """df with a row for each list: l, and v in the list's dimensions alone."""
        of = [F.struct(F.lit(i).alias("l"), F.slice(v, a + 1, b - a).alias("x")) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        return df.withColumn("__of", F.explode(F.array(*of))).withColumns({"l": F.col("__of.l"), v: F.col("__of.x")}).drop("__of")

    def heads(r: pa.Table, q: pa.Table) -> pa.Table:
        """For each query its highest entries in one part, in order, and whether the part has more rows."""
        if not r.num_rows or not q.num_rows:
            return empty(["query_id", "qb", "l", "rb", "ids", "entries", "more"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), IDS, SCORES, pa.bool_()])
        x, most = entries(r, q), min(head, r.num_rows)
        at = np.argpartition(-x, most - 1, axis=1)[:, :most]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(x, at, 1), axis=1, kind="stable"), 1)
        x, ids, m = np.take_along_axis(x, at, 1), r["vec_id"].to_numpy()[at], q.num_rows
        real = np.isfinite(x)
        return pa.table(
            {
                "query_id": q["query_id"],
                "qb": q["qb"],
                "l": q["l"],
                "rb": pa.array(np.repeat(r["rb"].to_numpy()[:1], m)),
                "ids": pa.array([i[f] for i, f in zip(ids, real, strict=True)], IDS),
                "entries": pa.array([v[f] for v, f in zip(x, real, strict=True)], SCORES),
                "more": pa.array([r.num_rows > most] * m),
            }
        )

    def rest(r: pa.Table, q: pa.Table) -> pa.Table:
        """For each query the rows of one part whose entry reaches the threshold."""
        if not r.num_rows or not q.num_rows:
            return empty(["query_id", "qb", "rb", "ids"], [pa.int64(), pa.int32(), pa.int32(), IDS])
        cutoff = q["cutoff"].to_numpy()[:, None]
        x, ids = entries(r, q), r["vec_id"].to_numpy()
        found = (x * lists >= cutoff) & np.isfinite(x)
        return pa.table({"query_id": q["query_id"], "qb": q["qb"], "rb": q["rb"], "ids": pa.array([ids[f] for f in found], IDS)})

    def exact(r: pa.Table, q: pa.Table) -> pa.Table:
        """The k best of the wanted rows of one part for each query."""
        out: list[tuple[np.ndarray, ...]] = []
        order = np.argsort(r["vec_id"].to_numpy())
        ids, v, qv = r["vec_id"].to_numpy()[order], matrix(r["v"])[order], matrix(q["qv"])
        for i, (query, wanted) in enumerate(zip(q["query_id"].to_pylist(), q["ids"], strict=True)):
            at = np.searchsorted(ids, np.unique(wanted.values.to_numpy()))
            score = v[at] @ qv[i]
            best = np.lexsort((ids[at], -score))[:k]
            out.append((np.full(len(best), query), ids[at][best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    def resolved(wanted: DataFrame) -> DataFrame:
        """query_id, vec_id, score, rank: the k best of the wanted rows (query_id, qb, rb, ids), exactly."""
        per = wanted.groupBy("query_id", "qb", "rb").agg(F.flatten(F.collect_list("ids")).alias("ids")).where(F.size("ids") > 0)
        per = per.join(asked.select("query_id", "qv"), "query_id")
        dealt = rows.withColumn("qb", every(query_blocks))
        best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = dealt.groupBy("qb", "rb").cogroup(per.groupBy("qb", "rb")).applyInArrow(exact, "query_id long, vec_id long, score double")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    list_rows = parts(rows, "v").withColumn("qb", every(query_blocks))
    list_queries = parts(asked, "qv")
    keys = ("l", "qb", "rb")
    first = list_rows.groupBy(*keys).cogroup(list_queries.withColumn("rb", every(row_blocks)).groupBy(*keys)).applyInArrow(heads, HEADS)
    first = stored(first)
    lead = W.partitionBy("query_id", "l").orderBy(F.desc("e.entries"), "e.ids")
    leaders = first.select("query_id", "qb", "l", "rb", F.explode(F.arrays_zip("entries", "ids")).alias("e"))
    leaders = leaders.withColumn("place", F.row_number().over(lead)).where(F.col("place") <= head)
    leaders = leaders.select("query_id", "qb", "rb", F.array("e.ids").alias("ids"))
    cutoffs = resolved(leaders).where(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff"))
    cut = asked.select("query_id").join(cutoffs, "query_id", "left").select("query_id", F.coalesce("cutoff", F.lit(float("-inf"))).alias("cutoff"))
    first = first.join(stored(cut), "query_id")
    open_ = F.col("more") & (F.element_at("entries", -1) * lists >= F.col("cutoff"))
    reached = F.transform(F.filter(F.arrays_zip("entries", "ids"), lambda e: e["entries"] * lists >= F.col("cutoff")), lambda e: e["ids"])
    closed = first.where(~open_).select("query_id", "qb", "rb", reached.alias("ids"))
    longer = first.where(open_).select("query_id", "l", "rb", "cutoff").join(list_queries, ["query_id", "l"])
    some = list_rows.join(longer.select(*keys).distinct(), list(keys), "left_semi")
    longer = some.groupBy(*keys).cogroup(longer.groupBy(*keys)).applyInArrow(rest, "query_id long, qb int, rb int, ids array<long>")
    collected = stored(closed.unionByName(longer))
    return resolved(collected), collected
