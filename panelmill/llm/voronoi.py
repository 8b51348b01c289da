"""Exact top-k by inner product: a kNN join over Voronoi groups.

Equal vectors are one candidate that carries its few smallest ids, equal queries are asked once. A query whose id
has several vectors among the data is asked by itself and leaves its own rows out from the start. Candidates are
grouped around data pivots, queries around query pivots. Summaries of the groups (radius, the distances closest to
the pivot, the largest query norm) give for every query group a score that its k-th answer certainly reaches, and for
every candidate the score it can reach at most; only candidates that may matter are replicated to a query group.
Each pair of a query part and a candidate part, both of bounded size, is solved in one task, and the parts' answers
are merged by rank.

For a query q of group (c, r: radius, n: largest norm) and a candidate x at distance d from its pivot p,
    c.p - r|p| - n d  <=  q.x  <=  c.p + r|p| + n d.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.storage import stored

DATA_PER_PIVOT, QUERIES_PER_PIVOT = 4_000, 2_000
MOST_PIVOTS = 2_048
_EXACT = 2**53


def integer_vectors(embeddings: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v = floor(scale * component). Rows with a null id or vector, or with a component that is null or
    not finite, are left out."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embeddings.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(key).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )


def _matrix(column: pa.Array | pd.Series, width: int) -> np.ndarray:
    """Rows of at most `width` components; shorter ones end in zeros."""
    rows = column.to_pylist() if isinstance(column, pa.Array) else column
    out = np.zeros((len(rows), width))
    for at, row in enumerate(rows):
        out[at, : len(row)] = row
    return out


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact."""
    most = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * queries.shape[1]
    if most < _EXACT:
        return (queries @ data.T).astype(np.int64)
    return queries.astype(np.int64) @ data.astype(np.int64).T


def _pivots(vectors: DataFrame, rows: int, per_pivot: int, width: int) -> np.ndarray:
    """A sample by hash of at most MOST_PIVOTS vectors."""
    count = min(MOST_PIVOTS, max(1, -(-rows // per_pivot)))
    found = vectors.orderBy(F.xxhash64("vkey"), "vkey").limit(count).select("v").collect()
    return _matrix(pd.Series([row["v"] for row in found]), width)


def _assigned(vectors: DataFrame, pivots: np.ndarray, part_rows: int, width: int) -> DataFrame:
    """Add the nearest pivot (cell), the distance to it, the norm and a part number to every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    at = vectors.columns.index("v")

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        squares = (centres**2).sum(axis=1)
        for batch in batches:
            rows = _matrix(batch.column(at), width)
            cell = (squares - 2 * rows @ centres.T).argmin(axis=1) if len(rows) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(cell.astype(np.int32)),
                    pa.array(np.linalg.norm(rows - centres[cell], axis=1)), pa.array(np.linalg.norm(rows, axis=1)),
                ],
                names=[*batch.schema.names, "cell", "away", "norm"],
            )

    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in vectors.schema)
    found = vectors.mapInArrow(assign, f"{kinds}, cell int, away double, norm double")
    sizes = found.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / part_rows))
    return found.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("vkey"), parts)).drop("_n")


def _needed(data: DataFrame, queries: DataFrame, pivots: np.ndarray, centres: np.ndarray, most: int) -> pd.DataFrame:
    """For query group and data cell: the distance from the pivot from which on candidates may matter.

    Candidates that may be a query's own rows only (solo) are not counted on.
    """
    nearest = Window.partitionBy("cell").orderBy("away", "vkey")
    certain = data.where(~F.col("solo")).select("cell", "away", F.row_number().over(nearest).alias("n"))
    close = certain.where(F.col("n") <= most).toPandas()
    radii = data.groupBy("cell").agg(F.max("away").alias("radius")).toPandas()
    reach = np.full(len(pivots), -1.0)
    reach[radii["cell"]] = radii["radius"]
    widest = queries.groupBy("cell").agg(F.max("away").alias("radius"), F.max("norm").alias("norm")).toPandas()
    lengths = np.linalg.norm(pivots, axis=1)
    cells = close["cell"].to_numpy()
    rows = []
    for group, radius, norm in widest.itertuples(index=False):
        centre = pivots @ centres[group]
        lower = centre[cells] - radius * lengths[cells] - norm * close["away"].to_numpy()
        reached = np.sort(lower)[-most] if len(lower) >= most else -np.inf
        missing = reached - centre - radius * lengths
        missing -= 1e-9 * (np.abs(centre) + (radius + norm) * lengths + np.abs(missing).min(initial=1.0)) + 1e-6
        least = missing / norm if norm > 0 else np.where(missing > 0, np.inf, -np.inf)
        rows += [(int(group), int(cell), float(least[cell])) for cell in np.flatnonzero(reach >= np.maximum(least, 0))]
    return pd.DataFrame(rows, columns=["q_cell", "cell", "least"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, repeats: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of `vectors` for each row of `queries` except the row
    with the query's own id; ties go to the smaller id, with fewer than k others all are returned.

    Both have vec_id and v (whole numbers; shorter vectors count as ending in zeros). Equal vectors and repeated rows
    are candidates of their own. A repeated query id is one query: it asks with each of its distinct vectors, and its
    answers are the k best of all pairs of vector and row. With `repeats` equal query rows make pairs of their own, as
    in a join of the two tables. Empty tables give an empty result.
    """
    spark, most = vectors.sparkSession, k + 1
    keyed = vectors.select("vec_id", "v", F.md5(F.array_join("v", ",").cast("binary")).alias("vkey"))
    asked = stored(
        queries.select(F.col("vec_id").alias("query_id"), "v", F.md5(F.array_join("v", ",").cast("binary")).alias("vkey"))
        .groupBy("query_id", "vkey").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("times")),
        "knn-queries",
    )
    # query ids with several vectors: room for one vector of their own would not do
    several = stored(
        vectors.join(asked.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
        .groupBy(F.col("vec_id").alias("own")).agg(F.min(F.xxhash64("v")).alias("_low"), F.max(F.xxhash64("v")).alias("_high"))
        .where(F.col("_low") != F.col("_high")).select("own"),
        "knn-repeated-ids",
    )
    # of each id the k rows that matter; without those of any one id, k of 2 k rows are left
    same = Window.partitionBy("vkey", "vec_id").orderBy("vec_id")
    smallest = Window.partitionBy("vkey").orderBy("vec_id")
    kept = keyed.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k)
    kept = kept.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= 2 * k)
    listed = kept.groupBy("vkey").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    lone = F.when(F.col("ids")[0] == F.element_at("ids", -1), F.col("ids")[0])
    data = stored(
        listed.withColumn("_lone", lone).join(several.withColumnRenamed("own", "_own"), F.col("_lone") == F.col("_own"), "left")
        .select("vkey", "v", "ids", F.col("_own").isNotNull().alias("solo")),
        "knn-data",
    )
    asked = asked.join(several, F.col("query_id") == F.col("own"), "left").withColumn(
        "vkey", F.when(F.col("own").isNull(), F.col("vkey")).otherwise(F.concat_ws(" ", "vkey", F.col("own").cast("string")))
    )
    distinct = stored(asked.groupBy("vkey").agg(F.first("v").alias("v"), F.first("own").alias("own")), "knn-query-vectors")

    facts = data.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    asked_facts = distinct.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(facts[1] or 0, asked_facts[1] or 0, 1)
    pivots, centres = _pivots(data, facts[0], DATA_PER_PIVOT, width), _pivots(distinct, asked_facts[0], QUERIES_PER_PIVOT, width)
    found = "qkey string, score long, ids array<long>"
    if len(pivots) and len(centres):
        grouped = stored(_assigned(data, pivots, DATA_PER_PIVOT, width), "knn-data-groups")
        asking = stored(_assigned(distinct, centres, QUERIES_PER_PIVOT, width), "knn-query-groups")
        keys = ["q_cell", "q_part", "cell", "part"]
        # at most MOST_PIVOTS squared small rows
        needed = spark.createDataFrame(_needed(grouped, asking, pivots, centres, most), "q_cell int, cell int, least double")
        sent = grouped.join(F.broadcast(needed) if needed.count() <= 100_000 else needed, "cell").where(F.col("away") >= F.col("least"))
        q_parts = asking.select(F.col("cell").alias("q_cell"), F.col("part").alias("q_part")).distinct()
        pairs = sent.select("q_cell", "cell", "part").distinct().join(q_parts, "q_cell")
        data_side = sent.join(q_parts, "q_cell").select("q_cell", "q_part", "cell", "part", "v", "ids")
        query_side = asking.select(F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), F.col("vkey").alias("qkey"), F.col("v").alias("q"),
            F.coalesce("own", F.lit(0)).alias("own"), F.col("own").isNotNull().alias("apart")).join(
            pairs, ["q_cell", "q_part"]
        ).select(*[F.col(name).alias(f"_{name}") for name in keys], "qkey", "q", "own", "apart")

        def solve(rows: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
            if rows.empty or questions.empty:
                return pd.DataFrame({"qkey": [], "score": [], "ids": []})
            order = np.argsort([ids[0] for ids in rows["ids"]], kind="stable")
            ids, points = rows["ids"].to_numpy()[order], _matrix(rows["v"], width)[order]
            # the two smallest different ids, or the only one twice
            first = np.array([held[0] for held in ids])
            second = np.array([next((one for one in held if one != held[0]), held[0]) for held in ids])
            out = []
            for start in range(0, len(questions), 256):
                block = questions.iloc[start : start + 256]
                scores = _scores(_matrix(block["q"], width), points)
                for qkey, own, apart, line in zip(block["qkey"], block["own"], block["apart"], scores):
                    if apart:
                        others = np.flatnonzero((first != own) | (second != own))
                        if len(others):
                            floor = np.partition(line[others], -most)[-most] if len(others) > most else line[others].min()
                            close = others[line[others] >= floor]
                            smallest_other = np.where(first[close] == own, second[close], first[close])
                            best = close[np.lexsort((smallest_other, -line[close]))[:most]]
                            out += [(qkey, int(line[at]), ids[at][ids[at] != own]) for at in best]
                        continue
                    floor = np.partition(line, -most)[-most] if len(line) > most else line.min()
                    close = np.flatnonzero(line >= floor)
                    best = close[np.argsort(-line[close], kind="stable")[:most]]
                    out += [(qkey, int(line[at]), ids[at]) for at in best]
            return pd.DataFrame(out, columns=["qkey", "score", "ids"])

        answers = data_side.groupBy(*keys).cogroup(query_side.groupBy(*[f"_{name}" for name in keys])).applyInPandas(solve, found)
    else:
        answers = spark.createDataFrame([], found)
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), F.element_at("ids", 1))
    merged = answers.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)
    rows = merged.select("qkey", "score", F.explode("ids").alias("vec_id"))
    ranked = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= 2 * most).drop("n")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.select("query_id", F.col("vkey").alias("qkey"), (F.least("times", F.lit(k)) if repeats else F.lit(1)).cast("int").alias("_times"))
        .join(rows, "qkey")
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("_time", F.explode(F.array_repeat(F.lit(1), F.col("_times"))))
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
