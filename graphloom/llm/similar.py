"""The most similar vectors of every vector, by cross-polytope hashing with exact reranking.

Unit vectors are turned by fast pseudo-rotations (three rounds of random signs and a Hadamard transform) and
fall into the bucket of their nearest signed axis; every table also takes the second nearest (multiprobe).
Pairs that share a bucket in any table are candidates. Within a bucket they are compared by block products of
one byte a dimension; the error of each rounded vector is known, so no pair of at least ``least`` is lost by that.
The best ``SPARE`` * k of each query are compared exactly, in double precision. Only pairs of one group (model, profile, dimensions) meet.

Scale: each vector is hashed and rounded once and written down; only the rounded form is sent to its buckets,
the full vectors only for the pairs that are compared exactly. A bucket above ``bucket_rows`` rows is compared block against block in
cells of a grid, so that all pairs that share it stay candidates, no cell grows with the data and recall does not depend on the number of
rows; a row of it is sent once for each block. The list of such buckets has at most rows * tables * probes / ``bucket_rows`` entries
(24 bytes for 1,000 rows with 10 tables and 2 probes). Exact copies are one representative, and are put back with at most k + 1 of them
for each neighbour list.

Defined cases: null, zero, non-finite vectors and those whose length is not ``dimensions`` are unusable and
have no list; repeated rows of an id count once; equal similarities are ordered by id; a group with fewer
than k + 1 vectors gives shorter lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import cut_lineage, land, read_table, spread

SEED = 20240229
#: Candidates of each query, as a multiple of k, that are compared exactly.
SPARE = 2


def usable_vectors(df: DataFrame) -> DataFrame:
    """(id, grp, embedding), one row for each usable ``vector_id``."""
    good = (
        F.col("embedding").isNotNull() & (F.size("embedding") == F.col("dimensions"))
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    group = F.concat_ws("\x1f", F.coalesce("model_name", F.lit("")), F.coalesce("embedding_profile_version", F.lit("")), F.col("dimensions").cast("string"))
    return df.where(good).select(F.col("vector_id").alias("id"), group.alias("grp"), F.col("embedding").cast("array<float>").alias("embedding")).dropDuplicates(["id"])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (its length a power of two), not scaled."""
    rows, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(rows, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, width)
        step *= 2
    return x


def signs(width: int, table: int) -> np.ndarray:
    return np.random.default_rng([SEED, width, table, 0]).choice(np.array([-1.0, 1.0], dtype=np.float32), size=(3, width))


def nearest_axes(unit: np.ndarray, table: int, probes: int) -> np.ndarray:
    """(rows, probes): the nearest signed axes of each pseudo-rotated row, the nearest first."""
    width = 1 << max(0, unit.shape[1] - 1).bit_length()
    y = np.zeros((len(unit), width), dtype=np.float32)
    y[:, : unit.shape[1]] = unit
    for s in signs(width, table):
        y = hadamard(y * s)
        y *= width**-0.5
    size = np.abs(y)
    probes = min(probes, width)
    best = np.argpartition(-size, range(probes), axis=1)[:, :probes] if probes < width else np.argsort(-size, axis=1)
    return best * 2 + (np.take_along_axis(y, best, axis=1) < 0)


def _unit_rows(batch: pa.RecordBatch) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each group of the batch: (positions of its rows, their unit vectors)."""
    groups = np.array(batch.column("grp").to_pylist(), dtype=object)
    vectors = batch.column("embedding")
    out = {}
    for group in dict.fromkeys(groups):
        at = np.flatnonzero(groups == group)
        part = vectors.take(pa.array(at))
        x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)  # lengths whose square leaves the range of doubles
        out[group] = at, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return out


def _coded(vectors: DataFrame, tables: int, probes: int) -> DataFrame:
    """(id, grp, asked, codes, packed): the buckets of each vector in all tables, the nearest first, and its unit vector
    rounded to bytes behind the scale and the length of the error."""
    def run(batches):
        for batch in batches:
            order, codes, packed = [], [], []
            for at, x in _unit_rows(batch).values():
                order.append(at)
                found = np.concatenate([nearest_axes(x, table, probes) for table in range(tables)], axis=1).astype(np.int32)
                codes += list(found)
                scale = np.abs(x).max(axis=1, keepdims=True) / 127
                rounded = np.rint(x / scale)
                error = np.linalg.norm(x - rounded * scale, axis=1, keepdims=True)
                head = np.ascontiguousarray(np.concatenate([scale, error], axis=1).astype(np.float32)).view(np.uint8)
                packed += [row.tobytes() for row in np.concatenate([head, rounded.astype(np.int8).view(np.uint8)], axis=1)]
            at = pa.array(np.concatenate(order)) if order else pa.array([], type=pa.int64())
            columns = [batch.column(n).take(at) for n in ("id", "grp", "asked")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, type=pa.list_(pa.int32())), pa.array(packed, type=pa.binary())], names=["id", "grp", "asked", "codes", "packed"])

    return vectors.select("id", "grp", "asked", "embedding").mapInArrow(run, "id bigint, grp string, asked boolean, codes array<int>, packed binary")


def candidate_neighbours(vectors: DataFrame, k: int, tables: int, probes: int, least: float | None, queries=None, bucket_rows: int = 8192, query_probes: int | None = None) -> DataFrame:
    """(a, b, similarity): for each query a its best candidates b of at least ``least``, ``SPARE`` * k of them.

    ``vectors`` is (id, grp, embedding); ``queries`` is a condition on ``id``, all rows without it. Queries may
    look into more buckets (``query_probes``) than the rows are stored in (``probes``)."""
    deepest, wanted = max(probes, query_probes or probes), SPARE * k

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        side = table.column("side").to_numpy(zero_copy_only=False).astype(bool)
        asked = table.column("asked").to_numpy(zero_copy_only=False).astype(bool)
        packed = np.frombuffer(b"".join(table.column("packed").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        scale, error = np.ascontiguousarray(packed[:, :8]).view(np.float32).T
        x = packed[:, 8:].view(np.int8).astype(np.float32) * scale[:, None]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sides = ((~side, side), (side, ~side)) if side.any() else ((~side, ~side),)
        for rows, columns in ((np.flatnonzero(a & asked), np.flatnonzero(b)) for a, b in sides):
            if not len(columns):
                continue
            for start in range(0, len(rows), 512):
                block = rows[start : start + 512]
                s = x[block] @ x[columns].T
                s[ids[block][:, None] == ids[columns][None, :]] = -2.0
                enough = -1.5 if least is None else least - 1e-5
                good = s + (error[block][:, None] + error[columns][None, :]) >= enough if least is not None else s > enough
                if good.sum() > wanted * len(block):
                    keep = _best(s, wanted)
                    good = np.take_along_axis(good, keep, axis=1)
                    a, b = np.repeat(np.arange(len(block)), keep.shape[1])[good.ravel()], keep[good]
                else:
                    a, b = np.nonzero(good)
                found.append((ids[block[a]], ids[columns[b]], s[a, b]))
        a, b, s = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3))
        return pa.table({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64)), "near": pa.array(s.astype(np.float32))})

    coded = land(_coded(vectors.withColumn("asked", F.lit(True) if queries is None else queries), tables, deepest), "p3-codes")
    n_codes = F.size("codes") / tables  # at most `deepest`, fewer where vectors are short
    entries = coded.select("id", F.xxhash64("grp").alias("grp"), "asked", "packed", n_codes.cast("int").alias("width"), F.posexplode("codes").alias("pos", "code")).where(F.col("asked") | (F.col("pos") % F.col("width") < probes))
    entries = entries.withColumn("tbl", F.floor(F.col("pos") / F.col("width")).cast("int")).drop("pos", "width")
    hot = entries.groupBy("grp", "tbl", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / bucket_rows).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cells = (
        entries.join(F.broadcast(hot), ["grp", "tbl", "code"], "left").withColumn("blocks", blocks)
        .select("grp", "tbl", "code", "id", "asked", "packed", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("grp", "tbl", "code", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).alias("side"), "id", "asked", "packed")
    )
    pairs = cells.groupBy("grp", "tbl", "code", "low", "high").applyInArrow(compare, "a bigint, b bigint, near float")
    by_query = Window.partitionBy("a").orderBy(F.desc("near"), "b")
    pairs = pairs.groupBy("a", "b").agg(F.max("near").alias("near")).withColumn("nth", F.row_number().over(by_query)).where(F.col("nth") <= wanted).select("a", "b")
    one, two = (vectors.select(F.col("id").alias(n), F.col("embedding").cast("array<double>").alias(f"v{n}")) for n in "ab")
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda total, p: total + p)
    cosine = dot("va", "vb") / (F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb")))
    exact = pairs.join(one, "a").join(two, "b").select("a", "b", F.least(F.lit(1.0), cosine).alias("similarity"))
    return exact if least is None else exact.where(F.col("similarity") >= least - 1e-7)  # vectors are stored in single precision


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row, all columns if there are no more."""
    return np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(s), 1))


def neighbours(vectors: DataFrame, k: int = 10, tables: int = 6, probes: int = 2, least: float | None = None, queries=None, query_probes: int | None = None) -> DataFrame:
    """(a, b, similarity, rank): the k nearest other vectors b of each query a, at least ``least`` similar."""
    copy_key = F.struct(F.col("grp"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.reverse("embedding"), F.lit(7)).alias("h2"))
    keyed = vectors.withColumn("copy", copy_key)
    by_copy = Window.partitionBy("copy").orderBy("id")
    firsts = keyed.select("copy", "id").withColumn("nth", F.row_number().over(by_copy)).where(F.col("nth") <= k + 1)  # limited before the shuffle
    # vectors stay where their id is; only hashes are grouped
    wanted = [F.max(queries).alias("wanted")] if queries is not None else []
    copies = keyed.groupBy("copy").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), *wanted).drop("copy")
    representatives = cut_lineage(keyed.join(copies.withColumnRenamed("rep", "id"), "id").withColumn("grp", F.col("copy.grp")))
    asked = F.col("wanted") if queries is not None else None
    near = candidate_neighbours(spread(representatives), k, tables, probes, least, asked, query_probes=query_probes)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).where(F.col("rank") <= k).select("a", "b", "similarity")
    several = representatives.where("copies > 1").select("copy", F.col("id").alias("rep"))
    members = firsts.join(several, "copy").select("rep", "id", "nth")  # the first copies only, k + 1 of each
    # who asks: every copy of a representative; who answers: the first copies of a neighbour
    answers = near.join(members.withColumnRenamed("rep", "b"), "b", "left").select("a", F.coalesce("id", "b").alias("b"), "similarity")
    own = members.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    offers = answers.unionByName(own)
    everyone = keyed.join(several, "copy").where(queries if queries is not None else F.lit(True)).select("rep", "id")
    expanded = offers.join(everyone.withColumnRenamed("rep", "a"), "a", "left").select(F.coalesce("id", "a").alias("a"), "b", "similarity").where(F.col("a") != F.col("b"))
    if queries is not None:
        expanded = expanded.withColumnRenamed("a", "id").where(queries).withColumnRenamed("id", "a")
    ranked = expanded.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b")))
    return ranked.where(F.col("rank") <= k).select("a", "b", "similarity", "rank")


def found(spark, root: str) -> DataFrame:
    """Pairs of neighbours of a cosine of at least 0.9; every vector is a query."""
    near = neighbours(usable_vectors(read_table(spark, root, "semantic_embeddings")), k=10, tables=6, probes=2, least=0.9)
    return near.select(F.least("a", "b").alias("vector_id_a"), F.greatest("a", "b").alias("vector_id_b")).distinct()


def nearest(spark, root: str) -> DataFrame:
    """The 10 nearest of each vector whose id is divisible by 50, among all vectors of its group."""
    near = neighbours(usable_vectors(read_table(spark, root, "semantic_embeddings")), k=10, tables=10, probes=2, query_probes=5, queries=F.col("id") % 50 == 0)
    return near.select(F.col("a").alias("vector_id"), F.col("b").alias("neighbour_id"), F.round("similarity", 5).alias("similarity"), "rank")
