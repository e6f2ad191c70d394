"""Near-duplicate embeddings: sign hashing by random hyperplanes, exact cosine, components.

Equal vectors of one label are one class first, so a hot vector is a row with a count.
Each table hashes a class to the signs of ``bits`` random projections; classes of a bucket
are compared by exact cosine in double precision.  A pair that meets in several tables is
counted in the first one only, which both rows' codes tell.  Buckets of over ``tile`` rows
are cut into tiles whose pairs are tasks of their own: none is capped or dropped, and no
pair leaves a task, only sums per class and a spanning set of links.

Chance to miss a pair at cosine c: (1 - p^bits)^tables with p = 1 - acos(c)/pi; ``plan``
picks bits from the row count and the tables for at most 0.3 % at the threshold.

Edge cases: vectors that are null, empty, zero or hold null, NaN or infinite components,
and rows without a label, link with nothing; vectors of different length never link;
repeated rows are vectors of their own and link with each other; a null id gets its count
and the component of its class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .scratch import Scratch


def plan(rows: int, threshold: float, miss: float = 0.003) -> tuple[int, int]:
    """(bits, tables): buckets of some 512 rows, and a chance to miss a pair at the threshold of at most ``miss``.

    Larger buckets ask for fewer bits and so for fewer tables, each of which moves the vectors once; the cosines of
    a bucket are one product of matrices.
    """
    bits = min(30, max(4, math.ceil(math.log2(max(1, rows) / 512))))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - p))


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(7919 * dim + 1).standard_normal((dim, bits * tables))


def _codes(bits: int, tables: int):
    """(rep, label, dim, n, codes): codes holds an int32 for each table."""
    place = 1 << np.arange(bits, dtype=np.int64)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            rep, vecs = batch.column(0), batch.column(1)
            dims = vecs.value_lengths().to_numpy(zero_copy_only=False)
            out = np.zeros((len(rep), tables), np.int32)
            flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate([[0], np.cumsum(dims)])
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                if d not in planes:
                    planes[d] = _planes(d, bits, tables)
                for i in range(0, len(rows), 2048):
                    part = rows[i : i + 2048]
                    v = np.stack([flat[at[r] : at[r] + d] for r in part])
                    v /= np.abs(v).max(axis=1, keepdims=True)
                    out[part] = ((v @ planes[d]).reshape(len(part), tables, bits) > 0) @ place
            yield pa.RecordBatch.from_arrays([rep, pa.array([r.tobytes() for r in out], pa.binary()), pa.array(out.tolist(), pa.list_(pa.int32()))], names=["c", "codes", "code"])

    return run


def _spread(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least label reachable by the links of a bipartite block, for its rows and its columns."""
    big = np.iinfo(np.int64).max
    while True:
        a2 = np.minimum(a, np.where(linked, b[None, :], big).min(axis=1, initial=big))
        b2 = np.minimum(b, np.where(linked, a2[:, None], big).min(axis=0, initial=big))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def _compare(threshold: float, tables: int):
    def links_of(t: int, same_tile: bool, left: np.ndarray, right: np.ndarray, c, n, unit, codes, out: list) -> None:
        step = 512
        for x in range(0, len(left), step):
            for y in range(x if same_tile else 0, len(right), step):
                p, q = left[x : x + step], right[y : y + step]
                near = unit(p) @ unit(q).T >= threshold
                if same_tile and x == y:
                    near &= np.tri(len(p), len(q), -1, dtype=bool).T
                for s in range(t):
                    if not near.any():
                        break
                    near &= codes[p, s][:, None] != codes[q, s][None, :]
                if near.any():
                    a, b = _spread(near, c[p], c[q])
                    for of, root, links in ((p, a, near @ n[q]), (q, b, near.T @ n[p])):
                        some = links > 0
                        out.append((c[of][some], root[some], links[some]))

    def run(table: pa.Table) -> pa.Table:
        """Links of the pairs of tiles that a group of buckets holds, each bucket's rows next to each other."""
        table = table.combine_chunks()
        t = table.column("t")[0].as_py()
        bucket, i, j, tile = (table.column(x).to_numpy() for x in ("b", "i", "j", "tile"))
        c, n, dim = (table.column(x).to_numpy() for x in ("c", "n", "dim"))
        flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        at = np.cumsum(dim) - dim
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int32).reshape(len(c), tables)

        def unit(rows: np.ndarray) -> np.ndarray:
            v = flat[at[rows][:, None] + np.arange(dim[rows[0]])]
            v = v / np.abs(v).max(axis=1, keepdims=True)
            return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]

        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        out: list = []
        for rows in np.split(order, cuts):
            if len(rows) > 1:
                first, second = i[rows[0]], j[rows[0]]
                links_of(t, first == second, rows[tile[rows] == first], rows[tile[rows] == second], c, n, unit, codes, out)
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("c", "root", "links"), columns, strict=True)))

    return run


def near_embeddings(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", tile: int = 1024, scratch: Scratch | None = None) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of vectors."""
    scratch = scratch or Scratch(vectors.sparkSession, "embeddings")
    v = F.col("embedding")
    sound = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("embedding"), F.col(label_col).alias("label"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    keys = ["label", "h1", "h2"]
    hashed = rows.withColumn("h1", F.when(F.col("sound"), F.xxhash64("label", "embedding"))).withColumn("h2", F.when(F.col("sound"), F.xxhash64("embedding", F.lit(1))))
    members = scratch.save(hashed.select("id", *keys), "members")
    classes = hashed.where("sound").groupBy(*keys).agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    classes = scratch.save(classes.withColumn("c", F.xxhash64(*keys)), "classes")
    n_classes = classes.count()
    bits, tables = plan(n_classes, threshold)
    coded = classes.select("c", "embedding").mapInArrow(_codes(bits, tables), "c long, codes binary, code array<int>")
    coded = scratch.save(coded, "coded")
    flat = coded.join(classes.select("c", "label", F.size("embedding").alias("dim")), "c").select("c", "label", "dim", F.posexplode("code").alias("t", "code"))
    flat = scratch.save(flat, "flat")
    bucket = ["t", "label", "dim", "code"]
    full = flat.groupBy(*bucket).agg(F.count("*").alias("m")).where("m > 1").withColumn("tiles", F.expr(f"cast((m + {tile - 1}) div {tile} AS int)"))
    placed = flat.join(full, bucket).withColumn("tile", F.expr("cast(pmod(hash(c), tiles) AS int)"))
    # The pairs of tiles (i, j), i <= j, that a row takes part in.
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    # Buckets are mostly small: a task's group takes some thousand rows of whole buckets, told apart by b.
    placed = placed.withColumn("b", F.xxhash64("label", "dim", "code", "i", "j"))
    slots = max(1, n_classes // 2048)
    work = placed.select("c", "t", "dim", "b", "tile", "i", "j", F.pmod("b", F.lit(slots)).alias("slot")).join(classes.select("c", "n", "embedding"), "c").join(coded.select("c", "codes"), "c")
    found = work.groupBy("t", "slot").applyInArrow(_compare(threshold, tables), "c long, root long, links long")
    found = scratch.save(found, "found")
    roots = connected_components(found.select(F.col("c").alias("a"), F.col("root").alias("b")).distinct(), scratch, "embeddings-cc")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    known = classes.select("c", "rep", *keys, "n").join(links, "c", "left").join(roots.withColumnRenamed("node", "c"), "c", "left")
    known = scratch.save(known.select(*keys, "rep", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "c").alias("root")), "known")
    least = known.groupBy("root").agg(F.min("rep").alias("component"))
    known = known.join(least, "root").select(*keys, "n", "links", "component")
    scratch.drop("flat", "coded")
    out = members.join(known, keys, "left").select("id", F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
