"""Exact Jaccard join of word-shingle sets, with links summed up as components.

Method: set-relation skipping.  A prefix index orders each set's shingles by document
frequency; lists carry each entry's position and set size and are cut into blocks by the
sizes that an entry's position leaves open for its partner, so blocks that position, size
or unshared elements rule out are skipped without looking at their pairs; blocks of a hot
list are cut into tiles.  Sets that are highly similar to a pivot take over the pivot's
answers: the pivot is verified first, its component is inherited, by the triangle inequality
of the Jaccard distance a set's distance to the pivot rules out partners without looking at
them, and where two sets have one pivot their overlap is derived from the pivot's answers
and the elements in which they differ from it.  Only pairs of lists that still join two
different components are verified at the end, so a group of thousands of near copies
costs a number of comparisons in proportion to its size, and no link is lost.  Shingles
that are frequent among one task's (``hot`` times, by default as the corpus' size asks) are dealt to salted parts of their
bucket, so no task gathers those of all texts.

Steps (t = threshold; a set of n shingles needs ceil(t*n) in common with any partner):

1. Texts become sets; equal sets are one class from here on.
2. Filter: of each set the n - ceil(t*n) + l smallest hashes (l = 5 % of n) are dealt by
   hash, packed.  A linked set has at least as many of them in its partner's part as l is
   for a set of ceil(t*n) elements.
3. The sets that are left are dealt whole; the elements that occur in two sets come back
   with their frequencies.  A set with fewer than ceil(t*n) of them has no partner.
4. Index, pivots, components, and the exact rest, as above.

Edge cases: null and empty texts and texts without words have an empty set, n = 0, and
link with nothing; fewer words than a shingle make one element of the whole sequence; a
null id is returned with its count and a null component; repeated ids share a component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import wordkernel as wk
from .components import connected_components
from .scratch import Scratch

MASK40 = np.uint64((1 << 40) - 1)
FREQUENT = 1 << 40  # stands for any frequency of a hash whose entries are spread over parts of a bucket


def sets_of(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct shingles of each row, sorted."""
    _, _, first, w = wk.hashed_words(raw, off, wk.LOWER)
    g = wk.window_hashes(w, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(np.array([wk.short_hash(w[a:b])], dtype=np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray, seed: int) -> int:
    return int(wk.mix(s ^ np.uint64(seed)).sum(dtype=np.uint64)) if len(s) else 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def _profiles(k: int):
    def run(batches):
        for batch in batches:
            for (ids,), raw, off in wk.slices([batch.column(0)], batch.column(1)):
                sets = sets_of(raw, off, k)
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), *(pa.array(signed(np.array([digest(s, seed) for s in sets], dtype=np.uint64))) for seed in (0, 77))], names=["id", "n", "d1", "d2"])

    return wk.lean(run)


def _dealt(k: int, deal: wk.Deal, keep, set_bytes: int, hash_bytes: int, least: int):
    """Packed entries (hash, set) of keep(set) for every distinct set of a task."""

    def run(batches):
        hashes, owners, held, seen = [], [], 0, set()

        def flush():
            h, o = np.concatenate(hashes), np.concatenate(owners)
            h = wk.mix(h)
            often = wk.hot(h, least)
            if often.any():
                # Each of a frequent shingle's sets is shared for sure; two of them stand for the rest.
                x, y = h[often], o[often]
                yield deal.pack(x, [(x, hash_bytes), (y, set_bytes)], wk.salt_of(y))
                stand = np.concatenate(wk.ends_of(x, y))
                yield deal.pack(x[stand], [(x[stand], hash_bytes), (y[stand], set_bytes)], stand=True)
                h, o = h[~often], o[~often]
            yield deal.pack(h, [(h, hash_bytes), (o, set_bytes)])

        for batch in batches:
            for _, raw, off in wk.slices([], batch.column(0)):
                for s in sets_of(raw, off, k):
                    if not len(s) or (d := digest(s, 0)) in seen:
                        continue
                    seen.add(d)
                    part = s[: keep(len(s))]
                    hashes.append(part)
                    owners.append(np.full(len(part), d, dtype=np.uint64))
                    held += len(part)
                if held >= wk.FLUSH:
                    yield from flush()
                    hashes, owners, held = [], [], 0
        if held:
            yield from flush()

    return wk.lean(run)


def _shared(table: pa.Table, hash_bytes: int, set_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, set, frequency) of the entries whose hash occurs in two sets at least.

    A hash that was frequent in any task has the frequency FREQUENT in every part of its bucket: the plain part
    tells by the entries that stand for a salted one, which itself returns their sets.
    """
    h, s = wk.unpack(table, [hash_bytes, set_bytes])
    stand = np.repeat(table.column("stand").to_numpy(), table.column("n").to_numpy())
    order = np.lexsort((stand, s, h))
    h, s, stand = h[order], s[order], stand[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    h, s, stand = h[new], s[new], stand[new]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(head)
    df = np.diff(np.append(at, len(h)))
    often = np.logical_or.reduceat(stand, at) | (table.column("salt")[0].as_py() > 0) if len(at) else np.zeros(0, bool)
    df = np.repeat(np.where(often, FREQUENT, df), df)
    many = (df >= 2) & ~stand
    return h[many], s[many], df[many]


def _counts(table: pa.Table) -> pa.Table:
    _, s, _ = _shared(table, 4, 5)
    s, n = np.unique(s, return_counts=True)
    return pa.table({"s": signed(s), "c": n.astype(np.int64)})


def _elements(table: pa.Table) -> pa.Table:
    h, s, df = _shared(table, 5, 8)
    b = np.uint64(table.column("bucket")[0].as_py()) if table.num_rows else np.uint64(0)
    return pa.table({"s": signed(s), "h": signed(h | (b << np.uint64(40))), "df": df.astype(np.int64)})


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, hot: int | None = None, coarse: int = wk.COARSE, scratch: Scratch | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id), a row for each row of docs; see the module for the method and the edge cases."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    need = lambda n: -(-percent * n // 100)
    need_sql = lambda n: f"ceil({percent} * {n} / 100D)"
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    prof = scratch.save(wk.over_texts(texts, _profiles(k), "id long, n long, d1 long, d2 long"), "profiles")
    total, rows = prof.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    classes = scratch.save(prof.where("n > 0 AND id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep")), "classes")

    # 2: which sets have enough of their smallest hashes in other sets.  The first l common elements of a pair lie in
    # both parts for the lesser l of the two; a partner has ceil(t*n) elements at least, hence the bound on the count.
    slack = lambda n: max(1, n // 20)
    entries = total * (1.05 - percent / 100)
    deal = wk.Deal(wk.bucket_bits(entries), coarse)
    dealt = wk.over_texts(texts.select("text"), _dealt(k, deal, lambda n: n - need(n) + slack(n), 5, 4, hot or wk.hot_least(entries)), wk.PACKED)
    hits = deal.spread(dealt, [4, 5]).groupBy("bucket", "salt").applyInArrow(_counts, "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
    alive = classes.withColumn("s", F.expr(f"d1 & {int(MASK40)}L")).join(hits, "s").where(f"c >= greatest(1, {need_sql('n')} div 20)").select("n", "d1", "d2", "rep")
    alive = scratch.save(alive, "alive")
    scratch.release()

    # 3: the elements of those sets that two sets share, with frequencies
    total, left = alive.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ids = alive.select(F.col("rep").alias("id"))
    ids = F.broadcast(ids) if left <= 500_000 else ids  # 8 bytes an id; more are joined by a shuffle
    deal = wk.Deal(wk.bucket_bits(total), coarse)
    dealt = wk.over_texts(texts.join(ids, "id", "left_semi").select("text"), _dealt(k, deal, lambda n: n, 8, 5, hot or wk.hot_least(total)), wk.PACKED)
    elements = deal.spread(dealt, [5, 8]).groupBy("bucket", "salt").applyInArrow(_elements, "s long, h long, df long")
    grouped = elements.groupBy("s").agg(F.array_sort(F.collect_set(F.struct("df", "h"))).alias("r")).select("s", F.col("r.h").alias("r"))
    sets = alive.select(F.col("d1").alias("s"), "n").distinct().join(grouped, "s").where(f"size(r) >= {need_sql('n')}").select("s", "n", "r")
    sets = scratch.save(sets, "sets")
    scratch.release()

    links = _links(sets, percent, scratch)
    roots = connected_components(links, scratch, "jaccard-cc")
    known = alive.select(F.col("d1").alias("node"), "rep").join(roots, "node")
    least = known.groupBy("root").agg(F.min("rep").alias("component"))
    of_set = known.select("node", "root").distinct().join(least, "root").select(F.col("node").alias("d1"), "component")
    whole = classes.join(of_set, "d1", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = prof.join(whole, ["n", "d1", "d2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with dist, the Jaccard distance, and whether they link."""
    left, right = sets.select(F.col("s").alias("a"), F.col("n").alias("na"), F.col("r").alias("ra")), sets.select(F.col("s").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ra", "rb")).cast("long").alias("o"))
    return both.select("a", "b", (1 - F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))).alias("dist"), F.expr(f"100 * o >= {percent} * (na + nb - o)").alias("link"))


SKETCH = 8  # longs of a parity sketch


def _sketches(r: str) -> list:
    """Columns of a parity sketch of the hashes in array r: 64 * SKETCH bits, each the parity of the elements it stands for."""
    return [F.expr(f"aggregate(filter({r}, x -> (shiftright(x, 6) & {SKETCH - 1}) = {j}), 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 AS int)))").alias(f"k{j}") for j in range(SKETCH)]


def _moved(state: DataFrame, done: DataFrame, roots: DataFrame) -> DataFrame:
    """state (s, comp, pv, dist) with new components and, where a set had no pivot of its own yet, the one tested last."""
    tested = done.select(F.col("a").alias("s"), F.col("b").alias("pv1"), F.col("dist").alias("dist1"))
    new = "pv = s AND pv1 IS NOT NULL"
    both = state.join(roots.select(F.col("node").alias("s"), "root"), "s", "left").join(tested, "s", "left")
    return both.select("s", F.coalesce("root", "comp").alias("comp"), F.expr(f"CASE WHEN {new} THEN pv1 ELSE pv END").alias("pv"), F.expr(f"CASE WHEN {new} THEN dist1 ELSE dist END").alias("dist"))


def _derived(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, pv) of sets with one pivot, and whether they link, from the pivot's answers and the differences to it.

    |a & b| = |pv| - |pv - a| - |pv - b| + |(pv - a) & (pv - b)| + |(a - pv) & (b - pv)|, so only the elements in which a
    set differs from its pivot are looked at; those are computed once a set, not once a pair.
    """
    own = pairs.select(F.explode(F.array("a", "b")).alias("s"), "pv").distinct()
    mine = sets.select("s", "n", "r")
    pivots = sets.select(F.col("s").alias("pv"), F.col("r").alias("rp"))
    apart = own.join(mine, "s").join(pivots, "pv").select("s", "pv", "n", F.size("rp").cast("long").alias("np"), F.array_except("rp", "r").alias("less"), F.array_except("r", "rp").alias("more"))
    left, right = (apart.select(F.col("s").alias(x), "pv", "np", *(F.col(c).alias(f"{c}_{x}") for c in ("n", "less", "more"))) for x in "ab")
    both = pairs.join(left, ["a", "pv"]).join(right.drop("np"), ["b", "pv"])
    common = F.col("np") - F.size("less_a") - F.size("less_b") + F.size(F.array_intersect("less_a", "less_b")) + F.size(F.array_intersect("more_a", "more_b"))
    return both.select("a", "b", "n_a", "n_b", common.alias("o")).select("a", "b", F.expr(f"100 * o >= {percent} * (n_a + n_b - o)").alias("link"))


STEPS = 4  # blocks of sizes for each factor 100 / percent


def _candidates(now: DataFrame, percent: int, tile: int, scratch: Scratch) -> DataFrame:
    """Pairs (x_, y_) of entries of one list, x of the larger set, of blocks that neither size nor position rules out.

    Sets x and y that link have 180 * min(n_x - p_x, n_y - p_y) >= 80 * (n_x + n_y) (for 80 percent), so an entry's
    position bounds its partner's size from above.  Lists are blocked by the sizes of both sides: an entry is put only
    into the blocks that its bound leaves open, and blocks that one side's positions rule out are never met.  A second
    bound is the unshared elements': 180 * (u_x + u_y) <= 20 * (n_x + n_y), so of two sets one at least has an excess
    180 * u - 20 * n of at most nothing, and lists are blocked by that, too.  The list's own least and greatest size
    (n0, n1) and its greatest excess (e1) keep an entry out of blocks that the list does not have.  Blocks of over ``tile`` entries are cut
    into tiles of the larger sets, with a copy of the smaller ones for each.
    """
    columns = ["s", "n", "u", "p", "comp", "pv", "dist", *(f"k{j}" for j in range(SKETCH))]

    def block(size: str) -> str:
        return f"bigint(floor(ln(double({size})) / ln({100 / percent}D) * {STEPS} + 1e-9))"

    # The largest partner by the position, and whether the set has too many unshared elements for another such set.
    most = F.expr(f"least({100 + percent} * (n - p) div {percent} - n, 100 * n div {percent})")
    rows = now.withColumn("most", F.least(most, "n1")).where(f"100 * most >= {percent} * n").withColumn("e", F.expr(f"{100 + percent} * u > {100 - percent} * n"))
    own = F.expr(block("n"))
    small = f"greatest(n0, ceil({percent} * n / 100D))"
    kinds = F.expr("CASE WHEN e OR e1 <= 0 THEN array(false) ELSE array(false, true) END")  # the kinds of partner: both cannot have the excess
    x = rows.select("h", own.alias("bx"), F.explode(F.expr(f"CASE WHEN {small} <= least(n, most) THEN sequence({block(small)}, {block('least(n, most)')}) END")).alias("by"), F.col("e").alias("ex"), kinds.alias("ey"), *(F.col(c).alias(f"x_{c}") for c in columns)).withColumn("ey", F.explode("ey"))
    y = rows.where("most >= n").select("h", F.explode(F.expr(f"sequence({block('n')}, {block('most')})")).alias("bx"), own.alias("by"), kinds.alias("ex"), F.col("e").alias("ey"), *(F.col(c).alias(f"y_{c}") for c in columns)).withColumn("ex", F.explode("ex"))
    key = ["h", "bx", "by", "ex", "ey"]
    full = x.select(*key).groupBy(*key).agg(F.count("*").alias("m")).where(f"m > {tile}").select(*key, F.expr(f"cast(1 + m div {tile} AS int)").alias("tiles"))
    full = scratch.save(full, "full")
    n = full.count()
    if not n:
        return x.join(y, key)
    full = F.broadcast(full) if n <= 200_000 else full  # 40 bytes a block; more are joined by a shuffle
    one = F.coalesce("tiles", F.lit(1))
    x = x.join(full, key, "left").withColumn("tile", F.pmod(F.hash("x_s"), one)).drop("tiles")
    y = y.join(full, key, "left").withColumn("tile", F.explode(F.sequence(F.lit(0), one - 1))).drop("tiles")
    return x.join(y, [*key, "tile"])


def _links(sets: DataFrame, percent: int, scratch: Scratch, rounds: int = 4, tile: int = 2048) -> DataFrame:
    """Links (a, b) between sets: all that are needed for the components, each verified."""
    far = 1 - percent / 100
    need = f"ceil({percent} * n / 100D)"
    # Prefix n - need + 1 of the order (unshared first, then by frequency); position p counts from 0.
    entries = sets.select("s", "n", F.expr("n - size(r)").alias("u"), F.expr(f"slice(r, 1, greatest(0, cast(size(r) - {need} + 1 AS int)))").alias("r"))
    entries = entries.select("s", "n", "u", F.posexplode("r").alias("i", "h")).select("h", "s", "n", "u", (F.col("u") + F.col("i")).alias("p"))
    entries = scratch.save(entries, "entries")
    state = scratch.save(sets.select("s", F.col("s").alias("comp"), F.col("s").alias("pv"), F.lit(0.0).alias("dist")), "state-0")
    links = []
    for i in range(rounds):
        now = entries.join(state.select("s", "comp"), "s")
        # A list's pivot: at first the set with the smallest share of elements that no other set has, which is the most
        # central of a group of near copies; then the least under an order that changes from round to round.
        rank = (F.struct((F.col("u") / F.col("n")).alias("x"), F.col("s").alias("y")) if i == 0 else F.struct(F.lit(0.0).alias("x"), F.xxhash64("s", F.lit(i)).alias("y"))).alias("o")
        lists = now.groupBy("h").agg(F.min(F.struct(rank, "s", "n", "comp")).alias("pivot"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
        tests = now.join(lists, "h").where(f"comp <> pivot.comp AND 100 * least(n, pivot.n) >= {percent} * greatest(n, pivot.n)")
        tests = tests.groupBy("s", F.col("pivot.s").alias("b")).agg(F.count("*").alias("c")).groupBy("s").agg(F.max(F.struct("c", "b")).alias("best"))
        done = scratch.save(_verified(tests.select(F.col("s").alias("a"), F.col("best.b").alias("b")), sets, percent), f"tests-{i}")
        new = done.where("link").select("a", "b")
        found = new.count()
        if found:
            links.append(new)
        # Components only ever grow: the new links join the components there are.
        label = state.select("s", "comp")
        joined = new.join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = connected_components(joined, scratch, f"pivots-{i}")
        roots = label.join(merged, F.col("comp") == F.col("node")).select(F.col("s").alias("node"), "root")
        state = scratch.save(_moved(state, done, roots), f"state-{i + 1}")
        if not found:
            break
    # The exact rest: entries of lists that still join different components, in blocks.
    now = entries.join(state, "s")
    excess = f"{100 + percent} * u - {100 - percent} * n"
    lists = now.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min(F.expr(excess)).alias("e0"), F.max(F.expr(excess)).alias("e1"))
    # An entry whose excess no other of its list makes up for has no partner there.
    now = now.join(lists.where("c0 <> c1").drop("c0", "c1"), "h").where(f"{excess} + e0 <= 0")
    now = scratch.save(now.join(now.select("s").distinct().join(sets, "s").select("s", *_sketches("r")), "s"), "open")
    both = _candidates(now, percent, tile, scratch)
    apart = " + ".join(f"bit_count(x_k{j} ^ y_k{j})" for j in range(SKETCH))
    pairs = both.where(
        "(x_n > y_n OR x_n = y_n AND x_s > y_s) AND x_comp <> y_comp"
        f" AND 100 * y_n >= {percent} * x_n"
        f" AND {100 + percent} * least(x_n - x_p, y_n - y_p) >= {percent} * (x_n + y_n)"
        f" AND NOT (x_pv = y_pv AND abs(x_dist - y_dist) > {far} + 1e-9)"
        # Unshared elements and the bits in which the sketches differ bound the symmetric difference from below.
        f" AND {100 + percent} * (x_u + y_u + {apart}) <= {100 - percent} * (x_n + y_n)"
    )
    pairs = scratch.save(pairs.select(F.col("x_s").alias("a"), F.col("y_s").alias("b"), F.when(F.col("x_pv") == F.col("y_pv"), F.col("x_pv")).alias("pv")).distinct(), "pairs")
    alone = _verified(pairs.where("pv IS NULL"), sets, percent).select("a", "b", "link")
    rest = scratch.save(alone.union(_derived(pairs.where("pv IS NOT NULL"), sets, percent)), "rest").where("link").select("a", "b")
    for part in links:
        rest = rest.union(part)
    return rest
