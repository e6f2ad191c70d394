"""SimHash fingerprints of whole texts, and search within a Hamming radius.

Fingerprint: each pair of neighbouring words, and each word, is a term; its 64-bit hash
votes on every bit of the fingerprint with the term's weight, up where the hash has a one
and down where not, once for each occurrence.  Pairs weigh 4 and words 1, as single words
of a language are shared by most texts.  Votes are counted two bits to a long: a row of
terms adds 32 longs, and the sums of a text combine map-side.

Search: a fingerprint is cut into ``blocks`` blocks; for every choice of blocks - radius
of them a table holds all fingerprints keyed by the bits of these blocks.  Two
fingerprints within the radius agree on all blocks of some choice (at most ``radius``
blocks can differ), so the tables find every one; the distance is then counted.  The query takes
as searches every row whose id is divisible by 20, against all rows.

Only DataFrame functions; no Python on the executors.

Edge cases: null and empty texts have the fingerprint of no votes (all zero) and are like
each other in full; one-word texts have their word only; equal texts have equal
fingerprints; null and repeated ids are rows like others (nulls come first in the order,
and are no searches); an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, Window

from .scratch import Scratch

BITS = 64
PAIR_WEIGHT, WORD_WEIGHT = 4, 1
LANES = (1 << 32) | 1


def _word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, fp long): the fingerprint of each row of texts; keys tell the rows apart."""
    words = texts.select(*keys, _word_hashes(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    # Each word with the one before it; the first row of a text has no pair, an empty text one row that votes on nothing.
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice(F.col("w"), 2, F.greatest(F.size("w") - 1, F.lit(1))).alias("b"))
    rows = words.select(*keys, F.explode_outer(pairs).alias("t")).select(*keys, F.col("t.a").alias("a"), F.col("t.b").alias("b"))
    rows = rows.select(*keys, F.coalesce("a", F.lit(0).cast("long")).alias("a"), F.coalesce(F.xxhash64("a", "b"), F.lit(0).cast("long")).alias("p"), F.col("a").isNotNull().cast("long").alias("na"), (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("long").alias("np"))
    ones = [F.sum(F.shiftright("a", j).bitwiseAND(F.lit(LANES)) * F.col("na") * WORD_WEIGHT + F.shiftright("p", j).bitwiseAND(F.lit(LANES)) * F.col("np") * PAIR_WEIGHT).alias(f"v{j}") for j in range(32)]
    sums = rows.groupBy(*keys).agg(F.sum(F.col("na") * WORD_WEIGHT + F.col("np") * PAIR_WEIGHT).alias("votes"), *ones)
    fp = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"v{j}", 32)
        fp = fp.bitwiseOR(F.when(2 * low > F.col("votes"), F.lit(1 << j)).otherwise(F.lit(0).cast("long")))
        fp = fp.bitwiseOR(F.when(2 * high > F.col("votes"), F.shiftleft(F.lit(1).cast("long"), j + 32)).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, fp.alias("fp"))


def as_text(fp: Column) -> Column:
    """Sixteen hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the bits that agree."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _masks(radius: int, blocks: int) -> list[int]:
    """The bits of each choice of blocks - radius of the blocks, as signed 64-bit numbers."""
    cut = [BITS * i // blocks for i in range(blocks + 1)]
    whole = [(1 << cut[i + 1]) - (1 << cut[i]) for i in range(blocks)]
    masks = [sum(whole[b] for b in choice) for choice in combinations(range(blocks), blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _radius_matches(queries: DataFrame, corpus: DataFrame, radius: int, blocks: int, tile: int) -> DataFrame:
    """(query_fp, found): for each table and tile the entries (fp, n, distance) within the radius.

    The fingerprints of a table that share a key travel as arrays of about ``tile`` entries (a hot key has many),
    so a query meets rows in proportion to the tiles and never a row for each entry; it looks through the arrays in place.
    """
    masks = _masks(radius, blocks)

    def tables(df: DataFrame) -> DataFrame:
        keys = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
        return df.select("*", F.explode(keys).alias("k")).select(*df.columns, "k.t", "k.key")

    wanted = tables(queries.select("fp").distinct()).select(F.col("fp").alias("query_fp"), "t", "key")
    entries = tables(corpus.groupBy("fp").agg(F.sum("n").alias("n")))
    sizes = entries.groupBy("t", "key").agg(F.count("*").alias("m")).where(f"m > {tile}")
    entries = entries.join(sizes, ["t", "key"], "left").withColumn("tile", F.coalesce(F.expr(f"pmod(xxhash64(fp), 1 + m div {tile})"), F.lit(0)))
    lists = entries.groupBy("t", "key", "tile").agg(F.collect_list(F.struct("fp", "n")).alias("many"))

    def first_table(apart: Column) -> Column:
        # A pair is found once: in the first table on whose blocks it agrees.
        return F.coalesce(*(F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)))

    near = F.filter("many", lambda e: F.bit_count(e["fp"].bitwiseXOR(F.col("query_fp"))) <= radius)
    found = wanted.join(lists, ["t", "key"]).select("query_fp", "t", near.alias("found")).where("size(found) > 0")
    found = found.select("query_fp", F.filter("found", lambda e: first_table(e["fp"].bitwiseXOR(F.col("query_fp"))) == F.col("t")).alias("found"))
    return found.where("size(found) > 0").select("query_fp", F.transform("found", lambda e: F.struct(e["fp"].alias("fp"), e["n"].alias("n"), F.bit_count(e["fp"].bitwiseXOR(F.col("query_fp"))).alias("distance"))).alias("found"))


def within_radius(queries: DataFrame, corpus: DataFrame, radius: int = 3, blocks: int = 6, tile: int = 1024) -> DataFrame:
    """(query_fp, fp, distance): all fingerprints of corpus (fp) within the radius of each of queries (fp).

    Works on distinct fingerprints, so copies cost nothing; join ids back as needed.
    """
    found = _radius_matches(queries, corpus.select("fp", F.lit(1).alias("n")), radius, blocks, tile)
    return found.select("query_fp", F.explode("found").alias("f")).select("query_fp", "f.fp", "f.distance")


def count_within_radius(queries: DataFrame, corpus: DataFrame, radius: int = 3, blocks: int = 6, tile: int = 1024) -> DataFrame:
    """(query_fp, n_near): the rows of corpus (fp) within the radius of each of queries (fp), copies counted, no pair made."""
    found = _radius_matches(queries, corpus.groupBy("fp").agg(F.count("*").alias("n")), radius, blocks, tile)
    each = found.select("query_fp", F.aggregate("found", F.lit(0).cast("long"), lambda acc, e: acc + e["n"]).alias("n"))
    return each.groupBy("query_fp").agg(F.sum("n").alias("n_near"))


RUN_ROWS = 65_536
CELLS = 4096


def _runs(rows: DataFrame, per_run: int | None) -> Column:
    """A number of about ``per_run`` neighbours in the order (id, hash), nulls first: non-decreasing along that order.

    A sketch of at most CELLS quantiles of the ids cuts them into cells of about equal rows, so ids far from all others
    or dense in places do no harm; within a cell runs are found by arithmetic on the id, in doubles, which keep the order
    and do not overflow.  An id that fills whole cells is cut by the hash of its texts.
    """
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col("id").isNull())).first()
    per_run = per_run or min(RUN_ROWS, max(32, n // 2048))
    cells = max(1, min(CELLS, -(-(n - nulls) // per_run)))
    found = rows.agg(F.percentile_approx("id", [i / cells for i in range(1, cells)] or [0.5], 16 * cells)).first()[0] or []
    low = rows.agg(F.min("id")).first()[0]
    marks = sorted({*found, *([low] if low is not None else [])})  # the first id of each cell; at most CELLS longs
    fine = max(1, -(-(n - nulls) // (cells * per_run)))  # runs of a cell
    often = [max(1, found.count(m)) * fine for m in marks]
    share = "((double(h) + 9223372036854775808D) / 18446744073709551616D)"
    null_run = f"bigint(floor({share} * {max(1, -(-nulls // per_run))})) - {1 << 40}L"
    if not marks:
        return F.expr(null_run)
    # Cells in two steps, by groups of neighbours: some hundred comparisons a row for thousands of cells.
    side = max(1, math.isqrt(len(marks)))
    groups = [marks[i : i + side] for i in range(0, len(marks), side)]
    ends = [*marks[1:], marks[-1]]

    def array(values: list, kind: str) -> str:
        return f"cast(split('{','.join(map(str, values))}', ',') AS array<{kind}>)"

    nested = f"array({', '.join(array(g, 'bigint') for g in groups)})"
    group = f"size(filter({array([g[0] for g in groups], 'bigint')}, m -> m <= id))"
    cell = f"greatest(1, ({group} - 1) * {side} + size(filter(element_at({nested}, greatest(1, {group})), m -> m <= id)))"
    keys = {
        "mark": f"element_at({array(marks, 'bigint')}, {cell})",
        "span": f"element_at({array([max(1.0, float(b) - float(a)) for a, b in zip(marks, ends, strict=True)], 'double')}, {cell})",
        "often": f"element_at({array(often, 'int')}, {cell})",
    }
    # Each cell has 2^20 numbers: the rows of its first id by their hash, then the others by their id.
    half = (1 << 19) - 1
    own = f"least({half}L, bigint(floor({share} * {keys['often']})))"
    inside = f"greatest(0L, least({half}L, bigint(floor((double(id) - double({keys['mark']})) / {keys['span']} * {fine}))))"
    return F.expr(f"CASE WHEN id IS NULL THEN {null_run} ELSE bigint({cell}) * {1 << 20}L + CASE WHEN id = {keys['mark']} THEN {own} ELSE {half + 1}L + {inside} END END")


def with_next(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, per_run: int | None = None) -> DataFrame:
    """(part, place, ghost, id, text, next_text): rows by ascending id (nulls first, equal ids by a hash of the text) with
    the text of the row after; one shuffle of texts.

    Rows are cut into runs of neighbours, and the first row of each run is also dealt to the run before it, as a ghost
    that only lends its text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = scratch.save(rows.select("id", "h"), "keys")
    part = _runs(keys, per_run)
    order = Window.orderBy("part")
    firsts = keys.select(part.alias("part"), "id", "h").groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "h")).alias("first"))
    # One row for every run: 40 bytes each, a few MB for billions of rows.
    runs = scratch.save(firsts.select("part", "first.id", "first.h", F.lag("part").over(order).alias("before"), F.max("part").over(Window.partitionBy()).alias("end")), "runs")
    ghosts = runs.select(F.col("id").alias("first_id"), F.col("h").alias("first_h"), F.coalesce("before", "end").alias("before"), F.col("before").isNull().alias("wraps"))
    ghosts = F.broadcast(ghosts) if runs.count() <= 1_000_000 else ghosts
    dealt = rows.join(ghosts, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")), "left")
    own = F.struct(part.alias("part"), F.lit(0).alias("ghost"))
    lent = F.struct(F.col("before").alias("part"), F.when(F.col("wraps"), F.lit(2)).otherwise(F.lit(1)).alias("ghost"))
    dealt = dealt.select("id", "text", "h", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, lent))).alias("d")).select("d.part", "d.ghost", "id", "text", "h")
    inside = Window.partitionBy("part").orderBy("ghost", "id", "h")
    return dealt.select("part", F.row_number().over(inside).alias("place"), "ghost", "id", "text", F.lead("text").over(inside).alias("next_text"))


def edited_text(text: Column, following: Column) -> Column:
    """text with its last quarter replaced by as many of the first code points of the following one."""
    n = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - n), F.substring(F.coalesce(following, F.lit("")), F.lit(1), n))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, per_run: int | None = None) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fp, edited_fp, next_fp) for every row, stored; fingerprints are longs."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    rows = with_next(docs, id_col, text_col, scratch, per_run)
    # A table of one row: it follows itself.
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.coalesce("next_text", "text")))
    keys = ["part", "place", "ghost", "id", "n_chars", "sha"]
    rows = rows.select("part", "place", "ghost", "id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("v"))
    fps = fingerprints(rows.select(*keys, F.col("v.kind").alias("kind"), F.col("v.text").alias("text")), [*keys, "kind"], "text")
    both = fps.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    after = F.lead("fp").over(Window.partitionBy("part").orderBy("place"))
    out = both.withColumn("next_fp", F.coalesce(after, "fp")).where("ghost = 0")
    return scratch.save(out.select(F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), "fp", "edited_fp", "next_fp"), "fingerprints")


SPREAD = 32


def with_neighbours(found: DataFrame, id_col: str = "doc_id", radius: int = 3, blocks: int = 6, every: int = 20) -> DataFrame:
    """found with n_near: for the rows whose id is divisible by ``every``, the other rows with a fingerprint within the
    radius; null for the rows that are no queries."""
    asked = F.coalesce(F.col(id_col) % every == 0, F.lit(False))
    queries = found.where(asked)
    near = count_within_radius(queries, found, radius, blocks).select("query_fp", "n_near", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    # Copies share a fingerprint, a third of the rows maybe: they are spread over SPREAD parts of the join.
    salted = queries.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SPREAD)).cast("int"))
    answered = salted.join(near, (salted["fp"] == near["query_fp"]) & (salted["salt"] == near["salt"]), "left").select(*[salted[c] for c in found.columns], (F.col("n_near") - 1).alias("n_near"))
    return answered.union(found.where(~asked).withColumn("n_near", F.lit(None).cast("long")))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near) for every row."""
    out = with_neighbours(fingerprint_documents(docs, id_col, text_col, scratch), id_col)
    return out.select(id_col, "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near")
