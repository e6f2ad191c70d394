"""K-d tree sharding: shards of near equal bytes, cut along metadata dimensions.

The tree is split from the root: a node that must become k shards is cut along its widest
dimension at the distributed weighted median (for odd k the quantile floor(k/2)/k) until
every leaf is one shard, i.e. holds the target bytes.  The coordinates are metadata of the
text alone (size, bytes per character, lines) with the text's CRC below them, and cuts lie
between positions, so equal texts have one place in the tree and stay in one shard.  Where
a median falls into a group of copies that would unbalance the cut, the group goes whole to
the nearer side that has room for it and the median of the other rows is found anew.  Only a
group that outweighs both sides of its cut (so more than a shard) is divided, by a hash of
the id.

A weighted median is found without a sort: a histogram of the node's key range, summed
map-side, is refined around the median.  All nodes of a level share each pass.  The driver
sees at most ``BINS`` sums a pass (or 256 a node, of many), whatever the input's size.  Everything is DataFrame
functions; texts are read once, the passes go over a narrow stored table.

Edge cases: a null text has no bytes and CRC 0; null ids, repeated rows and ties are
ordinary rows; fewer rows than shards leave shards empty; an empty table gives no rows;
other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .numbering import numbered
from .scratch import Scratch

BINS = 1 << 16
ROW_BYTES = 16
CRC_BITS = 32  # bits of a position below the quantised coordinate
TOP = (1 << 16) - 1
DICE = 1 << 30  # range of the id's hash
UNEVEN = 0.02  # share of a shard by which a text may move a cut before it is set aside
HOLDS = 8  # texts that one cut may set aside


def text_dimensions(text: str = "text") -> dict[str, Column]:
    """Metadata coordinates that depend on the text alone."""
    t = F.coalesce(F.col(text), F.lit(""))
    size, chars = F.octet_length(t).cast("double"), F.length(t).cast("double")
    return {"size": F.log2(size + 1), "script": F.when(chars > 0, size / chars).otherwise(F.lit(0.0)), "lines": F.log2(chars - F.length(F.translate(t, "\n", "")) + 1)}


class Node:
    """A node of the tree: ``shards`` leaves below it, from shard ``first`` on."""

    def __init__(self, shards: int, first: int = 0):
        self.shards, self.first = shards, first
        self.left = self.right = None
        self.dim = self.cut = 0
        self.held: dict[int, bool] = {}  # position of a group that goes whole: to the right?
        self.divided: tuple[int, int] | None = None  # position of a group that is cut, and the hash where

    def split(self, dim: int, cut: int, held: dict[int, bool] | None = None, divided: tuple[int, int] | None = None) -> None:
        half = self.shards // 2
        self.dim, self.cut, self.held, self.divided = dim, cut, held or {}, divided
        self.left, self.right = Node(half, self.first), Node(self.shards - half, self.first + half)

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def goes_right(self) -> str:
        """SQL condition; the texts that are set aside come first."""
        k = f"k{self.dim}"
        cases = [f"WHEN {k} IN ({', '.join(f'{p}L' for p, r in self.held.items() if r == right)}) THEN {right}" for right in set(self.held.values())]
        if self.divided:
            cases.append(f"WHEN {k} = {self.divided[0]}L THEN dice >= {self.divided[1]}L")
        return f"CASE {' '.join(cases)} ELSE {k} >= {self.cut}L END" if cases else f"{k} >= {self.cut}L"

    def expression(self, value: Callable[[Node], str]) -> str:
        """SQL of value(leaf) for the leaf that a row falls into: one decision tree, so linear in the leaves."""
        if self.left is None:
            return value(self)
        return f"CASE WHEN {self.goes_right()} THEN {self.right.expression(value)} ELSE {self.left.expression(value)} END"


class Median:
    """The search for a node's cut: where ``goal`` of the ``weight`` of its rows lies before it."""

    def __init__(self, node: Node, dim: int, lo: int, hi: int, weight: int, rows: int):
        self.node, self.dim, self.first, self.end, self.all_rows = node, dim, lo, hi, rows
        self.weight, self.goal = weight, weight * (node.shards // 2) / node.shards
        self.held: dict[int, bool] = {}
        self.inside: int | None = None  # the group whose rows are looked at by their hashes
        self._open(lo, hi, 0, rows)

    def _open(self, lo: int, hi: int, base: int, rows: int) -> bool:
        """The next pass looks at [lo, hi), before which lies ``base``."""
        self.lo, self.hi, self.base, self.rows = lo, hi, base, rows
        return False

    def bin(self, bins: int) -> str:
        """SQL of a row's bin of the open range, null for rows outside; few rows have a bin for each position."""
        self.width = 1 if self.rows <= bins else max(1, -(-(self.hi - self.lo) // bins))
        name = f"k{self.dim}" if self.inside is None else "dice"
        among = f"{name} >= {self.lo}L AND {name} < {self.hi}L"
        if self.inside is not None:
            among += f" AND k{self.dim} = {self.inside}L"
        elif self.held:
            among += f" AND {name} NOT IN ({', '.join(f'{p}L' for p in self.held)})"
        return f"CASE WHEN {among} THEN ({name} - {self.lo}L) div {self.width}L END"

    def narrow(self, found: list[tuple[int, int, int]], leaf: float, tolerance: float) -> bool:
        """Take the sums of a pass, (bin, weight, rows); True when the cut is decided."""
        found = sorted(found)
        while True:
            base = self.base
            for b, w, n in found:
                low = self.lo + b * self.width
                if low in self.held and self.inside is None:
                    continue
                if base + w >= self.goal:
                    break
                base += w
            else:
                return self._open(self.hi, self.end, base, self.all_rows) if self.inside is None and self.hi < self.end else self._done(self.hi)
            high = min(self.hi, low + self.width)
            if self.width > 1 and w > tolerance * leaf:
                return self._open(low, high, base, n)
            before, after = self.goal - base, base + w - self.goal
            if self.width > 1 or self.inside is not None or min(before, after) <= UNEVEN * leaf:
                return self._done(low if before < after else high)
            room = {False: w <= self.goal, True: w <= self.weight - self.goal}
            right = (before < after) if room[before < after] else not before < after
            if not room[right]:
                self.inside = low
                return self._open(0, DICE, base, n)
            if len(self.held) == HOLDS:
                return self._done(low if before < after else high)
            self.held[low] = right
            self.weight -= w
            if not right:
                self.goal -= w
                if self.goal < self.base and self.first < self.lo:
                    return self._open(self.first, self.lo, 0, self.all_rows)

    def _done(self, cut: int) -> bool:
        if self.inside is None:
            self.node.split(self.dim, cut, self.held)
        else:
            self.node.split(self.dim, self.inside, self.held, (self.inside, cut))
        return True


def grow_tree(points: DataFrame, dims: int, shards: int, tolerance: float = 0.001) -> Node:
    """Tree of ``shards`` leaves over points (size, k0, k1, ..., dice): 48-bit positions, one for each dimension."""
    root = Node(shards)
    stats = [F.sum("size").alias("w"), F.count("*").alias("n")] + [f(f"k{d}").alias(f"{n}{d}") for d in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    leaf = None
    while any(x.shards > 1 for x in root.leaves()):
        found = {r["node"]: r for r in points.groupBy(F.expr(root.expression(lambda x: str(x.first))).alias("node")).agg(*stats).collect()}  # a row per node
        leaf = sum(r["w"] for r in found.values()) / shards if leaf is None else leaf
        open_: dict[Node, Median] = {}
        for x in root.leaves():
            if x.shards > 1:
                r = found.get(x.first)
                if r is None:  # an empty node stays empty
                    x.split(0, 0)
                    continue
                d = max(range(dims), key=lambda d: ((r[f"hi{d}"] >> CRC_BITS) - (r[f"lo{d}"] >> CRC_BITS), -d))  # the widest
                open_[x] = Median(x, d, r[f"lo{d}"], r[f"hi{d}"] + 1, r["w"], r["n"])
        while open_:
            bins = max(256, BINS // len(open_))
            place = {x: m.bin(bins) for x, m in open_.items()}
            binned = points.select("size", F.expr(root.expression(lambda x: str(x.first))).alias("node"), F.expr(root.expression(lambda x, place=place: place.get(x, "CAST(NULL AS BIGINT)"))).alias("bin"))
            sums: dict[int, list] = {}
            for r in binned.where("bin IS NOT NULL").groupBy("node", "bin").agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect():  # BINS rows
                sums.setdefault(r["node"], []).append((r["bin"], r["w"], r["n"]))
            open_ = {x: m for x, m in open_.items() if not m.narrow(sums.get(x.first, []), leaf, tolerance)}
    return root


def kd_points(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", dimensions: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """(id, size, crc, k0, k1, ..., dice) of every row, stored, and the number of dimensions."""
    dims = dimensions or text_dimensions(text_col)
    names = [f"d{i}" for i in range(len(dims))]
    t = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.select(F.col(id_col).alias("id"), (F.octet_length(t) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("crc"), *(c.cast("double").alias(n) for n, c in zip(names, dims.values(), strict=True)))
    raw = scratch.save(raw, "raw")
    bounds = raw.agg(*(f(n).alias(f"{k}{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max)))).first()

    def place(n: str) -> Column:
        lo, hi = bounds[f"lo{n}"] or 0.0, bounds[f"hi{n}"] or 0.0
        return F.coalesce(F.floor((F.col(n) - lo) / (hi - lo) * TOP), F.lit(0)).cast("int") if hi > lo else F.lit(0)

    positions = (F.shiftleft(place(n).cast("long"), CRC_BITS).bitwiseOR(F.col("crc")).alias(f"k{i}") for i, n in enumerate(names))
    points = scratch.save(raw.select("id", "size", "crc", *positions, F.xxhash64("id").bitwiseAND(F.lit(DICE - 1)).alias("dice")), "points")
    scratch.drop("raw")
    return points, len(names)


def kd_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", dimensions: dict[str, Column] | None = None, tolerance: float = 0.001, scratch: Scratch | None = None) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) for every row; slot counts from 0 inside a shard.

    A cut misses its median by ``tolerance`` of a shard or by half of the one text that it meets."""
    scratch = scratch or Scratch(docs.sparkSession, "shards")
    points, dims = kd_points(docs, scratch, id_col, text_col, dimensions)
    tree = grow_tree(points, dims, shards, tolerance)
    spread = max(32, points.count() // (shards * 20_000))
    shard = F.expr(tree.expression(lambda x: str(x.first))).cast("int")
    placed = points.select("id", "size", "crc", shard.alias("shard"), F.pmod(F.xxhash64("id", "crc"), F.lit(spread)).alias("part"))
    placed = scratch.save(placed, "placed")
    scratch.drop("points")
    out = numbered(placed, ["shard"], "part", ["id", "crc", "size"], "slot")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")
