"""Sharding, numbering, mixing and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from petrel.llm import kd_shards as kd
from petrel.llm.kd_shards import kd_shards
from petrel.llm.mixing import capped_targets, mix_sources, solve_dual
from petrel.llm.numbering import numbered
from petrel.llm.scratch import Scratch

from .helpers import documents, prose, words


def test_numbering_is_gapless(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 7).alias("g"), (F.col("id") % 13).alias("b"))
    out = defaultdict(list)
    for r in numbered(df, ["g"], "b", ["id"], "slot").collect():
        out[r.g].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in out.values())


def test_kd_shards(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(1, 300))) for i in range(1500)] + [(5000 + i, "one copied text, many times") for i in range(700)] + [(9000, None), (9001, ""), (9002, "é" * 5), (None, "no id"), (1, "again"), (1, "again"), (9003, prose(rng, 4000))]
    out = kd_shards(documents(spark, rows), shards=8).collect()
    assert len(out) == len(rows)
    by, text = defaultdict(list), defaultdict(list)
    for i, t in rows:
        text[i].append(((len((t or "").encode()) + 16), zlib.crc32((t or "").encode())))
    for r in out:
        assert (r["size"], r.text_crc32) in text[r.doc_id]
        by[r.shard].append(r)
    assert set(by) == set(range(8))
    sizes = [sum(r["size"] for r in x) for x in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in out)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    assert sorted(map(tuple, kd_shards(documents(spark, rows), shards=8).select("doc_id", "shard").collect()), key=str) == sorted(((r.doc_id, r.shard) for r in out), key=str)


def test_kd_small_inputs(spark):
    assert kd_shards(documents(spark, []), shards=40).count() == 0
    out = kd_shards(documents(spark, [(1, "a"), (2, "b")]), shards=5).collect()
    assert len(out) == 2 and all(0 <= r.shard < 5 for r in out)
    # Equal texts meet in one shard.
    rng = random.Random(2)
    rows = [(i, prose(rng, 50)) for i in range(2000)] + [(9000 + i, "twins of a text") for i in range(2)]
    twins = {r.shard for r in kd_shards(documents(spark, rows), shards=4).where("doc_id >= 9000").collect()}
    assert len(twins) == 1


def plain_tree(rows, shards, dims, leaf, tolerance, first=0):
    """{row: shard} by a K-d tree over sorted rows (k0, k1, ..., size, dice), each cut searched from the start."""
    if shards == 1:
        return {i: first for i, *_ in rows}
    half = shards // 2
    right = set()
    if rows:
        wide = [(max(r[1][d] for r in rows) >> 32) - (min(r[1][d] for r in rows) >> 32) for d in range(dims)]
        d = wide.index(max(wide))
        held, weight = {}, sum(r[2] for r in rows)
        goal, cut, divided = weight * half / shards, None, None
        while cut is None:
            groups = defaultdict(int)
            for r in rows:
                if r[1][d] not in held:
                    groups[r[1][d]] += r[2]
            base = 0
            for k in sorted(groups):
                w = groups[k]
                if base + w >= goal:
                    break
                base += w
            else:
                cut = max(r[1][d] for r in rows) + 1
                break
            before, after = goal - base, base + w - goal
            side = before < after
            room = [w <= goal, w <= weight - goal]
            if min(before, after) <= kd.UNEVEN * leaf:
                cut = k if side else k + 1
            elif not any(room):
                divided, cut = k, k
            elif len(held) == kd.HOLDS:
                cut = k if side else k + 1
            else:
                held[k] = side if room[side] else not side
                weight -= w
                goal -= 0 if held[k] else w
        if divided is not None:
            for x in sorted({r[3] for r in rows if r[1][d] == divided}):
                w = sum(r[2] for r in rows if r[1][d] == divided and r[3] == x)
                if base + w >= goal:
                    at = x if goal - base < base + w - goal else x + 1
                    break
                base += w
        for r in rows:
            k = r[1][d]
            if held.get(k, r[3] >= at if k == divided else k >= cut):
                right.add(r[0])
    low, high = [r for r in rows if r[0] not in right], [r for r in rows if r[0] in right]
    return plain_tree(low, half, dims, leaf, tolerance, first) | plain_tree(high, shards - half, dims, leaf, tolerance, first + half)


def test_kd_tree_against_plain(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(1, 200)) + "\n" * rng.randrange(4) for _ in range(700)]
    texts += ["a copied text of some words"] * 400 + [prose(rng, 90)] * 30 + [texts[5]] * 20 + ["é ü"] * 15 + [None, "", ""]
    df = documents(spark, list(enumerate(texts)))
    points, dims = kd.kd_points(df, Scratch(spark, "kd-test"))
    rows = [(r.id, [r[f"k{d}"] for d in range(dims)], r["size"], r.dice) for r in points.collect()]
    for shards in (7, 16):
        leaf = sum(r[2] for r in rows) / shards
        want = plain_tree(rows, shards, dims, leaf, 0.0)
        got = {r.doc_id: r for r in kd_shards(df, shards=shards, tolerance=0.0).collect()}
        assert {i: r.shard for i, r in got.items()} == want
        groups, weight = defaultdict(set), defaultdict(int)
        for i, r in got.items():
            groups[r.text_crc32].add(r.shard)
            weight[r.text_crc32] += r["size"]
        assert all(len(x) == 1 for crc, x in groups.items() if weight[crc] < leaf)
        sizes = [sum(r["size"] for r in got.values() if r.shard == s) for s in range(shards)]
        assert max(sizes) - min(sizes) < 0.2 * leaf


def test_targets():
    assert capped_targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = capped_targets([10, 100, 100], [5, 2, 1])
    assert got[0] == 30 and sum(got) == pytest.approx(210) and got[1] == pytest.approx(120)
    assert capped_targets([0, 10], [5, 2]) == [0, 10] and capped_targets([], []) == [] and capped_targets([0, 0], [1, 1]) == [0, 0]


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(0, 120)), "en", rng.choice(["b", "a", "Z", None, "é"])) for i in range(1200)]
    rows += [(2000 + i, "hot copy of a text", "en", "a") for i in range(1500)] + [(4000, None, "en", "a"), (None, "no id", "en", "b"), (4001, prose(rng, 5000), "en", "tiny"), (4002, "  ", "en", "only-blank")]
    df = documents(spark, rows)
    out = mix_sources(df).collect()
    assert len(out) == len(rows)
    names = sorted({r[3] for r in rows if r[3]}) + [None]
    sizes = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in names}
    want = dict(zip(names, capped_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r["size"] * r.copies
    for s in names:
        least = min((len(words(r[1])) for r in rows if r[3] == s and words(r[1])), default=0)
        assert abs(taken[s] - want[s]) <= max(least, 1) or s == "tiny", (s, taken[s], want[s])
    again = mix_sources(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.copies)
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert mix_sources(df.limit(0)).count() == 0


def test_dual_against_bisection(spark):
    import math

    rng = random.Random(4)
    counts = [(s, n, rng.randrange(1, 9)) for s in range(4) for n in rng.sample(range(1, 400), 60)]
    sizes = {s: sum(n * m for t, n, m in counts if t == s) for s in range(4)}
    targets = {0: 2.5 * sizes[0], 1: 0.3 * sizes[1], 2: 1.0 * sizes[2], 3: 3.0 * sizes[3]}
    got = solve_dual(spark.createDataFrame(counts, "sid int, size long, n long"), targets, sizes, 16.0, 3)
    for s, want in targets.items():
        total = lambda lam, s=s: sum(n * m * min(3, math.exp(lam * n / (n + 16))) for t, n, m in counts if t == s)
        low, high = -50.0, 50.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if total(middle) < want else (low, middle)
        assert total(got[s]) == pytest.approx(want, rel=1e-8)
        assert s == 3 or got[s] == pytest.approx(high, abs=1e-6)


def test_shared_folder():
    from types import SimpleNamespace as S

    from petrel.llm.scratch import shared_dir

    def session(master, folder=None):
        return S(sparkContext=S(master=master, getConf=lambda: {"spark.checkpoint.dir": folder}), conf=S(get=lambda *a: None))

    assert shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(session("local[4]")).startswith("file:///")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://a:7077"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_dir(session(master))


def test_sources_are_bounded(spark):
    df = documents(spark, [(i, "a b", "en", f"s{i}") for i in range(5)])
    with pytest.raises(ValueError, match="5 sources"):
        mix_sources(df, most_sources=4)


def test_pipeline_against_plain_stages(spark):
    """The stages one by one on planted documents: what each must keep, drop and cut."""
    import corpus_pipeline as c

    rng = random.Random(7)
    syllables = "the and ing tion of er ly re".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(4)) + str(rng.randrange(99))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(120), "en", f"s{i % 4}") for i in range(80)]
    rows += [(100, rows[3][1], "en", "s1"), (101, " ".join([*rows[4][1].split()[:118], "changed", "ending"]), "en", "s2")]
    passage = text(60)
    rows += [(110, text(50) + " " + passage, "en", "s0"), (111, passage + " " + text(70), "en", "s0"), (112, passage, "en", "s3"), (120, None, "en", "s0"), (121, "123 456", "en", "s0"), (122, "", None, None), (3, rows[3][1], "en", "s3")]
    docs = documents(spark, rows)
    kept = c.language(spark, docs, "")
    assert kept.columns == c.COLUMNS and {r[0] for r in rows} - {r.doc_id for r in kept.collect()} == {120, 121, 122}
    kept = c.near_dups(spark, spark.createDataFrame(kept.collect(), kept.schema), "")
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({*range(80), 110, 111, 112})
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    cut = {r.doc_id: r for r in c.substrings(spark, kept, "").collect()}
    assert set(cut) == set(ids) - {112}
    assert words(cut[111].text) == words(rows[83][1])[60:] and cut[110].text == rows[82][1] and cut[111].n_chars == len(cut[111].text)
    mixed = c.mix(spark, spark.createDataFrame(list(cut.values()), kept.schema), "")
    assert mixed.columns == c.COLUMNS and 0 < mixed.count() <= 3 * len(cut)
    out = c.encode(spark, mixed, "")
    assert out.count() == mixed.count() and [n for n, _ in c.STAGES] == ["language", "near_dups", "substrings", "mix", "pieces"]
    # Mixing and pieces, row by row: every source near its target, no row over three times, and the library's ids.
    extra = [(500, "equal rows of some words", "en", "s1")] * 5 + [(None, text(9), "en", "s2"), (None, text(11), "en", "s2"), (501, text(8), "en", "s0"), (501, text(14), "en", "s0")]
    before = list(cut.values()) + documents(spark, extra, clash=False).select(c.COLUMNS).collect()
    mixed = c.mix(spark, spark.createDataFrame(before, kept.schema), "").collect()
    had, got = Counter((r.doc_id, r.text, r.source) for r in before), Counter((r.doc_id, r.text, r.source) for r in mixed)
    assert all(n <= 3 * had[r] for r, n in got.items())
    names = sorted({r.source for r in before})
    sizes = [sum(len(words(r.text)) for r in before if r.source == s) for s in names]
    for s, want in zip(names, capped_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True):
        least = min(len(words(r.text)) for r in before if r.source == s)
        assert abs(sum(len(words(t)) * n for (_, t, of), n in got.items() if of == s) - want) <= least
    import sentencepiece

    from petrel.llm.queries import piece_model

    lib = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in mixed:
        ids = [*lib.encode(r.text), lib.eos_id()]
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))))
    out = c.encode(spark, spark.createDataFrame(mixed, kept.schema), "").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    empty = docs.limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, empty, "").count() == 0
