"""Jaccard join, substring dedup and embeddings against brute force."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from petrel.llm.components import connected_components
from petrel.llm.embedding_dedup import near_embeddings, plan
from petrel.llm.jaccard_join import jaccard_components
from petrel.llm.scratch import Scratch
from petrel.llm.substring_dedup import remove_repeats

from .helpers import documents, prose, roots, words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(map(tuple, connected_components(df, Scratch(spark, "t")).collect()))
    want = roots({x for p in links for x in p}, links)
    assert all(got.get(x, x) == r for x, r in want.items())
    assert connected_components(df.limit(0), Scratch(spark, "t")).count() == 0


def near_rows():
    rng = random.Random(1)
    rows, n = [], 0
    for group in range(12):
        base = prose(rng, 120).split()
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    # A passage that many otherwise different texts share, a hot group of copies, and the odd rows.
    passage = prose(rng, 60)
    rows += [(n + i, prose(rng, 40) + " " + passage) for i in range(40)]
    n += 40
    rows += [(n + i, "One Two three\tfour  five six seven") for i in range(300)]
    n += 300
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "ONE two"), (n + 5, "two one"), (n + 6, prose(rng, 30000)), (n + 6, "one two"), (None, "one two three four five six seven")]
    return rows


def test_jaccard_against_brute_force(spark):
    rows = near_rows()
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    flat = [(i, s) for i, many in sets.items() for s in many]
    links = []
    for x, (i, a) in enumerate(flat):
        for j, b in flat[:x]:
            if a and b and (a is b or a == b or min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b)):
                links.append((i, j))
    want = roots(sets, links)
    out = jaccard_components(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    # With every shingle that a task has three times dealt as a frequent one.
    assert sorted(map(str, jaccard_components(documents(spark, rows), hot=3).collect())) == sorted(map(str, out))
    assert sorted(map(str, jaccard_components(documents(spark, rows), hot=40, coarse=4).collect())) == sorted(map(str, out))
    for r in out:
        if r.doc_id is not None:
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
            if len(sets[r.doc_id]) == 1:
                assert r.component_id == want[r.doc_id], r
        else:
            assert r.n_shingles == 3


def test_jaccard_templates(spark, monkeypatch):
    """Texts of one template that do not link are not met pair by pair, and near ones among them are found."""
    from petrel.llm import jaccard_join

    rng = random.Random(5)
    shared = [f"t{i}" for i in range(89)]
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(15)] + shared)) for i in range(1500)]
    rows += [(2000 + i, " ".join([f"a{i}x{k}" for k in range(rng.randrange(1, 4), 15)] + shared)) for i in range(0, 60)]
    met = []
    old = jaccard_join._candidates
    monkeypatch.setattr(jaccard_join, "_candidates", lambda now, *a: met.append((now.count(), old(now, *a).count())) or old(now, *a))
    out = {r.doc_id: r.component_id for r in jaccard_components(documents(spark, rows)).collect()}
    assert out == {i: i if i < 2000 else i - 2000 for i in out}
    assert all(pairs < 20 * entries for entries, pairs in met), met


def test_jaccard_random_sets(spark):
    """Small sets with much in common, where every filter is at its bounds."""
    rng = random.Random(6)
    for _ in range(2):
        rows = []
        for i in range(160):
            w = [f"b{rng.randrange(3)}s{k}" if rng.random() < 0.12 else f"s{k}" for k in range(rng.randrange(8, 40))]
            rows.append((i, " ".join(w)))
        sets = {i: shingles(t) for i, t in rows}
        links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        want = roots(sets, links)
        assert {r.doc_id: r.component_id for r in jaccard_components(documents(spark, rows)).collect()} == want


def test_jaccard_empty(spark):
    assert jaccard_components(documents(spark, [])).count() == 0
    out = jaccard_components(documents(spark, [(1, None), (2, "")])).collect()
    assert sorted(map(tuple, out)) == [(1, 0, 1), (2, 0, 2)]


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substrings_against_brute_force(spark):
    rng = random.Random(2)
    passages = [prose(rng, n) for n in (12, 13, 14, 20, 60, 200)]
    rows = []
    for i in range(150):
        parts = [prose(rng, rng.randrange(0, 40)) for _ in range(3)] + rng.sample(passages, 2)
        rng.shuffle(parts)
        rows.append((i, rng.choice(["\n", " ", "\t\r\n"]).join(parts)))
    rows += [(200 + i, "same words " * 30) for i in range(50)] + [(300, None), (301, ""), (302, "  "), (303, prose(rng, 20000) + " " + passages[4]), (304, passages[0]), (305, passages[1]), (305, passages[1])]
    want = brute_repeats(rows)
    df = documents(spark, rows)
    assert sorted(map(tuple, remove_repeats(df, full=False).collect())) == want
    assert sorted(map(tuple, remove_repeats(df, full=False, hot=3).collect())) == want
    assert sorted(map(tuple, remove_repeats(df.repartition(6), full=False, hot=2).collect())) == want
    assert sorted(map(tuple, remove_repeats(df, full=False, hot=40, coarse=4).collect())) == want
    full = remove_repeats(df, full=True, carry=["lang", "source", "id"]).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(" ".join(words(r.kept_text)).encode()).hexdigest()) for r in full) == want
    assert all(sum(x.words for x in r.removed) == r.n_removed and r.id == "x" for r in full)
    assert all(r.kept_text == dict(rows)[r.doc_id] for r in full if r.n_removed == 0 and r.doc_id < 300)


def test_substrings_null_id_and_empty(spark):
    text = " ".join(map(str, range(20)))
    out = {r.doc_id: r.n_removed for r in remove_repeats(documents(spark, [(None, text), (5, text)]), full=False).collect()}
    assert out == {None: 20, 5: 0}
    assert remove_repeats(documents(spark, []), full=False).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (1, 2, None):
        for _ in range(6):
            center = rng.normal(size=16)
            for _ in range(25):
                rows.append((n, (center + rng.normal(size=16) * rng.choice([0.02, 0.25])).astype(np.float32).tolist(), label))
                n += 1
    hot = rng.normal(size=16).astype(np.float32).tolist()
    rows += [(n + i, hot, 1) for i in range(200)]
    n += 200
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows += [(n + i, v, 1) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("c", F.lit(1)).withColumn("h1", F.lit(2)).withColumn("n", F.lit(3))
    links = []
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for x, (i, a, la) in enumerate(good):
        for j, b, lb in good[:x]:
            if la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links.append((i, j))
    want = roots([r[0] for r in rows], links)
    count = {}
    for a, b in links:
        count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
    out = {r.vec_id: r for r in near_embeddings(df, tile=64).collect()}
    found = sum(r.n_links for r in out.values())
    assert 0.99 * 2 * len(links) <= found <= 2 * len(links)
    for i, r in out.items():
        assert r.n_links <= count.get(i, 0) and r.kept == (r.component_id == i)
    assert sum(out[i].component_id == c for i, c in want.items()) >= 0.99 * len(want)
    assert all(out[n + i].n_links == 0 for i in range(6)) and out[n + 6].n_links == 1
    assert near_embeddings(df.limit(0)).count() == 0


def test_plan_misses_few():
    import math

    for rows in (10, 10_000, 10_000_000):
        bits, tables = plan(rows, 0.93)
        p = (1 - math.acos(0.93) / math.pi) ** bits
        assert (1 - p) ** tables <= 0.003


def test_batches_of_texts_are_bounded_by_bytes(spark):
    import pyarrow as pa

    from petrel.llm import wordkernel as wk

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    before = spark.conf.get(wk.BATCH, None)
    try:
        spark.conf.unset(wk.BATCH)
        rows = spark.range(20_000).coalesce(1).selectExpr("repeat('x', 3000) AS text")
        got = wk.over_texts(rows, sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 20_000 and max(r.bytes for r in got) < 2 * wk.BATCH_BYTES
        spark.conf.set(wk.BATCH, str(1 << 20))  # a session's own bound stays
        assert max(r.bytes for r in wk.over_texts(rows, sizes, "n long, bytes long").collect()) < 2 << 20
    finally:
        spark.conf.unset(wk.BATCH)
        if before is not None:
            spark.conf.set(wk.BATCH, before)
