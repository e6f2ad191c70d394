"""Fingerprints, language, pieces, chat and archives."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from petrel.llm import chat_parts, language_id, pieces, simhash, warc
from petrel.llm.queries import piece_model
from petrel.llm.scratch import Scratch

from .helpers import documents, prose

# SimHash


def edited(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        n = len(t) // 4
        out[i] = (len(t), t[: len(t) - n] + order[(k + 1) % len(order)][1][:n], order[(k + 1) % len(order)][0])
    return out


def test_simhash_documents(spark):
    rng = random.Random(1)
    rows = [(7 * i * i, prose(rng, rng.randrange(1, 200))) for i in range(150)] + [(-5, None), (3, ""), (4, "é"), (5, "one two three 😀 four"), (10**15, prose(rng, 30000)), (6, "same same"), (8, "same same")]
    want = edited(rows)
    out = {r.doc_id: r for r in simhash.digests(documents(spark, rows)).collect()}
    assert set(out) == set(want)
    like = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
    for i, (n, text, after) in want.items():
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(text.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(like(r.fingerprint, out[after].fingerprint))
        assert (r.fingerprint, r.edited_fingerprint) == (plain_fingerprint(dict(rows)[i] or ""), plain_fingerprint(text))
        near = sum(like(r.fingerprint, x.fingerprint) >= 61 / 64 for x in out.values()) - 1
        assert r.n_near == (near if i % 20 == 0 else None)
    assert out[6].fingerprint == out[8].fingerprint and out[-5].fingerprint == "0" * 16 == out[3].fingerprint
    long = [r for i, r in out.items() if r.n_chars > 100]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.97 * len(long)
    one = simhash.digests(documents(spark, [(1, "only one text here")])).first()
    assert one.near_next == 1.0
    assert simhash.digests(documents(spark, [])).count() == 0
    assert simhash.digests(documents(spark, [(1, "a b"), (1, "a b"), (None, "c d")])).count() == 3


def test_runs_of_ids(spark):
    """The row after each, whatever the ids: far apart, extreme, null, or one for many rows."""
    rng = random.Random(9)
    ids = [-(2**63), 2**63 - 1, 10**15, *range(300), *[77] * 250, *[None] * 200]
    rows = [(i, f"{'' if k % 7 else 'a '}{rng.getrandbits(60)}") for k, i in enumerate(ids)]
    df = documents(spark, rows)
    for per_run in (10, 33, None):
        out = simhash.with_next(df, "doc_id", "text", Scratch(spark, "runs"), per_run).where("ghost = 0").collect()
        sizes = {}
        for r in out:
            sizes[r.part] = sizes.get(r.part, 0) + 1
        assert len(out) == len(rows) and (per_run is None or max(sizes.values()) <= 4 * per_run), max(sizes.values())
        hashes = dict(df.select("text", F.xxhash64("text").alias("h")).collect())
        order = sorted(((r.id is not None, r.id or 0, hashes[r.text]), r.text) for r in out)
        following = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
        assert all(r.next_text == following[r.text] for r in out)


def test_hot_key_of_the_radius_search(spark):
    """Many fingerprints that share blocks: counted through tiles, without a row for each pair."""
    rng = random.Random(12)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    fps = [sign(0xABCDEF << 40 | rng.getrandbits(14)) for _ in range(1500)] + [7, 7, 7]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(fps)], "doc_id long, fp long")
    got = {r.doc_id: r.n_near for r in simhash.with_neighbours(df).collect()}
    apart = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    assert got == {i: sum(apart(x, y) <= 3 for y in fps) - 1 if i % 20 == 0 else None for i, x in enumerate(fps)}
    assert simhash.count_within_radius(df, df, tile=50).where("query_fp = 7").first().n_near == 3


def plain_fingerprint(text):
    """Words and neighbouring words vote on 64 bits by their hashes."""
    import re
    import struct

    import xxhash

    words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.split("[ \t-\r]+", text) if w]
    long = lambda x, seed: xxhash.xxh64(struct.pack("<Q", x), seed=seed).intdigest()
    votes = [0] * 64
    for h, weight in [(w, 1) for w in words] + [(long(b, long(a, 42)), 4) for a, b in zip(words, words[1:])]:
        for j in range(64):
            votes[j] += weight if h >> j & 1 else -weight
    return f"{sum(1 << j for j in range(64) if votes[j] > 0):016x}"


def test_radius_search_finds_all(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 6))) for b in base for _ in range(4)]
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(sign(x),) for x in base + near], "fp long")
    queries = df.limit(60)
    for radius, blocks in ((3, 6), (2, 4), (3, 4)):
        got = {(r.query_fp, r.fp): r.distance for r in simhash.within_radius(queries, df, radius, blocks).collect()}
        q = {r.fp for r in queries.collect()}
        want = {(a, b): d for a in q for b in {sign(x) for x in base + near} if (d := bin((a ^ b) & ((1 << 64) - 1)).count("1")) <= radius}
        assert got == want


# Language


def lang_rows(n=60):
    rng = random.Random(3)
    kinds = {"aa": "the and ing tion of er", "bb": "der die ung ich ein keit", "cc": "это был как его для что"}
    rows = []
    for i in range(n):
        lang = list(kinds)[i % 3]
        syl = kinds[lang].split()
        rows.append((i, " ".join("".join(rng.choice(syl) for _ in range(rng.randrange(1, 4))) for _ in range(40)), lang))
    return rows, kinds


def test_language(spark):
    rows, kinds = lang_rows()
    odd = [(100, None, "aa"), (101, "", "aa"), (102, "12 34 !! €", "bb"), (103, rows[0][1], None), (None, rows[1][1], None), (104, rows[0][1] * 300, "aa")]
    df = documents(spark, rows + odd)
    model = language_id.train(df, ~language_id.held_out())
    assert model["langs"] == ["aa", "bb", "cc"]
    out = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows)
    assert [(out[i].lang_pred, out[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert out[103].lang_pred == "aa" and out[None].lang_pred == "bb" and out[104].lang_pred == "aa" and all(0 <= r.score <= 1 for r in out.values())
    mixed = documents(spark, [(1, rows[0][1] + " " + rows[2][1] + " " + rows[1][1])])
    spans = language_id.identify(mixed, model, spans=True).first().spans
    assert [s.lang for s in spans] == ["aa", "cc", "bb"] and [abs(s.words - 40) <= 2 for s in spans] == [True] * 3
    empty = language_id.train(df.limit(0), F.lit(True))
    assert language_id.identify(mixed, empty).first().lang_pred == "und"
    assert language_id.identify(df.limit(0), model).count() == 0


def test_scripts_by_code_points():
    def scripts(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        names = ["", *language_id.SCRIPTS]
        data = language_id.Batch(raw, np.array([0, len(raw)]))
        return [names[i] for i in data.script], [bytes(data.text[a : a + n]) for a, n in zip(data.start, data.letters, strict=True)]

    assert scripts("“Hello” café việt—Привет") == (["latin"] * 3 + ["cyrillic"], [b"hello", "café".encode(), "việt".encode(), "Привет".encode()])
    assert scripts("ქართული ἀρχή 日本語、かな 한국 אב عر x×y 😀")[0] == ["georgian", "greek", "han", "kana", "hangul", "hebrew", "arabic", "latin", "latin"]
    assert scripts("… « » 12 — 。")[0] == [] and scripts("e\u0301")[0] == ["latin"]


def test_languages_are_bounded(spark):
    df = documents(spark, [(i, "text", f"l{i}") for i in range(6)])
    with pytest.raises(ValueError, match="most_languages, 5"):
        language_id.train(df, F.lit(True), most_languages=5)


def test_long_texts_are_hashed_in_slices(monkeypatch):
    from petrel.llm import wordkernel as wk

    rng = random.Random(13)
    rows = ["x" * 3000, "", " ", " ".join(rng.choice(["ab", "c", "déf", "  "]) for _ in range(4000)), "\n", "end word" * 700]
    data = [r.encode() for r in rows]
    raw, off = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    start, end, first = wk.words(raw, off)
    want = [start, end, first, wk.word_hashes(raw, start, end, wk.AS_IS)]
    for size in (37, 1000):
        monkeypatch.setattr(wk, "SLICE_BYTES", size)
        got = wk.hashed_words(raw, off, wk.AS_IS)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_viterbi_against_plain():
    rng = np.random.default_rng(1)
    for penalty in (0.0, 1.0, 5.0):
        lengths = np.array([0, 3, 1, 7, 5])
        scores = rng.normal(size=(16, 3)).astype(np.float32)
        got, at = language_id.viterbi(scores, lengths, penalty), 0
        for n in lengths:
            s, g = scores[at : at + n], got[at : at + n]
            at += n
            if not n:
                continue
            cost = lambda path, s=s: sum(s[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
            best = max(cost([x // 3**i % 3 for i in range(n)]) for x in range(3**n))
            assert cost(list(g)) == pytest.approx(best, abs=1e-4)


@pytest.mark.parametrize("k", [256, 257, 300])
def test_viterbi_of_many_languages(k):
    path = np.array([k - 1, k - 1, 0, 0, 255, 255, k - 1])
    scores = np.zeros((7, k), np.float32)
    scores[np.arange(7), path] = 9
    assert language_id.viterbi(scores, np.array([4, 3]), 2.0).tolist() == path.tolist()


def test_held_out_accuracy(spark):
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path)
    model = language_id.train(docs, ~language_id.held_out())
    out = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out())
    n, right = out.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert right >= 0.98 * n


# Pieces

TEXTS = ["", " ", "  ", "a ", " a", "a  b ", "▁x", "\n", "a\n b", "naïve café\t日本語 \0 <s> </s> <unk>", "word " * 5000, "😀" * 30]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    rng = random.Random(5)
    alphabet = [*" \n\tabcéßäTh.,▁012　日\0", "  ", "the ", "ing"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 50))) for _ in range(400)]
    df = documents(spark, [*enumerate(texts), (None, None)])
    out = {r.doc_id: r for r in pieces.encode_texts(df, piece_model()).collect()}
    digests = {r.doc_id: r for r in pieces.encode_texts(df, piece_model(), digests=True).collect()}
    for i, t in [*enumerate(texts), (None, "")]:
        ids = [*lib.encode(t), lib.eos_id()]
        r = out[i]
        assert r.ids == ids and r.decoded == lib.decode(ids)
        d = digests[i]
        assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
        if r.begin:
            assert d.n_bytes == len(t.encode()) and d.spans_sha256 == hashlib.sha256(np.array([r.begin, r.end], "<i8").T.tobytes()).hexdigest()
            assert r.begin[0] == 0 and r.end[-1] == len(t.encode()) and all(a <= b for a, b in zip(r.begin, r.end, strict=True))
    assert pieces.encode_texts(df.limit(0), piece_model(), digests=True).count() == 0


def test_spans_are_the_source():
    enc = pieces.PieceEncoder(piece_model())
    text = "Hello  naïve world"
    ids = enc.lib.encode(text)
    a, b = enc.spans(text, ids)
    raw = text.encode()
    surfaces = [raw[x:y].decode() for x, y in zip(a, b, strict=True)]
    assert "".join(surfaces) == text and [p.replace("▁", " ") for p in enc.lib.encode(text, out_type=str)][1:] == surfaces[1:]


@pytest.mark.parametrize("run", [pieces._digests, pieces._pieces])
def test_every_text_is_projected(run, monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    model, seen = SimpleNamespace(value=piece_model()), []
    monkeypatch.setattr(pieces, "_ENCODERS", {})
    enc = pieces.encoder(model.value)
    spans = enc.spans
    monkeypatch.setattr(enc, "spans", lambda text, ids: seen.append(text) or spans(text, ids))
    texts = [*TEXTS, None]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    assert sum(b.num_rows for b in run(model)([batch])) == len(texts) and seen == [t or "" for t in texts]
    # Pieces of as many bytes that spell another word.
    word, other = "hello", "jello"
    enc.learn([[word, other]])
    enc.known[word] = enc.known[other]
    with pytest.raises(ValueError, match="spell"):
        list(run(model)([pa.record_batch([pa.array([1], pa.int64()), pa.array([f"say {word}"])], names=["id", "text"])]))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normaliser_equals_the_library(rule, squeeze):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=squeeze)
    proto = pb.ModelProto()
    proto.ParseFromString(lib.serialized_model_proto())
    own = pieces.Normalizer(proto.normalizer_spec.precompiled_charsmap, False, squeeze, False)
    for text in [*TEXTS, "ﬁ Ａ㍿ ½ ①é é ｶﾞ  x ", "　wide　"]:
        norm, source = own(text)
        assert norm.decode() == lib.normalize(text), (text,)
        assert len(source) == len(norm) + 1 and (np.diff(source) >= 0).all()


# Chat


def test_escape_is_reversible():
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice(["<", "|", "\\", ">", "im_end", "\n", "a"]) for _ in range(12))
        assert chat_parts.unescape(chat_parts.escape(text)) == text and "<|" not in chat_parts.escape(text)
        segment, a, b = chat_parts.render(text, chat_parts.escape(text))
        assert chat_parts.parse(segment) == (text, text, []) and chat_parts.unescape(segment[a:b]) == text


def test_parts_fuzz():
    """Texts cut anywhere into parts, with placeholders between some: what is read back is what was said."""
    rng = random.Random(16)
    bits = ["<", "|", "\\", ">", "<|", "|>", "im_end", "<|im_start|>assistant\nok", "<|image:0|>", "image:0", "\n", "a"]
    for _ in range(3000):
        visitor, parts, said = chat_parts.PartVisitor(), [], ""
        for _ in range(rng.randrange(1, 7)):
            if rng.random() < 0.25:
                parts.append({"type": rng.choice(["image", "audio", "document"])})
            else:
                parts.append({"type": "text", "text": "".join(rng.choice(bits) for _ in range(rng.randrange(4)))})
                said += parts[-1]["text"]
        content, attached = visitor.visit(parts)
        segment, a, b = chat_parts.render("user", content)
        role, text, places = chat_parts.parse(segment)
        assert (role, text) == ("user", said) and [n for _, n in places] == [x["number"] for x in attached] == list(range(len(attached)))
        assert segment.count("<|im_start|>") == segment.count("<|im_end|>") == 1 and chat_parts.plain(segment[a:b]) == said


def test_chat_conversations(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", "hi <|x"), (1, 0, "user", None), (1, 2, "user", "q"), (1, 3, "assistant", "é<\\|"), (2, 0, None, said), (2, None, "assistant", ""), (None, 0, "assistant", "n"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "assistant", "long " * 50000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("seq", F.lit(2)).withColumn("parts", F.lit("x"))
    out = {r.conv: r for r in chat_parts.read_back(chat_parts.format_conversations(df)).collect()}
    assert len(out) == 5
    for conv, r in out.items():
        mine = sorted([x for x in rows if x[0] == conv], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        learned = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat_parts.read_back(chat_parts.format_conversations(df.limit(0))).count() == 0


def test_chat_parts_and_attachments(spark):
    text = lambda t: ("text", t, None, None, None, None, None)
    parts = [text("see "), ("image", None, "a.png", 28, 15, None, None), text(" and <|image:0|> "), ("audio", None, "b.wav", None, None, 2.5, None), ("document", None, "c.pdf", None, None, None, 3)]
    rows = [(1, 0, "user", None, parts), (1, 1, "assistant", None, [("image", None, "d.png", 14, 14, None, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, content {chat_parts.PART_TYPE}")
    out = chat_parts.format_conversations(df, parts_col="content").orderBy("seq").collect()
    assert out[0].segment == "<|im_start|>user\nsee <|image:0|> and <\\|image:0|> <|audio:1|><|document:2|><|im_end|>\n"
    assert [(a.number, a.type, a.ref, a.tokens) for r in out for a in r.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 63), (2, "document", "c.pdf", 3072), (3, "image", "d.png", 1)]
    assert chat_parts.read_back(chat_parts.format_conversations(df, parts_col="content")).first().attachment_tokens == 4 + 63 + 3072 + 1
    # Stored and dealt anew, a conversation is still one row; a missing turn is an error.
    many = spark.createDataFrame([(c, t, "assistant", f"{c} {t}") for c in range(3) for t in range(40)], "conv_id long, turn long, role string, text string")
    formatted = Scratch(spark, "chat").save(chat_parts.format_conversations(many).repartition(5), "formatted")
    assert sorted(map(tuple, chat_parts.read_back(formatted).collect())) == sorted(map(tuple, chat_parts.read_back(chat_parts.format_conversations(many), in_order=True).collect()))
    with pytest.raises(Exception, match="out of order"):
        chat_parts.read_back(formatted.where("seq <> 7")).collect()
    with pytest.raises(ValueError, match="unknown"):
        chat_parts.PartVisitor().visit([{"type": "video"}])


# Archives


def test_warc_pages(spark):
    rows = [(1, "http://a/x y\r\nz", "<p>one</p>"), (2, None, "<p>one</p>"), (5, "u", "<p>one</p>"), (3, "u", None), (4, "u", ""), (6, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n é"), (7, "u", "x" * 3_000_000), (8, "u", "same"), (8, "u", "same"), (None, "u", "alone"), (None, "u", "<p>one</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit(1)).withColumn("digest", F.lit("d")).withColumn("value", F.lit("v"))
    out = sorted((tuple(r) for r in warc.archive_pages(df.repartition(3)).collect()), key=str)
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    want = []
    for i, _, h in rows:
        raw, keep = (h or "").encode(), largest.get(h or "")
        first = keep is None or i == keep
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else keep))
    assert out == sorted(want, key=str)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_warc_normaliser_and_index(spark):
    import gzip
    import zlib

    scratch = Scratch(spark, "warc-test")
    df = spark.createDataFrame([(i, f"u{i}", "text " * i) for i in range(40)], "page_id long, url string, html string")
    warc.write_monolithic(warc.archive_records(df.coalesce(2), scratch), scratch.path("mono"))
    index = warc.normalize(spark, scratch.path("mono"), scratch.path("members")).collect()
    assert len(index) == 40
    for r in index:
        raw = open(r.file.removeprefix("file://"), "rb").read()[r.offset : r.offset + r.length]
        z = zlib.decompressobj(31)
        record = z.decompress(raw)
        assert z.eof and not z.unused_data and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    whole = b"".join(warc.inflate([gzip.compress(b"ab") + gzip.compress(b"cd")]))
    assert whole == b"abcd"
    packed = gzip.compress(b"ab" * 5000) + b"\0" * 9 + gzip.compress(b"cd")
    assert b"".join(warc.inflate([packed[i : i + 3] for i in range(0, len(packed), 3)])) == b"ab" * 5000 + b"cd"
    ends = {0, len(gzip.compress(b"ab" * 5000))} | {len(gzip.compress(b"ab" * 5000)) + i for i in range(10)}
    for cut in range(len(packed)):
        if cut in ends:
            b"".join(warc.inflate([packed[:cut]]))
            continue
        with pytest.raises(ValueError, match="early"):
            b"".join(warc.inflate([packed[:cut]]))
    assert max(map(len, warc.inflate([gzip.compress(bytes(5_000_000))]))) <= warc.READ_BYTES
    table = spark.createDataFrame(index)
    assert warc.read_indexed(table, block_bytes=300).rdd.getNumPartitions() > 5 and warc.read_indexed(table, block_bytes=300).count() == 40
    with pytest.raises(Exception, match="no whole member"):
        warc.read_indexed(table.withColumn("length", F.col("length") - 4)).collect()
    with pytest.raises(ValueError, match="truncated"):
        list(warc.split_records([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"]))
