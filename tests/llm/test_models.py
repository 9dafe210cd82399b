"""Operators that SQL can't express, against brute force, round trips and held-out rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelspan.llm import class_lm, components, decontaminate, html_text, licenses, ngram_join, packing, pii, quality, tiff, token_counts
from reelspan.llm.common import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def ids(rows):
    tokenizer = Tokenizer.from_file(PATH)
    return {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in rows.items()}


def test_token_counts_equal_the_library(spark, docs, ids):
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, PATH).collect()} == {d: len(x) for d, x in ids.items()}


def test_token_counts_of_strange_texts():
    rng, tokenizer, counter = random.Random(3), Tokenizer.from_file(PATH), token_counts.Counter(PATH)
    texts = ["", " ", "  a", "a  ", "a \n b", "it's  we'LL", "<|endoftext|>a<|endoftext|>", "aaaa" * 50, " x  y\x1c z", "日本語 テキスト", "x" * 3000, "½ ²3 ①"]
    texts += ["".join(rng.choice("ab '\n\t.é1 😀 ") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    assert counter.counts(texts) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_packing_loses_nothing(docs, ids):
    pieces = packing.pack(docs.repartition(5), PATH).collect()
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        whole = [*ids[p["doc_id"]], 1]
        part = whole[p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] > 0 and p["doc_tokens"] == len(whole)
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == p["ids_crc32"]
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sum(p["length"] for p in pieces) == sum(len(x) + 1 for x in ids.values())
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(p["length"] for p in pieces)
    assert len(by_sequence) * 2048 - total < 2048 + 0.005 * total


def brute_tiles(a, b, least=5):
    used_a, used_b, total = [0] * len(a), [0] * len(b), 0
    while True:
        best, places = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best:
                    best, places = n, [(i, j)]
                elif n == best >= least:
                    places.append((i, j))
        if best < least:
            return total
        for i, j in places:
            if not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                used_a[i : i + best] = used_b[j : j + best] = [1] * best
                total += best


def test_tiles_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        a = [rng.randrange(200) for _ in range(rng.randint(5, 30))]
        b = [rng.randrange(200) for _ in range(rng.randint(0, 10))]
        for _ in range(4):
            p = rng.randint(0, len(a))
            b += [*a[p : p + rng.randint(3, 14)], 999]
        assert sum(n for _, _, n in decontaminate.tiles(a, b)) == brute_tiles(a, b)


def test_reordered_passages_are_leaks(spark):
    words = [f"w{i}" for i in range(60)]
    item = " ".join(words)
    moved = " ".join([*words[40:], "and", "then", *words[20:40], "before", *words[:20]]).title() + "!"
    part, few = " ".join(words[:25]), " ".join(words[i] for i in range(0, 60, 2))
    texts = spark.createDataFrame([(1, "x " + item), (2, moved), (3, part), (4, few)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    for size in (1 << 20, 40):
        got = {(r["doc_id"], r["n_tiles"]) for r in decontaminate.contamination(texts, bench, chunk_bytes=size).collect()}
        assert got == {(1, 1), (2, 3)}


def test_leaks_in_the_tables(spark, small, docs, rows):
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    flat = lambda t: " " + b" ".join(decontaminate.words_of(t)).decode() + " "
    want = {(d, i) for d, t in rows.items() for i, b in bench.items() if flat(b) in flat(t)}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert want and want <= got


def test_class_model_against_plain_counts(docs, rows):
    counts = collections.Counter()
    for d, t in rows.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update(t.encode().lower().split())
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    for hot in (50, 200_000):
        got = {r["doc_id"]: r for r in class_lm.score(docs, hot_words=hot).collect()}
        model = base = 0.0
        for d, t in rows.items():
            words = [*t.encode().lower().split(), b""]
            assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
            assert math.isclose(got[d]["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
            if got[d]["held_out"]:
                model, base = model + got[d]["score"], base + got[d]["base_score"]
        assert model > base


def test_exchange_finds_classes():
    rng = random.Random(5)
    size, groups = 31, 3
    kind = [0, *[1 + i % groups for i in range(size - 1)]]
    grid = np.zeros((size, size))
    before = 0
    for _ in range(20_000):
        group = 1 + (kind[before] % groups)
        after = rng.choice([i for i in range(1, size) if kind[i] == group])
        grid[before, after] += 1
        before = after
    cls = class_lm.exchange(grid, classes=4)
    assert len({(cls[i], kind[i]) for i in range(1, size)}) == 3


def test_gains_are_those_of_the_whole_likelihood():
    rng = np.random.default_rng(4)
    for _ in range(20):
        grid, cls, s = rng.integers(0, 6, (12, 12)).astype(float), np.r_[0, rng.integers(1, 5, 11)], int(rng.integers(1, 12))

        def whole(c, grid=grid, cls=cls, s=s):
            one = np.zeros((12, 5))
            one[np.arange(12), np.where(np.arange(12) == s, c, cls)] = 1
            g = one.T @ grid @ one
            return class_lm.f(g).sum() - class_lm.f(g.sum(0)).sum() - class_lm.f(g.sum(1)).sum()

        others = np.arange(12) != s
        one = np.zeros((12, 5))
        one[np.arange(12), cls] = 1
        one[s] = 0
        gain = class_lm.gains(one.T @ grid @ one, grid[s, others] @ one[others], grid[others, s] @ one[others], grid[s, s])
        assert np.allclose(gain[1:] - gain[1], [whole(c) - whole(1) for c in range(1, 5)])


@pytest.mark.parametrize("rest", [True, False])
def test_exchange_ends(rest):
    rng = np.random.default_rng(9)
    for size in (2, 3, 10, 60, 120):
        cls = class_lm.exchange(rng.integers(0, 9, (size, size)).astype(float), classes=48, rest=rest)
        assert cls[0] == 0 and (cls[1 : size - rest] > 0).all() and (not rest or cls[-1] == 48)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    moves = rng.integers(0, 50, (6, 5)).astype(float)
    counts, classes = rng.integers(1, 9, 200), rng.integers(1, 5, 200)
    counts, classes = np.r_[40, counts], np.r_[0, classes]
    totals = np.array([[counts[classes == c].sum(), (classes == c).sum(), (counts[classes == c] == 1).sum(), (counts[classes == c] == 2).sum()] for c in range(5)], dtype=float)
    totals[3] = 0  # a class without words
    seen = classes != 3
    model = class_lm.Model(moves, totals)
    for history in range(6):
        words = (10 ** (model.follow[history, classes[seen]] + model.emission(counts[seen], classes[seen]))).sum()
        assert math.isclose(words + 10 ** model.unseen[history], 1, rel_tol=1e-9)


def test_base_spans_equal_the_stated_patterns():
    rng = random.Random(2)
    stated = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = pii.only_digits
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), "phone": lambda m: 10 <= len(digits(m)) <= 15}
    pieces = ["a@b.co", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111 1111 1111 1111", "+1 (017) 555-7713", "@", ".", "-", " ", "x", "7", "+", "é", "1.2.3.4.5.6.7.8", "a@b@c.d.", "00000000000000"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        want = [(m.start(), m.end(), k) for k, p in stated.items() for m in re.finditer(p, t) if ok[k](m[0])]
        assert pii.base_spans(t) == sorted(want, key=pii.order), t


def test_spans_of_generated_sentences():
    model = pii.trained()
    found = wanted = right = 0
    for text, gold in pii.sentences(150, seed=99):
        base, spans = pii.find(text, model)
        assert set(base) <= set(spans)
        found, wanted, right = found + len(spans), wanted + len(gold), right + len(set(spans) & set(gold))
    assert right >= 0.9 * wanted and right >= 0.85 * found


def test_segments_equal_brute_force():
    model = pii.trained()
    text = "+1 (826) 555-4081 190."
    tokens, spans = pii.candidates(text, 0, len(text))
    score = {(i, j, y): float(model.weights[model.ids_of(pii.span_features(text, tokens[i][0], tokens[j - 1][1], j - i)), y - 1].sum()) for i, j in spans for y in range(1, 6)}

    def best(i, before):
        if i == len(tokens):
            return 0.0, ()
        options = [(model.follow[before, 0] + best(i + 1, 0)[0], best(i + 1, 0)[1])]
        options += [(model.follow[before, y] + s + best(j, y)[0], ((i, j, y), *best(j, y)[1])) for (a, j, y), s in score.items() if a == i]
        return max(options)

    assert model.decode(text, 0, len(text)) == [(tokens[i][0], tokens[j - 1][1], pii.KINDS[y - 1]) for i, j, y in best(0, 0)[1]]


def test_redaction_leaves_clean_texts(docs, rows):
    for r in pii.redact(docs).collect():
        base, spans = pii.find(rows[r["doc_id"]], pii.trained())
        assert (r["text"] == rows[r["doc_id"]]) == (not spans)
        assert r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])


@pytest.mark.parametrize("data", [b"", b"a", bytes(1000), b"ab" * 9000, np.random.default_rng(1).integers(0, 256, 70_000, dtype=np.uint8).tobytes(), np.random.default_rng(2).integers(0, 3, 90_000, dtype=np.uint8).tobytes()])
def test_codes_round_trip(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data and tiff.packbits_decode(tiff.packbits_encode(data)) == data
    payload = tiff.payload_of(data)
    assert b"".join(s.tobytes() for _, _, s in tiff.pages(tiff.store(payload))) == payload


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tiled", [True, False])
def test_pages_round_trip(spark, compression, predictor, tiled):
    rng = np.random.default_rng(compression)
    images = [rng.integers(0, 9, size, dtype=np.uint8) for size in ((5, 3), (150, 70), (64, 64))]
    file = tiff.write_tiff([(i, compression, predictor, tiled) for i in images])
    for image, (_, _, samples) in zip(images, tiff.pages(file), strict=True):
        assert (samples[:, :, 0] == image).all()


def test_big_endian_16_bit_rgb():
    values = (np.arange(2 * 3 * 3).reshape(2, 3, 3) * 1000).astype(">u2")
    data = values.tobytes()
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 3), (278, 3, 2), (279, 4, len(data))]
    import struct

    body = b"MM\0*" + struct.pack(">I", 8 + len(data)) + data + struct.pack(">H", len(tags))
    for tag, kind, value in tags:
        body += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">HH", value, 0) if kind == 3 else struct.pack(">I", value))
    (_, _, samples), = tiff.pages(body + b"\0\0\0\0")
    assert (samples == values).all()


def test_broken_files_give_reasons(spark):
    good = tiff.store(tiff.payload_of(b"x" * 100))
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"II*\0junk"), (4, bytearray(good)), (5, bytearray(good[:60]))], "doc_id long, media binary")
    got = {r["doc_id"]: (r["page"], r["error"]) for r in tiff.decode_pages(df).collect()}
    assert got[4] == (0, None) and all(got[i][0] is None and got[i][1] for i in (1, 2, 3, 5))


def ifd(tags, data, big=False):
    """A file of one page: tags as (tag, kind, value), the data from byte 8 on."""
    import struct

    e = ">" if big else "<"
    body = (b"MM\0*" if big else b"II*\0") + struct.pack(e + "I", 8 + len(data)) + data + struct.pack(e + "H", len(tags))
    for tag, kind, value in sorted(tags):
        body += struct.pack(e + "HHI", tag, kind, 1) + (struct.pack(e + "HH", value, 0) if kind == 3 else struct.pack(e + "I", value))
    return body + b"\0\0\0\0"


def strip(width, height, bits, data, compression=1, **more):
    names = {"samples": 277, "predictor": 317, "format": 339, "rows": 278}
    return [(256, 4, width), (257, 4, height), (258, 3, bits), (259, 3, compression), (273, 4, 8), (279, 4, len(data)), *((names[k], 3, v) for k, v in more.items())]


def test_streams_written_by_hand():
    # the example of the format's text for PackBits, and LZW codes 256, 45, 258, 258, 65, 259, 66, 257
    assert tiff.packbits_decode(bytes.fromhex("FEAA028000 2AFDAA0380002A22F7AA".replace(" ", ""))) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes, bits = [256, 45, 258, 258, 65, 259, 66, 257], ""
    for c in codes:
        bits += format(c, "09b")
    bits += "0" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big")
    assert tiff.lzw_decode(data) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_small_samples(bits):
    rng = np.random.default_rng(bits)
    values = rng.integers(0, 1 << bits, (5, 11), dtype=np.uint8)
    rows = [int("".join(format(v, f"0{bits}b") for v in row).ljust(-(-11 * bits // 8) * 8, "0"), 2).to_bytes(-(-11 * bits // 8), "big") for row in values.tolist()]
    data = b"".join(rows)
    for compression, stored in ((1, data), (32773, tiff.packbits_encode(data))):
        (_, _, got), = tiff.pages(ifd(strip(11, 5, bits, stored, compression), stored))
        assert (got[:, :, 0] == values).all()


def test_floats_with_their_predictor():
    values = np.linspace(-3, 1e9, 28, dtype=np.float32).reshape(4, 7)
    planes = values.astype(">f4").view("u1").reshape(4, 7, 4).transpose(0, 2, 1).reshape(4, 28)
    stored = zlib.compress(np.diff(planes, axis=1, prepend=np.zeros((4, 1), "u1")).tobytes())
    (_, _, got), = tiff.pages(ifd(strip(7, 4, 32, stored, 8, predictor=3, format=3), stored))
    assert (got[:, :, 0] == values).all()


def test_claims_of_a_header_are_not_believed(spark):
    data = bytes(64)
    bad = [ifd(strip(w, h, 8, data, c, **more), data) for w, h, c, more in ((0, 8, 1, {}), (8, 0, 1, {}), (8, 8, 7, {}), (4_000_000, 4_000_000, 8, {}), (60_000, 4000, 1, {}), (8, 8, 1, {"rows": 0}), (8, 8, 1, {"samples": 0}), (8, 8, 1, {"predictor": 9}), (8, 8, 8, {}), (16, 8, 1, {}))]
    bad += [ifd([(256, 4, 8), (257, 4, 8), (258, 3, 8), (322, 4, 0), (323, 4, 0), (324, 4, 8), (325, 4, 64)], data), b"II*\0\0\0\0\0"]
    good = tiff.store(tiff.payload_of(b"word " * 9000))
    rng = random.Random(3)
    for _ in range(150):
        broken = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            broken[rng.choice((rng.randrange(len(good)), len(good) - 1 - rng.randrange(400)))] = rng.randrange(256)
        bad.append(bytes(broken))
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bad)], "doc_id long, media binary")
    got = collections.defaultdict(list)
    for r in tiff.decode_pages(df).select("doc_id", "page", "error").collect():
        got[r["doc_id"]].append((r["page"], r["error"]))
    assert len(got) == len(bad) and all(len(got[i]) == 1 and got[i][0][1] for i in range(12))
    assert any(e is None for i in range(12, len(bad)) for _, e in got[i])


def test_a_page_that_cannot_be_read_leaves_the_others(spark):
    file = bytearray(tiff.write_tiff([(np.full((4, 4), k, dtype=np.uint8), tiff.NONE, 1, False) for k in range(3)]))
    at = file.index(b"\x03\x01\x03\0\x01\0\0\0\x01")  # the compression of the first page
    file[at + 8] = 7
    rows = tiff.decode_pages(spark.createDataFrame([(1, file)], "doc_id long, media binary")).orderBy("page").collect()
    assert [(r["page"], r["n_pages"], r["error"] is None, r["compression"]) for r in rows] == [(0, 3, False, "7"), (1, 3, True, "none"), (2, 3, True, "none")]


def test_quality_on_held_out_rows(spark, docs, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = quality.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.85 * len(got)
    again = quality.score(docs.repartition(3), labels.repartition(2)).join(labels, "doc_id").where("held_out").collect()
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in got}


def test_rules_as_columns_equal_rules_in_numpy(spark, docs, small):
    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    stats = quality.with_stats(docs).withColumn("s", model.column()).collect()
    x = np.array([[r[s] for s in quality.STATS] for r in stats])
    assert np.allclose(model.score(x), [r["s"] for r in stats])


def test_rules_are_sparse():
    rng = np.random.default_rng(0)
    x = rng.random((1500, len(quality.STATS)))
    y = ((x[:, 3] > 0.6) | (x[:, 7] <= 0.2)).astype(float)
    model = quality.fit(x, y)
    fresh = rng.random((500, len(quality.STATS)))
    right = (model.score(fresh) >= 0.5) == ((fresh[:, 3] > 0.6) | (fresh[:, 7] <= 0.2))
    assert right.mean() > 0.95 and len(model.rules) < 120


def brute_components(texts, words=4, percent=85):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    order = sorted(texts)
    for i, a in enumerate(order):
        for b in order[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in texts}, {d: len(s) for d, s in sets.items()}


def test_join_equals_brute_force_on_the_tables(docs, rows):
    want, sizes = brute_components(rows)
    got = ngram_join.join(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and {r["doc_id"]: r["n_shingles"] for r in got} == sizes


@pytest.mark.parametrize(("limit", "block"), [(16, 1 << 17), (2, 300)])
def test_join_equals_brute_force_on_a_large_group(spark, limit, block):
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    base, shared = [word() for _ in range(90)], [word() for _ in range(60)]
    texts = {}
    for d in range(160):
        t = list(base)
        for _ in range(rng.randrange(7)):
            t[rng.randrange(len(t))] = word()
        texts[d] = " ".join(t)
    for d in range(160, 220):
        texts[d] = " ".join([*shared, *(word() for _ in range(rng.randrange(14)))])
    texts |= {220: base[0], 221: base[0].upper(), 222: " ".join(base[:3]), 223: ""}
    want, _ = brute_components(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(df, pair_limit=limit, block_tokens=block).collect()}
    assert got == want and len(set(want.values())) < 160


def test_prefixes_keep_every_link():
    rng = random.Random(11)
    tokens = np.arange(400, dtype=np.int64)
    order = ngram_join.Order(tokens[:50], np.array([rng.randrange(3, 5000) for _ in range(50)]))
    for _ in range(300):
        n = rng.randint(1, 60)
        a = set(rng.sample(range(400), n))
        b = set(a)
        for _ in range(rng.randrange(5)):
            b.discard(rng.choice(sorted(a)))
            b.add(rng.randrange(400))
        if not b or 100 * len(a & b) < 85 * len(a | b):
            continue
        (pa_, ka, _), (pb, kb, _) = (order.prefix(np.array(sorted(s), dtype=np.int64)) for s in (a, b))
        assert len(set(pa_.tolist()) & set(pb.tolist())) >= min(ka, kb)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7), (None, 1)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(links, Scratch(spark, "chain")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == 99


PAGE = "<html><head><title>T</title></head><body><nav><ul><li><a>menu {n}</a></ul></nav><div class='cookie-notice'>We use cookies</div><{box}><h1>Head {n}</h1><p>One &amp; two<br>three {n}<p>Last <b>one</b> {n}</{box}><aside>side {n}</aside><div id=comments><p>A reader says {n}</div><form><p>Search</form><footer>foot</footer><script>var a='<p>x</p>';</script></body></html>"


def test_main_text(spark):
    pages = [(i, "http://a.example/x", PAGE.format(n=i, box="article")) for i in range(30)] + [(i, "https://b.example/y", PAGE.format(n=i, box="div")) for i in range(30, 60)]
    pages += [(60, None, None), (61, "http://a.example/z", "<p>no frame"), (62, "x", "<a <b>>&lt;&#233;"), (63, "http://c.example", "<!-- <article>a</article>")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(60):
        assert got[i]["text"] == f"Head {i}\n\nOne & two three {i}\n\nLast one {i}"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[60]["text"] == "" and got[61]["text"] == "no frame" and got[63]["text"] == ""


def test_template_texts_are_dropped_and_optional_parts_align(spark):
    box = "<body><main><div class=share_bar>Share</div><section>Advice from our team</section><section class=body><p>text {n} {m}</p>{extra}</section></main></body>"
    pages = [(i, "http://h/x", box.format(n=i, m="word " * (i % 5 + 3), extra="<ul><li>more</ul>" * (i % 3))) for i in range(40)]
    got = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r["text"].startswith(f"text {r['page_id']} word") and r["text"].count("more") == r["page_id"] % 3 for r in got)


def test_wrappers_fold_repeats():
    tree = html_text.wrapper_of(html_text.parse("<body>" + "<div class=a>x</div><div class=b>y</div>" * 9 + "</body>"))
    body = tree["c"][0][0]
    assert [(html_text.label(c), c[2]) for c in body["c"]] == [("div.a", True), ("div.b", True)]


def test_page_text_of_the_tables(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        inner = re.search(r"<article>(.*)</article>", source[r["page_id"]], re.S)[1]
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b.replace("<b>", "").replace("</b>", ""))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"].split() == "\n\n".join(b for b in blocks if b).split()


def test_license_statements():
    scanner = licenses.Scanner()
    for name, text in licenses.TEMPLATES:
        text = text.replace("<any>", "2020 Jane Doe")
        found = scanner.scan(f"Some words before.\n{text}\nAnd after it.")
        assert [(f[2], f[6]) for f in found] == [(name, "exact")], text
        start, end = found[0][:2]
        assert f"Some words before.\n{text}"[start:end] == text
    assert scanner.scan("no terms here\nThe license of the poet") == []
    assert scanner.scan("x. Licensed under CC BY-NC 4.0. y")[0][2] == "CC-BY-NC-4.0"
    assert scanner.scan("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without any restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to these conditions:")[0][6] == "modified"


def test_license_lines_of_the_tables(docs, rows):
    stated = ["This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."]
    want = sorted(d for d, t in rows.items() for s in stated for _ in range(t.count(s)))
    assert want == sorted(r["doc_id"] for r in licenses.scan_licenses(docs).collect())


def test_pipeline_against_its_parts(spark, small, docs, rows):
    import corpus_pipeline

    labels, bench = spark.read.parquet(f"{small}/labels.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    kept = {r["doc_id"] for r in quality.score(docs, labels).where("predicted = 1").collect()}
    groups, _ = brute_components({d: rows[d] for d in kept}, words=5, percent=80)
    kept = {d for d in kept if groups[d] == d}
    kept -= {r["doc_id"] for r in decontaminate.contamination(docs.where(F.col("doc_id").isin(*kept)), bench).collect()}
    tokenizer, model = Tokenizer.from_file(PATH), pii.trained()
    want = {d: len(tokenizer.encode(pii.redacted(rows[d], pii.find(rows[d], model)[1]), add_special_tokens=False).ids) + 1 for d in kept}
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, small).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want and 0 < len(want) < len(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
