"""Mixing, SimHash, packing, language ID and language-model scoring against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cognatus.llm import langid, maxent, mixing, packing, simhash
from cognatus.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 30_000


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = {"en": "the of and to in is it that was for".split(), "de": "der die das und ist nicht ein mit für auf".split()}
    docs = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "a", "b", "."]) for _ in range(rng.randrange(1, 80)))
        docs.append([i, text, lang, rng.choice(["s1", "s2", "é", None]), len(text)])
    for i in range(30, 45):
        docs[i][1] = docs[30][1]
    for i in range(50, 60):
        docs[i][1] = docs[50][1] + f" tail{i}"
    docs += [[200, None, "en", "s1", None], [201, "", None, None, 0], [202, " \t\n\x0b\x0c\r", "en", "s1", 6], [203, "A B c\x1cd", None, "s2", 7], [204, LONG, "en", "s1", len(LONG)]]
    docs += [[None, "null id", "en", "s2", 7], docs[3], docs[3], [205, "ßS İ \u0001 <|endoftext|> don't 12,5 😀".encode("utf-16", "surrogatepass").decode("utf-16"), "de", "s2", 3]]
    return [tuple(d) for d in docs]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


# -- mixing


def water_level(sizes, weights, total, cap=2.0):
    target, open_ = {}, set(sizes)
    left = total
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] > cap * sizes[s]}
        if not full:
            return target | {s: unit * weights[s] for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark, docs):
    sized = docs.withColumn("size", mixing.word_count("text")).withColumn("taken", F.lit("clash"))
    got = mixing.mix_sources(sized.select("doc_id", "source", "size", "taken")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((d[0] is None, d[0], len(words(d[1]))) for d in corpus() if d[0] is not None)
    sizes = Counter()
    for d in corpus():
        sizes[d[3]] += len(words(d[1]))
    order = [*sorted(s for s in sizes if s is not None), None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = water_level(sizes, weights, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        largest = max(len(words(d[1])) for d in corpus() if d[3] == s)
        assert abs(taken[s] - want[s]) <= max(0.03 * want[s], largest if s == "s1" else 0), s
    again = mixing.mix_sources(sized.repartition(7).select("doc_id", "source", "size"))
    assert Counter((r["doc_id"], r["taken"]) for r in again.collect()) == Counter((r["doc_id"], r["taken"]) for r in got)


def test_mixing_empty(empty):
    assert mixing.mix_sources(empty.withColumn("size", F.lit(1))).count() == 0


def test_newton_meets_targets(spark):
    rng = np.random.default_rng(2)
    size, n = rng.integers(0, 5000, 400), rng.integers(1, 9, 400)
    total = float((size * n).sum())
    shares = (0.0, 0.01, 0.5, 1.0, 1.7, 1.999, 2.0)
    strata = [(k, share * total, int(s), int(c)) for k, share in enumerate(shares) for s, c in zip(size, n, strict=True)]
    found = mixing.newton_duals(spark.createDataFrame(strata, "rank int, target double, size long, n long"), 2.0).collect()
    assert sorted(r["rank"] for r in found) == list(range(len(shares)))
    for r in found:
        rate = mixing.tilted(size, r["lam"], r["mean"], 2.0)
        assert (n * size * rate).sum() == pytest.approx(shares[r["rank"]] * total, rel=1e-6)
        assert rate.min() >= 0 and rate.max() <= 2


# -- SimHash


def fingerprint(text, k):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, k):
    fps = [(d[0], fingerprint(d[1], k)) for d in rows]
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                label[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(fps):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, fp, least.get(find(i))) for i, (doc, fp) in enumerate(fps))


@pytest.mark.parametrize("k", [3, 5])
def test_simhash(docs, k):
    got = simhash.simhash_groups(docs, shingle=k).collect()
    assert Counter((r["id"], r["fp"] % (1 << 64), r["component"]) for r in got) == brute_groups(corpus(), k)


@pytest.mark.parametrize("tile", [16, 4096])
def test_ring_join_is_complete(spark, tile):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(fps)[:6]:
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in simhash.fingerprint_links(df, tile=tile).collect():
        a, b = r["src"] % (1 << 64), r["dst"] % (1 << 64)
        parent[find(max(a, b))] = find(min(a, b))
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                assert find(a) == find(b)
    rank = Counter(find(x) for x in fps)
    assert len(rank) >= 290


def test_near_duplicates_dropped(docs, empty):
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()]
    want = {c for (_, _, c) in brute_groups([d for d in corpus() if d[0] is not None], 5)}
    assert Counter(kept) == Counter([*want, None])
    assert simhash.drop_near_duplicates(empty).count() == 0


# -- packing


def test_packing(spark, docs, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [r.asDict() for r in packing.pack(docs, tokenizer_path(), window=256, step=16, keep_ids=True).collect()]
    want = Counter()
    for d in corpus():
        ids = [*tokenizer.encode(d[1] or "", add_special_tokens=False).ids, 1]
        want[d[0], tuple(ids)] += 1
    by_doc = {}
    for r in rows:
        assert r["length"] == len(r["ids"]) and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by_doc.setdefault(r["id"], []).append(r)
    for (doc, ids), n in want.items():
        own = by_doc.pop(doc)
        assert all(r["doc_tokens"] == len(ids) and tuple(r["ids"]) == ids[r["start"] : r["start"] + r["length"]] for r in own)
        cover = Counter(i for r in own for i in range(r["start"], r["start"] + r["length"]))
        assert cover == Counter({i: n for i in range(len(ids))})
    assert not by_doc
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 256
    assert sum(filled.values()) / (256 * len(filled)) > 0.97
    assert packing.pack(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("hot", [0, 40])
def test_plan_uses_every_piece(hot):
    rng = random.Random(3)
    histogram = {c: rng.randrange(0, 500) for c in range(64)}
    histogram[hot] += 20_000
    slots, used = packing.plan_slots(histogram, 64, 3)
    room = Counter()
    for c in range(1, 64):
        own = sorted((s for s in slots if s.cls == c), key=lambda s: s.first)
        assert sum(s.count for s in own) == histogram[c]
        assert [s.first for s in own] == [sum(x.count for x in own[:i]) for i in range(len(own))]
        for s in own:
            for k in range(s.count):
                if s.each:
                    room[s.sequence + k // s.each] += c
                for step in range(s.start + k * c, s.start + k * c + c) if not s.each else ():
                    room[s.sequence + step // 64] += 1
    assert set(room) == set(range(used)) and max(room.values()) <= 64
    assert sum(room.values()) > 64 * (used - 1)


def test_joined_checksums():
    data = bytes(range(256)) * 3
    assert packing.join_crcs([zlib.crc32(data[i : i + 64]) for i in range(0, len(data), 64)], 64) == zlib.crc32(data)


def test_nnls():
    rng = np.random.default_rng(1)
    a, x = rng.random((20, 35)), np.zeros(35)
    x[:6] = rng.random(6) * 10
    s = packing.nnls(a, a @ x)
    assert s.min() >= 0 and np.abs(a @ s - a @ x).max() < 1e-6


def test_word_ids_equal_plain_encoding():
    import pyarrow as pa

    from cognatus.llm.text import ragged, split_words

    plain = Tokenizer.from_file(tokenizer_path())
    encode = packing.WordIds(tokenizer_path())
    rng = random.Random(1)
    letters = "abcABCéÉßΣσςİı'’.,;1٣ \n\t\x0b 　é\u0001<|endoftext|>的ﬁÅ"
    for _ in range(500):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        codes, vocabulary, _ = split_words(pa.array([t]), None if "<|" in t else "ascii")
        flat, start, length = encode(vocabulary)
        assert flat[ragged(start[codes], length[codes])].tolist() == plain.encode(t, add_special_tokens=False).ids


# -- language ID


def test_language_id(docs, empty):
    got = langid.language_ids(docs.withColumn("score", F.lit("clash"))).select("doc_id", "lang", "text", "held_out", "lang_pred", "score").collect()
    assert len(got) == len(corpus())
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["text"] is None or not re.search(r"[^\W\d_]", r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "de")
    right = [r["lang_pred"] == r["lang"] for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 200]
    assert sum(right) / len(right) > 0.8  # texts of a word or two are among them
    assert langid.language_ids(empty).count() == 0
    untaught = langid.language_ids(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r["lang_pred"] for r in untaught] == ["und"]


def test_held_out_accuracy(spark):
    got = langid.language_ids(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out AND lang_pred <> 'und'")
    row = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert row["right"] > 0.98 and row["n"] > 150


def test_labels_do_not_leak(docs):
    model = langid.train(docs.where(langid.learns_from()))
    a = langid.predict(docs, model).select("doc_id", "lang_pred", "score")
    b = langid.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("q")), model).select("doc_id", "lang_pred", "score")
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


def test_temperature():
    rng = np.random.default_rng(0)
    z = rng.standard_normal((4000, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=row) for row in p])
    assert langid.fit_temperature(z * 3, y) == pytest.approx(3, rel=0.15)


# -- language model


def test_language_model(docs, empty):
    got = [r.asDict() for r in maxent.score_documents(docs).collect()]
    tokens = [(d[0], [w.lower() for w in words(d[1])] + [None]) for d in corpus()]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in tokens for w in t if not held(i))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for i, t in tokens)
    assert Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] <= 0 for r in got)
    assert maxent.score_documents(empty).count() == 0


def test_model_beats_base_on_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = maxent.score_documents(d).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row["s"] > row["b"] * 0.81  # all weights at zero gave 0.817: the unseen word alone


def test_nothing_to_learn_from(docs):
    got = maxent.score_documents(docs, trains=F.lit(False)).collect()
    assert all(abs(r["score"]) < 1e-6 and r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)


@pytest.fixture(scope="module")
def trained(docs):
    rows = docs.select(F.col("doc_id").alias("id"), "text", maxent.learns_from().alias("trains"))
    parts = maxent.materialize(maxent.tokenize(rows, maxent.fit_topics(rows)))
    counted = maxent.materialize(maxent.count_words(parts))
    vocabulary = maxent.make_vocabulary(counted)
    coded = maxent.materialize(maxent.code_parts(parts, counted, vocabulary, 2))
    model = maxent.train(coded, vocabulary)
    known = {}  # hash -> count and topic
    for part in parts.collect():
        h, at = np.frombuffer(part["hashes"], "<u8"), 0
        for r in counted.where(F.col("part") == part["part"]).orderBy("bucket").collect():
            counts, topics = np.frombuffer(r["counts"], f"<u{r['count_width']}"), np.frombuffer(r["topics"], np.uint8)
            known |= {int(x): (int(n), int(t)) for x, n, t in zip(h[at : at + len(counts)], counts, topics, strict=True)}
            at += len(counts)
    return vocabulary, model, known, maxent.score_parts(coded, vocabulary, model)


def slots_of(vocabulary, known):
    """Hash -> slot, log of the probability within it, feature."""
    out = {}
    for h, (n, t) in known.items():
        head = vocabulary.heads.get(h)
        slot, inner = vocabulary.place(np.array([n]), np.array([t]), [] if head is None else [0], [] if head is None else [head])
        out[h] = int(slot[0]), float(inner[0]), h >> 20 & 0xFFFFFFFF if n >= maxent.KNOWN_FEATURE else int(slot[0]) + 1
    return out


def plain_rows(before, bits, cls=None):
    """Rows of weights for the three features before a token, the nearest first, in plain integers."""
    one, two, three, m = *before, 0xFFFFFFFF
    out = []
    for k, x in enumerate((one, two, three, (one * 0x9E3779B1 & m) ^ two, (one * 0x85EBCA77 & m) ^ three)):
        h = (x + k * 0x3C6EF372 & m) * 0x2C1B3C6D & m
        h ^= h >> 15
        if cls is not None:
            h = (h ^ ((cls + 1) * 0x7FEB352D & m)) * 0x846CA68B & m
            h ^= h >> 16
        out.append((h * 0x297A2D39 & m) >> 32 - bits)
    return out


def plain_softmax(weights, bias, rows):
    z = bias.astype(float) + sum(weights[k, r].astype(float) for k, r in enumerate(rows))
    return np.exp(z) / np.exp(z).sum()


def test_probabilities_add_up(trained):
    vocabulary, model, known, _ = trained
    assert any(np.abs(w).max() > 0.05 for w in model)
    (wide, narrow), table = vocabulary.biases(), slots_of(vocabulary, known)
    unseen = maxent.CLASSES * maxent.SLOTS - 1
    features = [f for _, _, f in table.values()]
    for before in ((0, 0, 0), (features[0], 0, 0), (features[1], features[2], features[3])):
        p = plain_softmax(model[0], wide, plain_rows(before, vocabulary.bits))
        q = [plain_softmax(model[1], narrow[c], plain_rows(before, vocabulary.bits, c)) if narrow[c].max() > -1e3 else None for c in range(maxent.CLASSES)]
        total = p[maxent.ONCE] * np.exp(vocabulary.place(np.array([0]), np.array([0]), [], [])[1][0])
        for h, (slot, inner, _) in table.items():
            if known[h][0]:
                assert slot != unseen
                total += p[slot // maxent.SLOTS] * q[slot // maxent.SLOTS][slot % maxent.SLOTS] * np.exp(inner)
        assert total == pytest.approx(1, abs=1e-4)


def test_scores_against_brute_force(trained, docs):
    vocabulary, model, known, scored = trained
    model = [w.astype(np.float16).astype(float) for w in model]
    (wide, narrow), table = vocabulary.biases(), slots_of(vocabulary, known)
    want = []
    for r in docs.collect():
        own = [w.lower() for w in words(r["text"])]
        if len(own) > 500:
            continue
        features, total = [0, 0, 0], 0.0
        for h in [*map(maxent.word_hash, own), maxent.END]:
            slot, inner, feature = table[h]
            cls, before = slot // maxent.SLOTS, features[:-4:-1]
            total += inner + np.log(plain_softmax(model[0], wide, plain_rows(before, vocabulary.bits))[cls])
            if slot != maxent.CLASSES * maxent.SLOTS - 1:
                total += np.log(plain_softmax(model[1], narrow[cls], plain_rows(before, vocabulary.bits, cls))[slot % maxent.SLOTS])
            features.append(feature)
        want.append((str(r["doc_id"]), len(own) + 1, total / np.log(10)))
    got = sorted(((str(r["id"]), r["n_tokens"], r["score"]) for r in scored.collect() if r["n_tokens"] <= 501), key=str)
    want.sort(key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-4, abs=1e-4)


def test_topics_are_fitted_to_all_texts(docs):
    """The sample only starts them: a cluster's probabilities are those of all its texts."""
    rows = docs.select(F.col("doc_id").alias("id"), "text", maxent.learns_from().alias("trains"))
    start, got = maxent.first_topics(rows, 20), maxent.fit_topics(rows, 20)
    sums = np.zeros((maxent.TOPICS, maxent.BINS_OF_WORDS))
    for r in rows.where("trains").select("text").collect():
        piece = maxent.pa.RecordBatch.from_arrays([maxent.pa.array([r["text"]], maxent.pa.string())], names=["text"])
        tokens, _, hashes = maxent._hashed(piece)
        bins = maxent._word_bins(hashes)[tokens]
        np.add.at(sums[int(np.argmax(start[bins].sum(axis=0)))], bins, 1)
    want = np.log((sums + 0.1) / (sums + 0.1).sum(axis=1, keepdims=True)).T
    assert np.allclose(got, want, atol=1e-4) and not np.allclose(got, start, atol=1e-2)
