"""Mixing, language ID and the whole pipeline against plain versions of themselves."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cognatus.llm import langid, mixing
from cognatus.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = {"en": "the of and to in is it that was for on with as his they at be this from have".split(), "de": "der die das und ist nicht ein mit für auf dem sich den von zu im sie war bei".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "", "a", "be", "so", "en"]) for _ in range(n))


def corpus(seed=2):
    """Documents, with pairs planted on either side of a similarity of 0.8, and the odd cases."""
    rng, docs = random.Random(seed), []
    for i in range(160):
        lang = rng.choice(["en", "de"])
        docs.append([i, prose(rng, lang, rng.randrange(20, 120)), lang, rng.choice(["s1", "s2", "é", None]), 1])
    for i in range(0, 60, 2):
        words = docs[i][1].split()
        for _ in range(i % 10):
            words[rng.randrange(len(words))] = f"other{rng.randrange(1000)}"
        docs[i + 1][1:3] = [" ".join(words), docs[i][2]]
    docs += [[200, None, "en", "s1", 0], [201, "", None, None, 0], [202, "12 34 56", "en", "s1", 8], [203, docs[80][1], "de", "s2", 1], [204, "lorem ipsum " * 3000, "en", "s1", 1]]
    docs += [docs[3], docs[3], [205, docs[81][1].upper(), "en", "s2", 1]]
    return [tuple(d) for d in docs]


def sizes_of(text):
    return len([w for w in (text or "").replace("\x1c", "x").split() if w])


def plain_copies(sizes, target, cap=2.0):
    """Size -> ``(base, ups)`` of one source: rates by bisection, rounded from long to short."""
    count = Counter(sizes)
    mean = sum(sizes) / max(1, sum(1 for s in sizes if s))
    rate = lambda lam, s: min(cap, math.exp(min(700, lam * s / mean)))
    low, high = -1e3, 1e3
    for _ in range(300):
        lam = (low + high) / 2
        low, high = (lam, high) if sum(n * s * rate(lam, s) for s, n in count.items()) < target else (low, lam)
    out, error = {0: (1, 0)}, 0.0
    for s in sorted((s for s in count if s), reverse=True):
        r = rate(lam, s) if target < cap * sum(sizes) * (1 - 1e-12) else cap
        base = math.floor(r + 1e-9)
        part = max(0.0, r - base)
        error += count[s] * part * s
        ups = min(count[s], max(0, round(error / s))) if part > 1e-9 else 0
        error -= ups * s
        out[s] = base, ups
    return out


def plain_targets(sizes):
    """Source -> target; sizes are lists by source."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(map(sum, sizes.values())), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s: 2.0 * sum(sizes[s]) for s in free if share[s] > 2.0 * sum(sizes[s])}
        if not over:
            return full | share
        full |= over


def strata_totals(rows):
    """``(source, size) -> copies`` that the mix owes, for rows ``(source, size)``."""
    sizes = defaultdict(list)
    for source, size in rows:
        sizes[source].append(size)
    targets, out = plain_targets(sizes), {}
    for source, own in sizes.items():
        plan = plain_copies(own, targets[source])
        for size, n in Counter(own).items():
            base, ups = plan[size]
            out[source, size] = base * n + ups
    return out


def test_copies(spark):
    df = spark.createDataFrame(corpus(), SCHEMA).select("doc_id", "source", mixing.word_count("text").alias("size"))
    got = mixing.mix_sources(df).collect()
    want = strata_totals([(r["source"], r["size"]) for r in got])
    have = Counter()
    for r in got:
        have[r["source"], r["size"]] += r["copies"]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    assert {k: n for k, n in have.items() if n} == {k: n for k, n in want.items() if n}


def test_reruns_agree_on_repeated_ids(spark):
    rows = [(i % 3 if i % 2 else None, f"text {i}", "s" if i % 5 else "t", 7) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    one, two = (sorted(((r["text"], r["copies"]) for r in mixing.mix_sources(x, buckets=4).collect())) for x in (df.repartition(3), df.repartition(7, "text")))
    assert one == two and len({n for _, n in one}) > 1


def plain_ngrams(text, dims):
    out = Counter()
    for word in text.lower().split():
        points = [32, *map(ord, word), 32]
        for n in (1, 2, 3):
            for at in range(len(points) - n + 1):
                gram = points[at : at + n]
                if (n == 1 and gram[0] == 32) or 32 in gram[1 : n - 1] or (n > 1 and at == len(points) - 1):
                    continue
                h = 2166136261 + n
                for p in gram:
                    h = (h ^ p) * 16777619 & 0xFFFFFFFF
                    h ^= h >> 15
                out[(h * 2654435769 & 0xFFFFFFFF) >> 32 - (dims - 1).bit_length()] += 1
    return out


def test_language_id_against_plain_version(spark):
    dims = 1 << 12
    rows = [d for d in corpus(5) if d[1] is not None and len(d[1]) < 5000]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(df, dims=dims, epochs=2)
    hashed = df.select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("h")).where("lang IS NOT NULL").collect()
    learned = sorted((r for r in hashed if any(c.isalpha() for c in r["text"])), key=lambda r: (r["h"], r["lang"]))
    grams = [plain_ngrams(r["text"], dims) for r in learned]
    df_of = Counter(f for g in grams for f in g)
    idf = {f: (math.log((1 + len(grams)) / (1 + n)) + 1) * 20 for f, n in df_of.items()}
    labels = ["de", "en"]
    value = [[(f, np.float32(np.float32(n / sum(g.values())) * idf[f])) for f, n in sorted(g.items())] for g in grams]
    keep = [i for i in range(len(learned)) if i % 5 != 4]
    z, n, order = defaultdict(float), defaultdict(float), np.random.default_rng(7)

    def weight(key):
        if abs(z[key]) <= 1e-3:
            return 0.0
        return -(z[key] - math.copysign(1e-3, z[key])) / ((1.0 + math.sqrt(n[key])) / 0.5 + 1e-3)

    def softmax(logits):
        e = [math.exp(x - max(logits)) for x in logits]
        return [x / sum(e) for x in e]

    for _ in range(2):
        for i in order.permutation(len(keep)):
            row = [*value[keep[i]], ("bias", 1.0)]
            w = {(f, c): weight((f, c)) for f, _ in row for c in range(2)}
            p = softmax([sum(float(x) * w[f, c] for f, x in row) for c in range(2)])
            p[labels.index(learned[keep[i]]["lang"])] -= 1
            for f, x in row:
                for c in range(2):
                    g = float(x) * p[c]
                    sigma = (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / 0.5
                    z[f, c] += g - sigma * w[f, c]
                    n[f, c] += g * g
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()}
    for r in learned:
        g = plain_ngrams(r["text"], dims)
        logits = [sum(c / sum(g.values()) * idf[f] * weight((f, k)) for f, c in g.items()) + weight(("bias", k)) for k in range(2)]
        p = softmax([x / model.temperature for x in logits])
        assert got[r["text"]][0] == labels[int(np.argmax(p))]
        assert got[r["text"]][1] == pytest.approx(max(p), abs=1e-3)


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_representatives(rows):
    """Ids that near-dedup keeps of ``(id, text)``."""
    own = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for at, (i, a) in enumerate(own):
        for j, b in own[at + 1 :]:
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i for i, _ in own if find(i) == i}


def test_pipeline(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.language_ids(df).collect()}
    spoken = [r for r in rows if told[r[0]][0] != "und" and told[r[0]][1] >= corpus_pipeline.LEAST_SCORE]
    assert {200, 201, 202}.isdisjoint(r[0] for r in spoken)
    kept = plain_representatives([(r[0], r[1]) for r in spoken])
    assert len({r[0] for r in spoken}) - 20 < len(kept) < len({r[0] for r in spoken}) - 5  # some pairs are near, some are not
    left = {r[0]: r for r in spoken if r[0] in kept}
    owed = strata_totals([(r[3], sizes_of(r[1])) for r in left.values()])

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = Tokenizer.from_file(tokenizer_path()).encode
    ids = {i: [*encode(r[1], add_special_tokens=False).ids, 1] for i, r in left.items()}
    tokens, spans = Counter(), defaultdict(list)
    for p in pieces:
        own = ids[p["doc_id"]]
        part = own[p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] > 0 and p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        tokens[p["doc_id"]] += p["length"]
        spans[p["sequence_id"]].append((p["offset"], p["length"]))
    have = Counter()
    for i, n in tokens.items():
        copies, rest = divmod(n, len(ids[i]))
        assert rest == 0 and copies <= 2
        have[left[i][3], sizes_of(left[i][1])] += copies
    assert have == Counter({k: n for k, n in owed.items() if n})
    for own in spans.values():
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist() and sum(n for _, n in own) <= 2048
