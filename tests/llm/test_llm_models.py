"""The language, quality and toxicity queries against plain loops over the whole tables."""

import math
import unicodedata
from collections import Counter
from zlib import crc32

import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from creditloom.llm import language, quality, toxicity
from creditloom.llm.queries import QUERIES
from creditloom.llm.text import table

MIDDLE = "/root/testdata/sf0.01"
FULL = 2**64


def documents(spark, folder):
    order = F.xxhash64(F.lit("order"), F.col("doc_id").cast("string"), F.col("text"))
    rows = table(spark, folder, "documents").select("doc_id", "text", "lang", order.alias("at"))
    return {r.doc_id: r for r in rows.collect()}


def labels(spark, folder, label, of, held):
    """Labels that may be learned from, by document."""
    rows = table(spark, folder, "labels").where(F.col(label).isNotNull()).collect()
    return {r.doc_id: float(r[label]) for r in rows if crc32(str(r.doc_id).encode()) % of != held}


def words(text, lowered):
    """Runs of letters and digits of a text; all beyond ASCII counts as a letter."""
    out, word = [], ""
    for c in lowered(text):
        if c >= "\x80" or "a" <= c <= "z" or "0" <= c <= "9":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] if word else out


def test_languages_by_loops(spark):
    docs, bundler = documents(spark, SMALL), language.Bundler()

    def profile(text):
        simple = [c.lower()[0] if unicodedata.category(c.lower()[0])[0] == "L" else " " for c in text or ""]
        spaced = " " + " ".join("".join(simple).split()) + " "
        out = np.zeros(language.SIZE)
        for run, n in Counter(zip(spaced, spaced[1:], spaced[2:])).items():
            a, b, c = (bundler.letter(0 if x == " " else ord(x)).astype(int) for x in run)
            out += n * np.roll(a, 2) * np.roll(b, 1) * c
        return out

    profiles = {i: profile(r.text) for i, r in docs.items()}
    sums = {}
    for i, r in docs.items():
        if r.lang is not None and crc32(str(i).encode()) % 3 != 1:
            sums[r.lang] = sums.get(r.lang, 0) + profiles[i]
    found = {r.doc_id: r for r in QUERIES["op1_language"](spark, SMALL).collect()}
    assert set(found) == set(docs)
    for i, own in profiles.items():
        if not own.any():
            assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
            continue
        near = {k: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for k, v in sums.items()}
        assert near[found[i].lang_pred] >= max(near.values()) - 1e-5
        assert abs(found[i].score - max(near.values())) < 1e-4


def terms(text):
    """Counts of a text's terms by place, as the module's docstring has them."""
    shapes = []
    for b in (text or "").encode():
        letter = 97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else b
        shape = 57 if 48 <= b <= 57 else letter
        if not shapes or shapes[-1] != shape:
            shapes.append(shape)
    out = Counter()
    for run in zip(shapes, shapes[1:], shapes[2:], shapes[3:]):
        out[(int.from_bytes(bytes(run), "big") * 2654435761 % 2**32) >> 23] += 1
    found = words(text or "", lambda t: "".join(c.lower() if c < "\x80" else c for c in t))
    if found:
        n, weight, last = len(found), max(4.0, len(shapes) / 8), quality.BANDS - 1
        at = quality.BUCKETS
        out[at + min(last, int(len(set(found)) / n**0.9 * 8))] = weight
        pairs = len(set(zip(found, found[1:])))
        out[at + quality.BANDS + min(last, int(pairs / n * last))] = weight
        out[at + 2 * quality.BANDS + min(last, int(math.log2(n)))] = weight / 4
        for word in found:
            mixed = crc32(word.encode()) * 0x9E3779B97F4A7C15 % FULL
            out[at + 3 * quality.BANDS + (mixed >> 54)] += 1
    return out


def test_quality_by_loops(spark):
    """Singular vectors of the labelled documents, all cosines, the votes of the nearest 15."""
    docs, known = documents(spark, MIDDLE), labels(spark, MIDDLE, "quality", 4, 2)
    known = {i: y for i, y in known.items() if i in docs}
    counts = {i: terms(r.text) for i, r in docs.items()}
    seen = Counter(t for i in known for t in counts[i])

    def weighted(i):
        out = np.zeros(quality.WIDTH)
        for t, n in counts[i].items():
            out[t] = math.log1p(n) * math.log((1 + len(known)) / (1 + seen[t]))
        return out

    unit = [weighted(i) / max(np.linalg.norm(weighted(i)), 1e-9) for i in known]
    axes = np.linalg.svd(np.stack(unit), full_matrices=False)[2][: quality.DIMENSIONS]
    latent = {i: axes @ weighted(i) for i in docs}
    latent = {i: v / max(np.linalg.norm(v), 1e-9) for i, v in latent.items()}
    found = {r.doc_id: r for r in QUERIES["op5_quality"](spark, MIDDLE).collect()}
    assert set(found) == set(docs)
    apart = 0
    for i in docs:
        near = sorted(((float(latent[i] @ latent[j]), y) for j, y in known.items()), reverse=True)
        border = near[quality.NEIGHBOURS - 1][0] - 1e-9
        votes = [(max(s, 0.0) ** 8, y) for s, y in near if s >= border]
        total = sum(w for w, _ in votes)
        share = sum(w * y for w, y in votes) / total if total else sum(known.values()) / len(known)
        # neighbours equally near but for rounding may change places at the border
        apart += abs(found[i].score - share) > 1e-3
        assert found[i].predicted == int(found[i].score >= 0.7)
    assert apart <= 0.01 * len(docs)


def places(text):
    """Places of a text's words, pairs and pairs with one word between, each once."""
    codes = [crc32(w.encode()) for w in words(text or "", str.lower)]
    mix = [int(m) for m in toxicity._MIX]
    codes = [c * mix[0] % FULL for c in codes]
    every = codes + [(a * mix[1] % FULL) ^ b for a, b in zip(codes, codes[1:])]
    every += [(a * mix[2] % FULL) ^ b for a, b in zip(codes, codes[2:])]
    return {((m ^ m >> 29) * mix[3] % FULL) >> (64 - toxicity.BITS) for m in every}


def test_toxicity_by_loops(spark):
    """One coordinate at a time: z, n and the weight that follows from them."""
    docs, known = documents(spark, SMALL), labels(spark, SMALL, "toxic", 5, 0)
    features = {i: places(r.text) for i, r in docs.items()}
    order = sorted((i for i in known if i in docs), key=lambda i: docs[i].at)
    rule, z, n = toxicity.FTRL(), Counter(), Counter()

    def weight(at):
        if abs(z[at]) <= rule.l1:
            return 0.0
        strength = (rule.smooth + math.sqrt(n[at])) / rule.rate + rule.l2
        return (math.copysign(rule.l1, z[at]) - z[at]) / strength

    def chance(at):
        return 1 / (1 + math.exp(-max(-35, min(35, sum(map(weight, at))))))

    shuffled = np.random.default_rng(7)
    for _ in range(3):
        for i in shuffled.permutation(len(order)).tolist():
            at = [*features[order[i]], "intercept"]
            g = chance(at) - known[order[i]]
            for x in at:
                z[x] += g - (math.sqrt(n[x] + g * g) - math.sqrt(n[x])) / rule.rate * weight(x)
                n[x] += g * g
    found = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, SMALL).collect()}
    assert set(found) == set(docs)
    for i, at in features.items():
        assert abs(found[i].score - chance([*at, "intercept"])) < 1e-4
        assert found[i].predicted == int(found[i].score >= 0.5)
