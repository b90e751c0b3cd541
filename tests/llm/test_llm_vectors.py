"""Resampling, product codes and vector duplicates against brute force, and their edge cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import quantisation, resampling, vector_duplicates
from creditloom.llm.text import words_of

# --- resampling --------------------------------------------------------------


def brute_resample(docs, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    """Rows (id, n_features, weight, score, rank) by the definition, word lists in Python."""

    def features(text):
        w = words_of((text or "").encode())
        return w, [
            zlib.crc32(b" ".join(w[i : i + n])) % buckets
            for n in range(1, longest + 1)
            for i in range(len(w) - n + 1)
        ]

    source = [(i, *features(t)) for i, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, f in source:
        for b in f:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    total, wanted = sum(s) + buckets, sum(t) + buckets
    gain = [math.floor(1000 * math.log((y + 1) * total / ((x + 1) * wanted))) for x, y in zip(s, t)]
    rows = []
    for i, w, f in source:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        name = f"{seed}:{'' if i is None else i}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, len(w)])
    order = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for at, row in enumerate(order[: len(order) * percent // 100], 1):
        row[4] = at
    return sorted((tuple(r[:5]) for r in rows), key=repr)


ODD_DOCS = [
    (None, "no id " * 12),
    (None, None),
    (1, None),
    (2, ""),
    (3, " .,; "),
    (4, "Ünïcode Wörter – straße " * 8),
    (5, "x" * 5000 + " y " + "z" * 257 + " " + "q" * 256),
    (6, "same text of a few words " * 5),
    (6, "same text of a few words " * 5),
    (7, "one\ttwo\nthree  four"),
]


def some_docs(n=150):
    draw = random.Random(11)
    words = [f"w{draw.randint(0, 300)}" for _ in range(400)]
    return [(100 + i, " ".join(draw.choices(words, k=draw.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("longest, least, percent", [(1, 20, 10), (2, 5, 50), (3, 1, 100)])
def test_resampling_by_brute_force(spark, longest, least, percent):
    docs, target = ODD_DOCS + some_docs(), ["w1 w2 w3", None, "", "straße same TEXT of"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(frame, wanted, longest=longest, least_words=least, percent=percent)
    rows = found.select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == brute_resample(
        docs, target, longest, least=least, percent=percent
    )


def test_resampling_without_rows_and_with_own_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, key int, rank int, _part int")
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(none, target).count() == 0
    docs = none.union(spark.createDataFrame([(1, "a b", 5, 6, 7)], none.schema))
    empty = target.where("text is null")
    assert resampling.resample(docs, empty).first().n_features == 2
    assert resampling.resample(docs, target).columns == [
        "doc_id", "n_words", "n_features", "weight", "score", "rank",
    ]


def test_words_of_all_sizes_and_a_full_dictionary():
    """The dictionary begins anew, long words stay out of it, long texts are cut."""
    draw = random.Random(2)
    bodies = [" ".join(f"v{draw.randint(0, 99)}" for _ in range(40)).encode() for _ in range(30)]
    bodies += [b"", b"..", b"a " + b"Z" * 400 + b" " + b"y" * 256 + b" b"]
    words = resampling.Dictionary(most=20)
    for _ in range(2):
        crc, size, counts = words.payloads(bodies)
        assert crc.tolist() == [zlib.crc32(w) for b in bodies for w in words_of(b)]
        assert size.tolist() == [len(w) for b in bodies for w in words_of(b)]
        assert counts.tolist() == [len(words_of(b)) for b in bodies]
    for most in (1, 9, 100):
        parts = {}
        for owners, pieces in resampling._pieces(bodies, most):
            for owner, piece in zip(owners, pieces):
                parts.setdefault(owner, []).extend(piece.split())
        assert [parts[i] for i in range(len(bodies))] == [
            [w.decode() for w in words_of(b)] for b in bodies
        ]


# --- product codes -----------------------------------------------------------


def test_tree_finds_the_nearest_entry_and_the_lower_one_of_ties():
    draw = np.random.default_rng(3)
    for scale in (2, 50, 1 << 23):
        entries = draw.integers(-scale, scale, (64, 4))
        entries[40] = entries[7]
        queries = np.concatenate([entries, draw.integers(-scale, scale, (3000, 4))])
        search = quantisation.Search(entries)
        number, far = search.nearest(queries)
        every = quantisation.distances(queries, entries)
        assert (number == every.argmin(1)).all() and (far == every.min(1)).all()
        assert search.tested < 0.6 * every.size


def brute_codes(rows, parts, entries, rounds):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    limit = quantisation.LARGEST
    whole = [[max(-limit, min(limit, math.floor(256 * x))) for x in r[1]] for r in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in book]
        return min(range(len(far)), key=lambda e: (far[e], e)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            homes = [nearest(v[p], books[p])[0] for v in cut]
            for e in range(len(books[p])):
                mine = [v[p] for v, h in zip(cut, homes) if h == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, totals = [], {}
    for (i, _, label), v in zip(kept, cut):
        found = [nearest(v[p], books[p]) for p in range(parts)]
        error = sum(d for _, d in found)
        totals[label] = totals.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e, _ in found), error, label))
    return sorted(((i, c, e, totals[label], digest) for i, c, e, label in out), key=repr)


def odd_vectors(n=120, size=8):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=size).round(2).tolist(), int(draw.integers(3))) for i in range(n)]
    rows += [(n + i, rows[i][1], None) for i in range(10)]
    rows += [(3, rows[3][1], 3), (None, rows[5][1], 1), (200, [1e6] * size, 1)]
    broken = [None, [None] + [1.0] * (size - 1), [math.nan] * size, [math.inf] + [0.0] * (size - 1), [1.0]]
    return rows + [(300 + i, v, 1) for i, v in enumerate(broken)]


@pytest.mark.parametrize("entries, rounds", [(16, 2), (64, 1), (256, 0)])
def test_codes_by_brute_force(spark, entries, rounds):
    rows = odd_vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    found, books = quantisation.compress(frame, parts=4, entries=entries, rounds=rounds)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == brute_codes(rows, 4, entries, rounds)
    code, error = next((r[1], r[2]) for r in got if r[0] == 0)
    meant = np.floor(256 * np.array(rows[0][1])).astype(int)
    assert ((quantisation.decode(code, books) - meant) ** 2).sum() == error


def test_codes_without_rows_and_with_odd_lengths(spark):
    schema = "vec_id long, embedding array<float>, label string, id int, error string, vector int"
    none = spark.createDataFrame([], schema)
    found, books = quantisation.compress(none)
    assert found.count() == 0 and books is None
    rows = [(i, [0.5 * i] * 5, None if i % 2 else "l", 1, "", 2) for i in range(6)]
    found, books = quantisation.compress(spark.createDataFrame(rows, schema), parts=4, entries=3)
    assert found.count() == 6 and books.shape == (4, 3, 2)
    assert quantisation.compress(spark.createDataFrame([(1, [], None, 1, "", 2)], schema))[0].first().error == 0


# --- vector duplicates -------------------------------------------------------


def brute_groups(rows, threshold=0.98):
    """(id, n_links, component, kept) by all pairs."""
    n = len(rows)
    usable = [
        v is not None and label is not None and any(x != 0 for x in v if x is not None)
        and all(x is not None and math.isfinite(x) for x in v)
        for _, v, label in rows
    ]
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            (_, v, a), (_, w, b) = rows[i], rows[j]
            if usable[i] and usable[j] and a == b and len(v) == len(w):
                x, y = np.array(v) / np.abs(v).max(), np.array(w) / np.abs(w).max()
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def planted(size=24, seed=6):
    """Groups of copies, multiples and near copies, chains, and vectors that link with nothing."""
    draw = np.random.default_rng(seed)
    rows = []

    def add(v, label):
        rows.append((len(rows), [float(x) for x in v], label))

    for group in range(25):
        centre, label = draw.normal(size=size), int(draw.integers(3))
        for k in range(int(draw.integers(1, 9))):
            add(centre + draw.normal(size=size) * draw.choice([0.0, 0.05, 0.12, 0.2]), label)
            if k % 3 == 0:
                add(rows[-1][1], label)
    step = draw.normal(size=size)
    for k in range(12):  # a chain whose ends are far apart
        add(np.append([np.cos(k * 0.19), np.sin(k * 0.19)], np.zeros(size - 2)), 2)
    for k in range(60):  # one large group
        add(step + draw.normal(size=size) * 0.07, 1)
    for k in range(80):
        add(draw.normal(size=size), int(draw.integers(3)))
    return rows


def groups_of(frame, **options):
    found = vector_duplicates.near_duplicates(frame, **options)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("cell_rows, block_rows", [(512, 4096), (8, 4096), (8, 5)])
def test_groups_by_brute_force(spark, monkeypatch, cell_rows, block_rows):
    monkeypatch.setattr(vector_duplicates, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(vector_duplicates, "BLOCK_ROWS", block_rows)
    rows = planted()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert groups_of(frame, recall=1.0) == brute_groups(rows)


def test_recall_below_one_is_reached_and_no_link_is_wrong(spark, monkeypatch):
    monkeypatch.setattr(vector_duplicates, "CELL_ROWS", 4)
    rows = planted()
    frame = spark.createDataFrame(rows, SCHEMA)
    every = {r[0]: r[1] for r in brute_groups(rows)}
    for recall in (0.9, 0.999):
        found = {r[0]: r[1] for r in groups_of(frame, recall=recall)}
        assert all(found[i] <= every[i] for i in every)
        assert sum(found.values()) >= recall * sum(every.values())


def test_group_edges(spark):
    v, far = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [
        (None, v, 1), (None, v, 2), (9, v, 1), (9, v, 1), (4, v, None), (5, None, 1), (6, [0.0] * 3, 1),
        (7, [None, 1.0, 1.0], 1), (8, [math.nan, 1.0, 1.0], 1), (10, [], 1), (11, [1.0, 2.0], 1),
        (12, [0.0, -0.0, 2.0], 3), (13, [-0.0, 0.0, 2.0], 3), (14, [1e200, 2e200, 3e200], 1),
        (15, [1e-300, 2e-300, 3e-300], 1), (16, far, 1), (17, [math.inf, 1.0, 1.0], 1), (18, [5.0], 1), (19, [2.0], 1),
    ]
    assert groups_of(spark.createDataFrame(rows, SCHEMA)) == brute_groups(rows)
    assert groups_of(spark.createDataFrame([], SCHEMA)) == []
    assert groups_of(spark.createDataFrame(rows[4:8], SCHEMA)) == brute_groups(rows[4:8])
    clash = "id", "same", "node", "cell", "home", "copies", "root", "n_links"
    own = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(7).alias(c) for c in clash))
    assert groups_of(own) == brute_groups(rows)
    floats = spark.createDataFrame(rows[:8], SCHEMA).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert groups_of(floats) == brute_groups(rows[:8])
