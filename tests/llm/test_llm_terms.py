"""Disclosing terms against the definition, and long texts with many spans."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from creditloom.llm import pii

WORD = re.compile(r"[^\W\d_]{3,}")


def entities_of(spark, rows):
    """Base spans per row, as the patterns give them."""
    docs = spark.createDataFrame(list(enumerate(t for _, t in rows)), "n long, text string")
    found = docs.select("n", pii.base_spans(F.col("text")).alias("s")).collect()
    return {r.n: [(s.kind, s.start, s.end, s.value) for s in r.s] for r in found}


def brute_terms(spark, rows, support, threshold):
    """Spans (start, end, fate) of terms per row, by counting documents in Python."""
    spans = entities_of(spark, rows)
    has = [{f"{k}:{v}" for k, _, _, v in spans[i]} for i in range(len(rows))]
    words = [set(WORD.findall((t or "").lower())) for _, t in rows]
    total = len(rows)
    n_entity, n_term, both = {}, {}, {}
    for e, w in zip(has, words):
        for x in e:
            n_entity[x] = n_entity.get(x, 0) + 1
        for t in w:
            n_term[t] = n_term.get(t, 0) + 1
        for x in e:
            for t in w:
                both[x, t] = both.get((x, t), 0) + 1
    fate = {}
    for (x, t), n in both.items():
        content = math.log(total / n_entity[x])
        pmi = math.log(n * total / (n_entity[x] * n_term[t]))
        if n >= support and n_entity[x] >= support and content > 0 and pmi >= threshold * content - 1e-9:
            fate[x, t] = "removed" if pmi >= content - 1e-9 else "generalised"
    out = []
    for i, (_, text) in enumerate(rows):
        hidden = list(text or "")
        for _, start, end, _ in spans[i]:
            hidden[start:end] = " " * (end - start)
        found = []
        for m in WORD.finditer("".join(hidden)):
            fates = [fate[x, m.group().lower()] for x in has[i] if (x, m.group().lower()) in fate]
            if fates:
                found.append((m.start(), m.end(), max(fates)))
        out.append(found)
    return out


def some_rows():
    draw = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in ("n", "rst", "lm", "ß")]
    people = [(f"{n}@mail.example.com", n.capitalize()) for n in ("smithson", "okafor", "lindqvist")]
    people.append(("+44 20 7946 0958", "Beaumont"))
    rows = []
    for i in range(160):
        body = [" ".join(draw.choices(words, k=draw.randint(0, 40))) for _ in range(3)]
        if i % 4 == 0:
            entity, name = people[i // 4 % 4]
            place = i % 3
            if place == 0:
                body.insert(1, f"Name: {name}\n\nWrite to {entity}")
            elif place == 1:
                body = [f"{name} {'x ' * 60}", *body, entity]
            else:
                body += [f"{entity}, {entity}", f"{name} and again {name.upper()}"]
        if i % 37 == 5:
            body.append("smithson elsewhere 10.20.30.40")
        rows.append((i, "\n".join(body)))
    rows += [(None, None), (None, ""), (7, rows[8][1]), (7, rows[8][1]), (500, "Ärger äöü 10.20.30.40 élan")]
    return rows


@pytest.mark.parametrize("support, threshold", [(2, 0.9), (1, 1.0), (3, 0.5)])
def test_terms_by_the_definition(spark, support, threshold):
    rows = some_rows()
    want = brute_terms(spark, rows, support, threshold)
    assert any(want) and any(f == "generalised" for w in want for _, _, f in w) == (threshold < 0.9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.select("*", *(F.lit(1).alias(c) for c in ("k0", "spans", "entity", "term", "rows", "_k0")))
    got = [
        (r.id, [(s.start, s.end, s.value) for s in r.spans if s.kind == "term"])
        for r in pii.find(docs, support=support, threshold=threshold).collect()
    ]
    assert sorted(got, key=repr) == sorted(((i, w) for (i, _), w in zip(rows, want)), key=repr)


def test_names_far_from_the_address_go(spark):
    """A line above, 60 characters away, and elsewhere in the same document."""
    rows = [(i, f"common words of text number {i}") for i in range(80)]
    rows += [(100, "Name: Smithson\nMail: ann@mail.example.com"), (101, "Smithson" + " -" * 40 + " ann@mail.example.com\nSmithson")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Smithson" not in clean[100] + clean[101] and "<EMAIL>" in clean[100]
    assert all(clean[i] == t for i, t in rows[:80])


def test_empty_table_and_no_entities(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(none).count() == 0 and pii.sanitise(none).count() == 0
    plain = spark.createDataFrame([(1, "nobody here"), (1, "nobody here")], none.schema)
    assert [r.spans for r in pii.find(plain).collect()] == [[], []]


def test_cost_follows_the_number_of_spans(spark):
    """Sixteen times the addresses take nowhere near 256 times as long."""
    def took(n):
        text = " ".join(f"host 10.{i % 256}.{i // 256 % 256}.7 and {i}" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begin = time.time()
        spans = docs.select(pii.base_spans(F.col("text")).alias("s"))
        out = spans.select(F.size("s").alias("n")).first().n
        new = docs.select(pii.rewritten(F.col("text"), pii.base_spans(F.col("text"))).alias("t")).first().t
        assert out == n and new.count("<IP>") == n and new.startswith("host <IP> and 0 host <IP>")
        return time.time() - begin

    took(1000)
    few, many = took(2000), took(32000)
    assert many < 60 * max(few, 0.2)
