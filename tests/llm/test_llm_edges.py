"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from creditloom.llm import (
    decontamination,
    fingerprints,
    html,
    language,
    near_duplicates,
    pieces,
    pii,
    quality,
    toxicity,
    warc,
)

LONG = "a long text of many words, mail me.x@mail.example.com or +1 (234) 555-0199. " * 2_000
SCHEMA = (
    "doc_id long, text string, lang string, score string, ids string, spans string,"
    " n_words string, fingerprint string, key string, part string, node string, y string,"
    " size string, bucket string, root string, term string, k0 string, payload string"
)
ROWS = [
    (1, "plain words of the first text, which is short"),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "  \n\t .,;"),
    (6, "plain words of the first text, which is short"),
    (6, "plain words of the first text, which is short"),
    (None, "a row without an id, plain words of some text"),
    (None, None),
    (7, "ünï cödé 漢字 😀 \x00 words"),
]
LABELS = [(1, 1, 0), (4, 0, 1), (6, 1, 0), (7, None, None), (None, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    rest = [None] * (len(SCHEMA.split(",")) - 3)
    rows = [(i, t, "en" if t else None, *rest) for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def test_language(docs):
    known = language.fit(docs)
    for rows in (docs, docs.limit(0)):
        out = language.predict(rows, known)
        assert set(docs.columns) <= set(out.columns)
        found = out.select("text", "lang_pred", "score").collect()
        assert len(found) == rows.count()
        for r in found:
            empty = not any(c.isalpha() for c in r.text or "")
            assert (r.lang_pred == "und") == empty and 0 <= r.score <= 1
    nothing = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_fingerprints(docs):
    out = fingerprints.beside_next(docs).collect()
    assert len(out) == len(ROWS)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    prints = fingerprints.fingerprints(docs).select("text", "fingerprint").collect()
    by_text = {}
    for r in prints:
        by_text.setdefault(r.text or "", set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and by_text[""] == {""}
    assert fingerprints.beside_next(docs.limit(0)).count() == 0
    alone = fingerprints.beside_next(docs.where("doc_id = 1")).first()
    assert alone.near_next == 1.0


def test_pii(docs):
    found = pii.find(docs).collect()
    assert len(found) == len(ROWS)
    long = next(r for r in found if r.id == 4)
    assert sum(s.kind == "email" for s in long.spans) == 2_000
    assert sum(s.kind == "phone" for s in long.spans) == 2_000
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    rows = clean.select("doc_id", "text").collect()
    assert sorted(str((r.doc_id, r.text)) for r in rows if r.doc_id != 4) == sorted(
        str(r) for r in ROWS if r[0] != 4
    )
    text = next(r.text for r in rows if r.doc_id == 4)
    assert "@" not in text and "555" not in text and "<EMAIL>" in text and "<PHONE>" in text
    assert pii.sanitise(docs.limit(0)).count() == 0


def test_pieces(docs, vocabulary):
    out = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    rows = out.select("text", "ids", "decoded").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.decoded == (r.text or "") and bool(r.ids) == bool(r.text)
    assert pieces.encode(docs.limit(0), vocabulary).count() == 0


def test_classifiers(docs, labels):
    for module in (quality, toxicity):
        model = module.fit(docs, labels)
        out = module.score(docs, model)
        assert set(out.columns) == set(docs.columns)
        scores = {}
        for r in out.select("text", "score").collect():
            scores.setdefault(r.text or "", set()).add(r.score)
        assert all(len(s) == 1 and 0 <= min(s) <= 1 for s in scores.values())
        assert module.score(docs.limit(0), model).count() == 0
        untaught = module.fit(docs, labels.limit(0))
        assert module.score(docs, untaught).count() == len(ROWS)
    assert all(r.score < 0.01 for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect())


def test_main_text(docs):
    pages = docs.withColumn("html", F.col("text"))
    out = html.extract(pages).select("html", "text").collect()
    assert len(out) == len(ROWS)
    assert all(r.text == " ".join((r.html or "").split()) for r in out)
    assert html.extract(pages.limit(0)).count() == 0


def test_near_duplicates(docs, spark):
    out = near_duplicates.near_duplicates(docs).collect()
    assert len(out) == len(ROWS)
    found = {r.doc_id: r for r in out}
    assert found[1].class_id == found[6].class_id == 1
    assert (found[6].n_copies, found[6].n_links) == (3, 2)
    assert all(found[i].class_id == i and found[i].n_links == 0 for i in (2, 3, 4, 5, 7))
    assert all(r.class_id is None and r.n_links == 0 for r in out if r.doc_id is None)
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0
    text = "five words and a few more"
    rows = [(None, text), (None, text), (None, text), (None, "x"), (9, "y z"), (5, "y z"), (None, "y z")]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(
        [(None, None, 3, 2)] * 3 + [(None, None, 1, 0), (9, 5, 3, 2), (5, 5, 3, 2), (None, 5, 3, 2)], key=str
    )


CLASHES = (
    "toxicity _toxicity _dropped _before row_number gone _row _class _id n_words n_hit hit_items contaminated"
    " own_0 own_1 text_before k0 k1 spans entity term ids decoded n_tokens class links same"
).split()


def stage_rows(spark):
    """Documents with nulls in any column, repeated rows, odd texts and clashing columns."""
    rows = [(i, t, None, None if n % 2 else f"s{n}", None if n % 3 else n) for n, (i, t) in enumerate(ROWS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *(F.concat(F.lit(c), F.coalesce("source", F.lit("-"))).alias(c) for c in CLASHES))


@pytest.mark.parametrize("number", range(5))
def test_pipeline_stages(spark, number):
    import corpus_pipeline

    docs, sf_dir = stage_rows(spark), "/root/testdata/sf0.001"
    name, stage = corpus_pipeline.STAGES[number]
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    if name == "toxicity":  # labelled documents to learn from
        docs = docs.withColumn("doc_id", F.col("doc_id") + 10**6)
        taught = corpus_pipeline.table(spark, sf_dir, "documents").select("doc_id", "text")
        docs = docs.unionByName(taught.withColumn("source", F.lit("taught")), allowMissingColumns=True)
    out = stage(spark, docs, sf_dir)
    if name == "toxicity":
        out = out.where("source is null or source <> 'taught'").withColumn("doc_id", F.col("doc_id") - 10**6)
    new = {"ids", "decoded", "n_tokens"} if name == "pieces" else set()
    assert set(out.columns) == set(docs.columns) and (new or out.columns == docs.columns)
    own = [c for c in CLASHES if c not in new]
    rows = out.collect()
    assert all(r[c] == f"{c}{r.source or '-'}" for r in rows for c in own)
    texts = [(r.doc_id, r.text) for r in rows]
    if name == "near_duplicates":
        first = [row for row in ROWS if row[0] != 6]
        assert sorted(texts, key=str) == sorted(first, key=str)
    elif name == "personal_data":
        clean = LONG.replace("me.x@mail.example.com", "<EMAIL>").replace("+1 (234) 555-0199", "<PHONE>")
        assert sorted(texts, key=str) == sorted(((i, clean if i == 4 else t) for i, t in ROWS), key=str)
        assert {r.doc_id: r.n_chars for r in rows}[4] == len(clean)
    else:
        assert sorted(texts, key=str) == sorted(ROWS, key=str)
    if name == "pieces":
        assert all((r.decoded, r.n_tokens) == ("", 0) for r in rows if not r.text)


def test_decontamination(docs, spark):
    items = spark.createDataFrame(
        [(1, "words of the first text"), (2, None), (3, ""), (None, "plain"), (4, "漢字")],
        "item_id long, text string",
    )
    out = decontamination.judged(docs, items)
    found = {r.doc_id: r for r in out.collect()}
    assert found[1].n_hit == 5 and found[1].hit_items == ["1"] and found[1].contaminated
    assert found[7].n_hit == 1 and found[7].hit_items == ["4"]
    for i in (2, 3, 5):
        assert (found[i].n_words, found[i].n_hit, found[i].contaminated) == (0, 0, False)
    assert decontamination.judged(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.judged(docs.limit(0), items).count() == 0


def test_warc(docs, tmp_path):
    records = docs.withColumn("payload", F.encode("text", "UTF-8")).withColumn("url", F.col("lang"))
    names = {"record_id": "doc_id", "payload": "payload"}
    warc.write_archive(records, f"{tmp_path}/a", **names, least_bytes=10)
    out = warc.read_archive(docs.sparkSession, f"{tmp_path}/a").collect()
    assert len(out) == len(ROWS)
    texts = sorted(bytes(r.payload).decode() for r in out)
    assert texts == sorted(t or "" for _, t in ROWS)
    same = [r for r in out if r.record_id in (1, 6)]
    assert sorted((r.record_id, r.record_type, r.refers_to) for r in same) == [
        (1, "revisit", "6"), (6, "response", None), (6, "response", None)
    ]
    warc.write_archive(records.limit(0), f"{tmp_path}/b", **names)
    assert warc.read_archive(docs.sparkSession, f"{tmp_path}/b").count() == 0
