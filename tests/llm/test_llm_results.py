"""Results of the operators against brute force, the library, held-out labels and SQL twins."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from compare import duck, mismatch
from conftest import SMALL
from pyspark.sql import functions as F

from creditloom.llm import fingerprints, html, near_duplicates, pieces, pii, warc
from creditloom.llm.decontamination import Searcher
from creditloom.llm.oracles import ORACLES
from creditloom.llm.queries import QUERIES
from creditloom.llm.text import table, words_of

#: Enough held-out rows to measure on.
MIDDLE = "/root/testdata/sf0.01"

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_twin(spark, name):
    assert mismatch(spark, duck(SMALL), QUERIES[name], ORACLES[name], SMALL) is None


def held_out_accuracy(spark, name, label):
    found = QUERIES[name](spark, MIDDLE).where("held_out")
    if label == "lang":
        rows = found.join(table(spark, MIDDLE, "documents").select("doc_id", "lang"), "doc_id")
        return rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    rows = found.join(table(spark, MIDDLE, "labels"), "doc_id")
    return rows.agg(F.avg((F.col(label) == F.col("predicted")).cast("int"))).first()[0]


@pytest.mark.parametrize(
    "name, label, least",
    [("op1_language", "lang", 0.97), ("op5_quality", "quality", 0.85), ("op8_toxicity", "toxic", 0.8)],
)
def test_held_out_labels(spark, name, label, least):
    """Some 330 documents are held out for languages, 100 and 80 labelled ones for the others."""
    assert held_out_accuracy(spark, name, label) >= least


def test_edited_texts(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op2_fingerprints"](spark, SMALL).collect()}
    ids = sorted(texts)
    for at, i in enumerate(ids):
        text, after = texts[i], texts[ids[(at + 1) % len(ids)]]
        moved = len(text) // 4
        edited = text[: len(text) - moved] + after[:moved]
        assert rows[i].n_chars == len(text)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].fingerprint == str(fingerprints.fingerprint(text))


def plain_anchors(text):
    """Every anchor by looking at each run: its code points, how often it was there before, its place."""
    marks = [f"<{i}>" for i in range(fingerprints.SIZE - 1)]
    codes = np.concatenate([fingerprints._BEFORE, [ord(c) for c in text]]).astype(np.uint64)
    letters, found, seen = [*marks, *text], [], collections.Counter()
    inner = fingerprints._run_hashes(codes, fingerprints.INNER)
    for i in range(len(text)):
        mine = inner[i : i + fingerprints.SIZE - fingerprints.INNER + 1]
        if i == 0 or mine.min() in (mine[0], mine[-1]):
            run = "".join(letters[i : i + fingerprints.SIZE])
            found.append(((run, seen[run]), i))
            seen[run] += 1
    return dict(found)


def plain_likeness(a, b):
    """By all anchors and every shift, in Python."""
    x, y = plain_anchors(a), plain_anchors(b)
    if not x or not y:
        return float(len(x) == len(y))
    shifts = sorted(x[r] - y[r] for r in x.keys() & y.keys())
    best = max((sum(s <= t <= s + 2 * fingerprints.SLACK for t in shifts) for s in shifts), default=0)
    return 2 * best / (len(x) + len(y))


def test_likeness_by_all_anchors(spark, texts):
    """The columns of the query against looking at every run of both texts."""
    rows = {r.doc_id: r for r in QUERIES["op2_fingerprints"](spark, SMALL).collect()}
    ids = sorted(texts)
    for at in range(0, len(ids), 4):
        i, after = ids[at], texts[ids[(at + 1) % len(ids)]]
        text = texts[i][:4000]
        if len(texts[i]) > len(text) or len(after) > 4000:
            continue
        moved = len(text) // 4
        edited = text[: len(text) - moved] + after[:moved]
        assert rows[i].near_edited == pytest.approx(plain_likeness(text, edited))
        assert rows[i].near_next == pytest.approx(plain_likeness(text, after))


def test_syncmers_do_not_depend_on_context():
    draw = random.Random(1)
    body = "".join(draw.choice("abcdefgh ") for _ in range(300))
    found = [
        fingerprints.fingerprint(before + body + after)
        for before, after in (("", ""), ("left " * 9, ""), ("", "right " * 7))
    ]
    inner = [dict(zip(f.hashes.tolist(), f.places.tolist())) for f in found]
    inside = {h for h, place in inner[0].items() if place >= fingerprints.SIZE - 1}
    assert inside <= set(inner[1]) and set(inner[0]) <= set(inner[2])
    assert {inner[1][h] - inner[0][h] for h in inside} == {45}
    places = np.sort(found[0].places)
    assert np.diff(places).max() <= fingerprints.SIZE - fingerprints.INNER  # one among any 12 runs
    assert fingerprints.likeness(found[0], found[0]) == 1.0
    for f in found:
        again = fingerprints.parse(str(f))
        assert again.hashes.tolist() == f.hashes.tolist() and again.places.tolist() == f.places.tolist()


def test_texts_of_all_lengths_are_compared_alike():
    """No length from which texts are another kind: edits of the last part, of a word."""
    draw = random.Random(21)
    letters = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=200))
    for n in range(1, 199):
        a, b = (fingerprints.fingerprint(x) for x in (letters[:n], letters[: n + 2]))
        assert fingerprints.likeness(a, b) == fingerprints.likeness(b, a) >= 0.5
        row, after = (
            fingerprints._Row(i, t, fingerprints.fingerprint(t)) for i, t in enumerate((letters[:n], ""))
        )
        edited, near_edited, near_next = (fingerprints._pair(row, after)[i] for i in (2, 5, 6))
        assert edited == letters[: n - n // 4] and near_edited >= 0.5 and near_next == 0
    for n in (99, 100, 101):
        word = letters[:50] + "word" + letters[54:n]
        near = fingerprints.likeness(*(fingerprints.fingerprint(x) for x in (letters[:n], word)))
        assert 0.4 < near < 1


def test_pieces_equal_library(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = {r.doc_id: r for r in QUERIES["op4_pieces"](spark, SMALL).collect()}
    for i, text in texts.items():
        ids = library.encode(text)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_odd_texts():
    import numpy as np

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    known = pieces.Vocabulary(PIECES)
    encoder, decoder = pieces.Encoder(known), pieces.Decoder(known)
    draw = random.Random(2)
    parts = "a|b|the| |  |▁|\n|\t|é|日本|😀|ing|<s>|<0x41>|.|　|    |12|ﬁ|\r\n".split("|") + ["|"]
    for _ in range(3_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))
        ids = np.frombuffer(encoder.encode(text), dtype=np.int32).tolist()
        assert ids == library.encode(text)
        assert decoder.decode(ids) == library.decode(ids)
    for size in range(1, 120):
        for text in (" " * size, "a" * size, "=" * size):
            assert np.frombuffer(encoder.encode(text), dtype=np.int32).tolist() == library.encode(text)


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    """The contract's patterns as they stand."""
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    out = []
    for rank, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans(spark, texts):
    draw = random.Random(3)
    parts = (
        "a|b.|@|@x.y|1|12|4929348385146306|255.1.2.3|1.2.3.4|-| |+|+1 (017) 555-7713|é|😀|\n|_|(|)"
        "|..|00000001.2.3.4|99999999999.1.1.1|4444 4444 4444 4448|%|@@|a@b.c|d@e-f.g.h"
    ).split("|")
    odd = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(2_000)]
    every = list(texts.values()) + odd + ["a" * 30_000 + "@b.c " + "1" * 20_000]
    df = spark.createDataFrame(list(enumerate(every)), "i long, text string").repartition(8)
    found = df.select("i", pii.listed(pii.base_spans(F.col("text"))).alias("s")).collect()
    assert all(r.s == plain_spans(every[r.i]) for r in found)


def test_disclosing_terms(spark):
    """A name beside the same address in several texts reveals it, a common word does not."""
    rows = [(i, f"and so on for number{i} the word here") for i in range(60)]
    rows += [(100 + i, f"text {i * 7} of the Smithson ann@mail.example.com word here") for i in range(4)]
    rows += [(200, "Smithson alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {}
    for r in pii.find(docs, threshold=0.8).collect():
        text = dict(rows)[r.id]
        terms[r.id] = [text[s.start : s.end] for s in r.spans if s.kind == "term"]
    assert all("Smithson" in terms[100 + i] for i in range(4))
    assert not any(set(t) & {"the", "word", "here"} for t in terms.values())
    assert terms[200] == [] and terms[5] == []
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, threshold=0.8).collect()}
    assert "<EMAIL>" in clean[100] and "Smithson" not in clean[100]


def brute_classes(texts):
    """All pairs of documents."""
    sets = {i: near_duplicates.shingles(words_of((t or "").encode())) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            if near_duplicates.similarity(sets[a], sets[b]) >= 0.8:
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {i: top(i) for i in sets}


def test_near_duplicates_of_all_pairs(spark, texts, monkeypatch):
    """Documents, and a group of many edits of one text so that tries have large nodes."""
    draw = random.Random(4)
    base = [f"w{draw.randint(0, 400)}" for _ in range(120)]
    many = dict(texts)
    for i in range(160):
        words = list(base)
        for _ in range(draw.randint(0, 9)):
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 400)}"
        many[10_000 + i] = " ".join(words)
    df = spark.createDataFrame(list(many.items()), "doc_id long, text string").repartition(6)
    expected = brute_classes(many)
    for few, block in ((near_duplicates.FEW, near_duplicates.BLOCK), (3, 8)):
        monkeypatch.setattr(near_duplicates, "FEW", few)
        monkeypatch.setattr(near_duplicates, "BLOCK", block)
        found = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(df).collect()}
        assert found == expected


def test_links_of_all_pairs(spark, monkeypatch):
    """Every partner counts, in large groups too, and each of its copies."""
    draw = random.Random(14)
    base = [f"w{draw.randint(0, 400)}" for _ in range(120)]
    texts = {}
    for i in range(70):
        words = list(base)
        for _ in range(draw.randint(0, 7)):
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 400)}"
        texts[i] = " ".join(words)
    texts |= {100 + i: texts[i % 9].upper() for i in range(20)}  # copies
    texts |= {200: "a few other words", 201: "a few other words", 202: None}
    sets = {i: near_duplicates.shingles(words_of((t or "").encode())) for i, t in texts.items()}
    expected = {
        i: sum(i != j and near_duplicates.similarity(a, b) >= 0.8 for j, b in sets.items())
        for i, a in sets.items()
    }
    assert max(expected.values()) > near_duplicates.FEW
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for few, block in ((near_duplicates.FEW, near_duplicates.BLOCK), (3, 8)):
        monkeypatch.setattr(near_duplicates, "FEW", few)
        monkeypatch.setattr(near_duplicates, "BLOCK", block)
        found = {r.doc_id: r.n_links for r in near_duplicates.near_duplicates(df).collect()}
        assert found == expected


def test_search_finds_every_occurrence():
    draw = random.Random(5)
    letters = [c.encode() for c in "abc"]
    for _ in range(60):
        items = [
            (str(i), b" ".join(draw.choices(letters, k=draw.randint(0, 16)))) for i in range(4)
        ]
        words = draw.choices(letters, k=80)
        size = draw.choice((2, 3, 5))
        starts, lengths, owners = Searcher(items, size).search(words)
        expected = collections.Counter()
        names = set()
        for name, text in items:
            own = text.split()
            runs = {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} - {()}
            for run in runs:
                for at in range(len(words) - len(run) + 1):
                    if tuple(words[at : at + len(run)]) == run:
                        expected[at, len(run)] = 1
                        names.add(name)
        assert collections.Counter(zip(starts, lengths)) == expected and owners == names


def test_main_text_of_the_pages(spark):
    """The pages mark their article; its text is known from the markup."""
    from html import unescape

    pages = {r.page_id: r.html for r in table(spark, SMALL, "pages").collect()}
    for r in QUERIES["op6_main_text"](spark, SMALL).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)
        plain = re.sub(r"</?b>", "", inner.group(1)) if inner else ""
        assert r.text == " ".join(unescape(re.sub(r"<[^>]+>", " ", plain)).split())


def test_main_text_without_marks():
    page = """<body><div class="top-nav"><ul><li><a>Home</a><li><a>News</a></ul></div>
    <div><div><p>A first long paragraph, with commas, and more. It goes on and on.</p>
    <p>A second one &amp; more,&nbsp;with words; it is long, too. Indeed.</p></div>
    <div><ul><li>Link one</li><li>Link two</li><li>Other</li></ul></div>
    <div id="comments"><p>I read this, and I like it, really. Thanks for it all.</p></div>
    <form><p>Write to us, please, with your name. We answer.</p></form></div></body>"""
    assert html.main_text(page) == (
        "A first long paragraph, with commas, and more. It goes on and on."
        " A second one & more, with words; it is long, too. Indeed."
    )
    marked = "<main><p>One</p><aside>no</aside><script>x<p>y</script>t<b>w</b>o</main><p>no</p>"
    assert html.main_text(marked) == "One two"


def test_ratios_decide_on_marked_pages():
    """Body text beside teaser cards that are articles; a layout class above an article."""
    long = "A long sentence, with commas, that goes on and on for a while; it does not end soon. "
    card = "<article><h3>Card</h3><p>See more</p></article>"
    page = f"<body><div>{card * 6}</div><div><p>{long * 6}</p><p>{long * 5}</p></div></body>"
    assert html.main_text(page) == " ".join([long.strip()] * 11)
    page = f'<body><div class="has-sidebar"><article><h1>Title</h1><p>{long}</p></article></div></body>'
    assert html.main_text(page) == "Title " + long.strip()
    page = f"<body><nav>{long}</nav><article><h1>Title</h1><p>{long}</p></article><p>Rights</p></body>"
    assert html.main_text(page) == "Title " + long.strip()


def test_archive_files(spark, tmp_path):
    rows = [(i, f"http://h/{i % 3}", (f"page {i % 4} " * 300).encode()) for i in range(12)]
    records = spark.createDataFrame(rows, "page_id long, url string, payload binary")
    warc.write_archive(records, f"{tmp_path}/archive")
    read = warc.read_archive(spark, f"{tmp_path}/archive")
    assert spark.read.parquet(f"{tmp_path}/archive/payloads").count() == 4
    warc.write_files(read, f"{tmp_path}/files")
    found = {}
    for r in warc.read_files(spark, f"{tmp_path}/files").collect():
        header = bytes(r.warc_header).decode()
        name = int(re.search(r"WARC-Record-ID: <urn:record:(\d+)>", header).group(1))
        found[name] = (header, bytes(r.block).partition(b"\r\n\r\n")[2])
    assert found.keys() == set(range(12))
    for i, _, payload in rows:
        header, body = found[i]
        response = i >= 8
        assert body == (payload if response else b"")
        assert f"sha1:{hashlib.sha1(payload).hexdigest()}" in header
        assert ("WARC-Refers-To" in header) != response


def test_pipeline(spark, texts):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "personal_data", "pieces"
    ]
    docs = corpus_pipeline.table(spark, SMALL, "documents")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert 0.5 * len(texts) < len(out) < len(texts)
    kept = {i: texts[i] for i in out}
    assert len(set(brute_classes(kept).values())) == len(kept)
    contaminated = QUERIES["op9_decontamination"](spark, SMALL).where("contaminated")
    assert not {r.doc_id for r in contaminated.collect()} & set(out)
    for i, r in out.items():
        assert r.decoded == r.text and r.n_tokens == len(r.ids) and r.n_chars == len(r.text)
        assert plain_spans(r.text) == "" and (plain_spans(texts[i]) or r.text == texts[i])
    assert all(set(docs.columns) <= set(r.asDict()) for r in out.values())


LONG = "A long sentence, with commas, that goes on and on for a while; it does not end soon."


@pytest.mark.parametrize(
    "page, want",
    [
        # reader comments, whatever marks they carry
        (f'<main><article><h1>T</h1><p>{LONG}</p></article><div id="comments"><article><p>{LONG}</p></article></div></main>', f"T {LONG}"),
        (f'<article><p>{LONG}</p></article><article class="user-comment"><p>{LONG}</p></article>', LONG),
        (f'<article><p>{LONG}</p></article><section class="comments-area"><h2>Replies</h2><p>{LONG}</p><p>{LONG}</p></section>', LONG),
        # a frame around the page
        (f"<body><form><div><p>{LONG}</p><p>{LONG}</p></div></form></body>", f"{LONG} {LONG}"),
        (f'<body><form><nav>x</nav><article><p>{LONG}</p></article><div class="ad">{LONG}</div></form></body>', LONG),
        (f'<body><div class="content-widget"><p>{LONG}</p></div></body>', LONG),
        # a form, an advert, a notice beside the text
        (f"<body><p>{LONG} {LONG}</p><form><p>{LONG}</p></form></body>", f"{LONG} {LONG}"),
        (f'<article><p>Short.</p></article><div class="ad">{LONG}</div>', "Short."),
        (f'<article><p>{LONG}</p><div class="cookie-notice">{LONG}</div></article>', LONG),
        # names that tell of the content
        (f'<article><section id="header-tank"><h2 id="search">Tanks</h2><p>{LONG}</p></section></article>', f"Tanks {LONG}"),
        # controls inside a sentence
        (f"<article><p>In<button>x</button> text, <select><option>1</select>{LONG}</p></article>", f"In text, {LONG}"),
        # paths below a mark are judged, too
        (
            f"<article><p>{LONG}</p><p>{LONG}</p><div><ul>{'<li><a>go</a></li>' * 12}</ul></div>"
            f"<p>{LONG}</p><p>{LONG}</p></article>",
            " ".join([LONG] * 4),
        ),
    ],
)
def test_main_text_cases(page, want):
    assert html.main_text(page) == want
