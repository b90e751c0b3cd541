"""Personal data: fixed patterns, and the terms around them that give a person away.

Patterns find addresses, card and phone numbers with their places.  The corpus
then tells which terms reveal such an entity: a term is disclosing if its pointwise
mutual information with the entity, from the numbers of documents that have the
one, the other and both, is at least ``threshold`` of the entity's own information
content.  Every occurrence of a disclosing term in the documents of its entity is
a span: terms that reveal the entity completely are removed, others generalised.

Entities found in the same documents reveal themselves through the same terms and
are counted as one.  An entity in fewer than ``support`` documents has no
frequencies to estimate from, so pairs are counted for the others alone.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.tables import if_small, written

#: The kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

# The patterns.  A run is taken up at its start or where the last
# match ended, which finds the same matches without trying every place in it.
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap signs that a pattern may match at all.
SIGNS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}

#: Letters a term has at least.
LEAST_LETTERS = 3

#: Documents that a term and an entity must share.  One is no estimate: each word that
#: the corpus has once would reveal each entity that it has once.
SUPPORT = 2

#: Matches or spans that are walked through at a time: arrays grow by copying.
CHUNK = 256

THRESHOLD = 0.9

_WORD = r"\p{L}{%d,}" % LEAST_LETTERS
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _walked(items: Column, after, result, kind: str, local=None) -> Column:
    """``result(at, item, extra)`` of all items in order, ``at`` being where the ones before end.

    ``after(at, item)`` gives the next place.  Items are walked in chunks whose
    results are put together at the end, so the cost follows their number and not
    its square.  ``local(begin, end)`` is computed once per chunk and handed on as
    ``(begin, value)``.
    """
    chunk, nothing = F.lit(CHUNK), F.array().cast(kind)

    def walk(items: Column) -> Column:
        def part(number: Column) -> Column:
            return F.slice(items, number * chunk + 1, chunk)

        def start(acc: Column, number: Column) -> Column:
            end = F.aggregate(part(number), acc["at"], after)
            return F.struct(end.alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))

        def inside(begin: Column, mine: Column, extra) -> Column:
            def step(acc: Column, x: Column) -> Column:
                out = F.concat(acc["out"], F.array(result(acc["at"], x, extra)))
                return F.struct(after(acc["at"], x).alias("at"), out.alias("out"))

            first = F.struct(begin.alias("at"), nothing.alias("out"))
            return F.aggregate(mine, first, step, lambda acc: acc["out"])

        def results(pair: Column) -> Column:
            begin = pair["start"]

            def go(mine: Column) -> Column:
                if local is None:
                    return inside(begin, mine, None)
                value = local(begin, F.aggregate(mine, begin, after))
                return _let(value, lambda v: inside(begin, mine, (begin, v)))

            return _let(part(pair["number"]), go)

        last = F.floor((F.size(items) - 1) / chunk).cast("int")
        numbers = F.when(F.size(items) > 0, F.sequence(F.lit(0), last))
        numbers = F.coalesce(numbers, F.array().cast("array<int>"))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        starts = F.aggregate(numbers, none, start, lambda acc: acc["all"])
        pairs = F.arrays_zip(starts.alias("start"), numbers.alias("number"))
        return F.flatten(F.transform(pairs, results))

    return _let(items, walk)


def matches(text: Column, pattern: str, ok=None, rank: int = 0, kind: str = "") -> Column:
    """Spans of all matches of ``pattern``, in code points; ``ok`` drops some of them.

    The text between matches and the matches themselves give the places.
    """
    between = F.split(text, pattern, -1)

    def after(at: Column, x: Column) -> Column:
        return at + F.length(x["between"]) + F.length(x["found"])

    def span(at: Column, x: Column, _) -> Column:
        return F.struct(
            (at + F.length(x["between"])).alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            after(at, x).alias("end"),
            x["found"].alias("value"),
        )

    def pairs(found: Column) -> Column:
        return F.arrays_zip(F.slice(between, 1, F.size(found)).alias("between"), found.alias("found"))

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pairs)
    spans = _walked(found, after, span, _SPAN)
    return F.filter(spans, lambda s: ok(s["value"])) if ok else spans


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Check sum of a card number: every second digit from the right counts twice."""

    def step(acc: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, digit * 2).otherwise(digit)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), step) % 10 == 0


def _is_ip(value: Column) -> Column:
    def small(part: Column) -> Column:
        return F.coalesce(part.try_cast("int") <= 255, F.lit(False))

    return F.forall(F.split(value, r"\."), small)


def _is_card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


CHECKS = {"ip": _is_ip, "card": _is_card, "phone": _is_phone}


def base_spans(text: Column) -> Column:
    """Spans of all patterns by start, then kind; an empty array for a null text."""
    none = F.array().cast(_SPAN)
    text = F.coalesce(text, F.lit(""))
    each = [
        F.when(
            text.rlike(SIGNS[kind]), matches(text, PATTERNS[kind], CHECKS.get(kind), rank, kind)
        ).otherwise(none)
        for rank, kind in enumerate(KINDS)
    ]
    return F.array_sort(F.concat(*each))


def _row_key(key: str, text: str) -> list[Column]:
    """Columns by which a row is known again; equal rows are alike in everything found."""
    return [
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k0"),
        F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("k1"),
    ]


def scanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: its key columns, ``id`` and base ``spans``.  The texts are not among the columns."""
    found = docs.select(*_row_key(key, text), F.col(key).alias("id"), F.col(text).alias("text"))
    return found.select("k0", "k1", "id", base_spans(F.col("text")).alias("spans"))


def _mentions(scan: DataFrame, support: int) -> DataFrame:
    """``k0``, ``k1``, ``entity`` and ``n_entity`` of the entities in ``support`` documents or more.

    Entities that occur in just the same documents are one row per document, under
    the name of the first of them: a page of a thousand addresses and its copies
    have one such class, not a thousand.
    """
    entity = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["value"]))
    found = scan.where("size(spans) > 0")
    found = found.select("k0", "k1", F.explode(F.array_distinct(entity)).alias("entity"))
    marks = [F.sum(F.xxhash64(F.lit(i), "k0", "k1").cast("decimal(38,0)")) for i in (0, 1)]
    counts = found.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_entity"), marks[0].alias("m0"), marks[1].alias("m1")
    )
    often = written(counts.where(F.col("n_entity") >= support))
    names = often.groupBy("n_entity", "m0", "m1").agg(F.min("entity").alias("entity"))
    names = if_small(written(names.select("entity", "n_entity")), 100_000)
    return written(found.join(names, "entity").dropDuplicates(["k0", "k1", "entity"]))


def _with_texts(docs: DataFrame, key: str, text: str, rows: DataFrame, *columns: str) -> DataFrame:
    """The texts of the documents among ``rows`` (one each), with ``columns`` of those."""
    texts = docs.select(*_row_key(key, text), F.col(text).alias("text"))
    rows = rows.select(F.col("k0").alias("_k0"), F.col("k1").alias("_k1"), *columns)
    same = (F.col("k0") == F.col("_k0")) & (F.col("k1") == F.col("_k1"))
    # equal rows have one key and one text
    found = texts.join(if_small(written(rows), 100_000, *columns), same)
    return found.select("k0", "k1", "text", *columns).dropDuplicates(["k0", "k1"])


def _words(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)))


def disclosing(
    docs: DataFrame, key: str, text: str, mentions: DataFrame, support: int, threshold: float
) -> DataFrame:
    """``entity``, ``term``, ``pmi`` and ``content`` of the terms that reveal an entity.

    Frequencies are documents, counted over all of them: with the entity, with the
    term anywhere in the text, and with both.  Rows count each for itself.
    """
    total = docs.count()
    holders = mentions.groupBy("k0", "k1").agg(
        F.collect_set(F.struct("entity", "n_entity")).alias("entities"), F.count(F.lit(1)).alias("_n")
    )  # classes of one document: fewer than its spans
    copies = docs.select(*_row_key(key, text)).groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("rows"))
    holders = written(holders.drop("_n").join(copies, ["k0", "k1"]))
    texts = _with_texts(docs, key, text, holders, "entities")
    texts = texts.join(holders.select("k0", "k1", "rows"), ["k0", "k1"])
    words = written(texts.select("rows", "entities", F.explode(_words("text")).alias("term")))
    near = words.groupBy("term").agg(F.sum("rows").alias("n_near"))
    both = words.select("rows", "term", F.explode("entities").alias("e"))
    joint = both.groupBy("e.entity", "e.n_entity", "term").agg(F.sum("rows").alias("n_both"))
    joint = joint.where(F.col("n_both") >= support)

    def information(n_term: str) -> Column:
        joined = F.col("n_both") * F.lit(float(total))
        return F.ln(joined / (F.col("n_entity") * F.col(n_term)))

    content = F.ln(F.lit(float(total)) / F.col("n_entity"))
    enough = F.lit(threshold) * F.col("content") - 1e-9
    # a term is in the documents with any entity at least: pairs that this already
    # rules out need no count over the corpus
    open_ = joint.join(near, "term").withColumn("content", content)
    open_ = written(open_.where((F.col("content") > 0) & (information("n_near") >= enough)))
    wanted = written(open_.select("term").distinct())
    terms = docs.select(F.explode(_words(text)).alias("term"))
    terms = terms.join(if_small(wanted), "term", "left_semi")
    terms = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    counted = open_.join(terms, "term").withColumn("pmi", information("n_term"))
    return counted.where(F.col("pmi") >= enough).select("entity", "term", "pmi", "content")


def _term_spans(
    docs: DataFrame, key: str, text: str, scan: DataFrame, mentions: DataFrame, reveals: DataFrame
) -> DataFrame:
    """``k0``, ``k1`` and ``extra``: the occurrences of disclosing terms beside the base spans."""
    fate = F.when(F.col("pmi") >= F.col("content") - 1e-9, "removed").otherwise("generalised")
    # a class of a third of all documents meets few terms: they must reveal it
    hits = mentions.join(if_small(reveals.withColumn("fate", fate), 100_000), "entity")
    hits = written(hits.groupBy("k0", "k1", "term").agg(F.max("fate").alias("fate")))
    holders = scan.join(
        if_small(written(hits.select("k0", "k1").distinct()), 100_000), ["k0", "k1"], "left_semi"
    )
    texts = _with_texts(docs, key, text, holders.dropDuplicates(["k0", "k1"]), "spans")
    hidden = covered(F.col("text"), F.col("spans"), lambda s, at: F.repeat(
        F.lit(" "), F.greatest(s["end"] - F.greatest(at, s["start"]), F.lit(0))
    ))
    places = texts.select("k0", "k1", F.explode(matches(hidden, _WORD)).alias("s"))
    places = places.select("k0", "k1", F.lower("s.value").alias("term"), "s.start", "s.end")
    found = places.join(hits, ["k0", "k1", "term"])
    term = F.struct(
        "start", F.lit(len(KINDS)).alias("rank"), F.lit(TERM).alias("kind"), "end",
        F.col("fate").alias("value"),
    )
    # terms of one text: shorter than the text
    return found.groupBy("k0", "k1").agg(F.collect_list(term).alias("extra"))


def find(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    support: int = SUPPORT,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row of ``docs``: key columns ``k0`` and ``k1``, ``id`` and all ``spans``.

    Spans are ordered by start, then kind as in ``KINDS`` with terms last; their
    ``value`` is the matched text, for terms ``removed`` or ``generalised``.
    Places are code points, the end is exclusive.  Null and empty texts have no
    spans.  Rows count as documents each for itself; equal rows have equal spans.
    Other columns are left out, an empty table gives an empty one.  Long texts: the
    cost of patterns and spans follows their number.
    """
    scan = written(scanned(docs, key, text))
    mentions = _mentions(scan, support)
    reveals = written(disclosing(docs, key, text, mentions, support, threshold))
    extra = written(_term_spans(docs, key, text, scan, mentions, reveals))
    extra = extra.select(F.col("k0").alias("_k0"), F.col("k1").alias("_k1"), "extra")
    joined = scan.join(
        if_small(extra, 100_000, "extra"),
        (F.col("k0") == F.col("_k0")) & (F.col("k1") == F.col("_k1")),
        "left",
    )
    spans = F.array_sort(F.concat("spans", F.coalesce("extra", F.array().cast(_SPAN))))
    return joined.select("k0", "k1", "id", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] != TERM)


def covered(text: Column, spans: Column, label) -> Column:
    """The text with its spans (in order of their starts) replaced by ``label(span, at)``.

    ``at`` is where the spans before end; a span that begins before it overlaps.
    """
    def after(at: Column, s: Column) -> Column:
        return F.greatest(at, s["end"])

    def piece(at: Column, s: Column, extra) -> Column:
        begin, here = extra
        kept = F.substring(here, at - begin + 1, F.greatest(s["start"] - at, F.lit(0)))
        return F.concat(kept, label(s, at))

    def here(begin: Column, end: Column) -> Column:
        return F.substring(text, begin + 1, end - begin)

    pieces = _walked(spans, after, piece, "array<string>", here)
    last = F.aggregate(spans, F.lit(0), after)
    return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))


def rewritten(text: Column, spans: Column) -> Column:
    """The text with every span replaced: entities by their kind, terms by a class or nothing.

    Of overlapping spans the first names the place, and all of them go.
    """
    def label(s: Column, at: Column) -> Column:
        name = (
            F.when(s["kind"] != TERM, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
            .when(s["value"] == "generalised", F.lit("<WORD>"))
            .otherwise(F.lit(""))
        )
        return F.when(s["start"] >= at, name).otherwise(F.lit(""))

    return F.when(F.size(spans) > 0, covered(text, spans, label)).otherwise(text)


def sanitise(
    docs: DataFrame, key: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """``docs`` with the spans replaced in ``text``; the other columns stay as they are.

    Rows without spans pass through; a null text stays null.
    """
    found = find(docs, key, text, **options).where("size(spans) > 0")
    found = written(found.select("k0", "k1", "spans").dropDuplicates(["k0", "k1"]))
    found = found.select(F.col("k0").alias("__pii_k0"), F.col("k1").alias("__pii_k1"), F.col("spans").alias("__pii_spans"))
    k0, k1 = _row_key(key, text)
    joined = docs.withColumns({"__pii_own0": k0, "__pii_own1": k1}).join(
        if_small(found, 100_000, "__pii_spans"),
        (F.col("__pii_own0") == F.col("__pii_k0")) & (F.col("__pii_own1") == F.col("__pii_k1")),
        "left",
    )
    new = F.when(F.col("__pii_spans").isNotNull(), rewritten(F.col(text), F.col("__pii_spans")))
    return joined.withColumn(text, F.coalesce(new, F.col(text))).select(*docs.columns)
