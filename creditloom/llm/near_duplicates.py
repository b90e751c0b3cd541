"""Join of documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

Copies (equal words) are merged first.  The others get MinHash signatures, cut
into the labels of several prefix tries (as in an LSH forest).  The prefix length is
fixed beforehand: the longest with which a pair at the threshold meets with the
target probability; documents that share a prefix of this length in some trie are
candidates.  A sketch of one bit per hash drops hopeless pairs, the words
themselves decide.

A trie node with few documents gives all its pairs.  One with many is split by
its longer prefixes: every node below it gives its pairs if it is small enough,
and the pairs with its first document if not.  What these leave apart is compared
in blocks inside tasks, which only return links between classes not yet joined.

Then links are counted.  A class without members in large nodes has all its pairs
already.  In the others every member is compared with every other one, block
against block, and tasks return sums per document instead of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.tables import components, if_small, written
from creditloom.llm.text import mapped, steps, texts_of, word_codes, words_of
from creditloom.operators.lookup import lookup_join

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9995
TREES, LABEL = 16, 8

#: Documents up to which a trie node gives all its pairs, and of a block in larger ones.
FEW, BLOCK = 24, 256

#: Distinct shingles that are counted at a time when two blocks are compared.
STRIP = 4096

#: Similarities this close to the threshold by hashes are decided by the words.
MARGIN = 0.01

#: Most differing bits among TREES * LABEL = 128: 12.8 are expected at the
#: threshold, with a deviation of 3.4.
DIFFERENT = 29

_HASHES = np.random.default_rng(5)
_SCALE = _HASHES.integers(1, 2**63, TREES * LABEL, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _HASHES.integers(1, 2**63, TREES * LABEL, dtype=np.uint64)
_PLACE = _HASHES.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def depth(threshold: float, recall: float, trees: int = TREES, label: int = LABEL) -> int:
    """Longest prefix with which a pair at the threshold meets in some trie with probability ``recall``."""
    for length in range(label, 1, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    return 1


def levels(length: int, label: int = LABEL, step: int = 2) -> list[int]:
    """Prefix lengths of the trie nodes that are kept, from full labels to ``length``."""
    return [*range(label, length, -step), length]


def shingles(words: list[bytes], size: int = WORDS) -> set[tuple[bytes, ...]]:
    """Runs of ``size`` words; all words as one run if there are fewer, nothing without words."""
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(size))))


def shingle_codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every run of words, in order."""
    codes = word_codes(words)
    if len(codes) < WORDS:
        codes = np.pad(codes, (0, WORDS - len(codes)))
    count = len(codes) - WORDS + 1
    out = np.zeros(count, dtype=np.uint64)
    for i in range(WORDS):
        out = (out ^ (codes[i : i + count] * _PLACE[i])) * _MIX
        out ^= out >> np.uint64(29)
    return out


def similarity(a: set, b: set) -> float:
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) if shared else 0.0


def signed(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """``doc_id``, ``same`` (digest of the words), ``prefixes`` and the sketch.

    ``prefixes`` names the document's node in every trie, for every one of
    ``levels(length)``: first all of the longest, last all of ``length``.  All but
    ``doc_id`` are null for a text without words.
    """
    lead, kept = np.arange(TREES, dtype=np.uint64), set(levels(length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            words = [words_of(t) for t in texts_of(batch)]
            full = [i for i, w in enumerate(words) if w]
            same: list = [None] * len(words)
            prefixes: list = [None] * len(words)
            halves: list = [[None] * len(words), [None] * len(words)]
            if full:
                codes = [shingle_codes(words[i]) for i in full]
                starts = np.cumsum([0] + [len(c) for c in codes[:-1]])
                every = np.concatenate(codes)
                least = np.empty((len(full), TREES * LABEL), dtype=np.uint64)
                for h in range(TREES * LABEL):
                    hashed = (every * _SCALE[h] + _SHIFT[h]) >> np.uint64(32)
                    least[:, h] = np.minimum.reduceat(hashed, starts)
                trie = np.zeros((len(full), TREES), dtype=np.uint64) + lead
                labels = least.reshape(len(full), TREES, LABEL)
                nodes = []
                for i in range(LABEL):
                    trie = (trie ^ labels[:, :, i]) * _MIX
                    trie = trie ^ (trie >> np.uint64(31))
                    if i + 1 in kept:
                        nodes.insert(0, trie)
                bits = np.packbits((least & np.uint64(1)).astype(bool), axis=1).view(np.int64)
                trie = np.concatenate(nodes, axis=1).view(np.int64)
                for row, i in enumerate(full):
                    same[i] = blake2b(b" ".join(words[i]), digest_size=16).digest()
                    prefixes[i] = trie[row].tolist()
                    halves[0][i], halves[1][i] = bits[row].tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(same, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(halves[0], pa.int64()),
                    pa.array(halves[1], pa.int64()),
                ],
                names=["doc_id", "same", "prefixes", "s0", "s1"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, same binary, prefixes array<long>, s0 long, s1 long"
    return mapped(rows, run, schema)


def _alike(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    different = F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))
    return different <= DIFFERENT


def _candidates(members: DataFrame) -> DataFrame:
    """Pairs ``a < b``: all of small trie nodes, those with the first document of large ones."""
    few = members.where(F.col("size") <= FEW)
    lists = few.groupBy("bucket").agg(F.collect_list(F.struct("node", "s0", "s1")).alias("in"))
    left = lists.select("in", F.explode("in").alias("x"))
    pairs = left.select("x", F.explode("in").alias("y")).where("x.node < y.node")
    first = members.where(F.col("size") > FEW).select(
        F.col("pivot").alias("x"), F.struct("node", "s0", "s1").alias("y")
    )
    both = pairs.unionByName(first.where("x.node <> y.node"))
    alike = both.where(
        _alike(F.col("x.s0"), F.col("x.s1"), F.col("y.s0"), F.col("y.s1"))
    )
    return alike.select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
    ).distinct()


def _below(members: DataFrame, sketches: DataFrame, deeper: int) -> DataFrame:
    """Members of the longer prefixes' nodes under the large nodes, as in ``members``."""
    large = members.where(F.col("size") > FEW).select("tree", F.col("node").alias("_node"))
    level = F.explode(F.sequence(F.lit(0), F.lit(deeper - 1))).alias("level")
    rows = large.join(sketches, F.col("node") == F.col("_node")).select(
        "node", "s0", "s1", "tree", "prefixes", level
    )
    place = F.col("level") * TREES + F.col("tree")
    rows = written(rows.select("node", "s0", "s1", "tree", F.get("prefixes", place).alias("bucket")))
    return _sized(rows, rows)


def _sized(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """``placed`` with the size and the first document of each trie node of at least two."""
    sizes = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "s0", "s1")).alias("pivot")
    ).where("size > 1").withColumnRenamed("bucket", "_bucket")
    shared = if_small(written(sizes), 100_000)
    return written(placed.join(shared, F.col("bucket") == F.col("_bucket")).drop("_bucket"))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose words are similar enough, with their ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text_a"):
            found = [
                similarity(shingles(words_of(x)), shingles(words_of(y)))
                for x, y in zip(texts_of(batch, "text_a"), texts_of(batch, "text_b"))
            ]
            kept = pa.array([s >= threshold for s in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(found, pa.float64())],
                names=["a", "b", "similarity"],
            ).filter(kept)

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return mapped(rows, run, "a long, b long, similarity double")


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of large trie nodes whose documents are still in several classes.

    ``main`` says whether a member is in the node's largest class; ``mains`` and
    ``others`` are the numbers of blocks of either kind.
    """
    large = members.where(F.col("size") > FEW).select("bucket", "tree", "node")
    roots = roots.withColumnRenamed("node", "_node")
    classed = large.join(roots, F.col("node") == F.col("_node"), "left").select(
        "bucket", "tree", "node", F.coalesce("root", "node").alias("root")
    )
    classed = written(classed)
    sizes = classed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    tops = sizes.groupBy("bucket").agg(
        F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all")
    )
    tops = tops.where(F.col("all") > F.col("top.n")).select(
        F.col("bucket").alias("_bucket"),
        F.col("top.root").alias("top"),
        F.ceil(F.col("top.n") / BLOCK).cast("int").alias("mains"),
        F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("others"),
    )
    return classed.join(written(tops), F.col("bucket") == F.col("_bucket")).select(
        "bucket", "tree", "node", "root", (F.col("root") == F.col("top")).alias("main"),
        "mains", "others",
    )


def _block_links(
    apart: DataFrame, sketches: DataFrame, texts: DataFrame, threshold: float, shortest: Column
) -> DataFrame:
    """Links between classes inside large trie nodes, found block against block.

    Blocks of the largest class meet the other blocks but not each other.  A
    pair is looked at in the first trie it shares a node of.  A task returns at
    most one link fewer than it has classes.
    """
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others")))
    mine = F.when(F.col("main"), mine).otherwise(mine + F.col("mains"))
    rows = apart.withColumn("mine", mine.cast("int"))
    low = F.when(F.col("main"), F.col("mains")).otherwise(F.lit(0))
    other = F.explode(F.sequence(low, F.col("mains") + F.col("others") - 1)).alias("other")
    rows = rows.select("bucket", "tree", "node", "root", "mine", other)
    rows = rows.select(
        "bucket", "tree", "node", "root", "mine",
        F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
    )
    facts = sketches.join(texts, "node").select(
        F.col("node").alias("_node"), shortest.alias("prefixes"), "s0", "s1", "text"
    )
    rows = rows.join(written(facts), F.col("node") == F.col("_node")).drop("_node")
    few = DIFFERENT

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["node", "text"], kind="stable")
        i, j, tree = (int(group[c].iloc[0]) for c in ("i", "j", "tree"))
        words = [words_of((t or "").encode()) for t in group["text"]]
        codes = [np.unique(shingle_codes(w)) for w in words]
        sketch = group[["s0", "s1"]].to_numpy(dtype=np.int64).view(np.uint64)
        prefixes = np.array(group["prefixes"].tolist(), dtype=np.int64)
        mine, node = group["mine"].to_numpy(), group["node"].to_numpy()
        root = dict(enumerate(group["root"].tolist()))
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        links = []
        for x in range(len(node)):
            if mine[x] != i:
                continue
            unlike = np.bitwise_count(sketch ^ sketch[x]).sum(axis=1)
            others = (mine == j) & (unlike <= few)
            if i == j:
                others &= np.arange(len(node)) > x
            for y in np.flatnonzero(others).tolist():
                p, q = top(root[x]), top(root[y])
                if p == q or int((prefixes[x] == prefixes[y]).argmax()) != tree:
                    continue
                small, large = sorted((len(codes[x]), len(codes[y])))
                if small < threshold * large * 0.99:
                    continue
                both = np.intersect1d(codes[x], codes[y], assume_unique=True).size
                if both < (threshold - 0.01) * (small + large - both):
                    continue
                value = similarity(shingles(words[x]), shingles(words[y]))
                if value >= threshold:
                    parent[max(p, q)] = min(p, q)
                    links.append((min(node[x], node[y]), max(node[x], node[y]), value))
        return pd.DataFrame(links, columns=["a", "b", "similarity"])

    return rows.groupBy("bucket", "i", "j").applyInPandas(
        run, "a long, b long, similarity double"
    )


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of codes every one of ``left`` has in common with every one of ``right``."""
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    own, other = (np.unique(np.concatenate(side)) for side in (left, right))
    common = np.intersect1d(own, other, assume_unique=True)

    def places(side: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(side)), [len(c) for c in side])
        every = np.concatenate(side)
        at = np.searchsorted(common, every)
        known = common[np.minimum(at, len(common) - 1)] == every
        order = np.argsort(at[known], kind="stable")
        return row[known][order], at[known][order]

    if not len(common):
        return out
    (row_l, at_l), (row_r, at_r) = places(left), places(right)
    for start in range(0, len(common), STRIP):
        strips = []
        for side, row, at in ((left, row_l, at_l), (right, row_r, at_r)):
            low, high = np.searchsorted(at, [start, start + STRIP])
            strip = np.zeros((len(side), STRIP), dtype=np.float32)
            strip[row[low:high], at[low:high] - start] = 1
            strips.append(strip)
        out += strips[0] @ strips[1].T
    return out


def _alike_pairs(left: list[list[bytes]], right: list[list[bytes]], threshold: float) -> np.ndarray:
    """Whether each text of ``left`` is similar enough to each of ``right``, from their words."""
    codes_l, codes_r = ([np.unique(shingle_codes(w)) for w in side] for side in (left, right))
    both = _shared(codes_l, codes_r)
    sizes = np.add.outer([len(c) for c in codes_l], [len(c) for c in codes_r])
    value = both / (sizes - both)
    out = value >= threshold
    for x, y in np.argwhere(np.abs(value - threshold) <= MARGIN).tolist():
        out[x, y] = similarity(shingles(left[x]), shingles(right[y])) >= threshold
    return out


def _block_counts(
    roots: DataFrame, members: DataFrame, copies: DataFrame, texts: DataFrame, threshold: float
) -> DataFrame:
    """``node`` and ``links`` for all members of classes that reach into large trie nodes.

    Each member meets each other one once; ``links`` sums the copies of those
    that are similar enough.
    """
    large = members.where(F.col("size") > FEW).select(F.col("node").alias("_node")).distinct()
    reached = roots.join(large, F.col("node") == F.col("_node"), "left_semi")
    reached = written(reached.select(F.col("root").alias("_root")).distinct())
    inside = roots.join(if_small(reached, 100_000), F.col("root") == F.col("_root"), "left_semi")
    sizes = written(inside.groupBy(F.col("root").alias("_root")).agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    ))
    rows = inside.join(if_small(sizes, 100_000), F.col("root") == F.col("_root"))
    rows = rows.join(copies, "node").join(texts, "node")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("root", "node", "copies", "text", "mine", other)
    rows = rows.select(
        "root", "node", "copies", "text", "mine",
        F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["node", "text"], kind="stable")
        i, j = (int(group[c].iloc[0]) for c in ("i", "j"))
        sides = [group[group["mine"] == k] for k in (i, j)]
        if not all(map(len, sides)):
            return pd.DataFrame({"node": [], "links": []}).astype("int64")
        words = [[words_of((t or "").encode()) for t in side["text"]] for side in sides]
        alike = _alike_pairs(*words, threshold)
        # texts of one id are one document
        (left, firsts_l), (right, firsts_r) = (
            np.unique(side["node"].to_numpy(), return_index=True) for side in sides
        )
        alike = np.logical_or.reduceat(alike, firsts_l, axis=0)
        alike = np.logical_or.reduceat(alike, firsts_r, axis=1)
        weight_l, weight_r = (
            side["copies"].to_numpy()[f] for side, f in zip(sides, (firsts_l, firsts_r))
        )
        if i == j:
            np.fill_diagonal(alike, False)
            return pd.DataFrame({"node": left, "links": alike @ weight_r})
        return pd.DataFrame({
            "node": np.concatenate([left, right]),
            "links": np.concatenate([alike @ weight_r, weight_l @ alike]),
        })

    parts = rows.groupBy("root", "i", "j").applyInPandas(run, "node long, links long")
    return parts.groupBy("node").agg(F.sum("links").alias("links"))


def _link_counts(
    links: DataFrame, roots: DataFrame, members: DataFrame, groups: DataFrame,
    texts: DataFrame, threshold: float,
) -> DataFrame:
    """``node`` and ``links``, the documents of other words that each is similar enough to."""
    copies = groups.groupBy("node").agg(F.max("copies").alias("copies"))
    blocks = written(_block_counts(roots, members, copies, texts, threshold))
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("partner"))
    ends = ends.union(links.select("b", "a"))
    known = if_small(blocks).select(F.col("node").alias("_node"))
    ends = ends.join(known, F.col("node") == F.col("_node"), "left_anti")
    weights = copies.withColumnRenamed("node", "partner")
    counts = ends.join(weights, "partner").groupBy("node").agg(F.sum("copies").alias("links"))
    return counts.union(blocks)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` as a written table with a number per row, which stays what it is."""
    return written(docs.withColumn(name, F.monotonically_increasing_id()))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """One row per document: ``key``, ``class_id``, ``n_copies`` and ``n_links``.

    ``class_id`` is the smallest id the document is connected with by links of
    similarity ``threshold`` or more; copies are in one class.  ``n_copies``
    counts documents with the same words (1 for a document by itself).
    ``n_links`` counts the other documents of similarity ``threshold`` or more: its
    copies, and each copy of every different text.

    Every row is a document, also those of one id and those without an id, which
    name a class only if no member has one.  Texts without words (null, empty,
    only marks) are in no group.  Very long texts are taken whole.  An empty table
    gives an empty one.  Ids are whole numbers; other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = numbered(rows, "row")
    found = by_number(rows, "row", "text", threshold, recall)
    found = written(rows.select("id", "row").join(found, "row"))
    # copies and links make a class: only classes of several rows need a name
    names = found.where("n_links > 0").groupBy("class").agg(F.min("id").alias("name"))
    named = lookup_join(found, written(names), ["class"])
    return named.select(
        F.col("id").alias(key),
        F.when(F.col("n_links") > 0, F.col("name")).otherwise(F.col("id")).alias("class_id"),
        "n_copies",
        "n_links",
    )


def by_number(
    rows: DataFrame, number: str, text: str, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """``number``, ``class`` (its smallest number), ``n_copies`` and ``n_links`` of numbered rows."""
    length = depth(threshold, recall)
    marks = written(signed(rows, number, text, length))
    groups = marks.where("same is not null").groupBy("same").agg(
        F.min("doc_id").alias("node"),
        F.count(F.lit(1)).alias("copies"),
        F.first("prefixes").alias("prefixes"),
        F.first("s0").alias("s0"),
        F.first("s1").alias("s1"),
    )
    groups = written(groups)
    sketches = groups.select("node", "prefixes", "s0", "s1")
    deeper = len(levels(length)) - 1
    shortest = F.slice("prefixes", deeper * TREES + 1, TREES)
    placed = sketches.select("node", "s0", "s1", F.posexplode(shortest).alias("tree", "bucket"))
    # hashes of different tries are different numbers, so the number is the trie node
    members = _sized(placed, placed)
    below = _below(members, sketches, deeper) if deeper else members.limit(0)
    pairs = written(_candidates(members).union(_candidates(below)).distinct())
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    wanted = wanted.union(members.where(F.col("size") > FEW).select("node")).distinct()
    texts = rows.select(F.col(number).alias("node"), F.col(text).alias("text"))
    texts = written(texts.join(if_small(written(wanted)), "node", "left_semi").distinct())
    links = written(_verified(pairs, texts, threshold))
    roots = written(components(links))
    apart = written(_apart(members, roots))
    if apart.limit(1).count():
        more = written(_block_links(apart, sketches, texts, threshold, shortest))
        if more.limit(1).count():
            links = written(links.union(more).groupBy("a", "b").agg(F.max("similarity")))
            roots = written(components(links))
    counts = _link_counts(links, roots, members, groups, texts, threshold)
    found = _classes(marks, groups, counts, roots)
    return found.withColumnsRenamed({"doc_id": number, "class_id": "class"})


def _classes(marks: DataFrame, groups: DataFrame, counts: DataFrame, roots: DataFrame) -> DataFrame:
    """Every document with its class and counts, put together by the words it has."""
    linked = roots.join(counts, "node", "left").select(
        F.col("node").alias("_node"), "root", "links"
    )
    facts = groups.join(linked, F.col("node") == F.col("_node"), "left").where(
        "copies > 1 or root is not null"
    )
    facts = facts.select(
        F.col("same").alias("_same"),
        F.coalesce("root", "node").alias("root"),
        "copies",
        F.coalesce("links", F.lit(0)).alias("links"),
    )
    # rows without words have no digest and would meet in one task
    wordy = marks.select("doc_id", F.col("same").alias("_same")).where("_same is not null")
    joined = lookup_join(wordy, written(facts), ["_same"])
    rest = marks.where("same is null").select(
        "doc_id", *(F.lit(None).cast("long").alias(c) for c in ("root", "copies", "links"))
    )
    joined = joined.select("doc_id", "root", "copies", "links").union(rest)
    return joined.select(
        "doc_id",
        F.coalesce("root", "doc_id").alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
    )
