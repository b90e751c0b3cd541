"""SentencePiece (merge-type) encoding and decoding without the library.

For every prefix of a text there is exactly one token its encoding ends with.
The table of these last tokens is filled from left to right: an Aho-Corasick
automaton lists the tokens that end at a position, longest first, and the one
wanted is the first that is compatible with the last token of the prefix before
it.  Two tokens are compatible if merging their joined text gives just these
two.  The ids are then read off backwards.

No token holds a blank after another character, so a text is cut before its
runs of blanks and each distinct piece of text is encoded once per task.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from creditloom.llm.text import mapped, steps, texts_of, with_arrays, with_fields

BLANK = "▁"
LATIN = "A-Za-zÀ-ɏ"

#: Distinct chunks (twice as many at most: those seen lately and those before) and
#: pairs of tokens that a task remembers.
CHUNKS, PAIRS = 150_000, 300_000

codecs.register_error(
    "per_byte", lambda e: ("�" * (e.end - e.start), e.end)
)


class Vocabulary:
    """Tokens, scores and kinds of a model file; small and of fixed size, so it is broadcast."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        kinds = [
            "byte" if model.is_byte(i)
            else "control" if model.is_control(i)
            else "unknown" if model.is_unknown(i)
            else "piece"
            for i in range(size)
        ]
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.kinds = kinds
        self.scores = {
            p: model.get_score(i) for i, p in enumerate(self.pieces) if kinds[i] == "piece"
        }
        self.unknown = kinds.index("unknown")
        probe = model.encode("a", out_type=str)
        self.prefix = BLANK if "".join(probe).startswith(BLANK) else ""
        same = "Éﬁ  x\t　"
        if model.decode(model.encode(same)) != same:
            raise ValueError("only models that keep texts as they are can be encoded")
        if any(re.search(f"[^{BLANK}]{BLANK}|\n.|.\n", p, re.S) for p in self.scores):
            raise ValueError("a token goes over a word's end")
        ordered = sorted(set(self.scores.values()), reverse=True)
        places = {score: i for i, score in enumerate(ordered)}
        self.ranks = {p: places[score] for p, score in self.scores.items()}
        self.whole, self.parts, self.uneven = [], {}, set()
        for piece in sorted(self.scores, key=len):
            *_, before, whole = [None, *self.merges(piece)]
            if whole != [piece]:
                continue
            self.whole.append(piece)
            if len(piece) > 1:
                self.parts[piece] = tuple(before)
                inner = [p for p in before if len(p) > 1]
                if any(self.ranks[p] >= self.ranks[piece] or p in self.uneven for p in inner):
                    self.uneven.add(piece)
        #: Where a text may be cut: before a line end, before blanks, and after Latin
        #: letters if no token goes on from one of them to anything else.
        letters, others = f"[{LATIN}]", f"[^{LATIN}{BLANK}\n]"
        if any(re.search(f"{letters}[^{LATIN}]", p) for p in self.scores):
            self.cut = f"(?:\n|{BLANK}+)[^{BLANK}\n]*|[^{BLANK}\n]+"
        else:
            tail = f"{others}*{letters}*"
            self.cut = f"(?:\n|{BLANK}+){tail}|{others}+{letters}*|{letters}+"

    def merges(self, text: str) -> Iterator[list[str]]:
        """States of a short text while merging: best score first, then leftmost."""
        parts, scores = list(text), self.scores
        while True:
            yield list(parts)
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def merged(self, text: str) -> list[str]:
        *_, state = self.merges(text)
        return state


class Encoder:
    """Prefix tables over one vocabulary; lives in a task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece in vocabulary.whole:
            if len(piece) > 1:
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.ids: dict[str, bytes] = {
            p: np.int32(i).tobytes()
            for i, p in enumerate(vocabulary.pieces)
            if vocabulary.kinds[i] == "piece"
        }
        self.bytes = {
            int(p[1:-1], 16): i
            for i, p in enumerate(vocabulary.pieces)
            if vocabulary.kinds[i] == "byte"
        }
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.cut = re.compile(vocabulary.cut)

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` gives these two tokens.

        Their last merges are undone one by one, the later first.  At each
        state the two characters' runs at the seam must not have joined before
        the merge undone last; at equal score the leftmost pair merges first.
        """
        rank, parts = self.vocabulary.ranks, self.vocabulary.parts
        if left in self.vocabulary.uneven or right in self.vocabulary.uneven:
            return self.vocabulary.merged(left + right) == [left, right]
        limit, ties = len(rank) + 1, False
        while True:
            joined = rank.get(left + right)
            if joined is not None and (joined < limit or ties and joined == limit):
                return False
            of_left = rank[left] if left in parts else -1
            of_right = rank[right] if right in parts else -1
            if of_left > of_right:
                limit, ties, left = of_left, False, parts[left][1]
            elif of_right >= 0:
                limit, ties, right = of_right, True, parts[right][0]
            else:
                return True

    def tokens(self, chunk: str) -> list[str]:
        """Tokens of a chunk; a character outside the vocabulary stands for itself."""
        last, done, pairs = list(chunk), -1, self.pairs
        for end, (piece, length) in self.automaton.iter(chunk):
            if end == done:
                continue
            start = end - length
            if start >= 0:
                pair = (last[start], piece)
                known = pairs.get(pair)
                if known is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    known = pairs[pair] = self.compatible(*pair)
                if not known:
                    continue
            last[end] = piece
            done = end
        out, end = [], len(chunk)
        while end:
            piece = last[end - 1]
            out.append(piece)
            end -= len(piece)
        return out[::-1]

    def chunk_ids(self, chunk: str) -> bytes:
        """Ids of a chunk that is not among those seen lately."""
        known, ids = self.earlier.get(chunk), self.ids
        if known is None:
            known = b"".join([ids.get(t) or self._id(t) for t in self.tokens(chunk)])
        if len(self.chunks) >= CHUNKS:
            self.earlier, self.chunks = self.chunks, {}
        if len(chunk) < 64:
            self.chunks[chunk] = known
        return known

    def _id(self, token: str) -> bytes:
        """Ids of a character outside the vocabulary."""
        if not self.bytes:
            return np.int32(self.vocabulary.unknown).tobytes()
        return np.array([self.bytes[b] for b in token.encode()], dtype=np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed 32-bit integers."""
        if not text:
            return b""
        marked = self.vocabulary.prefix + text.replace(" ", BLANK)
        miss = self.chunk_ids
        return b"".join([self.chunks.get(c) or miss(c) for c in self.cut.findall(marked)])


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.texts = []
        for piece, kind in zip(vocabulary.pieces, vocabulary.kinds):
            if kind == "byte":
                self.texts.append(bytes([int(piece[1:-1], 16)]))
            elif kind == "control":
                self.texts.append(b"")
            elif kind == "unknown":
                self.texts.append(" ⁇ ".encode())
            else:
                self.texts.append(piece.replace(BLANK, " ").encode())
        self.cut = bool(vocabulary.prefix)
        self.control = {i for i, k in enumerate(vocabulary.kinds) if k == "control"}
        self.marked = {
            i for i, p in enumerate(vocabulary.pieces) if p[:1] == BLANK
        }

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; the blank put before a text when encoding goes again."""
        body = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "per_byte")
        if self.cut:
            first = next((i for i in ids if i not in self.control), None)
            if first in self.marked:
                return body[1:]
        return body


def encode(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """``docs`` with the token ids of ``text`` as an integer array, without begin or end ids.

    A null or empty text has no ids.  The text is never shortened.  An input
    column with the name of the new one is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # fixed size of a vocabulary
    field = T.StructField(ids, T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in steps(batches, text, 1 << 20):
            lists = _packed([encoder.encode(x.decode()) for x in texts_of(batch, text)])
            yield with_arrays(batch, {ids: lists})

    return mapped(docs, run, with_fields(docs.schema, [field]))


def round_trip(
    docs: DataFrame,
    vocabulary: Vocabulary,
    text: str = "text",
    ids: str = "ids",
    decoded: str = "decoded",
) -> DataFrame:
    """:func:`encode` and :func:`decode` of its ids in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    fields = [
        T.StructField(ids, T.ArrayType(T.IntegerType(), False)),
        T.StructField(decoded, T.StringType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for batch in steps(batches, text, 1 << 20):
            lists = _packed([encoder.encode(x.decode()) for x in texts_of(batch, text)])
            texts = [decoder.decode(r) for r in _lists(lists)]
            yield with_arrays(batch, {ids: lists, decoded: pa.array(texts, pa.string())})

    return mapped(docs, run, with_fields(docs.schema, fields))


def _packed(rows: list[bytes]) -> pa.ListArray:
    """Rows of packed 32-bit integers as an array column."""
    ends = np.cumsum([0] + [len(r) // 4 for r in rows]).astype(np.int32)
    values = pa.Array.from_buffers(
        pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(rows))]
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _lists(column: pa.ListArray) -> Iterator[list[int]]:
    """The integer lists of an array column, null as empty."""
    ends = column.offsets.to_numpy().tolist()
    values = column.values.to_numpy(zero_copy_only=False)
    for start, end in zip(ends, ends[1:]):
        yield values[start:end].tolist()


def decode(
    docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded"
) -> DataFrame:
    """``docs`` with the text of an id array; null and empty arrays give an empty text.

    Byte tokens that make no valid UTF-8 become one replacement character each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = [decoder.decode(r) for r in _lists(batch.column(ids))]
                yield with_arrays(batch, {text: pa.array(texts, pa.string())})

    return mapped(docs, run, with_fields(docs.schema, [T.StructField(text, T.StringType())]))
