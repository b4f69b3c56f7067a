"""Best-fit packing: bounded-space online best-fit over token pieces.

Each partition is one online stream with `open_bins` open sequences. Open sequences are keyed by free space in a
bitset (bit f is set when some open sequence has f places free), so the best fit is the lowest set bit at or above
the piece's length. When a new sequence is needed and all are open, the fullest closes first. Nothing is shuffled,
the state of a task is `open_bins` integers, and a rerun task gives the same sequences. A stream leaves a few sequences
unfilled at its end, so partitions of few bytes are read as one stream, of about STREAM_BYTES of text.

Defined cases: null text counts as empty (one piece: the end token); repeated rows are packed one by one; an empty
table gives an empty result; very long texts are encoded whole; other columns are ignored. Only documents longer than the capacity are cut, into
pieces of the capacity of which the first may be shorter.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
OPEN_BINS = 1024
#: So many pieces of the stream are put in order of falling length before they are placed.
LOOKAHEAD = 1000
#: Text of a stream, at least, where partitions can be joined.
STREAM_BYTES = 4_000_000
END_ID = 2


class Bins:
    """Open sequences keyed by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_no = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_no

    def place(self, length: int) -> tuple[int, int]:
        """The sequence that gets a piece, and the piece's offset there."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_no = self._take(free)
        else:
            free, bin_no = self.capacity, self.made
            self.made += 1
            if length < free and self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        left = free - length
        if left:
            self.by_free[left].append(bin_no)
            self.bits |= 1 << left
            self.open += 1
        return bin_no, self.capacity - free


class _NotPlain(Exception):
    """A word that cannot be encoded apart from its neighbours."""


class _Words(dict):
    """Token bytes by word. A single space or line feed between two non-space characters always starts a new
    pre-token, so the pieces between them can be encoded one by one; anything else is encoded whole."""

    def __init__(self, encode, before: str, most: int = 500_000):
        super().__init__()
        self.encode, self.before, self.most = encode, before, most

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _NotPlain
        if len(self) >= self.most:
            self.clear()
        ids = self[word] = self.encode(self.before + word)
        return ids


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes bytes as: printable ones stand for themselves, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Texts to little-endian unsigned 32-bit ids by a tokenizers file, with words kept between calls."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        t = self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = t.model, _byte_letters()
        before = t.pre_tokenizer
        plain = t.normalizer is None and isinstance(t.model, models.BPE) and isinstance(before, pre_tokenizers.ByteLevel)
        self.byte_level = plain and not before.add_prefix_space and before.use_regex
        self.first, self.later = _Words(self.word, ""), _Words(self.word, " ")
        self.feed = self.whole("\n")
        self.marks = {c: self.whole(c) for c in ",."}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """A word of letters is one pre-token, which the model takes without the steps around it; a comma or full stop
        after letters is a pre-token of its own."""
        if self.byte_level and max(word) < "\u0250":
            bare = word[1:] if word[0] == " " else word
            if bare.isalpha():
                written = word.encode().decode("latin-1").translate(self.letters)
                return array("I", [x.id for x in self.model.tokenize(written)]).tobytes()
            if bare[-1] in self.marks and bare[:-1].isalpha():
                return (self.later if word[0] == " " else self.first)[bare[:-1]] + self.marks[bare[-1]]
        return self.whole(word)

    def __call__(self, text: str) -> bytes:
        try:
            lines = []
            for line in text.split("\n"):
                head, *words = line.split(" ")
                lines.append(self.first[head] + b"".join(map(self.later.__getitem__, words)))
            return self.feed.join(lines)
        except _NotPlain:
            return self.whole(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.coalesce(max(1, total // STREAM_BYTES))  # larger partitions stay as they are
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = array("I", [end_id]).tobytes()
    names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]

    def run(batches):
        encode, bins, part = encoder(tokenizer_path), Bins(capacity, open_bins), TaskContext.get().partitionId() << 36

        def rows(doc, at, some):
            cols = list(zip(*some))
            return pa.RecordBatch.from_arrays(
                [doc.take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())],
                names,
            )

        def placed(doc, some):
            some.sort(key=lambda x: -x[3])  # stable: long pieces of the lookahead first
            return rows(doc, [x[0] for x in some], [(*x[1:5], part | bin_no, off) for x in some for bin_no, off in [bins.place(x[3])]])

        for b in batches:
            some, held = [], 0
            for i, text in enumerate(b.column(1)):
                ids = (encode(t) if (t := text.as_py()) else b"") + end
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    some.append((i, piece, start, length, ids[4 * start : 4 * (start + length)]))
                held += len(ids)
                if len(some) >= LOOKAHEAD or held > 16_000_000:
                    yield placed(b.column(0), some)
                    some, held = [], 0
            if some:
                yield placed(b.column(0), some)

    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
