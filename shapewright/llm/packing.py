"""Harmonic packing of documents into training sequences.

A document of n tokens is of class floor(capacity / n), and a bin of class j takes exactly j whole documents of its class. Each
worker fills its own bins and needs to know nothing of the others, so no row is moved. What a full bin leaves free, the gap, is given
to what lies over, that is documents shorter than those of class LAST, and else to the head of the documents that come next, the last
of which is cut; so a sequence cuts one document or none and wastes fewer than LEAST_GAP tokens. Of a document longer than the
capacity whole sequences are cut first. At the end documents of bins that never filled are laid end to end and cut at the capacity; the
last stretch is cut at powers of two, which need no padding. Thus padding does not grow with the number of workers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import quoted, slices

CAPACITY = 4096
LAST = 64
LEAST_GAP = 8
"""Free tokens of a sequence from which on they are filled; fewer are padding, as a piece of a few tokens teaches nothing."""
END_ID = 2
MEMO = 300_000
"""Entries of each memory of tokenised words in a worker; it is emptied when it has so many."""
PIECES = 256
"""Pieces of a batch that a worker gives."""
TOKENIZER = "word_bpe_49k.json"
# Fixed values of such tokenizer files: how they normalise and cut texts. None of it reaches across white space.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
CUT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Little-endian 32-bit ids of texts by a `tokenizers` file.

    A file that is not known to cut at white space, by NORMALIZERS and CUT, gets every text whole. Otherwise a text is cut at spaces and line ends and each distinct chunk is tokenised once. A chunk of basic Latin or Latin-1 letters followed by
    plain punctuation is split there, as the file's own pre-tokenizer does, and its lower-cased letters go to the file's model
    alone; any other chunk goes through the whole tokenizer.
    """

    plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.;:!?*#$%&]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        about = json.loads(Path(path).read_text())
        cuts = (about["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.apart = (about["normalizer"] or {}).get("normalizers") == NORMALIZERS and cuts[0] == CUT and [c["type"] for c in cuts[1:]] == ["ByteLevel"] and not cuts[1]["add_prefix_space"]
        self.model = self.whole.model
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte = {chr(b): alphabet.pre_tokenize_str(chr(b))[0][0] for b in range(0x20, 0x7F)}
        two = [alphabet.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)]
        self.byte |= {chr(c): x for c, x in zip(range(0x80, 0x100), two, strict=True)}
        self.letters = str.maketrans(self.byte)

    def piece(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= MEMO:
                self.words.clear()
            got = self.words[word] = b"".join(x.id.to_bytes(4, "little") for x in self.model.tokenize(word.translate(self.letters)))
        return got

    def chunk(self, text: str) -> bytes:
        if m := self.plain.fullmatch(text):
            got = self.piece(m[1].lower()) + (self.piece(m[2]) if m[2] else b"")
        else:
            got = b"".join(i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids)
        if len(self.chunks) >= MEMO:
            self.chunks.clear()
        if len(text) < 64:
            self.chunks[text] = got
        return got

    def __call__(self, text: str) -> bytes:
        if not self.apart:
            return b"".join(i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids)
        get, chunk = self.chunks.get, self.chunk
        return b"".join([get(x) or chunk(x) for x in text.replace("\n", " ").split(" ") if x])


class Packer:
    """Gives pieces (document, start, ids, sequence, offset) of documents, in one worker.

    Sequence numbers are first, first + 1, ...; a document is any small object. An open bin holds fewer than j documents of class j,
    none longer than capacity / j, so all open bins hold fewer than capacity * last ids. One sequence with a gap is held at most: what
    comes next fills it before anything else.
    """

    def __init__(self, first: int = 0, capacity: int = CAPACITY, last: int = LAST):
        self.next, self.capacity, self.last = first, capacity, min(last, capacity)
        self.open: dict[int, list] = {}
        self.held: list = []
        self.held_size = 0
        self.tail: list = []
        self.tail_size = 0

    def add(self, document, ids: bytes) -> Iterator[tuple]:
        start, tokens = 0, len(ids) // 4
        if self.held:
            start = min(tokens, self.capacity - self.held_size)
            self.hold(document, 0, ids[: 4 * start])
            yield from self.settled()
        while tokens - start >= self.capacity:
            yield from self.sequence([(document, start, ids[4 * start : 4 * (start + self.capacity)])])
            start += self.capacity
        if start == tokens:
            return
        j = self.capacity // (tokens - start)
        if j > self.last:
            yield from self.add_tail(document, start, ids[4 * start :])
            return
        bin_ = self.open.setdefault(j, [])
        bin_.append((document, start, ids[4 * start :]))
        if len(bin_) == j:
            for piece in [*bin_, *self.taken(self.capacity - sum(len(x) // 4 for *_, x in bin_))]:
                self.hold(*piece)
            bin_.clear()
            yield from self.settled()

    def hold(self, document, start: int, ids: bytes) -> None:
        self.held.append((document, start, ids))
        self.held_size += len(ids) // 4

    def settled(self) -> Iterator[tuple]:
        """The sequence that is held, once its gap is small enough."""
        if self.capacity - self.held_size < LEAST_GAP:
            yield from self.sequence(self.held)
            self.held, self.held_size = [], 0

    def sequence(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for d, b, x in pieces:
            yield d, b, x, self.next, offset
            offset += len(x) // 4
        self.next += 1

    def add_tail(self, document, start: int, ids: bytes) -> Iterator[tuple]:
        self.tail.append((document, start, ids))
        self.tail_size += len(ids) // 4
        while self.tail_size >= self.capacity:
            yield from self.sequence(self.taken(self.capacity))

    def taken(self, size: int) -> list:
        """Pieces of the tail's first size tokens, or of all it has."""
        out = []
        while size and self.tail:
            d, b, x = self.tail.pop(0)
            n = min(size, len(x) // 4)
            out.append((d, b, x[: 4 * n]))
            size, self.tail_size = size - n, self.tail_size - n
            if 4 * n < len(x):
                self.tail.insert(0, (d, b + n, x[4 * n :]))
        return out

    def close(self) -> Iterator[tuple]:
        left = [*self.held, *[x for _, bin_ in sorted(self.open.items()) for x in bin_]]
        self.open, self.held, self.held_size = {}, [], 0
        for d, b, x in left:
            yield from self.add_tail(d, b, x)
        while self.tail_size:
            yield from self.sequence(self.taken(1 << (self.tail_size.bit_length() - 1)))


FIELDS = [
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
]


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, make: Callable | None = None) -> DataFrame:
    """A row for each piece: doc_id (the key), start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's tokens are those of path's tokenizer, without special ones, then end_id; so a null or empty text is one token.
    Cutting leaves each token in exactly one piece. sequence_id is the task's number times 2**40 plus a count. Repeated rows, equal
    and null keys are packed as the rows they are; other columns are not read, whatever their names; key: a column of integers. An
    empty table gives no pieces. A worker holds the ids of fewer than j pieces of each class j and of one tail, 1 MB in all, beside
    the current slice, so memory is bounded by the longest text.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = (make or WordTokenizer)(path)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        end = end_id.to_bytes(4, "little")

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            parts = [[d[0] for d, *_ in pieces], [p[1] for p in pieces], [len(p[2]) // 4 for p in pieces], [p[2] for p in pieces], [d[1] for d, *_ in pieces], [p[3] for p in pieces], [p[4] for p in pieces]]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if f.name == "ids" else pa.int64()) for x, f in zip(parts, FIELDS, strict=True)], names=[f.name for f in FIELDS])

        for whole in batches:
            for part in slices(whole, "text"):
                out = []
                for key_, text_ in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = (tokens(text_) if text_ else b"") + end
                    for piece in packer.add((key_, len(ids) // 4), ids):
                        out.append(piece)
                        if len(out) >= PIECES:
                            yield rows(out)
                            out = []
                if out:
                    yield rows(out)
        if out := list(packer.close()):
            yield rows(out)

    return df.select(quoted(key).cast("long").alias("key"), quoted(text).alias("text")).mapInArrow(run, T.StructType(FIELDS))


def packed_documents(docs: DataFrame) -> DataFrame:
    """op7: all documents packed; crc32 of each piece's ids in place of them."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
