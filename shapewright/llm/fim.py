"""Fill-in-the-middle by a parallel automaton scan.

A deterministic automaton reads the UTF-8 bytes of a text and counts code points and markers. Bytes are cut into chunks wherever they
fall, also inside a code point or a marker: each chunk is scanned from every state at once and gives its transition function (where
it ends, for each state it may begin in) and the counts for each of these. Functions compose associatively, so a prefix scan by
doubling over a text's chunks resolves each chunk's entry state and what was counted before it. The chunk in which a cut lies is then
selected by these counts, and only that chunk is read again, from its known entry state, for the byte at which the cut falls.

Texts up to GIANT bytes are scanned where they lie, all chunks of a slice of rows in step. The pieces of a longer one are dealt out
over the cluster: workers give one function for each piece, the functions of a text, 2 GB / PIECE at most, are composed, the two
pieces that hold the cuts are selected and searched by their own workers, and only the cuts meet the text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import place_of, slices

CHUNK = 2048
"""Bytes that are scanned in step with other chunks."""
PIECE = 32 * CHUNK
"""Bytes of a giant document's part that one worker scans."""
GIANT = PIECE
"""Bytes beyond which a document's pieces are dealt out."""
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
"""Of h3 % 100, from where on a document stays plain, and of h4 % 100, below which its suffix comes first."""

READY, OPEN, NAMED, DUE = 0, 1, 2, 2
"""States: nothing pending, after `<`, after `<` and a letter of a marker; DUE + k: k more bytes of a code point are due."""
STATES = 6
OTHER, LESS, LETTER, MORE, TAIL, LEAD, PAD = 0, 1, 2, 3, 4, 4, 8
"""Kinds of bytes; LEAD + k: the first byte of a code point with k more, k from 1 to 3. PAD fills up chunks and changes nothing."""
MARK = 1 << 32
"""Counts hold code points and, in multiples of this, markers."""


def kinds() -> np.ndarray:
    """The kind of each byte; bytes that occur in no UTF-8 text count as code points of their own."""
    out = np.full(256, OTHER, np.uint8)
    out[0x80:0xC0], out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:0xF8] = TAIL, LEAD + 1, LEAD + 2, LEAD + 3
    out[ord("<")], out[ord(">")] = LESS, MORE
    out[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = LETTER
    return out


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next states and counts by kind of byte and state. A code point is counted at its last byte."""
    step, count = np.zeros((PAD + 1, STATES), np.uint8), np.ones((PAD + 1, STATES), np.int64)
    step[LESS], step[LETTER, OPEN] = OPEN, NAMED
    count[MORE, NAMED] += MARK
    for k in (1, 2, 3):
        step[LEAD + k], count[LEAD + k] = DUE + k, 0
    for k in (2, 3):  # an early tail leaves one byte fewer due
        step[TAIL, DUE + k], count[TAIL, DUE + k] = DUE + k - 1, 0
    step[PAD], count[PAD] = np.arange(STATES), 0
    return step, count


KINDS = kinds()
STEP, COUNT = automaton()


def chunked(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds of bytes [width, chunks] of all texts' chunks, the text of each chunk and its place in it; an empty text has one chunk."""
    n = np.maximum(1, -(-sizes // width))
    owner = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    within = place * width + np.arange(width)[:, None]
    there = within < sizes[owner]
    out = np.full(within.shape, PAD, np.uint8)
    out[there] = KINDS[data[(begin[owner] + within)[there]]]
    return out, owner, place


def functions(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition functions and counts [chunks, states] of chunks that are scanned in step, from every state."""
    state = np.broadcast_to(np.arange(STATES), (kinds.shape[1], STATES))
    count = np.zeros(state.shape, np.int64)
    step, add = STEP.ravel(), COUNT.ravel()
    for row in kinds.astype(np.intp) * STATES:
        at = row[:, None] + state
        state = step.take(at)
        count += add.take(at)
    return state.astype(np.uint8), count


def composed(end: np.ndarray, count: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Functions from a text's first chunk through each of its chunks: an associative scan by doubling."""
    end, count, reach = end.copy(), count.copy(), 1
    while (at := np.flatnonzero(place >= reach)).size:
        before, counted = end[at - reach], count[at - reach]
        end[at], count[at] = np.take_along_axis(end[at], before, 1), counted + np.take_along_axis(count[at], before, 1)
        reach *= 2
    return end, count


def found(kinds: np.ndarray, entry: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Bytes of each chunk up to its wanted-th code point, from its entry state; kinds [width, chunks], wanted from 1."""
    state, counts = entry.astype(np.intp), np.empty(kinds.shape, np.int64)
    for i, row in enumerate(kinds.astype(np.intp)):
        counts[i] = COUNT[row, state]
        state = STEP[row, state]
    return (np.cumsum(counts % MARK, axis=0) >= wanted).argmax(axis=0) + 1


class Scan:
    """The chunks of texts, their composed functions, and cuts by code points; entry: the state each text begins in."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, width: int = CHUNK):
        self.width = width
        self.kinds, owner, self.place = chunked(data, begin, sizes, width)
        self.end, self.count = composed(*functions(self.kinds), self.place)
        self.last = np.searchsorted(owner, np.arange(len(sizes)), "right") - 1
        self.first = np.searchsorted(owner, np.arange(len(sizes)))

    def totals(self, entry: int = READY) -> tuple[np.ndarray, np.ndarray]:
        """Code points and markers of each text."""
        return self.count[self.last, entry] % MARK, self.count[self.last, entry] // MARK

    def cut(self, units: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Bytes of each text up to its units-th code point (0: none), when it is entered in a state."""
        out = np.zeros(len(units), np.int64)
        some = np.flatnonzero(units > 0)
        low, high = self.first[some].copy(), self.last[some].copy()
        while (open_ := low < high).any():  # the first chunk through which enough are counted
            middle = (low + high) // 2
            enough = self.count[middle, entry[some]] % MARK >= units[some]
            high, low = np.where(open_ & enough, middle, high), np.where(open_ & ~enough, middle + 1, low)
        inner = self.place[low] > 0
        state = np.where(inner, self.end[low - 1, entry[some]], entry[some])
        before = np.where(inner, self.count[low - 1, entry[some]] % MARK, 0)
        out[some] = self.place[low] * self.width + found(self.kinds[:, low], state, units[some] - before)
        return out


def planned(n: np.ndarray, marks: np.ndarray, h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Form, and the code points before the first and the second cut."""
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    form = np.where((n == 0) | (marks > 0) | (h[2] % 100 >= PLAIN_FROM), "plain", np.where(h[3] % 100 < SPM_BELOW, "spm", "psm"))
    return form, np.minimum(one, two), np.maximum(one, two)


def draws(key: Column) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of `1:` and the key as text, as unsigned integers; a null key counts as no text."""
    digits = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


DRAWS = [f"h{i}" for i in range(1, 5)]
CUTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("prefix_chars", "middle_chars", "b1", "b2")]])
"""Code points, form, code points of prefix and middle (null if plain), and the bytes before each cut."""


def cut_arrays(n: np.ndarray, form: np.ndarray, low: np.ndarray, high: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> list[pa.Array]:
    plain = form == "plain"
    return [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *[pa.array(x, pa.int64(), mask=plain) for x in (low, high - low)], *[pa.array(x, pa.int64()) for x in (b1, b2)]]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a column of strings or binaries, where each value begins, and its size; null as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends[:-1], np.diff(ends)


def with_cuts(df: DataFrame, text: str, width: int) -> DataFrame:
    """df, which has the columns h1 to h4, with CUTS in their place; no row is moved."""
    names = [c for c in df.columns if c not in DRAWS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text):
                scan = Scan(*bytes_of(part.column(text)), width)
                n, marks = scan.totals()
                form, low, high = planned(n, marks, [part.column(c).to_numpy() for c in DRAWS])
                entry = np.full(len(n), READY)
                new = cut_arrays(n, form, low, high, scan.cut(low, entry), scan.cut(high, entry))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *new], names=[*names, *CUTS.names])

    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in names], *CUTS.fields]))


PIECES = "who string, h1 long, h2 long, h3 long, h4 long, piece int, part binary"
FUNCTION = "who string, h1 long, h2 long, h3 long, h4 long, piece int, ends array<int>, counts array<long>"
WANTED = "who string, n long, form string, prefix_chars long, middle_chars long, cut int, piece int, state int, units long"


def distributed_cuts(giants: DataFrame, width: int, piece: int) -> DataFrame:
    """who and CUTS of documents (who, text, h1 to h4) whose pieces are dealt out; who is one row's."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                data, begin, size = bytes_of(row.column("text"))
                same = [row.column(c) for c in ("who", *DRAWS)]
                for k in range(max(1, -(-int(size[0]) // piece))):
                    at = int(begin[0]) + k * piece
                    own = data[at : min(at + piece, int(begin[0] + size[0]))].tobytes()
                    yield pa.RecordBatch.from_arrays([*same, pa.array([k], pa.int32()), pa.array([own], pa.binary())], names=["who", *DRAWS, "piece", "part"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "part"):
                scan = Scan(*bytes_of(b.column("part")), width)
                new = [pa.array(scan.end[scan.last].tolist(), pa.list_(pa.int32())), pa.array(scan.count[scan.last].tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("who", *DRAWS, "piece")] + new, names=["who", *DRAWS, "piece", "ends", "counts"])

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                parts = sorted(row["parts"], key=lambda x: x["piece"])
                end, count = composed(np.array([x["ends"] for x in parts]), np.array([x["counts"] for x in parts]), np.arange(len(parts)))
                n, marks = count[-1:, READY] % MARK, count[-1:, READY] // MARK
                form, low, high = planned(n, marks, [np.array([row[c]]) for c in DRAWS])
                same = dict(zip(CUTS.names, [x[0].as_py() for x in cut_arrays(n, form, low, high, low, high)], strict=True))
                out = []
                for k, units in enumerate((int(low[0]), int(high[0]))):
                    at = int(np.searchsorted(count[:, READY] % MARK, units)) if units else 0
                    before, state = (int(count[at - 1, READY] % MARK), int(end[at - 1, READY])) if at else (0, READY)
                    out.append({"who": row["who"], "cut": k, "piece": at, "state": state, "units": units - before} | {c: same[c] for c in CUTS.names[:4]})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("who", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("cut", pa.int32()), ("piece", pa.int32()), ("state", pa.int32()), ("units", pa.int64())]))

    same = ["who", *CUTS.names[:4], "cut"]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "part"):
                inside = Scan(*bytes_of(b.column("part")), width).cut(b.column("units").to_numpy(), b.column("state").to_numpy())
                at = inside + b.column("piece").to_numpy().astype(np.int64) * piece
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in same], pa.array(at, pa.int64())], names=[*same, "at"])

    pieces = giants.mapInArrow(split, PIECES).repartition("who", "piece")
    function = pieces.mapInArrow(summed, FUNCTION)
    # a document's functions, of 100 bytes, are as many as its pieces: 2 GB / piece at most
    wanted = function.groupBy("who", *DRAWS).agg(F.collect_list(F.struct("piece", "ends", "counts")).alias("parts")).mapInArrow(selected, WANTED)
    at = pieces.select("who", "piece", "part").join(wanted, ["who", "piece"]).mapInArrow(searched, T.StructType([*[T.StructType.fromDDL(WANTED)[c] for c in same], T.StructField("at", T.LongType())]))
    return at.groupBy("who", *CUTS.names[:4]).agg(F.max(F.when(F.col("cut") == 0, F.col("at"))).alias("b1"), F.max(F.when(F.col("cut") == 1, F.col("at"))).alias("b2"))


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = CHUNK, piece: int = PIECE, giant: int = GIANT) -> DataFrame:
    """df with n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and fim, the text in that form.

    psm: `<P>` prefix `<S>` suffix `<M>` middle; spm: `<S>` suffix `<P>` prefix `<M>` middle. Cuts and form are drawn from the key, so
    rows with equal keys draw alike; a null key draws as an empty one. A text that holds a marker stays plain, as does an empty one; a
    null text counts as empty. Rows stay as they are, repeats included; other columns may have any name and pass through, and those
    named like the new ones are replaced. An empty table gives an empty one. No row moves but texts of over giant bytes. In strings that
    are no UTF-8 a stray tail byte counts as a code point and a broken code point ends with the next one; texts are rebuilt all the same.
    """
    new = ("n", "form", "prefix_chars", "middle_chars", "fim")
    own, keyed = place_of(df, text), F.col(f"c{place_of(df, key)}")
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in new or i == own]
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    rows = inner.select(*[f"c{i}" for i in kept], F.coalesce(F.col(f"c{own}"), F.lit("")).alias("whole"), *draws(keyed))
    long = F.octet_length("whole") > giant
    near = with_cuts(rows.where(~long), "whole", width)
    far = rows.where(long).withColumn("who", F.sha2(F.concat(F.concat_ws(":", *DRAWS), F.lit(":"), "whole"), 256))
    once = far.select("who", F.col("whole").alias("text"), *DRAWS).dropDuplicates(["who"])
    far = far.drop(*DRAWS).join(distributed_cuts(once, width, piece), "who").select(near.columns)
    out = near.unionAll(far)
    parts = F.col("whole").cast("binary")
    cut = lambda begin, end=None: F.substring(parts, begin + 1, F.octet_length(parts) if end is None else end - begin).cast("string")
    prefix, middle, suffix = cut(F.lit(0), F.col("b1")), cut(F.col("b1"), F.col("b2")), cut(F.col("b2"))
    fim = F.when(F.col("form") == "plain", F.col("whole")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    left = [i for i in kept if df.columns[i].lower() not in new]
    return out.select(*[f"c{i}" for i in left], "n", "form", "prefix_chars", "middle_chars", fim.alias("fim")).toDF(*[df.columns[i] for i in left], *new)


def restored(fim: Column, form: Column) -> Column:
    """The text from its form alone: what stands between the markers, put in order."""
    rest = F.substring(fim, F.lit(len(PREFIX) + 1), F.length(fim))
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    after = lambda whole, mark: F.substring(whole, F.instr(whole, mark) + F.length(mark), F.length(whole))
    first = F.substring(rest, F.lit(1), F.instr(rest, second) - 1)
    tail = after(rest, second)
    last = F.substring(tail, F.lit(1), F.instr(tail, F.lit(MIDDLE)) - 1)
    middle = after(tail, F.lit(MIDDLE))
    return F.when(form == "plain", fim).when(form == "psm", F.concat(first, middle, last)).otherwise(F.concat(last, middle, first))


def filled_documents(docs: DataFrame) -> DataFrame:
    """op13: every document's cuts, with digests of its output and of the text rebuilt from it."""
    out = fill_in_middle(docs.select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("fim")).alias("output_sha256"), digest(restored(F.col("fim"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), units AS (
  SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
         CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= {PLAIN_FROM} THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, substr(text, 1, least(a, b)) AS p, substr(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substr(text, greatest(a, b) + 1) AS s FROM units
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""
