"""Media columns: telephony audio.

A payload of bytes is stored as a RIFF/WAVE file in one of three telephony codecs: mu-law and A-law, whose unit is an 8-bit sample,
and IMA ADPCM, whose unit is a block of 36 bytes. Files are read back by their chunks. mu-law and A-law samples are expanded by
256-entry tables; ADPCM blocks are decoded by numpy across all blocks of a slice, so the only loop is over the 64 steps inside
a block. The decoded sound is resampled by a polyphase filter and stored as 16-bit PCM.

All arithmetic on samples is elementwise or on integers, so equal payloads give equal files and features wherever they lie.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import append_columns

UNIT = 576
BLOCK = 36
"""Bytes of an ADPCM block: 4 of header, then 64 nibbles."""
SAMPLES = 2 * (BLOCK - 4) + 1
CODECS = ("mulaw", "alaw", "ima")
RATE = 8000
TARGET_RATE = 16000
TAPS = 16
PART = 1024 * 576
"""Bytes of a file that are decoded at once, and the least samples that are resampled at once where there are more."""

# Fixed values of the WAVE format: format tags.
TAGS = {"pcm": 0x0001, "alaw": 0x0006, "mulaw": 0x0007, "ima": 0x0011}
# Fixed values of the IMA ADPCM format.
INDEX_STEPS = [-1, -1, -1, -1, 2, 4, 6, 8]
STEP_SIZES = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]


def mulaw_table() -> np.ndarray:
    """ITU-T G.711 mu-law: 256 codes to 16-bit samples."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0xF) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """ITU-T G.711 A-law: 256 codes to 16-bit samples."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment = (code >> 4) & 7
    size = ((code & 0xF) << 4) + 8 + np.where(segment > 0, 0x100, 0)
    size = size << np.maximum(segment - 1, 0)
    return np.where(code & 0x80, size, -size).astype(np.int16)


def ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """For 16 * step index + nibble: what is added to the prediction, and 16 * the next step index."""
    step, nibble = np.array(STEP_SIZES)[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    following = np.clip(np.arange(len(STEP_SIZES))[:, None] + np.array(INDEX_STEPS)[nibble & 7], 0, len(STEP_SIZES) - 1)
    return np.where(nibble & 8, -size, size).astype(np.int32).ravel(), (16 * following).astype(np.int32).ravel()


EXPAND = {"mulaw": mulaw_table(), "alaw": alaw_table()}
DELTA, FOLLOWING = ima_tables()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """[n, BLOCK] bytes to [n, SAMPLES] samples. A step index beyond the table, which a file may hold, counts as the last."""
    out = np.empty((SAMPLES, len(blocks)), np.int16)
    predicted = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    state = np.minimum(blocks[:, 2], len(STEP_SIZES) - 1).astype(np.int32) * 16
    out[0] = predicted
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(1, SAMPLES):
        pair = data[(k - 1) // 2]
        at = state + ((pair >> 4) if k % 2 == 0 else (pair & 0xF))
        predicted += DELTA[at]
        np.clip(predicted, -32768, 32767, out=predicted)
        state = FOLLOWING[at]
        out[k] = predicted
    return np.ascontiguousarray(out.T)


def wave_header(codec: str, rate: int, n_samples: int, n_bytes: int) -> bytes:
    """All of a RIFF/WAVE file of one channel before its n_bytes of data, an even number: the chunks fmt and fact, and the head of data."""
    unit, bits = {"pcm": (2, 16), "ima": (BLOCK, 4)}.get(codec, (1, 8))
    speed = rate * BLOCK // SAMPLES if codec == "ima" else rate * unit
    extra = struct.pack("<HH", 2, SAMPLES) if codec == "ima" else struct.pack("<H", 0)
    layout = struct.pack("<HHIIHH", TAGS[codec], 1, rate, speed, unit, bits) + extra
    chunks = b"".join(name + struct.pack("<I", len(x)) + x for name, x in ((b"fmt ", layout), (b"fact", struct.pack("<I", n_samples)))) + b"data" + struct.pack("<I", n_bytes)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks) + n_bytes) + b"WAVE" + chunks


def read_wave(media: bytes | memoryview) -> tuple[str, int, memoryview]:
    """Codec, rate and the bytes of the data chunk."""
    view, at, found = memoryview(media), 12, {}
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    while at + 8 <= len(media):
        (n,) = struct.unpack_from("<I", media, at + 4)
        found[bytes(view[at : at + 4])] = view[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    tag, _, rate = struct.unpack_from("<HHI", found[b"fmt "])
    return {v: k for k, v in TAGS.items()}[tag], rate, found[b"data"]


def filters(up: int, down: int) -> np.ndarray:
    """[up, TAPS] Hann-windowed sinc filters, one for each phase; each sums to 1."""
    cut = min(1.0, up / down)
    t = np.arange(TAPS)[None, :] - (TAPS // 2 - 1) - (np.arange(up) / up)[:, None]
    h = np.sinc(t * cut) * np.cos(np.pi * t / (TAPS + 2)) ** 2
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


def span(x: np.ndarray, n_in: int, up: int, down: int) -> np.ndarray:
    """The samples that stand for n_in ones of x, which has TAPS + down more before and after. Sums are taken tap by tap, in one order everywhere."""
    reach, n = TAPS + down, -(-n_in * up // down)
    x = x.astype(np.float32)
    out, h = np.empty(n, np.float32), filters(up, down)
    for r in range(min(up, n)):
        count = -(-(n - r) // up)
        phase, begin = r * down % up, r * down // up + reach - (TAPS // 2 - 1)
        if phase == 0 and up >= down:
            out[r::up] = x[r * down // up + reach :: down][:count]
            continue
        total = np.zeros(count, np.float32)
        for t in range(TAPS):
            total += x[begin + t : begin + t + down * (count - 1) + 1 : down] * h[phase, t]
        out[r::up] = total
    return np.clip(np.rint(out), -32768, 32767).astype("<i2")


def resampled(parts: Iterable[np.ndarray], rate: int, target: int) -> Iterator[np.ndarray]:
    """16-bit samples at another rate, of sound that comes in parts; silence is assumed on both sides. The parts play no part in the result."""
    g = np.gcd(rate, target)
    up, down = int(target // g), int(rate // g)
    if up == down:
        yield from parts
        return
    reach = TAPS + down
    held = np.zeros(reach, np.int16)
    for part in parts:
        held = np.concatenate((held, part))
        ready = (len(held) - 2 * reach) // down * down
        if ready >= PART:
            yield span(held[: ready + 2 * reach], ready, up, down)
            held = held[ready:]
    if len(held) > reach:
        yield span(np.concatenate((held, np.zeros(reach, np.int16))), len(held) - reach, up, down)


def resample(sound: np.ndarray, rate: int, target: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, "<i2"), *resampled([sound], rate, target)])


def pick_codec(checksum: int) -> str:
    """A codec fixed by the payload's crc32 alone, so that a corpus exercises all three and equal payloads get equal files."""
    return CODECS[checksum % len(CODECS)]


def decode(codec: str, data: np.ndarray) -> np.ndarray:
    """Samples of the bytes of one codec, all blocks together."""
    return decode_ima(data.reshape(-1, BLOCK)).ravel() if codec == "ima" else EXPAND[codec][data]


def n_samples(codec: str, n_bytes: int) -> int:
    return n_bytes // BLOCK * SAMPLES if codec == "ima" else n_bytes


class Tally:
    """Peak, mean square, sign changes and full-scale samples of sound that comes in parts."""

    def __init__(self):
        self.n = self.peak = self.squares = self.changes = self.full = 0
        self.last: np.ndarray | None = None

    def add(self, sound: np.ndarray) -> None:
        wide = sound.astype(np.int64)
        size = np.abs(wide)
        negative = sound < 0
        self.changes += int(np.count_nonzero(negative[1:] != negative[:-1])) + (self.last is not None and bool(self.last != negative[0]))
        self.n, self.peak, self.last = self.n + len(sound), max(self.peak, int(size.max())), negative[-1]
        self.squares += int((wide * wide).sum())
        self.full += int(np.count_nonzero(size >= 32124))

    def __str__(self) -> str:
        return f"n={self.n};peak={self.peak};ms={self.squares // self.n};zc={self.changes};full={self.full}"


FIELDS = [
    T.StructField("media", T.BinaryType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("pcm", T.BinaryType()),
    T.StructField("codec", T.StringType()),
    T.StructField("feature", T.StringType()),
]


def column(values: np.ndarray, ends: list[int]) -> pa.Array:
    """A binary column of stretches of bytes, which are not copied."""
    if ends and ends[-1] >= 1 << 31:
        raise ValueError("the texts of a slice give 2 GB of media or more; a column of Arrow cannot hold that")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.array([0, *ends], np.int32)), pa.py_buffer(values)])


def transcode(texts: list[str | None], codec: str | None = None, target: int = TARGET_RATE) -> list[pa.Array]:
    """Columns media, payload (as read back from media), pcm, codec and feature.

    Each column's bytes are written once, to where they stay. Short files of a codec are decoded together, a long one in parts.
    """
    raws = [(t or "").encode() for t in texts]
    fills = [(-len(r)) % UNIT if r else UNIT for r in raws]
    kinds = [codec or pick_codec(zlib.crc32(b"\xff" * f, zlib.crc32(r))) for r, f in zip(raws, fills, strict=True)]
    heads = [wave_header(k, RATE, n_samples(k, len(r) + f), len(r) + f) for k, r, f in zip(kinds, raws, fills, strict=True)]
    ends = list(accumulate(len(h) + len(r) + f for h, r, f in zip(heads, raws, fills, strict=True)))
    media = np.full(ends[-1] if ends else 0, 0xFF, np.uint8)
    for end, h, r, f in zip(ends, heads, raws, fills, strict=True):
        begin = end - f - len(r)
        media[begin - len(h) : begin] = np.frombuffer(h, np.uint8)
        media[begin : begin + len(r)] = np.frombuffer(r, np.uint8)
    del raws
    stored = memoryview(media)
    read = [read_wave(stored[b:e]) for b, e in zip([0, *ends], ends, strict=False)]
    payload_ends = list(accumulate(len(data) for *_, data in read))
    payload = np.empty(payload_ends[-1] if read else 0, np.uint8)
    for end, (*_, data) in zip(payload_ends, read, strict=True):
        payload[end - len(data) : end] = np.frombuffer(data, np.uint8)
    sizes = [-(-n_samples(kind, len(data)) * target // rate) for kind, rate, data in read]
    heads = [wave_header("pcm", target, n, 2 * n) for n in sizes]
    pcm_ends = list(accumulate(len(h) + 2 * n for h, n in zip(heads, sizes, strict=True)))
    pcm = np.empty(pcm_ends[-1] if read else 0, np.uint8)
    feature = [""] * len(read)

    def store(i: int, sound: Iterable[np.ndarray]) -> None:
        tally = Tally()

        def seen() -> Iterator[np.ndarray]:
            for part in sound:
                tally.add(part)
                yield part

        at = pcm_ends[i] - 2 * sizes[i]
        pcm[at - len(heads[i]) : at] = np.frombuffer(heads[i], np.uint8)
        for part in resampled(seen(), read[i][1], target):
            pcm[at : at + 2 * len(part)] = np.ascontiguousarray(part, "<i2").view(np.uint8)
            at += 2 * len(part)
        feature[i] = f"{read[i][0]};{tally}"

    for kind in CODECS:
        own = [i for i, x in enumerate(read) if x[0] == kind]
        short = [i for i in own if len(read[i][2]) <= PART]
        if short:
            sound = decode(kind, np.concatenate([np.frombuffer(read[i][2], np.uint8) for i in short]))
            for i, part in zip(short, np.split(sound, np.cumsum([n_samples(kind, len(read[i][2])) for i in short])[:-1]), strict=True):
                store(i, [part])
        for i in own:
            data = np.frombuffer(read[i][2], np.uint8)
            if len(data) > PART:
                store(i, (decode(kind, data[b : b + PART]) for b in range(0, len(data), PART)))
    del read
    return [column(media, ends), column(payload, payload_ends), column(pcm, pcm_ends), pa.array(kinds, pa.string()), pa.array(feature, pa.string())]


def telephony(df: DataFrame, text: str = "text", codec: str | None = None, target: int = TARGET_RATE) -> DataFrame:
    """df with the columns media, payload, pcm, codec and feature made from its text.

    The payload is the text's UTF-8 bytes with bytes 255 up to a positive multiple of 576. codec: one of CODECS for all rows; by
    default the payload's own checksum picks it. Nulls and empty texts give the payload of 576 bytes 255. Rows stay as they are,
    repeats included; other columns pass through, except that columns named like the new ones are replaced. No row is moved.
    Other columns may have any name. Of 2 MB of texts, or the longest text, at a time a worker holds the columns once and PART bytes'
    worth of sound; a slice that gives 2 GB of media, some 290 MB of one text, is an error, as Arrow's columns end there.
    """
    return append_columns(df, text, lambda: lambda texts: transcode(texts, codec, target), FIELDS)


def media_digests(docs: DataFrame) -> DataFrame:
    """op1: digests of what telephony() stores for every document."""
    out = telephony(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "codec",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )
