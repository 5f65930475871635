"""Text into parts for speech, and sample formats. The splitters look ahead and back, so they run in Arrow batches."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: Lengths of the first and the later parts, and the marks after which a part may end.
FIRST, LATER, LEAST, MARKS = 68, 160, 28, (". ", "? ", "! ", "\n", "; ", ", ")
FULL_STOPS, EARLIEST = (". ", "? ", "! "), 18


def split_speech(text: str | None) -> list[str]:
    """A short first part, so that speech can start early, then parts up to LATER characters; joined they are the text again."""
    rest, parts = (text or "").strip(), []
    while rest:
        opening = not parts
        blank = rest.find("\n\n")
        if opening and EARLIEST <= blank <= 120:
            parts.append(rest[:blank].strip())
            rest = rest[blank + 2 :].lstrip()
            continue
        most = FIRST if opening else LATER
        if len(rest) <= most:
            parts.append(rest)
            break
        ends = [at + len(m) for m in MARKS if (at := rest.rfind(m, 0, most + len(m))) >= 0]
        cut = max(ends, default=-1)
        stops = [at for m in FULL_STOPS if EARLIEST <= (at := rest.find(m)) < most] if opening else []
        if stops:
            cut = min(stops) + 2
        elif cut < LEAST:
            cut = rest.rfind(" ", 0, most + 1)
        cut = cut if cut >= 1 else most
        if part := rest[:cut].strip():
            parts.append(part)
        rest = rest[cut:].lstrip()
    return parts


def split_fixed(text: str | None, most: int = 280, least: int = 80) -> list[str]:
    """Parts of at most `most` characters that end at a mark, else at a space; white space is made single first."""
    rest, parts = re.sub(r"\s+", " ", text or "").strip(), []
    while len(rest) > most:
        at = max(rest.rfind(m, 0, most) for m in (". ", "? ", "! ", "; ", ", "))
        if at < least:
            at = rest.rfind(" ", 0, most)
        at = at if at >= 1 else most
        at += rest[at : at + 1] in tuple(".?!;,")
        parts.append(rest[:at].strip())
        rest = rest[at:].strip()
    return parts + [rest] if rest else parts


@F.pandas_udf(ArrayType(StringType()))
def speech_segments(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in text:
        yield series.map(split_speech)


@F.pandas_udf(ArrayType(StringType()))
def tts_chunks(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in text:
        yield series.map(split_fixed)


def decode_pcm(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i2").astype(np.float32) / 32768


def encode_pcm(x: np.ndarray) -> bytes:
    """Clipped to -1..1; negative samples scale to 32768, others to 32767."""
    x = np.clip(x, -1, 1)
    return np.where(x < 0, x * 32768, x * 32767).astype("<i2").tobytes()


def resample_linear(x: np.ndarray, source: int, target: int) -> np.ndarray:
    n = round(len(x) * target / source)
    return np.interp(np.arange(n) * source / target, np.arange(len(x)), x).astype(np.float32) if len(x) else x


def resample_box(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Each output sample is the mean of the input over its own interval."""
    total, n = np.concatenate([[0.0], np.cumsum(x, dtype=float)]), int(len(x) * target // source)
    edges = np.arange(n + 1) * source / target
    whole = np.minimum(edges.astype(int), len(x))
    padded = np.append(x, 0.0)
    upto = total[whole] + (edges - whole) * padded[np.minimum(whole, len(x))]
    return (np.diff(upto) / (source / target)).astype(np.float32)


def nearest_frames(x: np.ndarray, source: int = 24_000, target: int = 16_000, frame: int = 1600) -> np.ndarray:
    """Rows of `frame` samples at the target rate, each the input sample at or before its time; the last row is filled up with zeros."""
    n = -(-len(x) * target // (source * frame)) * frame
    at = np.arange(n) * source // target
    padded = np.append(x, np.zeros(1, x.dtype))
    return padded[np.minimum(at, len(x))].reshape(-1, frame)


def wav_bytes(pcm: bytes, rate: int) -> bytes:
    """Mono 16-bit samples with the 44-byte header."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(pcm)) + pcm


@F.pandas_udf(BinaryType())
def wav_samples(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sample bytes of a WAV file: its data chunk, found by walking the chunks, which are padded to even lengths."""

    def one(b: bytes | None) -> bytes | None:
        if b is None or b[:4] != b"RIFF" or b[8:12] != b"WAVE":
            return None
        at = 12
        while at + 8 <= len(b):
            name, size = struct.unpack_from("<4sI", b, at)
            if name == b"data":
                return b[at + 8 : at + 8 + size]
            at += 8 + size + size % 2
        return None

    for series in content:
        yield series.map(one)


def frame_header(frame) -> tuple:
    """Sequence number and rate from the first eight bytes of a frame, little-endian."""

    def number(start: int):
        digits = F.concat(*[F.hex(F.substring(frame, start + i, 1)) for i in (3, 2, 1, 0)])
        return F.conv(digits, 16, 10).cast("long")

    return number(1), number(5)
