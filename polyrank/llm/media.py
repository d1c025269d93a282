"""Media columns: bytes stored as 8-bit WAV, read back, and fingerprinted by pairs of spectral peaks."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import byte_chunks, documents, texts_as_bytes

HOP, FRAME, BLOCK, FAN, RATE = 64, 128, 16, 3, 8000
_HANN = np.hanning(FRAME)

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, codes array<int>"


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return w.readframes(w.getnframes())


def pad(raw: bytes, unit: int = HOP) -> bytes:
    """raw and zero bytes up to a positive multiple of unit."""
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


def peaks(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each payload, the strongest point (frame, bin) of the spectrogram in each block of BLOCK frames.

    Returns the payload's number, frame and bin of every peak. Frames of all payloads are transformed together;
    silence of a hop follows each payload, so that no frame has samples of two.
    """
    joined = np.frombuffer(b"".join(p + b"\x80" * HOP for p in payloads), np.uint8)
    frames = np.lib.stride_tricks.sliding_window_view(joined, FRAME)[::HOP]
    strongest, at = np.empty(len(frames), np.int64), np.empty(len(frames), np.int64)
    for i in range(0, len(frames), 8192):
        spectrum = np.fft.rfft((frames[i : i + 8192].astype(np.float64) - 128) * _HANN, axis=1)[:, 1:]
        power = np.rint(spectrum.real**2 + spectrum.imag**2).astype(np.int64)  # whole numbers: equal sound, equal peaks
        at[i : i + 8192] = power.argmax(1)
        strongest[i : i + 8192] = power[np.arange(len(power)), at[i : i + 8192]]
    n = np.array([len(p) // HOP for p in payloads])  # frames of each
    first = np.concatenate(([0], np.cumsum(n + 1)[:-1]))
    blocks = -(-n // BLOCK)
    owner = np.repeat(np.arange(len(n)), blocks)
    in_doc = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = first[owner] + in_doc * BLOCK
    size = np.minimum(BLOCK, n[owner] - in_doc * BLOCK)
    grid = start[:, None] + np.minimum(np.arange(BLOCK), size[:, None] - 1)
    best = grid[np.arange(len(grid)), strongest[grid].argmax(1)]
    return owner, best - first[owner], at[best]


def landmarks(owner: np.ndarray, time: np.ndarray, bin_: np.ndarray, n: int) -> list[tuple[list[int], list[int]]]:
    """For each payload, times and codes (bin, bin, distance) of pairs of a peak with the next FAN peaks; a lone peak is paired with itself."""
    t, c, o = [], [], []
    for k in range(1, FAN + 1):
        same = owner[k:] == owner[:-k]
        t.append(time[:-k][same])
        o.append(owner[:-k][same])
        c.append((bin_[:-k][same] << 14) | (bin_[k:][same] << 8) | np.minimum(255, time[k:][same] - time[:-k][same]))
    lone = np.flatnonzero(np.bincount(owner, minlength=n)[owner] == 1)
    t.append(time[lone])
    o.append(owner[lone])
    c.append((bin_[lone] << 14) | (bin_[lone] << 8))
    t, c, o = map(np.concatenate, (t, c, o))
    order = np.lexsort((c, t, o))
    t, c, o = t[order], c[order], o[order]
    cut = np.searchsorted(o, np.arange(n + 1))
    return [(t[a:b].tolist(), c[a:b].tolist()) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def media_rows(ids: list, raws: list[bytes]) -> dict[str, list]:
    media = [to_wav(pad(r)) for r in raws]
    back = [from_wav(m) for m in media]
    marks = landmarks(*peaks(back), len(back))
    return {
        "doc_id": ids,
        "n_bytes": [len(r) for r in raws],
        "payload_bytes": [len(p) for p in back],
        "payload_sha256": [hashlib.sha256(p).hexdigest() for p in back],
        "tail_crc32": [zlib.crc32(p[-HOP:]) for p in back],
        "media_bytes": [len(m) for m in media],
        "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
        "feature": [" ".join(f"{a}:{b:x}" for a, b in zip(t, c, strict=True)) for t, c in marks],
        "times": [t for t, _ in marks],
        "codes": [c for _, c in marks],
    }


def media_columns(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as WAV and its fingerprint: one row per row of docs; a null text counts as empty (64 zero bytes are stored).

    feature lists the landmarks as time:code (hex); times and codes are the same as arrays. Other columns of docs are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_chunks(batches, 1, limit=2 << 20):
            yield pa.RecordBatch.from_pydict(media_rows(b.column(0).to_pylist(), texts_as_bytes(b.column(1))), schema=schema)

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text}` as text").mapInArrow(run, SCHEMA)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir, "doc_id", "text")).drop("times", "codes")
