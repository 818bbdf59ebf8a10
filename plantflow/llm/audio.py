"""Audio columns: a lossless 8-bit sample store and features computed from what was read back.

A payload becomes unsigned 8-bit mono samples in a WAV container. Features come from the
samples of that container: polyphase resampling by 1/2, log-mel filterbanks over half
overlapped frames (the signal padded with silence to whole hops, so that each sample lies in a
frame), and segments of activity by energy with hysteresis. Log-mel frames are
cut into fixed-shape tensors of `FRAMES` x `MELS` (the last one padded with the floor
value), stored as an Arrow tensor column with the time span of each tensor.

For texts, the payload is the UTF-8 bytes padded with zero bytes to a positive multiple
of 64; null text counts as empty and gives 64 zero bytes. Each row is computed on its own
in blocks of fixed size, so equal texts have equal values wherever they stand, and a very
long text needs no more memory for its frames than a block. Repeated and null ids are
handled row by row; other columns are ignored.

At scale: one pass over the rows, nothing is shuffled or broadcast.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantflow.llm.text import runs

RATE = 8000
UNIT = 64
TAPS, DOWN = 16, 2
FRAME, HOP, MELS = 128, 64, 16
FRAMES = 32
BLOCK_FRAMES = 2048
ON_DB, OFF_DB, MIN_FRAMES = 3.0, -3.0, 3
FLOOR = -80.0


def _lowpass() -> np.ndarray:
    t = np.arange(TAPS) - (TAPS - 1) / 2
    taps = np.sinc(t / DOWN) * np.hamming(TAPS)
    return (taps / taps.sum()).astype(np.float32)


def _mel_bank() -> np.ndarray:
    rate = RATE / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(rate / 2), MELS + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(FRAME, 1 / rate)
    up = (freq[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_TAPS, _BANK, _WINDOW = _lowpass(), _mel_bank(), np.hanning(FRAME).astype(np.float32)


def store(payload: bytes) -> bytes:
    """A WAV file whose samples are the payload's bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def resample(samples: np.ndarray) -> np.ndarray:
    """Half the rate: each of the filter's two phases runs over its own half of the samples."""
    x = (samples.astype(np.float32) - 128.0) / 128.0
    x = np.concatenate([np.zeros(TAPS, np.float32), x, np.zeros(TAPS + len(x) % DOWN, np.float32)])
    n = (len(x) - TAPS) // DOWN
    out = np.zeros(n, np.float32)
    for phase in range(DOWN):
        branch = x[phase::DOWN]
        for k, tap in enumerate(_TAPS[phase::DOWN]):
            out += tap * branch[k : k + n]
    return out


def log_mel(signal: np.ndarray) -> np.ndarray:
    """(frames, MELS) in dB, block by block."""
    short = FRAME - len(signal) if len(signal) < FRAME else -(len(signal) - FRAME) % HOP
    signal = np.concatenate([signal, np.zeros(short, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    out = []
    for lo in range(0, len(frames), BLOCK_FRAMES):
        spectrum = np.fft.rfft(frames[lo : lo + BLOCK_FRAMES] * _WINDOW, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out.append(10 * np.log10(np.maximum(power @ _BANK, 1e-8)))
    return np.concatenate(out).astype(np.float32)


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges that start above the mean energy + ON_DB and last until it falls under mean + OFF_DB."""
    energy = mel.mean(axis=1)
    level = energy.mean()
    state = np.where(energy >= level + ON_DB, 1, np.where(energy < level + OFF_DB, -1, 0))
    marks = np.flatnonzero(state)
    if not len(marks):
        return []
    kind = state[marks]
    change = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    starts = marks[change][kind[change] == 1]
    stops = np.append(marks[change][kind[change] == -1], len(energy))
    ends = stops[np.searchsorted(stops, starts)]
    return [(int(a), int(b)) for a, b in zip(starts, ends) if b - a >= MIN_FRAMES]


def to_tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream with a fixed-shape tensor column and the time span of each tensor."""
    n = -(-len(mel) // FRAMES)
    padded = np.full((n * FRAMES, MELS), FLOOR, np.float32)
    padded[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
    storage = pa.FixedSizeListArray.from_arrays(pa.array(padded.ravel()), FRAMES * MELS)
    step = HOP * DOWN / RATE
    first = np.arange(n) * FRAMES
    batch = pa.record_batch(
        {
            "start_s": pa.array(first * step),
            "end_s": pa.array(np.minimum(first + FRAMES, len(mel)) * step),
            "log_mel": pa.ExtensionArray.from_storage(kind, storage),
        }
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_tensors(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def audio_features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (WAV), payload read back, tensors (Arrow stream) and spans of activity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        step = HOP * DOWN / RATE
        for batch in batches:
            idents, texts = batch.column("doc_id"), batch.column("text").cast(pa.large_binary())
            for lo, hi in runs(batch.column("text"), limit=4 << 20):
                sizes, medias, payloads, tensors, spans = [], [], [], [], []
                for raw in texts.slice(lo, hi - lo).to_pylist():
                    raw = raw or b""
                    media = store(raw + bytes(-len(raw) % UNIT if raw else UNIT))
                    payload = load(media)
                    mel = log_mel(resample(np.frombuffer(payload, np.uint8)))
                    sizes.append(len(raw))
                    medias.append(media)
                    payloads.append(payload)
                    tensors.append(to_tensors(mel))
                    spans.append([{"start_s": a * step, "end_s": b * step} for a, b in segments(mel)])
                yield pa.RecordBatch.from_arrays(
                    [
                        idents.slice(lo, hi - lo),
                        pa.array(sizes, pa.int64()),
                        pa.array(medias, pa.binary()),
                        pa.array(payloads, pa.binary()),
                        pa.array(tensors, pa.binary()),
                        pa.array(spans, kind),
                    ],
                    ["doc_id", "n_bytes", "media", "payload", "tensors", "spans"],
                )

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_bytes long, media binary, payload binary, tensors binary, spans array<struct<start_s double, end_s double>>"
    return rows.mapInArrow(run, schema)


def digests(featured: DataFrame) -> DataFrame:
    """The query's digest columns, by SQL functions over the operator's columns."""
    tail = F.crc32(F.expr(f"substring(payload, -{UNIT}, {UNIT})"))
    feature = F.concat_ws(
        ":",
        F.lit(f"logmel{FRAMES}x{MELS}"),
        F.size("spans").cast("string"),
        F.substring(F.sha2("tensors", 256), 1, 32),
        F.substring(F.sha2(F.to_json("spans"), 256), 1, 16),
    )
    return featured.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        tail.alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(audio_features(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE = None
