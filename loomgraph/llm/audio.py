"""Media columns: 8-bit audio, log-mel tensors and energy segments with time spans."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from .common import Work

#: Stored rate, and the ratio UP / DOWN to the rate of the features.
RATE, UP, DOWN, TAPS = 16_000, 5, 8, 16
#: Samples of a frame and between frames, at the features' rate.
FRAME, HOP, MELS = 256, 128, 24
#: Frames of one tensor; the last one is padded with silence.
WINDOW = 64
#: Decibels above a recording's median energy that open and hold a segment.
OPEN_DB, HOLD_DB = 0.5, 0.2
BLOCK = 64
#: Frames computed at once; a multiple of UP keeps pieces aligned with whole input samples.
PIECE = 8000
FEATURE_RATE = RATE * UP // DOWN
FLOOR = 1e-10


def _resampler() -> np.ndarray:
    """Polyphase bank as one matrix: TAPS + DOWN inputs to UP outputs.

    Column p holds the taps of phase p of a Hann-windowed sinc that cuts at the
    lower of the two Nyquist rates, placed where output p of a block reads.
    """
    bank = np.zeros((TAPS + DOWN, UP))
    cut = min(1.0, UP / DOWN)
    for p in range(UP):
        where = p * DOWN / UP
        first = int(np.floor(where)) + 1
        t = np.arange(first, first + TAPS) - TAPS / 2 - where
        taps = cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(2 * t / TAPS, -1, 1)))
        bank[first : first + TAPS, p] = taps / taps.sum()
    return bank


def _mel_bank() -> np.ndarray:
    """Triangles evenly spaced in mel over the power spectrum: (FRAME/2 + 1) x MELS."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40.0), mel(FEATURE_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1)[:, None] * FEATURE_RATE / FRAME
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


RESAMPLER, MEL_BANK = _resampler(), _mel_bank()
TAPER = np.hanning(FRAME + 1)[:-1]


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes with zero bytes up to a positive multiple of BLOCK."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def store(payload: bytes) -> bytes:
    """A mono WAV file whose unsigned 8-bit samples are the payload."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def resample(x: np.ndarray, blocks: int) -> np.ndarray:
    """UP outputs for each of ``blocks`` steps of DOWN inputs; x carries TAPS inputs of context in all."""
    rows = np.lib.stride_tricks.sliding_window_view(x, TAPS + DOWN)[::DOWN][:blocks]
    return (np.ascontiguousarray(rows) @ RESAMPLER).ravel()


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Natural log of mel energies (frames x MELS) and frame energies in dB.

    Frames overlap by half.  There is at least one frame, and the last may read
    silence beyond the end.  Long recordings are computed in pieces of PIECE
    frames, so memory doesn't grow with them.
    """
    raw = np.frombuffer(samples, dtype=np.uint8)
    n_out = -(-len(raw) * UP // DOWN)
    frames = max(1, -(-(n_out - FRAME + HOP) // HOP))
    mels, energy = [], []
    for at in range(0, frames, PIECE):
        n = min(PIECE, frames - at)
        first = at * HOP * DOWN // UP
        blocks = -(-((n - 1) * HOP + FRAME) // UP)
        lo, hi = first - TAPS // 2, first + blocks * DOWN + TAPS // 2 + DOWN
        x = np.zeros(hi - lo)
        inside = raw[max(lo, 0) : max(min(hi, len(raw)), 0)]
        x[max(-lo, 0) : max(-lo, 0) + len(inside)] = (inside.astype(np.float64) - 128) / 128
        y = resample(x, blocks)
        spans = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n] * TAPER
        power = np.abs(np.fft.rfft(spans, axis=1)) ** 2
        mels.append(np.log(power @ MEL_BANK + FLOOR))
        energy.append(10 * np.log10((spans**2).mean(axis=1) + FLOOR))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray) -> np.ndarray:
    """Frame ranges [start, stop) that hold a frame over the opening threshold.

    A segment extends while energy stays over the lower threshold, so short
    dips neither end nor start one.
    """
    middle = np.median(energy)
    hold = np.concatenate([[False], energy >= middle + HOLD_DB, [False]])
    edges = np.flatnonzero(hold[1:] != hold[:-1]).reshape(-1, 2)
    loud = np.concatenate([[0], np.cumsum(energy >= middle + OPEN_DB)])
    return edges[loud[edges[:, 1]] > loud[edges[:, 0]]] if len(edges) else edges


def tensor_stream(mels: np.ndarray) -> bytes:
    """Arrow stream of fixed-shape tensors (WINDOW x MELS, half precision) with their time spans in seconds."""
    windows = -(-len(mels) // WINDOW)
    padded = np.full((windows * WINDOW, MELS), np.log(FLOOR), dtype=np.float16)
    padded[: len(mels)] = mels
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(padded.reshape(windows, WINDOW, MELS))
    start = np.arange(windows) * WINDOW * HOP / FEATURE_RATE
    stop = (np.minimum((np.arange(windows) + 1) * WINDOW, len(mels)) * HOP + FRAME - HOP) / FEATURE_RATE
    batch = pa.RecordBatch.from_arrays([tensors, pa.array(start), pa.array(stop)], names=["log_mel", "start_s", "stop_s"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tensors and spans of tensor_stream."""
    got = pa.ipc.open_stream(stream).read_all().combine_chunks()
    column = got["log_mel"].chunk(0) if got["log_mel"].num_chunks else got["log_mel"].combine_chunks()
    return column.to_numpy_ndarray(), np.stack([got["start_s"].to_numpy(), got["stop_s"].to_numpy()], axis=1)


def feature_digest(tensors: np.ndarray, spans: np.ndarray, runs: np.ndarray) -> str:
    """Counts, times and a digest of the stored tensors.

    All arithmetic is in double precision, whose errors are far below the step
    of the halves that are stored, so equal audio gives equal strings on any
    machine.
    """
    body = hashlib.sha256(np.ascontiguousarray(tensors, dtype="<f2").tobytes() + runs.astype("<i8").tobytes()).hexdigest()[:32]
    held = float((runs[:, 1] - runs[:, 0]).sum() * HOP / FEATURE_RATE)
    return f"tensors={len(tensors)};seconds={spans[-1, 1]:.4f};segments={len(runs)};held={held:.4f};mel={body}"


def _rows(rows: DataFrame, fields: pa.Schema, describe: Callable[[tuple], dict]) -> DataFrame:
    """A row of ``fields`` for each row, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = [describe(x) for x in batch.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_pylist(out, schema=fields)

    return rows.mapInArrow(run, from_arrow_schema(fields))


def recorded(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): every text as a WAV file.  A null text is an empty one, which has BLOCK zero bytes."""
    rows = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    fields = pa.schema([("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return _rows(rows, fields, lambda x: {"doc_id": x["doc_id"], "n_bytes": len((x["text"] or "").encode("utf-8", "surrogatepass")), "media": store(payload_of(x["text"]))})


def heard(media: DataFrame) -> DataFrame:
    """Reads WAV files back: digests of payload and file, the Arrow stream of log-mel tensors with their spans, and the loud segments."""
    fields = pa.schema([("doc_id", to_arrow_type(media.schema["doc_id"].dataType)), *HEARD, *TENSORS])

    def describe(row: dict) -> dict:
        back = load(row["media"])
        mels, energy = log_mel(back)
        return {
            "doc_id": row["doc_id"], "n_bytes": row["n_bytes"], "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-BLOCK:]),
            "media_bytes": len(row["media"]), "media_sha256": hashlib.sha256(row["media"]).hexdigest(), "log_mel": tensor_stream(mels),
            "segments": [{"start": a, "stop": b, "start_s": a * HOP / FEATURE_RATE, "stop_s": (b * HOP + FRAME - HOP) / FEATURE_RATE} for a, b in segments(energy).tolist()],
        }

    return _rows(media, fields, describe)


HEARD = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
TENSORS = [("log_mel", pa.binary()), ("segments", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("start_s", pa.float64()), ("stop_s", pa.float64())])))]


def summarised(features: DataFrame) -> DataFrame:
    """Reads stored tensors and segments: the columns of ``heard`` with ``feature`` in place of them."""
    fields = pa.schema([("doc_id", to_arrow_type(features.schema["doc_id"].dataType)), *HEARD, ("feature", pa.string())])

    def describe(row: dict) -> dict:
        tensors, spans = read_tensors(row.pop("log_mel"))
        runs = np.array([(s["start"], s["stop"]) for s in row.pop("segments")], dtype=np.int64).reshape(-1, 2)
        return row | {"feature": feature_digest(tensors, spans, runs)}

    return _rows(features, fields, describe)


def audio_features(docs: DataFrame, work: Work, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Media and feature columns of every text: (media, features, summary), a row each for each row of ``docs``.

    ``media`` (doc_id, n_bytes, media) is a stored table of WAV files;
    ``features`` (doc_id, HEARD, TENSORS) is a stored table of what was
    computed from the files read back; ``summary`` (doc_id, HEARD, feature) is
    read from that one.  A null or empty text is 64 zero bytes; long ones are
    computed in pieces and never cut; repeated rows and equal texts give equal
    values; a null key stays null; an empty table gives empty ones; other
    columns are ignored.
    """
    media = work.table(recorded(docs, text, key), "media", compression="zstd")
    features = work.table(heard(media), "features", compression="zstd")
    return media, features, summarised(features)
