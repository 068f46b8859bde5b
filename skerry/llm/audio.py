"""Media columns: sound as 8-bit samples, and its features as fixed-shape Arrow tensors.

A payload becomes a mono WAV file of unsigned 8-bit samples, losslessly, in a binary
column of a written table. Features of the stored sound: the samples are resampled by a
polyphase filter, cut into overlapped windows, and turned into log-mel energies; frames of
sound are told from pauses by hysteresis (on above the upper threshold, off below the
lower one). Frames are stored in tensors of ``FRAMES`` by ``MELS`` half floats, the last
one of a sound filled up, each with its time span and beside a tensor of ``FRAMES`` marks that tell
which frames are sound, in Arrow files in the shared folder. The written result names these files, once for
all actions: what a lost or repeated task left behind is in no row of it and doesn't count.

Rows: null text counts as empty; payloads are padded with zero bytes to a positive
multiple of 64; null and repeated doc_ids are kept; other columns are ignored; an empty
table gives no files and no rows; long texts are whole sounds. Equal payloads have equal features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, new_folder, open_fs, task_file
from .tokens import slices

RATE, UP, DOWN = 16_000, 1, 2
WINDOW, HOP, MELS, FRAMES = 256, 128, 20, 32
ON, OFF = 1.0, 0.25  # above the median log energy


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Mono WAV with the bytes as unsigned 8-bit samples."""
    pad = b"\0" * (len(payload) % 2)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and sample bytes of a mono 8-bit WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit samples")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache
def _low_pass(up: int, down: int, half: int = 8) -> np.ndarray:
    """Windowed-sinc filter with its cut-off at the lower of the two rates."""
    widest = max(up, down)
    n = np.arange(-half * widest, half * widest + 1)
    h = np.sinc(n / widest) * np.hamming(len(n))
    return (h / h.sum() * up).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling by up / down: each output phase has its own part of the filter.

    Output n stands at input position n * down / up; ceil(len(x) * up / down) outputs.
    """
    h, count = _low_pass(up, down), -(-len(x) * up // down)
    middle, out = len(h) // 2, np.zeros(count, np.float32)
    for phase in range(up):  # outputs whose position has this phase
        first = next(n for n in range(up) if (n * down + middle) % up == phase)
        own, taps = np.arange(first, count, up), h[phase::up]
        start = (own * down + middle) // up
        if not len(own):
            continue
        # in steps of `down` inputs: one convolution for each of `down` input phases
        for k in range(min(down, len(taps))):
            part = taps[k::down]
            offset = int(start[0]) - k
            lo, size = offset % down, int(start[-1]) - k
            line = x[lo::down].astype(np.float32)
            got = np.convolve(line, part) if len(line) else np.zeros(1, np.float32)
            at = (offset - lo) // down
            need = (size - lo) // down + 1
            piece = got[max(at, 0) : need]
            skip = max(0, -at)
            out[own[skip : skip + len(piece)]] += piece
    return out


@lru_cache
def _mel_bank(rate: int) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, a column for each."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(WINDOW, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """Log energies of overlapped windows, one row each; sounds are filled up with zeros so that every sample lies in a window."""
    x = np.pad(x, (0, max(WINDOW - len(x), (WINDOW - len(x)) % HOP)))
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    shape, bank = np.hanning(WINDOW).astype(np.float32), _mel_bank(rate)
    out = np.empty((len(frames), MELS), np.float32)
    for i in range(0, len(frames), 4096):
        spectrum = np.fft.rfft(frames[i : i + 4096] * shape, axis=1)
        out[i : i + 4096] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank
    return np.log(out + 1e-6)


def segments(energy: np.ndarray, on: float = ON, off: float = OFF) -> np.ndarray:
    """(first, after last) frame of each stretch of sound, by hysteresis around the median."""
    base = np.median(energy)
    switch = np.where(energy > base + on, 1, np.where(energy < base + off, 0, -1))
    switch[0] = max(switch[0], 0)
    last = np.maximum.accumulate(np.where(switch >= 0, np.arange(len(switch)), 0))
    edges = np.diff(np.concatenate([[0], switch[last], [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)


def features(media: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[float, float]]]:
    """Tensors (n, FRAMES, MELS), marks (n, FRAMES) of sound, their time spans in seconds, and the time spans of sound."""
    rate, samples = from_wav(media)
    x = resample(np.frombuffer(samples, np.uint8).astype(np.float32) / 128 - 1)
    mel = log_mel(x, rate * UP // DOWN)
    step = HOP * DOWN / UP / rate
    n = -(-len(mel) // FRAMES)
    full = np.full((n * FRAMES, MELS), np.log(1e-6), np.float32)
    full[: len(mel)] = mel
    first = np.arange(n) * FRAMES
    spans = np.stack([first * step, np.minimum(first + FRAMES, len(mel)) * step], axis=1)
    marks, found = np.zeros(n * FRAMES, np.uint8), segments(mel.mean(axis=1)).tolist()
    for a, b in found:
        marks[a:b] = 1
    return full.reshape(n, FRAMES, MELS).astype(np.float16), marks.reshape(n, FRAMES), spans, [(a * step, b * step) for a, b in found]


TENSOR, MARKS = pa.fixed_shape_tensor(pa.float16(), (FRAMES, MELS)), pa.fixed_shape_tensor(pa.uint8(), (FRAMES,))
TENSORS = pa.schema([("doc_id", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", TENSOR), ("sound", MARKS)])


def tensors_of(key: int | None, tensors: np.ndarray, marks: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
    """A sound's tensors as rows of ``TENSORS``."""
    mel = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1), pa.float16()), FRAMES * MELS)
    sound = pa.FixedSizeListArray.from_arrays(pa.array(marks.reshape(-1), pa.uint8()), FRAMES)
    columns = [pa.array([key] * len(tensors), pa.int64()), pa.array(spans[:, 0]), pa.array(spans[:, 1])]
    return pa.RecordBatch.from_arrays([*columns, pa.ExtensionArray.from_storage(TENSOR, mel), pa.ExtensionArray.from_storage(MARKS, sound)], schema=TENSORS)


def read_tensors(uri: str) -> Iterator[pa.RecordBatch]:
    """The rows of one tensor file that a result names, a batch for each sound."""
    store, path = open_fs(uri)
    with store.open_input_file(path) as f:
        reader = pa.ipc.open_file(f)
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 8_000_000):
            raw = [(t or "").encode() for t in part.column("text").to_pylist()]
            media = [to_wav(r.ljust(max(64, -(-len(r) // 64) * 64), b"\0")) for r in raw]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text's bytes as a WAV file, as a written table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(_encode, "doc_id long, n_bytes long, media binary"), "media")


def _features(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tensors", pa.int64()), ("tensor_file", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for part in slices(batch, 8_000_000, "media"):
                if out is None:
                    store, path, uri = task_file(folder, ".arrow")
                    sink = store.open_output_stream(path)
                    out = pa.ipc.new_file(sink, TENSORS, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                rows = []
                for key, n, media in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                    tensors, marks, spans, sound = features(media)
                    payload = from_wav(media)[1]
                    out.write_batch(tensors_of(key, tensors, marks, spans))
                    digest = hashlib.sha256(tensors.tobytes() + marks.tobytes()).hexdigest()
                    note = f"tensors={len(tensors)};seconds={spans[-1, 1]:.3f};sounds={len(sound)};sound_s={sum(b - a for a, b in sound):.3f};sha256={digest}"
                    rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), note, len(tensors), uri))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
        if out is not None:  # a task that fails leaves its file without an end
            out.close()
            sink.close()

    return run


def audio_features(media: DataFrame, folder: str | None = None) -> DataFrame:
    """Features of a table from ``media_table``, as a written table; tensors are written to ``folder``.

    Returns a row for each sound with digests of the payload and of the stored form as read
    back, a summary of the features, and the Arrow file that holds its tensors.
    """
    folder = folder or new_folder(media.sparkSession, "tensors")
    found = media.mapInArrow(_features(folder), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensors long, tensor_file string")
    return materialize(found, "features")
