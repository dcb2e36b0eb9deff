"""Media columns: lossless 8-bit audio of bytes, and audio features.

A payload becomes a RIFF/WAVE file with one channel of unsigned 8-bit samples.
Features are computed from the samples that the stored file gives back:
polyphase resampling by UP/DOWN, overlapped log-mel filterbanks, and segments
found by frame energy with two thresholds (one to open, a lower one to close).
The log-mel frames are stored as an Arrow stream of fixed-shape tensors
(BLOCK x MELS) with time spans; the last block of a file is padded with the
floor value.  `digests` reads both stored forms back.

Defined results: null text counts as empty; its payload is 64 bytes 0.  A text
gets the same values wherever it stands, since each is computed by itself.
Of very long payloads, signal and spectra are held BLOCK_FRAMES frames at a time;
what is held whole is the payload, the stored forms (together about as long) and
a number for each frame.  Repeated rows and further columns of the input do no
harm; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridweave.llm.common import PerWorker

RATE, UP, DOWN = 16_000, 1, 2
FRAME, HOP, MELS, FLOOR = 256, 160, 24, -10.0
#: Frames of a tensor.
BLOCK = 64
#: Frames that are computed at a time, a multiple of BLOCK.
BLOCK_FRAMES = 4096
TAPS = 8
#: Mean log energy over the file's median at which a segment opens and closes.
OPEN, CLOSE = 0.02, -0.02


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    pad = len(payload) % 2
    head = b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * pad


def from_wav(stored: bytes) -> tuple[int, bytes]:
    """Sampling rate and the sample bytes of a file of 8-bit samples."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not one channel of 8-bit samples")
        elif name == b"data":
            return rate, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text in bytes, and these bytes filled up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


class AudioFeatures:
    """Filters and window, made once."""

    def __init__(self, rate: int = RATE, up: int = UP, down: int = DOWN):
        self.up, self.down = up, down
        self.rate = rate * up / down
        length = 2 * TAPS * max(up, down) + 1
        t = np.arange(length) - length // 2
        low_pass = np.sinc(t / max(up, down)) * np.hanning(length + 2)[1:-1]
        self.taps = (low_pass / low_pass.sum() * up).astype(np.float32)
        self.window = np.hanning(FRAME + 1)[:-1].astype(np.float32)
        mel = lambda f: 2595 * np.log10(1 + f / 700)
        edges = 700 * (10 ** (np.linspace(0, mel(self.rate / 2), MELS + 2) / 2595) - 1)
        bins = np.fft.rfftfreq(FRAME, 1 / self.rate)[:, None]
        rising, falling = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
        self.bank = np.maximum(0, np.minimum(rising, falling)).astype(np.float32)

    def length(self, n: int) -> int:
        """Samples after resampling n."""
        return -(-n * self.up // self.down)

    def resample(self, samples: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Outputs start to stop.  Polyphase: output m is a dot product of one
        phase of the filter with the inputs around m * down / up; no product with
        a stuffed zero is made."""
        half = len(self.taps) // 2
        stop = self.length(len(samples)) if stop is None else stop
        out = np.zeros(stop - start, np.float32)
        low = (start * self.down - half) // self.up  # inputs from here on are held
        high = (stop * self.down + half) // self.up + self.down + 1
        padded = np.zeros(high - low, np.float32)
        padded[max(0, -low) : max(0, min(high, len(samples)) - low)] = samples[max(0, low) : max(0, min(high, len(samples)))]
        for phase in range(start, min(start + self.up, stop)):
            which = len(range(phase, stop, self.up))
            place = phase * self.down
            for i in range(-(-(place - half) // self.up), (place + half) // self.up + 1):
                tap = self.taps[place - i * self.up + half]
                out[phase - start :: self.up] += tap * padded[i - low : i - low + self.down * which : self.down][:which]
        return out

    def frames(self, n: int) -> int:
        return max(1, -(-max(0, self.length(n) - FRAME) // HOP) + 1)

    def log_mel(self, samples: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Log filterbank energies (frames x MELS) and log energy of frames start to stop."""
        first, last = start * HOP, (stop - 1) * HOP + FRAME
        signal = np.zeros(last - first, np.float32)
        some = self.resample(samples, first, min(last, self.length(len(samples))))
        signal[: len(some)] = some
        part = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP] * self.window
        spectrum = np.fft.rfft(part, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels = np.log10(power @ self.bank / FRAME + 10**FLOOR)
        return np.round(mels, 3).astype(np.float32), np.log10((part * part).sum(axis=1) / FRAME + 10**FLOOR)

    @staticmethod
    def segments(energy: np.ndarray) -> list[tuple[int, int]]:
        """Frame ranges: opened at OPEN over the median, closed under CLOSE."""
        rel = np.round(energy - np.median(energy), 4)
        state = np.where(rel >= OPEN, 1, np.where(rel < CLOSE, -1, 0))
        known = np.maximum.accumulate(np.where(state != 0, np.arange(1, len(state) + 1), 0))
        on = np.concatenate([[False], np.where(known > 0, state[known - 1] > 0, False), [False]])
        change = np.flatnonzero(on[1:] != on[:-1])
        return list(zip(change[::2].tolist(), change[1::2].tolist()))

    def stored(self, samples: bytes) -> bytes:
        """An Arrow stream: for each block of frames its time span in seconds,
        the number of its frames that are real, whether a segment meets it, and
        its tensor; the segments, as frame numbers, are in the schema's metadata."""
        raw = np.frombuffer(samples, np.uint8)
        n = self.frames(len(raw))
        energy, blocks = [], []
        for start in range(0, n, BLOCK_FRAMES):
            mels, e = self.log_mel(_Signal(raw), start, min(start + BLOCK_FRAMES, n))
            energy.append(e)
            full = np.full((-(-len(mels) // BLOCK) * BLOCK, MELS), FLOOR, np.float32)
            full[: len(mels)] = mels
            blocks.append(full)
        found = self.segments(np.concatenate(energy))
        values = np.concatenate(blocks).reshape(-1)
        count = len(values) // (BLOCK * MELS)
        starts = np.arange(count) * BLOCK
        ends = np.minimum(starts + BLOCK, n)
        edges = np.zeros(n + 1, np.int64)
        for a, z in found:
            edges[a] += 1
            edges[z] -= 1
        active = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:-1] > 0)])
        tensors = pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(pa.array(values), BLOCK * MELS))
        columns = [pa.array(starts * HOP / self.rate), pa.array(((ends - 1) * HOP + FRAME) / self.rate), pa.array((ends - starts).astype(np.int32)), pa.array(active[ends] > active[starts]), tensors]
        schema = pa.schema([pa.field(name, c.type) for name, c in zip(TENSOR_NAMES, columns)], {b"segments": np.array(found, "<i4").tobytes()})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as writer:
            writer.write_table(pa.Table.from_arrays(columns, schema=schema), max_chunksize=4096)
        return sink.getvalue().to_pybytes()


class _Signal:
    """Samples as numbers from -1 to 1, of which only slices are made."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw

    def __len__(self) -> int:
        return len(self.raw)

    def __getitem__(self, at: slice) -> np.ndarray:
        return (self.raw[at].astype(np.float32) - 128) / 128


TENSOR_NAMES = ["start_s", "end_s", "frames", "active", "tensor"]


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), (BLOCK, MELS))


def read_tensors(stored: bytes) -> tuple[pa.Table, list[tuple[int, int]]]:
    """The stored blocks, with tensors of Arrow's fixed-shape type, and the segments."""
    table = pa.ipc.open_stream(stored).read_all()
    found = np.frombuffer(table.schema.metadata[b"segments"], "<i4").reshape(-1, 2)
    return table, [(a, z) for a, z in found.tolist()]


def media(docs: DataFrame) -> DataFrame:
    """doc_id, wav (the stored payload) and tensors (the stored features) of each row."""
    shared = PerWorker(docs.sparkSession, AudioFeatures)

    def run(batches):
        made = shared.get()
        for b in batches:
            for k, text in enumerate(b.column(1).to_pylist()):  # one row at a time: stored forms may be long
                wav = to_wav(payload_of(text)[1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([wav], pa.binary()), pa.array([made.stored(from_wav(wav)[1])], pa.binary())], ["doc_id", "wav", "tensors"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, wav binary, tensors binary")


def digest(n: int, wav: bytes, tensors: bytes) -> tuple:
    """What `digests` says of a row, from its stored forms."""
    back = from_wav(wav)[1]
    table, found = read_tensors(tensors)
    values = table["tensor"].combine_chunks().storage.flatten().to_numpy()
    hashed = hashlib.sha256(np.rint(values * 1000).astype("<i4").tobytes())
    hashed.update(np.array(found, "<i4").tobytes())
    for name in ("start_s", "end_s"):
        hashed.update(np.rint(table[name].to_numpy() * 1e6).astype("<i8").tobytes())
    frames = sum(table["frames"].to_pylist())
    feature = f"frames={frames};blocks={table.num_rows};segments={len(found)};sha256={hashed.hexdigest()}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), feature


def digests(docs: DataFrame) -> DataFrame:
    """A row for each document: payload, stored form and features as digests.

    feature: frames, blocks, segments and the SHA-256 of the tensors (in
    thousandths, as little-endian 32-bit integers), of the segments and of the
    blocks' time spans (microseconds), all read back from the stored forms.
    """
    shared = PerWorker(docs.sparkSession, AudioFeatures)

    def one(text: str | None, made: AudioFeatures):
        n, payload = payload_of(text)
        wav = to_wav(payload)
        return digest(n, wav, made.stored(from_wav(wav)[1]))

    def run(batches):
        made = shared.get()
        for b in batches:
            rows = [one(t, made) for t in b.column(1).to_pylist()]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
