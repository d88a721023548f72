"""Leaves: what a clip's audio gives. Each runs once per clip and returns one row.

A Backend has plain numpy functions: decode, pitch, emissions, latents and
voice; models plug in by subclassing. The default needs numpy alone: PCM wave
files, autocorrelation pitch, and Viterbi alignment of whatever CTC emissions a
subclass gives. ``precompute`` is the one pass from clip and text to targets,
pitch, windows, transcript and embedding; its parts are read out with
``frames_of`` and ``windows_of``. A clip that cannot be read is a row with a
status, not a gap.
"""

from __future__ import annotations

import io
import math
import threading
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import align_text
from ..operators import signal


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono float samples and the rate of PCM of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:  # the only unsigned width
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))
    return mono(x.reshape(-1, channels)), rate


def mono(x: np.ndarray) -> np.ndarray:
    """The mean of the channels."""
    return x.mean(axis=1) if x.ndim > 1 else x


def resampled(x: np.ndarray, rate: int, to: int, crossings: int = 24) -> np.ndarray:
    """x at another rate, band-limited: what lies above half of the lower rate is filtered out, so nothing folds back.

    Each output sample is a sum over a windowed sinc (Hann, so many zero
    crossings to a side), divided by the sum of its weights; memory is bounded.
    """
    if rate == to or not len(x):
        return x
    n, cut = round(len(x) * to / rate), min(1.0, to / rate)
    reach = int(np.ceil(crossings / cut))
    taps = np.arange(-reach, reach + 1)
    out, x = np.empty(n, np.float32), np.asarray(x, np.float64)
    for lo in range(0, n, 1 << 12):
        at = np.arange(lo, min(n, lo + (1 << 12))) * (rate / to)
        k = np.floor(at).astype(np.int64)[:, None] + taps
        d = (at[:, None] - k) * cut
        w = np.sinc(d) * np.where(np.abs(d) < crossings, 0.5 + 0.5 * np.cos(np.pi * d / crossings), 0)
        w = np.where((k >= 0) & (k < len(x)), w, 0)
        out[lo : lo + len(at)] = (w * x[np.clip(k, 0, len(x) - 1)]).sum(axis=1) / w.sum(axis=1)
    return out


def peak_normalised(x: np.ndarray, peak: float = 0.95) -> np.ndarray:
    top = np.abs(x).max(initial=0.0)
    return x * (peak / top) if top > 0 else x


def fft_size(n: int) -> int:
    """The least number from n on without prime factors above 5, for which transforms are fast."""
    return min(f << max(0, -(-n // f) - 1).bit_length() for f in (1, 3, 5, 9, 15, 25, 27, 45, 75))


#: Frames that the tracker takes at once, at most, and the arrays that a thread's calls use again: new ones of this size would be new pages each time.
FRAMES, _room = 136, threading.local()


def _space(name: str, *shape: int, kind: type = float) -> np.ndarray:
    """An array of a thread, of whatever it held before."""
    n, held = math.prod(shape), _room.__dict__.get(name)
    if held is None or held.size < n:
        held = _room.__dict__[name] = np.empty(n, kind)
    return held[:n].reshape(shape)


def pitch(x: np.ndarray, rate: int, lo: float = 65.0, hi: float = 400.0, hop: float = 0.01, width: float = 0.04, voiced: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """times, f0 (NaN: unvoiced) and confidence by the normalised difference function, with parabolic refinement; some frames at once, in as few arrays as will do.

    Where hops divide the window, products at each lag are summed once a hop and
    a window adds up its hops; else once a window.
    """
    n, step = int(width * rate), int(hop * rate)
    longest, shortest = int(rate / lo) + 1, max(2, int(rate / hi))
    starts = np.arange(0, max(0, len(x) - n - longest), step)
    times, f0, sure = starts / rate + width / 2, np.full(len(starts), np.nan), np.zeros(len(starts))
    part = n if n % step else step
    size, lags, places = fft_size(part + longest), np.arange(1.0, longest + 1), np.arange(longest - shortest, dtype=np.int16)
    each = -(-len(starts) // max(1, -(-len(starts) // FRAMES)))
    for at in range(0, len(starts), max(1, each)):
        rows = np.arange(min(each, len(starts) - at))
        m, begin = len(rows), at * step
        b = np.array(x[begin : begin + (m - 1) * step + n + longest], np.float64)
        gap, k = b.itemsize, m + n // part - 1
        padded, spectrum, first = _space("padded", k, size), *(_space(c, k, size // 2 + 1, kind=complex) for c in ("spectrum", "first"))
        padded[:, part + longest :] = 0
        padded[:, : part + longest] = np.lib.stride_tricks.as_strided(b, (k, part + longest), (gap * step, gap), writeable=False)
        np.fft.rfft(padded, out=spectrum)
        padded[:, part:] = 0
        np.fft.rfft(padded, out=first)
        spectrum *= np.conj(first, out=first)
        sums = np.fft.irfft(spectrum, size, out=padded)[:, : longest + 1]
        diff = _space("diff", m, longest + 1)
        diff[:] = sums[:m]
        for k in range(1, n // part):
            diff += sums[k : k + m]
        energy = np.zeros(len(b) + 1)
        np.cumsum(b * b, out=energy[1:])
        across = energy[n:] - energy[:-n]
        moving = np.lib.stride_tricks.as_strided(across, (m, longest + 1), (gap * step, gap), writeable=False)
        own = moving[:, 0].copy()
        diff *= -2
        diff += moving
        diff += own[:, None]
        diff = diff[:, 1:]
        norm = np.cumsum(diff, axis=1, out=_space("norm", m, longest))
        np.maximum(norm, 1e-12, out=norm)
        diff *= lags
        np.divide(diff, norm, out=norm)
        band = norm[:, shortest - 1 : longest - 1]
        good = band < 0.15
        # The first dip under the threshold, followed to its bottom; the least of all where there is none.
        start = good.argmax(axis=1)
        any_good = good[rows, start]
        turns = np.ones(band.shape, bool)
        np.greater_equal(band[:, 1:], band[:, :-1], out=turns[:, :-1])
        turns &= places >= start[:, None]
        bottom = turns.argmax(axis=1)
        j = np.where(any_good, bottom, band.argmin(axis=1))
        depth, lag = band[rows, j], j + shortest
        l, c, r = norm[rows, np.maximum(lag - 2, 0)], norm[rows, lag - 1], norm[rows, np.minimum(lag, longest - 1)]
        bend = l - 2 * c + r
        fine = lag + np.where((bend != 0) & (lag > 1) & (lag < longest), 0.5 * (l - r) / np.where(bend, bend, 1), 0)
        live = (depth <= voiced) & (np.sqrt(np.maximum(own, 0) / n) >= 1e-3)
        f0[at : at + m] = np.where(live, rate / fine, np.nan)
        sure[at : at + m] = np.where(live, np.clip(1 - depth, 0, 1), 0)
    return times, f0, sure


def greedy_decode(logits: np.ndarray, vocabulary: list[str], blank: int = 0) -> str:
    """The best symbol of each frame, repeats collapsed, blanks dropped."""
    best = logits.argmax(axis=1)
    kept = best[np.r_[True, best[1:] != best[:-1]]] if len(best) else best
    return "".join(vocabulary[k] for k in kept if k != blank)


def ctc_windows(logits: np.ndarray, symbols: list[int], seconds: float, blank: int = 0) -> list[tuple[float, float] | None]:
    """Times of each symbol on the best path through the emission matrix; None for all if the frames are too few."""
    t, n = len(logits), len(symbols)
    if not n or t < n + sum(a == b for a, b in zip(symbols, symbols[1:], strict=False)):
        return [None] * n
    lp = logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)
    states = np.array([blank if k % 2 == 0 else symbols[k // 2] for k in range(2 * n + 1)])
    skip = np.array([k >= 2 and k % 2 == 1 and states[k] != states[k - 2] for k in range(len(states))])
    score = np.full(len(states), -np.inf)
    score[:2] = lp[0, states[:2]]
    back = np.zeros((t, len(states)), np.int8)
    for i in range(1, t):
        one = np.r_[-np.inf, score[:-1]]
        two = np.where(skip, np.r_[-np.inf, -np.inf, score[:-2]], -np.inf)
        choice = np.argmax([score, one, two], axis=0)
        back[i] = choice
        score = np.choose(choice, [score, one, two]) + lp[i, states]
    s = len(states) - 1 if score[-1] >= score[-2] else len(states) - 2
    path = [s]
    for i in range(t - 1, 0, -1):
        s -= back[i, s]
        path.append(s)
    path = np.array(path[::-1])
    each = seconds / t
    out = []
    for k in range(n):
        at = np.flatnonzero(path == 2 * k + 1)
        out.append((float(at[0] * each), float((at[-1] + 1) * each)) if len(at) else None)
    return out


def segment(latents: np.ndarray, t0: float | None, t1: float | None, hop: float = 0.02, least: int = 2) -> np.ndarray | None:
    """The latent frames of a window; None if it is not aligned or too short."""
    if t0 is None or t1 is None:
        return None
    out = latents[max(0, int(t0 / hop)) : int(np.ceil(t1 / hop))]
    return out if len(out) >= least else None


def unit_windows(backend: Backend, text: str, logits: np.ndarray, seconds: float, whole: bool = False) -> list[tuple[float, float] | None] | None:
    """Times of each tone-bearing unit by forced alignment; a unit whose character the model lacks is None. whole: None altogether if any unit is. None if nothing can be aligned."""
    flat, places, _ = align_text(text)
    ids, at = [], []
    for k, c in enumerate(flat):
        i = backend.symbol(c)
        if i is not None:
            ids.append(i)
            at.append(k)
    if len(flat) < 2 or not places or len(ids) < 2:
        return None
    found = dict(zip(at, ctc_windows(logits, ids, seconds, backend.blank), strict=True))
    out = [found.get(p) for p in places]
    return None if whole and None in out else out


class Backend:
    """Pitch by autocorrelation; no acoustic model, hence no alignment, latents or voice."""

    name = "numpy"
    #: The rate that models hear.
    rate = 16_000
    blank = 0
    vocabulary: tuple[str, ...] = ()

    def decode(self, data: bytes) -> tuple[np.ndarray, int]:
        """Samples and rate. Compressed kinds need a subclass with a codec."""
        if data[:4] != b"RIFF":
            raise ValueError("not a wave file")
        return read_wav(data)

    def pitch(self, x: np.ndarray, rate: int, lo: float = 65.0, hi: float = 400.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return pitch(x, rate, lo, hi)

    def emissions(self, x: np.ndarray) -> np.ndarray | None:
        """Frames by symbols."""
        return None

    def latents(self, x: np.ndarray) -> np.ndarray | None:
        """Frames, 20 ms each, by dimensions."""
        return None

    def voice(self, x: np.ndarray) -> np.ndarray | None:
        return None

    def symbol(self, character: str) -> int | None:
        """The model's number of a character, a space being |; None if it has none."""
        c = "|" if character == " " else character
        return self.vocabulary.index(c) if c in self.vocabulary and self.vocabulary.index(c) != self.blank else None

    def transcript(self, logits: np.ndarray) -> str:
        return greedy_decode(logits, list(self.vocabulary), self.blank).replace("|", " ").strip()


@lru_cache(maxsize=4)
def loaded(kind: type[Backend]) -> Backend:
    """One backend of a kind per worker."""
    return kind()


def read(backend: Backend, data: bytes, peak: float | None = None) -> tuple[np.ndarray | None, int, str]:
    """Samples, rate and status (ok, or why there are none)."""
    try:
        x, rate = backend.decode(bytes(data))
    except (wave.Error, EOFError, ValueError) as e:
        return None, 0, f"unreadable: {e}"
    if not len(x):
        return None, rate, "empty"
    return x if peak is None else peak_normalised(x, peak), rate, "ok"


FRAME = "clip_id string, status string, backend string, frame_idx int, t double, f0 double, confidence double"


def frames(clips: DataFrame, kind: type[Backend] = Backend, lo: float = 65.0, hi: float = 400.0, peak: float | None = None) -> DataFrame:
    """frames(clip_id, status, backend, frame_idx, t, f0, confidence) of clips(clip_id, content), NaN as NULL. A clip that cannot be read gives one row with its status and no time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = loaded(kind)
        for batch in batches:
            for clip, data in zip(batch.clip_id, batch.content, strict=True):
                x, rate, status = read(backend, data, peak)
                times, f0, sure = ([None],) * 3 if x is None else backend.pitch(x, rate, lo, hi)
                yield pd.DataFrame({"clip_id": clip, "status": status, "backend": backend.name, "frame_idx": range(len(times)), "t": times, "f0": f0, "confidence": sure}).astype({"t": float, "f0": float, "confidence": float})

    out = clips.select(F.col("clip_id").cast("string"), "content").mapInPandas(run, FRAME)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("t", "f0", "confidence")})


PRECOMPUTED = "clip_id string, status string, backend string, method string, seconds double, targets array<string>, times array<double>, f0 array<double>, t0 array<double>, t1 array<double>, hyp string, voice array<double>, latents array<float>, latent_width int"


#: Results leave a task in batches of so many clips, or earlier, as soon as they hold so many numbers.
BATCH, NUMBERS = 64, 1 << 18


def _lists(values: list[np.ndarray | None], kind: pa.DataType, missing: bool = False) -> pa.Array:
    """Lists of numbers, or NULLs; missing: NaN is NULL in them."""
    flat = np.concatenate([np.ravel(v) for v in values if v is not None] or [np.empty(0)])
    offsets = np.cumsum([0] + [0 if v is None else np.size(v) for v in values])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind, mask=np.isnan(flat) if missing else None), mask=pa.array([v is None for v in values]))


def precompute(clips: DataFrame, kind: type[Backend] = Backend, whole: bool = False, lo: float = 65.0, hi: float = 400.0, peak: float | None = None) -> DataFrame:
    """All that scoring needs of clips(clip_id, text, content), one row each, in one pass over the audio.

    method: forced-align, else proportional (the voiced span in equal windows),
    else abstain (no span; windows are NULL). whole: a clip of which one unit is
    not aligned falls back altogether. peak: clips are scaled to that peak first.
    Emissions are computed once for both the transcript and the windows. latents
    (frames one after the other, latent_width numbers each), voice and hyp are
    NULL without a model. Rows leave by a few clips at once, long ones by
    themselves, so a task holds few results, beside the clips' bytes of its
    partition.
    """

    def row(backend: Backend, clip: str, text: str | None, data: bytes) -> tuple:
        x, rate, status = read(backend, data, peak)
        tones = list(align_text(text or "")[2])
        method, seconds, found, hyp = "abstain", 0.0, None, None
        times = f0 = np.empty(0)
        voice = latents = None
        if x is not None:
            times, f0, _ = backend.pitch(x, rate, lo, hi)
            at_rate, seconds = resampled(x, rate, backend.rate), len(x) / rate
            logits, latents, voice = backend.emissions(at_rate), backend.latents(at_rate), backend.voice(at_rate)
            if logits is not None:
                hyp, found = backend.transcript(logits), unit_windows(backend, text or "", logits, seconds, whole)
            live = np.flatnonzero(~np.isnan(f0))
            if found is not None:
                method = "forced-align"
            elif len(live) and tones:
                edges = np.linspace(times[live[0]], times[live[-1]], len(tones) + 1)
                found, method = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)), "proportional"
        found = found or [None] * len(tones)
        t0, t1 = ([w and w[k] for w in found] for k in range(2))
        return clip, status, backend.name, method, seconds, tones, times, f0, t0, t1, hyp, voice, latents, None if latents is None else int(latents.shape[1])

    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
    names, declared = zip(*(c.split() for c in PRECOMPUTED.split(", ")), strict=True)
    arrays = {"times": (pa.float64(), False), "f0": (pa.float64(), True), "voice": (pa.float64(), False), "latents": (pa.float32(), False)}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(names, declared, zip(*rows, strict=True), strict=True)
        return pa.RecordBatch.from_arrays([_lists(list(v), *arrays[c]) if c in arrays else pa.array(v, kinds[kind]) for c, kind, v in columns], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend, held, numbers = loaded(kind), [], 0
        for b in batches:
            for k in range(b.num_rows):
                held.append(row(backend, *(b.column(c)[k].as_py() for c in range(3))))
                numbers += sum(np.size(v) for c, v in zip(names, held[-1], strict=True) if c in arrays and v is not None) + len(held[-1][5])
                if len(held) >= BATCH or numbers >= NUMBERS:
                    yield batch(held)
                    held, numbers = [], 0
        if held:
            yield batch(held)

    return clips.select(F.col("clip_id").cast("string"), F.col("text").cast("string"), F.col("content").cast("binary")).mapInArrow(run, PRECOMPUTED)


def frames_of(pre: DataFrame) -> DataFrame:
    """frames(clip_id, frame_idx, t, f0) of precomputed clips."""
    return pre.select("clip_id", F.posexplode(F.arrays_zip("times", "f0")).alias("frame_idx", "x")).select("clip_id", "frame_idx", F.col("x.times").alias("t"), F.col("x.f0").alias("f0"))


def windows_of(pre: DataFrame) -> DataFrame:
    """windows(clip_id, tbu_idx, target, t0, t1) of precomputed clips."""
    return pre.select("clip_id", F.posexplode(F.arrays_zip("targets", "t0", "t1")).alias("tbu_idx", "x")).select("clip_id", "tbu_idx", F.col("x.targets").alias("target"), F.col("x.t0").alias("t0"), F.col("x.t1").alias("t1"))


UNITS = "clip_id string, tbu_idx int, target string, st double, t_mid double"


def units_of(pre: DataFrame, late: float = signal.LATE) -> DataFrame:
    """``signal.unit_semitones`` of precomputed clips, whose frames and windows are in one row already: nothing is shuffled, and a clip's frames are read by place, as their times ascend."""

    def middle(values: np.ndarray) -> float | None:
        s = np.sort(values)
        return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2 if len(s) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            st: list[float | None] = []
            for k in range(b.num_rows):
                times, f0, t0, t1 = (b.column(c)[k].values for c in ("times", "f0", "t0", "t1"))
                live = f0.is_valid().to_numpy(zero_copy_only=False)
                t, y = (c.to_numpy(zero_copy_only=False)[live] for c in (times, f0))
                lo, hi = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in (t0, t1))
                first, tail, end = (np.searchsorted(t, x, "left").tolist() for x in (lo, lo + late * (hi - lo), hi))
                for i in range(len(lo)):
                    part = y[tail[i] : end[i]] if end[i] > tail[i] else y[first[i] : end[i]]
                    known = t0[i].is_valid and t1[i].is_valid and len(part)
                    st.append(12 * float(np.log2(max(middle(part), 1e-6) / 100)) if known else None)
            sizes = [len(b.column("targets")[k].values) for k in range(b.num_rows)]
            flat = [b.column(c).flatten() for c in ("targets", "t0", "t1")]
            mid = pc.divide(pc.add(flat[1], flat[2]), 2.0)
            columns = [pa.array(np.repeat(np.arange(b.num_rows), sizes)), pa.array(np.concatenate([np.arange(n) for n in sizes] or [[]]), pa.int32()), flat[0], pa.array(st, pa.float64()), mid]
            yield pa.RecordBatch.from_arrays([b.column("clip_id").take(columns[0]), *columns[1:]], [c.split()[0] for c in UNITS.split(", ")])

    return pre.select("clip_id", "targets", "times", "f0", "t0", "t1").mapInArrow(run, UNITS)


def clips(spark, folder: str, pattern: str = "*.wav") -> DataFrame:
    """clip_id (file name without its ending) and content of the audio files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("clip_id"), "content")
