"""Audio in NumPy: log-mel features, tone power, levels. Used inside Arrow functions, one stretch of sound at a time."""

from __future__ import annotations

import functools

import numpy as np

from .constants import SAMPLE_RATE

# Fixed values of the feature pipeline.
SCALE = 32_768.0
FRAME = 400
SHIFT = 160
FFT = 512
BINS = 80
LOW_HZ = 20.0
PRE_EMPHASIS = 0.97
ENERGY_FLOOR = 1.1920928955078125e-07


@functools.cache
def mel_weights(bins: int = BINS) -> np.ndarray:
    """FFT bins x mel bins: triangles of equal width on the mel scale, from 20 Hz to half the sample rate."""
    mel = lambda hz: 1127.0 * np.log1p(np.asarray(hz) / 700.0)
    edges = np.linspace(mel(LOW_HZ), mel(SAMPLE_RATE / 2), bins + 2)
    at = mel(np.arange(FFT // 2 + 1) * (SAMPLE_RATE / FFT))[:, None]
    left, middle, right = edges[:-2], edges[1:-1], edges[2:]
    rise, fall = (at - left) / (middle - left), (right - at) / (right - middle)
    return np.maximum(0.0, np.minimum(rise, fall)) * ((at > left) & (at < right))


def fbank(samples: np.ndarray, mean_normalise: bool = True) -> np.ndarray:
    """Frames x 80 log mel energies of whole 25 ms frames every 10 ms, each bin less its mean; no rows if too short."""
    x = np.asarray(samples, dtype=np.float64) * SCALE
    if len(x) < FRAME:
        return np.zeros((0, BINS), dtype=np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::SHIFT]
    frames = frames - frames.mean(axis=1, keepdims=True)
    before = np.concatenate((frames[:, :1], frames[:, :-1]), axis=1)
    frames = (frames - PRE_EMPHASIS * before) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(FRAME) / (FRAME - 1)))
    power = np.abs(np.fft.rfft(frames, FFT, axis=1)) ** 2
    out = np.log(np.maximum(power @ mel_weights(), ENERGY_FLOOR))
    return (out - out.mean(axis=0) if mean_normalise else out).astype(np.float32)


def rms(samples: np.ndarray) -> float:
    x = np.asarray(samples, dtype=np.float64)
    return float(np.sqrt((x * x).mean())) if len(x) else 0.0


def tone_power(frames: np.ndarray, hz: float) -> np.ndarray:
    """Power of each row at the Fourier bin nearest to ``hz``, over the squared length: what Goertzel's filter gives."""
    n = frames.shape[1]
    turn = np.exp(-2j * np.pi * np.round(n * hz / SAMPLE_RATE) * np.arange(n) / n)
    return np.abs(frames @ turn) ** 2 / (n * n)


def to_16k_mono(samples: np.ndarray, rate: int) -> np.ndarray:
    """Channels averaged, resampled by linear interpolation."""
    x = np.asarray(samples, dtype=np.float64)
    x = x.mean(axis=1) if x.ndim == 2 else x
    if rate != SAMPLE_RATE and len(x):
        n = int(np.floor(len(x) * SAMPLE_RATE / rate + 0.5))
        x = np.interp(np.arange(n) * rate / SAMPLE_RATE, np.arange(len(x)), x)
    return x.astype(np.float32)
