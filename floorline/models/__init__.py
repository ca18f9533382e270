"""Neural stages as plug-ins: what hears speakers in a window, and what turns a stretch of voice into a vector."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import numpy as np

from ..functions.audio import BINS, tone_power
from ..functions.constants import CLASSES, SAMPLE_RATE


class Segmenter(Protocol):
    def __call__(self, samples: np.ndarray) -> np.ndarray:
        """Frames x 7 scores of a window."""


class Embedder(Protocol):
    def __call__(self, features: np.ndarray) -> np.ndarray:
        """A vector for frames x 80 features."""


# Fixed values of the deterministic stand-ins: two tones a voice, heard in frames of 20 ms.
TONES = {"A": (200, 250), "B": (2000, 2200), "C": (800, 900)}
FRAME = 320
EDGE_MS = 1000
TONE_POWER = 0.00002


class ToneSegmenter:
    """Hears the test voices by their tones, and nothing in the first and last second of a window."""

    def __call__(self, samples: np.ndarray) -> np.ndarray:
        n = len(samples) // FRAME
        frames = np.asarray(samples[: n * FRAME], dtype=np.float64).reshape(n, FRAME)
        heard = [np.any([tone_power(frames, hz) > TONE_POWER for hz in TONES[v]], axis=0) for v in "ABC"] if n else [np.zeros(0, bool)] * 3
        cls = np.select([heard[0] & heard[1], heard[0], heard[1], heard[2]], [4, 1, 2, 3], 0)
        at = np.arange(n) * FRAME * 1000 / SAMPLE_RATE
        cls[(at < EDGE_MS) | (at >= len(samples) * 1000 / SAMPLE_RATE - EDGE_MS)] = 0
        out = np.full((n, CLASSES), -10.0, dtype=np.float32)
        out[np.arange(n), cls] = 10.0
        return out


class SpreadEmbedder:
    """Spread of each feature over time, less the middle one of all: the floor that leakage gives every bin."""

    def __call__(self, features: np.ndarray) -> np.ndarray:
        spread = np.asarray(features, dtype=np.float64).std(axis=0)
        return spread - np.sort(spread)[BINS // 2]


class OnnxModel:
    """A network from a file, loaded once in each worker. The file isn't part of this repository."""

    _sessions: dict[str, object] = {}

    def __init__(self, path: str, sha256: str | None = None):
        self.path, self.sha256 = path, sha256

    def _session(self):
        if self.path not in self._sessions:
            verified(self.path, self.sha256)
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            self._sessions[self.path] = onnxruntime.InferenceSession(self.path, options, providers=["CPUExecutionProvider"])
        return self._sessions[self.path]

    def _run(self, x: np.ndarray) -> np.ndarray:
        session = self._session()
        return session.run(None, {session.get_inputs()[0].name: x.astype(np.float32)})[0]


class OnnxSegmenter(OnnxModel):
    def __call__(self, samples: np.ndarray) -> np.ndarray:
        return self._run(np.asarray(samples)[None, None, :])[0]


class OnnxEmbedder(OnnxModel):
    def __call__(self, features: np.ndarray) -> np.ndarray:
        return self._run(np.asarray(features)[None])[0]


def verified(path: str, sha256: str | None, size: int | None = None) -> str:
    """``path`` if the file has the given digest and size; else an error."""
    body = Path(path).read_bytes()
    if size is not None and len(body) != size:
        raise ValueError(f"{path} has {len(body)} bytes, not {size}")
    if sha256 is not None and hashlib.sha256(body).hexdigest() != sha256:
        raise ValueError(f"{path} isn't the file that was meant")
    return path


@dataclass(frozen=True)
class Models:
    segment: Segmenter
    embed: Embedder


def models(name: str = "tones", folder: str | None = None) -> Models:
    """Models by name: ``tones`` (the stand-ins), or ``int8``, ``fp32``, ``campplus`` from files in ``folder``."""
    if name == "tones":
        return Models(ToneSegmenter(), SpreadEmbedder())
    if name not in ("int8", "fp32", "campplus") or folder is None:
        raise ValueError(f"no models {name!r}" if folder else "network models need a folder")
    kind = "fp32" if name == "campplus" else name
    return Models(OnnxSegmenter(f"{folder}/segmentation-{kind}.onnx"), OnnxEmbedder(f"{folder}/embedding-{name}.onnx"))
