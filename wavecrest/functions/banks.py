"""Seeded banks of weights, drawn on the driver and shipped as constants.

Spark's own rand() depends on partitions, so no bank uses it. Window banks (12
Gaussian windows, 12 two-layer nets, 16 and 2x4 kernels of 9 taps) and battery banks
are our own draws in the documented shapes. The first three of the four-space banks
are RandomState draws by the documented seeds and thus regenerate exactly.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WINDOW_SEED = 20240


@lru_cache(maxsize=4)
def window_banks(seed: int = WINDOW_SEED) -> dict[str, np.ndarray]:
    rng = np.random.RandomState(seed)
    hydra = rng.randn(2, 4, 9)
    hydra -= hydra.mean(-1, keepdims=True)
    hydra /= np.abs(hydra).sum(-1, keepdims=True)
    return {
        "trf_mu": rng.uniform(0, 1, 12),
        "trf_sig": np.exp(rng.uniform(np.log(0.02), np.log(0.5), 12)),
        "srf_W": rng.randn(12, 6, 12) / np.sqrt(12),
        "srf_b": rng.randn(12, 6),
        "srf_u": rng.randn(12, 6) / np.sqrt(6),
        "crf_w": rng.randn(16, 9),
        "hydra_w": hydra,
    }


def load_banks(banks: dict[str, np.ndarray] | str | None = None) -> dict[str, np.ndarray]:
    """Window banks: the seeded ones, those given, or those of an npz file; shapes are checked."""
    if banks is None:
        return window_banks()
    given = dict(np.load(banks)) if isinstance(banks, str) else dict(banks)
    for name, known in window_banks().items():
        if name not in given or np.size(given[name]) != known.size:
            raise ValueError(f"bank {name} must have the shape {known.shape}")
    return {name: np.asarray(given[name], float).reshape(known.shape) for name, known in window_banks().items()}


#: Battery banks: name -> (seed, outputs); matrices have a row for each embedding column.
MATRICES = {"W501": 16, "W801": 16, "W701": 16, "W1901": 16, "W201": 24, "W4011": 16, "W6041": 12, "W6042": 12, "W321": 8, "W322": 8, "W7011": 24, "W951": 16, "W5141": 20}
LANDMARKS = {"A209": 8, "A6091": 12}
PHASES = {"b202": 24, "b4012": 16}


@lru_cache(maxsize=8)
def battery_banks(dims: int) -> dict[str, np.ndarray]:
    draw = lambda name: np.random.RandomState(int(name[1:]))
    out = {k: draw(k).randn(dims, n).astype(np.float32).astype(float) for k, n in MATRICES.items()}
    out |= {k: draw(k).randn(n, dims).astype(np.float32).astype(float) for k, n in LANDMARKS.items()}
    return out | {k: draw(k).rand(n).astype(np.float32).astype(float) * 2 * np.pi for k, n in PHASES.items()}


def gaussian_windows(length: int, count: int = 200, seed: int = 42) -> np.ndarray:
    """(count, length) normalised windows of random centre and width."""
    rng = np.random.RandomState(seed)
    centre = rng.uniform(0, length, count)
    width = np.exp(rng.uniform(np.log(max(1, 0.01 * length)), np.log(max(2, length / 2)), count))
    w = np.exp(-((np.arange(length) - centre[:, None]) ** 2) / (2 * width[:, None] ** 2))
    return w / (w.sum(1, keepdims=True) + 1e-12)


def fourier_projections(length: int, projections: int = 5, dims: int = 256, seed: int = 142) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.RandomState(seed)
    return [(rng.randn(length, dims) / np.sqrt(length), rng.uniform(0, 2 * np.pi, dims)) for _ in range(projections)]


def statistic_nets(count: int = 200, hidden: int = 8, inputs: int = 12, seed: int = 242) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.RandomState(seed)
    return rng.randn(count, hidden, inputs) / np.sqrt(inputs), rng.randn(count, hidden), rng.randn(count, hidden) / np.sqrt(hidden)


def random_kernels(length: int, count: int = 500, size: int = 9, seed: int = 342) -> tuple[np.ndarray, np.ndarray]:
    """Kernel weights and their dilations."""
    rng = np.random.RandomState(seed)
    return rng.randn(count, size), rng.randint(1, max(2, length // 2), count)
