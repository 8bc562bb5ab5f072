"""Rotation and 1- to 8-bit quantization of residuals with error bounds, on numpy batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPSILON = 1.9
#: Where the search begins, as a share of its end, by bits.
_TIGHT = {1: 0.15, 2: 0.2, 3: 0.52, 4: 0.59, 5: 0.71, 6: 0.75, 7: 0.77}
_EXTRA, _EPS = 10, 1e-5
METRICS = ("l2", "ip")


def padded_dims(dims: int) -> int:
    return -(-dims // 64) * 64


@dataclass(frozen=True)
class Descriptor:
    """How a vector column is quantized. ``bit_width`` counts the sign bit; ``payload`` is 4 sign sequences or a matrix."""

    dims: int
    metric: str = "l2"
    bit_width: int = 1
    rotator: str = "fht"
    payload: bytes = b""

    def __post_init__(self) -> None:
        if self.dims <= 0 or self.metric not in METRICS or not 1 <= self.bit_width <= 8 or self.rotator not in ("fht", "matrix"):
            raise ValueError(f"no such quantization: {self}")
        want = padded_dims(self.dims) // 2 if self.rotator == "fht" else 4 * self.dims * padded_dims(self.dims)
        if self.payload and len(self.payload) != want:
            raise ValueError(f"the payload must have {want} bytes")

    @property
    def padded(self) -> int:
        return padded_dims(self.dims)

    @staticmethod
    def fht(dims: int, metric: str = "l2", bit_width: int = 1, seed: int = 0) -> Descriptor:
        return Descriptor(dims, metric, bit_width, "fht", np.random.default_rng(seed).bytes(padded_dims(dims) // 2))

    @staticmethod
    def matrix(dims: int, metric: str = "l2", bit_width: int = 1, seed: int = 0) -> Descriptor:
        full = np.linalg.qr(np.random.default_rng(seed).standard_normal((padded_dims(dims),) * 2))[0]
        return Descriptor(dims, metric, bit_width, "matrix", full[:dims].astype("<f4").tobytes())

    def rotate(self, x: np.ndarray) -> np.ndarray:
        if self.rotator == "matrix":
            return np.asarray(x, np.float64) @ np.frombuffer(self.payload, "<f4").reshape(self.dims, self.padded)
        return rotate_fht_kac(x, self.padded, self.payload)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised fast Hadamard transform of each row; the length is a power of two."""
    n, size, span = len(x), x.shape[1], 1
    while span < size:
        y = x.reshape(n, size // (2 * span), 2, span)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, size)
        span *= 2
    return x


def rotate_fht_kac(x: np.ndarray, padded: int, flips: bytes) -> np.ndarray:
    """Four rounds of sign flips (lowest bit first), Hadamard and rescaling; where the dimension is no power of two they alternate between its two ends, each with a step of Kac's walk."""
    x = np.asarray(x, np.float64)
    out = np.zeros((len(x), padded))
    out[:, : x.shape[1]] = x
    signs = 1.0 - 2.0 * np.unpackbits(np.frombuffer(flips, np.uint8), bitorder="little").reshape(4, padded)
    part = 1 << (x.shape[1].bit_length() - 1)
    whole = part == padded
    for k in range(4):
        out = out * signs[k]
        a = 0 if whole or k % 2 == 0 else padded - part
        out[:, a : a + part] = hadamard(out[:, a : a + part]) / np.sqrt(part)
        if not whole:
            left, right = out[:, : padded // 2], out[:, padded // 2 :]
            out = np.concatenate([left + right, left - right], axis=1)
    return out if whole else out * 0.25


def _factors(residual: np.ndarray, centre: np.ndarray, code: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """f_add, f_rescale and f_error of a centred code; a vector on its centre has 0 (or 1), 0 and 0."""
    size = (residual**2).sum(axis=1)
    along = (residual * code).sum(axis=1)
    along = np.where(along == 0, np.inf, along)
    across = (centre * code).sum(axis=1)
    bracket = np.maximum((size * (code**2).sum(axis=1) / along**2 - 1) / (code.shape[1] - 1), 0)
    error = np.sqrt(size) * EPSILON * np.sqrt(bracket)
    if metric == "l2":
        return size + 2 * size * across / along, -2 * size / along, 2 * error
    return 1 - (residual * centre).sum(axis=1) + size * across / along, -size / along, error


def quantize_one_bit(x: np.ndarray, centre: np.ndarray, metric: str = "l2") -> dict[str, np.ndarray]:
    """Sign bits of the residuals (highest bit first) and their three factors."""
    residual = np.asarray(x, np.float64) - centre
    bits = residual > 0
    add, rescale, error = _factors(residual, np.broadcast_to(centre, residual.shape), bits - 0.5, metric)
    return {"code": np.packbits(bits, axis=1), "f_add": add, "f_rescale": rescale, "f_error": error}


def best_rescales(o: np.ndarray, ex_bits: int) -> np.ndarray:
    """For each row of magnitudes (all positive), the scale at which they, rounded, point most nearly along it.

    Every scale at which one code steps up is an event; the running sums over the events in order give the cosine
    after each.
    """
    top, dims = (1 << ex_bits) - 1, o.shape[1]
    out = np.empty(len(o))
    for first in range(0, len(o), max(1, (1 << 21) // (dims * top))):  # bounds the table of events
        x = o[first : first + max(1, (1 << 21) // (dims * top))]
        end = (top + _EXTRA) / x.max(axis=1, keepdims=True)
        now = (end * _TIGHT[ex_bits] * x + _EPS).astype(np.int64)
        steps = np.arange(1, max(1, int(np.ceil(np.minimum(top, end * x) - now).max())) + 1)
        code = now[:, :, None] + steps
        at = code / x[:, :, None]
        keep = (steps == 1) | ((code <= top) & (at < end[:, :, None]))
        at, code = np.where(keep, at, np.inf).reshape(len(x), -1), code.reshape(len(x), -1)
        order = np.argsort(at, axis=1, kind="stable")
        at = np.take_along_axis(at, order, axis=1)
        below = np.cumsum(2.0 * np.take_along_axis(code, order, axis=1), axis=1) + dims * 0.25 + (now * now + now).sum(axis=1, keepdims=True)
        above = np.cumsum(np.take_along_axis(x, order // len(steps), axis=1), axis=1) + ((now + 0.5) * x).sum(axis=1, keepdims=True)
        best = np.where(np.isfinite(at), above / np.sqrt(below), -np.inf).argmax(axis=1)
        out[first : first + len(x)] = at[np.arange(len(x)), best]
    return out


def calibrate(dims: int, ex_bits: int, seed: int = 0, samples: int = 100) -> float:
    """The mean best scale of random directions, to share among vectors."""
    x = np.abs(np.random.default_rng(seed).standard_normal((samples, dims)))
    return float(np.mean(best_rescales(x / np.linalg.norm(x, axis=1, keepdims=True), ex_bits)))


def quantize_ex(x: np.ndarray, centre: np.ndarray, ex_bits: int, metric: str = "l2", scale: float | None = None) -> dict[str, np.ndarray]:
    """Magnitude codes of ``ex_bits`` bits and their two factors; ``scale`` skips the search for each vector."""
    residual = np.asarray(x, np.float64) - centre
    centre = np.broadcast_to(centre, residual.shape)
    size = np.sqrt((residual**2).sum(axis=1))
    codes, add, rescale = np.zeros(residual.shape, np.int64), np.zeros(len(residual)), np.zeros(len(residual))
    top, some = (1 << ex_bits) - 1, size > 0
    r = residual[some]
    if len(r):
        o = np.abs(r) / size[some, None]
        t = best_rescales(np.maximum(o, 1e-300), ex_bits)[:, None] if scale is None else scale
        c = np.minimum((t * o + _EPS).astype(np.int64), top)
        total = ((c + 0.5) * o).sum(axis=1)
        c = np.where(r < 0, ~c & top, c)
        full = c + np.where(r >= 0, top + 1, 0) - (top + 0.5)
        codes[some] = c
        add[some] = _factors(r, centre[some], full, metric)[0]
        rescale[some] = (-2 if metric == "l2" else -1) * size[some] / total
    return {"ex_code": codes.astype(np.uint8), "f_add_ex": add, "f_rescale_ex": rescale}


def _query(q: np.ndarray, centre: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    apart = ((q - centre) ** 2).sum(axis=-1)
    return (apart if metric == "l2" else -(q * centre).sum(axis=-1)), np.sqrt(apart)


def estimate(code: dict[str, np.ndarray], q: np.ndarray, centre: np.ndarray, metric: str = "l2") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimated squared distance (or negated inner product) of every code to ``q``, with lower and upper bound."""
    bits = np.unpackbits(code["code"], axis=1)[:, : len(q)]
    add, error = _query(q, centre, metric)
    value = code["f_add"] + add + code["f_rescale"] * (bits @ q - 0.5 * q.sum())
    bound = code["f_error"] * error
    return value, value - bound, value + bound


def estimate_boosted(code: dict[str, np.ndarray], ex: dict[str, np.ndarray], ex_bits: int, q: np.ndarray, centre: np.ndarray, metric: str = "l2") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with the magnitude bits; the bound shrinks by ``2 ** ex_bits``."""
    bits = np.unpackbits(code["code"], axis=1)[:, : len(q)]
    add, error = _query(q, centre, metric)
    scale = 1 << ex_bits
    value = ex["f_add_ex"] + add + ex["f_rescale_ex"] * (scale * (bits @ q) + ex["ex_code"] @ q - (2 * scale - 1) / 2 * q.sum())
    bound = code["f_error"] * error / scale
    return value, value - bound, value + bound
