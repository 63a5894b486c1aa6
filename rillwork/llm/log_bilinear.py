"""A log-bilinear model of units, trained by noise-contrastive estimation on numpy batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Dimensions of the representations, units of context, tokens of a step, noise units of a step, learning rate.
WIDTH, CONTEXT, BATCH, NOISE, RATE = 16, 5, 512, 32, 0.1
#: Tokens whose unit probabilities are held at once.
SCORED = 2048


@dataclass
class Model:
    """read: a representation of each unit as context, the last one the empty place before a text; write, bias: of each
    unit as the next one; mix: weights of the context's places, nearest first."""

    read: np.ndarray
    write: np.ndarray
    bias: np.ndarray
    mix: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.read, self.write, self.bias[:, None], self.mix]

    def rows(self) -> np.ndarray:
        """All parameters as rows of WIDTH (the biases padded)."""
        return np.concatenate([np.pad(p, ((0, 0), (0, self.mix.shape[1] - p.shape[1]))) for p in self.parts()])

    @staticmethod
    def of_rows(rows: np.ndarray, units: int) -> Model:
        read, write, bias, mix = np.split(rows.astype(np.float32), np.cumsum([units + 1, units, units]))
        return Model(read, write, bias[:, 0].copy(), mix)


def initial(share: np.ndarray) -> Model:
    """Small random representations (fixed seed) and the logarithms of the units' shares as biases."""
    rng, units = np.random.default_rng(13), len(share)
    small = (rng.standard_normal((2 * units + 1, WIDTH)) * 0.1).astype(np.float32)
    small[units] = 0
    return Model(small[: units + 1], small[units + 1 :], np.log(share).astype(np.float32), np.full((CONTEXT, WIDTH), 0.5, np.float32))


def laid_out(units: np.ndarray, at: np.ndarray, empty: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of texts that begin at `at`, each text behind CONTEXT empty places; and where each unit went."""
    place = np.arange(len(units)) + CONTEXT * np.repeat(np.arange(1, len(at)), np.diff(at))
    out = np.full(len(units) + CONTEXT * (len(at) - 1), empty, np.int64)
    out[place] = units
    return out, place


def predicted(model: Model, known: np.ndarray) -> np.ndarray:
    """The representation that each place's context predicts; known: read vectors, CONTEXT of them ahead of the first."""
    n = len(known) - CONTEXT
    out = known[CONTEXT - 1 : CONTEXT - 1 + n] * model.mix[0]
    for i in range(1, CONTEXT):
        out += known[CONTEXT - 1 - i : CONTEXT - 1 - i + n] * model.mix[i]
    return out


def log_probs(model: Model, line: np.ndarray) -> np.ndarray:
    """Natural log-probability, normalised over all units, of each unit of `line` from place CONTEXT on (0 at empty ones)."""
    units = len(model.bias)
    out = np.zeros(max(len(line) - CONTEXT, 0))
    weights = np.ascontiguousarray(model.write.T)
    for lo in range(0, len(out), SCORED):
        piece = line[lo : lo + SCORED + CONTEXT]
        target = piece[CONTEXT:]
        scores = predicted(model, model.read[piece]) @ weights + model.bias
        scores -= scores.max(axis=1, keepdims=True)
        own = scores[np.arange(len(target)), np.minimum(target, units - 1)].astype(float)
        np.exp(scores, out=scores)
        out[lo : lo + SCORED] = np.where(target < units, own - np.log(scores.sum(axis=1)), 0)
    return out


class Trainer:
    """Steps of noise-contrastive estimation with AdaGrad. A step tells its tokens from NOISE units drawn by their
    shares, the same for all tokens of the step, so scores of all pairs are one matrix product."""

    def __init__(self, model: Model, share: np.ndarray, seed: int):
        self.model = Model(*(p.copy() for p in (model.read, model.write, model.bias, model.mix)))
        self.squares = [np.full(p.shape, 0.1, np.float32) for p in (model.read, model.write, model.bias, model.mix)]
        self.rng, self.cumulative = np.random.default_rng(seed), np.cumsum(share)
        self.noise_log = (np.log(share) + np.log(NOISE)).astype(np.float32)
        self.tokens, self.left = 0, np.zeros(0, np.int64)

    def learn(self, line: np.ndarray) -> None:
        """Steps over a laid-out line; what doesn't fill a step waits for the next line."""
        line = np.concatenate([self.left, line])
        lo = 0
        while lo + CONTEXT + BATCH <= len(line):
            self._step(line[lo : lo + CONTEXT + BATCH])
            lo += BATCH
        self.left = line[lo:]

    def finish(self) -> Model:
        if len(self.left) > CONTEXT:
            self._step(self.left)
        self.left = self.left[:0]
        return self.model

    def _step(self, piece: np.ndarray) -> None:
        m, units, target = self.model, len(self.model.bias), piece[CONTEXT:]
        real = target < units
        self.tokens += int(real.sum())
        target = np.where(real, target, 0)
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]), units - 1)
        known = m.read[piece]
        context, own, others = predicted(m, known), m.write[target], m.write[noise]
        told = np.einsum("ij,ij->i", context, own) + m.bias[target] - self.noise_log[target]
        off = context @ others.T + (m.bias[noise] - self.noise_log[noise])
        pull = (_logistic(told) - 1) * real
        push = _logistic(off) * real[:, None]
        d_context = pull[:, None] * own + push @ others
        d_write = _scatter(np.concatenate([target, noise]), np.concatenate([pull[:, None] * context, push.T @ context]), units)
        d_bias = np.bincount(target, pull, units) + np.bincount(noise, push.sum(axis=0), units)
        n = len(d_context)
        d_known, d_mix = np.zeros_like(known), np.empty_like(m.mix)
        for i in range(CONTEXT):
            d_known[CONTEXT - 1 - i : CONTEXT - 1 - i + n] += d_context * m.mix[i]
            d_mix[i] = np.einsum("ij,ij->j", d_context, known[CONTEXT - 1 - i : CONTEXT - 1 - i + n])
        d_read = _scatter(piece, d_known, units + 1)
        d_read[units] = 0
        scale = BATCH**-0.5
        for p, g, s in zip((m.read, m.write, m.bias, m.mix), (d_read, d_write, d_bias, d_mix), self.squares, strict=True):
            g = (g * scale).astype(np.float32)
            s += g * g
            p -= RATE * g / np.sqrt(s)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.minimum(-x, 60)))


def _scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their place."""
    width = rows.shape[1]
    return np.bincount((at[:, None] * width + np.arange(width)).ravel(), rows.ravel(), n * width).reshape(n, width)
