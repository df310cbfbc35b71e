"""Small dense networks for imputation: fitted on a bounded sample on the driver, applied to batches wherever rows are."""

from __future__ import annotations

import numpy as np

#: Passes over the sample, learning rate, hint rate, corruption and weights of the losses.
GAIN_PASSES, MIDA_PASSES, HIVAE_PASSES, RATE = 300, 400, 400, 1e-3
HINT, CORRUPTED, GAIN_FIT_WEIGHT, HIVAE_KL_WEIGHT = 0.9, 0.2, 2.0, 0.01
_EPS = 1e-8


class Net:
    """Linear layers with ReLU between them, and the state of Adam for each parameter."""

    def __init__(self, sizes: list[int], rng: np.random.Generator):
        self.params = []
        for a, b in zip(sizes, sizes[1:]):
            self.params += [rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)]
        self.first = [np.zeros_like(p) for p in self.params]
        self.second = [np.zeros_like(p) for p in self.params]
        self.t = 0

    def __call__(self, x: np.ndarray, seen: list | None = None) -> np.ndarray:
        layers = len(self.params) // 2
        for k in range(layers):
            if seen is not None:
                seen.append(x)
            x = x @ self.params[2 * k] + self.params[2 * k + 1]
            if k < layers - 1:
                x = np.maximum(x, 0)
        return x

    def back(self, seen: list, grad: np.ndarray) -> tuple[list, np.ndarray]:
        """Gradients of the parameters and of the input, from the inputs that each layer saw."""
        grads: list = [None] * len(self.params)
        for k in reversed(range(len(seen))):
            grads[2 * k], grads[2 * k + 1] = seen[k].T @ grad, grad.sum(0)
            grad = grad @ self.params[2 * k].T
            if k:
                grad = grad * (seen[k] > 0)
        return grads, grad

    def step(self, grads: list) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + _EPS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_gain(x: np.ndarray, seen: np.ndarray, seed: int):
    """Adversarial: a generator fills cells, a discriminator with a partial hint tells filled from observed ones.

    ``x`` is standardised with 0 for missing cells, ``seen`` the mask of observed ones. Returns the function that fills.
    """
    rng = np.random.default_rng(seed)
    n, d = x.shape
    h = max(2 * d, 32)
    maker, judge = Net([2 * d, h, h, d], rng), Net([2 * d, h, h, d], rng)
    cells, gone = n * d, 1 - seen
    for _ in range(GAIN_PASSES):
        hint = (rng.random((n, d)) < HINT) * seen
        at: list = []
        made = maker(np.hstack([seen * x + gone * rng.normal(size=(n, d)) * 0.01, seen]), at)
        whole = np.hstack([seen * x + gone * made, hint])
        trace: list = []
        p = _sigmoid(judge(whole, trace))
        judge.step(judge.back(trace, (p - seen) / cells)[0])  # cross entropy through the sigmoid
        trace = []
        p = _sigmoid(judge(whole, trace))
        fooled = judge.back(trace, -gone * (1 - p) / cells)[1][:, :d] * gone
        fit = GAIN_FIT_WEIGHT * 2 * seen * (made - x) / cells / (seen.mean() + _EPS)
        maker.step(maker.back(at, fooled + fit)[0])
    return lambda x, seen: maker(np.hstack([seen * x, seen]))


def fit_mida(x: np.ndarray, seen: np.ndarray, seed: int):
    """Denoising autoencoder: a part of the observed cells is hidden in each pass and has to be restored."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    h = max(3 * d, 64)
    net = Net([d, h, h // 2, h, d], rng)
    for _ in range(MIDA_PASSES):
        at: list = []
        out = net(x * seen * (rng.random((n, d)) > CORRUPTED), at)
        net.step(net.back(at, 2 * seen * (out - x) / (n * d))[0])
    return lambda x, seen: net(x * seen)


def fit_hivae(x: np.ndarray, seen: np.ndarray, seed: int):
    """Variational autoencoder on observed cells; a row is filled from the mean of its posterior."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    latent, h = max(d // 2, 2), max(2 * d, 32)
    enc, dec = Net([d, h, 2 * latent], rng), Net([latent, h, d], rng)
    for _ in range(HIVAE_PASSES):
        at: list = []
        head = enc(x * seen, at)
        mu, logvar = head[:, :latent], np.clip(head[:, latent:], -20, 20)
        noise, spread = rng.normal(size=mu.shape), np.exp(0.5 * logvar)
        to: list = []
        out = dec(mu + spread * noise, to)
        grads, back = dec.back(to, 2 * seen * (out - x) / (n * d))
        dec.step(grads)
        weight = HIVAE_KL_WEIGHT / mu.size
        enc.step(enc.back(at, np.hstack([back + weight * mu, back * noise * spread / 2 + weight * (np.exp(logvar) - 1) / 2]))[0])
    return lambda x, seen: dec(enc(x * seen)[:, :latent])
