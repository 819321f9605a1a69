"""A gated recurrent language model in numpy with a class-factored softmax.

``P(word | state) = P(class | state) * P(word | class, state)``.  Frequent words
stand in classes of equal size with a softmax each; every other word belongs to
one of the remaining classes, within which its share is its smoothed count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FIELDS = ("inputs", "recurrent", "gate_bias", "class_out", "class_bias", "word_out", "word_bias")


@dataclass
class GatedNet:
    """Weights.  ``inputs`` holds one row for each input symbol: its part of the three gates."""

    inputs: np.ndarray
    recurrent: np.ndarray
    gate_bias: np.ndarray
    class_out: np.ndarray
    class_bias: np.ndarray
    word_out: np.ndarray
    word_bias: np.ndarray

    @classmethod
    def create(cls, symbols: int, hidden: int, class_share: np.ndarray, word_share: np.ndarray, seed: int = 11) -> GatedNet:
        """Output biases give the plain class and word shares before any training."""
        rng = np.random.default_rng(seed)
        frequent, width = word_share.shape
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return cls(
            draw(symbols, 3 * hidden), draw(hidden, 3 * hidden), np.zeros(3 * hidden, np.float32),
            np.zeros((hidden, len(class_share)), np.float32), np.log(class_share).astype(np.float32),
            np.zeros((frequent, hidden, width), np.float32), np.log(word_share).astype(np.float32),
        )

    @property
    def hidden(self) -> int:
        return self.recurrent.shape[0]

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f).ravel() for f in FIELDS])

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Parts of a vector in the shapes of the weights."""
        out, at = {}, 0
        for f in FIELDS:
            shape = getattr(self, f).shape
            n = int(np.prod(shape))
            out[f] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def load(self, flat: np.ndarray) -> GatedNet:
        return GatedNet(**{f: v.copy() for f, v in self.views(flat.astype(np.float32)).items()})

    def _gates(self) -> tuple[np.ndarray, np.ndarray]:
        """(inputs with bias, recurrent weights), gate by gate; those of the sigmoids are negated."""
        h = self.hidden
        table = (self.inputs + self.gate_bias).reshape(-1, 3, h).transpose(1, 0, 2).copy()
        pull = self.recurrent.reshape(h, 3, h).transpose(1, 0, 2).copy()
        np.negative(table[:2], out=table[:2])
        np.negative(pull[:2], out=pull[:2])
        return table, pull

    def run(self, symbols: np.ndarray, state: np.ndarray, keep: bool = False):
        """(states after each step of a (time, texts) window whose first state is ``state``, trace).

        With ``keep`` the trace is (states before each step, the three gates, pulls of the last).
        """
        h = self.hidden
        steps, n = symbols.shape
        table, pull = self._gates()
        gates = np.empty((3, steps, n, h), table.dtype)
        for g in range(3):
            np.take(table[g], symbols, axis=0, out=gates[g], mode="clip")
        states = np.empty((steps + 1, n, h), table.dtype)
        states[0] = state
        pulls = np.empty((steps, n, h), table.dtype) if keep else None
        pulled, tmp = np.empty((3, n, h), table.dtype), np.empty((n, h), table.dtype)
        with np.errstate(over="ignore"):
            for t in range(steps):
                np.matmul(states[t], pull, out=pulled)
                zr, new = gates[:2, t], gates[2, t]
                zr += pulled[:2]
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                if keep:
                    pulls[t] = pulled[2]
                np.multiply(gates[1, t], pulled[2], out=tmp)
                new += tmp
                np.tanh(new, out=new)
                np.subtract(states[t], new, out=tmp)
                tmp *= gates[0, t]
                np.add(new, tmp, out=states[t + 1])
        return states[1:], (states, gates, pulls) if keep else None

    def log_probs(self, states: np.ndarray, classes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural log probability of each target: its class, and its word where the class is frequent."""
        out = np.empty(len(states), np.float64)
        for i in range(0, len(states), 4096):
            own = classes[i : i + 4096]
            p = _exp(states[i : i + 4096] @ self.class_out, self.class_bias)
            out[i : i + 4096] = _share(p, own)
        for c, pick, part, cut in self._by_class(states, classes):
            for i in range(0, len(pick), 4096):
                p = _exp(part[i : i + 4096] @ self.word_out[c], self.word_bias[c])
                out[pick[i : i + 4096]] += _share(p, words[pick[i : i + 4096]])
        return out

    def _by_class(self, states: np.ndarray, classes: np.ndarray):
        """(class, places, states, where they stand in the sorted order) of each frequent class that occurs."""
        n = len(self.word_out)
        order = np.argsort(_short(classes), kind="stable")
        cuts = np.searchsorted(classes[order], np.arange(n + 1))
        order = order[: cuts[-1]]
        sorted_states = states[order]
        for c in range(n):
            a, b = cuts[c], cuts[c + 1]
            if a < b:
                yield c, order[a:b], sorted_states[a:b], slice(a, b)

    def gradients(self, symbols, classes, words, mask, state):
        """(loss, gradients, last state) of one window: backpropagation ends at its first step."""
        h = self.hidden
        states, (all_states, gates, pulls) = self.run(symbols, state, keep=True)
        steps, n = symbols.shape
        kind = states.dtype
        live = None if mask.all() else np.flatnonzero(mask)
        flat, target, word = states.reshape(-1, h), classes.ravel(), words.ravel()
        if live is not None:
            flat, target, word = flat[live], target[live], word[live]
        total = max(len(flat), 1)
        vector = np.zeros(sum(getattr(self, f).size for f in FIELDS), kind)
        grad = Gradient(vector, self.views(vector))
        p = _exp(flat @ self.class_out, self.class_bias)
        loss = -float(_share(p, target, 1 / total).sum())
        np.matmul(flat.T, p, out=grad["class_out"])
        grad["class_bias"][...] = np.ones(len(p), kind) @ p
        back = p @ self.class_out.T
        for c, pick, own, _ in self._by_class(flat, target):
            q = _exp(own @ self.word_out[c], self.word_bias[c])
            loss -= float(_share(q, word[pick], 1 / total).sum())
            np.matmul(own.T, q, out=grad["word_out"][c])
            grad["word_bias"][c] = np.ones(len(q), kind) @ q
            back[pick] += q @ self.word_out[c].T
        if live is not None:
            whole = np.zeros((steps * n, h), kind)
            whole[live] = back
            back = whole
        back = back.reshape(steps, n, h)
        z, r, new = gates
        rest = 1 - z
        to_new = rest * (1 - new * new)
        to_z = (all_states[:-1] - new) * z
        to_z *= rest
        to_r = pulls * r
        to_r *= 1 - r
        given = np.empty((3, steps, n, h), kind)
        pulled = np.empty((steps, n, h), kind)
        through = self.recurrent.reshape(h, 3, h).transpose(1, 2, 0).copy()
        carry = np.zeros((n, h), kind)
        part = np.empty((n, h), kind)
        for t in range(steps - 1, -1, -1):
            carry += back[t]
            d_z, d_r, d_new = given[0, t], given[1, t], given[2, t]
            np.multiply(carry, to_new[t], out=d_new)
            np.multiply(carry, to_z[t], out=d_z)
            np.multiply(d_new, to_r[t], out=d_r)
            np.multiply(d_new, r[t], out=pulled[t])
            carry *= z[t]
            for g, d in ((0, d_z), (1, d_r), (2, pulled[t])):
                np.matmul(d, through[g], out=part)
                carry += part
        before = all_states[:-1].reshape(-1, h).T
        order = np.argsort(_short(symbols.ravel()), kind="stable")
        used, first = np.unique(symbols.ravel()[order], return_index=True)
        for g in range(3):
            cut = slice(g * h, (g + 1) * h)
            own = given[g].reshape(-1, h)
            grad["recurrent"][:, cut] = before @ (own if g < 2 else pulled.reshape(-1, h))
            grad["gate_bias"][cut] = np.ones(len(own), kind) @ own
            grad["inputs"][used, cut] = np.add.reduceat(own[order], first)
        return loss / total, grad, states[-1]


class Gradient(dict):
    """Gradients by field, all parts of one vector."""

    def __init__(self, vector: np.ndarray, parts: dict[str, np.ndarray]):
        super().__init__(parts)
        self.vector = vector


def _short(values: np.ndarray) -> np.ndarray:
    """Small integers in the type that sorts fastest."""
    return values.astype(np.uint16) if not len(values) or values.max() < 1 << 16 else values


def _exp(logits: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """exp of logits, each row's shifted by a number of its own where that is needed."""
    logits += bias
    if logits.size and (logits.max() > 60 or logits.min() < -60):
        logits -= logits.max(1, keepdims=True)
    return np.exp(logits, out=logits)


def _share(p: np.ndarray, target: np.ndarray, scale: float | None = None) -> np.ndarray:
    """Log of each row's share of its target; with ``scale`` ``p`` becomes the scaled gradient of minus that."""
    rows = np.arange(len(p))
    total = p @ np.ones(p.shape[1], p.dtype)
    out = np.log(np.maximum(p[rows, target], 1e-37) / total)
    if scale is not None:
        p *= (scale / total)[:, None].astype(p.dtype)
        p[rows, target] -= scale
    return out


class Adam:
    """Adam over all weights as one vector; the weights of ``net`` become views of it."""

    def __init__(self, net: GatedNet, rate: float):
        self.rate, self.step = rate, 0
        self.weights = net.flat()
        for f, view in net.views(self.weights).items():
            setattr(net, f, view)
        self.first, self.second, self.tmp = (np.zeros_like(self.weights) for _ in range(3))

    def apply(self, grad: Gradient) -> None:
        self.step += 1
        g, m, s, tmp = grad.vector, self.first, self.second, self.tmp
        g *= min(1.0, 5.0 / max(float(np.sqrt(g @ g)), 1e-9))
        m *= 0.9
        s *= 0.99
        np.multiply(g, g, out=tmp)
        tmp *= 0.01
        s += tmp
        g *= 0.1
        m += g
        np.multiply(s, 1 / (1 - 0.99**self.step), out=tmp)
        np.sqrt(tmp, out=tmp)
        tmp += 1e-7
        np.divide(m, tmp, out=tmp)
        tmp *= self.rate / (1 - 0.9**self.step)
        self.weights -= tmp


def lockstep(lengths: np.ndarray, limit: int) -> list[np.ndarray]:
    """Texts in groups of ``limit`` at most, longest first, to be run side by side."""
    order = np.argsort(-lengths, kind="stable")
    return [order[i : i + limit] for i in range(0, len(order), limit)]


def window(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, start: int, steps: int, pad: int) -> np.ndarray:
    """(time, texts) symbols ``start .. start + steps`` of each text; ``pad`` past its end."""
    at = start + np.arange(steps)[:, None]
    return np.where(at < lengths, flat[np.minimum(begins + at, len(flat) - 1)], pad)


def stretch_states(net: GatedNet, symbols, bounds, start_symbol: int, stretch: int, steps: int = 32, texts: int = 2048) -> np.ndarray:
    """State before each stretch of each text, by running through the longer texts with the weights as they are."""
    parts = -(-np.diff(bounds) // stretch)
    places = np.cumsum(parts) - parts
    out = np.zeros((int(parts.sum()), net.hidden), np.float32)
    for group in lockstep(parts, texts):
        group = group[parts[group] > 1]
        if not len(group):
            continue
        state = np.zeros((len(group), net.hidden), np.float32)
        for k in range(1, int(parts[group[0]])):
            live = group[: int(np.searchsorted(-parts[group], -k, "left"))]
            state = state[: len(live)]
            for start in range((k - 1) * stretch, k * stretch, steps):
                given = window(symbols, bounds[live], np.diff(bounds)[live], start - 1, min(steps, k * stretch - start), start_symbol)
                if start == 0:
                    given[0] = start_symbol
                state = net.run(given, state)[0][-1]
            out[places[live] + k] = state
    return out


def train(net: GatedNet, symbols, classes, words, bounds, start_symbol: int, steps: int = 16, texts: int = 256, rate: float = 0.02, stretch: int = 1024) -> int:
    """One pass over texts by truncated backpropagation, states carried from window to window; the tokens learned from.

    Longer texts are learned in stretches of ``stretch`` tokens side by side,
    so that a long one does not fill windows of its own.  Each inner stretch
    begins with the true token before it and the state there, as the weights at
    the start of the pass give it.
    """
    parts = -(-np.diff(bounds) // stretch)
    firsts = np.repeat(bounds[:-1], parts) + stretch * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    lengths = np.minimum(np.repeat(bounds[1:], parts), firsts + stretch) - firsts
    inner = np.arange(parts.sum()) > np.repeat(np.cumsum(parts) - parts, parts)
    states = stretch_states(net, symbols, bounds, start_symbol, stretch)
    adam, learned = Adam(net, rate), 0
    for group in lockstep(lengths, texts):
        group = group[lengths[group] > 0]
        if not len(group):
            continue
        begins, size = firsts[group], lengths[group]
        state = states[group]
        for start in range(0, int(size[0]), steps):
            live = int(np.searchsorted(-size, -start, "left"))
            take = min(steps, int(size[0]) - start)
            b, n = begins[:live], size[:live]
            target = window(classes, b, n, start, take, 0)
            word = window(words, b, n, start, take, 0)
            mask = (start + np.arange(take)[:, None]) < n
            given = window(symbols, b, n, start - 1, take, start_symbol)
            if start == 0:
                given[0] = np.where(inner[group], given[0], start_symbol)
            _, grad, state = net.gradients(given, target, word, mask, state[:live])
            adam.apply(grad)
            learned += int(mask.sum())
    return learned


def score(net: GatedNet, symbols, classes, words, bounds, start_symbol: int, steps: int = 32, texts: int = 2048) -> np.ndarray:
    """Natural log probability of each whole text, the state carried across windows."""
    lengths = np.diff(bounds)
    out = np.zeros(len(lengths))
    for group in lockstep(lengths, texts):
        group = group[lengths[group] > 0]
        if not len(group):
            continue
        begins, size = bounds[group], lengths[group]
        state = np.zeros((len(group), net.hidden), np.float32)
        for start in range(0, int(size[0]), steps):
            live = int(np.searchsorted(-size, -start, "left"))
            take = min(steps, int(size[0]) - start)
            b, n = begins[:live], size[:live]
            given = window(symbols, b, n, start - 1, take, start_symbol)
            if start == 0:
                given[0] = start_symbol
            states, _ = net.run(given, state[:live])
            # The state before each step predicts it: the given symbol is the one before.
            state = states[-1]
            at = start + np.arange(take)[:, None]
            mask = at < n
            place = (b + at)[mask]
            found = net.log_probs(states[mask], classes[place], words[place])
            out[group[:live]] += np.bincount(np.broadcast_to(np.arange(live), mask.shape)[mask], found, live)
    return out
