"""A gated recurrent model of word classes in numpy: truncated backpropagation, Adam, and
scoring that carries the state from window to window to the end of each text.

Texts run through lanes side by side. A lane holds one text after another; the state is set
back where a text begins.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

HIDDEN = 16
WINDOW = 32
LANES = 32
#: Most and fewest lanes that score side by side.
SCORE_LANES = (1024, 32)
#: Steps of all lanes whose logits are held at a time when scoring.
TOGETHER = 1024
RATE = 0.01
CLIP = 1.0
#: Gates' columns halved, those of the new state as they are.
HALF = np.array([0.5] * (2 * HIDDEN) + [1] * HIDDEN, dtype=np.float32)


def init(classes: int, counts: np.ndarray) -> list[np.ndarray]:
    """Input rows (one more for the start), recurrent weights, output weights and bias. The
    bias begins with the logarithm of the classes' shares, so an untrained model is a unigram."""
    rng = np.random.default_rng(7)
    share = (counts + 0.5) / (counts.sum() + 0.5 * classes)
    return [rng.normal(0, 0.1, (classes + 1, 3 * HIDDEN)).astype(np.float32),
            (rng.normal(0, 1, (HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32),
            rng.normal(0, 0.05, (HIDDEN, classes)).astype(np.float32),
            np.log(share).astype(np.float32)]


def lay_out(texts: list[np.ndarray], lanes: int, start: int) -> tuple:
    """(inputs, targets, begins) of shape (steps, lanes), and per text its lane and offset.
    Longest texts are placed first, each into the emptiest lane; unused targets are -1."""
    load = [(0, lane) for lane in range(lanes)]
    where = [(0, 0)] * len(texts)
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        used, lane = heapq.heappop(load)
        where[i] = (lane, used)
        heapq.heappush(load, (used + len(texts[i]), lane))
    steps = max(used for used, _ in load)
    inputs = np.full((steps, lanes), start, dtype=np.int16)
    targets = np.full((steps, lanes), -1, dtype=np.int16)
    begins = np.zeros((steps, lanes), dtype=bool)
    for text, (lane, at) in zip(texts, where):
        n = len(text)
        if n:
            inputs[at + 1:at + n, lane] = text[:-1]
            targets[at:at + n, lane] = text
            begins[at, lane] = True
    return inputs, targets, begins, where


def _halved(rows: np.ndarray, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input rows, and recurrent weights turned round, with those of the gates halved: a gate's
    sigmoid(v) is tanh(v / 2) / 2 + 1 / 2."""
    half = HALF.astype(recurrent.dtype, copy=False)
    return rows * half, np.ascontiguousarray((recurrent * half).T)


def _forward(into: np.ndarray, given: np.ndarray, now: np.ndarray, a: np.ndarray,
             gates: np.ndarray, new: np.ndarray, after: np.ndarray) -> None:
    """One step of all lanes, which are the last axis, from the state `now` to `after`."""
    n2 = 2 * HIDDEN
    np.dot(into, now, out=a)
    np.add(given[:n2], a[:n2], out=gates)
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    np.multiply(gates[HIDDEN:], a[n2:], out=new)
    new += given[n2:]
    np.tanh(new, out=new)
    np.subtract(now, new, out=after)
    after *= gates[:HIDDEN]
    after += new


def _safe(out: np.ndarray, bias: np.ndarray) -> bool:
    """States lie between -1 and 1, so this bounds every logit; exp is safe well below it."""
    return float((np.abs(out).sum(axis=0) + np.abs(bias)).max()) < 60


def log_likelihoods(params: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Natural-log probability of every class sequence, state carried through each text."""
    rows, recurrent, out, bias = params
    start = len(rows) - 1
    # As many lanes as the longest text leaves full.
    longest = max(map(len, texts), default=0)
    full = sum(map(len, texts)) // max(1, longest)
    lanes = max(1, min(len(texts), max(SCORE_LANES[1], min(SCORE_LANES[0], full))))
    inputs, targets, begins, where = lay_out(texts, lanes, start)
    total = np.zeros((len(inputs) + 1, lanes))
    safe, ones = _safe(out, bias), np.ones(len(bias), dtype=bias.dtype)
    n, n2, kind = HIDDEN, 2 * HIDDEN, recurrent.dtype
    halved, into = _halved(rows, recurrent)
    halved = np.ascontiguousarray(halved.T)
    now = np.zeros((n, lanes), dtype=kind)
    given, a = np.empty((2, 3 * n, lanes), dtype=kind)
    s, w = np.empty((n2, lanes), dtype=kind), np.empty((n, lanes), dtype=kind)
    window = min(WINDOW, len(inputs))
    states = np.empty((window, n, lanes), dtype=kind)
    # Ones under the states and the bias under the output weights: one product gives logits.
    under, weights = np.ones((n + 1, window, lanes), dtype=kind), np.vstack([out, bias])
    held = np.empty((TOGETHER, len(bias)), dtype=kind)
    places = np.arange(TOGETHER) * len(bias)
    for at in range(0, len(inputs), WINDOW):
        x, reset = inputs[at:at + WINDOW], begins[at:at + WINDOW]
        for t, after in enumerate(states[:len(x)]):
            if reset[t].any():
                now = now * ~reset[t]
            np.take(halved, x[t], axis=1, out=given, mode="clip")
            _forward(into, given, now, a, s, w, after)
            now = after
        now = now.copy()
        under[:n, :len(x)] = states[:len(x)].transpose(1, 0, 2)
        flat = under.reshape(n + 1, -1)
        y = targets[at:at + WINDOW].ravel()
        logp = np.empty(len(y), dtype=np.float32)
        # Few rows at a time, so that their logits stay in the caches.
        for i in range(0, len(y), TOGETHER):
            wanted = np.maximum(y[i:i + TOGETHER], 0)
            logits = np.dot(flat[:, i:i + len(wanted)].T, weights, held[:len(wanted)])
            if not safe:
                logits -= logits.max(axis=1, keepdims=True)
            picked = logits.ravel()[places[:len(wanted)] + wanted]
            np.exp(logits, out=logits)
            logp[i:i + TOGETHER] = picked - np.log(logits @ ones)
        logp *= y >= 0
        total[at + 1:at + 1 + len(x)] = logp.reshape(len(x), lanes)
    np.cumsum(total, axis=0, out=total)
    return np.array([total[at + len(t), lane] - total[at, lane]
                     for t, (lane, at) in zip(texts, where)])


def _together(params: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """One vector with a copy of all parameters, and each of them as a view of it."""
    flat = np.concatenate([p.ravel() for p in params])
    cuts = np.cumsum([p.size for p in params])[:-1]
    return flat, [v.reshape(p.shape) for v, p in zip(np.split(flat, cuts), params)]


class _Room:
    """Arrays of a window of one shape, used again by the next one, and the pieces of them that
    each step reads and writes.

    What would be added to a step's product is part of it: rows of the right side that the left
    side takes as they are.
    """

    def __init__(self, steps: int, lanes: int, inputs: int, classes: int, kind: np.dtype):
        n, n2, n3 = HIDDEN, 2 * HIDDEN, 3 * HIDDEN
        self.shape, size = (steps, lanes), steps * lanes
        self.half = np.full((n2, lanes), 0.5, dtype=kind)
        #: The state before a step, and what its input adds to the gates and to the new state.
        self.read = np.empty((steps + 1, n3, lanes), dtype=kind)
        self.given = np.empty((steps, n, lanes), dtype=kind)
        self.taken = np.empty((size, n3), dtype=kind)
        self.into = np.zeros((n3, n3), dtype=kind)
        self.into[:n2, n:] = np.eye(n2)
        self.a = np.empty((steps, n3, lanes), dtype=kind)
        self.zr = np.empty((steps, n2, lanes), dtype=kind)
        self.new = np.empty((steps, n, lanes), dtype=kind)
        #: States of all steps with ones below, output weights with the bias below.
        self.states = np.ones((n + 1, steps, lanes), dtype=kind)
        self.out = np.empty((n + 1, classes), dtype=kind)
        self.error = np.empty((size, classes), dtype=kind)
        self.ones = np.ones(max(size, classes), dtype=kind)
        self.at_class = np.arange(size) * classes
        self.at_input = np.arange(size) * inputs
        #: Gradients of the states, what they are multiplied by, and the products: those of the
        #: gates and the new state, what goes on to the state before, and what that one has itself.
        self.d = np.empty((steps, n, lanes), dtype=kind)
        self.by = np.empty((steps, 4, n, lanes), dtype=kind)
        self.to_new = np.empty((steps, n, lanes), dtype=kind)
        self.other = np.empty((steps, n, lanes), dtype=kind)
        self.d_a = np.zeros((steps, 5, n, lanes), dtype=kind)
        self.back = np.concatenate([np.zeros((n, n3)), np.eye(n), np.eye(n)], axis=1).astype(kind)
        self.d_states = np.empty((size, n), dtype=kind)
        self.d_given = np.empty((steps, lanes, n3), dtype=kind)
        self.before = np.empty((n, steps, lanes), dtype=kind)
        self.hot = np.zeros((size, inputs), dtype=kind)
        self.forward = [
            (self.read[t], self.a[t], self.a[t, :n2], self.zr[t], self.zr[t, n:], self.a[t, n2:],
             self.new[t], self.given[t], self.read[t, :n], self.read[t + 1, :n], self.zr[t, :n])
            for t in range(steps)]
        self.backward = [
            (t, self.d[t], self.by[t], self.d_a[t, :4], self.d_a[t].reshape(5 * n, lanes),
             self.d[t - 1]) for t in range(steps - 1, 0, -1)]


class Trainer:
    """Adam over windows of truncated backpropagation.

    All parameters are views of one vector, so one update is a few operations. Inside a window
    lanes are the last axis: what a step reads and writes then lies in one piece.
    """

    def __init__(self, params: list[np.ndarray]):
        self.flat, self.params = _together(params)
        self.mean, self.square = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.updates = self.tokens = 0
        self.room: _Room | None = None

    def train(self, texts: list[np.ndarray]) -> None:
        """One pass over the texts."""
        lanes = max(1, min(LANES, len(texts)))
        inputs, targets, begins, _ = lay_out(texts, lanes, len(self.params[0]) - 1)
        h = np.zeros((lanes, HIDDEN), dtype=np.float32)
        for at in range(0, len(inputs), WINDOW):
            h, grads, n = self.window(inputs[at:at + WINDOW], targets[at:at + WINDOW],
                                      begins[at:at + WINDOW], h)
            if n:
                self.step([g / n for g in grads])
                self.tokens += n

    def window(self, x: np.ndarray, y: np.ndarray, reset: np.ndarray, h: np.ndarray) -> tuple:
        """State after the window, gradients of the summed loss inside it, targets seen."""
        rows, recurrent, out, bias = self.params
        steps, lanes = x.shape
        n, n2, size = HIDDEN, 2 * HIDDEN, steps * lanes
        if self.room is None or self.room.shape != x.shape:
            self.room = _Room(steps, lanes, len(rows), len(bias), recurrent.dtype)
        room, begun = self.room, reset.any(axis=1).tolist()
        keep, read, half, into = ~reset, room.read, room.half, room.into
        halved, into[:, :n] = _halved(rows, recurrent)
        x = x.ravel()
        given = np.take(halved, x, axis=0, out=room.taken, mode="clip").reshape(steps, lanes, -1)
        read[:-1, n:] = given[:, :, :n2].transpose(0, 2, 1)
        room.given[:] = given[:, :, n2:].transpose(0, 2, 1)
        read[0, :n] = h.T
        dot, tanh, add, multiply, subtract = np.dot, np.tanh, np.add, np.multiply, np.subtract
        left = {}
        for t, (both, a, a_zr, zr, r, a_new, new, g, now, after, z) in enumerate(room.forward):
            if begun[t]:
                left[t] = now.copy()
                now *= keep[t]
            dot(into, both, a)
            tanh(a_zr, zr)
            multiply(zr, half, zr)
            add(zr, half, zr)
            multiply(r, a_new, new)
            add(new, g, new)
            tanh(new, new)
            subtract(now, new, after)
            multiply(after, z, after)
            add(after, new, after)
        states, error, ones = room.states, room.error, room.ones
        states[:n] = read[1:, :n].transpose(1, 0, 2)
        for t, state in left.items():
            if t:
                states[:n, t - 1] = state
        flat = states.reshape(n + 1, size)
        room.out[:n], room.out[n] = out, bias
        dot(flat.T, room.out, error)
        if not _safe(out, bias):
            error -= error.max(axis=1, keepdims=True)
        np.exp(error, out=error)
        error *= (1 / (error @ ones[:len(bias)]))[:, None]
        target = y.ravel()
        error.ravel()[room.at_class + np.maximum(target, 0)] -= 1
        seen = int((target >= 0).sum())
        if seen < size:
            error *= (target >= 0)[:, None]
        d_out, d_bias = flat[:n] @ error, ones[:size] @ error
        d_states = dot(error, np.ascontiguousarray(out.T), room.d_states)
        d_states = d_states.reshape(steps, lanes, n).transpose(0, 2, 1)
        room.d[-1], room.d_a[1:, 4] = d_states[-1], d_states[:-1]
        # What a step's gradient is multiplied by, for all steps at once.
        before, new, to_new, other = read[:-1, :n], room.new, room.to_new, room.other
        d_z, d_r, d_new, by_z = (room.by[:, i] for i in range(4))
        z, r = room.zr[:, :n], room.zr[:, n:]
        by_z[:] = z
        subtract(before, new, d_z)
        multiply(d_z, z, d_z)
        subtract(1, z, other)
        multiply(d_z, other, d_z)
        multiply(new, new, to_new)
        subtract(1, to_new, to_new)
        multiply(other, to_new, to_new)
        multiply(to_new, r, d_new)
        multiply(d_new, room.a[:, n2:], d_r)
        subtract(1, r, other)
        multiply(d_r, other, d_r)
        back = room.back
        back[:, :3 * n] = recurrent
        for t, d, to, products, all_rows, d_before in room.backward:
            multiply(d, to, products)
            if begun[t]:
                dot(back[:, :4 * n], all_rows[:4 * n], d_before)
                d_before *= keep[t]
                d_before += all_rows[4 * n:]
            else:
                dot(back, all_rows, d_before)
        multiply(room.d[0], room.by[0], room.d_a[0, :4])
        room.d_given[:] = room.d_a[:, :3].reshape(steps, 3 * n, lanes).transpose(0, 2, 1)
        room.before[:] = before.transpose(1, 0, 2)
        d_given = room.d_given.reshape(size, 3 * n)
        d_recurrent = room.before.reshape(n, size) @ d_given
        multiply(room.d, to_new, other)
        room.d_given[:, :, n2:] = other.transpose(0, 2, 1)
        at = room.at_input + x
        room.hot.ravel()[at] = 1
        d_rows = room.hot.T @ d_given
        room.hot.ravel()[at] = 0
        return read[-1, :n].T.copy(), [d_rows, d_recurrent, d_out, d_bias], seen

    def step(self, grads: list[np.ndarray]) -> None:
        g = np.concatenate([g.ravel() for g in grads])
        g *= min(1.0, CLIP / max(math.sqrt(float(g @ g)), 1e-12))
        self.updates += 1
        by = np.subtract(g, self.mean)
        by *= 0.1
        self.mean += by
        g *= g
        g -= self.square
        g *= 0.01
        self.square += g
        np.divide(self.square, 1 - 0.99 ** self.updates, out=g)
        np.sqrt(g, out=g)
        g += 1e-8
        np.divide(self.mean, 1 - 0.9 ** self.updates, out=by)
        by *= RATE
        by /= g
        self.flat -= by
