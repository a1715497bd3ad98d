"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy.

Gates are clipped lines (0 to 1), the cell and candidate use tanh. Arrays run over time first, then windows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

CODES = 128


def codes(text: str) -> np.ndarray:
    """One code a character; everything outside ASCII shares one."""
    return np.frombuffer(text.encode("ascii", "replace"), np.uint8)


@dataclass
class Tagger:
    """Parameters: per direction input rows (bias included), recurrence, output; label bias and transitions."""

    hidden: int
    labels: int
    values: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, hidden: int, labels: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        made = cls(hidden, labels)
        bias = np.concatenate([np.full(hidden, b) for b in (0.5, 0.9, 0.5, 0.0)])
        for way in "fb":
            made.values[f"in_{way}"] = bias + 0.2 * rng.standard_normal((CODES, 4 * hidden))
            made.values[f"re_{way}"] = 0.25 * rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)
            made.values[f"out_{way}"] = rng.standard_normal((hidden, labels)) / np.sqrt(hidden)
        made.values["bias"] = np.zeros(labels)
        made.values["moves"] = np.zeros((labels, labels))
        made.values = {k: v.astype(np.float32) for k, v in made.values.items()}
        return made

    def emissions(self, windows: np.ndarray) -> np.ndarray:
        """Label scores (time, labels, windows) of code windows (time, windows)."""
        n, h, v = windows.shape[1], self.hidden, self.values
        scores = np.empty((len(windows), self.labels, n), np.float32)
        scores[:] = v["bias"][:, None]
        read, gates = np.empty((n, 4 * h), np.float32), np.empty((4 * h, n), np.float32)
        for way, order in (("f", range(len(windows))), ("b", range(len(windows) - 1, -1, -1))):
            state, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            rows = v[f"in_{way}"]
            back, out = np.ascontiguousarray(v[f"re_{way}"].T), np.ascontiguousarray(v[f"out_{way}"].T)
            for t in order:
                np.take(rows, windows[t], axis=0, out=read, mode="clip")
                np.matmul(back, state, out=gates)
                gates += read.T
                line, fresh = gates[: 3 * h], gates[3 * h :]
                np.clip(line, 0, 1, out=line)
                np.tanh(fresh, out=fresh)
                cell *= line[h : 2 * h]
                fresh *= line[:h]
                cell += fresh
                np.tanh(cell, out=state)
                state *= line[2 * h :]
                scores[t] += out @ state
        return scores

    def decode(self, windows: np.ndarray) -> dict[int, np.ndarray]:
        """Best label paths by window, of the windows whose path is not label 0 throughout.

        The path of zeros is settled without the dynamic program where label 0 leads everywhere by more than any moves could
        win back, then by the best score alone; only the windows that remain are traced.
        """
        scores, moves = self.emissions(windows), self.values["moves"]
        asked = self._open_windows(scores)
        if not len(asked):
            return {}
        own = np.ascontiguousarray(scores[:, :, asked])
        zeros = own[:, 0].sum(axis=0, dtype=np.float64) + float(moves[0, 0]) * (len(own) - 1)
        best = own[0].astype(np.float64)
        for t in range(1, len(own)):
            best = np.stack([self._best_into(best, label) for label in range(self.labels)]) + own[t]
        traced = best.max(axis=0) > zeros + 1e-6
        asked, own = asked[traced], np.ascontiguousarray(own[:, :, traced].transpose(0, 2, 1))
        best, came = own[0], []
        for t in range(1, len(own)):
            paths = best[:, :, None] + moves
            came.append(paths.argmax(axis=1))
            best = paths.max(axis=1) + own[t]
        path = np.empty((len(own), len(asked)), np.int8)
        path[-1] = best.argmax(axis=1)
        for t in range(len(own) - 2, -1, -1):
            path[t] = came[t][np.arange(len(asked)), path[t + 1]]
        return {int(w): path[:, i] for i, w in enumerate(asked) if path[:, i].any()}

    def _best_into(self, best: np.ndarray, label: int) -> np.ndarray:
        moves = self.values["moves"]
        top = best[0] + moves[0, label]
        for other in range(1, self.labels):
            np.maximum(top, best[other] + moves[other, label], out=top)
        return top

    def _open_windows(self, scores: np.ndarray) -> np.ndarray:
        """Windows where some stretch of other labels might beat label 0.

        A bound by one running maximum: a stretch gains at most its best scores with the best move into each label, and pays
        to enter from label 0 and to return, but for the window's edges.
        """
        moves = self.values["moves"] - self.values["moves"][0, 0]
        into = moves[1:].max(axis=0)[1:]
        enter, leave = float((moves[0, 1:] - into).max()), float(moves[1:, 0].max())
        gain = scores[:, 1] + into[0]
        for label in range(2, self.labels):
            np.maximum(gain, scores[:, label] + into[label - 1], out=gain)
        gain -= scores[:, 0]
        run = scores[0, 1:].max(axis=0) - scores[0, 0]
        best = run + leave
        for step in gain[1:]:
            np.maximum(run, enter, out=run)
            run += step
            np.maximum(best, run + leave, out=best)
        return np.flatnonzero(np.maximum(best, run) > -1e-4)

    def loss(self, windows: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag paths a character, and its gradient."""
        v, h, (steps, n) = self.values, self.hidden, windows.shape
        scores = np.zeros((steps, n, self.labels)) + v["bias"]
        kept = {}
        for way in "fb":
            order = range(steps) if way == "f" else range(steps - 1, -1, -1)
            state = cell = np.zeros((n, h))
            trail = []
            for t in order:
                line = v[f"in_{way}"][windows[t]] + state @ v[f"re_{way}"]
                gates = np.clip(line[:, : 3 * h], 0, 1)
                fresh = np.tanh(line[:, 3 * h :])
                before, held = state, cell
                cell = gates[:, h : 2 * h] * held + gates[:, :h] * fresh
                bent = np.tanh(cell)
                state = gates[:, 2 * h :] * bent
                scores[t] += state @ v[f"out_{way}"]
                trail.append((t, line, gates, fresh, before, held, bent, state))
            kept[way] = trail
        lost, to_scores, to_moves = self._paths(scores, tags)
        grads = {"bias": to_scores.sum(axis=(0, 1)), "moves": to_moves}
        for way in "fb":
            to_in, to_re, to_out = (np.zeros(v[f"{k}_{way}"].shape) for k in ("in", "re", "out"))
            to_state = to_cell = np.zeros((n, h))
            for t, line, gates, fresh, before, held, bent, state in reversed(kept[way]):
                to_out += state.T @ to_scores[t]
                to_state = to_state + to_scores[t] @ v[f"out_{way}"].T
                to_cell = to_cell + to_state * gates[:, 2 * h :] * (1 - bent**2)
                inside = (line[:, : 3 * h] > 0) & (line[:, : 3 * h] < 1)
                to_line = np.concatenate(
                    [
                        np.concatenate([to_cell * fresh, to_cell * held, to_state * bent], axis=1) * inside,
                        to_cell * gates[:, :h] * (1 - fresh**2),
                    ],
                    axis=1,
                )
                np.add.at(to_in, windows[t], to_line)
                to_re += before.T @ to_line
                to_state, to_cell = to_line @ v[f"re_{way}"].T, to_cell * gates[:, h : 2 * h]
            grads |= {f"in_{way}": to_in, f"re_{way}": to_re, f"out_{way}": to_out}
        return lost / (steps * n), {k: g / (steps * n) for k, g in grads.items()}

    def _paths(self, scores: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log likelihood over all paths, and its slopes by score and move (forward-backward)."""
        moves, (steps, n, k) = self.values["moves"].astype(np.float64), scores.shape
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0]
        for t in range(1, steps):
            ahead[t] = scores[t] + log_sum(ahead[t - 1][:, :, None] + moves, 1)
        for t in range(steps - 2, -1, -1):
            behind[t] = log_sum(moves + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
        total = log_sum(ahead[-1], 1)
        to_scores, to_moves = np.exp(ahead + behind - total[None, :, None]), np.zeros((k, k))
        for t in range(1, steps):
            pairs = ahead[t - 1][:, :, None] + moves + (scores[t] + behind[t])[:, None, :] - total[:, None, None]
            to_moves += np.exp(pairs).sum(axis=0)
        at = np.arange(n)
        gold = sum(scores[t, at, tags[t]].sum() for t in range(steps))
        gold += moves[tags[:-1], tags[1:]].sum()
        for t in range(steps):
            to_scores[t, at, tags[t]] -= 1
        np.subtract.at(to_moves, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        return float(total.sum() - gold), to_scores, to_moves


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(windows: np.ndarray, tags: np.ndarray, labels: int, hidden: int, rounds: int, batch: int, rate: float, seed: int) -> Tagger:
    """Adam over shuffled batches; ``windows`` and ``tags`` are (windows, time). Equal input gives an equal model."""
    tagger, rng = Tagger.fresh(hidden, labels, seed), np.random.default_rng(seed)
    mean, square, step = {}, {}, 0
    total = rounds * max(1, len(windows) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(windows))
        for at in range(0, max(1, len(order) - batch + 1), batch):
            part, step = order[at : at + batch], step + 1
            _, grads = tagger.loss(windows[part].T, tags[part].T)
            pace = rate * min(1.0, 2.0 * (1 - step / (total + 1)) + 0.02)
            for name, g in grads.items():
                g = np.clip(g * 100, -5, 5)
                mean[name] = 0.9 * mean.get(name, 0) + 0.1 * g
                square[name] = 0.99 * square.get(name, 0) + 0.01 * g * g
                moved = mean[name] / (1 - 0.9**step) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
                tagger.values[name] = (tagger.values[name] - pace * moved).astype(np.float32)
    return tagger
