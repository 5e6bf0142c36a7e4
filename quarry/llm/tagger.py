"""A character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is outside; 1 + 2 * kind begins a span, 2 + 2 * kind goes on with it.
LABELS = 1 + 2 * len(KINDS)
WIDTH = 64
EMBED, HIDDEN = 12, 16

#: Character classes: the pad, each letter in lower case, each digit, and these marks; then capitals, white space and the rest.
MARKS = "@.-+_%()[]/:=,;\"'#*$&|<>!?"
CLASSES = 1 + 26 + 10 + len(MARKS) + 3
_CODE = np.full(128, CLASSES - 1, np.int32)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789" + MARKS):
    _CODE[ord(_c)] = 1 + _i
_CODE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = CLASSES - 3
_CODE[[ord(c) for c in " \t\n\r\x0b\x0c"]] = CLASSES - 2


def classes(text: str) -> np.ndarray:
    """The class of each character."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], CLASSES - 1).astype(np.uint8)


def coded(texts: Sequence[str], width: int = WIDTH) -> np.ndarray:
    """(texts, width): classes of the characters, padded on the right."""
    out = np.zeros((len(texts), width), np.uint8)
    for i, t in enumerate(texts):
        out[i, : len(t[:width])] = classes(t[:width])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        shape = {"embed": (CLASSES, EMBED), "out": (2 * HIDDEN, LABELS), "out_b": (LABELS,), "step": (LABELS, LABELS), "first": (LABELS,)}
        for d in "fb":
            shape |= {f"x_{d}": (EMBED, 4 * HIDDEN), f"h_{d}": (HIDDEN, 4 * HIDDEN), f"b_{d}": (4 * HIDDEN,)}
        weights = {k: (rng.standard_normal(s) * (0.3 if len(s) > 1 else 0)).astype(np.float32) for k, s in shape.items()}
        for d in "fb":
            weights[f"b_{d}"][HIDDEN : 2 * HIDDEN] = 1  # to remember at first
        return Tagger(weights)

    def _direction(self, e: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (steps, batch, hidden) of one direction; e: (steps, batch, embed) in the order to be read."""
        w = self.weights
        into = e @ w[f"x_{d}"] + w[f"b_{d}"]
        h = np.zeros((e.shape[1], HIDDEN), np.float32)
        c, out, kept = h, np.empty((*e.shape[:2], HIDDEN), np.float32), []
        for t in range(len(e)):
            z = into[t] + h @ w[f"h_{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, before_h = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                kept.append((i, f, o, g, before, tc, before_h))
        return out, kept

    def emissions(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """(steps, batch, labels) of classes (batch, steps)."""
        w = self.weights
        e = w["embed"][x.T]
        ahead, kept_f = self._direction(e, "f", keep)
        back, kept_b = self._direction(e[::-1], "b", keep)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        return both @ w["out"] + w["out_b"], (e, both, kept_f, kept_b)

    def _scores(self, x: np.ndarray, d: str, into: np.ndarray) -> None:
        """Adds one direction's share of the emissions to into (steps, labels, batch); x: (steps, batch), in the text's order.

        The batch is the last axis, so that each gate is one contiguous block; a state and its character's vector stand in
        one matrix, so that a step is one product. Halved rows make the three sigmoids and the candidate one tanh.
        """
        w, h = self.weights, HIDDEN
        weight = np.ascontiguousarray(np.concatenate([w[f"h_{d}"], w[f"x_{d}"], w[f"b_{d}"][None]]).T, np.float32)
        weight[: 3 * h] *= 0.5
        vectors = np.ascontiguousarray(np.concatenate([w["embed"].T, np.ones((1, CLASSES))]), np.float32)
        out = np.ascontiguousarray((w["out"][:h] if d == "f" else w["out"][h:]).T)
        n = x.shape[1]
        state, z, c, spare = np.zeros((h + EMBED + 1, n), np.float32), np.empty((4 * h, n), np.float32), np.zeros((h, n), np.float32), np.empty((h, n), np.float32)
        share = np.empty((LABELS, n), np.float32)
        gates, i, f, o, g = z[: 3 * h], z[:h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h :]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(vectors, x[t], axis=1, out=state[h:], mode="clip")
            np.matmul(weight, state, out=z)
            np.tanh(z, out=z)
            gates *= 0.5
            gates += 0.5
            c *= f
            np.multiply(i, g, out=spare)
            c += spare
            np.tanh(c, out=spare)
            np.multiply(o, spare, out=state[:h])
            np.matmul(out, state[:h], out=share)
            into[t] += share

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best label sequences (batch, steps) of classes (batch, steps)."""
        w, x = self.weights, np.ascontiguousarray(x.T, np.intp)
        score = np.empty((len(x), LABELS, x.shape[1]), np.float32)  # of the best path up to each label
        score[:] = w["out_b"][:, None]
        self._scores(x, "f", score)
        self._scores(x, "b", score)
        score[0] += w["first"][:, None]
        each = np.empty((LABELS, LABELS, x.shape[1]), np.float32)
        for t in range(1, len(x)):
            np.add(score[t - 1][:, None, :], w["step"][:, :, None], out=each)
            score[t] += each.max(axis=0)
        out = np.empty(x.shape, np.int8)
        label = score[-1].argmax(axis=0)
        out[-1] = label
        for t in range(len(x) - 1, 0, -1):
            label = (score[t - 1] + w["step"][:, label]).argmax(axis=0)
            out[t - 1] = label
        return out.T

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The CRF's negative log likelihood of labels y (batch, steps), a window on average, and its gradient."""
        w, n = self.weights, len(x)
        emit, (e, both, kept_f, kept_b) = self.emissions(x, keep=True)
        steps, rows = len(emit), np.arange(n)
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = w["first"] + emit[0]
        for t in range(1, steps):
            alpha[t] = _lse(alpha[t - 1][:, :, None] + w["step"], 1) + emit[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(w["step"] + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        gold = w["first"][y[:, 0]] + emit[0, rows, y[:, 0]]
        d_emit = np.exp(alpha + beta - z[None, :, None])
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["first"] = d_emit[0].sum(axis=0)
        for t in range(steps):
            if t:
                gold = gold + w["step"][y[:, t - 1], y[:, t]] + emit[t, rows, y[:, t]]
                g["step"] += np.exp(alpha[t - 1][:, :, None] + w["step"] + (emit[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
                np.add.at(g["step"], (y[:, t - 1], y[:, t]), -1)
            d_emit[t, rows, y[:, t]] -= 1
        np.add.at(g["first"], y[:, 0], -1)
        g["out"] = np.tensordot(both, d_emit, ((0, 1), (0, 1)))
        g["out_b"] = d_emit.sum(axis=(0, 1))
        d_both = d_emit @ w["out"].T
        d_e = self._back(e, d_both[:, :, :HIDDEN], kept_f, "f", g) + self._back(e[::-1], d_both[::-1, :, HIDDEN:], kept_b, "b", g)[::-1]
        np.add.at(g["embed"], x.T, d_e)
        return float((z - gold).mean()), {k: v / n for k, v in g.items()}

    def _back(self, e: np.ndarray, d_out: np.ndarray, kept: list, d: str, g: dict[str, np.ndarray]) -> np.ndarray:
        """Adds one direction's gradients to g and gives that of e."""
        w = self.weights
        d_z = np.empty((*e.shape[:2], 4 * HIDDEN), np.float32)
        d_h = np.zeros_like(d_out[0])
        d_c = d_h
        for t in range(len(e) - 1, -1, -1):
            i, f, o, cand, before, tc, before_h = kept[t]
            d_h = d_h + d_out[t]
            d_c = d_c + d_h * o * (1 - tc * tc)
            d_z[t] = np.concatenate([d_c * cand * i * (1 - i), d_c * before * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - cand * cand)], axis=1)
            d_c = d_c * f
            g[f"h_{d}"] += before_h.T @ d_z[t]
            d_h = d_z[t] @ w[f"h_{d}"].T
        g[f"x_{d}"] += np.tensordot(e, d_z, ((0, 1), (0, 1)))
        g[f"b_{d}"] += d_z.sum(axis=(0, 1))
        return d_z @ w[f"x_{d}"].T


def train(examples: Sequence[tuple[str, Sequence[tuple[int, int, str]]]], steps: int = 450, batch: int = 32, rate: float = 0.02, seed: int = 3) -> Tagger:
    """examples: texts of WIDTH characters at most with their labelled spans (start, end, kind). Adam on the CRF's likelihood."""
    tagger, rng = Tagger.fresh(seed), np.random.default_rng(seed)
    x = coded([t for t, _ in examples], max((len(t) for t, _ in examples), default=1))
    y = np.zeros(x.shape, np.int64)
    for row, (_, found) in zip(y, examples, strict=True):
        for start, end, kind in found:
            row[start:end] = 2 + 2 * KINDS.index(kind)
            row[start] = 1 + 2 * KINDS.index(kind)
    m = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    v2 = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    for step in range(1, steps + 1):
        some = rng.integers(0, len(x), batch)
        _, g = tagger.gradient(x[some], y[some])
        lr = rate * (1 - 0.9 * step / steps)
        for k, w in tagger.weights.items():
            d = np.clip(g[k], -5, 5)
            m[k] += 0.1 * (d - m[k])
            v2[k] += 0.01 * (d * d - v2[k])
            w -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


def examples(count: int = 6000, seed: int = 3, width: int = WIDTH) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Windows of invented text with personal data in many forms, some of which no fixed pattern has, and with look-alikes."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "in", "ou", "de", "ti", "la", "sch", "é", "ç", "ñ", "ü", "st", "b", "m", "a", "e")) for _ in range(rng.randint(1, 4)))
    plain = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))

    def luhn(n: int) -> str:
        body = rng.choice("3456") + digits(n - 2)
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def email() -> str:
        at, dot = rng.choice((("@", "."),) * 3 + ((" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" (at) ", "."), (" AT ", " DOT "), (" at ", " dot "), (" at ", " dot "), (" [AT] ", "."), ("[AT]", "[DOT]"), (" {at} ", "."), ("{at}", "{dot}")))
        host = plain() + (dot + plain() if rng.random() < 0.4 else "") + dot + rng.choice(("com", "org", "net", "de", "fr", "example"))
        return plain() + rng.choice(("", rng.choice(("", ".", "_", "-")) + rng.choice((plain(), digits(2))))) + at + host

    def card() -> str:
        n = luhn(rng.choice((13, 15, 16, 16, 16, 16, 19)))
        sep = rng.choice(("", "", " ", "-", "."))
        return sep.join(n[i : i + 4] for i in range(0, len(n), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice((f"+{digits(rng.randint(1, 2))} ({a}) {b}-{c}", f"+{digits(1)} {a} {b} {c}", f"+{digits(2)}{a}{b}{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"+{digits(2)}-{a}-{b}-{c}"))

    def ip() -> str:
        return rng.choice((".", ".", ".", "[.]", "(dot)", "[dot]", " dot ")).join(str(rng.randint(0, 255)) for _ in range(4))

    def other() -> str:
        return rng.choice((
            lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((16, 32, 40)))), lambda: str(rng.randint(1800, 2100)), lambda: f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}",
            lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 31):02}", lambda: digits(rng.randint(1, 7)), lambda: f"{rng.randint(0, 23)}:{digits(2)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"${digits(3)}.{digits(2)}",
            lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)), lambda: f"§{digits(2)}", lambda: "@" + plain(), lambda: f"[{digits(2)}]", lambda: digits(rng.randint(20, 30)), lambda: f"{digits(3)},{digits(3)},{digits(3)}", lambda: f"{plain()} at {plain()} {plain()}", lambda: f"{plain()} at {plain()}, dot {plain()}",
        ))()

    made = []
    for _ in range(count):
        parts: list[tuple[str, str | None]] = []
        for _ in range(rng.randint(8, 14) * width // WIDTH):
            r = rng.random()
            if r < 0.16:
                kind = rng.choice((*KINDS, "email", "email"))
                parts.append(({"email": email, "ip": ip, "card": card, "phone": phone}[kind](), kind))
            elif r < 0.26:
                parts.append((other(), None))
            else:
                w = word()
                parts.append((rng.choice((w, w, w.capitalize(), w.upper(), plain(), plain())), None))
            parts.append((rng.choice((" ", " ", " ", " ", ", ", ". ", "\n", "!! ", "*** ", " | ", ": ")), None))
        text, found = "", []
        for t, kind in parts:
            if kind:
                found.append((len(text), len(text) + len(t), kind))
            text += t
        at = rng.randint(0, max(0, len(text) - width))
        made.append((text[at : at + width], [(max(a - at, 0), min(b - at, width), k) for a, b, k in found if b > at and a < at + width]))
    return made
