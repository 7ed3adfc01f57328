"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns find e-mail addresses, IP addresses, payment cards and telephone numbers by
fixed rules. The model, trained in numpy from labelled spans, adds spans of the same kinds
in forms that the rules do not know: addresses written out or defanged, national telephone
numbers, cards with other marks between their digits. It tells them by their surroundings
from dates, decimals, serial numbers and the like; what it finds is kept if it has such a
form and passes the kind's own test (octets, checksum, number of digits). It reads every
character of every text, in windows that overlap; each character has its tag from one of
them, and spans are made of the tags of the whole text.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, lean, slices, small_batches, smallest_keys, text_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
# possessive and anchored at a run's start: the same matches as the contract's patterns, in linear time
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT, _DOT = r"(?:\s?@\s?|\s?[(\[{]at[)\]}]\s?|\sat\s)", r"(?:\.|\s?[(\[{](?:dot|\.)[)\]}]\s?|\sdot\s)"
#: The forms in which the model's spans of each kind are kept.
_FORMS = (
    re.compile(rf"(?<![\w.%+-])[a-z0-9][a-z0-9._%+-]*{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+(?![\w-])", re.IGNORECASE),
    re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\s?\.\s?|\s?[(\[{](?:dot|\.)[)\]}]\s?|\sdot\s)[0-9]{1,3}){3}(?![\w]|\.[0-9])", re.IGNORECASE),
    re.compile(r"(?<![\w.,-])[0-9]{4}(?:[ ./_\u00a0-]{1,3}?[0-9]{2,6}){2,4}(?![\w]|[.,-][0-9])"),
    re.compile(r"(?<![\w.,:/+-])(?:\([0-9]{1,5}\)|[0-9])(?:[ ()./-]{0,2}[0-9])+(?![\w]|[.,:/-][0-9])"),
)


def luhn(digits: str) -> bool:
    """The checksum of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern, found from each @ outwards."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            end = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of every base span, by kind and then by start."""
    found: list[Span] = []
    if "@" in text:
        found += [(0, a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                    found.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((3, *m.span()))
    return found


# -- the model ---------------------------------------------------------------------

WINDOW = 64  # characters of a window to learn from
READ, MARGIN = 512, 16  # characters of a window that is read, and at its ends those that the windows beside it tell
STEP, ROUND = READ - 2 * MARGIN, 128  # a text's last window has a multiple of ROUND characters
TAGS = 1 + 2 * len(KINDS)  # outside, and for each kind its first and its further characters


def char_ids(text: str) -> np.ndarray:
    """Classes of characters: each of the printable ASCII ones, other letters, other white space, the rest."""
    if text.isascii():
        return np.frombuffer(text.encode().translate(_CLASS_OF.tobytes().ljust(256)), np.uint8)
    return _CLASS_OF[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 127)]


CLASSES = 99
_CLASS_OF = np.array([97 if p < 32 else 18 if chr(p) in string.digits else p - 30 if p < 127 else 98 for p in range(128)], np.uint8)  # one class for the ten digits


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    high = x.max(axis=axis, keepdims=True)
    return (high + np.log(np.exp(x - high).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Character vectors, two LSTMs, emission weights and CRF transitions."""

    p: dict[str, np.ndarray]
    hidden: int

    @classmethod
    def fresh(cls, hidden: int = 24, dims: int = 12, seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {"chars": draw(CLASSES, dims) * 3, "emit": draw(2 * hidden, TAGS), "emit_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for way in "fb":
            p |= {f"x{way}": draw(dims, 4 * hidden), f"h{way}": draw(hidden, 4 * hidden), f"b{way}": np.zeros(4 * hidden, np.float32)}
            p[f"b{way}"][hidden : 2 * hidden] = 1
        return cls(p, hidden)

    def _both(self, name: str) -> np.ndarray:
        """A parameter of both directions, the forward one first."""
        return np.stack([self.p[f"{name}f"], self.p[f"{name}b"]])

    def _run(self, vectors: np.ndarray) -> tuple[np.ndarray, list]:
        """Both LSTMs side by side over (time, batch, dims): outputs by direction, in each one's own order of time, and what back-propagation needs."""
        steps, batch, _ = vectors.shape
        n = self.hidden
        h, c = np.zeros((2, batch, n), vectors.dtype), np.zeros((2, batch, n), vectors.dtype)
        out, kept = np.empty((steps, 2, batch, n), vectors.dtype), [None] * steps
        pre = np.stack([vectors @ self.p["xf"] + self.p["bf"], vectors[::-1] @ self.p["xb"] + self.p["bb"]], axis=1)
        weights = self._both("h")
        for t in range(steps):
            g = pre[t] + h @ weights
            gates = sigmoid(g[..., : 3 * n])
            i, f, o = gates[..., :n], gates[..., n : 2 * n], gates[..., 2 * n :]
            u = np.tanh(g[..., 3 * n :])
            before, c = c, f * c + i * u
            th = np.tanh(c)
            kept[t] = (i, f, o, u, before, th, h)
            h = o * th
            out[t] = h
        return out, kept

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        vectors = self.p["chars"][ids.T]
        out, kept = self._run(vectors)
        both = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)
        return both @ self.p["emit"] + self.p["emit_b"], (vectors, both, kept)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The CRF's negative log-likelihood per character, and its gradient by every parameter."""
        e, (vectors, both, kept) = self.emissions(ids)
        e = e.astype(np.float64)
        steps, batch, _ = e.shape
        trans, y, rows = self.p["trans"].astype(np.float64), tags.T, np.arange(batch)
        # sums over all paths up to and from each step, side by side: the latter are the former on reversed time and transitions
        both_ways, told = np.stack([trans, trans.T])[:, None], np.stack([e, e[::-1]], axis=1)
        reached = np.empty_like(told)
        reached[0] = told[0]
        for t in range(1, steps):
            reached[t] = told[t] + log_sum(reached[t - 1][..., None] + both_ways, 2)
        alpha, onward = reached[:, 0], reached[::-1, 1]
        beta = onward - e
        total = log_sum(alpha[-1], 1)
        score = e[0, rows, y[0]] + (trans[y[:-1], y[1:]] + np.take_along_axis(e[1:], y[1:, :, None], 2)[..., 0]).sum(0)
        d_trans = np.exp(alpha[:-1, :, :, None] + trans + onward[1:, :, None, :] - total[:, None, None]).sum((0, 1))
        np.add.at(d_trans, (y[:-1], y[1:]), -1)
        d_e = np.exp(alpha + beta - total[:, None])
        d_e[np.arange(steps)[:, None], rows, y] -= 1
        scale = 1 / (steps * batch)
        d_e = (d_e * scale).astype(np.float32)
        grads = {"trans": (d_trans * scale).astype(np.float32), "emit_b": d_e.sum((0, 1)), "emit": np.tensordot(both, d_e, ((0, 1), (0, 1)))}
        d_both = d_e @ self.p["emit"].T
        n = self.hidden
        d_out = np.stack([d_both[..., :n], d_both[::-1, :, n:]], axis=1)
        d_h, d_c = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        d_g = np.empty((*d_out.shape[:3], 4 * n), d_out.dtype)
        weights = self._both("h")
        d_hh, back = np.zeros_like(weights), weights.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            i, f, o, u, before, th, h = kept[t]
            d_h = d_h + d_out[t]
            d_c = d_c + d_h * o * (1 - th * th)
            d_g[t] = np.concatenate([d_c * u * i * (1 - i), d_c * before * f * (1 - f), d_h * th * o * (1 - o), d_c * i * (1 - u * u)], -1)
            d_hh += h.transpose(0, 2, 1) @ d_g[t]
            d_h, d_c = d_g[t] @ back, d_c * f
        d_vectors = d_g[:, 0] @ self.p["xf"].T + (d_g[:, 1] @ self.p["xb"].T)[::-1]
        for k, (way, told) in enumerate((("f", vectors), ("b", vectors[::-1]))):
            grads |= {f"h{way}": d_hh[k], f"b{way}": d_g[:, k].sum((0, 1)), f"x{way}": np.tensordot(told, d_g[:, k], ((0, 1), (0, 1)))}
        grads["chars"] = np.zeros_like(self.p["chars"])
        np.add.at(grads["chars"], ids.T, d_vectors)
        return float((total - score).sum() * scale), grads

    def gains(self, ids: np.ndarray) -> np.ndarray:
        """What the emission of each tag has over that of the first one: (time, other tags, batch).

        The same numbers as `emissions` gives, without what only learning needs. One tanh takes all gates, as sigmoid(x) is
        (1 + tanh(x / 2)) / 2, and the halves are put into the weights. The batch is the last axis, so a gate is one block of
        memory, and one direction is read after the other, so that what a step needs stays in a core's cache. One product a
        step takes character vectors, bias and outputs to the gates, in four parts that BLAS multiplies without copying them.
        """
        n, (rows, steps), others = self.hidden, ids.shape, TAGS - 1
        chars, halves = np.ascontiguousarray(self.p["chars"].T), np.repeat(np.array([0.5, 0.5, 0.5, 1], np.float32), n)
        emit, bias = ((x[..., 1:] - x[..., :1]) for x in (self.p["emit"] / 2, self.p["emit_b"]))
        at, dims = np.ascontiguousarray(ids.T, np.intp), len(chars)
        out, back = np.empty((steps, others, rows), np.float32), np.empty((others, rows), np.float32)
        made = np.empty((4 * n, rows), np.float32)
        into, ifo, (i, f, o, u) = made.reshape(4, n, rows), made[: 3 * n], made.reshape(4, n, rows)
        for k, way in enumerate("fb"):
            parts = (np.concatenate([self.p[f"x{way}"], self.p[f"b{way}"][None], self.p[f"h{way}"] / 2]) * halves).T.reshape(4, n, -1)
            tell = np.concatenate([bias[None] * (1 - k), emit[k * n : (k + 1) * n]]).T
            parts, tell = (np.ascontiguousarray(x, np.float32) for x in (parts, tell))
            given, c = np.zeros((dims + 1 + n, rows), np.float32), np.zeros((n, rows), np.float32)
            given[dims] = 1
            x, h, own = given[:dims], given[dims + 1 :], given[dims:]
            for t in range(steps)[:: 1 - 2 * k]:
                np.take(chars, at[t], axis=1, out=x, mode="clip")
                np.matmul(parts, given, out=into)
                np.tanh(made, out=made)
                ifo += 1
                c *= f
                c += np.multiply(i, u, out=i)
                c *= 0.5
                np.multiply(o, np.tanh(c, out=u), out=h)
                if k:
                    out[t] += np.matmul(tell, own, out=back)
                else:
                    np.matmul(tell, own, out=out[t])
        return out

    def undecided(self, gains: np.ndarray, block: int = 16) -> np.ndarray:
        """The windows whose best path may have other tags than the first one.

        A stretch of other tags gains at most what it would if at each of its characters the best tag were taken, and each tag
        were reached by its best transition. In a window where no stretch gains anything by this bound, the path that has
        the first tag throughout is the best one.
        """
        trans = self.p["trans"] - self.p["trans"][0, 0]
        begun, longer = (np.empty((len(gains), gains.shape[2]), np.float32) for _ in range(2))
        for a in range(0, len(gains), block):
            some = gains[a : a + block]
            np.max(some + trans[0, 1:, None], axis=1, out=begun[a : a + block])
            np.max(some + trans[1:, 1:].max(0)[:, None], axis=1, out=longer[a : a + block])
        away = gains[0].max(0)
        most = away.copy()
        for t in range(1, len(gains)):
            away += longer[t]
            np.maximum(away, begun[t], out=away)
            np.maximum(most, away, out=most)
        return np.flatnonzero(np.maximum(most + trans[1:, 0].max(), away) > -0.01)  # below 0, as sums are rounded

    def decode(self, ids: np.ndarray, batch: int = 1000) -> np.ndarray:
        """The best tag sequence of each window (Viterbi); most windows need no more than a bound to tell it."""
        tags = np.zeros(ids.shape, np.int8)
        at, held = [], []
        for first in range(0, len(ids), batch):
            gains = self.gains(ids[first : first + batch])
            some = self.undecided(gains)
            at.append(first + some)
            held.append(gains[:, :, some])
            many = sum(map(len, at))
            if many and (2 * many >= batch or first + batch >= len(ids)):
                tags[np.concatenate(at)] = self.best_paths(np.concatenate(held, axis=2))
                at, held = [], []
        return tags

    def best_paths(self, gains: np.ndarray) -> np.ndarray:
        """The best tag sequences by gains. Of the paths only their scores are kept; the way back looks at the tags before the one that it came from."""
        steps, _, rows = gains.shape
        best, trans, ways = np.zeros((steps, TAGS, rows), np.float32), self.p["trans"], np.empty((TAGS, TAGS, rows), np.float32)
        best[:, 1:] = gains
        for t in range(1, steps):
            best[t] += np.add(best[t - 1][:, None], trans[:, :, None], out=ways).max(0)
        best, before, tags = np.ascontiguousarray(best.transpose(0, 2, 1)), np.ascontiguousarray(trans.T), np.empty((steps, rows), np.intp)
        best[-1].argmax(1, out=tags[-1])
        for t in range(steps - 1, 0, -1):
            (best[t - 1] + before[tags[t]]).argmax(1, out=tags[t - 1])
        return tags.T


def train_tagger(windows: list[tuple[str, list[Span]]], steps: int = 700, batch: int = 48, rate: float = 0.02, seed: int = 11) -> Tagger:
    """Learns from windows of text with labelled spans, by Adam."""
    model, rng = Tagger.fresh(), np.random.default_rng(seed)
    ids = np.zeros((len(windows), WINDOW), np.int64)
    tags = np.zeros((len(windows), WINDOW), np.int64)
    for i, (text, spans) in enumerate(windows):
        got = char_ids(text[:WINDOW])
        ids[i, : len(got)] = got
        for kind, a, b in spans:
            tags[i, max(a, 0) : b] = 2 + 2 * kind
            if a >= 0:
                tags[i, a] = 1 + 2 * kind
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    for step in range(1, steps + 1):
        some = rng.integers(0, len(windows), batch)
        _, grads = model.gradients(ids[some], tags[some])
        lr = rate * (1 - step / (steps + 1))
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model.p[k] = model.p[k] - (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def plausible(kind: int, body: str) -> bool:
    """Whether text in the form of a kind passes the kind's own test."""
    digits = "".join(_DIGIT.findall(body))
    if kind == 0:
        return len(body) >= 6 and ("@" in body or re.search(_AT + ".*" + _DOT, body, re.IGNORECASE) is not None)
    if kind == 1:
        return all(int(p) <= 255 for p in re.findall("[0-9]+", body))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(re.findall("[0-9]+", body)) >= 3 and body.count("(") == body.count(")")


def labelled_texts(texts: list[str], many: int = 2500, seed: int = 17) -> list[tuple[str, list[Span]]]:
    """Short texts with labelled spans: forms of the four kinds, and look-alikes without a label, set into words of the texts."""
    rng = np.random.default_rng(seed)
    words = [w for t in texts for w in t.split() if len(w) < 20 and not re.search(r"[0-9@+]", w)] or ["word", "text", "of", "lines"]
    letters, alnum = string.ascii_lowercase, string.ascii_lowercase + string.digits
    pick = lambda pool, n: "".join(pool[k] for k in rng.integers(0, len(pool), n))
    digits = lambda n: pick(string.digits, n)
    some = lambda *of: of[int(rng.integers(0, len(of)))]
    names = [w.lower() for w in words if w.isascii() and w.isalpha() and len(w) > 2] or ["name", "some"]
    name = lambda: some(pick(letters, rng.integers(3, 9)), names[int(rng.integers(0, len(names)))])

    def email() -> str:
        at, dot = some(("@", "."), ("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), ("@", "[.]"))
        domain = dot.join([some(pick(alnum, rng.integers(3, 9)), name(), name()), *some(["example", "com"], ["org"], ["net"], ["co", "uk"], ["de"], ["com"])])
        return f"{name()}{some('', some('.', '-', '_', '') + pick(alnum, rng.integers(1, 6)))}{at}{domain}"

    def ip() -> str:
        return some(".", ".", "[.]", " . ", "(.)", " dot ", "[dot]").join(str(rng.integers(0, 256)) for _ in range(4))

    def card() -> str:
        body = digits(int(rng.integers(14, 17)) - 1)
        body += next(d for d in string.digits if luhn(body + d))
        sep = some("", " ", "-", ".", "/", "_", "  ", " - ")
        return sep.join(body[k : k + 4] for k in range(0, len(body), 4))

    def phone() -> str:
        sep = some("-", " ", ".")
        return some(
            f"+{digits(rng.integers(1, 3))} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(6)}", f"({digits(3)}) {digits(3)}-{digits(4)}",
            sep.join([digits(3), digits(3), digits(4)]), sep.join(["1", digits(3), digits(3), digits(4)]), f"00{digits(2)} {digits(2)} {digits(4)} {digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"0{digits(2)}/{digits(4)} {digits(4)}",
        )

    def other() -> str:
        year, month, day = str(rng.integers(1900, 2100)), f"{rng.integers(1, 13):02d}", f"{rng.integers(1, 29):02d}"
        clock = f"{rng.integers(0, 24):02d}:{rng.integers(0, 60):02d}"
        return some(
            digits(rng.integers(1, 7)), digits(rng.integers(8, 20)), f"{digits(2)}.{digits(2)}", f"{digits(1)}.{digits(rng.integers(4, 16))}", f"{digits(rng.integers(1, 4))},{digits(3)},{digits(3)}", f"{digits(rng.integers(1, 4))} {digits(3)} {digits(3)}",
            f'token = "{pick("abcdef" + string.digits, 30)}"', f"1+{digits(1)}", f"@{pick(letters, 5)}", f"{pick(letters, 5)}@", f"{year}-{month}-{day}", f"{day}/{month}/{year}", f"{day}.{month}.{year} {clock}", f"{year}-{month}-{day} {clock}:{digits(2)}", f"{year}{month}{day}{digits(6)}",
            "### %%% ***", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(2)}.{digits(1)}.{digits(4)}", f"{pick(string.ascii_uppercase, 2)}-{digits(4)}-{digits(4)}-{digits(4)}", f"SN {digits(4)}-{digits(6)}-{digits(3)}", f"ISBN {digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
            f"{year}-{int(year) % 100 + 1}", f"{digits(2)}x{digits(2)}x{digits(2)}", f"{digits(3)} {digits(2)} {digits(2)}", f"{digits(2)} - {digits(2)} - {digits(2)} - {digits(2)}", f"pp. {digits(3)}-{digits(3)}", f"{digits(4)} at {digits(2)} dot {digits(2)}", "look at the dot here", "a dot at its end",
        )

    made = [email, ip, card, phone]
    out = []
    for _ in range(many):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 4))):
            text += " ".join(words[k] for k in rng.integers(0, len(words), rng.integers(0, 9)))
            text += some(" ", " ", " ", ": ", "\n", " (", ' "') if text else ""
            kind = int(rng.integers(0, 8))
            inner = made[kind]() if kind < 4 else other()
            if kind < 4:
                spans.append((kind, len(text), len(text) + len(inner)))
            text += inner + some(" ", ", ", ". ", "\n", ") ", '" ')
        text += " ".join(words[k] for k in rng.integers(0, len(words), rng.integers(0, 12)))
        out.append((text, spans))
    return out


def training_windows(labelled: list[tuple[str, list[Span]]], each: int = 3, seed: int = 23) -> list[tuple[str, list[Span]]]:
    """Windows cut out of labelled texts at any place; a span that a window begins within has a start before it."""
    rng = np.random.default_rng(seed)
    out = []
    for text, spans in labelled:
        for k in range(each):
            start = int(rng.integers(0, max(1, len(text) - WINDOW // 2))) if k else 0
            inside = [(kind, a - start, min(b - start, WINDOW)) for kind, a, b in spans if b > start and a < start + WINDOW]
            out.append((text[start : start + WINDOW], inside))
    return out


def windows_of(n: int) -> list[tuple[int, int]]:
    """(start, size) of the windows of n characters: one begins every STEP, until the last character is read; the last one is padded."""
    starts = range(0, max(1, n - 2 * MARGIN), STEP) if n else ()
    return [(a, min(READ, -(-(n - a) // ROUND) * ROUND)) for a in starts]


def text_ids(text: str, most: int = 1 << 16) -> np.ndarray:
    """Classes of a text's characters, and of the padding after it."""
    told = [char_ids(text[a : a + most]) for a in range(0, len(text), most)]
    return np.concatenate([*told, np.zeros(ROUND, np.uint8)])


def tags_of(model: Tagger, texts: list[str], batch: int = 8000) -> list[np.ndarray]:
    """The model's tag of every character of every text.

    A character has it from the window in which it stands MARGIN from both ends at least, or from the one at the text's own end.
    Windows of one size are decoded together, whatever their texts; a window's tags depend on its characters alone.
    """
    ids, out = [text_ids(t) for t in texts], [np.zeros(len(t), np.int8) for t in texts]
    by_size: dict[int, list[tuple[int, int]]] = {}
    for k, text in enumerate(texts):
        for begin, size in windows_of(len(text)):
            by_size.setdefault(size, []).append((k, begin))
    for size, windows in sorted(by_size.items()):
        for first in range(0, len(windows), batch):
            some = windows[first : first + batch]
            tags = model.decode(np.stack([ids[k][begin : begin + size] for k, begin in some]))
            for row, (k, begin) in zip(tags, some):
                low = MARGIN if begin else 0
                high = READ - MARGIN if begin + READ < len(texts[k]) else len(texts[k]) - begin
                out[k][begin + low : begin + high] = row[low:high]
    return out


def tagged_spans(tags: np.ndarray) -> Iterator[Span]:
    """Runs of characters of one kind; a kind's first tag begins another."""
    places = np.flatnonzero(tags)
    told = tags[places]
    kinds = (told - 1) // 2
    opens = (np.diff(places, prepend=-2) != 1) | (np.diff(kinds, prepend=-1) != 0) | (told % 2 == 1)
    begins = np.flatnonzero(opens)
    ends = np.append(begins[1:], len(places)) - 1
    yield from zip(kinds[begins].tolist(), places[begins].tolist(), (places[ends] + 1).tolist() if len(begins) else [])


def is_free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a range touches none of an ordered list of ranges that do not overlap."""
    k = bisect_left(taken, (b, b))
    return not k or taken[k - 1][1] <= a


def added_spans(text: str, tags: np.ndarray, base: list[Span]) -> list[Span]:
    """The model's spans over a whole text, from its characters' tags.

    Of the form that a span's kind has, the longest match that lies at least half in the span and
    holds at least half of it is taken; it stays if it passes the kind's test and touches no base
    span. Such a match ends within the span's own length of it on both sides, so no more is searched.
    """
    if not tags.any():
        return []
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):  # of several kinds, so they may overlap
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    found: set[Span] = set()
    for k, a, b in tagged_spans(tags):
        reach = max(MARGIN, b - a + 3)
        best = None
        for m in _FORMS[k].finditer(text, max(0, a - reach), min(len(text), b + reach)):
            x, y = m.span()
            shared = min(b, y) - max(a, x)
            if 2 * shared >= max(y - x, b - a) and (best is None or y - x > best[1] - best[0]):
                best = x, y
        if best and plausible(k, text[best[0] : best[1]]) and is_free(taken, *best):
            found.add((k, *best))
    kept: list[Span] = []
    apart: list[tuple[int, int]] = []
    for span in sorted(found, key=lambda s: (s[1] - s[2], s)):  # of spans that overlap, the longest
        if is_free(apart, *span[1:]):
            insort(apart, span[1:])
            kept.append(span)
    return kept


def find_spans(model: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; the model reads all of it."""
    out = []
    for text, tags in zip(texts, tags_of(model, texts)):
        base = base_spans(text)
        out.append((base, sorted({*base, *added_spans(text, tags, base)})))
    return out


SPAN = "struct<kind:string,start:bigint,end:bigint,base:boolean>"


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 200, most_chars: int = 1 << 20) -> DataFrame:
    """Spans of personal data in every whole text.

    Returns key and spans (array of kind, start, end, base: code points, end exclusive, by
    kind as listed in KINDS and then by start). base spans follow the fixed rules; the
    rest are the model's, and touch neither a base span nor each other. The model is trained
    on labelled windows of generated spans and look-alikes, whose surrounding words come from
    at most `most` texts of `most_chars` characters together, one a key, those with the smallest
    md5 of the key: a bounded sample, and the model has a fixed size, so it is broadcast. A
    null or empty text has no spans. Every text, however long, is searched whole, and the model
    reads every character of it. Rows are independent: ties, repeated rows and null keys pass through; an empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.lit(0).alias("_value"))
    sample = bounded_sample(rows, smallest_keys(docs, key, most), most_chars)
    shared = spark.sparkContext.broadcast(train_tagger(training_windows(labelled_texts([t for t, _ in sample]))))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            texts = batch.to_pylist()
            found = []
            for a, b in slices(texts, 1 << 22):
                for base, spans in find_spans(model, texts[a:b]):
                    own = set(base)
                    found.append([{"kind": KINDS[k], "start": s, "end": e, "base": (k, s, e) in own} for k, s, e in spans])
            yield pa.array(found, kind)

    run = lean(run)

    @F.arrow_udf(f"array<{SPAN}>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(batches)

    return docs.select(F.col(key), spans(text_of(docs, text)).alias("spans"))
