"""Personal data by rules and by a character-level tagger.

Rules find emails, ip addresses, card and phone numbers exactly. A bidirectional
LSTM over characters with CRF transitions, trained in numpy from labelled spans
(rule matches of sampled texts and generated examples), adds spans that the rules
miss: disguised addresses, local telephone numbers, numbers that run into others.
Texts are read in overlapping windows; all windows are decoded. In an
overlap each window labels the half that lies nearer to its middle, so spans
are put together across windows into runs over the whole text. A run is added
where it touches no span of the rules and its labels lead "none" by a margin.

Positions are code points, ends exclusive. Defined results: NULL and empty texts
have no spans; repeated rows are tagged alike; an empty table gives no rows;
texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STEP = 80, 64
HIDDEN = 8
LABELS = 1 + len(KINDS)  # 0 is none
BLOCK = 4096  # windows decoded at once
MARGINS = (0.0, 0.5, 1.0, 2.0, 3.0)  # mean leads of an added run over "none" that are tried
SHORTEST, APART = 4, 6  # least length of a run, and how far apart pieces of one run may lie
REACH = 24  # characters beside a run that its words may take
TRAIN_TEXTS = 1500  # texts learned from, at most
TRAIN_CHARACTERS = 20_000  # a longer text is not learned from
TRAIN_WINDOWS = 6000

_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that fails from its start fails from within too
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits]
    doubled = [d * 2 - 9 * (d > 4) for d in values[-2::-2]]
    return (sum(values[-1::-2]) + sum(doubled)) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches end where the tail ends and begin with the run of local characters before the @."""
    found, free = [], 0
    for m in _EMAIL_TAIL.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            free = m.end()
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the rules' matches, by kind and start."""
    found = []
    if "@" in text:
        found += [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = _NO_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def described(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_APART = "@.-_%+ ()\n\t,:;/\\\"'[]<>=*#&!?|$"
#: end of text, digit, lower, upper, other ASCII, beyond ASCII, then the characters that stand for themselves
CLASSES = 6 + len(_APART)
_CLASS = np.full(129, 4, np.uint8)
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91], _CLASS[128] = 1, 2, 3, 5
_CLASS[[ord(c) for c in _APART]] = np.arange(6, CLASSES)


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _CLASS[np.minimum(points, 128)]


@dataclass(frozen=True)
class Windows:
    """Windows over texts that lie one after another; windows of a text follow each other."""

    first: np.ndarray
    end: np.ndarray  # of the window's text
    heads: np.ndarray  # characters at the window's start that the window before labels
    tails: np.ndarray


def windows(lengths: np.ndarray) -> Windows:
    count = np.where(lengths > 0, np.maximum(1, -(-(lengths - WINDOW) // STEP) + 1), 0)
    of = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.cumsum(lengths) - lengths
    half = (WINDOW - STEP) // 2
    return Windows(begin[of] + nth * STEP, (begin + lengths)[of], np.where(nth > 0, half, 0), np.where(nth < count[of] - 1, WINDOW - STEP - half, 0))


def _squash(x: np.ndarray, out: np.ndarray, work: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), a sigmoid without exponentials; a gate is half of it plus a half."""
    np.abs(x, out=work)
    work += 1
    return np.divide(x, work, out=out)


def _slope(y: np.ndarray) -> np.ndarray:
    """The derivative of ``_squash`` where its value is y."""
    return (1 - np.abs(y)) ** 2


@dataclass
class Tagger:
    """Weights by name: for each direction inputs by class and recurrent; then output and transitions."""

    w: dict[str, np.ndarray]
    margin: float = 1.0

    @staticmethod
    def new(seed: int = 5) -> Tagger:
        draw, h = np.random.default_rng(seed), HIDDEN
        w = {}
        for d in "fb":
            w[d + "x"] = (0.5 * draw.normal(0, 1, (CLASSES, 4 * h))).astype(np.float32)
            w[d + "x"][:, h : 2 * h] += 1  # remember at first
            w[d + "u"] = (draw.normal(0, 1, (h, 4 * h)) / np.sqrt(h)).astype(np.float32)
        w["o"] = (draw.normal(0, 1, (2 * h, LABELS)) / np.sqrt(2 * h)).astype(np.float32)
        w["k"] = np.zeros(LABELS, np.float32)
        w["t"] = np.zeros((LABELS, LABELS), np.float32)
        return Tagger(w)

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Label scores [WINDOW, LABELS, n] from classes [WINDOW, n]; windows lie along the last axis, so gates are contiguous."""
        w, h, n = self.w, HIDDEN, x.shape[1]
        states = np.empty((len(x), 2 * h, n), np.float32)
        kept: dict = {}
        size, cell_size = np.empty((4 * h, n), np.float32), np.empty((h, n), np.float32)
        for d, order, side in (("f", range(len(x)), slice(0, h)), ("b", range(len(x) - 1, -1, -1), slice(h, 2 * h))):
            given, u = np.ascontiguousarray(w[d + "x"].T), np.ascontiguousarray(w[d + "u"].T)
            state, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            for t in order:
                a = given.take(x[t], axis=1, mode="clip")
                a += u @ state
                _squash(a, a, size)
                gates = a[: 3 * h]
                gates *= 0.5
                gates += 0.5
                before = cell
                cell = gates[h : 2 * h] * cell
                cell += gates[:h] * a[3 * h :]
                out = _squash(cell, np.empty_like(cell), cell_size)
                if keep:
                    kept[d, t] = (state, before, a, out)
                state = np.multiply(gates[2 * h :], out, out=states[t, side])
        scores = w["o"].T @ states
        scores += w["k"][:, None]
        return (scores, states, kept) if keep else scores

    def decoded(self, scores: np.ndarray) -> np.ndarray:
        """The best labels [WINDOW, n] under the transitions."""
        trans = self.w["t"]
        best = np.zeros((len(scores), scores.shape[2]), np.uint8)
        # where "none" leads everywhere by more than transitions can give back, it is the best path
        lead = (scores[:, 0] - scores[:, 1:].max(1)).min(0)
        open_ = np.flatnonzero(lead <= 2 * float(trans.max() - trans.min()))
        if len(open_) == 0:
            return best
        s = scores[:, :, open_]
        back = np.zeros((len(s), LABELS, len(open_)), np.uint8)
        total = s[0]
        for t in range(1, len(s)):
            reach = total[:, None] + trans[:, :, None]
            back[t] = reach.argmax(0)
            total = reach.max(0) + s[t]
        at, rows = total.argmax(0), np.arange(len(open_))
        for t in range(len(s) - 1, -1, -1):
            best[t, open_] = at
            at = back[t, at, rows]
        return best

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean negative log likelihood of labels y [WINDOW, n]."""
        w, h, (length, n) = self.w, HIDDEN, x.shape
        scores, states, kept = self.emissions(x, keep=True)
        # forward and backward passes on probabilities, scaled at each character
        likely = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
        trans = np.exp(w["t"].astype(np.float64))
        ahead, behind, scale = np.empty_like(likely), np.ones_like(likely), np.empty((length, n))
        for t in range(length):
            ahead[t] = likely[t] * (trans.T @ ahead[t - 1]) if t else likely[0]
            scale[t] = ahead[t].sum(0)
            ahead[t] /= scale[t]
        for t in range(length - 2, -1, -1):
            behind[t] = trans @ (likely[t + 1] * behind[t + 1] / scale[t + 1])
        error = ahead * behind
        error[np.arange(length)[:, None], y, np.arange(n)] -= 1
        to_trans = trans * sum(ahead[t - 1] @ (likely[t] * behind[t] / scale[t]).T for t in range(1, length))
        np.subtract.at(to_trans, (y[:-1].ravel(), y[1:].ravel()), 1)
        error = (error / n).astype(np.float32)
        g = {"t": (to_trans / n).astype(np.float32), "o": np.einsum("thn,tln->hl", states, error), "k": error.sum((0, 2))}
        to_states = w["o"] @ error
        for d, order, side in (("f", range(length - 1, -1, -1), slice(0, h)), ("b", range(length), slice(h, 2 * h))):
            gu, gx = np.zeros_like(w[d + "u"]), np.zeros_like(w[d + "x"])
            to_state, to_cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            for t in order:
                state, before, a, out = kept[d, t]
                i, f, o, new = (a[k * h : (k + 1) * h] for k in range(4))
                total = to_state + to_states[t, side]
                cell = to_cell + total * o * _slope(out)
                back = np.vstack([
                    cell * new * _slope(2 * i - 1) / 2, cell * before * _slope(2 * f - 1) / 2,
                    total * out * _slope(2 * o - 1) / 2, cell * i * _slope(new),
                ])
                gu += state @ back.T
                gx += (x[t] == np.arange(CLASSES)[:, None]).astype(np.float32) @ back.T
                to_state, to_cell = w[d + "u"] @ back, cell * f
            g[d + "u"], g[d + "x"] = gu, gx
        return g

    def labels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Label of each character of the texts laid one after another, and its lead over "none"."""
        joined = np.concatenate([classes_of(t) for t in texts]) if texts else np.zeros(0, np.uint8)
        label, lead = np.zeros(len(joined), np.uint8), np.zeros(len(joined), np.float32)
        held = windows(np.array([len(t) for t in texts], np.int64))
        steps = np.arange(WINDOW)[:, None]
        for at in range(0, len(held.first), BLOCK):
            part = slice(at, at + BLOCK)
            place = held.first[part] + steps
            inside = place < held.end[part]
            scores = self.emissions(np.where(inside, joined[np.minimum(place, len(joined) - 1)], 0))
            best = self.decoded(scores)
            own = inside & (steps >= held.heads[part]) & (steps < WINDOW - held.tails[part]) & (best > 0)
            t, n = np.nonzero(own)
            label[place[t, n]] = best[t, n]
            lead[place[t, n]] = scores[t, best[t, n], n] - scores[t, 0, n]
        return label, lead


# forms that added spans must have
_HOST, _NAME = r"[A-Za-z0-9-]+", r"[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]"
_WIDE_EMAIL = re.compile(
    rf"{_NAME}[ ]?(?:@|\[at\]|\(at\))[ ]?{_HOST}(?:[ ]?(?:\.|\[dot\]|\(dot\))[ ]?{_HOST})+|{_NAME} at {_HOST}(?: dot {_HOST})+"
)
_WIDE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9])")
_WIDE_PHONE = re.compile(r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_GROUP = re.compile(r"[0-9]+")


def _wide_cards(text: str) -> list[tuple[int, int]]:
    """Digit groups one space, point, slash or hyphen apart that make 16 to 19 digits with a right check digit."""
    groups = [m.span() for m in _GROUP.finditer(text)]
    found, i = [], 0
    while i < len(groups):
        digits, j, taken = "", i, 0
        while j < len(groups) and len(digits) < 19 and (j == i or groups[j][0] - groups[j - 1][1] == 1 and text[groups[j][0] - 1] in " ./-"):
            digits += text[slice(*groups[j])]
            j += 1
            if 16 <= len(digits) <= 19 and luhn(digits):
                taken = j
                break
        if taken:
            found.append((groups[i][0], groups[taken - 1][1]))
        i = taken or i + 1
    return found


def wide_spans(kind: int, text: str) -> list[tuple[int, int]]:
    """What has the wider form of a kind."""
    if kind == 2:
        return _wide_cards(text)
    found = [m.span() for m in (_WIDE_EMAIL, _WIDE_IP, None, _WIDE_PHONE)[kind].finditer(text)]
    return [s for s in found if kind != 1 or all(int(p) <= 255 for p in _GROUP.findall(text[slice(*s)]))]


def proposed(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, mean lead) of the labelled runs of each text, near pieces of one kind together."""
    label, lead = tagger.labels(texts)
    begin = np.cumsum([0] + [len(t) for t in texts])
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    edge = np.flatnonzero(np.diff(label.astype(np.int16), prepend=0, append=0))
    edge = np.union1d(edge, begin[(begin > 0) & (begin < len(label))])
    sums = np.concatenate([[0.0], np.cumsum(lead, dtype=np.float64)])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if label[a] == 0:
            continue
        i = int(np.searchsorted(begin, a, "right")) - 1
        kind, start, end, weight = int(label[a]) - 1, int(a - begin[i]), int(b - begin[i]), float(sums[b] - sums[a])
        if out[i] and out[i][-1][0] == kind and start - out[i][-1][2] <= APART:
            _, start, _, before = out[i].pop()
            weight += before
        out[i].append((kind, start, end, weight))
    return [[(k, s, e, w / (e - s)) for k, s, e, w in runs if e - s >= SHORTEST] for runs in out]


def reconciled(text: str, runs: list[tuple[int, int, int, float]], margin: float, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that the runs add to those of the rules: apart from them and from each other."""
    found: list[tuple[int, int, int]] = []
    for kind, start, end, lead in runs:
        if lead < margin:
            continue
        low, high = max(0, start - REACH), min(len(text), end + REACH)
        for a, b in wide_spans(kind, text[low:high]):
            a, b = a + low, b + low
            cut = a == low and low > 0 and text[low - 1].isalnum() or b == high and high < len(text) and text[high].isalnum()
            if a < end and b > start and not cut and all(e <= a or s >= b for _, s, e in base + found):
                found.append((kind, a, b))
    return found


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans beyond the rules' for each text."""
    return [reconciled(t, runs, tagger.margin, b) if runs else [] for t, runs, b in zip(texts, proposed(tagger, texts), base)]


def generated(n: int = 600, seed: int = 6) -> list[str]:
    """Texts with personal data of all kinds between ordinary words; the rules label them."""
    draw = np.random.default_rng(seed)

    def word() -> str:
        return "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), draw.integers(2, 9)))

    def digits(k: int) -> str:
        return "".join(map(str, draw.integers(0, 10, k)))

    def card() -> str:
        body = digits(15)
        last = next(d for d in "0123456789" if luhn(body + d))
        sep = str(draw.choice(["", "", " ", "-"]))
        return sep.join((body + last)[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        return "+" + digits(int(draw.integers(1, 3))) + str(draw.choice([" ", "-", " ("])) + digits(3) + str(draw.choice([" ", "-", ") "])) + digits(3) + "-" + digits(4)

    def one(kind: int) -> str:
        if kind == 0:
            return f"{word()}{draw.choice(['.', '_', '', '-'])}{digits(int(draw.integers(0, 3)))}@{word()}.{draw.choice(['com', 'org', 'net', 'example.com'])}"
        if kind == 1:
            return ".".join(str(p) for p in draw.integers(0, 256, 4))
        if kind == 2:
            return card()
        if kind == 3:
            return phone()
        # near misses: numbers, prices, dates, versions, urls, handles
        return str(draw.choice([digits(int(draw.integers(1, 14))), f"{digits(2)}.{digits(2)}.{digits(4)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"@{word()}", f"http://{word()}.com/{word()}", f"{digits(3)}-{digits(4)}"]))

    def text() -> str:
        parts = [word() for _ in range(draw.integers(4, 14))]
        parts.insert(int(draw.integers(0, len(parts))), one(int(draw.integers(0, 5))))
        return " ".join(parts) + str(draw.choice([".", "", "\n"]))

    return [text() for _ in range(n)]


def missed_examples(n: int = 900, seed: int = 16) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with personal data that the rules miss, with its spans, and such that only looks alike."""
    draw = np.random.default_rng(seed)

    def word() -> str:
        return "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), draw.integers(2, 9)))

    def digits(k: int) -> str:
        return "".join(map(str, draw.integers(0, 10, k)))

    def card(gap: str) -> str:
        body = digits(15)
        body += next(d for d in "0123456789" if luhn(body + d))
        return gap.join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        gap = str(draw.choice(["-", " ", "."]))
        return str(draw.choice([f"({digits(3)}) ", f"({digits(3)})", digits(3) + gap])) + digits(3) + gap + digits(4)

    def far_phone() -> str:
        return f"+{digits(int(draw.integers(1, 3)))} ({digits(3)}) {digits(3)}-{digits(4)}"

    def address() -> str:
        at, dot = [(" @ ", " . "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", "."), (" at ", " dot "), ("@ ", "."), ("[at]", ".")][draw.integers(8)]
        return word() + str(draw.choice(["", ".", "_"])) + word() + at + word() + dot + str(draw.choice(["com", "org", "net", "example"]))

    def numbers() -> str:
        return str(draw.choice(["[.]", "(.)", " . "])).join(str(p) for p in draw.integers(0, 256, 4))

    def one() -> list[tuple[int | None, str]]:
        kind = draw.integers(0, 9)
        if kind < 2:
            return [(0, address())]
        if kind == 2:
            return [(1, numbers())]
        if kind == 3:
            return [(2, card(str(draw.choice([".", "/"]))))]
        if kind == 4:
            return [(2, card("")), (None, " "), (2, card(""))]
        if kind == 5:
            return [(3, phone())]
        if kind == 6:
            return [(3, far_phone()), (None, " "), (2, card(""))]
        if kind == 7:
            return [(3, far_phone()), (None, " "), (1, ".".join(str(p) for p in draw.integers(0, 256, 4)))]
        # looks alike and is none
        return [(None, str(draw.choice([f"{word()} at {word()}.", digits(16), f"{digits(3)} {digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"[{word()}]", f"({digits(4)})", f"{word()} @ {digits(2)}"])))]

    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(draw.integers(1, 8))) + " ", []
        for k, piece in one():
            if k is not None:
                spans.append((k, len(text), len(text) + len(piece)))
            text += piece
        text += str(draw.choice([" ", ". ", ", ", "\n"])) + " ".join(word() for _ in range(draw.integers(0, 8)))
        base = base_spans(text)
        out.append((text, [s for s in spans if all(e <= s[1] or a >= s[2] for _, a, e in base)]))
    return out


def training_windows(texts: list[str | tuple[str, list[tuple[int, int, int]]]], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Classes and labels [WINDOW, n]: windows with spans first, then such with digits or @, then others.

    A text may come with spans beyond those of the rules.
    """
    draw, x, y = np.random.default_rng(seed), [], []
    for text in texts:
        text, more = text if isinstance(text, tuple) else (text, [])
        if not text:
            continue
        label = np.zeros(len(text), np.int64)
        for k, a, b in base_spans(text) + more:
            label[a:b] = k + 1
        held = windows(np.array([len(text)]))
        place = held.first + np.arange(WINDOW)[:, None]
        inside = place < len(text)
        place = np.minimum(place, len(text) - 1)
        x.append(np.where(inside, classes_of(text)[place], 0))
        y.append(np.where(inside, label[place], 0))
    x, y = np.concatenate(x, 1), np.concatenate(y, 1)
    marked = (y > 0).any(0) * 2 + ((x == 1) | (x == 6)).any(0)
    order = np.lexsort((draw.random(x.shape[1]), -np.minimum(marked, 2)))
    taken = np.concatenate([order[: TRAIN_WINDOWS * 2 // 3], draw.permutation(order[TRAIN_WINDOWS * 2 // 3 :])[: TRAIN_WINDOWS // 3]])
    return x[:, taken], y[:, taken]


def train(texts: list[str], rounds: int = 20, least_steps: int = 400, seed: int = 8) -> Tagger:
    """Adam on the likelihood of the labels; a small sample gets more rounds."""
    x, y = training_windows([*texts, *generated(), *missed_examples()])
    rounds = max(rounds, least_steps // max(1, x.shape[1] // 128))
    tagger, draw, steps = Tagger.new(), np.random.default_rng(seed), 0
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in tagger.w.items()}
    for round_ in range(rounds):
        rate = 0.04 * 0.5 * (1 + np.cos(np.pi * round_ / rounds)) + 0.001
        for part in np.array_split(draw.permutation(x.shape[1]), max(1, x.shape[1] // 128)):
            steps += 1
            for k, g in tagger.gradients(x[:, part], y[:, part]).items():
                g = np.clip(g, -1, 1)
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                tagger.w[k] -= (rate * m / (1 - 0.9**steps) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)
    held_out = missed_examples(400, seed=17)
    runs = proposed(tagger, [t for t, _ in held_out])
    scores = [agreement(held_out, [reconciled(t, r, m, base_spans(t)) for (t, _), r in zip(held_out, runs)]) for m in MARGINS]
    tagger.margin = MARGINS[int(np.argmax([2 * p * r / max(p + r, 1e-9) for p, r in scores]))]
    return tagger


def agreement(marked: list[tuple[str, list[tuple[int, int, int]]]], found: list[list[tuple[int, int, int]]]) -> tuple[float, float]:
    """Precision and recall of spans that must agree in kind, start and end."""
    right = sum(len(set(s) & set(f)) for (_, s), f in zip(marked, found))
    return right / max(1, sum(map(len, found))), right / max(1, sum(len(s) for _, s in marked))


def learn(docs: DataFrame) -> Tagger:
    """Train on at most TRAIN_TEXTS texts of the lowest hashes that may hold personal data, and generated ones."""
    maybe = F.col("text").rlike(r"@[A-Za-z0-9-]+\.|[0-9][ -]?[0-9]{3}")
    usable = docs.select("text").where(maybe & (F.length("text") <= TRAIN_CHARACTERS)).withColumn("h", F.xxhash64("text"))
    # the lowest hashes are found first, so that texts above them stay where they are
    cut = usable.select("h").orderBy("h").limit(TRAIN_TEXTS).agg(F.max("h").alias("h")).first()["h"]
    got = usable.where(F.col("h") <= F.lit(cut)).orderBy("h", "text").limit(TRAIN_TEXTS).select("text").toArrow()
    return train(got["text"].to_pylist())


def all_spans(tagger: Tagger, texts: list[str | None]) -> list[tuple[list, list]]:
    """For each text the spans of the rules and those that the tagger adds."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    return list(zip(base, added_spans(tagger, texts, base)))


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs (doc_id, text)."""
    tagger = learn(docs)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = all_spans(tagger, batch.column("text").to_pylist())
            counts = np.array([np.bincount([s[0] for s in b + m], minlength=len(KINDS)) for b, m in found], np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *[pa.array(counts[:, k]) for k in range(len(KINDS))],
                    pa.array([hashlib.sha256(described(b).encode()).hexdigest() for b, _ in found]),
                    pa.array([described(b + m) for b, m in found]),
                ],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

        return step

    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return map_batches(docs.select("doc_id", "text"), make, schema)


def masked_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, joined where they overlap, replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """The documents with personal data masked and ``n_chars``, where there, counted anew; all rows and columns stay."""
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            fields = row.flatten()
            names = [f.name for f in row.type]
            texts = fields[names.index("text")].to_pylist()
            new = [t if not t else masked_text(t, b + m) for t, (b, m) in zip(texts, all_spans(tagger, texts))]
            fields[names.index("text")] = pa.array(new, row.type.field("text").type)
            if "n_chars" in names:
                old = fields[names.index("n_chars")]
                counted = [n if a == b else len(b) for n, a, b in zip(old.to_pylist(), texts, new)]
                fields[names.index("n_chars")] = pa.array(counted, old.type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(row.type))], ["row"])

    return held.mapInArrow(run, held.schema).select("row.*")
