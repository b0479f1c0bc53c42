"""Personal data by a semi-Markov conditional random field (Sarawagi and Cohen, 2004) beside fixed patterns.

The patterns (e-mail addresses, IP addresses, payment cards, telephone numbers) decide by themselves; the field adds what
they miss, such as numbers without their prefix, in odd groups, or addresses that were spelled out. A text's stretches
around digits and at-signs are cut into tokens. Each run of up to ``MOST`` tokens is a candidate for each kind, scored by
features of the whole run: how many digits in how many groups, the check digit, signs, what it touches, cue words before it. Dynamic
programming over runs and kinds picks boundaries and kinds jointly. Weights are fitted in numpy by the exact likelihood, with
forward and backward sums over the same lattice, on a bounded sample of texts that the patterns label, and on made-up
lines with forms that these don't know and with numbers of other sorts.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Tokens and characters in a candidate, at most.
MOST, WIDEST = 16, 64

# the patterns; each is linear in the text: groups are taken whole, and a search can't start inside one
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    twice = [int(c) for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in twice)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches of the patterns, by start, then kind; leftmost and non-overlapping for each kind."""
    out, done, run = [], 0, 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, 0, done))
        else:
            done = at + 1  # no match can hold this sign
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Where a candidate may be: it holds one of these.
TRIGGER = r"[0-9@]|[\[({] ?[aA][tT] ?[\])}]|\b[aA][tT] [^\n]{1,40} [dD][oO][tT]\b"
_TRIGGER = re.compile(TRIGGER)
_TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|\S")
_SIGNS = {"@": 2, ".": 3, "+": 4, "(": 5, ")": 6, "-": 7}
DIGITS, LETTERS, AT, DOT, PLUS, OPEN, CLOSE, HYPHEN, OTHER, SAID_AT, SAID_DOT = range(11)
_SAID = {"at": SAID_AT, "dot": SAID_DOT}
_CUES = {
    **dict.fromkeys(("mail", "email", "contact", "write", "correo", "courriel", "kontakt", "schreiben"), 1),
    **dict.fromkeys(("ip", "host", "server", "address", "servidor", "serveur", "adresse"), 2),
    **dict.fromkeys(("card", "visa", "mastercard", "tarjeta", "carte", "karte"), 3),
    **dict.fromkeys(("phone", "tel", "call", "fax", "mobile", "telefono", "teléfono", "téléphone", "telefon", "handy"), 4),
}


class Tokens:
    """The tokens of stretches around triggers, over many texts; a stretch never runs over a line's end."""

    def __init__(self):
        self.text, self.start, self.end, self.kind, self.stretch, self.gap, self.cue = [], [], [], [], [], [], []
        self.n, self.texts = 0, []

    def add(self, text: str) -> None:
        """Cuts a text; every candidate with a trigger in it lies within a stretch."""
        k, spans = len(self.texts), []
        self.texts.append(text)
        for m in _TRIGGER.finditer(text):
            a, z = max(0, m.start() - WIDEST), min(len(text), m.end() + WIDEST)
            a, z = max(a, text.rfind("\n", a, m.start()) + 1), (text.find("\n", m.end(), z) + 1 or z + 1) - 1
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(z, spans[-1][1])
            else:
                spans.append([a, z])
        for a, z in spans:
            last, cue, since = a, 0, 9
            for m in _TOKEN.finditer(text, a, z):
                s, e = m.span()
                c = text[s]
                since += 1
                if "0" <= c <= "9":
                    kind = DIGITS
                elif c.isalpha():
                    low = m[0].lower() if e - s <= 12 else ""
                    kind = _SAID.get(low, LETTERS)
                else:
                    kind, low = _SIGNS.get(c, OTHER), ""
                self.text.append(k)
                self.start.append(s)
                self.end.append(e)
                self.kind.append(kind)
                self.stretch.append(self.n)
                self.gap.append(s > last)
                self.cue.append(cue if since <= 4 else 0)
                if kind == LETTERS and low in _CUES:
                    cue, since = _CUES[low], 0
                last = e
            self.n += 1

    def arrays(self) -> None:
        for x in ("text", "start", "end", "kind", "stretch", "gap", "cue"):
            setattr(self, x, np.array(getattr(self, x), np.int64))


#: Sizes of the features, which are one number each: digits, groups of them, letters, signs at and dots, the same spelled out, plus, brackets,
#: hyphens, others, gaps, first and last token, what is touched on the left and right, groups over 255, check digit, cue, tokens, last three groups.
_SIZES = (21, 9, 7, 15, 6, 3, 3, 5, 5, 7, 121, 12, 12, 4, 3, 5, MOST + 1, 217)
_FROM = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])
N_FEATURES = sum(_SIZES)


def candidates(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, tokens, features) of all candidates; features are places in the weights."""
    n = len(t.kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(_SIZES)), np.int64)
    up = lambda x: np.concatenate([[0], np.cumsum(x)])
    size = np.where(t.kind == DIGITS, t.end - t.start, 0)
    big = np.zeros(n, bool)
    for i in np.flatnonzero(size == 3).tolist():
        big[i] = t.texts[t.text[i]][t.start[i] : t.end[i]] > "255"
    big |= size > 3
    sums = {k: up(t.kind == k) for k in range(11)}
    digits, over, gaps = up(size), up(big), up(t.gap)
    # sizes of the last three groups of digits up to each token
    groups = np.flatnonzero(size)
    upto = np.searchsorted(groups, np.arange(n), side="right")
    padded = np.concatenate([[0, 0, 0], np.minimum(size[groups], 5)])
    tail = padded[upto + 2] + 6 * padded[upto + 1] + 36 * padded[upto]
    left = np.where((np.arange(n) > 0) & (t.stretch == np.roll(t.stretch, 1)) & (t.gap == 0), np.roll(t.kind, 1) + 1, 0)
    right = np.roll(left, -1) * 0
    right[:-1] = np.where((t.stretch[1:] == t.stretch[:-1]) & (t.gap[1:] == 0), t.kind[1:] + 1, 0)
    opens = np.isin(t.kind, (DIGITS, LETTERS, PLUS, OPEN))
    closes = np.isin(t.kind, (DIGITS, LETTERS))
    first, many, feats = [], [], []
    for m in range(1, min(MOST, n) + 1):
        i = np.arange(n - m + 1)
        j = i + m
        has = lambda k: sums[k][j] - sums[k][i]  # noqa: B023, E731
        nd = digits[j] - digits[i]
        ok = opens[i] & closes[j - 1] & (t.stretch[i] == t.stretch[j - 1]) & (t.end[j - 1] - t.start[i] <= WIDEST)
        ok &= (nd > 0) | (has(AT) > 0) | ((has(SAID_AT) > 0) & (has(SAID_DOT) + has(OPEN) + has(OTHER) > 0))
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        nd = nd[ok]
        inner = gaps[j] - gaps[i + 1]
        n_groups, n_letters, other = has(DIGITS), has(LETTERS), has(OTHER)
        check = np.zeros(len(i), np.int64)
        plain = (nd >= 14) & (nd <= 19) & (n_letters + has(AT) + has(PLUS) + has(SAID_AT) == 0)
        for x in np.flatnonzero(plain).tolist():
            check[x] = 1 + luhn(_digits(t.texts[t.text[i[x]]][t.start[i[x]] : t.end[j[x] - 1]]))
        pairs = has(OPEN) - has(CLOSE)
        cols = (
            np.minimum(nd, 20),
            np.minimum(n_groups, 8),
            np.minimum(n_letters, 6),
            np.minimum(has(AT), 2) * 5 + np.minimum(has(DOT), 4),
            np.minimum(has(SAID_AT), 1) * 3 + np.minimum(has(SAID_DOT), 2),
            np.where(has(PLUS) == 0, 0, np.where((t.kind[i] == PLUS) & (has(PLUS) == 1), 1, 2)),
            np.where(has(OPEN) + has(CLOSE) == 0, 0, np.where((pairs == 0) & (has(OPEN) == 1), 1, 2)),
            np.minimum(has(HYPHEN), 4),
            np.minimum(other, 4),
            np.minimum(inner, 6),
            t.kind[i] * 11 + t.kind[j - 1],
            left[i],
            right[j - 1],
            2 * (n_groups == 4) + (over[j] > over[i]),
            check,
            t.cue[i],
            np.full(len(i), m),
            np.where(n_groups >= 3, 1 + tail[j - 1], 0),
        )
        first.append(i)
        many.append(np.full(len(i), m))
        feats.append(np.stack(cols, 1) + _FROM)
    cat = lambda x, empty: np.concatenate(x) if x else empty
    return cat(first, np.zeros(0, np.int64)), cat(many, np.zeros(0, np.int64)), cat(feats, np.zeros((0, len(_SIZES)), np.int64))


LOW = -1e30


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


class Lattice:
    """All ways to cut padded stretches into outside tokens and candidates: scores is (stretch, token, tokens - 1, kind)."""

    def __init__(self, scores: np.ndarray, length: np.ndarray, moves: np.ndarray):
        self.s, self.length, self.moves = scores, length, moves.astype(scores.dtype)

    def forward(self, join=_sum, both=np.logaddexp):
        n, width, most, kinds = self.s.shape
        alpha = np.full((n, width + 1 + most, kinds + 1), LOW, self.s.dtype)
        enter = np.empty((n, width, kinds + 1), self.s.dtype)
        for t in range(width):
            enter[:, t] = join(alpha[:, t, :, None] + self.moves, 1) if t else 0.0
            alpha[:, t + 1, kinds] = enter[:, t, kinds]
            part = alpha[:, t + 1 : t + 1 + most, :kinds]
            part[...] = both(part, enter[:, t, None, :kinds] + self.s[:, t])
        return alpha, enter

    def expected(self):
        """(candidates' chances, moves' expected counts)."""
        n, width, most, kinds = self.s.shape
        alpha, enter = self.forward()
        z = _sum(alpha[np.arange(n), self.length], 1)
        beta = np.zeros((n, width + 1 + most, kinds + 1), self.s.dtype)
        chance = np.zeros_like(self.s)
        moved = np.zeros_like(self.moves)
        for t in range(width - 1, -1, -1):
            on = t < self.length
            ahead = self.s[:, t] + beta[:, t + 1 : t + 1 + most, :kinds]
            inner = np.concatenate([_sum(ahead, 1), beta[:, t + 1, kinds:]], 1)
            beta[:, t] = np.where(on[:, None], _sum((self.moves + inner[:, None, :]).transpose(0, 2, 1), 1), 0)
            chance[:, t] = np.where(on[:, None, None], np.exp(enter[:, t, None, :kinds] + ahead - z[:, None, None]), 0)
            if t:
                step = np.exp(alpha[:, t, :, None] + self.moves + inner[:, None, :] - z[:, None, None])
                moved += step[on].sum(0)
        return chance, moved

    def best(self) -> list[tuple[int, int, int, int]]:
        """(stretch, first token, tokens, kind) of the candidates on each stretch's best way."""
        n, width, most, kinds = self.s.shape
        alpha, enter = self.forward(lambda x, axis: x.max(axis), np.maximum)
        out = []
        for b in range(n):
            t = int(self.length[b])
            label = int(alpha[b, t].argmax())
            while t > 0:
                m = 1
                if label < kinds:
                    sizes = np.arange(1, min(most, t) + 1)
                    m = int(sizes[np.argmax(enter[b, t - sizes, label] + self.s[b, t - sizes, sizes - 1, label])])
                    out.append((b, t - m, m, label))
                t -= m
                if t:
                    label = int((alpha[b, t] + self.moves[:, label]).argmax())
        return out


class Model:
    """weights (feature, kind) and moves (label before, label), the last label being outside."""

    def __init__(self):
        self.weights = np.zeros((N_FEATURES, len(KINDS)))
        self.moves = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def scores(self, feats: np.ndarray) -> np.ndarray:
        """Scores by kind; a card whose check digit is wrong and an IP address with a part over 255 are impossible."""
        out = np.zeros((len(feats), len(KINDS)), np.float32)
        if not len(feats):
            return out
        weights = self.weights.astype(np.float32)
        for k in range(feats.shape[1]):
            out += weights[feats[:, k]]
        own = feats - _FROM
        out[own[:, 14] != 2, 2] = LOW
        out[own[:, 13] & 1 == 1, 1] = LOW
        return out

    def spans(self, texts: list[str], most: int = 1 << 14) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) on the best way through each text."""
        t = Tokens()
        for x in texts:
            t.add(x)
        t.arrays()
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not t.n:
            return out
        i, m, feats = candidates(t)
        order = np.argsort(i, kind="stable")
        i, m, s = i[order], m[order], self.scores(feats[order])
        begin = np.searchsorted(t.stretch, np.arange(t.n + 1))
        length = np.diff(begin)
        by_length = np.argsort(length, kind="stable")
        at = 0
        while at < t.n:  # stretches of like length together
            to = at + 1
            while to < t.n and (to + 1 - at) * length[by_length[to]] <= most:
                to += 1
            rows = by_length[at:to]
            padded = np.full((len(rows), max(1, int(length[rows[-1]])), MOST, len(KINDS)), LOW, np.float32)
            for b, r in enumerate(rows.tolist()):
                own = slice(*np.searchsorted(i, (begin[r], begin[r + 1])))
                padded[b, i[own] - begin[r], m[own] - 1] = s[own]
            for b, first, n, kind in Lattice(padded, length[rows], self.moves).best():
                x = begin[rows[b]] + first
                out[t.text[x]].append((int(t.start[x]), kind, int(t.end[x + n - 1])))
            at = to
        return out


def fit(labelled: list[tuple[str, list[tuple[int, int, int]]]], *, rounds: int = 40, rate: float = 0.3, prior: float = 0.02, longest: int = 80, parts: int = 6) -> Model:
    """A model of texts with their spans; stretches over ``longest`` tokens, or with a span that no candidate fits, are left out."""
    t, gold_of = Tokens(), []
    for x, spans in labelled:
        t.add(x)
        gold_of.append(spans)
    t.arrays()
    i, m, feats = candidates(t)
    begin = np.searchsorted(t.stretch, np.arange(t.n + 1))
    length = np.diff(begin)
    place = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(i, m))}
    starts = {(int(k), int(s)): n for n, (k, s) in enumerate(zip(t.text, t.start))}
    ends = {(int(k), int(e)): n for n, (k, e) in enumerate(zip(t.text, t.end))}
    bad, gold = length > longest, []
    bad |= length == 0
    stretch_of = {}
    for n, k in enumerate(t.stretch[begin[:-1][length > 0]].tolist()):
        stretch_of.setdefault(int(t.text[begin[k]]), []).append(k)
    for k, spans in enumerate(gold_of):
        for s, kind, e in spans:
            a, z = starts.get((k, s)), ends.get((k, e))
            c = place.get((a, z - a + 1)) if a is not None and z is not None else None
            if c is None:
                for r in stretch_of.get(k, ()):
                    bad[r] |= t.start[begin[r]] < e and t.end[begin[r + 1] - 1] > s
            else:
                gold.append((c, kind))
    model = Model()
    rows = np.flatnonzero(~bad)
    if not len(rows):
        return model
    rows = rows[np.argsort(length[rows], kind="stable")]
    row_of = np.full(t.n, -1)
    row_of[rows] = np.arange(len(rows))
    kept = row_of[t.stretch[i]] >= 0
    number = np.cumsum(kept) - 1
    gold = [(number[c], kind) for c, kind in gold if kept[c]]
    i, m, feats = i[kept], m[kept], feats[kept]
    b, at = row_of[t.stretch[i]], i - begin[t.stretch[i]]
    size = length[rows]

    want, want_moves = np.zeros_like(model.weights), np.zeros_like(model.moves)
    labels = [np.full(n, len(KINDS)) for n in size]
    first = [np.ones(n, bool) for n in size]  # where segments begin
    for c, kind in gold:
        np.add.at(want[:, kind], feats[c], 1)
        labels[b[c]][at[c] : at[c] + m[c]] = kind
        first[b[c]][at[c] + 1 : at[c] + m[c]] = False
    for own, begins in zip(labels, first):
        np.add.at(want_moves, (own[begins][:-1], own[begins][1:]), 1)

    # stretches of like length are padded together
    cuts = np.unique(np.linspace(0, len(rows), parts + 1).astype(np.int64))
    chunks = [(slice(x, y), np.flatnonzero((b >= x) & (b < y))) for x, y in zip(cuts[:-1], cuts[1:])]
    scale = 1 / len(rows)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (model.weights, model.moves)]
    for step in range(1, rounds + 1):
        have, moved = np.zeros_like(want), np.zeros_like(want_moves)
        for own, c in chunks:
            padded = np.full((own.stop - own.start, int(size[own].max()), MOST, len(KINDS)), LOW, np.float32)
            where = b[c] - own.start, at[c], m[c] - 1
            padded[where] = model.scores(feats[c])
            chance, part = Lattice(padded, size[own], model.moves).expected()
            moved += part
            p = chance[where]
            for k in range(len(KINDS)):
                have[:, k] += np.bincount(feats[c].ravel(), np.repeat(p[:, k], feats.shape[1]), N_FEATURES)
        for x, slope, (mean, var) in zip((model.weights, model.moves), ((want - have - prior * model.weights) * scale, (want_moves - moved - prior * model.moves) * scale), state):
            mean *= 0.9
            mean += 0.1 * slope
            var *= 0.99
            var += 0.01 * slope * slope
            x += rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-6)
    return model


def _made_card(rng: random.Random, right: bool) -> str:
    body = rng.choice(("4", "51", "37", "6011")) + "".join(rng.choice("0123456789") for _ in range(15))
    body = body[:15]
    last = next(d for d in "0123456789" if luhn(body + d))
    return body + (last if right else rng.choice([d for d in "0123456789" if d != last]))


def made_lines(words: list[str], n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Lines of words with one or two insertions: personal data in the patterns' forms and in others, and numbers of other sorts."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(c for c in rng.choice(words).lower() if "a" <= c <= "z") or "name"

    def email() -> str:
        name, host, top = rng.choice((word(), f"{word()}.{num(2)}", f"{word()}.{word()}")), rng.choice((word(), f"mail{num(1)}.{word()}")), rng.choice(("com", "org", "de", "fr", "es", "net"))
        at, dot = rng.choice((("@", "."), (" [at] ", "."), (" (at) ", " (dot) "), (" at ", " dot "), (" @ ", "."), ("[at]", "[dot]"), ("(at)", ".")))
        return f"{name}{at}{host}{dot}{top}"

    def ip() -> str:
        return rng.choice((".", "[.]", ".", "(.)", " . ")).join(str(rng.randrange(1, 256)) for _ in range(4))

    def card() -> str:
        c = _made_card(rng, True)
        return rng.choice(("", " ", "-", ".", "/", "  ")).join(c[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"00 1 {a} {b} {c}", f"+1/{a}/{b}/{c}", f"1-{a}-{b}-{c}", f"({a}) {b}.{c}", f"+ 1 {a} {b} {c}"))

    def none() -> str:
        y, wrong = rng.randrange(1900, 2100), _made_card(rng, False)
        zeros = "0" + num(15)
        return rng.choice(
            (
                str(y),
                f"{y}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}",
                f"{rng.randrange(24)}:{rng.randrange(60):02}",
                f"{rng.randrange(9)}.{rng.randrange(9)}",
                f"v{rng.randrange(9)}.{rng.randrange(30)}.{rng.randrange(30)}",
                f"{num(2)},{num(3)} $",
                wrong,
                " ".join(wrong[k : k + 4] for k in range(0, 16, 4)),
                zeros if not luhn(zeros) else zeros[:-1] + str((int(zeros[-1]) + 1) % 10),
                "token = \"" + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"',
                "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(18)),
                "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)),
                f"{num(3)}-{num(3)}",
                f"{num(2)} | {num(3)} | {num(4)}",
                f"({num(1)})",
                f"at {num(2)} dot {word()}",
                f"@{word()}",
                f"{word()} at. {word()}",
                f"at {num(4)}",
                num(7),
                num(10),
                f"{num(3)} {num(3)} {num(4)}",
                f"{rng.randrange(300, 999)}.{num(2)}.{num(2)}.{num(2)}",
                f"{num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(1)}",
                "0x" + num(6),
                f"https://{word()}.com/{num(5)}",
            )
        )

    makers = ((email, 0), (ip, 1), (card, 2), (phone, 3))
    out = []
    for _ in range(n):
        parts, spans, at = [], [], 0
        for k in range(rng.choice((1, 1, 2))):
            for w in [rng.choice(words) for _ in range(rng.randrange(0, 9))]:
                parts.append(w + " ")
            at = sum(map(len, parts))
            make, kind = (none, None) if rng.random() < 0.5 else rng.choice(makers)
            x = make()
            parts.append(x)
            if kind is not None:
                spans.append((at, kind, at + len(x)))
            parts.append(rng.choice((" ", ". ", ", ", " | ", "\n", "!! ")))
        parts.extend(rng.choice(words) + " " for _ in range(rng.randrange(0, 9)))
        out.append(("".join(parts), spans))
    return out


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of which none overlap: longer ones first."""
    out: list[tuple[int, int, int]] = []
    for s in sorted(spans, key=lambda x: (x[0] - x[2], x)):
        if all(s[2] <= o[0] or o[2] <= s[0] for o in out):
            out.append(s)
    return out


def train(docs: DataFrame, *, sample: int = 200, max_chars: int = 4000, made: int = 600, text_col: str = "text") -> Model:
    """Fits a model on at most ``sample`` texts of up to ``max_chars`` characters with digits or at-signs, as the patterns label them, and ``made`` made-up lines.

    Which texts goes by a hash of the text, so reruns agree whatever the rows' order; equal texts count once. Without any
    such texts the made-up lines are all there is.
    """
    t = docs.select(F.col(text_col).cast("string").alias("text")).filter((F.length("text") <= max_chars) & F.col("text").rlike(r"[0-9@]"))
    t = t.withColumn("h", F.xxhash64("text"))
    least = t.select("h").distinct().orderBy("h").limit(sample)  # numbers alone are gathered, then ``sample`` texts
    texts = [r["text"] for r in t.join(F.broadcast(least), "h").groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()]
    words = sorted({w for x in texts for w in re.findall(r"[^\W\d_]+", x) if len(w) <= 12}) or ["the", "name", "of", "and", "box", "under", "with", "from"]
    return fit([(x, _apart(patterns(x))) for x in texts] + made_lines(words, made))


def merged(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """All of ``base``, and those of ``more`` that overlap none of it, by start, kind and end."""
    ends = sorted((s, e) for s, _, e in base)
    starts, upto = np.array([s for s, _ in ends]), np.maximum.accumulate(np.array([e for _, e in ends] or [0]))
    out = [(*x, True) for x in base]
    for s, kind, e in more:
        k = int(np.searchsorted(starts, e, "left"))  # base spans that begin before this one ends
        if not k or upto[k - 1] <= s:
            out.append((s, kind, e, False))
    return sorted(out)


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span as its kind in brackets; of overlapping ones the first names the whole."""
    out, at = [], 0
    for s, kind, e, _ in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _found(batches, shared, redact: bool):
    import pyarrow as pa
    import pyarrow.compute as pc

    model = shared.value
    for whole in batches:
        for part in common.slices(whole, "text"):
            texts = pc.fill_null(part.column(1), "")
            some = np.flatnonzero(pc.match_substring_regex(texts, TRIGGER).to_numpy(zero_copy_only=False))
            held = texts.take(pa.array(some)).to_pylist()
            spans: list[list] = [[] for _ in range(len(part))]
            for k, text, more in zip(some.tolist(), held, model.spans(held)):
                spans[k] = merged(patterns(text), more)
            flat = [x for own in spans for x in own]
            cols = [pa.array([KINDS[x[1]] for x in flat], pa.string()), *(pa.array([x[k] for x in flat], kind) for k, kind in ((0, pa.int64()), (2, pa.int64()), (3, pa.bool_())))]
            upto = pa.array(np.cumsum([0, *map(len, spans)]).astype(np.int32))
            out = [part.column(0), pa.ListArray.from_arrays(upto, pa.StructArray.from_arrays(cols, ["kind", "start", "end", "base"]))]
            if redact:
                out.append(pa.array([redacted(t, s) if s else t for t, s in zip(part.column(1).to_pylist(), spans)], pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["id", "spans", *["redacted"] * redact])


def find(docs: DataFrame, model: Model | None = None, *, redact: bool = False, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, spans) of every row: spans are (kind, start, end, base) in code points, end exclusive, by start, kind and end.

    ``base`` tells the patterns' spans, of which kinds may overlap; those of the field overlap no other. With ``redact`` the text comes
    too, with spans replaced by their kinds. Null and empty texts have no spans (a null text stays null). Rows of one id are
    rows each, in any order; an empty table gives an empty result. Other columns don't matter, whatever their names. Without ``model`` one is trained on ``docs``.
    """
    if model is None:
        model = train(docs, text_col=text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(d.dtypes)["id"]
    schema = f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>" + (", redacted string" if redact else "")
    return common.arrow_map(d, lambda it: _found(it, shared, redact), schema)


def listed(spans: Column) -> Column:
    """kind:start:end of spans in their order, with commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
