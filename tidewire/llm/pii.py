"""Personal data: exact patterns, and what a linear-chain conditional random field adds.

The base finds emails, IPv4 addresses, card numbers and phone numbers by pattern, leftmost and not
overlapping per kind, and drops matches that fail their test. Its spans stay. The field labels every token
(runs without white space) of the whole text by the shapes of the word and its neighbours, and by whether a
key word and an assignment stand before it; it adds ``secret`` spans: keys, tokens and passwords, without
quotes around them. Its label for the base's kinds tells secrets from what else has digits or follows a key
word; what it marks and the base doesn't has failed the base's test, and isn't added. The field is trained on TABLE
by gradient ascent on the regularised likelihood, with forward and backward sums over all its sequences at
once, and decoded by Viterbi over all texts of a batch at once. A text of over BLOCK tokens is cut in
blocks, each decoded once for every label that may stand before it; joining them is exact, too.

Features depend on a token's shape only, so a worker keeps a row of scores for each shape it has met and
the shape of each word of up to 64 characters, both bounded.

Spans are in code points, the end exclusive. Defined cases: a null text counts as an empty one and has
no spans. A null doc_id is passed on. Repeated rows give repeated results, an empty table none. Of equally
good labellings the one with the earlier label in LABELS is taken. Texts are read whole, whatever their
length, in time proportional to it. Extra columns are passed on by ``redact``, and ignored by ``find``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.base import caches, enter
from tidewire.llm.bpe import parted

KINDS = ("email", "ip", "card", "phone", "secret")
#: Of the field: nothing, one of the kinds of the base, a secret.
LABELS = ("other", "known", "secret")
#: Tokens of a text beyond which it is decoded in blocks, and texts' tokens that are decoded at a time.
BLOCK, BATCH = 2048, 2_000_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
#: Sum of the digits of twice a digit.
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

#: Labelled sequences; a token is other unless a label and a colon stand before it. Braces are drawn: a word,
#: hex digits, letters and digits, letters of both cases, lower-case letters, an email, an address, a card, a
#: phone number, a number, a year, a time.
TABLE = """
{w} {w} token = secret:"{hex}" {w} {w}
{w} {w}. token = secret:'{hex}' {w} {w}
{w} token: secret:{hex} {w} {w}
{w} | {w} | token = secret:"{hex}" | {w} | {w}
{w} {w} {w} secret:token="{hex}" {w} {w}
{w} api_key = secret:"{mix}" {w} {w}
{w} {w} api_key: secret:{mix} {w}.
{w} {w} secret = secret:"{mix}" {w} {w}
{w} secret_key = secret:"{hex}"! {w}
{w} {w} password = secret:"{mix}" {w}
{w} password: secret:{mix} {w} {w}
{w} key = secret:"{hex}" {w} {w}
{w} access_token: secret:"{mix}" {w} {w}
{w} Authorization: Bearer secret:{mix} {w}
{w} card:{card} token = secret:"{hex}" {w}
{w} email:{email} token = secret:"{hex}" {w} {w}
{w}&&& {w}%%% token = secret:"{hex}"### {w}***
TOKEN = secret:"{hex}"!! {w} {w}
{w} password = secret:"{cased}" {w} {w}
{w} {w} api_key = secret:"{cased}" {w}
{w} token: secret:{cased} {w} {w}
{w} Authorization: Bearer secret:{cased} {w}
{w} {w} secret = secret:'{cased}' {w}
{w} {w} secret:password="{cased}" {w}
{w} password = secret:"{lower}" {w} {w}
{w} {w} passwd: secret:"{lower}" {w}
{w} secret = secret:'{lower}' {w} {w}
{w} pass: secret:{w}{n} {w} {w}
{w} {w} password: secret:{w}{n} {w}
{w} password = secret:"{w}{n}" {w} {w}
{w} {w} email:{email} {w} {w}.
{w}. email:{email} {w} {w} {w}
{w} {w} ip:{ip} {w} {w} {w}
{w} ip:{ip}!! {w} {w}
{w} {w} card:{card} {w} {w}
{w} {w} card:{card}$$$ {w}
{w} card = card:{card} {w} {w}
{w} phone:+1 phone:(425) phone:{tel} {w} {w}
{w} {w} phone:+1 phone:(212) phone:{tel}%%% {w}
{w} {w} {n} {w} {w}
{w} in {y} {w} {w} {w}
{w} {w} {y}-{n}-{n} {w}
{w} at {t} {w} {w}
{w} version {n}.{n} {w} {w}
{w} Creative Commons BY-NC {n}.{n} {w}
{w} {w} {n}%, {w} {w}
{w} {w} {w} {w} {w} {w}
{w} "{w} {w}" {w} {w}
{w} "{w}" {w} "{w}" {w}
{w} {lower} {w} {lower} {w}
{w} {w}: {w} {w} {w}
{w} {w} = "{w}" {w}
{w} the token {w} {w} {w}
{w} the token: {w} {w} {w}
{w} {w} = {n} {w} {w}
{w} key {w} {n} {w} {w}
{w} key: {w} {w} {w}
{w} password {w} {w} {w}
{w} password: {w} {w} {w}
{w} a pass {n} {w} {w}
{w} {w} secret {w}, {w} {w}
{w} {w} http://{w}.example.com/{n} {w}
{w} chapter {n} {w} page {n} {w}
"""
DRAWS = 12
#: Key words whose presence before a token is a feature.
KEYS = frozenset("token key apikey api_key secret secret_key access_token access_key password passwd pass pwd bearer authorization auth credential credentials private_key client_secret".split())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact patterns, ordered."""
    out: list[tuple[int, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((s, 0, last := m.end()))
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def luhn(digits: str) -> bool:
    """Whether the check digit, the last, is right; every second digit from the right is doubled."""
    return sum(_DOUBLED[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


_MARKS = "\"'`.,;:!?()[]{}<>|#$%&*="
QUOTES = "\"'`"
_HEX = frozenset("0123456789abcdefABCDEF")


class _Kinds(dict):
    """For str.translate: 9 for a digit of ASCII, X for a capital, x for every other letter or sign beyond ASCII."""

    def __missing__(self, c: int) -> int:
        self[c] = to = ord("9") if 48 <= c < 58 else ord("X") if chr(c).isupper() else ord("x") if chr(c).islower() or c > 127 else c
        return to


_kinds = _Kinds()
#: What stands before a token: nothing of note, a key word up to two tokens before, and an assignment to one.
LEADS = ("x", "key", "set")


def coded(token: str) -> tuple[str, bool, bool, int]:
    """What the features of a token depend on: its shape, whether it is long and hexadecimal, whether it is
    an assignment to a key word, and what it is to the tokens after it: nothing, a key word, one with an
    assignment, or an assignment (0 to 3)."""
    core = token.strip(_MARKS)
    key = core.lower() in KEYS
    role = (2 if token[-1] in ":=" else 1) if key else 3 if token in ("=", ":", ":=", "=>") else 0
    name, sign, value = token.partition("=")
    return token[:400].translate(_kinds), len(core) >= 16 and _HEX.issuperset(core), bool(sign and value and name.lower().strip("\"'") in KEYS), role


@lru_cache(maxsize=20_000)
def shape(kinds: str, hexadecimal: bool, assigned: bool) -> tuple[str, ...]:
    """Features of a token by itself; the first is its run of kinds, which its neighbours see too."""
    core = kinds.strip(_MARKS)
    run = "run=" + re.sub(r"(.)\1+", r"\1+", kinds)[:16]
    numbers, letters = "9" in core, "x" in core or "X" in core
    plain = not core.strip("xX9-_+/=") and not set(core) - set("xX9-_+/=")
    changes = sum(a != b for a, b in zip(core, core[1:], strict=False) if a in "xX" and b in "xX")
    found = [run, f"size={min(len(core), 64) // 4}", f"mixed={letters and numbers}", f"long={plain and letters and numbers and len(core) >= 16}", f"hex={hexadecimal}", f"cased={plain and len(core) >= 12 and changes >= 4}", f"quoted={kinds[0] in QUOTES}.{letters and not numbers and len(core) >= 8}"]
    if assigned:
        found.append("assigned")
    return tuple(found)


caches("pii", shape.cache_clear)


def leads(roles: np.ndarray) -> np.ndarray:
    """For the roles of the tokens of a text, each one's place in LEADS."""
    one, two = np.concatenate([[0], roles[:-1]]), np.concatenate([[0, 0], roles[:-2]])[: len(roles)]
    named = lambda r: (r == 1) | (r == 2)
    return np.where((one == 2) | ((one == 3) & named(two)), 2, np.where(named(one) | named(two), 1, 0))


def described(tokens: list[str]) -> list[list[str]]:
    """Features of each token of a sequence."""
    known = [coded(t) for t in tokens]
    own, lead = [shape(*k[:3]) for k in known], leads(np.array([k[3] for k in known]))
    out = []
    for i, f in enumerate(own):
        before = own[i - 1][0] if i else "run=^"
        after = own[i + 1][0] if i + 1 < len(own) else "run=$"
        out.append([*f, f"before.{before}", f"after.{after}", *led(LEADS[lead[i]], f)])
    return out


def led(lead: str, own: tuple[str, ...]) -> list[str]:
    """Features of a token with its lead."""
    return [f"lead={lead}", *(f"lead={lead}.{x}" for x in own[2:7])]


def table() -> list[tuple[list[str], list[int]]]:
    """TABLE drawn out: tokens and labels of each sequence."""
    random = np.random.default_rng(0)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    pick = lambda chars, low, high: "".join(random.choice(list(chars), random.integers(low, high + 1)))
    word = lambda: "".join(random.choice(letters, random.integers(1, 12))).capitalize() if random.random() < 0.1 else "".join(random.choice(letters, random.integers(1, 12))) + random.choice(["", "", "", "", ".", ","])
    makers = {
        "w": word,
        "hex": lambda: pick("0123456789abcdef", 24, 48),
        "mix": lambda: pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 20, 44) + pick("0123456789", 1, 1),
        "cased": lambda: pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 20, 44),
        "lower": lambda: pick("abcdefghijklmnopqrstuvwxyz", 14, 30),
        "email": lambda: f"{pick('abcdefghij', 2, 8)}.{random.integers(10, 99)}@{pick('abcdefghij', 3, 8)}.example.com",
        "ip": lambda: ".".join(str(x) for x in random.integers(1, 256, 4)),
        "card": lambda: pick("0123456789", 16, 16),
        "tel": lambda: f"{random.integers(100, 999)}-{random.integers(1000, 9999)}",
        "n": lambda: str(random.integers(1, 3000)),
        "y": lambda: str(random.integers(1900, 2030)),
        "t": lambda: f"{random.integers(0, 24)}:{random.integers(10, 60)}",
    }
    out = []
    for line in TABLE.strip().splitlines():
        for _ in range(DRAWS):
            tokens, labels = [], []
            for part in line.split():
                label, _, rest = part.partition(":")
                known = label in KINDS and rest
                tokens.append(re.sub(r"\{(\w+)\}", lambda m: makers[m[1]](), rest if known else part))
                labels.append((LABELS.index("secret") if label == "secret" else LABELS.index("known")) if known else 0)
            out.append((tokens, labels))
    return out


class _Rows(dict):
    """Rows of tokens; ``find`` gives, and may keep, those that aren't here."""

    def __init__(self, find: Callable[[str], int]):
        self.find = find

    def __missing__(self, token: str) -> int:
        return self.find(token)


class Field:
    """Weights of a linear-chain conditional random field."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights.astype(np.float32), moves.astype(np.float32)
        self.clear()

    def __getstate__(self):
        return self.names, self.weights, self.moves

    def __setstate__(self, state):
        self.__init__(*state)

    def clear(self) -> None:
        """Forget the shapes met. Row 0 of the scores stands for the end of a text."""
        self.rows: dict[tuple, int] = {}
        self.simple: dict[str, int] = {}  # rows of short words by their kinds alone
        self.tokens = _Rows(self._row)
        self.own, self.role, self.n = np.zeros((len(LEADS), 1024, len(LABELS)), np.float32), np.zeros(1024, int), 1
        self.beside = np.zeros((2, 1024, len(LABELS)), np.float32)
        self.beside[:, 0] = self.sum(["before.run=^"]), self.sum(["after.run=$"])

    def sum(self, found: list[str]) -> np.ndarray:
        return self.weights[[k for f in found if (k := self.names.get(f)) is not None]].sum(axis=0)

    def _row(self, token: str) -> int:
        """The row of a token's shape."""
        simple = len(token) < 16 and "=" not in token and (core := token.strip(_MARKS)) and core.lower() not in KEYS
        if simple and (row := self.simple.get(token.translate(_kinds))) is not None:
            self.tokens[token] = row
            return row
        known = coded(token)
        row = self.rows.get(known)
        if row is None:
            if self.n == len(self.role):
                self.own, self.beside, self.role = (np.concatenate([x, np.zeros_like(x)], axis=x.ndim - 2 if x.ndim > 1 else 0) for x in (self.own, self.beside, self.role))
            self.rows[known] = row = self.n
            self.n += 1
            own = shape(*known[:3])
            for k, lead in enumerate(LEADS):
                self.own[k, row] = self.sum([*own, *led(lead, own)])
            self.beside[0, row], self.beside[1, row] = self.sum([f"before.{own[0]}"]), self.sum([f"after.{own[0]}"])
            self.role[row] = known[3]
        if simple:
            self.simple[known[0]] = row
        if len(token) <= 64:
            self.tokens[token] = row
        return row

    def emissions(self, tokens: list[str]) -> np.ndarray:
        if len(self.tokens) > CACHE or self.n > SHAPES:
            self.clear()
        rows = np.fromiter(map(self.tokens.__getitem__, tokens), np.int64, len(tokens))
        around = np.concatenate([[0], rows, [0]])
        return self.own[leads(self.role[rows]), rows] + self.beside[0][around[:-2]] + self.beside[1][around[2:]]

    def _viterbi(self, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best scores at the end by label, labels before by time, label and sequence) of scores by time, label and sequence."""
        best, back = scores[0], np.zeros(scores.shape, np.int8)
        for t in range(1, len(scores)):
            ways = best[:, None, :] + self.moves[:, :, None]
            back[t] = ways.argmax(axis=0)
            best = np.where(t < sizes, ways.max(axis=0) + scores[t], best)
        return best, back

    @staticmethod
    def _path(back: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Labels by time and sequence that end in ``label``."""
        out, each = np.zeros((len(back), len(sizes)), np.int8), np.arange(len(sizes))
        for t in range(len(back) - 1, -1, -1):
            out[t] = label
            if t:
                label = np.where(t < sizes, back[t, label, each], label)
        return out

    def _long(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of the scores of long sequences. Each block is decoded for every label before it, all at once."""
        many, each = len(LABELS), [-(-len(x) // BLOCK) for x in sequences]
        starts, n = np.cumsum([0, *each])[:-1], sum(each)
        sizes, later = np.full(n, BLOCK), np.ones(n, bool)
        later[starts] = False
        ends, back = np.zeros((many, n, many), np.float32), np.zeros((BLOCK, many, n, many), np.int8)  # label, block, label before
        cut = np.zeros((n, BLOCK, many), np.float32)
        for x, start, k in zip(sequences, starts, each, strict=True):
            cut[start : start + k].reshape(-1, many)[: len(x)] = x
            sizes[start + k - 1] = len(x) - BLOCK * (k - 1)
        for at in range(0, n, 256):
            some = np.repeat(cut[at : at + 256].transpose(1, 2, 0)[:, :, :, None], many, axis=3)
            some[0] += self.moves.T[:, None, :] * later[None, at : at + 256, None]
            x, y = self._viterbi(some.reshape(BLOCK, many, -1), np.repeat(sizes[at : at + 256], many))
            ends[:, at : at + 256], back[:, :, at : at + 256] = x.reshape(many, -1, many), y.reshape(BLOCK, many, -1, many)
        last, before = np.zeros(n, int), np.zeros((n, many), int)
        for start, k in zip(starts.tolist(), each, strict=True):
            best = ends[:, start, 0]
            for i in range(start + 1, start + k):
                ways = best[:, None] + ends[:, i].T  # label before, label at the end
                before[i], best = ways.argmax(axis=0), ways.max(axis=0)
            last[start + k - 1] = best.argmax()
            for i in range(start + k - 1, start, -1):
                last[i - 1] = before[i, last[i]]
        chosen = np.where(later, np.concatenate([[0], last[:-1]]), 0)
        labels = self._path(back[:, :, np.arange(n), chosen], sizes, last).T
        return [labels[start : start + k].reshape(-1)[: len(x)] for x, start, k in zip(sequences, starts, each, strict=True)]

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Best labels of each sequence: Viterbi over many at once, padded at the end."""
        out: list[np.ndarray] = [np.empty(0, np.int8)] * len(sequences)
        order = sorted((k for k, s in enumerate(sequences) if s), key=lambda k: len(sequences[k]))
        while order and len(sequences[order[-1]]) > BLOCK:
            some = []
            while order and len(sequences[order[-1]]) > BLOCK and sum(len(x) for _, x in some) < BATCH // 4:
                some.append((k := order.pop(), self.emissions(sequences[k])))
            for (k, _), labels in zip(some, self._long([x for _, x in some]), strict=True):
                out[k] = labels
        while order:
            longest = len(sequences[order[-1]])
            some = order[-max(1, BATCH // longest) :]
            del order[-len(some) :]
            sizes = np.array([len(sequences[k]) for k in some])
            scores = np.zeros((longest, len(LABELS), len(some)), np.float32)
            for i, k in enumerate(some):
                scores[: sizes[i], :, i] = self.emissions(sequences[k])
            best, back = self._viterbi(scores, sizes)
            labels = self._path(back, sizes, best.argmax(axis=0))
            for i, k in enumerate(some):
                out[k] = labels[: sizes[i], i]
        return out


#: Words and shapes that a worker keeps.
CACHE, SHAPES = 200_000, 50_000


def train(rows: list[tuple[list[str], list[int]]], rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Gradient ascent (Adam) on the mean log-likelihood; all sequences at once."""
    names: dict[str, int] = {}
    coded = [[[names.setdefault(f, len(names)) for f in fs] for fs in described(tokens)] for tokens, _ in rows]
    n, longest, many = len(rows), max(len(t) for t, _ in rows), len(LABELS)
    mask, gold, width = np.zeros((n, longest), bool), np.zeros((n, longest), int), max(len(f) for s in coded for f in s)
    used = np.full((n, longest, width), len(names))
    for i, (s, (_, labels)) in enumerate(zip(coded, rows, strict=True)):
        mask[i, : len(s)], gold[i, : len(s)] = True, labels
        for t, f in enumerate(s):
            used[i, t, : len(f)] = f
    weights, moves = np.zeros((len(names) + 1, many)), np.zeros((many, many))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    pairs = mask[:, 1:]
    hits = np.zeros_like(moves)
    np.add.at(hits, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    for step in range(1, rounds + 1):
        score = weights[used].sum(axis=2)
        ahead, behind = np.zeros((n, longest, many)), np.zeros((n, longest, many))
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            x = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], x, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            x = np.logaddexp.reduce(moves + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None], x, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        share = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
        slope = -share
        np.put_along_axis(slope, gold[:, :, None], np.take_along_axis(slope, gold[:, :, None], 2) + mask[:, :, None], 2)
        grad = np.zeros_like(weights)
        np.add.at(grad, used.reshape(-1), np.repeat(slope.reshape(-1, many), width, axis=0))
        both = np.exp(ahead[:, :-1, :, None] + moves + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pairs[:, :, None, None]
        for k, (w, g) in enumerate(((weights, grad / n - decay * weights), (moves, (hits - both.sum(axis=(0, 1))) / n - decay * moves))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights[-1] = 0
    return Field(names, weights, moves)


@lru_cache(maxsize=1)
def field() -> Field:
    return train(table())


_EDGE = "\"'`.,;:!?()[]{}<>|#$%&*"


def _core(token: str, start: int) -> tuple[int, int]:
    """The span of a secret inside its token: after an assignment, without quotes and marks around it."""
    m = re.match(r"[A-Za-z_]+[=:](?=.)", token)
    s = m.end() if m else 0
    while s < len(token) and token[s] in _EDGE:
        s += 1
    e = len(token)
    while e > s and token[e - 1] in _EDGE:
        e -= 1
    return start + s, start + e


def spans_of(texts: list[str | None], model: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text; (start, kind, end), ordered."""
    secret, out = LABELS.index("secret"), []
    for text, labels in zip(texts, model.decode([(t or "").split() for t in texts]), strict=True):
        base = all_of = base_spans(text) if text else []
        if (labels == secret).any():
            added = set(base)
            for m, label in zip(_TOKEN.finditer(text), labels.tolist(), strict=True):
                if label == secret:
                    s, e = _core(m[0], m.start())
                    if e > s and not any(a < e and s < b for a, _, b in base):
                        added.add((s, KINDS.index("secret"), e))
            all_of = sorted(added)
        out.append((base, all_of))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _found(model: Field, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("pii")
    for whole in batches:
        for batch in parted(whole, "text"):
            both = spans_of(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([written(b) for b, _ in both], pa.string()), pa.array([written(a) for _, a in both], pa.string()), *(pa.array([sum(x[1] == k for x in b) for b, _ in both], pa.int64()) for k in range(4))], names=["doc_id", "base", "spans", "n_email", "n_ip", "n_card", "n_phone"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (kind:start:end, joined by commas) and the counts of base spans of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_found, field()), "doc_id long, base string, spans string, n_email long, n_ip long, n_card long, n_phone long")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; a null text stays null."""
    model, at = field(), docs.columns.index(text)

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pii")
        for whole in batches:
            for batch in parted(whole, text):
                texts = batch.column(text).to_pylist()
                out = []
                for t, (_, spans) in zip(texts, spans_of(texts, model), strict=True):
                    if spans:
                        parts, end = [], 0
                        for s, k, e in spans:
                            if s >= end:
                                parts += [t[end:s], f"[{KINDS[k].upper()}]"]
                            end = max(end, e)
                        t = "".join([*parts, t[end:]])
                    out.append(t)
                columns = list(batch.columns)
                columns[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(redacted, docs.schema)
