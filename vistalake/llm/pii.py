"""Personal data: exact patterns for what has a format, and a linear-chain CRF for what only has a shape.

``base_spans`` finds e-mail addresses, IP addresses, card numbers and phone numbers by rule. The CRF adds spans of
``secret``, ``person`` and ``national_id``. It is trained by gradient ascent on the small labelled table that
``labelled_table`` builds, over word-shape and cue-word features of a token and its two neighbours and of what stands
before it, and decoded by Viterbi in numpy batches. Tokens are what white space, quotes, brackets, ``=``, ``:`` and
``|`` separate.

Decoding is confined to windows around tokens with evidence: by the bound in ``_windows`` every best path's run of
entity labels holds such a token, so text without one is decoded as all outside without running Viterbi. A window
whose path has an entity near an end that isn't the line's is widened and decoded again. A window is decoded whole,
however long (seven bytes of back pointers a token).

Defined cases: a null text counts as empty and has no spans; a very long text or line is decoded whole; repeated rows
get equal results; where spans start together, the kind listed first comes first; offsets are code points, end
exclusive; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.common import bound_batches, table

BASE_KINDS = ("email", "ip", "card", "phone")
MODEL_KINDS = ("secret", "person", "national_id")
KINDS = BASE_KINDS + MODEL_KINDS
LABELS = ("O", *(f"{p}-{k}" for k in MODEL_KINDS for p in "BI"))
WINDOW = 8

# ---------------------------------------------------------------- base rules

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits is entered at its start only: a later start in it would succeed or fail for the same reason.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def _emails(text: str):
    """Each ``@`` is tried once, with the longest local part before it that no earlier match took."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        nothing = start == at
        m = None if nothing else _DOMAIN.match(text, at + 1)
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base spans, leftmost and non-overlapping within a kind."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# ---------------------------------------------------------------- features

#: Words that name what follows or precedes (fixed values).
CUES = {
    "secret": "token secret key apikey api_key password passwd pwd credential bearer access_key private_key".split(),
    "title": "mr mrs ms dr prof herr frau señor señora monsieur madame mme".split(),
    "intro": "name named signed contact author patient customer employee".split(),
    "id": "ssn social passport id taxpayer nif dni insurance".split(),
    "glue": "= : is no number of the my".split(),
}
_CUE = {w: f"{kind}:{w}" if kind == "glue" else kind for kind, ws in CUES.items() for w in ws}
_EDGE = "\"'`.,;:!?()[]{}<>*$%&#|"
_GAPS = re.compile(r"""([\s=:"'`()\[\]{}<>|]+)""")


class _Shapes(dict):
    """str.translate table: digits to 0, lower to a, upper to A; filled as code points appear."""

    def __missing__(self, point: int) -> int:
        c = chr(point)
        out = ord("0") if "0" <= c <= "9" else ord("A") if c.isupper() else ord("a") if c.isalpha() else point
        if len(self) < 20_000:
            self[point] = out
        return out


_SHAPES = _Shapes()
_HEX = re.compile(r"[0-9a-fA-F]+")
_LONG = 12


def gap_kind(gap: str) -> str:
    """What stands before a token: a space, or an equals sign, colon, bar, bracket, quote or other white space."""
    if gap == " ":
        return ""
    mark = next((c for c in "=:|" if c in gap), "")
    return mark + ("q" if any(c in gap for c in "\"'`") else "b" if any(c in gap for c in "()[]{}<>") else "" if mark else "t")


def token_key(token: str, gap: str = "") -> str:
    """What the features see of a token and the kind of gap before it; few keys, many tokens."""
    return f"{gap}\0{_word_key(token)}"


def _word_key(token: str) -> str:
    if token.isalpha() and token.islower() and token not in _CUE and len(token) <= 20:
        return "aaaaaaaaaaaa"[: len(token)]
    core = token.strip(_EDGE)
    cue = _CUE.get(core.lower()) or _CUE.get(token.lower())
    if cue:
        return f"cue {cue} {'T' if core[:1].isupper() else 't'}"
    if len(core) >= 16 and _HEX.fullmatch(core) and not core.isdigit():
        return f"hex {len(core) // 8} {'w' if core.isalpha() else 'm'}"
    shape = core.translate(_SHAPES)
    kinds = "".join(k for k in "0aA" if k in shape)
    if len(core) >= _LONG and not core.isalpha() and not core.isdigit():
        turns = sum(x != y for x, y in zip(shape, shape[1:]))
        other = len(core) - sum(map(shape.count, "0aA"))
        return f"long {min(len(core) // 8, 8)} {kinds} {min(4 * turns // len(core), 3)} {min(other, 3)}"
    short = re.sub(r"a{3,}", "aaa", re.sub(r"0{5,}", "00000", re.sub(r"A{3,}", "AAA", shape)))
    return f"s {short if len(short) <= 2 * _LONG else kinds} {token[-1:] if token[-1:] in _EDGE else ''}"


def features(key: str) -> list[str]:
    gap, key = key.split("\0", 1)
    before = [f"gap={gap}"] if gap else []
    if key.startswith(("cue ", "hex ", "long ")):
        parts = key.split(" ")
        out = [key, parts[0], " ".join(parts[:2])]
        return [*out, *before, *(f"{gap} {parts[0]}" for _ in before)]
    if key.startswith("s "):
        bare, last = key[2:].rsplit(" ", 1)
    else:
        bare, last = key, ""
    out = [f"shape={re.sub(r'(.)\1+', r'\1+', bare)}", f"len={min(len(bare), 12)}"]
    if bare[:1] == "A":
        out.append("title" if "A" not in bare[1:] else "upper")
    if "0" in bare:
        out.append(f"digits={min(bare.count('0'), 12)}")
        if "a" in bare.lower():
            out.append("mixed")
    if bare.count("-") == 2:
        out.append("two-hyphens")
    if last and last in ".!?,;":
        out.append(f"ends{last}")
    if not bare:
        out.append("no-core")
    return out + before


# ---------------------------------------------------------------- the labelled table

GIVEN = "Anna John Maria Peter Laura James Elena Paul Sofia Mark Julia David Clara Luis Emma Karl".split()
FAMILY = "Smith Keller Moreau García Brown Weber Dubois López Taylor Fischer Bernard Ruiz Wilson Bauer".split()


def labelled_table(seed: int = 7, copies: int = 60) -> list[list[tuple[str, str]]]:
    """Sentences of (piece, label), built from templates with seeded fillers.

    A piece is text with what may follow it; a labelled piece without space at its end is set apart by one.
    """
    rng = random.Random(seed)
    pieces = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()

    def word() -> str:
        return "".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))

    def prose(n: int) -> list[tuple[str, str]]:
        out = []
        for i in range(n):
            w = word()
            r = rng.random()
            w = w.capitalize() if r < 0.15 or i == 0 else w
            w += "." if r > 0.93 else "," if r > 0.88 else rng.choice(["***", "$$$", "&&&", "###"]) if r > 0.85 else ""
            out.append((w, "O"))
        return out

    def chars(alphabet: str, n: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(n))

    digits = lambda n: chars("0123456789", n)
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    every = low + up + "0123456789"

    def value() -> str:
        made = rng.randrange(8)
        if made < 3:
            return chars("0123456789abcdef", rng.choice([24, 32, 40, 40, 48, 64]))
        if made == 3:
            return chars("abcdef", rng.choice([16, 24, 32, 40]))
        if made == 4:
            return rng.choice(["sk-", "pk_live_", "ghp_", "xoxb-", ""]) + chars(every, rng.randint(20, 40))
        if made == 5:
            return chars(up + "0123456789", rng.randint(16, 24))
        if made == 6:
            return chars(every + "+/", rng.randint(24, 44)) + rng.choice(["", "=", "=="])
        return chars(low, 4) + rng.choice("@!#_-") + chars(every, rng.randint(6, 12)) + digits(2)

    def secret() -> list[tuple[str, str]]:
        cue = rng.choice(["token", "secret", "password", "api_key", "key", "Token", "bearer", "Password", "SECRET", "apikey", "access_key", "credential"])
        quote = rng.choice(['"', "'", "", ""])
        mark = rng.choice([" = ", "=", ": ", ":", " is ", " ", "\t", '": '])
        return [(f"{cue}{mark}", "O"), (f"{quote}{value()}{quote}" + rng.choice(["", "", ".", ",", ";", "***"]), "B-secret")]

    def person() -> list[tuple[str, str]]:
        lead = rng.choice(["Mr. ", "Mrs. ", "Dr. ", "Herr ", "Frau ", "Señora ", "Madame ", "name: ", "contact: ", "signed: ", "name=", "Contact: ", "Author: ", "name\t", "Prof. "])
        given = [(rng.choice(GIVEN) + " ", "B-person"), *((rng.choice(GIVEN) + " ", "I-person") for _ in range(rng.choice([0, 0, 1])))]
        return [(lead, "O"), *given, (rng.choice(FAMILY) + rng.choice(["", "", ",", ".", ";"]), "I-person")]

    def national() -> list[tuple[str, str]]:
        lead = rng.choice(["SSN ", "SSN: ", "social number ", "ssn is ", "SSN=", "ssn\t", "insurance number: "])
        return [(lead, "O"), (f"{digits(3)}-{digits(2)}-{digits(4)}" + rng.choice(["", ".", ","]), "B-national_id")]

    def other() -> list[tuple[str, str]]:
        pair = f"{word().capitalize()} {word().capitalize()}"
        again = word().capitalize()
        plain = [
            " ".join([again] * rng.randint(4, 12)), " ".join(word().capitalize() for _ in range(rng.randint(3, 8))),
            f"is {pair}", f"of {pair}.", f"my name {word().capitalize()}. {pair}", pair, f"{word().capitalize()}. {pair},", f"{word()}: {word()} {word()}", f"{word().capitalize()}: {word()}",
            digits(16), digits(4), f"{digits(3)}.{digits(2)}.{digits(1)}.{digits(3)}", f"user{digits(2)}@mail.example.com", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}",
            "the name of", "no key", "the number is", "Licensed under the MIT License.", f"http://www.{word()}.com/{word()}/{word()}-{word()}.html?id={digits(6)}", f"version={digits(1)}.{digits(2)}.{digits(1)}", f"{word()}({word()}, {word()})",
            f"the key is {word()}", f"token {word()}", f"password: {word()}", f"{word()}-{word()}-{word()}-{word()}", f"{word()}={word()}", f'"{word()}": "{word()} {word()}"', f"{word()}_{word()}_{word()}", chars(low, rng.randint(12, 30)), f"{word()}*** {word()}### {word()}$$$ {word()}%%%",
        ]
        return [(w, "O") for w in re.findall(r"\S+\s*", rng.choice(plain))]

    table: list[list[tuple[str, str]]] = []
    for _ in range(copies):
        for kind in (secret, secret, person, national, other, other, other):
            table.append(prose(rng.randint(1, 6)) + kind() + prose(rng.randint(0, 5)))
        table.append(prose(rng.randint(6, 14)))
    return table


def sentence(row: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The text of a row of the table and its (start, end, label) pieces, without what the tokens leave out."""
    text, pieces = "", []
    for piece, label in row:
        if text and text[-1] not in " \t=:":
            text += " "
        if label != "O":
            bare = piece.strip().strip("\"'")
            at = len(text) + piece.index(bare)
            pieces.append((at, at + len(bare), label))
        text += piece
    return text, pieces


def tokens_of(line: str) -> tuple[list[str], list[str]]:
    """The tokens of a line, empty ones too, and the gap before each (a space before the first)."""
    parts = _GAPS.split(line)
    return parts[0::2], [" ", *parts[1::2]]


def token_labels(row: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(key, label) of the tokens of a row of the table; of a piece of several tokens the later ones continue it."""
    text, pieces = sentence(row)
    out, at = [], 0
    for token, gap in zip(*tokens_of(text)):
        at += len(gap) if out else 0
        label = next((x if at == s or x[0] == "I" else f"I{x[1:]}" for s, e, x in pieces if s <= at < e and token), "O")
        out.append((token_key(token, gap_kind(gap)), label))
        at += len(token)
    return out


# ---------------------------------------------------------------- the model


@dataclass
class Crf:
    index: dict[str, int]
    own: np.ndarray  # features x labels
    before: np.ndarray  # of the token before
    after: np.ndarray  # of the token after
    step: np.ndarray  # labels x labels
    first: np.ndarray

    def vectors(self, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = [i for f in features(key) if (i := self.index.get(f)) is not None]
        return self.own[at].sum(0), self.before[at].sum(0), self.after[at].sum(0)


def _allowed() -> np.ndarray:
    """An inside label follows the begin or inside label of its kind only."""
    out = np.zeros((len(LABELS), len(LABELS)))
    for j, label in enumerate(LABELS):
        if label.startswith("I-"):
            for i, before in enumerate(LABELS):
                if before[2:] != label[2:]:
                    out[i, j] = -1e4
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(rows: list[list[tuple[str, str]]], rounds: int = 120, rate: float = 0.15, ridge: float = 2e-3) -> Crf:
    """Maximum likelihood with a ridge penalty by Adam; forward-backward over all sentences at once, padded."""
    rows = [token_labels(row) for row in rows]
    keys = sorted({key for row in rows for key, _ in row})
    names = sorted({f for key in keys for f in features(key)})
    index, number = {f: i for i, f in enumerate(names)}, {key: i for i, key in enumerate(keys)}
    n, t, k, m = len(rows), max(map(len, rows)), len(LABELS), len(names)
    has = np.zeros((len(keys) + 1, m))  # which key has which features; the last row is of no token
    for key, i in number.items():
        for f in features(key):
            has[i, index[f]] += 1
    x = np.full((n, t + 2), len(keys))
    y = np.zeros((n, t), dtype=np.int64)
    on = np.zeros((n, t), dtype=bool)
    for i, row in enumerate(rows):
        for j, (key, label) in enumerate(row):
            x[i, j + 1], y[i, j], on[i, j] = number[key], LABELS.index(label), True
    places = {"own": x[:, 1:-1], "before": x[:, :-2], "after": x[:, 2:]}
    barred = _allowed()
    start_barred = np.array([-1e4 if s.startswith("I-") else 0.0 for s in LABELS])
    params = {"own": np.zeros((m, k)), "before": np.zeros((m, k)), "after": np.zeros((m, k)), "step": np.zeros((k, k)), "first": np.zeros(k)}
    first_moment = {p: np.zeros_like(v) for p, v in params.items()}
    second_moment = {p: np.zeros_like(v) for p, v in params.items()}
    gold = np.eye(k)[y] * on[:, :, None]
    both = on[:, 1:] & on[:, :-1]
    gold_steps = np.einsum("ntk,ntl->kl", gold[:, :-1] * both[:, :, None], gold[:, 1:])
    for r in range(1, rounds + 1):
        e = sum((has @ params[p])[at] for p, at in places.items())
        step = params["step"] + barred
        a = np.zeros((n, t, k))
        a[:, 0] = e[:, 0] + params["first"] + start_barred
        for j in range(1, t):
            a[:, j] = np.where(on[:, j, None], _logsum(a[:, j - 1, :, None] + step[None], 1) + e[:, j], a[:, j - 1])
        b = np.zeros((n, t, k))
        for j in range(t - 2, -1, -1):
            b[:, j] = np.where(on[:, j + 1, None], _logsum(step[None] + (e[:, j + 1] + b[:, j + 1])[:, None, :], 2), b[:, j + 1])
        z = _logsum(a[:, -1], 1)
        mean = np.exp(np.minimum(a + b - z[:, None, None], 0)) * on[:, :, None]
        pairs = np.zeros((k, k))
        for j in range(1, t):
            p = a[:, j - 1, :, None] + step[None] + (e[:, j] + b[:, j])[:, None, :] - z[:, None, None]
            pairs += (np.exp(np.minimum(p, 0)) * both[:, j - 1, None, None]).sum(0)
        d = gold - mean
        by_key = {p: np.stack([np.bincount(at.ravel(), d[:, :, c].ravel(), minlength=len(has)) for c in range(k)], axis=1) for p, at in places.items()}
        grad = {
            **{p: has.T @ g for p, g in by_key.items()},
            "step": gold_steps - pairs,
            "first": (gold[:, 0] - mean[:, 0]).sum(0),
        }
        for p, g in grad.items():
            g = g / n - ridge * params[p]
            first_moment[p] = 0.9 * first_moment[p] + 0.1 * g
            second_moment[p] = 0.999 * second_moment[p] + 0.001 * g * g
            params[p] = params[p] + rate * (first_moment[p] / (1 - 0.9**r)) / (np.sqrt(second_moment[p] / (1 - 0.999**r)) + 1e-8)
    return Crf(index, params["own"], params["before"], params["after"], params["step"] + barred, params["first"] + start_barred)


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return train(labelled_table())


def viterbi(emissions: np.ndarray, lengths: np.ndarray, model: Crf, opened: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """Best label paths of a padded batch (sequences x positions x labels).

    ``opened`` and ``closed`` say which sequences have outside tokens before and behind them in their line.
    """
    n, t, k = emissions.shape
    back = np.zeros((n, t, k), dtype=np.int8)
    best = emissions[:, 0] + np.where(opened[:, None], model.step[0] - model.step[0, 0], model.first)
    for j in range(1, t):
        through = best[:, :, None] + model.step[None]
        back[:, j] = through.argmax(1)
        moved = through.max(1) + emissions[:, j]
        best = np.where((j < lengths)[:, None], moved, best)
    out = np.zeros((n, t), dtype=np.int8)
    rows = np.arange(n)
    label = (best + np.where(closed[:, None], model.step[:, 0] - model.step[0, 0], 0.0)).argmax(1)
    for j in range(t - 1, -1, -1):
        inside = j < lengths
        out[inside, j] = label[inside]
        if j:
            label = np.where(inside, back[rows, j, label], label)
    return out


def _alike(windows: list[tuple[int, int]], rows: int = 512, tokens: int = 512 * 256):
    """Runs of windows, sorted by length, of at most ``tokens`` with their padding; a longer one is a run of its own."""
    some: list[tuple[int, int]] = []
    for s, e in windows:
        if some and (len(some) == rows or (len(some) + 1) * (e - s) > tokens):
            yield some
            some = []
        some.append((s, e))
    if some:
        yield some


class Tagger:
    """Decodes texts; keeps the vectors of the token keys it has seen, within a bound."""

    def __init__(self, model: Crf, gated: bool = True):
        self.model, self.gated = model, gated
        best_step = max(float((model.step - model.step[0, 0]).max()), float((model.first[1:] - model.first[0]).max()), 0.0)
        self.slack = 2.0 * best_step
        self.tokens: dict[str, int] = {}
        self.keys: dict[str, int] = {}
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.table: np.ndarray | None = None

    def _number(self, token: str, gap: str) -> int:
        key = token_key(token, gap_kind(gap))
        at = self.keys.get(key)
        if at is None:
            at = self.keys[key] = len(self.rows)
            self.rows.append(self.model.vectors(key))
            self.table = None
        if len(self.tokens) < 300_000 and len(token) < 60:
            self.tokens[token if gap == " " else f"{gap}\0{token}"] = at
        return at

    def tag(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, kind number, end) of the model's spans in each text."""
        if len(self.keys) > 50_000:
            self.tokens, self.keys, self.rows, self.table = {}, {}, [], None
        known, number = self.tokens.get, self._number
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        lines = []  # text, offset, tokens, gaps, first token
        ids: list[int] = []
        for i, text in enumerate(texts):
            offset = 0
            for line in text.split("\n"):
                if line:
                    tokens, gaps = tokens_of(line)
                    lines.append((i, offset, tokens, gaps, len(ids)))
                    ids += [x if (x := known(w if g == " " else f"{g}\0{w}")) is not None else number(w, g) for w, g in zip(tokens, gaps)]
                offset += len(line) + 1
        if not ids:
            return out
        if self.table is None:
            self.table = np.array(self.rows, dtype=np.float32)  # keys x 3 x labels
        at = np.array(ids, dtype=np.int64)
        starts = np.array([x[-1] for x in lines], dtype=np.int64)
        emissions = self.table[at, 0]
        inner = np.ones(len(at), dtype=bool)
        inner[starts] = False
        follow = np.nonzero(inner)[0]
        emissions[follow] += self.table[at[follow - 1], 1]
        emissions[follow - 1] += self.table[at[follow], 2]
        windows = self._windows(emissions, starts, len(at)) if self.gated else [(int(s), int(e)) for s, e in zip(starts, [*starts[1:], len(at)])]
        self._decode(windows, emissions, starts, lines, out)
        return [sorted(set(x)) for x in out]

    def _windows(self, emissions, starts, total) -> list[tuple[int, int]]:
        """Windows around evidence, within lines, merged where they touch.

        If the best path has a run of r entity labels, making them all outside can't improve it: the gains of the r
        tokens plus at most (r + 1) times the best step gain are not negative, so some token's gain is at least minus
        twice that step gain.
        """
        gain = emissions[:, 1:].max(1) - emissions[:, 0]
        hits = np.nonzero(gain >= -self.slack)[0]
        if not len(hits):
            return []
        line = np.searchsorted(starts, hits, side="right") - 1
        ends = np.append(starts[1:], total)
        lo, hi = np.maximum(hits - WINDOW, starts[line]), np.minimum(hits + WINDOW + 1, ends[line])
        new = np.ones(len(hits), dtype=bool)
        new[1:] = (lo[1:] > hi[:-1]) | (line[1:] != line[:-1])
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(hits)) - 1
        return list(zip(lo[first].tolist(), hi[last].tolist()))

    def _decode(self, windows, emissions, starts, lines, out) -> None:
        # Every window is decoded whole; what is padded to the longest of a batch bounds the batch.
        ends = np.append(starts[1:], len(emissions))
        wider: list[tuple[int, int]] = []
        for some in _alike(sorted(windows, key=lambda p: p[1] - p[0])):
            lengths = np.array([e - s for s, e in some])
            wide = int(lengths.max())
            take = np.minimum(np.array([s for s, _ in some])[:, None] + np.arange(wide)[None], len(emissions) - 1)
            begin, end = np.array([s for s, _ in some]), np.array([e for _, e in some])
            line = np.searchsorted(starts, begin, side="right") - 1
            opened, closed = begin > starts[line], end < ends[line]
            paths = viterbi(emissions[take].astype(np.float64), lengths, self.model, opened, closed)
            for (s, e), path, k, before, behind in zip(some, paths, line.tolist(), opened.tolist(), closed.tolist()):
                path = path[: e - s]
                if not path.any():
                    continue
                if (before and path[:2].any()) or (behind and path[-2:].any()):
                    more = 4 * (e - s)
                    wider.append((max(s - more, int(starts[k])), min(e + more, int(ends[k]))))
                    continue
                text, offset, tokens, gaps, base = lines[k]
                self._spans(path, s - base, tokens, gaps, offset, out[text])
        if wider:
            self._decode(_merged(wider), emissions, starts, lines, out)

    @staticmethod
    def _spans(path, first, tokens, gaps, offset, into) -> None:
        j, n = 0, len(path)
        while j < n:
            if not path[j]:
                j += 1
                continue
            kind, stop = LABELS[path[j]][2:], j + 1
            while stop < n and LABELS[path[stop]] == f"I-{kind}":
                stop += 1
            a = offset + sum(map(len, tokens[: first + j])) + sum(map(len, gaps[1 : first + j + 1]))
            piece = tokens[first + j] + "".join(g + w for g, w in zip(gaps[first + j + 1 : first + stop], tokens[first + j + 1 : first + stop]))
            core = piece.strip(_EDGE)
            if core:
                a += len(piece) - len(piece.lstrip(_EDGE))
                into.append((a, KINDS.index(kind), a + len(core)))
            j = stop


def _merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The windows, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(windows):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_all(texts: list[str | None], tagger: Tagger) -> list[tuple]:
    """Per text: the four base counts, the digest of the base spans, all spans."""
    whole = [t or "" for t in texts]
    out = []
    for text, extra in zip(whole, tagger.tag(whole)):
        base = base_spans(text)
        kinds = [k for _, k, _ in base]
        every = sorted([*base, *extra]) if extra else base
        out.append((*map(kinds.count, range(4)), hashlib.sha256(digest(base).encode()).hexdigest(), digest(every)))
    return out


SPAN_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(documents: DataFrame, model: Crf | None = None) -> DataFrame:
    """Counts and spans of every document: one narrow pass over the whole texts, in batches of bounded size."""
    bound_batches(documents.sparkSession)
    carrier = documents.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        tagger = Tagger(carrier.value)
        names = [c.split(" ")[0] for c in SPAN_SCHEMA.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        for batch in batches:
            for start, some in _slices(batch.column(1).to_pylist()):
                columns = list(zip(*find_all(some, tagger)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(some)), *(pa.array(c, kind) for c, kind in zip(columns, kinds))], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SPAN_SCHEMA)


def _slices(texts: list[str | None], most: int = 2_000_000):
    """Runs of texts of about ``most`` characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, texts[start:]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return detect(table(spark, sf_dir, "documents"))
