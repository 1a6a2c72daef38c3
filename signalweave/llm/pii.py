"""Personal data by a semi-Markov conditional random field over whole spans.

Text is read in islands: runs of chunks with a digit or an at sign (or an at sign spelt in brackets). An island is a row
of atoms (runs of letters and digits, single marks); candidate segments are up to ATOMS atoms of it. Features look at the
whole segment (digits, shape, checksums, what stands around it), and a segment of a kind scores the sum of its features'
weights; atoms outside score nothing. Dynamic programming over the candidates finds the segmentation with the largest
sum, so boundaries and kinds are chosen together. Spans of the base patterns are given: they stay, and no segment that
crosses one is a candidate.

Weights are fitted here, by the likelihood of whole segmentations, to made entities and made look-alikes set into lines
of a bounded sample of the corpus.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweave.llm.common import batch_slices, quoted
from signalweave.llm.text import filled

BASE_KINDS = ("email", "ip", "card", "phone")
#: The order of kinds at one start; the method knows the last ones besides.
KINDS = (*BASE_KINDS, "iban", "id", "secret")
#: A segment has so many atoms and spaces between them at most; so many starts are scored at a time; rows and lines that weights are fitted on.
ATOMS, SPACES, STEP, SAMPLE_ROWS, SAMPLE_LINES = 16, 8, 4096, 256, 400

# --- base patterns

_AT = re.compile("@")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: No digit stands before a match: every match takes digits to their end, so one that starts inside a run doesn't come up.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _only_digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping for each kind; what fails its test is dropped. One pass a kind, however long runs are."""
    out, done = [], 0
    for m in _AT.finditer(text):  # the local part is all that can stand before an at sign, back to the last match
        at = start = m.start()
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            out.append((start, domain.end(), "email"))
            done = domain.end()
    if _DIGITS.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if octets(m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- islands and atoms

_CHUNK = r"[^\s0-9@]*+[0-9@]\S*+"
_SPELT = r"[\[({]\x20?(?:at|AT|arroba)\x20?[\])}]"
_SPELT_MAIL = rf"(?<![\w.+-])[\w.+-]++\x20?{_SPELT}\x20?[\w-]++(?:(?:\.|\x20?[\[({{]\x20?(?:dot|DOT|punto|point)\x20?[\])}}]\x20?)[\w-]++)*+"
#: Starts stand behind what they can't hold, and all repeats are possessive, so that long runs are read once.
ISLAND = regex.compile(rf"{_SPELT_MAIL}|(?<!\S){_CHUNK}(?:\x20(?:[A-Z]{{4}}\x20(?=[0-9]{{4}}))?{_CHUNK})*+")
_ATOM = re.compile(r"[^\W_]+|[^\s]")
_WORD = re.compile(r"[^\W\d_]+")
_BEFORE = re.compile(r"\S+")
#: Words that tell what follows. Fixed values.
CUES = {
    "phone": "tel telephone phone call mobile cell fax telefon handy téléphone teléfono móvil whatsapp",
    "email": "mail email contact correo kontakt",
    "ip": "ip host server client addr node",
    "card": "card visa mastercard amex credit karte kreditkarte carte tarjeta",
    "iban": "iban bic konto account cuenta compte",
    "id": "ssn social passport nin dni tin",
    "secret": "password passwd pwd secret token key apikey bearer aws credentials passwort contraseña",
    "other": "sha md5 commit revision version isbn page order invoice date id serial build checksum etag uuid",
}
_CUE = {w: 1 + i for i, k in enumerate(CUES) for w in CUES[k].split()}
_MARKS = "+ ( ) [ ] \" ' . - : @ = / _ , ; # $ % & * < > { } | !".split()
_MARK = {c: 4 + i for i, c in enumerate(_MARKS)}
N_CLASS = 6 + len(_MARKS)


def _side(c: str) -> int:
    """Class of a neighbouring character: 0 none, 1 space, 2 letter, 3 digit, marks, other."""
    if not c:
        return 0
    if c.isspace():
        return 1
    return 2 if c.isalpha() else 3 if c.isdigit() else _MARK.get(c, 4 + len(_MARKS))


class Atoms:
    """Columns of the atoms of some islands, one after another."""

    def __init__(self, text: str, spans: list[tuple[int, int]]) -> None:
        self.text = text
        start, end, kind, island, cue, before, after = [], [], [], [], [], [], []
        for n, (a, b) in enumerate(spans):
            last = [_CUE.get(w.lower(), 0) for w in _WORD.findall(text[max(0, a - 40) : a])][-3:]
            for m in _ATOM.finditer(text, a, b):
                s, e, w = m.start(), m.end(), m[0]
                start.append(s)
                end.append(e)
                island.append(n)
                cue.append(next((c for c in reversed(last) if c), 0))
                alpha, digit = w.isalpha(), w.isascii() and w.isdigit()
                kind.append(1 if digit else 2 if alpha else 3 if w.isalnum() else _MARK.get(w, 4 + len(_MARKS)))
                before.append(_side(text[s - 1 : s]) if s else 0)
                after.append(_side(text[e : e + 1]))
                if alpha:
                    last = [*last[-2:], _CUE.get(w.lower(), 0)]
        self.start, self.end, self.kind, self.island, self.cue, self.before, self.after = (np.array(x, "i8") for x in (start, end, kind, island, cue, before, after))
        words = [text[s:e] for s, e in zip(start, end)]
        self.words = words
        count = lambda f: np.concatenate([[0], np.cumsum(np.fromiter(map(f, words), "i8", len(words)))])
        self.digits = count(lambda w: sum(map(str.isdigit, w)))
        self.letters = count(lambda w: sum(map(str.isalpha, w)))
        self.upper = count(lambda w: sum(map(str.isupper, w)))
        self.hex = count(lambda w: sum(c in "abcdefABCDEF" for c in w))
        self.turns = count(lambda w: sum(a.isdigit() != b.isdigit() for a, b in zip(w, w[1:])))
        self.marks = {c: np.concatenate([[0], np.cumsum(self.kind == _MARK[c])]) for c in (*".-:@+=/", *"([{", '"')}
        self.numbers = np.concatenate([[0], np.cumsum(self.kind == 1)])
        self.puncts = np.concatenate([[0], np.cumsum(self.kind > 3)])
        gap = np.concatenate([[False], (self.start[1:] > self.end[:-1]) & (self.island[1:] == self.island[:-1])]) if words else np.zeros(0, bool)
        self.gaps = np.concatenate([[0], np.cumsum(gap)])
        size = self.end - self.start
        at, places = (self.kind == 1), np.arange(len(words))
        self.next_number = np.minimum.accumulate(np.where(at, places, len(words))[::-1])[::-1] if words else places
        self.last_number = np.maximum.accumulate(np.where(at, places, -1)) if words else places
        self.size = size


def segments(a: Atoms, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last atom of the candidates that start at atoms low to high - 1: inside an island, with a digit or an at sign, ending on letters or digits, with SPACES spaces at most."""
    first = np.repeat(np.arange(low, high), ATOMS)
    last = first + np.tile(np.arange(ATOMS), high - low)
    keep = last < len(a.start)
    first, last = first[keep], last[keep]
    keep = a.island[first] == a.island[last]
    keep &= (a.kind[first] <= 3) | np.isin(a.kind[first], [_MARK["+"], _MARK["("], _MARK[":"]])
    keep &= (a.kind[last] <= 3) | (a.kind[last] == _MARK["="]) | (a.kind[last] == _MARK[":"])
    keep &= a.gaps[last + 1] - a.gaps[first + 1] <= SPACES
    keep &= np.any([sums[last + 1] > sums[first] for sums in (a.digits, *(a.marks[c] for c in "@([{"))], axis=0)
    return first[keep], last[keep]


#: Sizes of the features, in the order of features().
_BUCKETS = np.array([4, 8, 10, 12, 14, 16, 18, 20, 24, 30, 34, 41, 64, 128])
_LETTERS = np.array([1, 2, 3, 4, 5, 9, 17, 41])
_TURNS = np.array([1, 2, 3, 6, 11])
SIZES = (ATOMS, 25, 9, 15, N_CLASS, N_CLASS, N_CLASS, N_CLASS, 5, 5, 9, 3, 3, 5, 7, 9, 10, 10, 6, 4, 4, 3, 3, 3, 3, 9, 3, 2, 3)
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])
_V6 = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:)+(?::[0-9A-Fa-f]{1,4})+")
_MAIL_AT, _MAIL_DOT = re.compile(_SPELT), re.compile(r"\.|[\[({]\x20?(?:dot|DOT|punto|point)\x20?[\])}]")


def mod97(compact: str) -> bool:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def features(a: Atoms, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The features of segments, as columns of one matrix: each row has one place in each of the ranges of SIZES."""
    over = lambda sums: sums[last + 1] - sums[first]
    nd, nl, nu, n = over(a.digits), over(a.letters), over(a.upper), last - first + 1
    spaces = a.gaps[last + 1] - a.gaps[first + 1]
    numbers = over(a.numbers)
    nan = numbers == 0
    first_number, last_number = np.minimum(a.next_number[first], len(a.size) - 1), np.maximum(a.last_number[last], 0)
    checks = np.zeros((len(first), 5), "i8")  # luhn, octets, mod 97, version 6, spelt mail
    dots, colons, puncts = over(a.marks["."]), over(a.marks[":"]), over(a.puncts)
    for i in np.flatnonzero((nl == 0) & (nd >= 12) & (nd <= 19)).tolist():
        checks[i, 0] = 2 if luhn("".join(w for w in a.words[first[i] : last[i] + 1] if w.isdigit())) else 1
    for i in np.flatnonzero((n == 7) & (dots == 3) & (numbers == 4) & (spaces == 0)).tolist():
        checks[i, 1] = 2 if octets(a.words[first[i] : last[i] + 1 : 2]) else 1
    for i in np.flatnonzero((nl >= 2) & (puncts == 0) & (nd + nl >= 15) & (nd + nl <= 34) & (a.size[first] >= 4)).tolist():
        compact = "".join(a.words[first[i] : last[i] + 1])
        checks[i, 2] = 2 if compact.isascii() and compact[:2].isupper() and compact[2:4].isdigit() and mod97(compact) else 1
    for i in np.flatnonzero((colons >= 2) & (spaces == 0) & (puncts == colons)).tolist():
        checks[i, 3] = 2 if _V6.fullmatch(a.text, a.start[first[i]], a.end[last[i]]) else 1
    for i in np.flatnonzero((sum(over(a.marks[c]) for c in "([{") > 0) & (nl > 3)).tolist():
        m = _MAIL_AT.search(a.text, a.start[first[i]], a.end[last[i]])
        checks[i, 4] = (2 if _MAIL_DOT.search(a.text, m.end(), a.end[last[i]]) else 1) if m else 0
    tld = (a.kind[last] == 2) & (a.size[last] >= 2) & (a.size[last] <= 6)
    hexes = over(a.hex)
    cols = [
        n - 1, np.minimum(nd, 24), np.searchsorted(_LETTERS, nl, side="right"), np.searchsorted(_BUCKETS, nd + nl, side="right"), a.kind[first], a.kind[last], a.before[first], a.after[last],
        np.minimum(dots, 4), np.minimum(over(a.marks["-"]), 4), np.minimum(colons, 8), np.minimum(over(a.marks["@"]), 2), np.minimum(over(a.marks["("]), 2), np.minimum(puncts, 4), np.minimum(spaces, 6),
        np.minimum(numbers, 8), np.where(nan, 0, np.minimum(a.size[first_number], 9)), np.where(nan, 0, np.minimum(a.size[last_number], 9)), np.searchsorted(_TURNS, over(a.turns), side="right"),
        np.where(nl == 0, 0, np.where(nu == 0, 1, np.where(nu == nl, 2, 3))), np.where(nl == 0, 0, np.where(hexes < nl, 3, np.where(nu == 0, 1, 2))), *checks[:, :4].T, a.cue[first], checks[:, 4], tld.astype("i8"),
        np.where(over(a.marks["="]) > 0, 1, np.where(over(a.marks['"']) > 0, 2, 0)),
    ]
    return np.stack(cols, axis=1) + OFFSETS[:-1]


# --- decoding


def best_segmentation(items: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of scored segments (first, last, kind, score > 0) the disjoint ones with the largest sum; of equal sums the one that ends earlier."""
    items = sorted(items, key=lambda x: (x[1], x[0], x[2]))
    ends = [x[1] for x in items]
    before = np.searchsorted(ends, [x[0] for x in items], side="left").tolist() if items else []
    best, take = [0.0], []
    for (_, _, _, score), k in zip(items, before):
        take.append(best[k] + score > best[-1])
        best.append(max(best[-1], best[k] + score))
    out, i = [], len(items)
    while i:
        if take[i - 1]:
            out.append(items[i - 1])
            i = before[i - 1]
        else:
            i -= 1
    return out[::-1]


def method_spans(text: str, fixed: list[tuple[int, int, str]], weights: np.ndarray) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of the segments chosen beside the fixed spans. Segments that score nothing or less are in no best segmentation, so only the others are held."""
    islands = [m.span() for m in ISLAND.finditer(text)]
    if not islands:
        return []
    out = []
    for some in _bunches(islands):
        a = Atoms(text, some)
        good: list[tuple[int, int, int, float]] = []
        taken = np.zeros(len(a.start) + 1, "i8")
        for s, e, _ in fixed:
            lo, hi = np.searchsorted(a.end, s, side="right"), np.searchsorted(a.start, e, side="left")
            taken[lo:hi] = 1
        taken = np.concatenate([[0], np.cumsum(taken)])
        for low in range(0, len(a.start), STEP):
            first, last = segments(a, low, min(low + STEP, len(a.start)))
            free = taken[last + 1] == taken[first]
            first, last = first[free], last[free]
            if not len(first):
                continue
            score = weights[features(a, first, last)].sum(axis=1)
            kind = score.argmax(axis=1)
            score = score[np.arange(len(kind)), kind]
            good += [(int(first[i]), int(last[i]), int(kind[i]), float(score[i])) for i in np.flatnonzero(score > 0)]
        out += [(int(a.start[f]), int(a.end[z]), KINDS[k], s) for f, z, k, s in best_segmentation(good)]
    return out


def _bunches(islands: list[tuple[int, int]], limit: int = 1 << 20) -> Iterator[list[tuple[int, int]]]:
    """Islands of a text in bunches of about limit characters."""
    held, size = [], 0
    for span in islands:
        held.append(span)
        size += span[1] - span[0]
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


# --- made entities


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random) -> str:
    n = r.choice([15, 16, 16, 16, 19])
    body = r.choice("3456") + _digits(r, n - 2)
    d = body + next(c for c in "0123456789" if luhn(body + c))
    return d if r.random() < 0.4 else r.choice(" -").join(d[i : i + 4] for i in range(0, n, 4))


def _iban(r: random.Random) -> str:
    land, body = r.choice(["DE", "FR", "ES", "GB", "NL"]), r.choice(["", "ABNA", "BUKB"]) + _digits(r, r.choice([14, 18, 20]))
    check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
    full = f"{land}{check:02d}{body}"
    return full if r.random() < 0.5 else " ".join(full[i : i + 4] for i in range(0, len(full), 4))


def _secret(r: random.Random) -> str:
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    k = r.random()
    if k < 0.35:
        return pick("0123456789abcdef", r.choice([16, 18, 20, 24, 32, 40, 48, 64]))
    if k < 0.6:
        return pick(up, 4) + pick(up + "0123456789", 16)
    if k < 0.8:
        return r.choice(["sk_live_", "ghp_", "xox-", "key-"]) + pick(low + up + "0123456789", r.randint(16, 40))
    return pick(low + up + "0123456789", r.randint(20, 44))


def _email(r: random.Random) -> str:
    name = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    host = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    name += r.choice(["", f".{_digits(r, 2)}", f".{host[:4]}", _digits(r, 2)])
    tld = r.choice(["com", "org", "de", "fr", "es", "net"])
    if r.random() < 0.4:
        return f"{name}@{host}{r.choice(['', '.example', '1.mail'])}.{tld}"
    o, c = r.choice(["[]", "()", "{}"])
    gap = r.choice(["", " "])
    return f"{name}{gap}{o}{r.choice(['at', 'AT'])}{c}{gap}{host}" + (f"{gap}{o}dot{c}{gap}{tld}" if r.random() < 0.6 else f".{tld}")


def _phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    area = r.choice("23456789") + d(2)
    return r.choice([f"+{r.randint(1, 99)} ({area}) {d(3)}-{d(4)}", f"({area}) {d(3)}-{d(4)}", f"{area}-{d(3)}-{d(4)}", f"{area}.{d(3)}.{d(4)}", f"00{r.randint(20, 99)} {d(2)} {d(4)} {d(4)}", f"0{r.choice('12345679')} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{r.randint(20, 99)}{d(9)}", f"0{d(3)}-{d(7)}"])


def _ip(r: random.Random) -> str:
    if r.random() < 0.5:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    part = lambda: f"{r.randint(1, 65535):x}"
    return ":".join(part() for _ in range(8)) if r.random() < 0.5 else ":".join(part() for _ in range(r.randint(1, 4))) + "::" + ":".join(part() for _ in range(r.randint(1, 3)))


def _id(r: random.Random) -> str:
    return f"{r.randint(100, 899)}-{r.randint(10, 99)}-{_digits(r, 4)}"


def _lookalike(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    bad = next(x for x in iter(lambda: d(16), "") if not luhn(x))
    k = r.randrange(16)
    return [
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}" + r.choice(["", f":{d(2)}"]), lambda: f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}",
        lambda: f"{r.randint(0, 20)}.{r.randint(0, 30)}.{r.randint(0, 99)}", lambda: f"{r.randint(1, 999)},{d(3)}.{d(2)}", lambda: d(r.randint(1, 8)), lambda: bad, lambda: " ".join(d(r.randint(1, 4)) for _ in range(r.randint(2, 9))),
        lambda: f"commit {hexes(40)}", lambda: f"{r.choice(['sha256', 'md5', 'etag'])}: {hexes(r.choice([32, 64]))}", lambda: f"uuid {hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", lambda: f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        lambda: f"order {r.choice('ABCDEF')}{d(6)}", lambda: f"pages {d(2)}-{d(3)}", lambda: f"x{d(2)} y{d(1)}.{d(2)} @{d(2)}", lambda: f"v{d(1)}.{d(1)}-rc{d(1)} h2o covid19 b2b 3d mp3",
    ][k]()


MAKERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "iban": _iban, "id": _id, "secret": _secret}


def made(r: random.Random, lines: list[str], n: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """n texts with the spans set into them: a place of a line, perhaps a cue, an entity or a look-alike."""
    for i in range(n):
        words = (r.choice(lines).split(" ") if lines else []) or ["so"]
        k = r.randrange(len(words) + 1)
        head, tail = " ".join(words[max(0, k - 8) : k]), " ".join(words[k : k + 8])
        kind = None if i % 3 == 0 else KINDS[i % len(KINDS)]
        what = _lookalike(r) if kind is None else MAKERS[kind](r)
        lead, trail = "", ""
        bare_hex = kind == "secret" and re.fullmatch("[0-9a-f]+", what)
        if kind and (bare_hex or r.random() < 0.6):
            cue = r.choice(CUES[kind].split())
            lead = f"{cue}{r.choice(['=', ': ', ' ', ' = '])}" if kind == "secret" else f"{r.choice([cue, cue.title(), cue.upper()])}{r.choice([': ', ' ', '. ', ':'])}"
        if kind == "secret" and r.random() < 0.4:
            lead, trail = lead + '"', '"'
        text = f"{head} {lead}" if head else lead
        end = r.choice([" ", " ", ". ", ", ", ") ", "! ", "*** ", "\n"])
        spans = [(len(text), len(text) + len(what), kind)] if kind else []
        yield text + what + trail + end + tail, spans


def examples(texts: Iterator[tuple[str, list[tuple[int, int, str]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, first place, last place, text and label (kind, or -1) of all candidate segments of texts; places are counted within a text."""
    cols: list[list] = [[], [], [], [], []]
    for n, (text, spans) in enumerate(texts):
        islands = [m.span() for m in ISLAND.finditer(text)]
        if not islands:
            continue
        a = Atoms(text, islands)
        first, last = segments(a, 0, len(a.start))
        label = np.full(len(first), -1)
        for s, e, kind in spans:
            label[(a.start[first] == s) & (a.end[last] == e)] = KINDS.index(kind)
        for held, x in zip(cols, (features(a, first, last), first, last, np.full(len(first), n), label)):
            held.append(x)
    return tuple(np.concatenate(c) for c in cols)


def fitted(lines: list[str], seed: int = 5, n: int = 2400, rounds: int = 120, rate: float = 0.15, decay: float = 2e-4) -> np.ndarray:
    """Weights by (feature, kind): gradient steps (Adam) on the log-likelihood of the segmentations of n made texts, all texts abreast."""
    x, first, last, text, label = examples(made(random.Random(seed), lines, n))
    n_text, longest = int(text.max()) + 1, int(last.max()) + 1
    dense = np.zeros((len(x), OFFSETS[-1]), "f4")
    dense[np.arange(len(x))[:, None], x] = 1
    by_end, by_start = ([np.flatnonzero(c == t) for t in range(longest)] for c in (last, first))
    gold = np.zeros((len(x), len(KINDS)))
    gold[np.flatnonzero(label >= 0), label[label >= 0]] = 1
    w, m, v = (np.zeros((OFFSETS[-1], len(KINDS))) for _ in range(3))
    for step in range(1, rounds + 1):
        score = (dense @ w.astype("f4")).astype("f8")
        top = score.max(axis=1, keepdims=True)
        whole = (top + np.log(np.exp(score - top).sum(axis=1, keepdims=True)))[:, 0]
        # forward[t]: all segmentations of the first t atoms; backward[t]: of those from t on
        forward, backward = np.zeros((longest + 1, n_text)), np.zeros((longest + 1, n_text))
        for t in range(longest):
            forward[t + 1] = forward[t]
            np.logaddexp.at(forward[t + 1], text[by_end[t]], forward[first[by_end[t]], text[by_end[t]]] + whole[by_end[t]])
        for t in range(longest - 1, -1, -1):
            backward[t] = backward[t + 1]
            np.logaddexp.at(backward[t], text[by_start[t]], backward[last[by_start[t]] + 1, text[by_start[t]]] + whole[by_start[t]])
        marginal = np.exp(forward[first, text] + backward[last + 1, text] - forward[longest, text] + whole)
        expected = marginal[:, None] * np.exp(score - whole[:, None])
        slope = dense.T @ (gold - expected).astype("f4") / n_text - decay * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


# --- the operator


def carriers(docs: DataFrame, text: str, seed: int) -> list[str]:
    """Lines without digits or at signs of the SAMPLE_ROWS rows with the smallest seeded hashes of their texts, SAMPLE_LINES at most: what made entities are set into."""
    rows = docs.select(quoted(text).alias("text")).where("text IS NOT NULL").select("text", F.xxhash64(F.lit(seed), "text").alias("h"))
    lines = rows.orderBy("h", "text").limit(SAMPLE_ROWS).select("h", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = lines.where(~F.rlike("line", F.lit("[0-9@]")) & (F.length(F.trim("line")) > 0)).select("h", "i", F.expr("array_join(slice(split(line, ' '), 1, 64), ' ')").alias("line"))
    return [r.line for r in lines.orderBy(F.xxhash64("h", "i"), "line").limit(SAMPLE_LINES).collect()]


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean,score:double>>"


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 5) -> DataFrame:
    """Rows (doc_id, spans) for each row of docs; a span is (kind, start, end, base, score) in code points, end exclusive, by start, kind and end.

    Base spans have no score and may overlap each other; spans of the method overlap nothing. A null text counts as
    empty; repeated rows give equal rows; ids are cast to long; other columns are ignored; an empty table gives no rows.
    Apart from the sample that the weights are fitted on (SAMPLE_ROWS rows), it is a narrow job over whole texts.
    """
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(fitted(carriers(docs, text, seed), seed))
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for part in batch_slices(batch, "text"):
                sizes, cols = [], ([], [], [], [], [])
                for t in filled(part.column("text")).to_pylist():
                    base = base_spans(t)
                    spans = [(k, s, e, True, None) for s, e, k in base] + [(k, s, e, False, x) for s, e, k, x in method_spans(t, base, w)]
                    spans.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                    sizes.append(len(spans))
                    for held, values in zip(cols, zip(*spans)):
                        held += values
                fields = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.float64()))]
                inner = pa.StructArray.from_arrays(fields, ["kind", "start", "end", "base", "score"])
                yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), inner)], names=["doc_id", "spans"])

    return rows.mapInArrow(run, SPANS)
