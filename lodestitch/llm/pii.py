"""Operator 8, personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The field works on regions: whitespace-separated chunks that hold a digit, an @
or a spelled-out at in brackets, with their like neighbours (at most 40 characters
without a cue stand between two cues of a region that a blank parts). A region is cut
into atoms (runs of 16 and more letters and digits, digits, ASCII letters, or one other
character). A segmentation gives each atom to one segment: a single outside
atom or an entity of at most MAX_ATOMS atoms. Features look at a whole segment
(shape, digit count, checksum, number ranges, spelled signs, what stands before
and after), and each kind has a weight after each other; dynamic programming over
bounded segments finds the best boundaries and kinds together. Text outside
regions cannot be an entity, as every kind needs such a sign; so whole texts
are judged. Beside the four base kinds it finds secrets (keys and tokens).

It is trained by the gradient of the conditional likelihood on lines whose true
spans are known: base spans of a bounded sample of documents and drawn ones,
written plainly or as the base patterns do not find them (user [at] host,
1[.]2[.]3[.]4, other separators, phones without a plus), among numbers that are
no personal data. Its spans are added where they overlap no base span.

Rows: a null or empty text has no spans. Repeated rows each get a row. Spans
are in code points, the end is exclusive. Any other columns are left alone.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import small_batches, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the field; the last has no base pattern.
ALL_KINDS = (*KINDS, "secret")
SAMPLE = 600
#: Different true spans of a kind, and lines made of them.
SPANS = 200
MADE = 900
MAX_ATOMS = 20
#: Starts of segments that are worked on together.
WINDOW = 512
#: Letters and digits from which on a run is one atom.
MIXED = 16
BITS = 14
EPOCHS = 4

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUE = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]", re.IGNORECASE)
_ATOM = re.compile(r"[0-9A-Za-z]{16,}|[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
#: Signs that stand within personal data of any kind, beside blanks.
_INSIDE = frozenset("+()[]{}._%-@/#*~")
_MASK = {ord(c): "9" for c in "0123456789"}
_MARK = re.compile(r"\b(at|dot)\b", re.IGNORECASE)
#: The word before a span, over a sign or two.
_BEFORE = re.compile(r"([A-Za-z_]+)[^A-Za-z0-9]{0,5}$")
_OPEN = re.compile(r"(?:^|\s)[\[({]\s?(?:at|dot|\.)\s?[\])}]$", re.IGNORECASE)
_SPELLED = re.compile(r"\s[\[({]\s?(?:at|dot|\.)\s?[\])}]\s\S+|\s[.@-]\s\S+", re.IGNORECASE)

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        n = n * 2 if k % 2 else n
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end(), "email"
            done = found.end()
            at = text.find("@", done)
        else:  # a local part never reaches over an @
            done = at + 1
            at = text.find("@", done)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by start, then kind as listed."""
    spans: list[Span] = list(_emails(text)) if "@" in text else []
    if _CUE.search(text):
        spans += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        spans += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        spans += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15] if "+" in text else []
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring chunks that hold a cue; chunks are parted by one blank, or by one blank and a bracket or sign. A sign or a spelled one that stands alone brings the chunks on both its sides."""
    done = 0
    while cue := _CUE.search(text, done):
        start = cue.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        if start > done + 1 and cue.group()[0] in "[({@" and start >= cue.start():
            start -= 1
            while start > done and not text[start - 1].isspace():
                start -= 1
        end = cue.end()
        while True:
            while end < len(text) and not text[end].isspace():
                end += 1
            if end + 1 < len(text) and not text[end + 1].isspace() and _OPEN.search(text[max(start, end - 8) : end]):
                end += 1
                continue
            if spelled := _SPELLED.match(text, end):
                end = spelled.end()
                continue
            stop = end + 1
            while stop < len(text) and not text[stop].isspace() and text[stop] not in "0123456789@":
                stop += 1
                if stop - end > 40:
                    break
            if stop < len(text) and (text[end : end + 1] == " " or text[end : end + 2] == "  ") and text[stop] in "0123456789@":
                end = stop
            elif text[end : end + 2] == "  " and text[end + 2 : end + 3].isdigit():
                end += 2
            else:
                break
        yield start, end
        done = end


def _side(c: str) -> str:
    return "end" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "blank" if c.isspace() else c


def _shape_features(text: str, atoms: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Of the segment of atoms i to j - 1, the whole span at once: what does not hang on which digits it has."""
    a, b = atoms[i][0], atoms[j - 1][1]
    s = text[a:b]
    digits = _digits(s)
    shape = "".join("9" * min(4, q - p) if text[p].isdigit() and text[p:q].isdigit() else "w" if _MARK.fullmatch(text, p, q) else "a" if text[p].isalnum() else text[p] for p, q in atoms[i:j])
    signs = "".join(sorted({c for c in s if not c.isalnum()}))
    out = ["bias", f"shape={shape}", f"n={len(digits)}", f"edges={_side(text[a - 1 : a])},{_side(text[b : b + 1])}", f"ends={_side(s[0])},{_side(s[-1])}", f"signs={signs}", f"n,signs={len(digits)},{signs}"]
    groups = re.findall(r"[0-9]+", s)
    gaps = set(re.split(r"[0-9A-Za-z]+", s)[1:-1])
    out += [f"groups={'-'.join(str(min(5, len(g))) for g in groups[:5])},{len(groups) > 5}", f"gaps={'|'.join(sorted(gaps)[:4])}", f"kinds={any(c.isalpha() for c in s)},{'@' in s},{len(groups) > 0},{len(gaps)}"]
    if "@" in s:
        head, _, tail = s.partition("@")
        out.append(f"at={bool(head)},{'.' in tail},{'@' in tail},{' ' in s}")
    marks = [m.lower() for m in _MARK.findall(s)]
    if marks:
        out.append(f"marks={marks.count('at')},{marks.count('dot')},{s[0].isalnum()},{s[-1].isalnum()}")
    return out


def _digit_features(s: str) -> list[str]:
    """What hangs on which digits the span has."""
    out = []
    digits = _digits(s)
    if 12 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)},{len(digits)},{len({c for c in s if not c.isalnum()})}")
    parts = re.split(r"[^0-9]+", s)
    if len(parts) == 4 and all(parts) and len(digits) <= 12:
        out.append(f"octets={all(map(_small, parts))},{''.join(sorted({c for c in s if not c.isalnum()}))}")
    if len(s) >= MIXED and s.isalnum():
        out += [f"mixed={any(c.isdigit() for c in s)},{any(c.isalpha() for c in s)},{all(c in '0123456789abcdefABCDEF' for c in s)}", f"long={min(8, len(s) // 8)}", f"many={len(set(s)) * 2 > min(16, len(s))}"]
    return out


def _hashed(features: list[str]) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for f in features]


class Features:
    """Hashed features of segments; those of equal shapes are computed once."""

    def __init__(self, most: int = 20_000):
        self.most, self.shapes = most, {}

    def of(self, text: str, atoms: list[tuple[int, int]], i: int, j: int, before: list[int], masked: str | None = None) -> list[int]:
        """`before`: the hashed feature of the word before atom i; `masked`: the span with 9 for each digit."""
        a, b = atoms[i][0], atoms[j - 1][1]
        key = masked or text[a:b].translate(_MASK), _side(text[a - 1 : a]), _side(text[b : b + 1])
        known = self.shapes.get(key)
        if known is None:
            if len(self.shapes) >= self.most:
                self.shapes.clear()
            s = text[a:b]
            n = sum(map(len, re.findall(r"[0-9]+", s)))
            own = 12 <= n <= 19 or (n <= 12 and len(parts := re.split(r"[^0-9]+", s)) == 4 and all(parts)) or (len(s) >= MIXED and s.isalnum())
            known = self.shapes[key] = _hashed(_shape_features(text, atoms, i, j)), own
        shape, own = known
        return shape + before + _hashed(_digit_features(text[a:b])) if own else shape + before


def _before(text: str, a: int) -> list[int]:
    before = _BEFORE.search(text, max(0, a - 24), a)
    return _hashed([f"before={before.group(1).lower() if before else ''}"])


def possible_ends(text: str, atoms: list[tuple[int, int]], i: int) -> Iterator[int]:
    """Where an entity that begins at atom i can end: it begins and ends with a letter or digit (or begins with one of a few signs), holds a cue, and no sign that no kind is written with."""
    a = atoms[i][0]
    if not (text[a].isalnum() or text[a] in "+(._%-"):
        return
    cue = False
    for j in range(i, min(len(atoms), i + MAX_ATOMS)):
        p, q = atoms[j]
        if text[p].isalnum():
            cue = cue or _CUE.search(text, a, q) is not None
            if cue:
                yield j + 1
        elif text[p] not in _INSIDE and not text[p].isspace():
            return


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class SemiCRF:
    """Segments are outside atoms or entities; a segmentation's score sums whole-span features of its entities and a weight for each kind after each.

    Features are hashed into 2**BITS rows of `weights`, with a column for each
    kind; `moves[x, y]` is the weight of kind y after kind x, the last row and
    column being the outside.
    """

    def __init__(self):
        self.weights = np.zeros((1 << BITS, len(ALL_KINDS)))
        self.moves = np.zeros((len(ALL_KINDS) + 1, len(ALL_KINDS) + 1))

    @property
    def empty(self) -> bool:
        return not self.weights.any()

    @staticmethod
    def segments(text: str, atoms: list[tuple[int, int]], first: int, beyond: int, features: Features) -> tuple[list[tuple[int, int]], np.ndarray]:
        """The possible entities (first atom, atom beyond) that begin at the atoms from first to beyond - 1, and their hashed features, -1 where there are fewer."""
        found, hashed = [], []
        if first < beyond:
            zero = atoms[first][0]
            masked = text[zero : atoms[min(len(atoms), beyond + MAX_ATOMS) - 1][1]].translate(_MASK)
        for i in range(first, beyond):
            before, a = None, atoms[i][0]
            for j in possible_ends(text, atoms, i):
                before = before or _before(text, a)
                found.append((i, j))
                hashed.append(features.of(text, atoms, i, j, before, masked[a - zero : atoms[j - 1][1] - zero]))
        width = max(map(len, hashed), default=0)
        return found, np.array([h + [-1] * (width - len(h)) for h in hashed], np.int64).reshape(len(found), width)

    def scores(self, hashed: np.ndarray) -> np.ndarray:
        return (self.weights[hashed] * (hashed >= 0)[:, :, None]).sum(1) if hashed.size else np.zeros((len(hashed), len(ALL_KINDS)))

    def best(self, text: str, start: int, end: int, window: int = WINDOW) -> list[Span]:
        """Viterbi over bounded segments: boundaries and kinds together.

        Segments are made and scored a window of starts at a time. Where no segment
        that could win covers a place, all paths pass outside there, so the best one
        up to it is settled and nothing of it is kept: memory is that of a window,
        but for as long as such segments chain. Windows do not change the result.
        """
        if self.empty:
            return []
        out, features = len(ALL_KINDS), Features()
        # the most that an entity of each kind can win over outside atoms by what stands before and after it
        gain = (self.moves[:, :out] - self.moves[:, out:]).max(0) + np.maximum(0.0, (self.moves[:out] - self.moves[out:]).max(1))
        spans: list[Span] = []
        atoms: list[tuple[int, int]] = []
        more = _ATOM.finditer(text, start, end)
        fresh = np.full(out + 1, -np.inf)
        fresh[out] = 0.0
        value, back, covered, settled, ended = {0: fresh}, {}, 0, 0, False
        i = 0
        while True:
            while not ended and len(atoms) < i + window + MAX_ATOMS:
                atom = next(more, None)
                ended = atom is None
                if not ended:
                    atoms.append(atom.span())
            beyond = len(atoms) if ended else i + window
            found, hashed = self.segments(text, atoms, i, beyond, features)
            scores = self.scores(hashed)
            length = np.array([b - a for a, b in found], np.int64)
            scores[scores + gain < (length - 1)[:, None] * self.moves[out, out]] = -np.inf
            starting: dict[int, list] = {}
            for n in np.flatnonzero(scores.max(1, initial=-np.inf) > -np.inf).tolist():
                starting.setdefault(found[n][0], []).append((found[n][1], scores[n]))
            for i in range(i, beyond):
                if i >= covered and i:  # all paths pass outside here
                    spans += _traced(atoms, back, i, out)
                    value, back, settled = {i: value[i]}, {}, i
                now = value.pop(i)
                step = now + self.moves[:, out]
                there = value.setdefault(i + 1, np.full(out + 1, -np.inf))
                there[out] = step.max()
                back[i + 1, out] = i, int(step.argmax())
                for j, s in starting.get(i, ()):
                    covered = max(covered, j + 1)
                    there = value.setdefault(j, np.full(out + 1, -np.inf))
                    reach = now[:, None] + self.moves[:, :out]
                    most = reach.max(0) + s
                    for k in np.flatnonzero(most > there[:out]).tolist():
                        there[k], back[j, k] = most[k], (i, int(reach[:, k].argmax()))
            i = beyond
            if ended:
                break
            if settled:
                atoms, i, covered = atoms[settled:], i - settled, covered - settled
                value = {j - settled: x for j, x in value.items()}
                back = {(j - settled, k): (b - settled, x) for (j, k), (b, x) in back.items()}
                settled = 0
        return spans + _traced(atoms, back, len(atoms), int(value[len(atoms)].argmax())) if atoms else spans

    def fit(self, regions_: list[tuple[str, int, int, list[Span]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> None:
        """regions_: texts with a region each and its true spans. The gradient of the conditional likelihood, by sums over all segmentations forwards and backwards."""
        made, features = [], Features()
        for text, start, end, spans in regions_:
            atoms = [m.span() for m in _ATOM.finditer(text, start, end)]
            found, hashed = self.segments(text, atoms, 0, len(atoms), features)
            first, last = {a: n for n, (a, _) in enumerate(atoms)}, {b: n + 1 for n, (_, b) in enumerate(atoms)}
            gold = {(first[a], last[b]): ALL_KINDS.index(k) for a, b, k in spans if a in first and b in last}
            made.append((len(atoms), found, hashed, gold))
        for epoch in range(epochs):
            for n, found, hashed, gold in made:
                self._step(n, found, hashed, gold, rate / (1 + epoch), decay)

    def _step(self, n: int, found: list, hashed: np.ndarray, gold: dict, step: float, decay: float) -> None:
        out = len(ALL_KINDS)
        scores = self.scores(hashed)
        ending: dict[int, list] = {}
        starting: dict[int, list] = {}
        for k, (i, j) in enumerate(found):
            ending.setdefault(j, []).append(k)
            starting.setdefault(i, []).append(k)
        ahead, before = np.full((n + 1, out + 1), -np.inf), np.empty((n + 1, out + 1))
        ahead[0, out] = 0.0
        for j in range(n + 1):
            if j:
                ahead[j, out] = before[j - 1, out]
                if own := ending.get(j):
                    ahead[j, :out] = _logsum(before[[found[k][0] for k in own], :out] + scores[own], 0)
            before[j] = _logsum(ahead[j][:, None] + self.moves, 0)
        behind, after = np.zeros((n + 1, out + 1)), np.empty((n + 1, out + 1))
        for i in range(n - 1, -1, -1):
            after[i, out] = behind[i + 1, out]
            after[i, :out] = -np.inf
            if own := starting.get(i):
                after[i, :out] = _logsum(behind[[found[k][1] for k in own], :out] + scores[own], 0)
            behind[i] = _logsum(self.moves + after[i][None, :], 1)
        total = behind[0, out]
        if found:
            i, j = np.array(found).T
            push = -np.exp(np.minimum(0.0, before[i, :out] + scores + behind[j, :out] - total))
            for k, place in enumerate(found):
                if place in gold:
                    push[k, gold[place]] += 1
            for f in range(hashed.shape[1]):
                there = hashed[:, f] >= 0
                np.add.at(self.weights, hashed[there, f], step * push[there])
            touched = np.unique(hashed[hashed >= 0])
            self.weights[touched] *= 1 - step * decay
        expected = sum(np.exp(np.minimum(0.0, ahead[i][:, None] + self.moves + after[i][None, :] - total)) for i in range(n))
        true = np.zeros_like(self.moves)
        kind, i = out, 0
        ends = {a: (b, k) for (a, b), k in gold.items()}
        while i < n:
            i, new = ends.get(i, (i + 1, out))
            true[kind, new] += 1
            kind = new
        self.moves += step * 0.1 * (true - expected)


def _traced(atoms: list[tuple[int, int]], back: dict[tuple[int, int], tuple[int, int]], j: int, k: int) -> list[Span]:
    """Entities of the path that ends at atom j with kind k, in order, as far back as it is known."""
    spans, out = [], len(ALL_KINDS)
    while (j, k) in back:
        i, before = back[j, k]
        if k != out:
            spans.append((atoms[i][0], atoms[j - 1][1], ALL_KINDS[k]))
        j, k = i, before
    return spans[::-1]


def all_spans(text: str, model: SemiCRF) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the method's."""
    base = base_spans(text)
    if not _CUE.search(text):
        return base, base
    added, taken, n = [], sorted((a, b) for a, b, _ in base), 0
    for start, end in regions(text):
        while n < len(taken) and taken[n][1] <= start:
            n += 1
        # base spans stay, so the field segments what lies between them
        while start < end:
            stop = min(end, taken[n][0]) if n < len(taken) else end
            if stop > start and _CUE.search(text, start, stop):
                added += model.best(text, start, stop)
            if stop == end:
                break
            start = max(start, taken[n][1])
            n += 1
    return base, sorted(base + added, key=lambda s: (s[0], ALL_KINDS.index(s[2])))


def _card(rng: random.Random) -> str:
    body = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(rng.choice([13, 14, 14, 14])))
    return next(body + d for d in "0123456789" if luhn(body + d))


def noisy(kind: str, span: str, rng: random.Random) -> str:
    """A span as people write it to be read by people: spelled signs, other separators, blanks."""
    if kind == "email":
        at, dot = rng.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" @ ", "."), (" [at] ", "."), ("(at)", ".")])
        head, _, tail = span.partition("@")
        return head + at + tail.replace(".", dot)
    if kind == "ip":
        return span.replace(".", rng.choice(["[.]", " . ", "(.)", " [.] "]))
    digits = _digits(span)
    if kind == "card":
        return rng.choice([".", "/", "_", " - ", "  "]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    area, mid, end = digits[-10:-7] or "555", digits[-7:-4], digits[-4:]
    return rng.choice([f"({area}) {mid}-{end}", f"({area}){mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"00{digits[:1]} {area} {mid} {end}", f"{area} {mid} {end}"])


def _other(rng: random.Random) -> str:
    """Text with digits that is no personal data."""
    n = lambda a, b: rng.randint(a, b)
    bad = _card(rng)
    return rng.choice([
        f"version {n(0, 9)}.{n(0, 20)}.{n(0, 9)}", f"{n(0, 99)}.{n(0, 99)}", f"{n(1900, 2030)}-{n(1, 12):02d}-{n(1, 28):02d}", f"{n(0, 23)}:{n(0, 59):02d}:{n(0, 59):02d}", f"{n(1, 999)},{n(100, 999)},{n(100, 999)}", f"no. {n(1, 99999)}",
        f"{n(256, 999)}.{n(256, 999)}.{n(1, 99)}.{n(1, 9)}", bad[:-1] + str((int(bad[-1]) + n(1, 9)) % 10), f"chapter {n(1, 40)} verse {n(1, 99)}", f"{n(1, 99)} %", f"A-{n(1000, 99999)}", f"{n(1, 31)}/{n(1, 12)}/{n(1900, 2030)}", f"{n(1, 9)} @ {n(2, 99)}.{n(10, 99)} each", f"{n(100, 999)} {n(100, 999)} m", "(at) noon [at] home",
    ])


_CUES = {"secret": ["token", "key", "api_key", "secret", "password", "auth", "bearer"], "phone": ["tel", "call", "phone", ""], "card": ["card", "visa", ""], "email": ["mail", "write to", ""], "ip": ["host", "from", ""]}


def _secret(rng: random.Random) -> str:
    signs = rng.choice(["0123456789abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
    return "".join(rng.choice(signs) for _ in range(rng.choice([20, 24, 32, 40, 40, 64])))


def examples(found: list[tuple[str, str]], made: int = MADE, seed: int = 8) -> list[tuple[str, int, int, list[Span]]]:
    """Regions with true spans: `made` lines of true spans, plain and noisy, and of other texts with digits. found: true spans (kind, text) of the corpus; where a kind has none, they are drawn."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(rng.randint(2, 9)))
    drawn = {
        "email": lambda: f"{word()}{rng.choice(['', '.', '_'])}{rng.randint(1, 99) if rng.random() < 0.5 else word()}@{word()}.{rng.choice(['com', 'org', 'example.net', 'de'])}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": lambda: _card(rng),
        "phone": lambda: f"+{rng.randint(1, 99)} ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}",
    }
    own = {k: sorted({s for kind, s in found if kind == k}) for k in KINDS}
    out = []
    for _ in range(made):
        text, spans = word() + " ", []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice([*ALL_KINDS, "other", "other"])
            if kind == "other":
                text += _other(rng)
            else:
                cue = rng.choice(_CUES[kind])
                text += cue + (rng.choice([" ", ": ", " = ", "=", " = \""]) if cue else "")
                if kind == "secret":
                    span = _secret(rng)
                else:
                    span = rng.choice(own[kind]) if own[kind] and rng.random() < 0.5 else drawn[kind]()
                    span = noisy(kind, span, rng) if rng.random() < 0.6 else span
                spans.append((len(text), len(text) + len(span), kind))
                text += span
            text += rng.choice([" ", ", ", ". ", "\" ", "\n", "### ", " and "]) + rng.choice(["", word() + " ", word() + " " + word() + " "])
        out += [(text, a, b, [s for s in spans if a <= s[0] and s[1] <= b]) for a, b in regions(text)]
    return out


def train(docs: DataFrame, sample: int = SAMPLE, spans: int = SPANS, made: int = MADE) -> SemiCRF:
    """Fits the field in one task; only the weights, of a fixed size, come to the driver.

    Documented bounds: true spans of the corpus are the base spans of at most
    `sample` rows that hold a digit or an @, those with the least hash of doc_id
    and text, and of these at most `spans` different ones of a kind, those with
    the least hash and at most 80 characters; they are written plainly and
    noisily into `made` lines, where other spans are drawn. A corpus without base
    spans has drawn ones alone.
    """
    small_batches(docs.sparkSession)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            told = {(k, t[a:b]) for t in rows.column(0).to_pylist() for a, b, k in base_spans(t)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in told], pa.string()), pa.array([s for _, s in told], pa.string())], names=["kind", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(k, s) for rows in batches for k, s in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())]
        if found:  # one row at least, in one of the partitions
            model = SemiCRF()
            model.fit(examples([x for x in found if x[0]], made))
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([model.moves.tobytes()], pa.binary())], names=["weights", "moves"])

    cued = docs.where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("doc_id", "text").alias("h"))
    # hashes are picked first, so that no task reads texts of all others
    least = cued.select("h").orderBy("h").limit(sample).distinct()
    picked = cued.join(F.broadcast(least), "h", "left_semi").select("text").mapInArrow(collect, "kind string, span string").where(F.length("span") <= 80).distinct()
    ranked = picked.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("span"), "span"))).where(F.col("nth") <= spans)
    none = docs.sparkSession.createDataFrame([(None, None)], "kind string, span string")  # a corpus without spans has a field, too
    fitted = ranked.select("kind", "span").unionByName(none).coalesce(1).mapInArrow(run, "weights binary, moves binary").collect()
    model = SemiCRF()
    if fitted:
        model.weights = np.frombuffer(fitted[0].weights, np.float32).reshape(model.weights.shape).astype(np.float64)
        model.moves = np.frombuffer(fitted[0].moves, np.float64).reshape(model.moves.shape)
    return model


def find_spans(docs: DataFrame, model: SemiCRF) -> DataFrame:
    """doc_id, base and spans of every row: arrays of (start, end, kind) by start, then kind as listed."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [all_spans(t or "", sent.value) for t in rows.column(1).to_pylist()]
            cols = [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in x[n]] for x in found], kind) for n in (0, 1)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *cols], names=["doc_id", "base", "spans"])

    narrow = docs.select("doc_id", "text")
    spans = "array<struct<start:bigint,end:bigint,kind:string>>"
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, base {spans}, spans {spans}")


def redact(docs: DataFrame, model: SemiCRF) -> DataFrame:
    """The rows with each span of personal data replaced by its kind in angle brackets; a null text stays null."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for a, b, k in all_spans(text, sent.value)[1]:
            if a >= done:
                out += [text[done:a], f"<{k}>"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield rows.set_column(place, rows.schema.field(place), pa.array([clean(t) for t in rows.column(place).to_pylist()], rows.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_spans(docs, train(docs))
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))
