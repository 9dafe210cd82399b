"""Personal data by a semi-Markov conditional random field.

A text is cut into fields around digits and ``@``; the tokens of a field are segmented by dynamic
programming over whole candidate spans of bounded length. A span's score comes from features of
the span as a whole (its shape, checksum, context and edges) and from the kind of the span before
it, so boundaries and kinds are chosen jointly. Weights are fitted by gradient ascent on the
conditional likelihood of generated sentences. Plain patterns give the base spans, which always
stay; the field adds spans that touch none of them.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from array import array
from bisect import bisect_left
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import keyed_text, map_arrow, map_batches, slices

#: Kinds in the order in which spans of one start are listed; the last is found by the model only.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
#: Tokens of an entity at most, and of a stretch of a long field that is looked at in one go.
MOST_TOKENS, STRETCH = 16, 4096
#: Size, seed and passes of the training; the only bound on what the weights are learned from.
TRAIN_SENTENCES, TRAIN_SEED, TRAIN_PASSES = 120, 20, 30

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_EVIDENCE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\W_]+|[^\s]")
_LOOSE_FIELD = re.compile(r"[().+-]*+[0-9][0-9().+-]*+\Z")
_PREFIXED = re.compile(r"[A-Za-z]{2,9}[_-](?:[A-Za-z]{2,9}[_-])?[A-Za-z0-9]{16,}\Z")
_HEX = re.compile(r"[0-9a-fA-F]{24,}\Z")


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    """The ASCII digits of a text."""
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain patterns, leftmost and non-overlapping for each kind."""
    if not _EVIDENCE.search(text):
        return []
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(only_digits(m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=order)


def order(span: tuple[int, int, str]) -> tuple[int, int]:
    """Spans go by start, then by kind as listed."""
    return span[0], KINDS.index(span[2])


def fields(text: str) -> list[tuple[int, int]]:
    """Runs without white space that hold a digit or ``@``, with numeric neighbours one space away."""
    out: list[tuple[int, int]] = []
    end = 0
    for m in _EVIDENCE.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        if out and start - out[-1][1] == 1 and text[start - 1] == " " and _LOOSE_FIELD.match(text[start:end].rstrip(".,")) and _numeric_tail(text, *out[-1]):
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _numeric_tail(text: str, start: int, end: int) -> bool:
    """Whether a field ends in a numeric word."""
    return bool(_LOOSE_FIELD.match(text[max(start, text.rfind(" ", start, end) + 1) : end]))


#: Words before a span that speak for a kind.
CUES = {"email": ("mail", "email", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "iban", "account", "credit"), "phone": ("phone", "tel", "call", "fax", "mobile"), "secret": ("token", "key", "secret", "password", "apikey", "bearer")}
_CUE_OF = {w: k for k, words in CUES.items() for w in words}


def span_features(text: str, start: int, end: int, n_tokens: int) -> list[str]:
    """Features of a candidate span as a whole."""
    s = text[start:end]
    digits = only_digits(s)
    n = len(digits)
    before, after = text[start - 1 : start], text[end : end + 1]
    out = ["bias", f"digits={min(n, 20)}", f"tokens={min(n_tokens, 9)}"]
    out.append("edge" if (before.isalnum() or before in "@_" and before) or (after.isalnum() or after in "@_" and after) else "free")
    whole = {kind for a, b, kind in base_spans(s) if b - a == len(s)}
    if "email" in whole:
        out.append("like=email")
    elif "@" in s:
        out.append("like=at")
    if "ip" in whole:
        out.append("like=ip")
    if "phone" in whole:
        out.append("like=phone")
    elif re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", s):
        out.append("like=local_phone")
    if 13 <= n <= 19 and re.fullmatch(r"[0-9](?:[ -]?[0-9])+", s):
        out.append("like=luhn" if luhn(digits) else "like=digits")
        if re.fullmatch(r"[0-9]{4}(?:[ -][0-9]{4}){3}", s):
            out.append("like=groups")
    if _HEX.match(s) and any(c.isalpha() for c in s) and n:
        out.append("like=hex")
    elif s.isalnum() and len(s) >= 20 and n and any(c.isalpha() for c in s):
        out.append("like=mixed")
    elif n and _PREFIXED.match(s):
        out.append("like=prefixed")
    out.append(f"cue={cue_of(text, start)}")
    if before in "\"'" and before and after == before:
        out.append("quoted")
    return out


def cue_of(text: str, start: int) -> str:
    """The kind for which the word before a span speaks, or ``none``."""
    cue = re.search(r"([^\W\d_]+)\W{0,4}\Z", text[max(0, start - 24) : start])
    return _CUE_OF.get(cue[1].lower(), "none") if cue else "none"


def candidates(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The tokens of a field, and the spans of them (first, last + 1) that may be entities."""
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    return tokens, candidates_of(text, tokens)


def candidates_of(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans of tokens that hold evidence, begin with a word, ``+`` or ``(`` and end with a word."""
    holds = [bool(_EVIDENCE.search(text, *t)) for t in tokens]
    word = [text[a].isalnum() for a, _ in tokens]
    spans = []
    for i, (a, _) in enumerate(tokens):
        if not (word[i] or text[a] in "+("):
            continue
        seen = False
        for j in range(i, min(i + MOST_TOKENS, len(tokens))):
            seen = seen or holds[j]
            if seen and word[j]:
                spans.append((i, j + 1))
    return spans


class Paths:
    """The best segmentations of a run of tokens up to each place, by the kind that ends there. What is
    held for each place are two offsets and, in a byte for each kind, the step back."""

    def __init__(self, follow: np.ndarray, first: int = 0):
        self.follow, self.kinds = follow, len(KINDS) + 1
        self.first = self.at = self.reach = first
        self.best = {first: np.array([0.0] + [-np.inf] * len(KINDS))}
        self.back, self.starts, self.ends = bytearray(), array("q"), array("q")
        self.look = STRETCH

    def row(self, place: int) -> int:
        """The number of a place among those held, for which there is room then."""
        row = place - self.first
        if (short := row + 1 - len(self.starts)) > 0:
            self.back.extend(bytes(short * self.kinds))
            self.starts.extend([0] * short)
            self.ends.extend([0] * short)
        return row

    def step(self) -> None:
        """Goes one token on, taking it for a single other one."""
        past = self.best.pop(self.at) + self.follow[:, 0]
        y = int(past.argmax())
        self.at += 1
        self.best.setdefault(self.at, np.full(self.kinds, -np.inf))[0] = past[y]
        self.back[self.row(self.at) * self.kinds] = y

    def add(self, place: int, n: int, start: int, end: int, scores: np.ndarray) -> None:
        """Adds a span of ``n`` tokens from a place on; places don't go down."""
        while self.at < place:
            self.step()
        into = self.best[place][:, None] + self.follow[:, 1:] + scores
        top, by = into.max(0), into.argmax(0)
        best = self.best.setdefault(place + n, np.full(self.kinds, -np.inf))
        row = self.row(place + n)
        self.starts[place - self.first], self.ends[row] = start, end
        for y in np.flatnonzero(top > best[1:]).tolist():
            best[y + 1], self.back[row * self.kinds + y + 1] = top[y], n * self.kinds + int(by[y])
        self.reach = max(self.reach, place + n)

    def before(self, place: int, y: int) -> tuple[int, int]:
        """The place and kind before."""
        n, kind = divmod(self.back[(place - self.first) * self.kinds + y], self.kinds)
        return place - (n or 1), kind

    def settled(self, at_end: bool = False) -> list[tuple[int, int, str]]:
        """The spans of the best path to the end of the run; another token follows unless the field ends."""
        while self.at < self.reach:
            self.step()
        past = self.best[self.at] if at_end else self.best[self.at] + self.follow[:, 0]
        return self.spans(self.at, int(past.argmax()))

    def spans(self, place: int, y: int) -> list[tuple[int, int, str]]:
        """The spans on the path to a place and kind."""
        out = []
        while place > self.first:
            begin, kind = self.before(place, y)
            if y:
                out.append((self.starts[begin - self.first], self.ends[place - self.first], KINDS[y - 1]))
            place, y = begin, kind
        return out[::-1]

    def agreed(self) -> list[tuple[int, int, str]]:
        """The spans before the last place that all paths share, which are let go. Looks only when twice as
        much is held as the last look left."""
        if len(self.starts) < self.look:
            return []
        nodes = [(-place, y) for place, best in self.best.items() for y in np.flatnonzero(best > -np.inf).tolist()]
        heapify(nodes)
        while len(nodes) > 1:
            top = heappop(nodes)
            if top != nodes[0]:
                place, y = self.before(-top[0], top[1])
                heappush(nodes, (-place, y))
        place, y = -nodes[0][0], nodes[0][1]
        out, row = self.spans(place, y), place - self.first
        del self.back[: row * self.kinds], self.starts[:row], self.ends[:row]
        self.first, self.look = place, max(STRETCH, 2 * len(self.starts))
        return out


class Model:
    """Weights of span features by kind and of kind after kind; 0 is the kind of single other tokens."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))
        self.follow = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def ids_of(self, names: list[str], grow: bool = False) -> list[int]:
        if grow:
            for n in names:
                self.ids.setdefault(n, len(self.ids))
        return [self.ids[n] for n in names if n in self.ids]

    def lattice(self, text: str, start: int, end: int, grow: bool = False):
        """Tokens, and for each end the (first token, feature ids) of the spans that end there."""
        tokens, spans = candidates(text, start, end)
        ends: list[list[tuple[int, list[int]]]] = [[] for _ in range(len(tokens) + 1)]
        for i, j in spans:
            ends[j].append((i, self.ids_of(span_features(text, tokens[i][0], tokens[j - 1][1], j - i), grow)))
        return tokens, ends

    def decode(self, text: str, start: int, end: int) -> list[tuple[int, int, str]]:
        """The best segmentation of a field, as its entity spans.

        Only contenders are held against each other. Past the last token that one of them covers, all
        paths go through the same other token, so what lies before is decided there; in a longer run it
        is decided as soon as all paths back from its last tokens meet. Of equal scores the span that
        begins first wins, then the kind that is listed first."""
        out, paths, number = [], Paths(self.follow), 0
        for number, spans in self.contenders(text, start, end):
            if number > paths.reach:
                out += paths.settled()
                paths = Paths(self.follow, number)
            else:
                out += paths.agreed()
            for span in spans:
                paths.add(number, *span)
        return out + paths.settled(at_end=paths.reach == number)

    def contenders(self, text: str, start: int, end: int):
        """For each token at which a span begins that a best segmentation may hold, its number and these
        spans as (tokens, start, end, scores by kind); at last the number of all tokens and no span.

        A span that scores less than its tokens as single others, whatever kinds stand beside it, is in
        no best segmentation. In a stretch of many tokens a bound from counts drops most of these before
        their features are looked at."""
        margin = self.margins()
        found, tokens, number, last = _TOKEN.finditer(text, start, end), [], 0, False
        while not last:
            fresh = [m.span() for m in islice(found, STRETCH)]
            tokens += fresh
            last = len(fresh) < STRETCH
            whole = len(tokens) if last else len(tokens) - MOST_TOKENS + 1
            likely = self.likely(text, tokens, whole, margin) if len(tokens) > 4 * MOST_TOKENS else candidates_of(text, tokens)
            at, spans = -1, []
            for i, j in likely:
                scores = self.weights[self.ids_of(span_features(text, tokens[i][0], tokens[j - 1][1], j - i))].sum(0)
                if (scores + margin[j - i] < 0).all():
                    continue
                if i != at and spans:
                    yield number + at, spans
                    spans = []
                at = i
                spans.append((j - i, tokens[i][0], tokens[j - 1][1], scores))
            if spans:
                yield number + at, spans
            tokens, number = tokens[whole:], number + whole
        yield number, []

    def margins(self) -> np.ndarray:
        """By tokens and kind: the most that a span gains from the kinds beside it over single others, with
        something for rounding."""
        into = (self.follow[:, 1:] - self.follow[:, :1]).max(0)
        out_of = np.maximum((self.follow[1:] - self.follow[0]).max(1), 0)
        return into + out_of - (np.arange(MOST_TOKENS + 1)[:, None] - 1) * self.follow[0, 0] + 1e-6

    def most(self, *names: str) -> np.ndarray:
        """By kind, the most that one of these features, or none, adds to a score."""
        return np.maximum(self.weights[self.ids_of(list(names))].max(0, initial=0.0), 0.0)

    def weight(self, name: str) -> np.ndarray:
        """By kind, what a feature adds to a score."""
        return self.weights[self.ids_of([name])].sum(0)

    def likely(self, text: str, tokens: list[tuple[int, int]], whole: int, margin: np.ndarray) -> list[tuple[int, int]]:
        """The spans (first, last + 1) from the first ``whole`` tokens that may be entities, without those
        that a bound from counts of digits, tokens and marks shows to be none."""
        low = max(0, tokens[0][0] - 5)
        chars = np.frombuffer(text[low : tokens[-1][1]].encode("ascii", "replace"), np.uint8)
        a, b = np.array(tokens).T
        first = chars[a - low]
        digit = ((chars >= 48) & (chars <= 57)).view(np.uint8)
        bounds = np.column_stack((a, b)).ravel()[:-1] - low
        digits = np.add.reduceat(digit, bounds, dtype=np.int64)[::2]
        word = ((first | 32) >= 97) & ((first | 32) <= 122) | (first >= 48) & (first <= 57)
        for i in np.flatnonzero((first == 63) & ~word).tolist():
            word[i] = text[a[i]].isalnum()
        sign = first == 64
        sums = lambda x: np.r_[0, np.cumsum(x)]
        n_digits, n_held, n_sign = sums(digits), sums((digits > 0) | sign), sums(sign)
        plain = digits == b - a
        n_not_card, n_not_ip = sums(~plain & (first != 45)), sums(~plain & (first != 46))
        begins = np.flatnonzero((word | (first == 43) | (first == 40))[:whole])
        fixed = np.tile(self.weight("bias") + np.maximum(self.weight("edge"), self.weight("free")), (len(tokens), 1))
        before = np.stack([chars[np.maximum(a - low - k, 0)] for k in range(1, 6)])
        near = (((before | 32) >= 97) & ((before | 32) <= 122) | (before == 63)).any(0)
        cues = {k: self.weight(f"cue={k}") for k in (*CUES, "none")}
        fixed += cues["none"]
        for i in begins[near[begins]].tolist():  # letters so near may be a cue
            fixed[i] += cues[cue_of(text, a[i])] - cues["none"]
        fixed[(before[0] == 34) | (before[0] == 39)] += self.most("quoted")
        fixed[first == 43] += self.most("like=phone")
        by_digits = np.stack([self.weight(f"digits={n}") for n in range(21)])
        like_at, like_ip, like_local = self.most("like=email", "like=at"), self.most("like=ip"), self.most("like=local_phone")
        like_card, like_key = self.most("like=luhn", "like=digits") + self.most("like=groups"), self.most("like=hex", "like=mixed", "like=prefixed")
        out = []
        for size in range(1, MOST_TOKENS + 1):
            i = begins[begins + size <= len(tokens)]
            j = i + size
            kept = word[j - 1] & (n_held[j] > n_held[i])
            i, j = i[kept], j[kept]
            n = n_digits[j] - n_digits[i]
            bound = fixed[i] + by_digits[np.minimum(n, 20)] + self.weight(f"tokens={min(size, 9)}") + margin[size]
            bound[n_sign[j] > n_sign[i]] += like_at
            bound[(n >= 13) & (n <= 19) & (n_not_card[j] == n_not_card[i])] += like_card
            if size == 7:
                bound[n_not_ip[j] == n_not_ip[i]] += like_ip
            if size <= 7:
                bound[n == 10] += like_local
            if size <= 5:
                bound[b[j - 1] - a[i] >= 19] += like_key
            kept = (bound >= 0).any(1)
            out += zip(i[kept].tolist(), j[kept].tolist(), strict=True)
        return sorted(out)

    def learn(self, sentences: list[tuple[str, list[tuple[int, int, str]]]]) -> None:
        """Fits the weights by gradient ascent (Adagrad steps, L2 penalty) on the likelihood."""
        data = []
        for text, gold in sentences:
            for a, b in fields(text):
                tokens, ends = self.lattice(text, a, b, grow=True)
                at = {t[0]: i for i, t in enumerate(tokens)} | {-t[1]: i + 1 for i, t in enumerate(tokens)}
                known = [(at[s], at[-e], KINDS.index(y) + 1) for s, e, y in gold if s >= a and e <= b and s in at and -e in at]
                data.append((len(tokens), ends, known))
        self.weights = np.zeros((len(self.ids), len(KINDS)))
        past_w, past_f = np.full(self.weights.shape, 1e-6), np.full(self.follow.shape, 1e-6)
        for _ in range(TRAIN_PASSES):
            grad_w, grad_f = -0.02 * self.weights, -0.02 * self.follow
            for n, ends, known in data:
                self.gradient(n, ends, known, grad_w, grad_f)
            past_w += grad_w**2
            past_f += grad_f**2
            self.weights += 0.4 * grad_w / np.sqrt(past_w)
            self.follow += 0.4 * grad_f / np.sqrt(past_f)
        # multiples of a power of two add up exactly in any order, so ties are ties wherever a path begins
        self.weights, self.follow = np.round(self.weights * 2**20) / 2**20, np.round(self.follow * 2**20) / 2**20

    def gradient(self, n, ends, known, grad_w, grad_f) -> None:
        """Adds observed less expected counts of one field, by forward and backward sums."""
        k = len(KINDS) + 1
        alpha, beta = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        alpha[0, 0] = 0.0
        scores = [[(i, ids, self.weights[ids].sum(0)) for i, ids in spans] for spans in ends]
        for j in range(1, n + 1):
            alpha[j, 0] = np.logaddexp.reduce(alpha[j - 1] + self.follow[:, 0])
            for i, _, s in scores[j]:
                alpha[j, 1:] = np.logaddexp(alpha[j, 1:], np.logaddexp.reduce(alpha[i][:, None] + self.follow[:, 1:], 0) + s)
        beta[n] = 0.0
        for j in range(n, 0, -1):
            beta[j - 1] = np.logaddexp(beta[j - 1], self.follow[:, 0] + beta[j, 0])
            for i, _, s in scores[j]:
                beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(self.follow[:, 1:] + s + beta[j, 1:], 1))
        z = np.logaddexp.reduce(alpha[n])
        for j in range(1, n + 1):
            grad_f[:, 0] -= np.exp(alpha[j - 1] + self.follow[:, 0] + beta[j, 0] - z)
            for i, ids, s in scores[j]:
                p = np.exp(alpha[i][:, None] + self.follow[:, 1:] + s + beta[j, 1:] - z)
                grad_f[:, 1:] -= p
                grad_w[ids] -= p.sum(0)
        spans = {(j, i): ids for j in range(n + 1) for i, ids in ends[j]}
        place, before = 0, 0
        for i, j, y in [*sorted(known), (n, n, -1)]:
            while place < i:
                grad_f[before, 0] += 1
                place, before = place + 1, 0
            if y > 0 and (j, i) in spans:
                grad_f[before, y] += 1
                grad_w[spans[j, i], y - 1] += 1
                place, before = j, y


def sentences(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated training sentences: words, entities of each kind in varied forms, and numbers,
    dates, versions and checksums that are none."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        body = digits(15)
        body = next(body + c for c in "0123456789" if luhn(body + c))
        return rng.choice((body, body, "-".join(body[i : i + 4] for i in range(0, 16, 4)), " ".join(body[i : i + 4] for i in range(0, 16, 4))))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice((f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(11)}"))

    mixed = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n - 2)) + rng.choice(string.ascii_letters) + digits(1)

    def secret() -> str:
        plain = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((32, 40, 64))))
        return rng.choice((plain, plain, mixed(rng.choice((20, 24, 40))), f"{word()[:4]}_{mixed(rng.choice((24, 36)))}"))

    entity = {
        "email": lambda: f"{rng.choice((word(), word() + '.' + digits(2), digits(2), word() + '_' + word()))}@{word()}{rng.choice(('', digits(1)))}.{rng.choice(('example.com', 'org', 'co.uk'))}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card, "phone": phone, "secret": secret,
    }
    other = [lambda: digits(rng.randint(1, 8)), lambda: f"{digits(1)}.{digits(1)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"@{word()}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{word()}{digits(2)}", lambda: next(d for d in iter(lambda: digits(16), None) if not luhn(d)), lambda: ".".join((digits(3), "9" + digits(2), "7" + digits(2), digits(2))), lambda: digits(25), lambda: rng.choice((",", ";", "/", ", ")).join(digits(rng.randint(1, 3)) for _ in range(rng.randint(4, 24)))]
    out = []
    for _ in range(count):
        text, gold = word().capitalize(), []
        for _ in range(rng.randint(2, 5)):
            text += "".join(" " + word() for _ in range(rng.randint(1, 4))) + rng.choice((" ", " ", ". ", ", ", "\n"))
            if rng.random() < 0.6:
                kind = rng.choice(KINDS)
                if kind == "secret" or rng.random() < 0.3:
                    text += rng.choice(CUES[kind]) + rng.choice((" ", ": ", " = "))
                value, quote = entity[kind](), '"' if kind == "secret" and rng.random() < 0.6 else ""
                text += quote
                gold.append((len(text), len(text) + len(value), kind))
                text += value + quote + rng.choice(("", "", ".", ",", "###", ")"))
            else:
                text += rng.choice(other)() + rng.choice(("", ".", ","))
        out.append((text + " " + word() + ".", gold))
    return out


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model, fitted once in a driver process."""
    model = Model()
    model.learn(sentences(TRAIN_SENTENCES, TRAIN_SEED))
    return model


def find(text: str, model: Model) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans of a text, and all spans: the base ones and what the model adds beside them."""
    base = base_spans(text)
    if not base and not _EVIDENCE.search(text):
        return [], []
    taken = sorted(base)
    starts, ends = [x[0] for x in taken], list(accumulate((x[1] for x in taken), max))
    added, at = [], 0
    for a, b in fields(text):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        near = taken[at : bisect_left(starts, b, at)] if at < len(taken) else []
        if len(near) == 1 and near[0][0] - a <= 1 and b - near[0][1] <= 2:
            continue  # the field is that base span, but for a mark at its edge
        for s in model.decode(text, a, b):
            before = bisect_left(starts, s[1])  # base spans that begin before its end
            if not before or ends[before - 1] <= s[0]:
                added.append(s)
    return base, sorted(base + added, key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end of each span, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one."""
    out, done = [], 0
    for a, b, kind in sorted(spans, key=order):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def detect(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: key, n_email, n_ip, n_card, n_phone (base spans), n_secret (which
    the model alone finds), n_spans (all spans), base_sha256 (of the base spans as kind:start:end,
    comma-joined), spans (all spans, joined likewise; in code points, end exclusive) and redacted (the
    text with every span replaced).

    A null text counts as empty and has no spans; a null key stays null; repeated rows give
    repeated rows; other columns are not read. No shuffle; the model is a few hundred numbers.
    """
    model = trained()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for body in batch.column(1).to_pylist():
                base, spans = find(body, model)
                rows.append([*(sum(s[2] == k for s in base) for k in BASE_KINDS), sum(s[2] == "secret" for s in spans), len(spans), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redacted(body, spans) if spans else body])
            columns = [list(c) for c in zip(*rows, strict=True)]
            types = [pa.int64()] * 6 + [pa.string()] * 3
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, "n_email", "n_ip", "n_card", "n_phone", "n_secret", "n_spans", "base_sha256", "spans", "redacted"])

        return work

    return map_batches(keyed_text(df, key, text), make, f"{key} long, n_email long, n_ip long, n_card long, n_phone long, n_secret long, n_spans long, base_sha256 string, spans string, redacted string")


def redact(df: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``df`` with every span in ``text`` replaced by its kind in brackets, and ``length``, where
    there is such a column, the new number of code points. Null texts stay null; other columns and
    rows without a span stay as they are."""
    place, model = df.columns.index(text), trained()

    def run(batches):
        for batch in batches:
            for piece in slices(batch, place):
                out = []
                for body in piece.column(place).to_pylist():
                    spans = find(body, model)[1] if body else []
                    out.append(redacted(body, spans) if spans else body)
                columns = list(piece.columns)
                columns[place] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=piece.schema.names)

    out = map_arrow(df, run, df.schema)
    if length not in df.columns:
        return out
    return out.withColumn(length, F.coalesce(F.length(text).cast(df.schema[length].dataType), F.col(length)))
