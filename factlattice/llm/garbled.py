"""Finding and repairing text that was decoded with the wrong character encoding.

1. Over all distinct texts, count in how many each pair of adjacent characters occurs (pairs with at least one character beyond
   ASCII; ASCII letters, digits, blanks and signs, and syllables are folded into classes, so the table is bounded by the
   alphabets in use). The pointwise mutual information of a pair tells how well its characters go together.
2. In each text, runs of characters beyond ASCII with their neighbours are scored by pairs that go badly together; the
   maximum-scoring segment of a run decides whether the run is improbable. Runs are also put to the test, however frequent their
   pairs, if a text has several different characters that are strict UTF-8 of more than one byte under one encoding.
3. Only inside improbable runs, inverse mappings are tried: encode with the encoding the text was wrongly read in, decode with
   the one it was written in, up to three times over. A mapping's gain is the log-likelihood ratio of the repaired against the
   garbled run, in context, under the pair table. Gains of the runs of a text add up along the text, again as a
   maximum-scoring segment, so weak evidence repeated counts, and a damaged part of a sound text is found.

A text is damaged if a segment gains enough, or if it holds a replacement character (U+FFFD), whose original is lost, or a
control character of the C1 range, which no sound text has. Null, empty and pure ASCII texts are never damaged.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlattice.session import cut, spread

# Bounds of memory alone: no result depends on them.
PIECE, PIECES = 250_000, 64  # pairs in a piece of the table, and pieces that a worker holds at a time
MAX_PAIRS = 1_000_000  # counts of pairs, looked up before, that a worker remembers
CHARACTERS_AT_ONCE = 200_000
SMOOTH = 0.3
ODD = -0.4  # mutual information (nats) below which a pair counts as badly matched
RARE = 0.02  # share of texts below which a pair is too rare for its mutual information to say much
# nats that the runs of a segment must gain together, and the best of them by itself: UTF-8 proves itself by its structure,
# any byte is a letter in the other encodings
GAIN, RUN_GAIN = {True: 2.0, False: 5.0}, {True: 2.0, False: 3.0}
PROOF = 4.0  # nats by which the UTF-8 structure of different characters of a text must be unlikely by chance
_SEQUENCE = {2: 2.14, 3: 3.47, 4: 5.32}  # nats: how unlikely random bytes beyond ASCII are a sequence of 2, 3 or 4
CONTRADICTION = -4.0  # a run that the mapping can't explain

# Encodings that texts are wrongly read in, and those they are written in.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp866", "koi8-r", "iso8859-2",
    "iso8859-5", "iso8859-7", "iso8859-15", "cp932", "gbk", "big5", "cp949", "euc_jp")
WRITTEN_IN = ("utf-8", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic", "cp1253", "iso8859-7", "cp1250", "iso8859-2", "cp1252", "mac_roman",
    "cp437", "cp850", "cp1254", "cp1258", "cp932", "euc_jp", "gbk", "big5", "cp949")
_WIDE = {"cp932", "gbk", "big5", "cp949", "euc_jp"}  # their second bytes may be ASCII
_WIDE_PLANS = [(w, ["cp932", "euc_jp", "gbk", "big5", "cp949"]) for w in ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r")]
_UTF8_PLANS = [(w, ["utf-8"]) for w in READ_AS if w not in _WIDE]
_RUN = re.compile("[^\x00-\x7f]+")
_HIGH = "[^\x00-\x7f\u1100-\u11ff\u2e80-\ud7ff\uf900-\ufaff\ufe30-\uffef]"  # kana, Han and Hangul are in no encoding of one byte
_WIDE_RUN = re.compile(f"{_HIGH}(?:{_HIGH}|[@-~](?={_HIGH})|[@-~][@-~](?={_HIGH}))*[@-~]?")
_UTF8 = re.compile(b"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_C1 = re.compile("[\x80-\x84\x86-\x9f]")
EDGE = 0  # before the first and after the last character

# classes below 32, where no character of interest lies
_LOWER, _UPPER, _DIGIT, _BLANK, _SIGN, _HANGUL, _HIRA, _KATA, _OTHER_WIDE = range(1, 10)


def fold_codes(codes: np.ndarray) -> np.ndarray:
    """Code points with ASCII and the large scripts folded into classes."""
    out = codes.astype(np.int64)
    ascii_ = codes < 128
    out[ascii_] = _SIGN
    out[(codes >= 97) & (codes <= 122)] = _LOWER
    out[(codes >= 65) & (codes <= 90)] = _UPPER
    out[(codes >= 48) & (codes <= 57)] = _DIGIT
    out[(codes == 32) | ((codes >= 9) & (codes <= 13))] = _BLANK
    out[(codes >= 0xAC00) & (codes <= 0xD7A3)] = _HANGUL
    out[(codes >= 0x3041) & (codes <= 0x309F)] = _HIRA
    out[(codes >= 0x30A0) & (codes <= 0x30FF)] = _KATA
    out[codes >= 0x20000] = _OTHER_WIDE
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def text_pairs(*texts: str) -> np.ndarray:
    """The distinct pairs of each text as a * 2**21 + b, all texts' one after another; each text edge is a neighbour too."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    c = fold_codes(_codes("\0".join(("", *texts, ""))))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    c[edges] = EDGE
    a, b = c[:-1], c[1:]
    keep = (a >= 32) | (b >= 32) | ((a >= _HANGUL) & (a <= _OTHER_WIDE)) | ((b >= _HANGUL) & (b <= _OTHER_WIDE))
    which = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)[keep]
    return np.unique((which << 42) + (a[keep] << 21) + b[keep]) & ((1 << 42) - 1)


def pair_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pair BIGINT, n BIGINT): in how many distinct texts each pair occurs; pair -1 has the number of texts with any character.

    Copies count once: a garbled text that fills a large part of the rows doesn't become usual by that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, part, size, texts = [], [], 0, 0
            for t in batch.column(0):
                s = t.as_py()
                if s:
                    texts += 1
                    if not s.isascii():
                        part.append(s)
                        size += len(s)
                        if size >= CHARACTERS_AT_ONCE:
                            found.append(np.unique(text_pairs(*part), return_counts=True))
                            part, size = [], 0
            if part:
                found.append(np.unique(text_pairs(*part), return_counts=True))
            pairs = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in found), [-1]]).astype(np.int64)
            n = np.concatenate([np.zeros(0, np.int64), *(k for _, k in found), [texts]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    return docs.select(text).where(F.col(text) != "").distinct().mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=64)
def _byte_table(encoding: str) -> dict[str, int]:
    """By character the byte that an encoding of one byte reads as it; positions it leaves undefined were kept as they are."""
    table = {}
    for b in range(256):
        try:
            table.setdefault(bytes([b]).decode(encoding), b)
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0x100):
        table.setdefault(chr(b), b)
    return table


@dataclass
class _Own:
    """A piece of the pair table that isn't broadcast."""

    value: tuple[np.ndarray, np.ndarray]


class PairTable(dict):
    """In how many texts each pair occurs: what was looked up is remembered, the rest read from sorted pieces when needed."""

    def __init__(self, pieces: list[tuple]):
        self.pieces = pieces
        self.firsts = [first for first, _ in pieces]
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __missing__(self, pair: int) -> int:
        n = 0
        if (i := bisect_right(self.firsts, pair) - 1) >= 0:
            pairs, counts = self._piece(i)
            k = int(pairs.searchsorted(pair))
            n = int(counts[k]) if k < len(pairs) and pairs[k] == pair else 0
        if len(self) >= MAX_PAIRS:
            self.clear()
        self[pair] = n
        return n

    def _piece(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        piece = self.held.pop(i, None)
        if piece is None:
            source = self.pieces[i][1]
            piece = source.value
            if getattr(source, "_path", None):  # a broadcast keeps what it has read, but can read it again
                source.__dict__.pop("_value", None)
            if len(self.held) >= PIECES:
                del self.held[next(iter(self.held))]
        self.held[i] = piece  # the last used is last
        return piece


class Repairer:
    """Scores and repairs texts under a pair table."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, before: dict[int, int] | None = None, after: dict[int, int] | None = None,
            pieces: list[tuple] | None = None):
        """``pieces``: the table in order, as the first pair of each piece and the broadcast of its sorted pairs and their counts, read
        when needed; without them ``pairs`` is the whole table. ``before``, ``after``: by character, the greatest count of its pairs,
        where ``pairs`` doesn't hold all."""
        total = counts[pairs == -1]
        self.texts = max(1, int(total[0])) if len(total) else 1
        keep = pairs >= 0
        pairs, counts = pairs[keep], counts[keep]
        order = np.argsort(pairs)
        self.pair = PairTable([(0, _Own((pairs[order], counts[order])))] if pieces is None else pieces)
        self.before: dict[int, int] = dict(before or {})
        self.after: dict[int, int] = dict(after or {})
        for p, n in zip(pairs.tolist(), counts.tolist(), strict=True):
            a, b = p >> 21, p & 0x1FFFFF
            self.before[a] = max(self.before.get(a, 0), n)
            self.after[b] = max(self.after.get(b, 0), n)
        for c in range(_SIGN + 1):  # nearly every text has these
            self.before[c] = self.after[c] = self.texts
        self.plans = self._plans()
        self.order = {(w, t): i for i, (w, t) in enumerate((w, t) for w, ts in self.plans for t in ts)}
        self.cache: dict = {}
        self.folded: dict[str, int] = {}

    @staticmethod
    def _plans() -> list[tuple[str, list[str]]]:
        return [(w, [t for t in WRITTEN_IN if w != t and not (w in _WIDE and t != "utf-8")]) for w in READ_AS]

    def _fold(self, c: str) -> int:
        got = self.folded.get(c)
        if got is None:
            got = self.folded[c] = int(fold_codes(np.array([ord(c)], np.uint32))[0]) if c else EDGE
        return got

    def _pair(self, a: int, b: int) -> int:
        """In how many texts a pair occurs."""
        return self.pair[(a << 21) + b]

    def _log_likelihood(self, before: str, run: str, after: str) -> float:
        total, a = 0.0, self._fold(before)
        for c in [*run, after]:
            b = self._fold(c)
            if a > _SIGN or b > _SIGN:
                total += math.log((self._pair(a, b) + SMOOTH) / (self.before.get(a, 0) + SMOOTH * 100))
            a = b
        return total

    def _rarest(self, before: str, run: str, after: str) -> int:
        """In how many texts the rarest pair of a run occurs."""
        codes = [self._fold(c) for c in [before, *run, after]]
        return min((self._pair(a, b) for a, b in zip(codes, codes[1:], strict=False) if a > _SIGN or b > _SIGN), default=self.texts)

    def information(self, a: int, b: int) -> float:
        """Pointwise mutual information of a pair, in nats, over texts."""
        return math.log((self._pair(a, b) + SMOOTH) * self.texts / ((self.before.get(a, 0) + SMOOTH) * (self.after.get(b, 0) + SMOOTH)))

    def _worst(self, before: str, run: str, after: str) -> tuple[float, int, int]:
        """Score of the maximum-scoring segment of pairs that match badly, or that few texts have; the first and the last of its pairs,
        where pair k is that before character k of the run."""
        best, first, last = 0.0, 0, 0
        here, start = 0.0, 0
        a = self._fold(before)
        for k, c in enumerate([*run, after]):
            b = self._fold(c)
            if a > _SIGN or b > _SIGN:
                rare = math.log(RARE * self.texts / (self._pair(a, b) + SMOOTH))
                here += min(3.0, max(-1.0, ODD - self.information(a, b), rare))
                if here <= 0:
                    here, start = 0.0, k + 1
                elif here > best:
                    best, first, last = here, start, k
            a = b
        return best, first, last

    def improbable(self, before: str, run: str, after: str) -> bool:
        """Whether the maximum-scoring segment of a run is positive."""
        return self._worst(before, run, after)[0] > 0

    def _parts(self, before: str, run: str, after: str) -> list[tuple[int, int]]:
        """Parts of an odd run that a mapping explains better than any explains the whole: sound characters may touch garbled ones.

        Tried are the stretches of strict UTF-8 under each encoding of one byte and, where nothing explains the whole, the worst segment
        with its ends moved to where the characters can be encoded."""
        key = ("parts", self._fold(before), run, self._fold(after))
        got = self.cache.get(key)
        if got is not None:
            return got
        n, (options, strong) = len(run), self._options(before, run, after)
        whole = max((options[p][0] for p in strong), default=0.0)
        spans: set[tuple[int, int]] = set()
        for wrong in READ_AS:
            if wrong not in _WIDE:
                table = _byte_table(wrong)
                spans.update(m.span() for m in _UTF8.finditer(bytes([table.get(c, 0) for c in run])))
        utf8 = set(spans)
        if not strong:
            _, first, last = self._worst(before, run, after)
            for first, last in {(first, last), (max(0, first - 1), min(n, last + 1))}:
                spans.add((first, last))
                for wrong in READ_AS:
                    table = None if wrong in _WIDE else _byte_table(wrong)
                    known = [c in table if table else self._bytes(c, wrong) is not None for c in run]
                    i, j = first, last
                    while i < j and not known[i]:
                        i += 1
                    while i < j and not known[j - 1]:
                        j -= 1
                    if i < j and all(known[i:j]):
                        while i > 0 and known[i - 1]:
                            i -= 1
                        while j < n and known[j]:
                            j += 1
                        spans.add((i, j))
        scored = []
        for i, j in spans - {(0, n)}:
            if i < j:
                plans = _UTF8_PLANS if (i, j) in utf8 else None
                found, best = self._options(run[i - 1] if i else before, run[i:j], run[j] if j < n else after, plans)
                gain = max((found[p][0] for p in best), default=0.0)
                if gain > whole:
                    scored.append((gain, i, j))
        got = []
        for _, i, j in sorted(scored, reverse=True):
            if all(j <= x or y <= i for x, y in got):
                got.append((i, j))
        got = self.cache[key] = sorted(got)
        return got

    @staticmethod
    def _bytes(text: str, encoding: str) -> bytes | None:
        """The bytes that were read as ``text``; positions that the encoding leaves undefined were kept as they are. None where no
        bytes would be read so: encoders that put one sign for another, such as a backslash for a yen sign, prove nothing."""
        if encoding not in _WIDE:
            table = _byte_table(encoding)
            try:
                return bytes([table[c] for c in text])
            except KeyError:
                return None
        try:
            data = text.encode(encoding)
            return data if data.decode(encoding, "replace") == text else None
        except UnicodeEncodeError:
            return None

    @staticmethod
    def _decode(data: bytes, right: str, run: str, after: str) -> str | None:
        try:
            return data.decode(right)
        except UnicodeDecodeError:
            if right == "utf-8" and after == " " and data[-1] >= 0xC2:  # a no-break space that became a plain one
                try:
                    return (data + b"\xa0").decode(right)
                except UnicodeDecodeError:
                    return None
            return None

    def _plausible(self, text: str) -> bool:
        """Whether the corpus has every character of ``text``."""
        known = self.before
        return all(self._fold(c) in known or self._fold(c) in self.after for c in text)

    def _structure(self, run: str) -> dict[str, tuple[dict[str, float], float]]:
        """By encoding of one byte a character under which ``run`` is strict UTF-8 of characters that the corpus has: those of more
        than one byte that prove something, and the nats that all speak against chance. Where only letters stand for a character,
        they may be a word of some language and prove nothing."""
        key = ("structure", run)
        got = self.cache.get(key)
        if got is None:
            got = {}
            for wrong in READ_AS if len(run) > 1 else ():
                data = None if wrong in _WIDE else self._bytes(run, wrong)
                fixed = self._decode(data, "utf-8", run, "") if data else None
                if fixed and not fixed.isascii() and self._plausible(fixed):
                    at, found = 0, {}
                    for c in fixed:
                        n = len(c.encode())
                        if n > 1:
                            found[c] = (_SEQUENCE[n], run[at : at + n].isalpha())
                        at += n
                    got[wrong] = {c: w for c, (w, letters) in found.items() if not letters}, sum(w for w, _ in found.values())
            self.cache[key] = got
        return got

    def _proven(self, runs: list[str]) -> set[str]:
        """The encodings under which the runs of a text hold different UTF-8 characters enough to prove it."""
        found: dict[str, dict[str, float]] = {}
        for run in runs:
            if len(run) > 1 and not run.isalpha():
                for wrong, (chars, _) in self._structure(run).items():
                    found.setdefault(wrong, {}).update(chars)
        return {wrong for wrong, chars in found.items() if sum(chars.values()) >= PROOF}

    def _options(self, before: str, run: str, after: str, plans=None) -> tuple[dict, list]:
        """For each mapping (wrong, right) that yields other, plausible text: (gain, repaired); and the mappings that gain much."""
        plans = plans or self.plans
        key = (self._fold(before), run, self._fold(after), len(plans))
        got = self.cache.get(key)
        if got is not None:
            return got
        base = self._log_likelihood(before, run, after)
        gains: dict[str, tuple[float, str] | None] = {}
        decoded: dict[tuple[bytes, str], str | None] = {}
        options: dict[tuple[str, str], tuple[float, str]] = {}
        for wrong, rights in plans:
            data = self._bytes(run, wrong)
            if data is None or data.isascii():  # characters beyond ASCII were never read from ASCII bytes
                continue
            for right in rights:
                if (data, right) not in decoded:
                    decoded[(data, right)] = self._decode(data, right, run, after)
                text = decoded[(data, right)]
                if not text or text == run:
                    continue
                if text not in gains:
                    gains[text] = None
                    if self._plausible(text) or (right == "utf-8" and len(run) > 2):  # two characters by chance make one that nobody uses
                        gain = self._log_likelihood(before, text, after) - base
                        if right == "utf-8":  # garbled pairs follow each other as surely as sound ones, but in fewer texts
                            gain += math.log((self._rarest(before, text, after) + SMOOTH) / (self._rarest(before, run, after) + SMOOTH))
                        final = text
                        if right == "utf-8" and not text.isascii() and len(text) < len(run):  # garbled more than once?
                            inner = max((o for p, o in self._options(before, text, after)[0].items() if p[1] == "utf-8"), default=None)
                            if inner and inner[0] > 0:
                                gain, final = gain + inner[0], inner[1]
                        gains[text] = (gain, final)
                if gains[text] is not None:
                    options[(wrong, right)] = gains[text]
        if len(self.cache) > 200_000:
            self.cache.clear()
        got = self.cache[key] = (options, [p for p, o in options.items() if o[0] >= RUN_GAIN[p[1] == "utf-8"]])
        return got

    def examine(self, text: str | None) -> tuple[bool, str | None, float, str | None]:
        """(damaged, repaired text, gain, mapping). The repaired text is the text itself where nothing is recoverable."""
        if not text or text.isascii():
            return False, text, 0.0, None
        lost = "�" in text
        control = bool(_C1.search(text))
        runs: list[tuple[int, int, list]] = []
        suspicious = False
        for m in _RUN.finditer(text):
            s, e = m.span()
            before, after = text[s - 1] if s else "", text[e] if e < len(text) else ""
            run = m.group()
            key = (before, run, after)
            got = self.cache.get(key)
            if got is None:
                odd = self.improbable(before, run, after) or bool(_C1.search(run))
                got = self.cache[key] = odd, self._parts(before, run, after) if odd and e - s > 1 else []
            odd, parts = got
            suspicious |= odd
            runs += [(s + i, s + j, True) for i, j in parts] or [(s, e, odd)]
        gain, mapping, fixed = 0.0, None, text
        proven = self._proven([text[s:e] for s, e, _ in runs])
        if suspicious or control or proven:
            gain, mapping, fixed = self._best(text, runs, proven)
        return lost or control or mapping is not None, fixed, gain, mapping

    @staticmethod
    def _segment(scores: dict) -> tuple[float, tuple[str, str] | None, list]:
        """The mapping and the stretch of runs with the greatest sum of gains. ``scores``: for each mapping, by index of the run,
        (start, end, gain, repaired). A run met before adds nothing; one that the mapping can't explain speaks against it."""
        best, how, chosen = 0.0, None, []
        for plan, steps in scores.items():
            unicode = plan[1] == "utf-8"
            here, top, took, seen, last = 0.0, 0.0, [], set(), -1
            for i in sorted(steps):
                here += CONTRADICTION * (i - last - 1) * (0.25 if unicode else 1)
                last = i
                if here <= 0:
                    here, top, took, seen = 0.0, 0.0, [], set()
                gain, fixed = steps[i][2:]
                took.append(steps[i])
                if fixed in seen:
                    continue
                seen.add(fixed)
                here, top = here + gain, max(top, gain)
                if here > best and here >= GAIN[unicode] and top >= RUN_GAIN[unicode]:
                    best, how, chosen = here, plan, list(took)
        return best, how, chosen

    def _wide(self, before: str, run: str, after: str) -> tuple[int, dict]:
        """The options of a run in the encodings of two bytes, and how much of the run they take: all, or all but an ASCII end."""
        key = ("wide", before, run, after)
        got = self.cache.get(key)
        if got is None:
            got = len(run), {}
            for size in (len(run), len(run) - 1) if run[-1] < "\x80" else (len(run),):
                options = self._options(before, run[:size], (run + after)[size : size + 1], _WIDE_PLANS)[0] if size > 1 else {}
                if options:
                    got = size, options
                    break
            self.cache[key] = got
        return got

    def _best(self, text: str, runs: list, proven: set[str] = frozenset()) -> tuple[float, str | None, str]:
        """The mapping whose gains have the best segment over the runs of the text, and the text repaired by it. Under the encodings
        ``proven`` by structure a run gains at least what its own structure says."""
        promising: set[tuple[str, str]] = {(wrong, "utf-8") for wrong in proven}
        for s, e, odd in runs:
            if odd:
                promising.update(self._options(text[s - 1] if s else "", text[s:e], text[e] if e < len(text) else "")[1])
        scores: dict[tuple[str, str], dict] = {p: {} for p in sorted(promising, key=self.order.__getitem__)}
        if promising:
            for i, (s, e, _) in enumerate(runs):
                options = self._options(text[s - 1] if s else "", text[s:e], text[e] if e < len(text) else "")[0]
                for p, steps in scores.items():
                    if p in options:
                        gain, fixed = options[p]
                        if p[1] == "utf-8" and p[0] in proven:
                            gain = max(gain, self._structure(text[s:e]).get(p[0], ({}, 0.0))[1])
                        steps[i] = (s, e, gain, fixed)
        best, how, chosen = self._segment(scores)
        # encodings whose characters run on into ASCII; the other mappings may explain a part of such a text, but gain less
        if (how is None or how[1] != "utf-8" or how[0] not in proven) and any(odd for *_, odd in runs):
            wide: dict[tuple[str, str], dict] = {}
            for i, m in enumerate(_WIDE_RUN.finditer(text)):
                s, e = m.span()
                size, got = self._wide(text[s - 1] if s else "", m.group(), text[e] if e < len(text) else "")
                for p, (g, fixed) in got.items():
                    wide.setdefault(p, {})[i] = (s, s + size, g, fixed)
            wide = {p: v for p, v in wide.items() if max(x[2] for x in v.values()) >= RUN_GAIN[False]}
            if (found := self._segment(wide))[0] > best:
                scores, (best, how, chosen) = wide, found
        if how is None:
            return 0.0, None, text
        # runs of the stretch that gain are repaired, and runs elsewhere that gain much by the same mapping
        least = 0.0 if how[1] == "utf-8" else RUN_GAIN[False]
        gains = {(s, e): f for s, e, g, f in scores[how].values() if g > least} | {(s, e): f for s, e, g, f in chosen if g > 0}
        out, at = [], 0
        for (s, e), f in sorted(gains.items()):
            if s >= at:
                out += [text[at:s], f]
                at = e
        return best, f"{how[0]}>{how[1]}", "".join([*out, text[at:]])


_REPAIRERS: dict = {}


def _repairer(token: str, args: tuple) -> Repairer:
    """The worker's Repairer of a pair table: kept from task to task, so what it learns of runs is learnt once. One is kept."""
    if token not in _REPAIRERS:
        _REPAIRERS.clear()
        _REPAIRERS[token] = Repairer(*args)
    return _REPAIRERS[token]


def _in_pieces(table: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The counted pairs in their order, at most PIECE at a time."""
    size = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        piece = lambda at: pa.RecordBatch.from_arrays([pa.array([a[:at].tobytes()], pa.binary()) for a in (pairs, n)], names=["pairs", "n"])
        for batch in batches:
            pairs, n = (np.concatenate([a, c.to_numpy(zero_copy_only=False)]) for a, c in zip((pairs, n), batch.columns, strict=True))
            while len(pairs) >= size:
                yield piece(size)
                pairs, n = pairs[size:], n[size:]
        if len(pairs):
            yield piece(len(pairs))

    parts = max(1, -(-table.count() // size))
    rows = table.select("pair", "n").repartitionByRange(parts, "pair").sortWithinPartitions("pair").mapInArrow(run, "pairs binary, n binary")
    for r in rows.toLocalIterator():
        yield np.frombuffer(r.pairs, np.int64), np.frombuffer(r.n, np.int64)


def pair_table(docs: DataFrame, text: str = "text") -> tuple:
    """The arguments of a Repairer for all documents: the number of texts, what is known of each character, and every pair, broadcast
    in pieces. Only one piece at a time passes through the driver, which keeps one number for each side of a character."""
    before, after, pieces, texts = np.zeros(1 << 21, np.int64), np.zeros(1 << 21, np.int64), [], np.zeros(0, np.int64)
    for pairs, n in _in_pieces(cut(pair_counts(docs, text))):
        if pairs[0] < 0:  # the number of texts comes first
            texts, pairs, n = n[:1], pairs[1:], n[1:]
        if len(pairs):
            np.maximum.at(before, pairs >> 21, n)
            np.maximum.at(after, pairs & ((1 << 21) - 1), n)
            pieces.append((int(pairs[0]), docs.sparkSession.sparkContext.broadcast((pairs, n))))
    known = [{c: int(side[c]) for c in np.flatnonzero(side).tolist()} for side in (before, after)]
    return np.full(len(texts), -1, np.int64), texts, *known, pieces


def examined(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, damaged, text, gain, mapping) of every document; ``text`` repaired where possible.

    The pair table is counted over all documents, then broadcast in pieces, all of it however large. Documents move once to count pairs over
    distinct texts, and small inputs once more to use all cores. Repeated rows are judged alike; null text is not damaged and stays
    null.
    """
    *known, pieces = pair_table(docs, text)
    shared, token = docs.sparkSession.sparkContext.broadcast(tuple(known)), uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = _repairer(token, (*shared.value, pieces))
        for f in frames:
            got = [r.examine(t if isinstance(t, str) else None) for t in f["_text"]]
            out = pd.DataFrame(got, columns=["damaged", "text", "gain", "mapping"])
            out.insert(0, key, f[key].to_numpy())
            yield out

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs).select(key, F.col(text).alias("_text")).mapInPandas(run,
        f"`{key}` {kind}, damaged boolean, text string, gain double, mapping string")
