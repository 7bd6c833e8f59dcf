"""The full analyzer: runs of letters and digits with joiners, folding, compounds, stop words, stems, numbers, synonyms.

tokens() gives (term, position, start, stop, flags) with byte offsets. At one position the plain part
comes first, then what is stacked on it: the compound as written, then its catenation.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cache, lru_cache
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import functions as F

from .stemmer import stem

NO_FUZZY, VARIANT = 1, 2
JOINERS = "_-.'+#@&"
QUOTES = str.maketrans({"‘": "'", "’": "'", "‐": "-", "‑": "-", "–": "-", "—": "-", "“": '"', "”": '"'})
STOPWORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
ONES = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * (i + 2) for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9}
MOST_NUMBER = 999_999_999_999
#: Part of every epoch: raised when the rules of this module change.
RULES_VERSION = 2


class Token(NamedTuple):
    term: str
    position: int
    start: int
    stop: int
    flags: int = 0


@dataclass(frozen=True)
class Config:
    profile: str = "text"
    stop: bool = True
    stemming: bool = True
    drop_single_letters: bool = True
    numbers: bool = True
    vocabulary: dict[tuple[str, ...], tuple[str, ...]] = field(default_factory=dict)

    def epoch(self) -> str:
        """Identity of the configuration: terms of different epochs don't compare."""
        text = repr((RULES_VERSION, self.profile, self.stop, self.stemming, self.drop_single_letters, self.numbers, sorted(self.vocabulary.items())))
        return hashlib.sha256(text.encode()).hexdigest()[:32]


TEXT = Config()
CODE = Config("code", stop=False, stemming=False, drop_single_letters=False, numbers=False)
VOICE = Config("voice")


def fold(text: str) -> str:
    """NFKC, case-folded, without nonspacing marks, typographic quotes and hyphens as ASCII."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text.translate(QUOTES)).casefold()
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn" or c in "\u3099\u309a")
    return unicodedata.normalize("NFC", bare)


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or "가" <= c <= "힯"


@cache
def _segment() -> re.Pattern:
    """A run of CJK or another word."""
    cjk = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uac00-\ud7af"
    marks = "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Mc") and not _cjk(chr(c)))
    joiners = re.escape(JOINERS) + "".join(chr(c) for c, to in QUOTES.items() if to in JOINERS)
    plain = rf"[^\W_{cjk}]"  # alphanumeric and not CJK
    return re.compile(rf"(?=[^\W_])[{cjk}]+|(?:[A-Za-z0-9]|{plain})(?:[A-Za-z0-9]+|{plain}+|[{marks}]|[{joiners}](?={plain}))*[+#]*")


_ASCII_SEGMENT = re.compile(rf"[A-Za-z0-9]+(?:[{re.escape(JOINERS)}][A-Za-z0-9]+)*[+#]*")


def _pattern(text: str) -> re.Pattern:
    return _ASCII_SEGMENT if text.isascii() else _segment()


def segments(text: str) -> list[tuple[int, int, bool]]:
    """(start, stop, is CJK) of the words: alphanumerics, joiners between them, plus signs and hashes after them."""
    return [(*m.span(), _cjk(m[0][0])) for m in _pattern(text).finditer(text)]


def parts(word: str) -> list[tuple[int, int]]:
    """Cuts at joiners, at changes of case and between letters and digits."""
    if word.isalpha() and (word.islower() or word[1:].islower() or word.isupper()):
        return [(0, len(word))]
    out, start = [], None
    for i, c in enumerate(word):
        if not (c.isalnum() or unicodedata.category(c) in ("Mn", "Mc")):
            if start is not None:
                out.append((start, i))
            start = None
            continue
        if start is None:
            start = i
            continue
        p = word[i - 1]
        change = (p.isdigit() != c.isdigit() and c.isalnum() and p.isalnum()) or (p.islower() and c.isupper())
        change = change or (p.isupper() and c.isupper() and i + 1 < len(word) and word[i + 1].islower())
        if change:
            out.append((start, i))
            start = i
    if start is not None:
        out.append((start, len(word)))
    return out


def spoken(words: list[str]) -> int | None:
    """The value of a whole run of number words (`and` may stand inside), or None if they don't make one."""
    total, current, seen = 0, 0, False
    if not words or "and" in (words[0], words[-1]):
        return None
    for w in words:
        if w in ONES or w in TENS:
            current, seen = current + (ONES[w] if w in ONES else TENS[w]), True
        elif w == "hundred":
            current, seen = (current or 1) * 100, True
        elif w in SCALES:
            if not seen:
                return None
            total, current = total + (current or 1) * SCALES[w], 0
    return total + current if seen and total + current <= MOST_NUMBER else None


def spelled(value: int) -> str:
    """The number in words, joined: 205 is twohundredfive."""
    if value < 20:
        return next(w for w, v in ONES.items() if v == value)
    if value < 100:
        return next(w for w, v in TENS.items() if v == value // 10 * 10) + (spelled(value % 10) if value % 10 else "")
    name, scale = next((n, v) for n, v in (*reversed(SCALES.items()), ("hundred", 100)) if value >= v)
    return spelled(value // scale) + name + (spelled(value % scale) if value % scale else "")


def _number_word(w: str) -> bool:
    return w in ONES or w in TENS or w in SCALES or w in ("hundred", "and")


def _number_variants(surface: list[tuple[str, int, int, int, bool]]):
    """(term, position, start, stop): numbers in digits get their words, runs of number words at consecutive positions their digits and their joined words.

    Parts of compounds are left alone and end a run, as a stop word does.
    """
    for term, position, start, stop, part in surface:
        if not part and term.isascii() and term.isdigit() and len(term) <= 12:
            yield spelled(int(term)), position, start, stop
    i = 0
    while i < len(surface):
        end = i
        while end < len(surface) and not surface[end][4] and _number_word(surface[end][0]) and surface[end][1] == surface[i][1] + end - i:
            end += 1
        words = [x[0] for x in surface[i:end]]
        if (value := spoken(words)) is not None:
            for term in (str(value), "".join(w for w in words if w != "and")):
                yield term, surface[i][1], surface[i][2], surface[end - 1][3]
        i = max(end, i + 1)


def tokens(text: str | None, config: Config = TEXT) -> list[Token]:
    if not text:
        return []
    bytes_at = range(len(text) + 1) if text.isascii() else [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]
    found: list[tuple[int, int, Token]] = []  # (position, rank, token)
    surface: list[tuple[str, int, int, int]] = []
    sounded: list[tuple[str, int, int, int, bool]] = []  # without what is left out
    position = 0
    for start, stop, cjk in segments(text):
        word = text[start:stop]
        if cjk:
            grams = [(start, stop)] if stop - start == 1 else [(i, i + 2) for i in range(start, stop - 1)]
            for a, b in grams:
                found.append((position, 0, Token(fold(text[a:b]), position, bytes_at[a], bytes_at[b], NO_FUZZY)))
                position += 1
            continue
        whole = fold(word)
        if word[-1] in "+#" and len(parts(word)) == 1:
            found.append((position, 0, Token(whole, position, bytes_at[start], bytes_at[stop], NO_FUZZY)))
            position += 1
            continue
        cut = parts(word)
        first = position
        for a, b in cut:
            term = fold(word[a:b])
            here = (bytes_at[start + a], bytes_at[start + b])
            surface.append((term, position, *here))
            single = len(term) == 1 and term.isalpha()
            if not (config.stop and term in STOPWORDS) and not (config.drop_single_letters and single and len(cut) > 1):
                digits = any(c.isdigit() for c in term)
                out = stem(term) if config.stemming and not digits and term.isascii() else term
                found.append((position, 0, Token(out, position, *here, NO_FUZZY if digits else 0)))
                sounded.append((term, position, *here, len(cut) > 1))
            position += 1
        if len(cut) > 1:
            span = (bytes_at[start], bytes_at[stop])
            found.append((first, 1, Token(whole, first, *span, NO_FUZZY)))
            joined = "".join(fold(word[a:b]) for a, b in cut)
            if joined != whole:
                found.append((first, 2, Token(joined, first, *span, NO_FUZZY | VARIANT)))
    words = [s[0] for s in surface]
    if config.numbers:
        found += [(at, 3, Token(term, at, start, stop, NO_FUZZY | VARIANT)) for term, at, start, stop in _number_variants(sounded)]
    if config.vocabulary:
        longest = max(map(len, config.vocabulary))
        i = 0
        while i < len(words):
            for n in range(min(longest, len(words) - i), 0, -1):
                extra = config.vocabulary.get(tuple(words[i : i + n]))
                if extra:
                    found += [(surface[i][1], 5, Token(x, surface[i][1], surface[i][2], surface[i + n - 1][3], NO_FUZZY | VARIANT)) for x in extra]
                    i += n - 1
                    break
            i += 1
    found.sort(key=lambda x: (x[0], x[1]))
    once: dict[tuple[str, int], Token] = {}
    for _, _, t in found:
        once.setdefault((t.term, t.position), t)  # a position never has one term twice
    return list(once.values())


SCHEMA = "array<struct<term:string,position:int,start:int,stop:int,flags:int>>"


def tokens_udf(config: Config = TEXT):
    """Column function: the tokens of a text, in Arrow batches."""

    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [tuple(x) for x in tokens(t, config)])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, SCHEMA)


def counter(config: Config = TEXT) -> Callable[[str | None], Counter]:
    """A function of a text: how often each of its terms occurs in tokens().

    What a word gives doesn't depend on its neighbours, but for numbers: words are counted, and their tokens made once.
    """
    if config.vocabulary:
        return lambda text: Counter(t.term for t in tokens(text, config))
    alone = replace(config, numbers=False)

    @lru_cache(1 << 17)
    def word(w: str) -> tuple[tuple[str, ...], int, tuple[str, str] | None]:
        """Its terms, how many positions it takes, and as it may sound as a number: the surface and its term."""
        if w.isascii() and w.isalnum() and (w.isdigit() or len(parts(w)) == 1):  # most words
            surface = w.lower()
            term = surface if w.isdigit() or not config.stemming else stem(surface)
            terms = () if config.stop and surface in STOPWORDS else (term,)
            return terms, 1, (surface, term) if terms and config.numbers and (w.isdigit() or _number_word(surface)) else None
        found = tokens(w, alone)
        if _cjk(w[0]):
            return tuple(t.term for t in found), max(1, len(w) - 1), None
        cut = parts(w)
        surface = fold(w) if len(cut) == 1 and w[-1] not in "+#" and found else ""
        number = surface and config.numbers and (_number_word(surface) or surface.isascii() and surface.isdigit())
        return tuple(t.term for t in found), len(cut), (surface, found[0].term) if number else None

    def count(text: str | None) -> Counter:
        words = _pattern(text).findall(text) if text else []
        out, numbers = Counter(), False
        for w, n in Counter(words).items():
            terms, _, number = word(w)
            numbers = numbers or number is not None
            for t in terms:
                out[t] += n
        if numbers:
            at, sounded, there = 0, [], set()
            for w in words:
                _, width, number = word(w)
                if number is not None:  # other words end a run as the gap of their position does
                    sounded.append((number[0], at, 0, 0, False))
                    there.add((number[1], at))
                at += width
            out.update(t for t, _ in {(t, p) for t, p, _, _ in _number_variants(sounded)} - there)
        return out

    return count


def term_counts(config: Config = TEXT):
    """For mapInArrow over (doc_id, text) of documents that stand in one row each: (term, n, df) of every batch."""

    def run(batches):
        import pyarrow as pa

        count = counter(config)
        for batch in batches:
            n, df = Counter(), Counter()
            for known, text in zip(batch.column(0).is_valid().to_pylist(), batch.column(1).to_pylist(), strict=True):
                here = count(text)
                n.update(here)
                if known:
                    df.update(here.keys())
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64()), pa.array([df[t] for t in n], pa.int64())], ["term", "n", "df"])

    return run


def terms_udf(config: Config = TEXT):
    """Column function for lexical.build: the terms alone."""
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [x.term for x in tokens(t, config)])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")
