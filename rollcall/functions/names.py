"""Person names: keys, sounds and likeness."""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIMILAR = 0.92
UNRELATED, FUZZY, SUBSET, EXACT = 0, 1, 2, 3


def _normal(raw: str | None) -> str | None:
    if raw is None:
        return None
    alphabetic = lambda c: c.isalpha() or unicodedata.category(c) in ("Nl", "Mc")
    text = "".join(c.lower() if c.isascii() and c.isalpha() else c if alphabetic(c) else " " for c in unicodedata.normalize("NFKD", raw))
    return " ".join(text.split())


@F.pandas_udf(T.StringType())
def _normalise_any(raw: pd.Series) -> pd.Series:
    return raw.map(_normal, na_action="ignore")


def normalise(raw: Column) -> Column:
    """Decomposed, ASCII lower case, all that is no letter turned to spaces, spaces squeezed. ASCII text
    stays with native functions; a mark splits a word, as in the data model."""
    plain = F.trim(F.regexp_replace(F.lower(raw), "[^a-z]+", " "))
    return F.when(raw.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(_normalise_any(F.when(~raw.rlike(r"^[\x00-\x7F]*$"), raw)))


def words_of(normal: Column) -> Column:
    return F.array_remove(F.split(normal, " "), "")


def tokens(normal: Column) -> Column:
    """Words of more than one byte."""
    return F.filter(words_of(normal), lambda t: F.octet_length(t) > 1)


def initials(normal: Column) -> Column:
    return F.filter(words_of(normal), lambda t: F.length(t) == 1)


def name_key(normal: Column) -> Column:
    return F.array_join(F.array_sort(tokens(normal)), " ")


def initials_compatible(inits: Column, other: Column) -> Column:
    return F.forall(inits, lambda i: F.exists(other, lambda t: F.substring(t, 1, 1) == i))


def jaro_winkler(a: str, b: str) -> float:
    """Similarity from matching characters within half the longer length, swaps, and up to four equal
    first characters (weight 0.1, applied above 0.7)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(mine, (c for c, t in zip(b, taken) if t))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


class _Spot:
    """A place in a word, and questions about what stands around it."""

    def __init__(self, word: str) -> None:
        self.word, self.i, self.last = word, 0, len(word) - 1
        self.slavic = any(x in word for x in ("W", "K", "CZ"))  # or Germanic

    def has(self, offset: int, *parts: str) -> bool:
        """Whether one of the parts stands at an offset from here; the end of the word counts as a space."""
        at = self.i + offset
        return at >= 0 and any(self.word.startswith(p, at) if " " not in p else (self.word + " ").startswith(p, at) for p in parts)

    def any(self, offset: int, letters: str) -> bool:
        at = self.i + offset
        return 0 <= at <= self.last and self.word[at] in letters

    def vowel(self, offset: int) -> bool:
        return self.any(offset, "AEIOUY")

    @property
    def first(self) -> bool:
        return self.i == 0

    @property
    def ends(self) -> bool:
        return self.i == self.last

    def begins(self, *parts: str) -> bool:
        return self.word.startswith(parts)


def _doubled(code: str, more: str = ""):
    """A letter with one code, doubled or not, or followed by one of `more`."""
    return [(lambda s: s.any(1, s.word[s.i] + more), code, 2), (lambda s: True, code, 1)]


def _hard_ch(s: _Spot) -> bool:
    """CH as in Greek and German words."""
    greek = s.first and (s.has(1, "HARAC", "HARIS") or s.has(1, "HOR", "HYM", "HIA", "HEM")) and not s.begins("CHORE")
    german = s.begins("SCH") or s.has(-2, "ORCHES", "ARCHIT", "ORCHID") or s.any(2, "TS")
    before = s.first or s.any(-1, "AOUE")
    return s.i > 0 and s.has(0, "CHAE") or greek or german or before and (s.any(2, "LRNMBHFVW") or s.i + 1 == s.last) or s.i > 0 and s.begins("MC")


#: The contexts of each letter, as published for double metaphone (primary code): tried in turn, each
#: with the code that it gives and how many letters it takes. They hold for English and, by their
#: spelling, Slavic, Germanic, Greek, French, Italian and Spanish words.
SOUNDS_OF: dict[str, list[tuple]] = {
    **{v: [(lambda s: s.first, "A", 1), (lambda s: True, "", 1)] for v in "AEIOUY"},
    "B": _doubled("P"),
    "C": [
        (lambda s: s.i > 1 and not s.vowel(-2) and s.has(-1, "ACH") and not s.any(2, "I") and (not s.any(2, "E") or s.has(-2, "BACHER", "MACHER")), "K", 2),
        (lambda s: s.first and s.has(0, "CAESAR"), "S", 2),
        (lambda s: s.has(0, "CHIA"), "K", 2),
        (lambda s: s.has(0, "CH") and _hard_ch(s), "K", 2),
        (lambda s: s.has(0, "CH"), "X", 2),
        (lambda s: s.has(0, "CZ") and not s.has(-2, "WICZ"), "S", 2),
        (lambda s: s.has(1, "CIA"), "X", 3),
        (lambda s: s.has(0, "CC") and not (s.i == 1 and s.begins("M")) and s.any(2, "IEH") and not s.has(2, "HU"), lambda s: "KS" if s.i == 1 and s.any(-1, "A") or s.has(-1, "UCCEE", "UCCES") else "X", 3),
        (lambda s: s.has(0, "CC") and not (s.i == 1 and s.begins("M")) or s.any(1, "KGQ"), "K", 2),
        (lambda s: s.any(1, "IEY"), "S", 2),
        (lambda s: s.any(1, "CKQ") and not s.has(1, "CE", "CI"), "K", 2),
        (lambda s: True, "K", 1),
    ],
    "D": [(lambda s: s.any(1, "G") and s.any(2, "IEY"), "J", 3), (lambda s: s.any(1, "G"), "TK", 2), *_doubled("T", "T")],
    "F": _doubled("F"),
    "G": [
        (lambda s: s.any(1, "H") and s.i > 0 and not s.vowel(-1), "K", 2),
        (lambda s: s.any(1, "H") and s.first, lambda s: "J" if s.any(2, "I") else "K", 2),
        (lambda s: s.any(1, "H") and (s.any(-2, "BHD") or s.any(-3, "BHD") or s.any(-4, "BH")), "", 2),
        (lambda s: s.any(1, "H") and s.i > 2 and s.any(-1, "U") and s.any(-3, "CGLRT"), "F", 2),
        (lambda s: s.any(1, "H"), lambda s: "" if s.any(-1, "I") else "K", 2),
        (lambda s: s.any(1, "N") and s.i == 1 and s.vowel(-1) and not s.slavic, "KN", 2),
        (lambda s: s.any(1, "N"), lambda s: "KN" if s.has(2, "EY") or s.slavic else "N", 2),
        (lambda s: s.has(1, "LI") and not s.slavic, "KL", 2),
        (lambda s: s.first and (s.any(1, "Y") or s.has(1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")), "K", 2),
        (lambda s: (s.has(1, "ER") or s.any(1, "Y")) and not s.begins("DANGER", "RANGER", "MANGER") and not s.any(-1, "EI") and not s.has(-1, "RGY", "OGY"), "K", 2),
        (lambda s: s.any(1, "EIY") or s.has(-1, "AGGI", "OGGI"), lambda s: "K" if s.begins("SCH") or s.has(1, "ET") else "J", 2),
        *_doubled("K"),
    ],
    "H": [(lambda s: (s.first or s.vowel(-1)) and s.vowel(1), "H", 2), (lambda s: True, "", 1)],
    "J": [
        (lambda s: s.has(0, "JOSE"), lambda s: "H" if s.first and s.last == 3 else "J", 1),
        (lambda s: s.any(1, "J"), "J", 2),
        (lambda s: not s.first and not s.ends and not (s.vowel(-1) and not s.slavic and s.any(1, "AO")) and (s.any(1, "LTKSNMBZ") or s.any(-1, "SKL")), "", 1),
        (lambda s: True, "J", 1),
    ],
    "K": _doubled("K"),
    "L": _doubled("L"),
    "M": [(lambda s: s.any(1, "M") or s.has(-1, "UMB") and (s.i + 1 == s.last or s.has(2, "ER")), "M", 2), (lambda s: True, "M", 1)],
    "N": _doubled("N"),
    "P": [(lambda s: s.any(1, "H"), "F", 2), *_doubled("P", "B")],
    "Q": _doubled("K"),
    "R": [(lambda s: s.ends and not s.slavic and s.has(-2, "IE") and not s.has(-4, "ME", "MA"), "", 1), *_doubled("R")],
    "S": [
        (lambda s: s.has(-1, "ISL", "YSL"), "", 1),
        (lambda s: s.first and s.has(0, "SUGAR"), "X", 1),
        (lambda s: s.has(0, "SH"), lambda s: "S" if s.has(1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X", 2),
        (lambda s: s.has(0, "SIO", "SIA"), "S", 3),
        (lambda s: s.any(1, "Z"), "S", 2),
        (lambda s: s.first and s.any(1, "MNLW"), "S", 1),
        (lambda s: s.has(0, "SCH"), lambda s: "SK" if s.has(3, "OO", "UY", "ED", "EM") else "X", 3),
        (lambda s: s.has(0, "SC"), lambda s: "S" if s.any(2, "IEY") else "SK", 3),
        (lambda s: s.ends and s.has(-2, "AI", "OI"), "", 1),
        *_doubled("S", "Z"),
    ],
    "T": [
        (lambda s: s.has(0, "TION", "TIA", "TCH"), "X", 3),
        (lambda s: s.has(0, "TH", "TTH"), lambda s: "T" if s.has(2, "OM", "AM") or s.begins("SCH") else "0", 2),
        *_doubled("T", "D"),
    ],
    "V": _doubled("F"),
    "W": [
        (lambda s: s.has(0, "WR"), "R", 2),
        (lambda s: s.first and (s.vowel(1) or s.any(1, "H")), "A", 1),
        (lambda s: s.has(0, "WICZ", "WITZ") and not (s.ends and s.vowel(-1)), "TS", 4),
        (lambda s: True, "", 1),
    ],
    "X": [
        (lambda s: s.first, "S", 1),
        (lambda s: s.ends and (s.has(-3, "IAU", "EAU") or s.has(-2, "AU", "OU")), "", 1),
        *_doubled("KS", "C"),
    ],
    "Z": [(lambda s: s.any(1, "H"), "J", 2), *_doubled("S")],
}


@lru_cache(100_000)
def metaphone(word: str, longest: int = 6) -> str:
    """The sound of an ASCII word as consonant codes: the primary code of double metaphone."""
    s = _Spot(word.upper())
    out, s.i = "", 1 if s.begins("GN", "KN", "PN", "WR", "PS") else 0
    while s.i <= s.last and len(out) < longest:
        for holds, code, step in SOUNDS_OF.get(s.word[s.i], ()):
            if holds(s):
                out += code if isinstance(code, str) else code(s)
                s.i += step
                break
        else:
            s.i += 1  # no letter
    return out[:longest]


def _sound(key: str) -> str:
    """Codes of the tokens of a name key, sorted; a token without a code stands for itself."""
    return " ".join(sorted((metaphone(t) if t.isascii() else "") or t for t in key.split(" ") if t))


@F.pandas_udf(T.StringType())
def phonetic_key(key: pd.Series) -> pd.Series:
    return key.map(_sound, na_action="ignore")


def _paired(a: list[str], b: list[str]) -> bool:
    """Every token of a finds, first come first served, a free token of b that is similar."""
    free = list(b)
    for x in a:
        hit = next((k for k, y in enumerate(free) if jaro_winkler(x, y) >= SIMILAR), None)
        if hit is None:
            return False
        del free[hit]
    return True


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        p, q = (x or "").split(), (y or "").split()
        out.append(bool(p and q) and (_sound(x) == _sound(y) or len(p) == len(q) >= 2 and _paired(p, q)))
    return pd.Series(out, dtype="bool")


def contained(key_a: Column, key_b: Column) -> Column:
    """Whether the shorter of two name keys has two tokens or more, all of them in the longer."""
    a, b = words_of(key_a), words_of(key_b)
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    return (F.size(short) >= 2) & (F.size(F.array_except(short, long)) == 0)


def relation(key_a: Column, key_b: Column) -> Column:
    """How two name keys relate: EXACT, SUBSET (see contained), FUZZY (same sound, or as many tokens, each
    similar to one of the other) or UNRELATED. Only pairs that the first two do not decide reach Python."""
    subset = contained(key_a, key_b)
    empty = (key_a == "") | (key_b == "")
    open_ = ~empty & (key_a != key_b) & ~subset
    alike = _alike(F.when(open_, key_a), F.when(open_, key_b))
    return F.when(empty, UNRELATED).when(key_a == key_b, EXACT).when(subset, SUBSET).when(alike, FUZZY).otherwise(UNRELATED)


#: Two tokens that are SIMILAR begin with the same four letters, or have at least this many letters in
#: common, as a share of each added up: what the measure asks for where three letters or fewer agree.
LEAST_COMMON = 3 * (SIMILAR - 0.3) / 0.7 - 1
#: The longest token whose choices of letters are all written out.
SPELT = 12


def _common(a: int, b: int) -> int:
    """The least number of letters that similar tokens of these lengths share, beyond a where none can be."""
    return math.ceil(LEAST_COMMON / (1 / a + 1 / b) - 1e-9)


def token_blocks(token: str) -> list[str]:
    """Keys of which two similar tokens share at least one: the first four letters; for each length that
    the other may have, every choice of as many letters as both must share; for long tokens, letters by
    rank, of which both must share one among the first few."""
    n, out = len(token), [f"p{token[:4]}"] if len(token) >= 4 else []
    letters = sorted(token)
    for other in range(max(1, n // 2), 2 * n + 1):
        a, b = min(n, other), max(n, other)
        m = _common(a, b)
        if m > a:
            continue
        if b <= SPELT:
            out += {f"{a},{b}:{''.join(x)}" for x in combinations(letters, m)}
        else:
            nth = [f"{c}{letters[:k].count(c)}" for k, c in enumerate(letters)]
            out += [f"{a},{b}/{x}" for x in nth[: n - m + 1]]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def token_blocks_udf(tokens: pd.Series) -> pd.Series:
    return tokens.map(token_blocks, na_action="ignore")
