"""Primary phonetic codes of at most four symbols: the Double Metaphone rules for English and common surnames.

Each letter has a list of rules (what stands from there, what it sounds like, letters read); the first that fits is taken.
Letters other than A-Z are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

LONGEST = 4

# fixed values: the sounds of letters and groups, in order of precedence; `<` stands for the letters before, `^` for the start of the word
RULES = {
    "A": [("^A", "A"), ("A", "")],
    "B": [("BB", "P"), ("B", "P")],
    "C": [("CIA", "X"), ("CHR", "K", 2), ("^CHA", "K", 2), ("CH", "X"), ("CK", "K"), ("C[IEY]", "S"), ("CC", "K"), ("C", "K")],
    "D": [("DG[IEY]", "J"), ("DG", "T"), ("D[DT]", "T"), ("D", "T")],
    "F": [("FF", "F"), ("F", "F")],
    "G": [("(?<=[AEIOUY])GH", ""), ("GH", "K"), ("GN", ""), ("G[IEY]", "J"), ("GG", "K"), ("G", "K")],
    "H": [("^H(?=[AEIOUY])|(?<=[AEIOUY])H(?=[AEIOUY])", "H"), ("H", "")],
    "J": [("JJ", "J"), ("J", "J")],
    "K": [("KK", "K"), ("K", "K")],
    "L": [("LL", "L"), ("L", "L")],
    "M": [("MM", "M"), ("M", "M")],
    "N": [("NN", "N"), ("N", "N")],
    "P": [("PH", "F"), ("P[PB]", "P"), ("P", "P")],
    "Q": [("QQ", "K"), ("Q", "K")],
    "R": [("RR", "R"), ("R", "R")],
    "S": [("SCH", "X"), ("SH", "X"), ("SIO|SIA", "X"), ("SS", "S"), ("S", "S")],
    "T": [("TIO|TIA", "X"), ("TH(?=OM|AM)", "T"), ("TH", "0"), ("T[TD]", "T"), ("T", "T")],
    "V": [("VV", "F"), ("V", "F")],
    "W": [("W(?=[AEIOUY])", "W"), ("W", "")],
    "X": [("^X", "S"), ("XX", "KS"), ("X", "KS")],
    "Z": [("ZZ", "S"), ("Z", "S")],
}
RULES |= {v: [(f"^{v}", "A"), (v, "")] for v in "EIOUY"}
_READ = {c: [(re.compile(r[0]), r[1], r[2] if len(r) > 2 else None) for r in rules] for c, rules in RULES.items()}
#: The first letter of these beginnings isn't sounded.
SILENT = ("GN", "KN", "PN", "WR", "PS", "AE")


def code(term: str | None) -> str:
    """Empty for a term without letters, which then sounds like nothing."""
    word = re.sub("[^A-Z]", "", (term or "").translate(_UPPER))
    out, at = "", 1 if word.startswith(SILENT) else 0
    while at < len(word) and len(out) < LONGEST:
        for rule, sound, length in _READ[word[at]]:
            if found := rule.match(word, at):
                out, at = out + sound, at + (length or len(found[0]))
                break
    return out[:LONGEST]


_UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def code_udf():
    import pandas as pd

    def run(terms: pd.Series) -> pd.Series:
        return terms.map(code)

    run.__annotations__ = {"terms": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")
