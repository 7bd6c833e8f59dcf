"""Snippets: the window of a text with the most distinct matched terms, then the most matches, then the earliest."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import functions as F

from .analyzer import TEXT, Config, tokens


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def snippet(text: str | None, terms: Collection[str], width: int = 160, config: Config = TEXT) -> tuple[str, list[tuple[int, int]]]:
    """(window, highlights inside it), both by bytes of the UTF-8 text; windows begin at a match and end at a character."""
    raw = (text or "").encode()
    hits = sorted({(t.start, t.stop, t.term) for t in tokens(text, config) if t.term in terms})
    best, at = None, 0
    for i, (a, _, _) in enumerate(hits):
        inside = [h for h in hits[i:] if h[1] <= a + width]
        rank = (-len({h[2] for h in inside}), -len(inside), a)
        if best is None or rank < best:
            best, at = rank, a
    end = min(len(raw), at + width)
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end += 1
    marks = merged([(a - at, b - at) for a, b, _ in hits if a >= at and b <= end])
    return raw[at:end].decode(), marks


def snippet_udf(terms: Collection[str], width: int = 160, config: Config = TEXT):
    import pandas as pd

    wanted = frozenset(terms)

    def run(texts: pd.Series) -> pd.DataFrame:
        got = [snippet(t, wanted, width, config) for t in texts]
        return pd.DataFrame({"window": [g[0] for g in got], "marks": [[{"start": a, "stop": b} for a, b in g[1]] for g in got]})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "window string, marks array<struct<start:int,stop:int>>")
