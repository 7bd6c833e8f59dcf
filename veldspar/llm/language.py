"""Language identification by compression: the language whose dictionary makes a text smallest.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled texts.
A text is cut into blocks, each compressed with every dictionary on its own, so that a long text can't
replace the dictionary by its own past; the sizes add up over the whole text. The score is the
softmax of the saved bits; a narrow margin between the two smallest sets `rejected`.

Bounds of the fit: for each language whole texts of at most FIT_BYTES each, the first by a hash of their id, until
they make `sample_bytes`; all languages share TOTAL_BYTES, so that many languages have smaller dictionaries.
Every language with such a text has a dictionary; one of less text than zstandard takes is filled up with spaces.

Defined cases: a null text, or one without a letter, is `und` with score 0 and rejected; no labelled
text at all makes every text `und`; ties go to the first language by name; repeated rows are judged one
by one and get equal rows; an empty table gives no rows; columns of the input that have the names of
new ones are replaced, others in `keep` stay; bytes that aren't UTF-8 are read as replacement characters.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SAMPLE_BYTES, TOTAL_BYTES = 256 << 10, 64 << 20
FIT_BYTES = 32 << 10
BLOCK = 8192
LEVEL = 6
#: Share of the smaller size by which it must win.
MARGIN = 0.02
LETTER = re.compile(r"[^\W\d_]")


def fit(docs: DataFrame, train, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, from the rows of docs (text, lang, doc_id) where `train` holds.

    One pass counts the languages' bytes; in another, a threshold on a hash of the id, which those set, leaves about twice
    the wanted bytes of each language, and running sums by that hash cut them.
    """
    size = F.octet_length("text").cast("long")
    rows = docs.where(train & F.col("lang").isNotNull() & (size <= FIT_BYTES))
    counts = rows.groupBy("lang").agg(F.sum(size).alias("bytes"))
    n = counts.count()
    each = min(sample_bytes, total_bytes // max(1, n))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    shares = counts.select("lang", F.least(F.lit(1.0), (2.0 * each + 40 * FIT_BYTES) / F.greatest("bytes", F.lit(1))).alias("share"))
    near = rows.select("doc_id", "lang", "text", h.alias("h")).join(shares, "lang").where(F.col("h") < F.col("share") * float(1 << 32))
    # what is left is bounded for each language, so a window over one doesn't grow with the input
    upto = F.sum(size).over(W.partitionBy("lang").orderBy("h", "doc_id", "text").rowsBetween(W.unboundedPreceding, -1))
    taken = near.withColumn("before", F.coalesce(upto, F.lit(0))).where(F.col("before") < each).select("lang", "text", "h", "doc_id").collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(taken, key=lambda r: (r.lang, r.h, str(r.doc_id), r.text)):
        out.setdefault(r.lang, []).append(r.text.encode())
    return {k: b"\n".join(v)[:each].ljust(8) for k, v in out.items()}


class Judge:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.names = sorted(dictionaries)
        self.by = [self._compressor(dictionaries[n], level) for n in self.names]

    @staticmethod
    def _compressor(dictionary: bytes, level: int):
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def sizes(self, text: bytes, block: int = BLOCK) -> list[int]:
        parts = [text[i : i + block] for i in range(0, len(text), block)]
        return [sum(len(f(p)) for p in parts) for f in self.by]

    def judge(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        if not text or not self.names or not LETTER.search(text):
            return "und", 0.0, True
        raw = text.lower().encode()
        got = np.array(self.sizes(raw), float)
        best = int(got.argmin())
        saved = (got[best] - got) / max(1.0, np.sqrt(got[best]))
        score = float(1 / np.exp(np.maximum(saved, -50)).sum())
        rest = np.delete(got, best)
        narrow = bool(len(rest)) and rest.min() - got[best] < max(1.0, margin * got[best])
        return self.names[best], score, narrow


@lru_cache(2)
def judge_of(items: tuple[tuple[str, bytes], ...], level: int) -> Judge:
    return Judge(dict(items), level)


def classify(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str], margin: float = MARGIN, level: int = LEVEL) -> DataFrame:
    """Columns `keep` of docs, then lang_pred, score (0 to 1) and rejected (the margin is narrow)."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(tuple(sorted((k, v.lower()) for k, v in dictionaries.items())))
    new = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    keep = [k for k in keep if k not in new]
    docs = docs.select(*keep, *([] if "text" in keep else ["text"]))

    def run(batches):
        j = judge_of(shared.value, level)
        for b in batches:
            got = [j.judge(t, margin) for t in common.strings(b)]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *cols], [*keep, *new])

    return docs.mapInArrow(run, common.schema_of(docs, keep, new))
