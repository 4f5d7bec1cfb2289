"""Language identification by rank-order profiles (out-of-place distance).

Learning counts the letter n-grams of every labelled training text, sums
them over the cluster and keeps the ``PROFILE`` most frequent of each
language, ties to the smaller n-gram.  A document is compared through its own
ranked n-grams: each adds the distance between its two ranks, or ``PROFILE``
where the language does not list it.  Profiles are the only thing that reaches
the driver: at most ``PROFILE`` rows a language.

Texts are lower-cased; words are runs of letters with one boundary mark at
both ends; n-grams have one to three characters.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stipendia.llm.common import plain
from stipendia.operators.frames import top_per_key

PROFILE = 300
UNKNOWN = "und"
_CHARACTERS = 0x110000
_PART = 1_000_000  # characters counted together while learning


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(_CHARACTERS)], np.int32)


def _grams(text: str) -> tuple[np.ndarray, int]:
    """All n-grams of a text as integers of up to three code points, and the bits of each.

    Letters stay, anything between words is one 0; an n-gram of three has a letter in the middle.
    """
    points = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")]
    points = points[(points != 0) | (np.concatenate([[1], points[:-1]]) != 0)]
    if len(points) < 3:
        return np.zeros(0, np.int32), 10
    bits = 10 if points.max() < 1024 else 21
    kind = np.int32 if bits == 10 else np.int64
    x = points.astype(kind)
    two = (x[:-1] << 2 * bits) | (x[1:] << bits)
    middle = np.flatnonzero(x[1:-1])
    return np.concatenate([x[x != 0] << 2 * bits, two, two[middle] | x[middle + 2]]), bits


def _wide(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes with 21 bits a character, in the same order."""
    codes = codes.astype(np.int64)
    if bits == 21:
        return codes
    return ((codes >> 20) << 42) | (((codes >> 10) & 1023) << 21) | (codes & 1023)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes in rising order, counts) of the n-grams of a whole text."""
    codes, bits = _grams(text) if text else (np.zeros(0, np.int32), 10)
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return _wide(codes[first], bits), np.diff(np.append(first, len(codes)))


def gram_text(code: int) -> str:
    return "".join(chr(c) for c in ((code >> 42), (code >> 21) & 0x1FFFFF, code & 0x1FFFFF) if c)


def ranked(codes: np.ndarray, n: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent of n-grams in rising order, ties to the smaller one."""
    return codes[np.argsort(-n, kind="stable")[:size]]


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """Profiles (lang, gram long, rank from 0) of all rows whose language and text are not null."""
    source = plain(labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), lang_col, text_col)

    def count(frames):
        for frame in frames:
            for lang, texts in frame.groupby(lang_col, sort=False)[text_col]:
                part, size_now = [], 0
                for text in [*texts, None]:
                    if text is not None:
                        part.append(text)
                        size_now += len(text)
                    if part and (text is None or size_now > _PART):
                        codes, n = counts(" ".join(part))
                        part, size_now = [], 0
                        yield pd.DataFrame({"lang": lang, "gram": codes, "n": n})

    counted = source.mapInPandas(count, "lang string, gram bigint, n bigint")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = top_per_key(summed, ["lang"], [F.desc("n"), F.asc("gram")], size)
    return best.select("lang", "gram", (F.col("rank") - 1).cast("int").alias("rank"))


def predict(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            size: int = PROFILE) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (one minus the mean out-of-place distance, 0 to 1) to the id column.

    Null texts, texts without a letter and an empty set of profiles give
    ``und`` and score 0; equal distances go to the smaller language name.
    """
    known = {}
    for lang, gram, rank in profiles.orderBy("lang", "gram").collect():
        known.setdefault(lang, ([], []))
        known[lang][0].append(gram)
        known[lang][1].append(rank)
    tables = [(lang, np.array(g, np.int64), np.array(r, np.int64)) for lang, (g, r) in sorted(known.items())]
    source = plain(docs, id_col, text_col)

    def run(frames):
        def best(text):
            mine = ranked(*counts(text), size)
            if not len(mine) or not tables:
                return UNKNOWN, 0.0
            order = np.arange(len(mine))
            distances = []
            for lang, codes, ranks in tables:
                at = np.searchsorted(codes, mine)
                at[at == len(codes)] = 0
                apart = np.where(codes[at] == mine, np.abs(ranks[at] - order), size)
                distances.append((int(apart.sum()), lang))
            distance, lang = min(distances)
            return lang, 1.0 - distance / (size * len(mine))

        for frame in frames:
            found = [best(t) for t in frame[text_col]]
            yield pd.DataFrame({id_col: frame[id_col], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    return source.mapInPandas(run, f"`{id_col}` {dict(source.dtypes)[id_col]}, lang_pred string, score double")


def held_out(doc_id) -> Column:
    """True where the CRC of the id, as text, leaves no remainder by five; null ids are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
