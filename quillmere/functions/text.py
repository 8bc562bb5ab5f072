"""Text analysis as columns: tokenizers, folding, stopwords, stems, and profiles that chain them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .porter2 import stem

STOPWORDS = tuple("there these their such with will then into this that they and the are for was not but be if of an in on no to or as is at it by a".split())


def ascii_words(text: Column) -> Column:
    """Runs of ``a-z0-9`` of the lower-case text; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def unicode_words(text: Column) -> Column:
    """Runs of letters and numbers of the lower-case text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def boundary_words(text: Column) -> Column:
    """Words of the JVM's boundary analysis that hold a letter or a number, in the text's own case."""
    return F.filter(F.flatten(F.sentences(text)), lambda w: w.rlike(r"[\p{IsAlphabetic}\p{N}]"))


def segments(run: str, weights: dict[str, float], longest: int) -> list[str]:
    """The words of least total weight that make up ``run``; a character that is no word costs more than any word."""
    dear = 10.0 + max(weights.values(), default=0.0)
    cost, back = [0.0] + [float("inf")] * len(run), [0] * (len(run) + 1)
    for i in range(len(run)):
        for j in range(i + 1, min(len(run), i + longest) + 1):
            w = weights.get(run[i:j], dear if j == i + 1 else None)
            if w is not None and cost[i] + w < cost[j]:
                cost[j], back[j] = cost[i] + w, i
    out, j = [], len(run)
    while j:
        out.append(run[back[j] : j])
        j = back[j]
    return out[::-1]


def dictionary_words(text: Column, counts: dict[str, int]) -> Column:
    """Words of a text in a script without spaces between words: runs of letters and numbers, cut by a dictionary of words and their counts.

    The cut of a run is the most likely one if words follow each other by chance. The dictionary is the caller's; each
    distinct run of a batch is cut once.
    """
    total, longest = sum(counts.values()) or 1, max(map(len, counts), default=1)
    weights = {w: float(np.log(total / n)) for w, n in counts.items() if n > 0}

    @F.pandas_udf(ArrayType(StringType()))
    def cut(runs: pd.Series) -> pd.Series:
        known = {r: segments(r, weights, longest) for r in {r for rs in runs.dropna() for r in rs}}
        return runs.map(lambda rs: [w for r in rs for w in known[r]], na_action="ignore")

    return cut(unicode_words(text))


def without_stopwords(words: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """The words that are no stopwords; the positions close up."""
    return F.filter(words, lambda w: ~w.isin(*stopwords))


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Full case folding, which may lengthen a text: the sharp s becomes ss."""
    return texts.map(str.casefold, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def stemmed_words(words: pd.Series) -> pd.Series:
    """Arrays of words by their stems; every distinct word of a batch once."""
    known = {w: stem(w) for w in {w for ws in words.dropna() for w in ws}}
    return words.map(lambda ws: [known[w] for w in ws], na_action="ignore")


@F.pandas_udf(StringType())
def _stemmed(words: pd.Series) -> pd.Series:
    known = {w: stem(w) for w in words.dropna().unique()}
    return words.map(known)


def stems(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` stemmed; every distinct word of a batch once."""
    return df.withColumn(column, _stemmed(F.col(column)))


@dataclass(frozen=True)
class Profile:
    """What analysis does. ``tokenizer``: ascii, unicode or boundary; ``case``: none, lower or full; ``stemmer``: none or english.

    No tokenizer puts two tokens at one place, so document lengths count none twice.
    """

    tokenizer: str = "ascii"
    case: str = "lower"
    stopwords: tuple[str, ...] = ()
    stemmer: str = "none"

    def __post_init__(self) -> None:
        if self.tokenizer not in ("ascii", "unicode", "boundary") or self.case not in ("none", "lower", "full") or self.stemmer not in ("none", "english"):
            raise ValueError(f"unknown analysis: {self}")

    def to_dict(self) -> dict:
        return {"token_retention": self.tokenizer, "case_folding": self.case, "stopwords": list(self.stopwords), "stemmer": self.stemmer, "counts_overlaps_in_length": False, "dictionary": None}

    @staticmethod
    def from_dict(x: dict) -> Profile:
        """The profile that a descriptor tells; what isn't offered is an error."""
        if x.get("dictionary"):
            raise ValueError("segmentation by dictionary is not offered")
        return Profile(x["token_retention"], x["case_folding"], tuple(x.get("stopwords") or ()), x.get("stemmer") or "none")


ASCII = Profile()
ENGLISH = Profile("boundary", "lower", STOPWORDS, "english")


def words(text: Column, profile: Profile = ASCII) -> Column:
    """The tokens of ``profile`` before stemming, which works on rows (see ``tokens``) or arrays (see ``analyze``)."""
    if profile.case == "full":
        text = folded(text)
    found = {"ascii": ascii_words, "unicode": unicode_words, "boundary": boundary_words}[profile.tokenizer](text)
    if profile.tokenizer == "boundary" and profile.case == "lower":
        found = F.transform(found, F.lower)
    return without_stopwords(found, profile.stopwords) if profile.stopwords else found


def tokens(docs: DataFrame, profile: Profile = ASCII, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_id``, ``pos``, ``term``: a row a token, positions counted after stopwords are gone."""
    rows = docs.select(F.col(id_col).alias("row_id"), F.posexplode(words(F.col(text_col), profile)).alias("pos", "term"))
    return stems(rows, "term") if profile.stemmer == "english" else rows


def analyze(text: Column, profile: Profile = ASCII) -> Column:
    """The array of a text's tokens after the whole chain."""
    found = words(text, profile)
    return stemmed_words(found) if profile.stemmer == "english" else found


@F.arrow_udf(ArrayType(IntegerType()))
def _ends(sizes: pa.Array) -> pa.Array:
    """Running sums of each array without the last, made over flat buffers of some hundred arrays at a time."""
    parts = [_running(sizes.slice(a, 256)) for a in range(0, len(sizes), 256)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def _running(sizes: pa.Array) -> pa.Array:
    flat = sizes.flatten().to_numpy(zero_copy_only=False)
    counts = pc.fill_null(pc.list_value_length(sizes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
    kept = np.ones(len(flat), bool)
    kept[ends[counts > 0] - 1] = False
    places = (total[1:] - np.repeat(total[ends - counts], counts))[kept].astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(counts - 1, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(places), mask=sizes.is_null())


def boundaries(text: Column, word: str = "a-z0-9") -> Column:
    """Places in characters, the ends left out, where runs of characters of the class ``word`` begin or end in the lower-case text."""
    return _ends(F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"[{word}]+|[^{word}]+"), F.lit(0)), F.length))


def agreement(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of boundaries; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
