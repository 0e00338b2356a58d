"""Fill-in-middle examples: whole texts cut at two line ends and put in another order.

An Arrow-batched pandas UDF takes ids and texts. The regex library's ``finditer`` runs over a text once
and leaves the end offset of every unit in a compact array; two look-ups there give both cuts, whatever
the length of the text, and slices of it are the prefix, the middle and the suffix. Seeds are digests of
the id, so a document is cut alike wherever and whenever it is read, without a shuffle or a state.

``restored`` is the way back: the sentinels mark the parts, and texts that contain one are left plain.

Defined cases: a null or empty text has no units and is plain, as is one that contains a sentinel; a null
id seeds like an empty one; repeated rows are rows of their own, with equal cuts if they have equal ids; an
empty table gives no rows; other columns are ignored. A text is held whole, with 8 bytes a unit.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempera.llm.common import bounded_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[^\n]*\n|[^\n]+"  # a line with its end
SEED = 7
RATE, SPM = 100, 50  # per cent of the texts that are transformed; of these, that start with the suffix

_FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def ends_of(text: str, unit: regex.Pattern) -> array:
    """End offsets of the units of a text."""
    return array("Q", (m.end() for m in unit.finditer(text)))


def transformed(text: str, doc_id: int | None, ends: array, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[str, str, int | None, int | None]:
    """``form, output`` and the code points of prefix and middle (None if plain)."""
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return "plain", text, None, None
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if h3 % 100 >= rate:
        return "plain", text, None, None
    cuts = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    first, second = (ends[c - 1] if c else 0 for c in cuts)
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm:
        return "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", first, second - first
    return "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", first, second - first


def restored(output: str, form: str) -> str:
    """The text behind an output."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = head.removeprefix(PREFIX).split(SUFFIX)
    else:
        suffix, prefix = head.removeprefix(SUFFIX).split(PREFIX)
    return prefix + middle + suffix


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = UNIT, outputs: bool = True) -> DataFrame:
    """``doc_id, n`` (units), ``form`` (plain, psm, spm), ``prefix_chars, middle_chars`` (null if plain), ``output``,
    and the digests of the output and of the text restored from it, for every row. Without ``outputs`` the
    transformed texts don't leave the tasks and the column is null."""

    @F.pandas_udf(_FIELDS)
    def transform(doc_id: pd.Series, text: pd.Series) -> pd.DataFrame:
        pattern, rows = regex.compile(unit), []
        for i, t in zip(doc_id, text, strict=True):
            t = t or ""
            ends = ends_of(t, pattern)
            form, output, first, middle = transformed(t, int(i) if i else None, ends, seed, rate, spm)
            rows.append((len(ends), form, first, middle, output if outputs else None, _sha(output), _sha(restored(output, form))))
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in _FIELDS.split(", ")])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.select("doc_id", transform(F.col("doc_id").cast("string"), "text").alias("_x")).select("doc_id", "_x.*")
