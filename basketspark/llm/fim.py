"""Fill-in-middle transformation: texts cut into prefix, middle and suffix, and put into another order.

A text is an array of code points (UTF-32). Neighbouring classes (blank or not) are compared,
and where a word ends there a token ends; ranks of tokens chosen from a keyed hash of the id
index that array, and the slices between them are encoded again. Tokens are words with the
blanks before them, and the blanks at a text's end.

What becomes of a text depends on its id, the seed and itself only, so that repeated rows are
transformed alike and an attempt that is run again gives the same.

Defined results: null text counts as empty; a null id is hashed as an empty one; empty texts
and texts that hold a mark stay plain; texts may be of any length, each is handled on its
own; repeated rows are all kept; an empty table gives an empty one; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def token_ends(points: np.ndarray) -> np.ndarray:
    """0 and the place after each token of an array of code points."""
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    inner = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return np.concatenate(([0], inner, [len(points)])) if len(points) else np.zeros(1, np.int64)


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks between which no other can arise: none begins another, and their first characters stand nowhere else in them."""
    heads = {m[:1] for m in marks}
    if not all(marks) or any(c in heads for m in marks for c in m[1:]) or any(b.startswith(a) for a, b in itertools.permutations(marks, 2)):
        raise ValueError(f"marks can't be told apart: {marks}")
    return marks


def fill_in_middle(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    seed: str = "42",
    percent: int = 50,
    suffix_first: int = 80,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (null for plain texts), output.

    Of the texts, ``percent`` in a hundred are transformed, of these ``suffix_first`` in a
    hundred with the suffix first (``spm``), the others with the prefix first (``psm``).
    """
    p, s, m = _checked(marks)

    def row(doc_id: int | None, text: str) -> tuple:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = token_ends(points)
        n = len(ends) - 1
        digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))
        if not text or p in text or s in text or m in text or h3 % 100 >= percent:
            return n, "plain", None, None, text
        lo, hi = (int(ends[x]) for x in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = (x.tobytes().decode("utf-32-le", "surrogatepass") for x in (points[:lo], points[lo:hi], points[hi:]))
        if h4 % 100 < suffix_first:
            return n, "spm", lo, hi - lo, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return n, "psm", lo, hi - lo, f"{p}{prefix}{s}{suffix}{m}{middle}"

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for t in tables:
            ids = t.column(0)
            made = [row(i, x) for i, x in zip(ids.to_pylist(), t.column(1).to_pylist(), strict=True)]
            columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True) if made else [[]] * 5, types, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(batches, SCHEMA)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from which ``output`` was made."""

    def after(mark: str) -> Column:
        out = F.substring_index(output, mark, -1)
        for x in marks:
            out = F.substring_index(out, x, 1)
        return out

    p, s, m = marks
    return F.when(form == "plain", output).otherwise(F.concat(after(p), after(m), after(s)))


#: Hashes of what comes out, and of what is made of that again.
FIM_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
        sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), r AS (
    SELECT *, len(tokens) AS n, ('0x' || h[1:8])::BIGINT % (len(tokens) + 1) AS r1, ('0x' || h[9:16])::BIGINT % (len(tokens) + 1) AS r2,
        text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 AS plain,
        ('0x' || h[25:32])::BIGINT % 100 < 80 AS spm
    FROM d
), c AS (
    SELECT *, array_to_string(tokens[1:least(r1, r2)], '') AS p, array_to_string(tokens[least(r1, r2) + 1:greatest(r1, r2)], '') AS m,
        array_to_string(tokens[greatest(r1, r2) + 1:], '') AS s
    FROM r
)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
    CASE WHEN NOT plain THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN NOT plain THEN length(m) END::BIGINT AS middle_chars,
    sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM c
"""
