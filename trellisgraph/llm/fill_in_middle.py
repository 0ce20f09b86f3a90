"""Fill-in-the-middle rearrangement of texts, cut between units of code points.

A text becomes a UTF-32 array; every code point has a class, units end where neighbouring classes differ, and the draws
of a row choose two of the edges. Output is ``<P>``prefix``<S>``suffix``<M>``middle (psm), ``<S>``suffix``<P>``prefix``<M>``middle
(spm) or the text itself (plain).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisgraph.llm.common import lean, text_or_empty

SENTINELS = ("<P>", "<S>", "<M>")


def points(cp: np.ndarray) -> np.ndarray:
    """Each code point is a class of its own, so each is a unit."""
    return np.arange(len(cp))


def runs(cp: np.ndarray) -> np.ndarray:
    """Blanks, letters with digits, and all else: a unit is a run of one of these."""
    kind = np.full(len(cp), 2, np.int8)
    kind[(cp >= 48) & (cp <= 57) | ((cp | 32) >= 97) & ((cp | 32) <= 122) | (cp >= 0xC0)] = 1
    kind[(cp == 32) | (cp >= 9) & (cp <= 13) | (cp == 0x85) | (cp == 0xA0) | (cp >= 0x2000) & (cp <= 0x200A) | (cp == 0x2028) | (cp == 0x2029) | (cp == 0x3000)] = 0
    return kind


UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"points": points, "runs": runs}


def edges(cp: np.ndarray, classes: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """0, the places where neighbouring classes differ, and the length; of an empty text 0 alone."""
    if not len(cp):
        return np.zeros(1, np.int64)
    kind = classes(cp)
    return np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(cp)]])


def rearranged(text: str, h1: int, h2: int, h3: int, h4: int, classes: Callable[[np.ndarray], np.ndarray], apply_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    cut = edges(cp, classes)
    n = len(cut) - 1
    if not n or h3 % 100 >= apply_percent or any(s in text for s in SENTINELS):
        return n, "plain", None, None, text
    a, b = (int(cut[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (x.tobytes().decode("utf-32-le", "surrogatepass") for x in (cp[:a], cp[a:b], cp[b:]))
    form = "spm" if h4 % 100 < spm_percent else "psm"
    first = f"<P>{prefix}<S>{suffix}" if form == "psm" else f"<S>{suffix}<P>{prefix}"
    return n, form, a, b - a, f"{first}<M>{middle}"


def _udf(units: str, apply_percent: int, spm_percent: int):
    classes = UNITS[units]
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, draws in batches:
            draw = np.array(draws.flatten()).reshape(-1, 4).tolist()
            rows = [rearranged(t.as_py(), *h, classes, apply_percent, spm_percent) for t, h in zip(texts, draw)]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names)

    return F.arrow_udf(run, "n long, form string, prefix_chars long, middle_chars long, output string")


def draws(key: Column, seed: int = 1) -> Column:
    """Four unsigned 32-bit numbers: the first four 8-digit groups of the hex SHA-256 of ``seed:key``; a null key is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def transformed(docs: DataFrame, row: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, units: str = "points", apply_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """_row (the value of ``row``, as a struct), n, form, prefix_chars, middle_chars and output of every row of ``docs``.

    n counts units (``points`` or ``runs``); the prefix ends after the smaller of two drawn numbers of units, the middle
    after the larger. A text that is empty or null, holds a sentinel or is not drawn (100 - ``apply_percent`` of all) stays
    as it is, with null lengths. Draws follow from the id alone: rows of one id, and rows without one, draw alike. No row is
    dropped, none is shuffled, and a task holds one Arrow batch of texts; an empty table gives no rows.
    """
    lean(docs.sparkSession, 500)
    made = _udf(units, apply_percent, spm_percent)(text_or_empty(text_col), draws(F.col(id_col), seed))
    return docs.select(row.alias("_row"), made.alias("_made")).select("_row", "_made.*")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. A sentinel has no border, so its first place is where it was put."""
    p, s, m = (F.locate(x, output) for x in SENTINELS)
    psm = F.concat(output.substr(F.lit(4), s - 4), output.substr(m + 3, F.length(output)), output.substr(s + 3, m - s - 3))
    spm = F.concat(output.substr(p + 3, m - p - 3), output.substr(m + 3, F.length(output)), output.substr(F.lit(4), p - 4))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every document."""
    rows = transformed(docs, F.struct("doc_id"))
    return rows.select("_row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: DuckDB SQL for ``digest``.
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM g
),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN a END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN b - a END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
