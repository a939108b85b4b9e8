"""Readers for pixels: OCR, handwriting and formula pictures are functions that a cluster brings along.

A provider takes the bytes of a page or region and returns rows of words; this module runs it where the data are, page by page, and turns
whatever goes wrong into error rows. Without a provider every page is an error row, never an invented text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = "document_id string, page int, n int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, error_code string"
Provider = Callable[[bytes], list[dict]]

# Recognition with this confidence or more is print.
CLEAR = 0.8


def words(images: DataFrame, provider: Provider | None, failure: str = "OCR_FAILURE") -> DataFrame:
    """Words (text, box, confidence) of page images (document_id, page, content), in the provider's order.

    ``provider`` is sent to the executors; an exception, or no provider, gives one row with the error code. Null contents fail as well.
    """
    names = [c.split()[0] for c in WORDS.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r in batch.itertuples():
                try:
                    if provider is None or r.content is None:
                        raise LookupError("nothing to read with")
                    read = [{"n": n, **w} for n, w in enumerate(provider(r.content))]
                except Exception:  # one page's failure stays its own
                    read = [{"error_code": failure}]
                found += [{"document_id": r.document_id, "page": r.page, **w} for w in read]
            out = pd.DataFrame(found, columns=names)
            yield out.astype(dict.fromkeys(names, object) | {"page": "Int32", "n": "Int32"} | dict.fromkeys(("x0", "y0", "x1", "y1", "confidence"), "float64"))

    return images.select("document_id", "page", "content").mapInPandas(each, WORDS)


def split_at_gaps(words: DataFrame, line: list[str], times: float = 4.0) -> DataFrame:
    """Words of a line with ``part``: a gap of more than four times the word's height starts a new one."""
    from pyspark.sql import Window

    by = Window.partitionBy(*line).orderBy("x0", "n")
    wide = F.col("x0") - F.lag("x1").over(by) > times * (F.col("y1") - F.col("y0"))
    return words.withColumn("_new", F.coalesce(wide, F.lit(False)).cast("int")).withColumn("part", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_new")


def handwriting_score(components: Column, jitter: Column, stroke: Column, ocr_confidence: Column) -> Column:
    """Half irregular shape (jitter of the base line, variation of the stroke), half weak recognition; 0 for under three components.

    A null confidence means that nothing was recognised, the weakest case. What was read with CLEAR or more is never handwriting.
    """
    shape = 0.55 * F.least(F.lit(1.0), jitter / 0.30) + 0.45 * F.least(F.lit(1.0), stroke / 0.55)
    weak = F.when(ocr_confidence.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.85 - ocr_confidence) / 0.35)))
    return F.when((components < 3) | F.coalesce(ocr_confidence >= CLEAR, F.lit(False)), 0.0).otherwise(F.round(0.5 * shape + 0.5 * weak, 3))
