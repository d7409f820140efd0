"""Text helpers that the Python operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

_CUT = re.compile(r"[ \t\n\r]")


def chunks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The whole text in parts of about size characters, cut before an ASCII blank."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


#: Rows to an Arrow batch: documents can be long and a worker's memory is small.
ROWS = 512
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark) -> None:
    """ROWS rows to an Arrow batch from now on, or fewer if the session says so. The setting is read
    when a plan runs, so it must outlast the lazy results of the operators; nothing sets it higher."""
    if not 0 < int(spark.conf.get(_KEY)) <= ROWS:
        spark.conf.set(_KEY, str(ROWS))


@contextmanager
def large_batches(spark, rows: int):
    """For plans over short rows that run inside the block; the session's own setting comes back."""
    before = spark.conf.get(_KEY)
    spark.conf.set(_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_KEY, before)
