"""Results record by record: a cursor to pull from, a callback to push to. Rows reach the driver a
partition at a time, never all at once."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row


class Cursor:
    """Pulls rows. ``max_results`` and ``timeout`` (seconds) bound what is read; ``stopped`` says
    what ended it: "end", "max_results", "timeout", "cancelled", or None while it is open.
    ``matched`` is true as soon as a row was seen, also if the reading was cut short. Closing, or
    leaving the ``with`` block, cancels the jobs of this cursor only."""

    def __init__(self, rows: DataFrame, max_results: int | None = None, timeout: float | None = None, prefetch: bool = False) -> None:
        self._context, self._tag = rows.sparkSession.sparkContext, f"cursor-{uuid.uuid4()}"
        self._rows = rows if max_results is None else rows.limit(max_results + 1)  # one more tells a cut from an end
        self._left, self._prefetch = max_results, prefetch
        self._source: Iterator[Row] | None = None
        self._timer = None
        self.matched, self.stopped = False, None
        if timeout is not None:
            self._timer = threading.Timer(timeout, self._stop, ("timeout",))
            self._timer.daemon = True
            self._timer.start()

    def _stop(self, why: str) -> None:
        if self.stopped is None:
            self.stopped = why
            self._context.cancelJobsWithTag(self._tag)
        if self._timer is not None:
            self._timer.cancel()

    def __iter__(self) -> Cursor:
        return self

    def __next__(self) -> Row:
        if self.stopped is not None:
            raise StopIteration
        self._context.addJobTag(self._tag)
        try:
            if self._source is None:
                self._source = self._rows.toLocalIterator(self._prefetch)
            row = next(self._source)
        except StopIteration:
            self._stop("end")
            raise
        except Exception:
            if self.stopped is not None:  # its jobs were cancelled
                raise StopIteration from None
            raise
        finally:
            self._context.removeJobTag(self._tag)
        self.matched = True
        if self._left == 0:
            self._stop("max_results")
            raise StopIteration
        if self._left is not None:
            self._left -= 1
        return row

    def batch(self, n: int) -> list[Row]:
        """The next ``n`` rows, fewer at the end."""
        return [row for _, row in zip(range(n), self)]

    def cancel(self) -> None:
        self._stop("cancelled")

    close = cancel

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def push(rows: DataFrame, each: Callable[[Row], object], **bounds) -> str:
    """Calls ``each`` with every row until it returns something true; why it ended."""
    with Cursor(rows, **bounds) as cursor:
        for row in cursor:
            if each(row):
                cursor.cancel()
    return cursor.stopped
