"""Streams with state: what a document has carried over from earlier pages, progress while a query runs, and stopping it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CARRIED = "doc_id long, page int, line_ix long, line string, section string"


def carried_sections(lines: DataFrame, is_heading: Callable[[str], bool]) -> DataFrame:
    """A stream of lines (doc_id, page, line_ix, line) with the section that each stands in: the last heading of the document so far, also of earlier batches.

    The state is one text a document. Lines of a batch are put in their order; a line that comes in a later batch than its followers gets the section known by then.
    """

    def carry(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        section = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["page", "line_ix"])
        found = []
        for line in rows["line"]:
            if line is not None and is_heading(line):
                section = line
            found.append(section)
        state.update((section,))
        yield rows.assign(section=found)[["doc_id", "page", "line_ix", "line", "section"]]

    return lines.groupBy("doc_id").applyInPandasWithState(carry, CARRIED, "section string", "append", GroupStateTimeout.NoTimeout)


class Progress(StreamingQueryListener):
    """Tells a callback (batch, rows in this batch, rows so far) after each batch of any query of the session."""

    def __init__(self, tell: Callable[[int, int, int], None]):
        self.tell, self.rows = tell, 0

    def onQueryStarted(self, event) -> None:
        self.rows = 0

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.tell(event.progress.batchId, event.progress.numInputRows, self.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_until(query: StreamingQuery, cancelled: Callable[[], bool], every: float = 0.5) -> bool:
    """Waits for a query; stops it between batches once it is cancelled. Whether it came to its end by itself; what its finished batches wrote stays, and the next run goes on from there."""
    while not query.awaitTermination(every):
        if cancelled():
            query.stop()
            return False
    return True
