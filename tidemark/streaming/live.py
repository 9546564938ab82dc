"""The stateless operators over streams.

Filter specs and generated list scans are plain Columns, so they run on a
streaming frame as they are; the overlay of a stream is a table that is joined
to each batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.predicates import FilterSpec
from ..model import Timeline, timeline
from ..operators.indicators import Indicator, scan


def filtered(stream: DataFrame, columns: list[str], spec: FilterSpec) -> DataFrame:
    """Rows of a stream that a filter spec keeps."""
    return spec.apply(timeline(stream, columns)).df


def hits(stream: DataFrame, columns: list[str], indicators: list[Indicator]) -> DataFrame:
    """row_id, list, line and label of the first hit of each list, as rows arrive."""
    t: Timeline = timeline(stream, columns)
    return scan(t, indicators)
