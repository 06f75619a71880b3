"""Arrow batches of a sorted partition, cut at group borders."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups of a sorted non-null integer ``key``, with the groups' borders.

    Held at once: one batch and the group that its border cuts.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        borders = _borders(table, key)
        if len(borders) > 2:
            yield table.slice(0, borders[-2]).combine_chunks(), borders[:-1]
        rest = table.slice(borders[-2])
    if rest is not None:
        yield rest.combine_chunks(), _borders(rest, key)


def _borders(table: pa.Table, key: str) -> np.ndarray:
    values = table[key].to_numpy()
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
