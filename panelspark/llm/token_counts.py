"""Exact token counts at every prefix of a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache, partial
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, strings
from .pieces import REMEMBERED, Memory, PieceTable, table_for

LIMIT = 4096
# Chunks of a text held as separate strings at once.
BLOCK = 1 << 16


class PrefixCounts:
    """Token counts of all prefixes of one text, by code points.

    The counts are made once, chunk by chunk (chunks are independent), into one array of four
    bytes per code point. Questions are answered from the array; nothing is encoded again.
    """

    def __init__(self, table: PieceTable, text: str, of_chunk: Callable[[str], np.ndarray] | None = None):
        of_chunk = of_chunk or partial(_chunk_counts, table)
        self.counts = np.zeros(len(text) + 1, np.int32)
        chunks = (m.group() for m in table.chunks.finditer(table.spaced(text)))
        # the marker in front of the text is no code point of it
        end, before = -1, 0
        while block := list(islice(chunks, BLOCK)):
            found = np.concatenate([of_chunk(chunk) for chunk in block])
            sizes = np.fromiter(map(len, block), np.int64, len(block))
            last = found[np.cumsum(sizes) - 1]
            found += np.repeat(before + np.cumsum(last) - last, sizes).astype(np.int32)
            self.counts[max(end, 0) + 1 : end + len(found) + 1] = found[1:] if end < 0 else found
            end, before = end + len(found), int(found[-1])

    @property
    def total(self) -> int:
        return int(self.counts[-1])

    @cached_property
    def least(self) -> np.ndarray:
        """The least count of a prefix and all longer ones; never falls, unlike the counts."""
        return np.minimum.accumulate(self.counts[::-1])[::-1]

    def at(self, n_chars: int) -> int:
        """Tokens of the first ``n_chars`` code points."""
        return int(self.counts[min(max(n_chars, 0), len(self.counts) - 1)])

    def longest(self, budget: int) -> int:
        """Code points of the longest prefix that has at most ``budget`` tokens."""
        if self.total <= budget:
            return len(self.counts) - 1
        return max(int(np.searchsorted(self.least, budget, "right")) - 1, 0)


def _chunk_counts(table: PieceTable, chunk: str) -> np.ndarray:
    """Counts of the non-empty prefixes of a chunk."""
    return np.array(table.chunk_counts(chunk)[1:], np.int32)


@lru_cache(maxsize=4)
def _remembered(model: bytes) -> Memory:
    return Memory(partial(_chunk_counts, table_for(model)), REMEMBERED)


def count_tokens(
    docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """Tokens per text: ``id, n_bytes, n_tokens, over_limit, fit_chars``.

    ``model`` is the path of a vocabulary file on the driver; ``fit_chars`` the number of code
    points of the longest prefix with at most ``limit`` tokens. A null text counts as empty
    (0 tokens); repeated rows and ids come back as often as they went in; an empty table gives
    an empty table; other columns are ignored. Nothing is shuffled.
    """
    ship(docs.sparkSession)
    proto = Path(model).read_bytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, of_chunk = table_for(proto), _remembered(proto).__getitem__
        for batch in batches:
            n_bytes, n_tokens, over, fit = [], [], [], []
            for value in strings(batch.column(1)):
                counts = PrefixCounts(table, value, of_chunk)
                n_bytes.append(len(value.encode()))
                n_tokens.append(counts.total)
                over.append(counts.total > limit)
                fit.append(counts.longest(limit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_()), pa.array(fit, pa.int64())],
                [id, "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    narrow = docs.select(F.col(f"`{id}`"), F.col(f"`{text}`"))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(work, f"`{id}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint")
