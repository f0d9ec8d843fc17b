"""Encode texts to piece ids and decode them again."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, strings
from .pieces import Memory, table_for


# Rows whose ids are held at once.
ROWS = 512


@lru_cache(maxsize=4)
def _coded(model: bytes) -> Memory:
    """Per chunk: how many ids, these as decimal text, and the text they decode to."""
    table = table_for(model)

    def work(chunk: str) -> tuple[int, str, str]:
        ids = table.chunk_ids(chunk)
        return len(ids), ",".join(map(str, ids)), table.text_of(ids)

    return Memory(work)


def encode_decode(
    docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", keep_ids: bool = True, keep_text: bool = True
) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` and, if kept, ``ids`` and ``decoded``.

    ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256`` over the decoded
    text in UTF-8. A null text is empty: no ids, the digests of nothing. Repeated rows come back
    as often as they went in; an empty table gives an empty table; other columns are ignored.
    Chunks decode one by one, because no character spans two of them.
    """
    ship(docs.sparkSession)
    proto = Path(model).read_bytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, coded = table_for(proto), _coded(proto)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            out: list[list] = [[], [], [], [], []]
            for value in strings(batch.column(1)):
                parts = [coded[c] for c in table.chunks.findall(table.spaced(value))]
                back = "".join([p[2] for p in parts])
                back = back[1:] if back.startswith(" ") else back
                listed = ",".join([p[1] for p in parts])
                out[0].append(sum([p[0] for p in parts]))
                out[1].append(sha256(listed.encode()).hexdigest())
                out[2].append(sha256(back.encode()).hexdigest())
                if keep_ids:
                    out[3].append(np.array(listed.split(","), np.int32) if listed else [])
                if keep_text:
                    out[4].append(back)
            arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = [id, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays.append(pa.array(out[3], pa.list_(pa.int32())))
                names.append("ids")
            if keep_text:
                arrays.append(pa.array(out[4], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(arrays, names)

    narrow = docs.select(F.col(f"`{id}`"), F.col(f"`{text}`"))
    kind = narrow.schema[0].dataType.simpleString()
    schema = f"`{id}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return narrow.mapInArrow(work, schema)
