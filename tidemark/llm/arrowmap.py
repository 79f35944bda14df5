"""Text operators in Python as one narrow stage: columns go in, columns are added."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.textkernel import slices


def add_columns(df: DataFrame, text: str, fields: list[T.StructField], work: Callable[[pa.Array], list], most: int = 4 << 20) -> DataFrame:
    """Append ``fields``, computed by ``work`` from pieces of the column ``text``.

    An input column named like a new one (in any case) is replaced by it.
    ``work`` gets an Arrow string array and returns one list or array for each
    field.  Nothing but the piece at hand is kept, so memory is bounded by the
    piece and the longest text.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [*kept, *(f.name for f in fields)]
    source = text if text in kept else "__source_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, source, most):
                made = work(piece.column(source))
                columns = [piece.column(c) for c in kept]
                columns += [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    extra = [] if source == text else [df[text].alias(source)]
    return df.select(*(df[c] for c in kept), *extra).mapInArrow(run, schema)
