"""Table functions over source texts: one row of text gives rows of what it holds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType, _parse_datatype_string

#: Texts whose rows are held as Python objects at once.
SLICE = 128


def parse(rows: DataFrame, key: str, path: str, text: str, function, schema: str) -> DataFrame:
    """(key, columns of ``schema``): ``function(path, text)`` yields tuples for each row.

    Texts go to Python in Arrow batches and are parsed whole, one at a time; a
    null text is an empty one. Only the rows of ``SLICE`` texts are held, however
    many a batch has. Rows keep no order between texts.
    """
    spec = _parse_datatype_string(schema)
    assert isinstance(spec, StructType)
    kind: DataType = rows.schema[key].dataType
    types = [to_arrow_type(kind), *[to_arrow_type(f.dataType) for f in spec.fields]]
    names = [key, *[f.name for f in spec.fields]]

    def run(batches):
        for some in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            out = [(k, *row) for k, p, t in zip(*(some.column(i).to_pylist() for i in range(3)), strict=True) for row in function(p or "", t or "")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.select(key, path, text).mapInArrow(run, StructType([rows.schema[key], *spec.fields]))
