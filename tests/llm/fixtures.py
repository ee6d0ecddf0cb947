"""Small tables for the text operators: written as Parquet, read by the registered queries."""

import os
import tempfile

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
TYPES = {
    "documents": DOCUMENTS,
    "benchmark": pa.schema([("item_id", pa.int64()), ("text", pa.string())]),
    "pages": pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]),
    "embeddings": pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())]),
    "conversations": pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]),
}


def tables(**rows) -> str:
    """A folder with one Parquet file per table; rows are tuples of the first columns."""
    folder = tempfile.mkdtemp(prefix="llm-tables-")
    for name, data in rows.items():
        schema = TYPES[name]
        full = [tuple(r) + (None,) * (len(schema) - len(r)) for r in data]
        cols = list(zip(*full)) if full else [[] for _ in schema]
        arrays = [pa.array(list(c), f.type) for c, f in zip(cols, schema)]
        # a column that no operator asked for, named like those they add
        extra = [pa.array(["x"] * len(full), pa.string()) for _ in range(4)]
        table = pa.Table.from_arrays(arrays + extra, [*schema.names, "sid", "shard", "score", "slot"])
        pq.write_table(table, os.path.join(folder, f"{name}.parquet"))
    return folder


def collect(df) -> pd.DataFrame:
    rows = df.collect()
    return pd.DataFrame([r.asDict() for r in rows], columns=df.columns)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]
