"""The small tables as plain Python rows."""
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"


def rows(table, *columns, sf=SF):
    return [tuple(r[c] for c in columns) for r in pq.read_table(f"{sf}/{table}.parquet", columns=list(columns)).to_pylist()]


def texts_of(table, key="doc_id", sf=SF):
    return rows(table, key, "text", sf=sf)
