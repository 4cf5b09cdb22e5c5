"""Every query of the package runs; those with SQL equal it."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
import verify
from docloom.llm import catalogue


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


#: Keys of the results that SQL does not check.
KEYS = {"p1_pieces": ("item_field", "item_id", "piece_no"), "p2_found": ("pair_id",), "p2_defects": ("pair_id",), "p4_neighbours": ("vec_id", "rank"), "p6_ids": ("doc_id",), "p7_bins": ("doc_id", "part"), "p7_fill": ("bins",), "p8_found": ("doc_id",), "p8_restored": ("doc_id",)}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, sf, name):
    mine = catalogue.QUERIES[name](spark, sf).toArrow()
    if name in catalogue.ORACLE:
        theirs = con.sql(catalogue.ORACLE[name]).to_arrow_table()
        assert verify.kinds(mine) == verify.kinds(theirs)
        assert verify.canonical(mine) == verify.canonical(theirs)
    else:
        rows = list(zip(*(mine.column(c).to_pylist() for c in KEYS[name])))
        assert rows and len(set(rows)) == len(rows)
        assert not any(mine.column(c).null_count == mine.num_rows for c in mine.column_names)


def test_entry_has_them():
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
