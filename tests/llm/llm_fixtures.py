from __future__ import annotations

import glob
import os

import duckdb
import pytest

DIR = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(60)]


def passage(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 31 + i * i * (seed + 3)) % len(WORDS)] + str((seed + i) % 17) for i in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, a null id, a repeated row, copies, near copies, odd spaces, a very long text, clashing names."""
    base = passage(1, 80)
    texts = {
        0: base, 1: base, 2: base.replace("w", "W"), 3: None, 4: "", 5: " \t\n ", 6: "one", 7: passage(2, 30) + "\n" + base + "\n",
        8: base + " tail", 9: "\n".join([passage(3, 12)] * 3), 10: passage(4, 20_000), 11: "é😀 ü a\x0bb\x0cc", 12: passage(5, 40) + "\n" + passage(3, 12),
    }
    rows = [(i, t, "en", "src" + str(i % 3) if i % 5 else None, len(t or ""), "clash", 1.0) for i, t in texts.items()]
    return [*rows, rows[0], (None, base, None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double"


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con
