"""Every registered SQL runs in DuckDB and gives its query's rows."""

import math
import os

import duckdb
import pytest

from seqrec.llm import queries
from seqrec.llm.sql import SQL

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 6)) if isinstance(v, float) else repr(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def check(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    got = con.execute(SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    want = rows(columns, got.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want and want


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same_rows(spark, name):
    check(spark, name, SF)


def test_private_keys_in_sql(spark, tmp_path):
    """The pattern of rule pem that DuckDB can read finds the same spans."""
    line, last = "M" * 64, "abcd+/EFGH12=="
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = f"{line}\n{line}\n{last}"
    texts = [f"a\n{begin}\n{body}\n{end}\nafter {begin}", f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES,01\n\n{body}\nafter all", f"{begin}\r\n{line}\r\n{last}", f'"{begin}\\n{line}\\n{last}\\n" token=abcdefgh',
             f"{begin} is a header", f"{begin}\n{body}\n-----BEGIN CERTIFICATE-----\nxyz\n-----END CERTIFICATE-----\n{begin}\n{body}\n{end}", f"> {begin}\n> {line}\n> {line}\n> word", None, ""]
    import pandas as pd
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(f"{tmp_path}/documents.parquet")
    check(spark, "op8_secrets", str(tmp_path))
