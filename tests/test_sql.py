"""Queries against their SQL on small odd tables."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folioflow.plans import registry

#: Every line is a contents line, white space outside ASCII, vertical tabs, line ends other than a line feed.
LINES = ["Title 12", "Title 12\nOther 7", "Title 12\n\n", "a...", "a 12", "a　12", "标题 5\nb", "a\x0b12", "a 12\x0b", "a 12 ", "a\x0c12\r\nb 3", "a ٣", "…!\nx 1?", "　a 1", "a  9", " a 5", "", None]


@pytest.fixture
def against(spark, tmp_path):
    def rows(name: str, **tables: pa.Table) -> tuple[list, list]:
        con = duckdb.connect()
        for t, data in tables.items():
            pq.write_table(data, f"{tmp_path}/{t}.parquet")
            con.register(t, data)
        got = registry.QUERIES[name](spark, str(tmp_path)).collect()
        return sorted(map(tuple, got), key=str), sorted(con.execute(registry.ORACLE[name]).fetchall(), key=str)

    return rows


def texts(values: list) -> pa.Table:
    return pa.table({"doc_id": pa.array(range(len(values)), pa.int64()), "text": pa.array(values, pa.string())})


def test_contents_lines_as_in_sql(against):
    got, want = against("toc_filter", documents=texts(LINES))
    assert got == want and (0, 0, "d41d8cd98f00b204e9800998ecf8427e") in got


def test_traces_as_in_sql(against):
    said = ["the\rx in", "the\u2028 and", "thexiné", "the iñ and", "éthe x", "the\x0b x", "the\u00a0", "the \u3000\u3000", "the x\x0b", "the  a", "thez", "of the\nin", "of the, : of", "the\u0085in", "_the in_", "", None]
    for name in ("trace_clean", "trace_examples"):
        for part in (said, *[said[k : k + 1] for k in range(len(said))]) if name == "trace_clean" else (said, said[5:]):
            got, want = against(name, documents=texts(part))
            assert got == want, part
