"""Order-insensitive comparison of a DataFrame with a DuckDB query."""

import math
import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    return None if isinstance(x, float) and math.isnan(x) else x


def rows(arrow, columns):
    return sorted(([plain(v) for v in r] for r in zip(*[arrow.column(c).to_pylist() for c in columns], strict=True)), key=str)


def same(x, y):
    return x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)


def assert_equal(df, con, sql):
    got, want = df.toArrow(), con.sql(sql).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))]
    assert not bad, bad[:3]
