"""Driver contract: entry smoke, query/oracle keys, a few oracle comparisons at sf0.001."""
import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from vigil.plans import catalog
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and sum(r["n"] for r in rows) > 0


def test_oracle_keys_subset():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    own = catalog.queries()
    assert set(own) <= set(o)


def _canon(df):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False):
        row = []
        for v in rec:
            if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
                row.append(None)
            elif isinstance(v, pd.Timestamp):
                row.append(v.to_pydatetime().replace(tzinfo=None))
            elif hasattr(v, "item"):
                row.append(v.item())
            else:
                row.append(v)
        out.append(tuple(row))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["asof_enrich", "interpolate_gaps", "zscore_filter", "cooldown_events",
                                  "rolling_features", "split_counts", "range_warnings", "health_tiers"])
def test_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    exp = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert _canon(got) == _canon(exp)
