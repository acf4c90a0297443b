"""Property checks (SURVEY §5 (d)): as-of join and fills equal brute force on random inputs."""
import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vigil.operators.asof import asof_join

D0 = dt.datetime(2024, 1, 1)
rows_left = st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 40)), min_size=1, max_size=25)
rows_right = st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 40),
                                st.one_of(st.none(), st.integers(0, 9))), max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows_left, rows_right)
def test_asof_equals_brute_force(spark, left, right):
    L = [(k, D0 + dt.timedelta(hours=h), i) for i, (k, h) in enumerate(left)]
    R = [(k, D0 + dt.timedelta(hours=h), j, None if p is None else float(p)) for j, (k, h, p) in enumerate(right)]
    l = spark.createDataFrame(L, "k string, t timestamp, lid long")
    r = spark.createDataFrame(R, "k string, t timestamp, rid long, p double")
    out = asof_join(l, r, on="t", by="k", left_tiebreak="lid", right_tiebreak="rid", bucket_seconds=5 * 3600)
    got = {x["lid"]: (x["rid"], x["p"]) for x in out.collect()}
    assert len(got) == len(L)
    for k, t, i in L:
        cands = [x for x in R if x[0] == k and x[1] <= t]
        best = max(cands, key=lambda x: (x[1], x[2])) if cands else None
        assert got[i] == ((best[2], best[3]) if best else (None, None))
