"""Property tests (hypothesis): exact rounding and formatting equal Python's."""

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillroll.functions.formatting import fmt_fixed
from tillroll.functions.numeric import np_round, py_round
from tillroll.operators.churn import binary_metrics

FLOATS = st.one_of(
    st.floats(min_value=-1e9, max_value=1e9, allow_nan=False, allow_infinity=False),
    st.integers(min_value=-10**7, max_value=10**7).map(lambda n: n / 1000),     # many exact decimal ties
    st.integers(min_value=-10**6, max_value=10**6).map(lambda n: n / 8),        # exact binary ties
)
# each example is a Spark job: few examples, no shrinking (a failure prints its example)
SETTINGS = settings(max_examples=8, deadline=None, phases=[Phase.explicit, Phase.reuse, Phase.generate],
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(xs=st.lists(FLOATS, min_size=20, max_size=60), d=st.integers(min_value=0, max_value=3))
def test_py_round_equals_python_round(spark, xs, d):
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    got = [r[0] for r in df.select(py_round("x", d)).collect()]
    assert got == [round(x, d) for x in xs]


@SETTINGS
@given(xs=st.lists(FLOATS, min_size=20, max_size=60), d=st.integers(min_value=0, max_value=2))
def test_fixed_text_equals_python_format(spark, xs, d):
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    got = [r[0] for r in df.select(fmt_fixed("x", d)).collect()]
    assert got == [f"{x:,.{d}f}" for x in xs]


@SETTINGS
@given(xs=st.lists(FLOATS, min_size=20, max_size=60))
def test_np_round_equals_numpy(spark, xs):
    import numpy as np
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    got = [r[0] for r in df.select(np_round("x", 2)).collect()]
    assert got == [float(np.round(x, 2)) for x in xs]


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 1), st.floats(0, 1, allow_nan=False)), min_size=10, max_size=80))
def test_binary_metric_counts_add_up(spark, rows):
    df = spark.createDataFrame(rows, "label INT, score DOUBLE")
    m = binary_metrics(df).first()
    assert m.tp + m.fp + m.tn + m.fn == m.n == len(rows)
    assert 0.0 <= m.accuracy <= 1.0 and 0.0 <= m.f1_score <= 1.0
    if m.roc_auc is not None:
        assert 0.0 <= m.roc_auc <= 1.0
