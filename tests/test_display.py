from conftest import SF_SMALL

from tillroll.operators import insights as IN
from tillroll.operators import inventory as INV
from tillroll.operators import stats as ST
from tillroll.sources.fixture import raw_transactions


def test_shape_preview_and_split(spark):
    raw = raw_transactions(spark, SF_SMALL, spaced_names=True)
    assert ST.shape(raw) == (6142, 9)
    assert ST.preview(raw).count() == 20
    num, other = ST.split_columns(raw)
    assert num == ["Quantity", "Price", "Customer ID"]
    assert "InvoiceDate" in other and "Invoice" in other


def test_top_insights_and_categories(spark, featured_small):
    ins = IN.generate(featured_small, None, INV.recommend(featured_small))
    first = [r.title for r in IN.top(ins).collect()]
    assert first == ["Highest Revenue Month", "Lowest Revenue Month", "Top Market", "Top Revenue Product"]
    cats = sorted(r.category for r in IN.categories(ins).collect())
    assert cats == ["Geography", "Inventory", "Product", "Revenue", "Trend"]
    assert IN.by_category(ins, "Trend").count() == 2
