"""Tunable constants for every operator, in one frozen dataclass.

Operators take ``cfg: Config = DEFAULT`` so a caller can change a threshold
without touching code (``dataclasses.replace(DEFAULT, clusters=5)``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values that must equal the reference's for equal results ---------
# Non-product stock codes dropped during cleaning (compared upper-cased).
NON_PRODUCT_CODES = ("POST", "D", "DOT", "M", "S", "BANK CHARGES",
                     "CRUK", "PADS", "AMAZONFEE", "TEST001", "TEST002")
# Ordered segment label pool; k clusters pick evenly spaced slots from it.
SEGMENT_LABELS = ("Champions", "Loyal Customers", "Potential Loyalists",
                  "Needs Attention", "At Risk", "Hibernating", "Lost")
# Weekday names, Monday first (weekday number 0).
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
            "Saturday", "Sunday")
# Month number -> season.
SEASONS = {12: "Winter", 1: "Winter", 2: "Winter",
           3: "Spring", 4: "Spring", 5: "Spring",
           6: "Summer", 7: "Summer", 8: "Summer",
           9: "Autumn", 10: "Autumn", 11: "Autumn"}
# Columns of the clean table, in order.
CLEAN_COLUMNS = ("Invoice", "StockCode", "Description", "Quantity",
                 "InvoiceDate", "UnitPrice", "CustomerID", "Country",
                 "TotalPrice", "IsCancelled")
# Churn model features, in model order.
CHURN_FEATURES = ("Recency", "Frequency", "Monetary", "AvgOrderValue", "TenureDays")
STOCK_ACTIONS = ("Increase Stock", "Maintain Stock", "Reduce Stock")
# Insight rows in order: (category, title, sentence with %s slots).
INSIGHTS = (
    ("Revenue", "Highest Revenue Month", "%s generated %s in revenue, the strongest month in the dataset."),
    ("Revenue", "Lowest Revenue Month", "%s was the weakest month, with only %s in revenue."),
    ("Geography", "Top Market", "%s is the top market, contributing %s (%s%% of total revenue)."),
    ("Product", "Top Revenue Product", "'%s' is the highest-grossing product at %s in total sales."),
    ("Product", "Best-Selling Product by Volume", "'%s' is the top seller by units, with %s units sold."),
    ("Trend", "Fastest Growing Product",
     "'%s' grew %s%% in the most recent 30-day period versus the prior 30 days."),
    ("Trend", "Declining Demand",
     "'%s' demand fell %s%% over the same comparison window and may need markdown or review."),
    ("Customers", "Most Valuable Customer Segment",
     "'%s' customers drive %s%% of total customer revenue despite being %s%% of the customer base."),
    ("Inventory", "Stock Action Needed",
     "%s top products show rising demand and should have stock increased; "
     "%s show declining demand and are candidates for stock reduction."),
)


@dataclass(frozen=True)
class Config:
    churn_inactivity_days: int = 90
    at_risk_factor: float = 0.6
    forecast_horizon_days: int = 30
    clusters: int = 4
    kmeans_restarts: int = 10
    quantity_cap_pct: float = 0.995
    price_cap_pct: float = 0.995
    min_valid_price: float = 0.01
    # reading of text dates (ymd, mdy, dmy); None: the one that parses most values of the column
    date_reading: str | None = None
    demand_low_q: float = 0.33
    demand_high_q: float = 0.67
    increase_threshold: float = 0.10
    reduce_threshold: float = -0.10
    service_level_z: float = 1.65
    lead_time_days: int = 7
    trend_window_days: int = 30
    std_window_days: int = 60
    top_n_skus: int = 50
    interval_z: float = 1.645
    seed: int = 42
    currency: str = "£"
    # churn model
    rf_trees: int = 120
    rf_depth: int = 8
    rf_min_leaf: int = 5
    test_fraction: float = 0.25
    split_buckets: int = 10_000
    min_train_rows: int = 50
    min_history_days: int = 30
    # Holt-Winters (fixed parameters for the oracle-checked forecast)
    hw_alpha: float = 0.3
    hw_beta: float = 0.05
    hw_gamma: float = 0.2
    hw_grid: tuple = field(default=(0.1, 0.3, 0.5, 0.7, 0.9))
    hw_trend_grid: tuple = field(default=(0.01, 0.05, 0.2))
    season_length: int = 7
    min_forecast_days: int = 14


DEFAULT = Config()
