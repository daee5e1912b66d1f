"""DuckDB text of the shared input chain (raw -> clean -> featured).

Each oracle query is ``with_chain(level, body)``: the CTEs up to ``level``
followed by the query body. The SQL restates the reference's semantics
independently of the Spark code so the two can check each other.
"""

from __future__ import annotations

from tillroll.config import DEFAULT, NON_PRODUCT_CODES
from tillroll.sources.fixture import duckdb_raw_ctes

_CODES = ", ".join(f"'{c}'" for c in NON_PRODUCT_CODES)
WS = r"'^\s+|\s+$'"


def clean_ctes(cfg=DEFAULT) -> str:
    return f"""std AS (
 SELECT Invoice, StockCode, Description, Quantity, InvoiceDate, Price AS UnitPrice, CustomerID, Country, SourceSheet FROM raw),
dedup AS (SELECT DISTINCT * FROM std),
has_cust AS (SELECT * FROM dedup WHERE CustomerID IS NOT NULL),
descr AS (
 SELECT * REPLACE (regexp_replace(coalesce(Description, 'UNKNOWN ITEM'), {WS}, '', 'g') AS Description) FROM has_cust),
cust_txt AS (
 SELECT * REPLACE (CAST(CAST(trunc(CustomerID) AS BIGINT) AS VARCHAR) AS CustomerID) FROM descr WHERE Description <> ''),
dated AS (SELECT * FROM cust_txt WHERE InvoiceDate IS NOT NULL),
flagged AS (SELECT *, coalesce(starts_with(Invoice, 'C'), false) AS IsCancelled FROM dated),
valid AS (SELECT * FROM flagged WHERE NOT IsCancelled AND Quantity > 0 AND UnitPrice >= {cfg.min_valid_price}),
products AS (SELECT * FROM valid WHERE upper(coalesce(StockCode, '')) NOT IN ({_CODES})),
caps AS (SELECT quantile_cont(Quantity, {cfg.quantity_cap_pct}) AS q_cap,
                quantile_cont(UnitPrice, {cfg.price_cap_pct}) AS p_cap FROM products),
capped AS (SELECT p.* REPLACE (least(Quantity, q_cap) AS Quantity, least(UnitPrice, p_cap) AS UnitPrice)
           FROM products p CROSS JOIN caps),
clean AS (
 SELECT coalesce(Invoice, 'UNKNOWN') AS Invoice, coalesce(StockCode, 'UNKNOWN') AS StockCode, Description,
        Quantity, InvoiceDate, UnitPrice, CustomerID,
        coalesce(regexp_replace(Country, {WS}, '', 'g'), 'UNKNOWN') AS Country,
        Quantity * UnitPrice AS TotalPrice, IsCancelled
 FROM capped)"""


def featured_ctes(cfg=DEFAULT) -> str:
    return f"""dq AS (SELECT quantile_cont(Quantity, {cfg.demand_low_q}) AS _lo,
               quantile_cont(Quantity, {cfg.demand_high_q}) AS _hi FROM clean),
snap AS (SELECT max(InvoiceDate) + INTERVAL 1 DAY AS snapshot FROM clean),
inv_tot AS (SELECT Invoice, CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) AS InvoiceTotalValue, sum(Quantity) AS InvoiceTotalQuantity
            FROM clean GROUP BY Invoice),
cust_agg AS (
 SELECT CustomerID, min(InvoiceDate) AS FirstPurchaseDate, max(InvoiceDate) AS LastPurchaseDate,
        count(DISTINCT Invoice) AS TotalOrders, CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) AS TotalSpend,
        sum(Quantity) AS TotalItemsPurchased
 FROM clean GROUP BY CustomerID),
cust_days AS (
 SELECT c.*, greatest(date_sub('day', FirstPurchaseDate, snapshot), 1) AS CustomerTenureDays,
        date_sub('day', LastPurchaseDate, snapshot) AS RecencyDays
 FROM cust_agg c CROSS JOIN snap),
cust_val AS (
 SELECT *, coalesce(TotalSpend / nullif(TotalOrders, 0), 0.0) AS AverageOrderValue,
        coalesce(TotalOrders / (CustomerTenureDays / CAST(30.0 AS DOUBLE)), 0.0) AS PurchaseFrequency,
        coalesce(TotalSpend / nullif(TotalOrders, 0) * (TotalOrders / (CustomerTenureDays / CAST(30.0 AS DOUBLE)))
                 * (CustomerTenureDays / CAST(30.0 AS DOUBLE)), 0.0) AS CustomerLifetimeValue
 FROM cust_days),
featured AS (
 SELECT c.*, year(InvoiceDate) AS Year, month(InvoiceDate) AS Month, strftime(InvoiceDate, '%b') AS MonthName,
        quarter(InvoiceDate) AS Quarter, strftime(InvoiceDate, '%A') AS DayOfWeek,
        isodow(InvoiceDate) - 1 AS DayOfWeekNum, hour(InvoiceDate) AS Hour,
        CASE WHEN month(InvoiceDate) IN (12, 1, 2) THEN 'Winter' WHEN month(InvoiceDate) IN (3, 4, 5) THEN 'Spring'
             WHEN month(InvoiceDate) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS Season,
        strftime(InvoiceDate, '%Y-%m') AS YearMonth,
        CASE WHEN Quantity <= _lo THEN 'Low' WHEN Quantity <= _hi THEN 'Medium' ELSE 'High' END AS DemandLevel,
        InvoiceTotalValue, InvoiceTotalQuantity, v.AverageOrderValue, v.PurchaseFrequency,
        v.CustomerLifetimeValue, v.RecencyDays, v.TotalOrders AS CustomerTotalOrders,
        v.TotalSpend AS CustomerTotalSpend
 FROM clean c CROSS JOIN dq JOIN inv_tot USING (Invoice) LEFT JOIN cust_val v USING (CustomerID))"""


def with_chain(level: str, body: str, cfg=DEFAULT, extra: str = "", recursive: bool = False) -> str:
    """``level`` in {raw, clean, featured}; ``extra`` adds more CTEs after the chain."""
    parts = [duckdb_raw_ctes()]
    if level in ("clean", "featured"):
        parts.append(clean_ctes(cfg))
    if level == "featured":
        parts.append(featured_ctes(cfg))
    if extra:
        parts.append(extra.strip().rstrip(","))
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body.strip()
