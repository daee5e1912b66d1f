"""Column-level scalar functions (built-in Spark expressions only, no UDFs)."""

from tillroll.functions.calendar import (day_name, day_number, elapsed_days, month_name,
                                         season, year_month)
from tillroll.functions.formatting import (fmt_currency, fmt_fixed, fmt_number, fmt_percent,
                                           fmt_plain_float)
from tillroll.functions.numeric import safe_divide, strip_ws

__all__ = [
    "day_name", "day_number", "elapsed_days", "month_name", "season", "year_month",
    "fmt_currency", "fmt_fixed", "fmt_number", "fmt_percent", "fmt_plain_float",
    "safe_divide", "strip_ws",
]
