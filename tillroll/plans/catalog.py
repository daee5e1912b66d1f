"""Importing this module registers every query (see registry.QUERIES / ORACLES)."""

from tillroll.plans import q_cleaning  # noqa: F401
from tillroll.plans import q_sales  # noqa: F401
from tillroll.plans import q_models  # noqa: F401
from tillroll.plans import q_inventory  # noqa: F401
from tillroll.plans import q_forecast  # noqa: F401
from tillroll.plans import q_insights  # noqa: F401
from tillroll.plans import q_io  # noqa: F401
from tillroll.plans import q_twins  # noqa: F401
