"""Sources: table scans and the fixture views the queries read."""

from .tables import (TEST_TABLES, nan_to_null, preview, read_table, register_test_views,
                     spread, test_table)
from .fixtures import customer_period, customer_period_from_orders, loan_like

__all__ = ["TEST_TABLES", "nan_to_null", "preview", "read_table", "register_test_views",
           "spread", "test_table", "customer_period", "customer_period_from_orders", "loan_like"]
