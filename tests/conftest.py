from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from storeflow.session import local_session, share_package  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"

CLEAN_DDL = (
    "row_id string, order_id string, order_date date, ship_date date, ship_mode string, "
    "customer_id string, customer_name string, segment string, country string, city string, "
    "state string, postal_code string, region string, product_id string, category string, "
    "sub_category string, product_name string, sales decimal(12,2), quantity int, "
    "discount decimal(4,2), profit decimal(12,2)"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("*", shuffle_partitions=8, app_name="storeflow-tests",
                      checkpoint_dir=str(tmp_path_factory.mktemp("checkpoint")))
    share_package(s, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    yield s


def line(i: int, **kw) -> dict:
    """One clean order line with harmless defaults."""
    base = dict(
        row_id=str(i), order_id=f"O{i}", order_date=dt.date(2020, 1, 1),
        ship_date=dt.date(2020, 1, 3), ship_mode="Standard", customer_id=f"C{i}",
        customer_name=f"Customer {i}", segment="Consumer", country="US", city="X",
        state="S", postal_code="10001", region="East", product_id=f"P{i}",
        category="Cat", sub_category="Sub", product_name=f"Product {i}",
        sales=Decimal("10.00"), quantity=1, discount=Decimal("0.00"), profit=Decimal("1.00"),
    )
    for k, v in kw.items():
        if k in ("sales", "profit", "discount") and v is not None and not isinstance(v, Decimal):
            v = Decimal(str(v))
        base[k] = v
    return base


@pytest.fixture
def lines(spark):
    def make(rows: list[dict]):
        cols = [c.split()[0] for c in CLEAN_DDL.split(", ")]
        return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], CLEAN_DDL)
    return make
