import math
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tierwatch.session import local_session
    s = local_session("*", shuffle_partitions=8, app="tierwatch-tests")
    yield s
    s.stop()


SUPPLIER_DDL = ("supplier_id string, supplier_name string, risk_score double, latitude double, "
                "longitude double, region string, tier bigint, annual_spend_usd double, "
                "last_audit_date string")


@pytest.fixture
def suppliers(spark):
    """Build a typed supplier frame from tuples."""
    def make(rows):
        return spark.createDataFrame(rows, SUPPLIER_DDL)
    return make


@pytest.fixture
def valid_pair(suppliers):
    return suppliers([
        ("SUP-001", "Acme Metals", 0.12, 48.1, 11.5, "EMEA", 2, 250_000.0, "2025-11-30"),
        ("SUP-002", "Pacific Parts", 0.88, 35.6, 139.7, "APAC", 1, 1_250_000.0, None),
    ])


@pytest.fixture
def scenario_four(suppliers):
    """One supplier strong in each component; spends are e**k - 1, so the
    financial components are 12/12, 6/12, 3/12 and 2/12."""
    e = math.e
    return suppliers([
        ("SPEND-1", "Harbour Finance", 0.05, 1.3, 103.8, "NA", 4, e ** 12 - 1, "2025-03-22"),
        ("PLACE-1", "Ridge Minerals", 0.45, 47.4, 19.1, "EMEA", 3, e ** 6 - 1, "2025-04-11"),
        ("LEVEL-1", "Quay Assembly", 0.35, 45.5, -73.6, "NA", 1, e ** 3 - 1, "2025-05-21"),
        ("AUDIT-1", "Dune Textiles", 0.25, -33.4, -70.7, "LATAM", 2, e ** 2 - 1, None),
    ])
