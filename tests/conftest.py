import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from deskline.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def seeds(spark):
    """The five demo tickets."""
    # Golden data.
    rows = [
        ("1", "Phone screen cracked", "My phone screen is cracked after I dropped it yesterday. The touch still works but there is a big crack across the display.", "Product Issue", 0.94),
        ("2", "App crashes on startup", "The main app crashes every time I try to open it. Just shows a white screen then closes. Reinstalled but same problem.", "Software Issue", 0.91),
        ("3", "WiFi keeps disconnecting", "WiFi disconnects every few minutes. Have to manually reconnect each time. Other devices work fine on same network.", "Network Issue", 0.89),
        ("4", "Battery drains in 2 hours", "Battery goes from 100% to 20% in just 2 hours with minimal use. Used to last all day.", "Battery Issue", 0.93),
        ("5", "How do I reset my password", "I forgot my password and need help resetting it. The reset email is not arriving in my inbox.", "General Question", 0.88),
    ]
    df = spark.createDataFrame(rows, "id string, title string, description string, predicted_category string, confidence_score double")
    return df.selectExpr(
        "id", "title", "description", "predicted_category", "predicted_category as actual_category", "confidence_score",
        "'seeded' as reasoning", "'corrected' as status",
        "timestamp_ntz'2024-01-01 00:00:00' as created_at", "timestamp_ntz'2024-01-01 00:00:00' as updated_at",
    )


def plan_of(df) -> str:
    """The physical plan with its full details."""
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
