import os
import sys

import pytest
from helpers import at
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from funnelspark.schemas import EVENTS
from funnelspark.session import tune


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("funnelspark-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        # A handful of rows per test: compiling a class per stage would take most of the time.
        .config("spark.sql.codegen.wholeStage", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def events_of(spark):
    """Event rows from (minutes, type, product, user, session[, price, brand, category])."""

    def make(rows):
        full = []
        for minutes, kind, product, user, session, *more in rows:
            price, brand, code = (list(more) + [10.0, "acme", "home.lamp"][len(more):])[:3]
            full.append((at(minutes), kind, product, 1, code, brand, price, user, session))
        return spark.createDataFrame(full, EVENTS)

    return make
