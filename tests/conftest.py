from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Dated headlines, one per line, as the jobs read them.
HEADLINES = [
    "20191124,woman stabbed adelaide shopping centre",
    "20191204,economy continue teetering edge recession",
    "20200401,coronanomics learnt coronavirus economy",
    "20200401,coronavirus home test kits selling chinese community",
    "20201015,coronavirus pacific economy foriegn aid china",
    "20201016,china builds pig apartment blocks guard swine flu",
    "20211216,economy starts bounce unemployment",
    "20211224,online shopping rise due coronavirus",
    "20211229,china close encounters elon musks",
]

# Headlines after stop-word removal.
CLEANED = [
    ("2003", "council chief executive fails secure position"),
    ("2003", "council welcomes ambulance levy decision"),
    ("2003", "council welcomes insurance breakthrough"),
    ("2003", "fed opp introduce national insurance"),
    ("2004", "cowboys survive eels comeback"),
    ("2004", "cowboys withstand eels fightback"),
    ("2004", "castro vows cuban socialism survive bush"),
    ("2020", "coronanomics learnt coronavirus economy"),
    ("2020", "coronavirus home test kits selling chinese community"),
    ("2020", "coronavirus campbell remess streams bear classes"),
    ("2020", "coronavirus pacific economy foriegn aid china"),
    ("2020", "china builds pig apartment blocks guard swine flu"),
]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("textmine-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def headlines(spark):
    """``<id, value>`` with ids 0 to 8."""
    return spark.createDataFrame(list(enumerate(HEADLINES)), "id bigint, value string")


@pytest.fixture(scope="session")
def parsed(headlines):
    from textmine.sources.lines import parse_dated_lines

    return parse_dated_lines(headlines, id_col="id")


@pytest.fixture(scope="session")
def cleaned(spark):
    rows = [(i, p, text.split(" ")) for i, (p, text) in enumerate(CLEANED)]
    return spark.createDataFrame(rows, "id bigint, period string, words array<string>")


def tuples(df):
    return [tuple(row) for row in df.collect()]
