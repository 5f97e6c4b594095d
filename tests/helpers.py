"""Small tables for tests."""

from sigtrace.functions.patterns import CASE_SENSITIVE
from sigtrace.operators.staging import stage
from sigtrace.schemas import LINES
from sigtrace.sources.feeds import indicators_from


def tlds(spark):
    return spark.sql("SELECT * FROM VALUES ('com'), ('net'), ('org') AS t(tld)")


def lines(spark, *texts, monitor="m", source="log"):
    rows = [(monitor, source, "/p", i + 1, t, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, LINES)


def feed(spark, entries, feed_id="f", mode=CASE_SENSITIVE):
    """Indicators of (entry, data) pairs or bare entries."""
    rows = [(feed_id, mode, *(e if isinstance(e, tuple) else (e, None))) for e in entries]
    return stage(indicators_from(spark.createDataFrame(rows, "feed_id string, mode string, entry string, data string")))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
