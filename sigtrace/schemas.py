"""Fixed table schemas."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

TEXT, LONG, INT, FLAG, TIME = StringType(), LongType(), IntegerType(), BooleanType(), TimestampType()
TEXTS = ArrayType(TEXT)


def table(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


INDICATORS = table(
    feed_id=TEXT,
    pattern_id=LONG,
    entry=TEXT,
    kind=TEXT,
    match_key=TEXT,
    family=INT,
    prefix_len=INT,
    net_bits=TEXT,
    glob_re=TEXT,
    suffix_key=TEXT,
    data=TEXT,
    mode=TEXT,
    probe_tag=TEXT,
    probe=TEXT,
)

FEEDS = table(
    feed_id=TEXT,
    path=TEXT,
    size_bytes=LONG,
    mode=TEXT,
    description=MapType(TEXT, TEXT),
    build_epoch=LONG,
    is_auto_updated=FLAG,
    sha256=TEXT,
)

LINES = table(monitor_id=TEXT, source=TEXT, path=TEXT, line_number=LONG, line=TEXT, event_ts=TIME)

HITS = table(
    id=TEXT,
    timestamp=TIME,
    matched_text=TEXT,
    match_type=TEXT,
    source=TEXT,
    database_id=TEXT,
    matched_indicators=TEXTS,
    data=TEXTS,
    log_line=TEXT,
)

COUNTS = table(run_id=TEXT, monitor_id=TEXT, lines_processed=LONG, items_extracted=LONG, hits_found=LONG, last_hit=TIME)

CATALOG = table(path=TEXT, is_auto_updated=FLAG, sha256=TEXT)

ARTIFACT = table(url=TEXT, sha256=TEXT, size=LONG, signature=TEXT)
MANIFEST = table(
    channel=TEXT,
    databases=ArrayType(table(name=TEXT, version=TEXT, format_version=INT, full=ARTIFACT)),
    generated_at=TEXT,
)

MONITORS = table(monitor_id=TEXT, enabled=FLAG)
