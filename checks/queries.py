"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame`` over the whole given tables.

Arrays are joined to text and times rendered, so that results compare by value.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigtrace import functions as S
from sigtrace.functions import patterns as P
from sigtrace.operators import counters as C
from sigtrace.operators import hits as H
from sigtrace.operators import indicators as I
from sigtrace.operators import lines as L
from sigtrace.operators.extract import extract
from sigtrace.plans.hits import lookup, match_candidates, scan
from sigtrace.operators.staging import shared_folder, stage
from sigtrace.plans.update import current_feeds, current_indicators, publish_feed, replace_auto_updated, save_feeds, unload_feeds
from sigtrace.schemas import MANIFEST
from sigtrace.sources import artifacts as A
from sigtrace.sources import catalog as K
from sigtrace.sources.feeds import indicators_from, load_feed
from sigtrace.sources.logs import name_matches, read_log_lines, read_log_stream, tail_files
from sigtrace.sources.tail import register_tail
from sigtrace.streaming.scan import running_counters, scan_stream, stored_hits

from . import views as V

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def feed(spark, sf_dir, *names) -> DataFrame:
    return stage(V.indicators(spark, sf_dir, *names))


def shown(hits: DataFrame, *extra) -> DataFrame:
    return hits.select(
        "id",
        "matched_text",
        "match_type",
        "source",
        "database_id",
        F.array_join("matched_indicators", ", ").alias("indicators"),
        F.array_join("data", ", ").alias("payload"),
        *extra,
    )


def known(c):
    """Numbers without nulls: -1 stands for none."""
    return F.coalesce(c, F.lit(-1))


def items(spark, sf_dir, lines, *types) -> DataFrame:
    return extract(lines, V.tlds(spark), types or None).select(
        "path", "line_number", "pos", "match_type", "matched_text", "lookup_key", known(F.col("family")).alias("family"), "ip_bits"
    )


# -- lines and extraction ------------------------------------------------------


@query
def lines_documents(spark, sf_dir):
    return V.lines_documents(spark, sf_dir).select("monitor_id", "source", "path", "line_number", "line")


@query
def tail_lines(spark, sf_dir):
    """Of every document as a text of its own, cut from the end."""
    tail = L.last_lines(F.col("text"), 3)
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), tail.alias("tail")).where("tail is not null")


@query
def tail_log_files(spark, sf_dir):
    """The last 50 lines of each source's log file, read from its end."""
    tails = tail_files(spark, V.log_files(spark, sf_dir), 50, recursive=True)
    return V.lines_files(tails)


@query
def tail_lines_long(spark, sf_dir):
    """The last 2,000 lines of each source's log, empty ones included."""
    lines = V.lines_files(read_log_lines(spark, V.log_files(spark, sf_dir), "m", recursive=True, keep_empty=True))
    return L.tail_lines(lines, 2000).select("path", F.md5(F.col("tail").cast("binary")).alias("tail_md5"))


@query
def read_logs(spark, sf_dir):
    """Numbered lines of log files, one file per source."""
    lines = V.lines_files(read_log_lines(spark, V.log_files(spark, sf_dir), "m", recursive=True))
    return lines.select("path", "line_number", "line")


@query
def extract_ipv4(spark, sf_dir):
    return items(spark, sf_dir, V.lines_documents(spark, sf_dir), P.IPV4_TYPE)


@query
def extract_domain(spark, sf_dir):
    both = V.lines_documents(spark, sf_dir).unionByName(V.lines_pages(spark, sf_dir))
    return items(spark, sf_dir, both, P.DOMAIN_TYPE)


@query
def extract_email(spark, sf_dir):
    return items(spark, sf_dir, V.lines_documents(spark, sf_dir), P.EMAIL_TYPE)


@query
def extract_sha1(spark, sf_dir):
    return items(spark, sf_dir, V.lines_documents(spark, sf_dir), P.SHA1_TYPE)


@query
def extract_all(spark, sf_dir):
    return items(spark, sf_dir, V.lines_documents(spark, sf_dir))


def _composed(spark, sf_dir, line) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.lit(1).cast("bigint").alias("line_number"), line.alias("line")
    )


@query
def extract_hashes(spark, sf_dir):
    """MD5 and SHA-256 of every document inside a line, beside one that is a digit too long."""
    text = F.col("text")
    line = F.concat(
        F.lit("md5="), F.md5(text.cast("binary")), F.lit(" sha256="), F.upper(F.sha2(text, 256)),
        F.lit(" bad="), F.md5(text.cast("binary")), F.lit("0"),
    )
    return items(spark, sf_dir, _composed(spark, sf_dir, line), P.MD5_TYPE, P.SHA256_TYPE)


@query
def extract_wallets(spark, sf_dir):
    """Wallet addresses made of each document's hash."""
    digest = F.sha2("text", 256)
    base58 = F.translate(F.left(digest, F.lit(30)), "0", "z")
    bech32 = F.translate(F.left(digest, F.lit(39)), "1b", "zy")
    line = F.concat(
        F.lit("1"), base58, F.lit(" bc1"), bech32, F.lit(" 0x"), F.left(digest, F.lit(40)),
        F.lit(" 2"), base58, F.lit(" 0x"), F.left(digest, F.lit(41)),
    )
    return items(spark, sf_dir, _composed(spark, sf_dir, line), P.BITCOIN_TYPE, P.ETHEREUM_TYPE)


@query
def extract_ipv6_prefixed(spark, sf_dir):
    """Addresses behind and before words that a colon joins to them."""
    digest = F.md5(F.col("text").cast("binary"))
    groups = [F.substring(digest, 4 * i + 1, 4) for i in range(8)]
    full = F.concat_ws(":", *groups)
    line = F.concat(
        F.lit("src:"), full, F.lit(" addr:"), groups[0], F.lit("::"), groups[1], F.lit(", x:::"), groups[2],
        F.lit(" "), full, F.lit(":port std::cout at:12:30"),
    )
    return items(spark, sf_dir, _composed(spark, sf_dir, line), P.IPV6_TYPE).select("path", "match_type", "matched_text")


@query
def extract_domain_underscore(spark, sf_dir):
    host = V.hosts(spark, sf_dir).select(
        F.col("page_id").cast("string").alias("path"), F.lit(1).cast("bigint").alias("line_number"),
        F.concat(F.lit("to _x_"), F.col("page_id"), F.lit("."), F.col("host"), F.lit(". or "), F.col("host"), F.lit("_no")).alias("line"),
    )
    return items(spark, sf_dir, host, P.DOMAIN_TYPE).select("path", "match_type", "matched_text")


@query
def extract_long_runs(spark, sf_dir):
    """Runs with too many labels or too long a first part beside good ones."""
    doc = F.col("doc_id").cast("string")
    line = F.concat(
        F.repeat(F.lit("a."), 140), F.lit("com "), F.repeat(F.lit("l"), 70), F.lit("@x.com ok"), doc, F.lit(".com b"), doc, F.lit("@y.org."),
    )
    return items(spark, sf_dir, _composed(spark, sf_dir, line), P.DOMAIN_TYPE, P.EMAIL_TYPE).select("path", "match_type", "matched_text")


def _dotted():
    return F.concat_ws(".", F.lit("10"), F.col("doc_id") % 256, F.col("n_chars") % 256, F.lit("7"))


@query
def extract_ipv6(spark, sf_dir):
    """Full, shortened, dotted and wrong IPv6 addresses made of each document's hash."""
    digest = F.md5(F.col("text").cast("binary"))
    groups = [F.substring(digest, 4 * i + 1, 4) for i in range(8)]
    full = F.concat_ws(":", *groups)
    line = F.concat_ws(
        " ",
        F.lit("from"), full,
        F.concat(F.lit("["), groups[0], F.lit("::"), groups[1], F.lit("]:443")),
        F.concat(F.lit("::ffff:"), _dotted()),
        F.concat(full, F.lit(":"), groups[0]),
        F.concat(F.lit("at 12:30:"), F.substring(digest, 1, 2)),
    )
    return items(spark, sf_dir, _composed(spark, sf_dir, line), P.IPV6_TYPE)


@query
def ip_bits(spark, sf_dir):
    return (
        V.addresses(spark, sf_dir)
        .distinct()
        .select(F.col("query").alias("address"), S.ip_family(F.col("query")).alias("family"), S.ip_bits(F.col("query")).alias("bits"))
    )


# -- feeds ---------------------------------------------------------------------


@query
def feed_load(spark, sf_dir):
    return V.indicators(spark, sf_dir, "derived_ip", "derived_text", "derived_globs").select(
        "feed_id", "pattern_id", "entry", "kind", "match_key", known(F.col("family")).alias("family"),
        known(F.col("prefix_len")).alias("prefix_len"), "net_bits", "data"
    )


@query
def glob_regex(spark, sf_dir):
    return V.indicators(spark, sf_dir, "derived_globs").select("entry", "glob_re", "suffix_key")


@query
def feed_counts(spark, sf_dir):
    return I.feed_counts(V.indicators(spark, sf_dir, "net", "derived_ip", "derived_text", "derived_globs"))


@query
def remove_feeds(spark, sf_dir):
    """Feeds left after one is unloaded and another added."""
    loaded = V.indicators(spark, sf_dir, "derived_ip", "derived_text")
    gone = V.constant(spark, "feed_id", ["derived_ip"])
    return I.add_feeds(I.remove_feeds(loaded, gone), V.indicators(spark, sf_dir, "derived_globs")).select(
        "feed_id", "entry", "pattern_id"
    )


# -- lookups and scans ---------------------------------------------------------


def host_queries(spark, sf_dir):
    return V.hosts(spark, sf_dir).select(F.col("host").alias("query"))


def text_queries(spark, sf_dir):
    found = extract(V.lines_documents(spark, sf_dir), V.tlds(spark), [P.SHA1_TYPE, P.EMAIL_TYPE])
    upper = host_queries(spark, sf_dir).select(F.upper("query").alias("query"))
    return found.select(F.col("matched_text").alias("query")).unionByName(upper)


def all_queries(spark, sf_dir):
    blank = V.table(spark, sf_dir, "pages").select(F.lit("").alias("query"))
    return V.addresses(spark, sf_dir).unionByName(text_queries(spark, sf_dir)).unionByName(host_queries(spark, sf_dir)).unionByName(blank)


@query
def lookup_literal(spark, sf_dir):
    return shown(lookup(text_queries(spark, sf_dir), feed(spark, sf_dir, "derived_text")))


@query
def lookup_cidr(spark, sf_dir):
    return shown(lookup(V.addresses(spark, sf_dir), feed(spark, sf_dir, "net")))


@query
def lookup_glob(spark, sf_dir):
    return shown(lookup(host_queries(spark, sf_dir), feed(spark, sf_dir, "globs", "globs_cs", "derived_globs")))


@query
def lookup_multi_feed(spark, sf_dir):
    everything = feed(spark, sf_dir, "net", "derived_ip", "derived_text", "globs", "globs_cs")
    return shown(lookup(all_queries(spark, sf_dir), everything))


@query
def scan_documents(spark, sf_dir):
    everything = feed(spark, sf_dir, "net", "derived_ip", "derived_text", "globs")
    hits = scan(V.lines_documents(spark, sf_dir), everything, V.tlds(spark), keep=["path", "line_number", "pos"])
    return shown(hits, "path", "line_number", "pos")


@query
def scan_conn(spark, sf_dir):
    hits = scan(
        V.lines_conn(spark, sf_dir), feed(spark, sf_dir, "net"), V.tlds(spark), include_line=True, hit_time=F.col("event_ts")
    )
    return shown(hits, S.rfc3339(F.col("timestamp")).alias("hit_time"), "log_line")


@query
def scan_pages(spark, sf_dir):
    return shown(scan(V.lines_pages(spark, sf_dir), feed(spark, sf_dir, "globs", "derived_globs"), V.tlds(spark)))


@query
def scan_brand_globs(spark, sf_dir):
    """A glob ``*<name>*.<tld>`` for every name met, against every host."""
    label = lambda n: F.substring_index(F.substring_index("host", ".", n), ".", 1)
    named = V.hosts(spark, sf_dir).where(F.length(label(-3)) > 2)
    entries = named.select(
        F.lit("brands").alias("feed_id"), F.lit(P.CASE_SENSITIVE).alias("mode"),
        F.concat(F.lit("*"), label(-3), F.lit("*."), F.substring_index("host", ".", -1)).alias("entry"), F.lit(None).cast("string").alias("data"),
    ).distinct()
    hits = lookup(host_queries(spark, sf_dir), stage(indicators_from(entries)))
    return hits.select("matched_text", F.array_join("matched_indicators", ", ").alias("indicators"))


@query
def scan_two_monitors(spark, sf_dir):
    """Two monitors read the same page addresses: each gets its own hits."""
    lines = V.lines_pages(spark, sf_dir)
    both = lines.withColumn("monitor_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return shown(scan(both, feed(spark, sf_dir, "globs", "derived_text"), V.tlds(spark), keep=["monitor_id"]), "monitor_id")


@query
def scan_html(spark, sf_dir):
    """Hits in the lines of every raw page."""
    html = V.table(spark, sf_dir, "pages").select(
        F.lit("html").alias("monitor_id"), F.lit("html").alias("source"), F.col("page_id").cast("string").alias("path"), "html"
    )
    hits = scan(L.split_lines(html, "html"), feed(spark, sf_dir, "derived_text"), V.tlds(spark), keep=["path", "line_number", "pos"])
    return shown(hits, "path", "line_number", "pos")


@query
def scan_logs_stream(spark, sf_dir):
    """Hits stored by a stream that reads the log files of all sources, in three batches of a restartable query."""
    logs, root = V.log_files(spark, sf_dir), f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    publish_feed(feed(spark, sf_dir, "derived_text"), current_feeds(spark, root), "text", "1", root)
    stream = read_log_stream(spark, f"{logs}/source=*", "m", max_files=7)
    running = scan_stream(
        stream, lambda: current_indicators(spark, root), V.tlds(spark), f"{root}/out", f"{root}/state", {"availableNow": True}
    )
    running.awaitTermination()
    return stored_hits(spark, f"{root}/out").select(
        "matched_text", "match_type", "database_id", F.array_join("matched_indicators", ", ").alias("indicators"), F.array_join("data", ", ").alias("payload")
    )


@query
def tail_stream(spark, sf_dir):
    """Hits of a query over growing logs that is stopped, gets more files and a second feed, and goes on."""
    register_tail(spark)
    root = f"{shared_folder(spark).rstrip('/')}/tail-{uuid.uuid4().hex}"
    docs = V.table(spark, sf_dir, "documents")
    feeds = current_feeds(spark, root)
    for part, name in enumerate(("text", "ip")):
        docs.where(F.col("doc_id") % 2 == part).select("text").coalesce(4).write.mode("append").text(f"{root}/logs")
        feeds = publish_feed(feed(spark, sf_dir, f"derived_{name}"), feeds, name, "1", root, auto_updated=False)
        lines = (
            spark.readStream.format("tail").option("path", f"{root}/logs").option("pathGlobFilter", "*.txt").option("startingPosition", "earliest")
            .option("monitorId", "m").option("positionLog", f"{root}/positions").load()
        )
        scan_stream(lines, lambda: current_indicators(spark, root), V.tlds(spark), f"{root}/out", f"{root}/state", {"availableNow": True}).awaitTermination()
    return stored_hits(spark, f"{root}/out").select(
        "matched_text", "match_type", "database_id", F.array_join("matched_indicators", ", ").alias("indicators"), F.array_join("data", ", ").alias("payload")
    )


@query
def counters_over_midnight(spark, sf_dir):
    """Running counters of five stored batches, the later documents' hits on the next day."""
    folder = f"{shared_folder(spark).rstrip('/')}/counted-{uuid.uuid4().hex}"
    lines = V.lines_documents(spark, sf_dir).withColumn("event_ts", F.col("event_ts") + F.make_dt_interval(secs=F.lit(86_000)))
    found = stage(extract(lines, V.tlds(spark)).drop("line"))
    hits = stage(
        match_candidates(found, feed(spark, sf_dir, "derived_ip", "derived_text"), hit_time=F.col("event_ts"), keep=["monitor_id", "path"])
    )
    for batch in range(5):
        part = F.col("path").cast("long") % 5 == batch
        counts = C.monitor_counts(lines.where(part), found.where(part), hits.where(part)).withColumn("run_id", F.lit("r"))
        counts.write.parquet(f"{folder}/counters/stream=s/batch_id={batch}")
    return running_counters(spark, folder)


@query
def publish_unload(spark, sf_dir):
    """The store after a publish, the unloading of the only feed and another publish."""
    root = f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    first = publish_feed(feed(spark, sf_dir, "derived_text"), current_feeds(spark, root), "derived_text", "1", root)
    save_feeds(unload_feeds(first, first.select("feed_id")), root)
    publish_feed(feed(spark, sf_dir, "derived_globs"), current_feeds(spark, root), "derived_globs", "1", root)
    return current_indicators(spark, root).select("feed_id", "pattern_id", "entry", "kind", "data")


@query
def feed_list(spark, sf_dir):
    """The list of loaded feeds with size, description, build date and counts."""
    loaded = feed(spark, sf_dir, "net", "derived_text", "derived_globs")
    rows = loaded.groupBy("feed_id").agg(F.sum(F.length("entry")).alias("size_bytes"), F.min("mode").alias("mode"))
    feeds = rows.select(
        "feed_id", F.concat(F.lit("/feeds/"), "feed_id").alias("path"), "size_bytes", "mode",
        F.create_map(F.lit("de"), F.lit("Liste"), F.lit("en"), F.concat(F.lit("Feed "), "feed_id")).alias("description"),
        (F.lit(1_700_000_000) + F.col("size_bytes")).alias("build_epoch"), (F.col("feed_id") == "net").alias("is_auto_updated"),
    )
    return C.feed_summary(feeds, loaded)


@query
def feed_file(spark, sf_dir):
    """A feed file of every page's host, read back; pattern numbers are unique and gapless."""
    path = f"{shared_folder(spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
    V.hosts(spark, sf_dir).select(F.col("host").alias("entry"), F.col("page_id").cast("string").alias("page")).write.option("header", True).csv(path)
    loaded = load_feed(spark, path, "hosts", "CaseInsensitive")
    last = F.max("pattern_id").over(Window.partitionBy("feed_id"))
    return loaded.select("feed_id", "entry", "kind", "match_key", "data", (last + 1).alias("entries"))


@query
def manifest_file(spark, sf_dir):
    """A manifest file per document, written as JSON and read back."""
    path = f"{shared_folder(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"
    full = F.struct(F.concat(F.lit("https://f/"), "doc_id").alias("url"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size"))
    entry = F.struct(F.concat(F.lit("feed-"), "doc_id").alias("name"), F.col("lang").alias("version"), F.lit(1).alias("format_version"), full.alias("full"))
    docs = V.table(spark, sf_dir, "documents").select(F.lit("stable").alias("channel"), F.array(entry, entry).alias("databases"), F.lit("2024").alias("generated_at"))
    docs.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    manifest = spark.read.schema(MANIFEST).json(path)
    return A.explode_manifest(manifest).select("channel", "name", "version", "url", "sha256", "size")


@query
def alerts(spark, sf_dir):
    found = feed(spark, sf_dir, "derived_ip", "derived_text")
    return H.alerts(scan(V.lines_documents(spark, sf_dir), found, V.tlds(spark)))


@query
def recent_hits(spark, sf_dir):
    """Newest 500 of three hit feeds, one of which arrives twice."""
    clock = {"hit_time": F.col("event_ts")}
    conn = stage(scan(V.lines_conn(spark, sf_dir), feed(spark, sf_dir, "net"), V.tlds(spark), **clock))
    docs = stage(scan(V.lines_documents(spark, sf_dir), feed(spark, sf_dir, "derived_ip", "derived_text"), V.tlds(spark), **clock))
    return shown(H.recent_hits(conn, docs, docs), S.rfc3339(F.col("timestamp")).alias("hit_time"))


# -- counters ------------------------------------------------------------------


@query
def monitor_stats(spark, sf_dir):
    lines = V.lines_documents(spark, sf_dir)
    found = stage(extract(lines, V.tlds(spark)).drop("line"))
    hits = match_candidates(
        found, feed(spark, sf_dir, "derived_ip", "derived_text"), hit_time=F.col("event_ts"), keep=["monitor_id"]
    )
    return C.monitor_stats(lines, found, hits)


@query
def feed_stats(spark, sf_dir):
    everything = feed(spark, sf_dir, "net", "derived_text", "globs", "globs_cs")
    asked = all_queries(spark, sf_dir)
    return C.feed_stats(asked, lookup(asked, everything), everything)


@query
def enabled_lines(spark, sf_dir):
    """Lines per monitor when every monitor whose name starts after ``e`` is off."""
    lines = V.lines_documents(spark, sf_dir)
    monitors = lines.select("monitor_id").distinct().withColumn("enabled", F.col("monitor_id") < "e")
    return C.enabled_lines(lines, monitors).groupBy("monitor_id", "source").agg(F.count(F.lit(1)).alias("lines"))


@query
def catalog_totals(spark, sf_dir):
    feeds = V.table(spark, sf_dir, "documents").select(F.col("source").alias("feed_id")).distinct()
    monitors = V.table(spark, sf_dir, "documents").select(F.col("lang").alias("monitor_id")).distinct()
    return C.totals(feeds, monitors)


@query
def manifest_read(spark, sf_dir):
    """A manifest file for each source, with a feed for each of its documents."""
    path = f"{shared_folder(spark).rstrip('/')}/manifests-{uuid.uuid4().hex}"
    full = F.struct(F.concat(F.lit("https://feeds/"), "doc_id").alias("url"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))
    each = F.struct(F.concat(F.lit("f"), "doc_id").alias("name"), F.col("lang").alias("version"), F.lit(1).alias("format_version"), full.alias("full"))
    rows = V.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("channel")).agg(F.collect_list(each).alias("databases"))
    rows.write.option("maxRecordsPerFile", 1).json(path)
    return A.read_manifest(spark, path).select("channel", "name", "version", "format_version", "url", "sha256", "size")


@query
def inventory_files(spark, sf_dir):
    """Size, hash and first bytes of each source's log file."""
    found = A.file_inventory(spark, V.log_files(spark, sf_dir), recursive=True)
    return V.lines_files(found)


@query
def catalog_file(spark, sf_dir):
    """A catalog of all documents, written in lists of 150 and read back."""
    path = f"{shared_folder(spark).rstrip('/')}/catalog-{uuid.uuid4().hex}"
    feeds = V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"),
        (F.col("doc_id") % 3 == 0).alias("is_auto_updated"),
        F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).alias("sha256"),
    )
    K.write_catalog(feeds, path, entries=150)
    return K.read_catalog(spark, path)


@query
def build_epochs(spark, sf_dir):
    """The build time of feed metadata: whole numbers count, negative ones, decimals and texts do not."""
    number = F.col("event_id").cast("string")
    text = (
        F.when(F.col("event_id") % 4 == 0, number)
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("-"), number))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('"'), number, F.lit('"')))
        .otherwise(F.concat(number, F.lit(".5")))
    )
    return V.table(spark, sf_dir, "events").select("event_id", known(S.build_epoch(F.parse_json(text))).alias("built"))


# -- catalog and updates -------------------------------------------------------


@query
def catalog_parse(spark, sf_dir):
    """A catalog text per document: new layout, old layout, no hash, or broken."""
    doc = F.col("doc_id")
    path = F.concat(F.lit("/feeds/"), "source", F.lit("/"), doc.cast("string"))
    entry = F.struct(path.alias("path"), (doc % 2 == 0).alias("is_auto_updated"), F.when(doc % 3 == 0, F.sha2("text", 256)).alias("sha256"))
    text = (
        F.when(doc % 5 == 0, F.to_json(F.array(path, F.concat(path, F.lit(".old")))))
        .when(doc % 7 == 0, F.concat(F.lit("["), F.to_json(entry)))
        .otherwise(F.to_json(F.array(entry)))
    )
    return K.parse_catalog(V.table(spark, sf_dir, "documents").select(text.alias("value")))


@query
def catalog_existing(spark, sf_dir):
    """Catalog of all documents against the files of the labelled ones."""
    catalog = V.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/feeds/"), F.col("doc_id").cast("string")).alias("path"), "source"
    )
    files = V.table(spark, sf_dir, "labels").select(F.concat(F.lit("/feeds/"), F.col("doc_id").cast("string")).alias("path"))
    kept, gone = K.split_existing(catalog, files)
    return kept.withColumn("state", F.lit("present")).unionByName(gone.withColumn("state", F.lit("missing")))


def _artifacts(spark, sf_dir):
    """Each document as a landed file, framed by its number; every eleventh did not land."""
    doc = F.col("doc_id")
    body = F.col("text").cast("binary")
    content = (
        F.when(doc % 6 == 0, F.concat(F.lit("<!DOCTYPE html>").cast("binary"), body))
        .when(doc % 6 == 1, F.substring(body, 1, 3))
        .when(doc % 6 == 2, body)
        .otherwise(F.concat(F.unhex(F.lit("28B52FFD")), body))
    )
    files = V.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("/landing/f-"), doc.cast("string")).alias("path"), content.alias("content")
    )
    facts = A.describe_files(files).join(files.select("path", "doc_id"), "path")
    manifest = facts.select(
        F.concat(F.lit("feed-"), doc.cast("string")).alias("name"),
        F.concat(F.lit("v"), (doc % 4).cast("string")).alias("version"),
        F.concat(F.lit("https://feeds.example.com/f-"), doc.cast("string")).alias("url"),
        F.when(doc % 6 == 3, F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"),
        (F.col("length") + F.when(doc % 6 == 4, 1).otherwise(0)).alias("size"),
    )
    return files.where(doc % 11 != 0).select("path", "content"), manifest


@query
def verify_artifacts(spark, sf_dir):
    files, manifest = _artifacts(spark, sf_dir)
    return A.verify_artifacts(A.describe_files(files), manifest).withColumn(
        "artifact", S.artifact_name(F.col("name"), F.col("version"))
    )


@query
def updates_available(spark, sf_dir):
    """Every document a feed of a manifest, every even one compared with the installed feed."""
    rows = V.table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 2 == 0, F.lit("threat-intel")).otherwise(F.lit("other")).alias("name"),
        F.col("doc_id").cast("string").alias("version"),
        F.sha2("text", 256).alias("sha256"),
    )
    installed = V.table(spark, sf_dir, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("feed_id"),
        (F.col("doc_id") % 5 == 4).alias("is_auto_updated"),
        F.sha2("text", 256).alias("sha256"),
    )
    return A.updates_available(rows, installed)


@query
def replace_feed(spark, sf_dir):
    """The catalog after a publish: auto-updated feeds leave, the new ones come in."""
    feeds = V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("feed_id"), (F.col("doc_id") % 4 == 0).alias("is_auto_updated"), F.sha2("text", 256).alias("sha256")
    )
    new = V.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("feed_id"), F.lit(True).alias("is_auto_updated"), F.sha2("text", 256).alias("sha256")
    )
    return replace_auto_updated(feeds, new)


# -- scalar functions ----------------------------------------------------------


@query
def format_size(spark, sf_dir):
    scaled = V.table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", F.explode(F.array(*[F.col("n_chars") * 1024**k for k in range(4)])).alias("bytes")
    )
    return scaled.select("doc_id", "bytes", S.format_size(F.col("bytes")).alias("size_human"))


@query
def format_build_date(spark, sf_dir):
    epoch = F.when(F.col("event_id") % 10 == 0, F.lit(10**14)).when(F.col("event_id") % 10 != 1, F.unix_seconds(F.col("ts").cast("timestamp")))
    return V.table(spark, sf_dir, "events").select("event_id", S.format_build_date(epoch).alias("built"))


@query
def format_hit_time(spark, sf_dir):
    ts = F.col("ts")
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, S.rfc3339(ts))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
        .when(kind == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'"))
        .otherwise(F.col("event_type"))
    )
    return V.table(spark, sf_dir, "events").select("event_id", S.format_hit_time(text).alias("shown"))


@query
def flatten_props(spark, sf_dir):
    return S.flatten_payload(V.table(spark, sf_dir, "events").select("event_id", "props"), "props").select(
        "event_id", "pos", "key", "value_text"
    )


@query
def flatten_nested(spark, sf_dir):
    """Payloads with nested arrays, an object, null, booleans and a number with decimals."""
    doc, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit('{"z": ['), doc, F.lit(', "a", null, {"k": 1}, [true, []]], "b": null, "a": "'), F.col("lang"), F.lit('"}')))
        .when(kind == 1, F.concat(F.lit('{"n": '), doc, F.lit('.50, "t": true, "o": {"x": 1}, "e": []}')))
        .when(kind == 2, F.concat(F.lit("["), doc, F.lit(",2]")))
        .otherwise(F.concat(F.lit("not json "), doc))
    )
    return S.flatten_payload(V.table(spark, sf_dir, "documents").select("doc_id", text.alias("payload")), "payload").select(
        "doc_id", "pos", "key", "value_text"
    )


@query
def flatten_deep(spark, sf_dir):
    """Arrays nested five to nine levels deep, one in fifty more than 900, with brackets inside strings."""
    doc, levels = F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 50 == 7, 990).otherwise(F.col("doc_id") % 5 + 5).cast("int")
    text = F.concat(F.lit('{"deep": '), F.repeat(F.lit('["[", '), levels), doc, F.repeat(F.lit("]"), levels), F.lit("}"))
    return S.flatten_payload(V.table(spark, sf_dir, "documents").select("doc_id", text.alias("payload")), "payload").select(
        "doc_id", "pos", "key", "value_text"
    )


@query
def sha256_docs(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", S.sha256_hex(F.col("text")).alias("sha256"))


@query
def source_labels(spark, sf_dir):
    """File names made of page addresses: base name, both labels and the name filter."""
    path = F.concat(F.regexp_replace("url", r"^[a-z]+:/|[?#].*$", ""), F.when(F.col("page_id") % 3 == 0, F.lit(".log.log")).otherwise(F.lit("")))
    return V.table(spark, sf_dir, "pages").select(
        "page_id",
        S.base_name(path).alias("name"),
        S.source_label(path).alias("label"),
        S.source_label(path, capture=True).alias("capture_label"),
        name_matches(path, "*.log").alias("is_log"),
    )
