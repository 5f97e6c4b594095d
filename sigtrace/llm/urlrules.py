"""URL filter: fixed host and path rules first, mined association rules for the rest.

URLs that a fixed rule judges are the labelled ones.  FP-growth mines combinations of
their tokens (host labels, path segments, query keys) together with the verdict; rules
below the support and confidence limits, and rules that say no more than a shorter one,
are dropped.  An inverted index from token to rule finds the rules of a URL: a rule
fires when as many of its tokens are met as it has.

Mining reads every distinct labelled URL once, so that copies do not weigh more.  Tokens that stand in the same
URLs are one class, mined as one item, so that a URL of thousands of tokens of its own adds one
item and not all their combinations.  A class that only URLs of one verdict have is a rule by itself, which
no combination with it can surpass.  FP-growth's work doubles with every class of a URL, so it mines the combinations of
those classes that are among the ``BASKET`` most frequent of every URL they stand in.  All combinations with any other
class are grown one class at a time, and only from those that are frequent, have both verdicts
and stand in fewer URLs than their parts: whatever is added to another gives no rule or one that a
shorter rule replaces.  Both together are all rules, of any number of tokens.  Their number, and with it the
work, can still grow with the power of the classes where hardly any two URLs of one verdict are alike.

Null URLs and URLs without ``://`` have empty host and path and no tokens;
they are allowed, as is every URL for which no rule fires.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigtrace.operators.sizing import broadcast_if_small
from sigtrace.operators.staging import stage

from .rows import only

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Limits of a rule: share of the distinct labelled URLs that have it and its verdict, share of those that have it with the verdict.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.8
#: Token classes of one URL that FP-growth combines (its sets grow with the power of these); the others are combined by ``grown``.
BASKET = 12
#: Distinct URLs in expectation of the share that ``drawn`` takes; mining does not use it.
SAMPLE = 200_000
VERDICT = "verdict="


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path."""
    rows = only(pages, "page_id", "url")
    part = lambda i: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return rows.select("page_id", "url", F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))


def fixed(rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fixed rule that fits, as struct of rule and verdict, or null."""
    host, path = F.col("host"), F.col("path")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # the longest is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens() -> Column:
    """Distinct host labels, path segments (numbers as ``#``) and query keys, each marked by its kind."""
    marked = lambda kind, parts: F.transform(
        F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(kind), F.regexp_replace(p, r"[0-9]+", "#"))
    )
    query = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    return F.array_sort(
        F.array_distinct(
            F.concat(marked("host:", F.split("host", r"\.")), marked("path:", F.split("path", "/")), marked("query:", keys))
        )
    )


def distinct_urls(labelled: DataFrame) -> DataFrame:
    """(key, draw, tokens, verdict) of distinct URLs (url, tokens, verdict); written."""
    distinct = labelled.groupBy("url").agg(F.first("tokens").alias("tokens"), F.first("verdict").alias("verdict"))
    return stage(distinct.select(F.xxhash64("url", F.lit(5)).alias("key"), F.pmod(F.xxhash64("url", F.lit(3)), F.lit(1 << 30)).alias("draw"), "tokens", "verdict"))


def drawn(labelled: DataFrame) -> DataFrame:
    """(key, tokens, verdict) of distinct URLs (url, tokens, verdict), all or a share chosen by hash, for a look at large tables."""
    rows = distinct_urls(labelled)
    share = min(1.0, SAMPLE / max(1, rows.count()))
    return rows.where(F.col("draw") < F.lit(share * (1 << 30))).drop("draw")


def token_classes(urls: DataFrame, least: int) -> DataFrame:
    """(token, class, n, sole): tokens of at least ``least`` URLs, with the name of the class of all that stand in the same URLs.

    Sets of URLs are told apart by their number and two sums over the URLs' hashes.  ``sole`` is the verdict
    where all these URLs have the same.
    """
    one = F.min("verdict") == F.max("verdict")
    marks = urls.select("key", "verdict", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("key").cast("decimal(20,0)")).alias("total"),
        F.bit_xor("key").alias("mixed"),
        F.when(one, F.min("verdict")).alias("sole"),
    )
    same = Window.partitionBy("n", "total", "mixed")
    return marks.where(F.col("n") >= least).select("token", F.min("token").over(same).alias("class"), "n", "sole")


def mine(labelled: DataFrame) -> DataFrame:
    """(id, tokens, verdict, confidence, support) of rules from URLs (url, tokens, verdict)."""
    urls = distinct_urls(labelled).drop("draw")
    total = urls.count()
    least = max(1, math.ceil(MIN_SUPPORT * total))
    members = stage(token_classes(urls, least))
    lone = members.where("sole is not null").select("class", "sole", "n").distinct()
    rules = lone.select(F.array("class").alias("classes"), F.col("sole").alias("verdict"), F.lit(1.0).alias("confidence"), (F.col("n") / total).alias("support"))
    combined = broadcast_if_small(members.where("sole is null").drop("sole"))
    found = urls.select("key", "verdict", F.explode_outer("tokens").alias("token")).join(combined, "token", "left")
    ranked = F.sort_array(F.collect_set(F.when(F.col("class").isNotNull(), F.struct((-F.col("n")).alias("n"), "class"))))
    baskets = stage(found.groupBy("key", "verdict").agg(ranked.alias("classes")))
    beyond = F.explode(F.slice("classes", BASKET + 1, 2**31 - 1)["class"]).alias("class")
    rest = stage(baskets.where(F.size("classes") > BASKET).select(beyond).distinct())
    if rest.isEmpty():
        rules = rules.unionByName(fp_rules(baskets.select("verdict", F.col("classes")["class"].alias("classes"))))
    else:
        marked = rest.select("class", F.lit(False).alias("head"))
        each = baskets.select("key", "verdict", F.explode_outer("classes").alias("item")).select("key", "verdict", (-F.col("item.n")).alias("n"), "item.class")
        each = each.join(broadcast_if_small(marked), "class", "left").withColumn("head", F.coalesce("head", F.lit(True)))
        item = F.when(F.col("class").isNotNull(), F.struct("head", "n", "class"))
        items = stage(each.groupBy("key", "verdict").agg(F.sort_array(F.collect_list(item)).alias("items")))
        heads = F.transform(F.filter("items", lambda i: i["head"]), lambda i: i["class"])
        rules = rules.unionByName(fp_rules(items.select("verdict", heads.alias("classes"))))
        rules = rules.unionByName(grown(items.where(F.exists("items", lambda i: ~i["head"])), least, total))
    short = stage(pruned(stage(rules)))
    named = short.select("id", "verdict", "confidence", "support", F.explode("classes").alias("class")).join(members.select("token", "class"), "class")
    return named.groupBy("id", "verdict", "confidence", "support").agg(F.sort_array(F.collect_list("token")).alias("tokens"))


def fp_rules(baskets: DataFrame) -> DataFrame:
    """Rules (classes, verdict, confidence, support) of all sets of the classes of URLs (verdict, classes)."""
    items = stage(baskets.select(F.array_append("classes", F.concat(F.lit(VERDICT), "verdict")).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=MIN_SUPPORT, minConfidence=MIN_CONFIDENCE).fit(items)
    return model.associationRules.where(F.col("consequent")[0].startswith(VERDICT)).select(
        F.array_sort("antecedent").alias("classes"),
        F.substring_index(F.col("consequent")[0], "=", -1).alias("verdict"),
        "confidence",
        "support",
    )


def grown(baskets: DataFrame, least: int, total: int) -> DataFrame:
    """Rules (classes, verdict, confidence, support) of sets that hold a class outside the head.

    ``baskets`` (key, verdict, items) are URLs with such a class, items being sorted structs of head, n, class; URLs
    that are alike in these are counted as one with a weight.  A set is written in the order of the structs, so that
    its first class is outside the head, as ``prefix`` and last ``item``.  Two sets of a URL that differ in the last item
    are joined to one; ``bound`` is the smaller of their numbers of URLs.
    """
    none = F.array().cast("array<string>")
    alike = baskets.groupBy("items", "verdict").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight"))
    rows = alike.select(none.alias("prefix"), "key", "weight", "verdict", F.explode("items").alias("item"), F.lit(None).cast("long").alias("bound"))
    opens = ~F.col("item.head")  # what a rule of one class and the first class of a set must be
    out = []
    while True:
        rows = stage(rows)
        hits = rows.groupBy("prefix", "item", "bound", "verdict").agg(F.sum("weight").alias("hits"))
        told = F.collect_list(F.struct("verdict", "hits")).alias("told")
        sets = stage(hits.groupBy("prefix", "item", "bound").agg(F.sum("hits").alias("n"), F.max("hits").alias("most"), told))
        each = sets.where(opens | (F.size("prefix") > 0)).select(
            F.array_sort(F.array_append("prefix", F.col("item.class"))).alias("classes"), "n", F.inline("told")
        )
        out.append(
            each.select("classes", "verdict", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / total).alias("support"), "hits")
            .where((F.col("hits") >= least) & (F.col("confidence") >= MIN_CONFIDENCE)).drop("hits")
        )
        fewer = F.col("bound").isNull() | (F.col("n") < F.col("bound"))
        live = stage(sets.where((F.col("most") >= least) & (F.col("most") < F.col("n")) & fewer).select("prefix", "item", "n"))
        if live.isEmpty():
            break
        lasts = F.sort_array(F.collect_list(F.struct("item", "n"))).alias("lasts")
        grouped = rows.drop("bound").join(live, ["prefix", "item"]).groupBy("prefix", "key", "weight", "verdict").agg(lasts)
        pairs = grouped.select("prefix", "key", "weight", "verdict", "lasts", F.posexplode("lasts").alias("at", "x"))
        pairs = pairs.where((~F.col("x.item.head")) | (F.size("prefix") > 0))
        pairs = pairs.select("prefix", "key", "weight", "verdict", "x", F.explode(F.slice("lasts", F.col("at") + 2, F.size("lasts"))).alias("y"))
        rows = pairs.select(
            F.array_append("prefix", F.col("x.item.class")).alias("prefix"), "key", "weight", "verdict", F.col("y.item").alias("item"), F.least("x.n", "y.n").alias("bound")
        )
    return reduce(DataFrame.unionByName, out)


def pruned(rules: DataFrame) -> DataFrame:
    """Rules (classes, verdict, confidence, support) without those of which a shorter one with the same verdict is as confident."""
    named = rules.withColumn("id", F.xxhash64("classes", "verdict"))
    # each set of the classes of a rule of at most BASKET is looked up
    grow = lambda sets, c: F.concat(sets, F.transform(sets, lambda s: F.array_append(s, c)))
    parts = F.aggregate("classes", F.array(F.array().cast("array<string>")), grow)
    parts = F.filter(parts, lambda p: (F.size(p) > 0) & (F.size(p) < F.size("classes")))
    shorter = rules.select(F.col("classes").alias("part"), "verdict", F.col("confidence").alias("known"))
    few = F.size("classes") <= BASKET
    beaten = (
        named.where(few).select("id", "verdict", "confidence", F.explode(parts).alias("part"))
        .join(shorter, ["part", "verdict"])
        .where("known >= confidence")
        .select("id")
        .distinct()
    )
    left = named.join(beaten, "id", "left_anti")
    if named.where(~few).isEmpty():
        return left
    # longer ones have too many sets: they are met by the first class of each rule that is left
    left = stage(left)
    long = left.where(~few).select("id", "verdict", "confidence", "classes", F.explode("classes").alias("first"))
    shorter = left.select(F.col("classes").alias("part"), F.col("classes")[0].alias("first"), "verdict", F.col("confidence").alias("known"))
    inside = (F.size("part") < F.size("classes")) & (F.size(F.array_except("part", "classes")) == 0)
    return left.join(long.join(shorter, ["first", "verdict"]).where(inside & F.expr("known >= confidence")).select("id").distinct(), "id", "left_anti")


def judge(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict) of distinct token sets for which a rule fires: the most confident, then best supported, then block."""
    index = broadcast_if_small(
        rules.select("id", "verdict", "confidence", "support", F.size("tokens").alias("needed"), F.explode("tokens").alias("token"))
    )
    postings = token_sets.select(F.xxhash64("tokens").alias("set"), "tokens", F.explode("tokens").alias("token"))
    met = (
        postings.select("set", "token").join(index, "token")
        .groupBy("set", "id", "verdict", "confidence", "support", "needed").count().where("count = needed")
    )
    best = met.groupBy("set").agg(F.max(F.struct("confidence", "support", F.col("verdict").alias("verdict"))).alias("best"))
    return token_sets.withColumn("set", F.xxhash64("tokens")).join(best, "set").select("tokens", "best.verdict")


def classify(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url)."""
    parts = stage(with_parts(pages).withColumn("fixed", fixed(rules)).withColumn("tokens", tokens()))
    labelled = parts.where("fixed is not null").select("url", "tokens", "fixed.verdict")
    mined = stage(mine(labelled))
    open_sets = parts.where("fixed is null and size(tokens) > 0").select("tokens").distinct()
    verdicts = judge(open_sets, mined).withColumnRenamed("verdict", "mined")
    columns = ["page_id", "host", "path", F.col("fixed.rule").alias("rule")]
    # fixed verdicts need no join, which keeps their hosts out of it
    decided = parts.where("fixed is not null").select(*columns, F.col("fixed.verdict").alias("verdict"))
    others = parts.where("fixed is null").join(verdicts, "tokens", "left")
    return decided.union(others.select(*columns, F.coalesce("mined", F.lit("allow")).alias("verdict")))
