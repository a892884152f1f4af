"""URL filtering by curated rules and by association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.runtime import durable, table

#: (verdict, host, path prefix)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
#: A rule's confidence is at least this many times the share of bad labels among all labelled URLs.
MIN_LIFT = 1.5
#: Labelled URLs that a frequent combination needs at least, however few there are.
MIN_ROWS = 25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "=block", "=allow"


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty if the URL is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def curated(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits as (size, rule, verdict), else null."""
    table_ = F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    fits = F.filter(table_, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"], r["rule"], r["verdict"])))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: the host's labels, their words, path words (digits as #), and parameter names."""
    labels = F.split(host, r"\.")
    words = F.regexp_replace(F.translate(path, UPPER, LOWER), "[0-9]+", "#")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    with_mark = lambda mark, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(
        F.concat(
            with_mark("h:", F.reverse(labels)),
            with_mark("w:", F.flatten(F.transform(labels, lambda x: F.split(x, "-")))),
            with_mark("p:", F.split(words, r"[/._~+-]+")),
            with_mark("q:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
        )
    )


def merged_tokens(labelled: DataFrame, support: float) -> tuple[DataFrame, DataFrame]:
    """``labelled`` with ``items``, and (item, members): frequent tokens that are in exactly the same URLs are one item.

    Tokens below the support can be in no rule. There are at most (tokens of a URL) / support others, so they are broadcast.
    """
    each = labelled.select("row", F.explode("tokens").alias("token"))
    mark = F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("mark")
    least = F.lit(support * labelled.count())
    tokens = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), mark).filter(F.col("n") >= least)
    items = durable(tokens.groupBy("n", "mark").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("members")))
    chosen = each.join(F.broadcast(items.select(F.col("item").alias("token"))), "token").groupBy("row").agg(F.collect_list("token").alias("items"))
    return labelled.join(chosen, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>"))), items.select("item", "members")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """(tokens, confidence, support, anchor) of the block rules; ``labelled``: tokens, blocked.

    All tokens are mined; those that are in the same labelled URLs are mined as one and all have to match. A rule's
    confidence has to exceed the share of blocked URLs by ``min_lift`` as well. A rule with more tokens than another it
    contains is kept only if its confidence is higher. The anchor is the rule's rarest token.
    """
    labelled = durable(labelled.select("tokens", "blocked", F.monotonically_increasing_id().alias("row")))
    rows, bad = labelled.agg(F.count(F.lit(1)), F.count_if("blocked")).first()
    support = min(1.0, max(min_support, MIN_ROWS / max(1, rows)))
    least = max(min_confidence, min_lift * bad / max(1, rows))
    merged, members = merged_tokens(labelled, support)
    items = durable(merged.select(F.concat("items", F.array(F.when(F.col("blocked"), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min(1.0, least)).fit(items)
    found = model.associationRules.filter(F.col("consequent")[0] == BLOCK).filter(~F.array_contains("antecedent", ALLOW)).filter(F.col("confidence") >= least)
    rules = found.select(F.sort_array("antecedent").alias("tokens"), "confidence", "support")
    wide = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    short = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("at_least"), F.col("tokens")[0].alias("token"))
    covered = (
        wide.join(short, "token")
        .filter((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("at_least") >= F.col("confidence")))
        .select("tokens")
        .distinct()
    )
    rules = rules.join(covered, "tokens", "left_anti")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = rules.select("tokens", F.explode("tokens").alias("token")).join(single, "token").groupBy("tokens").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))
    whole = rules.select("tokens", F.explode("tokens").alias("item")).join(members, "item").groupBy("tokens").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("all"))
    return rules.join(rarest, "tokens").join(whole, "tokens").select(F.col("all").alias("tokens"), "confidence", "support", "anchor")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages``.

    A curated rule decides where one fits (the longest). Elsewhere the verdict is block if a mined rule's tokens
    are all in the URL, else allow. Rules are mined on the URLs they decide on: those under no curated rule, with a row in
    ``labels`` for their id (blocked if toxic = 1 or quality = 0); distinct (URL, label) pairs count once. Where labels say
    nothing about URLs no rule has the confidence and lift, and all such URLs are allowed. A null URL or one without ``://`` has an empty host and path, matches no rule and is
    allowed; repeated rows are judged each; empty tables give no rows or no mined rules; other columns are ignored.
    """
    host, path = parse_url(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("hit", curated(F.col("host"), F.col("path"), rules))
    marks = labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad")).filter("bad is not null")
    marks = marks.groupBy("page_id").agg(F.max("bad").alias("bad"))
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    marked = parsed.filter("hit is null and host <> ''").join(marks, "page_id").select("url", "host", "path", F.col("bad").alias("blocked"))
    labelled = marked.distinct().select(tokens, "blocked")
    mined = mine_rules(labelled, min_support, min_confidence)
    open_urls = parsed.filter("hit is null and host <> ''").select("url", "host", "path").distinct().select("url", tokens)
    # inverted index: a rule is looked up by its rarest token only
    index = mined.select(F.col("anchor").alias("token"), F.col("tokens").alias("needed"))
    postings = open_urls.select("url", "tokens", F.explode("tokens").alias("token"))
    blocked = postings.join(index, "token").filter(F.size(F.array_except("needed", "tokens")) == 0).select(F.col("url").alias("bad_url")).distinct()
    judged = parsed.join(blocked, parsed["url"] == blocked["bad_url"], "left")
    method = F.when(F.col("bad_url").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


ORACLE: dict[str, str] = {}
