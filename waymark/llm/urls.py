"""URL filters: fixed host-and-path rules, and association rules mined from labelled pages.

Spark's FP-growth finds the combinations of URL tokens that go with a bad label; those that pass the support, confidence
and significance bounds are kept if each of their tokens raises the confidence, and if labelled pages that were held out
of the mining confirm them. A page is matched through an inverted index: each rule is listed under its rarest token, so a
URL's tokens meet only the rules found there.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules as (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: A rule holds this share of the pages at least, and MIN_PAGES bad pages, so that a few pages make no rule.
MIN_SUPPORT, MIN_PAGES = 0.002, 20
#: Its confidence takes away at least this share of what the base rate leaves open, and lies so many standard errors
#: (of a binomial count at the base rate) above it.
MIN_GAIN, MIN_Z = 0.5, 4.0
#: One labelled URL in so many is held out; on these a rule's bad pages lie so many standard errors above the base rate.
HELD, HELD_Z = 3, 1.645
BAD = "label=bad"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Empty strings for a null url or one without "://"."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, form, k), F.lit(""))
    return F.translate(part(1), UPPER, SMALL), part(2)


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL, marked by their part (h host, p path, q query); numbers are all "#"."""
    host, path = host_and_path(url)
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))

    def of(part: Column, mark: str) -> Column:
        words = F.filter(F.split(F.translate(part, UPPER, SMALL), "[^a-z0-9\x80-\U0010ffff]+"), lambda w: w != "")
        return F.transform(words, lambda w: F.concat(F.lit(mark), F.when(w.rlike("^[0-9]+$"), "#").otherwise(w)))

    return F.array_distinct(F.concat(of(host, "h:"), of(path, "p:"), of(query, "q:")))


def verdicts(rows: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """rows (page_id, url, ...) with host, path and best (size, rule, verdict): the longest fixed rule that fits, or null."""
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    if not rules:
        return rows.withColumn("best", F.lit(None).cast("struct<size:int,rule:string,verdict:string>"))
    given = F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    fits = lambda r: ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col("path"), r["path"])
    return rows.withColumn("best", F.array_max(F.filter(given, fits)))


def mine(known: DataFrame, min_support: float = MIN_SUPPORT, min_gain: float = MIN_GAIN, min_z: float = MIN_Z, min_pages: int = MIN_PAGES) -> DataFrame:
    """tokens (sorted array), rarest (of them), confidence, lift, pages and bad of the rules from url and bad (boolean).

    Of tokens that occur on exactly the same pages the first by name stands for all, as they would multiply every rule.
    A rule is kept if it is more confident than the same rule without any one of its tokens. Item sets and rules stay on
    the executors. No bad pages, or fewer than min_pages, give no rules.
    """
    spark, schema = known.sparkSession, "tokens array<string>, rarest string, confidence double, lift double, pages long, bad long"
    pages = stored(known.select(tokens(F.col("url")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad")).withColumn("id", F.monotonically_increasing_id()), "mined-pages")
    n, n_bad = pages.select(F.count("*"), F.count_if("bad")).first()
    if n_bad < min_pages:
        return spark.createDataFrame([], schema)
    least, base = max(min_support, min_pages / n), n_bad / n
    # At most (tokens of a URL) / min_support tokens are frequent, whatever the input.
    held = pages.select("id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("pages"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"))
    frequent = held.where(F.col("pages") >= least * n).groupBy("pages", "mark").agg(F.min("token").alias("token"))
    count = {r["token"]: r["pages"] for r in frequent.select("token", "pages").collect()}
    if not count:
        return spark.createDataFrame([], schema)
    items = F.concat(F.array_intersect("tokens", F.array(*map(F.lit, sorted(count)))), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array()))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=1.0).fit(pages.select(items.alias("items")))
    sets = stored(model.freqItemsets.select(F.sort_array(F.array_remove("items", BAD)).alias("tokens"), F.array_contains("items", BAD).alias("with_bad"), "freq"), "item-sets")
    both = sets.where("with_bad").select("tokens", F.col("freq").alias("bad")).join(sets.where(~F.col("with_bad")).select("tokens", F.col("freq").alias("pages")), "tokens")
    every = both.where(F.size("tokens") > 0).withColumn("confidence", F.col("bad") / F.col("pages"))
    spread = (n * base * (1 - base)) ** 0.5 if base < 1 else float("inf")
    z = (F.col("bad") - F.col("pages") * base) / (F.sqrt(F.col("pages") / float(n)) * spread)
    rules = every.where((F.col("confidence") >= base + min_gain * (1 - base)) & (z >= min_z))
    # The rule without one of its tokens; every such rule with a bad page is among the frequent sets.
    shorter = rules.select("tokens", "confidence", F.explode("tokens").alias("without")).select("tokens", "confidence", F.array_remove("tokens", F.col("without")).alias("rest")).where(F.size("rest") > 0)
    idle = shorter.join(every.select(F.col("tokens").alias("rest"), F.col("confidence").alias("other")), "rest").where("other >= confidence").select("tokens").distinct()
    rarest = F.array_min(F.transform("tokens", lambda t: F.struct(F.try_element_at(F.create_map(*[F.lit(x) for p in sorted(count.items()) for x in p]), t).alias("n"), t.alias("t"))))["t"]
    return rules.join(idle, "tokens", "left_anti").select("tokens", rarest.alias("rarest"), "confidence", (F.col("confidence") / base).alias("lift"), F.col("pages").cast("long").alias("pages"), F.col("bad").cast("long").alias("bad"))


def _hits(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """row and tokens: which rules the url of each row (row, url) holds all tokens of, through each rule's rarest."""
    asked = rows.select("row", tokens(F.col("url")).alias("own")).withColumn("rarest", F.explode("own"))
    return asked.join(rules.select("rarest", "tokens"), "rarest").where(F.size(F.array_except("tokens", "own")) == 0).select("row", "tokens")


def confirm(rules: DataFrame, held: DataFrame, min_z: float = HELD_Z) -> DataFrame:
    """rules with held_pages and held_bad, their pages among the held-out ones (url, bad), where these are worse than all
    held-out pages by min_z standard errors."""
    pages = stored(held.select("url", F.coalesce("bad", F.lit(False)).alias("bad")).withColumn("row", F.monotonically_increasing_id()), "held-pages")
    n, n_bad = pages.select(F.count("*"), F.count_if("bad")).first()
    base = n_bad / n if n else 0.0
    found = _hits(pages, rules).join(pages.select("row", "bad"), "row").groupBy("tokens").agg(F.count("*").alias("held_pages"), F.count_if("bad").alias("held_bad"))
    enough = F.col("held_bad") - F.col("held_pages") * base >= min_z * F.sqrt(F.col("held_pages") * base * (1 - base))
    return rules.join(found.where(enough & (F.col("held_bad") > F.col("held_pages") * base)), "tokens")


def matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (with url) and mined: whether the tokens of the url hold all tokens of a rule (tokens, rarest)."""
    if rules.isEmpty():
        return rows.withColumn("mined", F.lit(False))
    named = stored(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
    hit = _hits(named, rules).select("row").distinct().withColumn("mined", F.lit(True))
    return named.join(hit, "row", "left").withColumn("mined", F.coalesce("mined", F.lit(False))).drop("row")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, bad and held of each labelled page (doc_id = page_id): bad are those of quality 0 and the toxic ones, held is
    a hash of the URL, so that equal URLs are not on both sides. Several labels of a page count each on their own."""
    rows = pages.select("page_id", "url").join(labels.select(F.col("doc_id").alias("page_id"), "quality", "toxic"), "page_id")
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.col("quality") == 0, F.col("toxic") == 1)
    return rows.select("url", bad.alias("bad"), (F.pmod(F.xxhash64("url"), F.lit(HELD)) == 0).alias("held")).where("bad IS NOT NULL")


def label_rules(pages: DataFrame, labels: DataFrame, **thresholds: float) -> DataFrame:
    """The stored rules that the labels give and that held-out labels confirm; see mine and confirm."""
    known = stored(labelled(pages, labels), "labelled-pages")
    rules = stored(mine(known.where("NOT held"), **thresholds), "rules")
    return rules.selectExpr("*", "0L AS held_pages", "0L AS held_bad") if rules.isEmpty() else stored(confirm(rules, known.where("held")), "confirmed")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, **thresholds: float) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (whether an association rule matches) for every row of pages.

    A fixed rule fits its host and all subdomains if the path starts with the rule's; of several the longest decides.
    Without one, pages that an association rule matches are blocked and all others allowed. Association rules come from
    the labels alone, see label_rules; where no combination of tokens is significantly worse than the base rate there are
    none, and all these pages are allowed. Pages without label are no evidence. Null and repeated rows give a row each;
    empty tables mine no rules. Other columns are not read.
    """
    rows = matches(verdicts(pages.select("page_id", "url"), rules), label_rules(pages, labels, **thresholds))
    verdict = F.coalesce("best.verdict", F.when(F.col("mined"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "mined")
