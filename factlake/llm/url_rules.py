"""URL filters: curated host and path rules first, association rules for the rest.

FP-growth mines combinations of URL tokens (host labels, path segments, query keys, scheme) that labelled URLs share with the label
block; tokens that all of them have are left out, for they can't tell. Rules below a support or a confidence are pruned, and those that chance explains: so many
combinations are tried that one of them would be as sure, at the share of blocked URLs in all, with probability ``CHANCE`` or more (by Chernoff's
bound). So are rules of which any subset blocks as surely. An URL is blocked if all tokens of a rule are among its own; rules are found by an
inverted index from their rarest token, joined with the tokens of the distinct URLs.

Curated rules are (host, path, verdict). One fits its host and all subdomains, if the URL's path starts with the rule's; of those that fit
the longest (host and path together, then host) wins. A few are compiled into one expression; more are joined by host, with the distinct
host and path pairs.

Defined results: a null URL, or one without ``://``, has empty host and path and no tokens: no rule fits, it is allowed; repeated
rows get equal verdicts; labels with a null don't count; without labels nothing is mined and the rest is allowed.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import cut, free_name

MIN_SUPPORT = 0.002
MIN_COUNT = 5
MIN_CONFIDENCE = 0.6
BLOCK = "=block"
#: Rows of about 200 bytes that may be broadcast.
BROADCAST_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The probability that any of the rules that are kept is a product of chance.
CHANCE = 0.05
#: Curated rules that are compiled into one expression; more are joined.
COMPILED = 200
Curated = tuple[str, str, str]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens: digits are one token whatever they are."""
    hosts = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    paths = F.transform(F.filter(F.split(path_of(url), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(F.lower(x), "[0-9]+", "#")))
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("s:"), F.lower(F.substring_index(url, "://", 1))))
    found = F.array_distinct(F.concat(hosts, paths, keys, scheme))
    return F.when(F.instr(url, "://") > 0, found).otherwise(F.array().cast("array<string>"))


def curated_rule(host: Column, path: Column, rules: list[Curated], field: str) -> Column:
    """The text or the verdict of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for own, prefix, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):  # the last is asked first
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        out = F.when(fits, F.lit(own + prefix if field == "rule" else verdict)).otherwise(out)
    return out


def curated_join(pages: DataFrame, host: str, path: str, rules: list[Curated]) -> DataFrame:
    """(host, path, rule, verdict) of the distinct pairs that a rule fits: each is joined by its host and the hosts above it."""
    index = pages.sparkSession.createDataFrame([(h, p, v, len(h) + len(p), len(h)) for h, p, v in rules], "above string, prefix string, verdict string, n int, m int")
    own = pages.select(F.col(host).alias("host"), F.col(path).alias("path")).distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = own.withColumn("above", F.explode(above)).join(index, "above").filter(F.col("path").startswith(F.col("prefix")))
    best = met.groupBy("host", "path").agg(F.max(F.struct("n", "m", "above", "prefix", "verdict")).alias("b"))
    return best.select("host", "path", F.concat("b.above", "b.prefix").alias("rule"), F.col("b.verdict").alias("verdict"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, chance: float = CHANCE) -> DataFrame:
    """(tokens, key, confidence, support) of rules mined from (url, block), block a boolean."""
    known = labelled.filter(F.col("url").isNotNull() & F.col("block").isNotNull() & (F.instr("url", "://") > 0))
    spark, schema = labelled.sparkSession, "tokens array<string>, key string, confidence double, support double"
    own = known.select(tokens_of(F.col("url")).alias("tokens"), "block")
    # In one job: how many there are, how many of them are blocked.
    count, share = own.agg(F.count(F.lit(1)), F.avg(F.col("block").cast("double"))).first()
    if not count or not share:
        return spark.createDataFrame([], schema)
    # A token of all rows is in as many baskets as there are; there are at most as many of those as an URL has tokens.
    every = [r[0] for r in own.select(F.explode("tokens").alias("t")).groupBy("t").count().filter(F.col("count") == count).select("t").collect()]
    told = F.array_except("tokens", F.array(*map(F.lit, every)).cast("array<string>")) if every else F.col("tokens")
    baskets = cut(own.select(F.when(F.col("block"), F.array_append(told, BLOCK)).otherwise(told).alias("items")))
    least = min(1.0, max(min_support, min_count / count))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets)
    tried = max(1, model.freqItemsets.count())
    found = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BLOCK)))
    # Bits of surprise in n rows of which this share is blocked.
    c, q = F.col("confidence"), F.lit(float(share))
    surprise = c * F.log(c / q) + F.when(c < 1, (1 - c) * F.log((1 - c) / (1 - q))).otherwise(0.0)
    rows = F.col("support") * F.lit(float(count)) / c
    found = found.filter((c > q) & (rows * surprise >= F.lit(math.log(tried / chance))))
    found = found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = found.select("tokens", F.explode("tokens").alias("token")).join(single, "token").groupBy("tokens").agg(F.min(F.struct("freq", "token"))["token"].alias("key"))
    found = cut(found.join(rarest, "tokens").select("tokens", "key", "confidence", "support"))
    # Redundant: a rule with a subset among the rules that is as sure, found by the same index: a subset's key is among the rule's tokens.
    fewer = found.select(F.col("tokens").alias("fewer"), F.col("key").alias("token"), F.col("confidence").alias("sure"))
    met = found.select("tokens", "confidence", F.explode("tokens").alias("token")).join(fewer, "token")
    within = (F.size("fewer") < F.size("tokens")) & (F.size(F.array_except("fewer", "tokens")) == 0) & (F.col("sure") >= F.col("confidence"))
    return cut(found.join(met.filter(within).select("tokens").distinct(), "tokens", "left_anti").select("tokens", "key", "confidence", "support"))


def blocked(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence): the distinct urls that a mined rule blocks, with the confidence of the surest."""
    distinct = urls.select("url").filter(F.col("url").isNotNull()).distinct()
    posted = distinct.select("url", tokens_of(F.col("url")).alias("own")).select("url", "own", F.explode("own").alias("key"))
    small = rules.count() <= BROADCAST_ROWS
    met = posted.join(F.broadcast(rules) if small else rules, "key").filter(F.size(F.array_except("tokens", "own")) == 0)
    return met.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, curated: list[Curated], rules: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict (and confidence, of the mined rule where one decides)."""
    taken = {"host", "path", "rule", "verdict", "confidence"} & {c.lower() for c in pages.columns}
    if taken:
        raise ValueError(f"columns to be added are there: {sorted(taken)}")
    key, sure = free_name(pages, "_url"), free_name(pages, "_sure")
    address = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    own = pages.withColumn("host", host_of(address)).withColumn("path", path_of(address))
    if len(curated) <= COMPILED:
        said = free_name(own, "_said")
        own = own.withColumn("rule", curated_rule(F.col("host"), F.col("path"), curated, "rule")).withColumn(said, curated_rule(F.col("host"), F.col("path"), curated, "verdict"))
    else:
        fits = cut(curated_join(own, "host", "path", curated))
        at, under, said = (free_name(own, x) for x in ("_at", "_under", "_said"))
        fits = fits.select(F.col("host").alias(at), F.col("path").alias(under), "rule", F.col("verdict").alias(said))
        own = own.join(fits, (F.col("host") == F.col(at)) & (F.col("path") == F.col(under)), "left").drop(at, under)
    found = cut(blocked(pages.select(F.col(f"`{url}`").alias("url")), rules)).select(F.col("url").alias(key), F.col("confidence").alias(sure))
    small = found.count() <= BROADCAST_ROWS
    met = own.join(F.broadcast(found) if small else found, F.col(f"`{url}`") == F.col(key), "left")
    method = F.when(F.col(sure).isNotNull(), "block").otherwise("allow")
    out = met.withColumn("verdict", F.coalesce(F.col(said), method)).withColumn("confidence", F.when(F.col("rule").isNull(), F.col(sure)))
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], "host", "path", "rule", "verdict", "confidence")
