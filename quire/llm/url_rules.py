"""3. URL filter by a rule list and by mined association rules.

A list of host and path rules decides first. Where none fits, association rules
decide: FP-growth mines combinations of URL tokens from labelled URLs, those
that imply ``block`` with enough support and confidence are kept, without rules
that a shorter one with the same confidence covers. They are matched by an
inverted index: each rule is filed under its rarest token, a URL looks up its
tokens there and then needs all tokens of a rule it finds.

Tokens are the labels of the host, the segments of the path (numbers and long
segments by kind) and the names of the query parameters. Distinct URLs are
matched, so a repeated URL is matched once. Rule tables are joined without a
hint: Spark broadcasts them while they are small. Mining reads at most
``SAMPLE`` labelled URLs, those of least hash.

FP-growth lists every frequent combination, which doubles with each token that
always comes with the others, as the segments of a long common path do. Tokens
in exactly the same labelled URLs are therefore mined as one item, and a rule
names the longest of them (then the first by name), which says the same.

All of it is DataFrame functions and Spark's own FP-growth.

Contract: a NULL URL, or one without ``://``, has an empty host and path, no
tokens, no rule, and is allowed; rows with NULL or repeated page_id are kept;
without labels nothing is mined; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

ALLOW, BLOCK = "allow", "block"
# The rule list of the registered query: (verdict, host and path).
RULES = (
    (ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"),
)
SAMPLE = 200_000
MIN_SUPPORT = 0.002
MIN_COUNT = 20         # labelled URLs that hold a combination, whatever the support
MIN_CONFIDENCE = 0.8
_MARK = "label:block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def list_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or NULL."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fit = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fits.append(F.when(fit, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL; none of a NULL one or one without host."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    segment = lambda s: F.when(s.rlike("^[0-9]+$"), "path:#").when(F.length(s) > 40, "path:long") \
        .otherwise(F.concat(F.lit("path:"), F.regexp_replace(s, "[0-9]+", "#")))
    some = lambda x: x != ""
    host = F.transform(F.filter(F.split(host_of(url), r"\."), some), lambda x: F.concat(F.lit("host:"), x))
    path = F.transform(F.filter(F.split(path_of(url), "/"), some), segment)
    names = F.transform(F.filter(F.split(query, "&"), some), lambda x: F.concat(F.lit("query:"), F.split(x, "=")[0]))
    none = F.array().cast("array<string>")
    return F.when(host_of(url) == "", none).otherwise(F.coalesce(F.array_distinct(F.concat(host, path, names)), none))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules ``antecedent, confidence, support, token`` from ``url, blocked``."""
    sample = labelled.where("url is not null and blocked is not null") \
        .orderBy(F.xxhash64("url"), "url", "blocked").limit(SAMPLE)
    urls = cut_lineage(sample.select(F.monotonically_increasing_id().alias("u"), "blocked", tokens_of(F.col("url")).alias("items"))
                       .where("size(items) > 0"))
    n = max(1, urls.count())
    held = urls.select("u", F.explode("items").alias("token"))
    # tokens in the same URLs: as many of them, with the same two hashes over their ids
    held_by = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u")).alias("h1"),
                                        F.bit_xor(F.xxhash64(F.lit(1), "u")).alias("h2")) \
        .where(F.col("n") >= F.lit(max(min_support * n, MIN_COUNT)))
    items = held_by.groupBy("n", "h1", "h2").agg(F.min(F.struct(-F.length("token"), F.col("token").alias("token")))["token"].alias("token"))
    kept_items = held.join(items.select("token"), "token").groupBy("u").agg(F.collect_list("token").alias("items"))
    baskets = urls.select("u", "blocked").join(kept_items, "u", "left") \
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>"))) \
        .select(F.when(F.col("blocked"), F.concat("items", F.array(F.lit(_MARK)))).otherwise(F.col("items")).alias("items"))
    least = min(1.0, max(min_support, MIN_COUNT / n))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0] == _MARK) \
        .select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    # a rule that a part of it states as surely says nothing more; parts are looked up by one token left out
    part = rules.where(F.size("antecedent") > 1).select(
        "antecedent", "confidence", F.explode("antecedent").alias("left_out")) \
        .select("antecedent", F.array_sort(F.array_remove("antecedent", F.col("left_out"))).alias("part"),
                F.col("confidence").alias("own"))
    covered = part.join(rules.select(F.col("antecedent").alias("part"), "confidence"), "part") \
        .where("confidence >= own").select("antecedent").distinct()
    kept = rules.join(covered, "antecedent", "left_anti")
    seen = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    filed = kept.select("antecedent", "confidence", "support", F.explode("antecedent").alias("token")).join(seen, "token")
    return filed.groupBy("antecedent").agg(F.first("confidence").alias("confidence"), F.first("support").alias("support"),
                                           F.min_by("token", F.struct("freq", "token")).alias("token"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, confidence, mined``: for each distinct URL that some mined rule
    fits, the surest rule (ties: most support, then by its tokens)."""
    looked_up = urls.select("url").where("url is not null").distinct().withColumn("items", tokens_of(F.col("url"))) \
        .withColumn("token", F.explode("items"))
    return looked_up.join(rules, "token").where(F.size(F.array_except("antecedent", "items")) == 0).groupBy("url") \
        .agg(F.max(F.struct("confidence", "support", F.array_join("antecedent", " ").alias("mined"))).alias("best")) \
        .select("url", "best.confidence", "best.mined")


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined`` of every row. ``mined`` is
    the association rule that decided, if one did."""
    mined = mine(labelled)
    url = F.col("url")
    rows = pages.select("page_id", "url").withColumn("host", host_of(url)).withColumn("path", path_of(url)) \
        .withColumn("listed", list_rule(F.col("host"), F.col("path"), rules))
    found = match(rows.where("listed is null"), mined)
    return rows.join(found, "url", "left").select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce(F.col("listed.verdict"), F.when(F.col("mined").isNotNull(), BLOCK), F.lit(ALLOW)).alias("verdict"),
        F.when(F.col("listed").isNull(), F.col("mined")).alias("mined"))
