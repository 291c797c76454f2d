"""URL filtering by lists and by association rules.

Labelled URLs are baskets of tokens with their label as one more item. FP-growth mines the
frequent combinations; those that imply a label with enough confidence are rules, and a rule
that holds a more general one of the same label adds nothing and goes. Rules are matched by an
inverted index: a rule is posted under its rarest token, a URL looks up its own tokens, and the
whole rule is compared where one meets. Only DataFrame operations and MLlib's FPGrowth run.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonefold.llm.common import ascii_lower

ALLOW, BLOCK = "allow", "block"
LABEL = "label="


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: the host up to `/`, `?`, `#` or the end, in lower case, and the path up to `?` or `#`. Else both empty."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of rules (host, path, verdict) that fits; null where none does. rules is a short list."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    best = F.array_max(F.array_compact(F.array(*fits)))
    return best["rule"], best["verdict"]


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens by kind: host labels, the host's last two labels, path words, query names."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(ascii_lower(path), r"[^a-z0-9]+"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^([^=]*)", 1)), lambda x: x != "")
    tag = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(f"{kind}:"), x))
    return F.array_distinct(F.concat(tag("h", labels), tag("p", words), tag("q", names)))


def mine(labelled: DataFrame, confidence: float = 0.9, support: float = 0.002, least: int = 20) -> DataFrame:
    """antecedent array, verdict, confidence, support from labelled(tokens array, verdict).

    Frequent: in `support` of the rows, and `least` of them. No labelled row, or none frequent, gives no rules.
    """
    n = labelled.count()
    schema = "antecedent array<string>, verdict string, confidence double, support double"
    if not n:
        return labelled.sparkSession.createDataFrame([], schema)
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit(LABEL), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / n)), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent")[0].startswith(LABEL))
    rules = rules.select(F.sort_array("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 1000).alias("verdict"), "confidence", "support")
    return pruned(rules).select("antecedent", "verdict", "confidence", "support")


def pruned(rules: DataFrame) -> DataFrame:
    """Without rules that contain a shorter rule of the same verdict, found by looking up each of a rule's tokens."""
    ids = rules.withColumn("id", F.xxhash64("verdict", "antecedent"))
    short = ids.select(F.col("antecedent")[0].alias("token"), F.col("verdict").alias("v"), F.col("antecedent").alias("small"))
    long = ids.select("id", "verdict", F.col("antecedent").alias("large"), F.explode("antecedent").alias("token"))
    holds = (F.col("v") == F.col("verdict")) & (F.size("small") < F.size("large")) & (F.size(F.array_except("small", "large")) == 0)
    return ids.join(long.join(short, "token").filter(holds).select("id"), "id", "left_anti")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, verdict of the most confident rule that fits (then the best supported; block before allow) of urls(url, tokens); only URLs with a match."""
    flat = rules.select("*", F.explode("antecedent").alias("token"))
    often = flat.groupBy("token").agg(F.max("support").alias("often"))
    rarest = flat.join(often, "token").groupBy("antecedent", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("often", "token")).alias("token"))
    found = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(rarest, "token")
    found = found.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", (F.col("verdict") == BLOCK).alias("b"), "verdict"))
    return found.groupBy("url").agg(best.alias("best")).select("url", F.col("best.verdict").alias("mined"))


def judged(pages: DataFrame, labels: DataFrame, lists: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", default: str = ALLOW, **options) -> DataFrame:
    """page_id, url, host, path, rule, verdict, mined for each row of pages.

    labels(page_id, verdict) label pages; where a list's rule fits a URL, its verdict is the label.
    verdict: the list's, else the mined rules', else `default`. Null, empty and repeated URLs are
    judged like others; mining and matching see each distinct URL once a label.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = listed(F.col("host"), F.col("path"), lists)
    rows = rows.withColumns({"rule": rule, "listed": verdict})
    given = labels.groupBy("page_id").agg(F.max("verdict").alias("given"))
    taught = rows.join(given, "page_id", "left").withColumn("verdict", F.coalesce("listed", "given")).filter("verdict IS NOT NULL")
    bag = tokens(F.col("host"), F.col("path"), F.col("url"))
    rules = mine(taught.select("url", "host", "path", "verdict").distinct().select(bag.alias("tokens"), "verdict"), **options)
    open_ = rows.filter("listed IS NULL").select("url", "host", "path").distinct().select("url", bag.alias("tokens"))
    mined = matched(open_, rules)
    return rows.join(mined, "url", "left").select("page_id", "url", "host", "path", "rule", F.coalesce("listed", "mined", F.lit(default)).alias("verdict"), "mined")
