"""URL filter by association rules.

A fixed list of host and path rules decides some URLs; the longest rule that fits wins. These verdicts are
the labels: Spark's FP-growth mines which combinations of URL tokens go with them. Rules are kept with enough
support and confidence and at most LONGEST tokens, and only if no more general rule is as sure. A URL that no rule of the list
fits is held against an inverted index from each rule's rarest token; the surest rule that it
holds completely gives the verdict, and without one it is allowed. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import stored

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT, CONFIDENCE, LONGEST = 0.005, 0.9, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INDEX = "array<struct<item:string,rules:array<struct<confidence:double,hits:bigint,verdict:string,items:array<string>>>>>"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(url.isNotNull() & (at > 0), F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule of the list that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decides, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the last that fits is the longest
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(decides)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: host labels (the last one apart), path parts with digits as one sign, file ending, query names, fragment."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    last = F.transform(F.slice(labels, -1, 1), lambda x: F.concat(F.lit("tld:"), x))
    last = F.when(F.size(labels) > 0, last).otherwise(F.array().cast("array<string>"))
    hosts = F.transform(labels, lambda x: F.concat(F.lit("host:"), x))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    parts = F.transform(parts, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1)), lambda x: x != "")
    names = F.transform(names, lambda x: F.concat(F.lit("query:"), x))
    fragment = F.regexp_extract(F.coalesce(url, F.lit("")), "#(.+)", 1)
    fragment = F.when(fragment != "", F.array(F.concat(F.lit("fragment:"), fragment))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(last, hosts, parts, names, fragment))


def mine(labelled: DataFrame) -> str:
    """The inverted index as JSON, from all rows (tokens, verdict): per token the rules whose rarest token it is.

    What comes to the driver are rules with at least SUPPORT of the rows each, so their number has a bound that doesn't
    depend on the rows.
    """
    rows = stored(labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items")), "baskets")
    n = rows.count()
    if not n:
        return "[]"
    model = FPGrowth(itemsCol="items", minSupport=SUPPORT, minConfidence=CONFIDENCE).fit(rows)
    found = model.associationRules.where(F.col("consequent")[0].startswith("=") & (F.size("antecedent") <= LONGEST))
    found = found.select(
        F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], 2, 100).alias("verdict"), "confidence",
        F.round(F.col("support") * n).cast("long").alias("hits"),
    )
    found = stored(found.where(~F.exists("items", lambda x: x.startswith("="))), "rules")
    # the token sets that lack one or two of a rule's tokens, met by equality
    smaller = found.select("items", "verdict", "confidence", F.explode("items").alias("x"))
    one_less = smaller.select("items", "verdict", "confidence", F.array_remove("items", F.col("x")).alias("part"))
    singles = smaller.select("items", "verdict", "confidence", F.array("x").alias("part"))
    parts = one_less.unionByName(singles).where((F.size("part") > 0) & (F.size("part") < F.size("items")))
    general = found.select(F.col("items").alias("part"), "verdict", F.col("confidence").alias("as_sure"))
    beaten = parts.join(general, ["part", "verdict"]).where(F.col("as_sure") >= F.col("confidence")).select("items", "verdict").distinct()
    rules = found.join(beaten, ["items", "verdict"], "left_anti")
    often = stored(model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq"), "often")
    keyed = rules.select("*", F.explode("items").alias("item")).join(often, "item")
    rarest = keyed.groupBy("items", "verdict", "confidence", "hits").agg(F.min(F.struct("freq", "item"))["item"].alias("item"))
    entries = rarest.groupBy("item").agg(F.collect_list(F.struct("confidence", "hits", "verdict", "items")).alias("rules"))
    return entries.agg(F.to_json(F.collect_list(F.struct("item", "rules")))).first()[0] or "[]"


def learned(index: str, held: Column) -> Column:
    """The verdict of the surest rule whose tokens are all among `held`; null without one."""
    rules = F.map_from_entries(F.from_json(F.lit(index), _INDEX))
    candidates = F.flatten(F.filter(F.transform(held, lambda t: F.element_at(rules, t)), lambda x: x.isNotNull()))
    whole = F.filter(candidates, lambda r: F.size(F.array_except(r["items"], held)) == 0)
    # surest first, then best supported, then the shortest and first by name
    best = F.array_sort(F.transform(whole, lambda r: F.struct((-r["confidence"]).alias("a"), (-r["hits"]).alias("b"), F.size(r["items"]).alias("c"), r["items"].alias("d"), r["verdict"].alias("verdict"))))
    return F.try_element_at(F.transform(best, lambda r: r["verdict"]), F.lit(1)) if index != "[]" else F.lit(None).cast("string")


def judge(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, learned) of every URL.

    `pages` has page_id and url; other columns are not looked at. A null url, or one without `://`, has an empty host and
    path, fits no rule and is allowed unless a mined rule says otherwise. Repeated rows are judged alike. An empty table
    gives none. `learned` is what the mined rules say (null: nothing), also where the list decides.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = listed(F.col("host"), F.col("path"))
    split = split.withColumns({"rule": rule, "listed": verdict, "tokens": tokens(F.col("url"), F.col("host"), F.col("path"))})
    index = mine(split.where(F.col("listed").isNotNull()).select("tokens", F.col("listed").alias("verdict")))
    judged = split.withColumn("learned", learned(index, F.col("tokens")))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("listed", "learned", F.lit("allow")).alias("verdict"), "learned")
