"""URL filter: rules first, then gradient-boosted trees on lexical features.

A rule is ``host/path``; it fits its host and all subdomains if the url's path
starts with the rule's, and the longest rule that fits decides. Urls that a rule
decides are the labelled ones: the trees learn on a bounded sample of them
(``sample`` rows by a hash of the url) and judge the rest. Features are Column
expressions; suffix statistics (how many urls share the last host label, and the
smoothed share of blocked ones among the labelled) are counted over all rows.

Null urls and urls without ``://`` have an empty host and path and no rule; the
trees judge them by the rest of their features. Without labelled urls of both
verdicts the one verdict seen, else ``allow``, is given. Repeated rows are kept.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plan_alloc.llm.common import keep, lower_ascii, small

FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "parameter_length", "hyphens", "suffix_urls", "suffix_blocked")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    text = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(text, r"^[^/?#]*", 0)), F.regexp_extract(text, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule (verdict, text), as its text; null if none fits."""
    out = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n = F.length(url)
    count = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / F.greatest(n, F.lit(1))
    distinct = F.array_distinct(F.regexp_extract_all(url, F.lit("(?s)(.)"), 1))
    query = F.when(F.instr(url, "?") > 0, F.regexp_extract(url, r"\?([^#]*)", 1)).otherwise("")
    return {
        "length": n,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": count(path, "/"),
        "labels": count(host, "."),
        "digits": F.coalesce(F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(n, F.lit(1)), F.lit(0.0)),
        "entropy": F.coalesce(F.aggregate(distinct, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))), F.lit(0.0)),
        "parameters": F.when(query != "", count(query, "&") + 1).otherwise(0),
        "parameter_length": F.length(query),
        "hyphens": count(url, "-"),
    }


def judge(pages: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url", sample: int = 20_000, trees: int = 12, depth: int = 3) -> DataFrame:
    """Per row: id, host, path, rule, verdict (``allow`` or ``block``), block_score."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = split_url(url)
    verdicts = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)]) if rules else None
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    given = verdicts[F.col("rule")] if rules else F.lit(None).cast("string")
    rows = rows.withColumns({"given": given, "suffix": F.element_at(F.split("host", r"\."), -1)})
    blocked = F.col("given") == "block"
    totals = rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.count("given").alias("labelled"), F.count_if(blocked).alias("bad"))
    totals = keep(totals, "url_suffixes")
    every = totals.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).first()
    if not every["b"] or every["b"] == every["l"]:
        constant = "block" if every["b"] else "allow"
        return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", F.lit(constant)).alias("verdict"), F.lit(float(constant == "block")).alias("block_score"))
    prior = every["b"] / every["l"]
    totals = totals.select("suffix", F.log1p("n").alias("suffix_urls"), ((F.col("bad") + 20 * prior) / (F.col("labelled") + 20)).alias("suffix_blocked"))
    rows = rows.join(small(totals), "suffix").withColumns({k: v.cast("double") for k, v in lexical(url, F.col("host"), F.col("path")).items()})
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    labelled = assembled.where(F.col("given").isNotNull()).select("features", blocked.cast("double").alias("label"), F.xxhash64("url").alias("h"))
    chosen = keep(labelled.orderBy("h").limit(sample), "url_sample")
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, cacheNodeIds=False).fit(chosen.select("features", "label").coalesce(2))
    scored = model.setProbabilityCol("p").setPredictionCol("yes").transform(assembled)
    from pyspark.ml.functions import vector_to_array

    score = vector_to_array("p")[1]
    judged = F.coalesce("given", F.when(score >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", judged.alias("verdict"), score.alias("block_score"))
