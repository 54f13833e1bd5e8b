"""URL filtering by explicit rules and by mined association rules, in DataFrame operations only.

Explicit rules allow or block a host with all its subdomains below a path; of the fitting ones the longest decides. Where none fits,
mined rules do. A rule is a smallest combination of tokens that ``MIN_COUNT`` URLs labelled bad hold, the same number for every size of input, and of which
they are ``MIN_CONFIDENCE`` of all labelled URLs that hold it. Single tokens are counted first; what blocks by itself needs no longer combination. Of
the others, tokens that occur in the very same labelled URLs become one item, and Spark's FP-growth finds the combinations of items among the bad URLs; a
join counts them among all. So a path that many URLs have in common is one item, whatever its length. What is left is the number of frequent
combinations of items with different URLs none of which blocks by itself, and the list of these items, which Spark's FP-growth brings to the driver.

Rules are matched through an inverted index: each is filed under its rarest token, a URL looks up its own tokens, and what it finds is
verified against the whole combination. A URL is looked up once, however many pages have it. Labelled URLs count as often as they are given.

A null URL, or one without ``://``, has an empty host and path and no tokens; no rule fits it and it is allowed. If no label is given,
or all are alike, nothing is mined.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Rules of the query, as given.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MIN_COUNT = 8  # URLs labelled bad that hold the combination
MIN_CONFIDENCE = 0.5  # share of them in all labelled URLs that hold it

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` (with a column url) and its host and path."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.select("*", F.translate(host, _UPPER, _UPPER.lower()).alias("host"), path.alias("path"))


def fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    below = F.col("host") == F.lit(host)
    if host:
        below = below | F.endswith("host", F.lit("." + host))
    return below & F.startswith("path", F.lit(slash + path))


def explicit(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The fitting rule and its verdict, or nulls. Of equally long rules the one with the longer host is taken."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]), r[1])):
        rule = F.when(fits(text), F.lit(text)).otherwise(rule)
        verdict = F.when(fits(text), F.lit(word)).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """Distinct tokens of url, host and path: scheme, host labels and endings, path segments, query names, fragment; numbers are alike."""
    number = r"^[0-9]+(\.[a-z]+)?$"
    label = F.split("host", r"\.")
    host = F.transform(label, lambda x: F.concat(F.lit("host:"), x))
    # Endings of two and more labels: example.net, blog.example.net.
    n = F.size(label)
    endings = F.transform(
        F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.concat(F.lit("site:"), F.array_join(F.slice(label, k, n), ".")),
    )
    segments = F.transform(
        F.split(F.btrim(F.col("path"), F.lit("/")), "/"),
        lambda x: F.concat(F.lit("path:"), F.when(x.rlike(number), F.regexp_replace(x, "[0-9]+", "0")).otherwise(x)),
    )
    names = F.transform(F.regexp_extract_all("url", F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("query:"), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.regexp_extract("url", "^([^:]*)://", 1)))
    fragment = F.when(F.contains("url", F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.col("host") != "", F.array_distinct(F.concat(host, endings, segments, names, scheme, fragment))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules from (tokens, bad): antecedent, parts, rarest, support (a count) and confidence.

    Each of ``parts`` is an array of tokens of which a URL must have one, as they occur in the same labelled URLs; ``antecedent`` has the first token of
    each. ``rarest`` is the part that the fewest URLs hold. Tokens are those of ``tokens()``, or others without its prefixes.
    """
    # Many URLs have the same tokens; they are one set with a weight.
    sets = labelled.groupBy(F.sort_array("tokens").alias("tokens")).agg(F.count_if("bad").alias("bad"), F.count("*").alias("n"))
    sets = cut(sets.select(F.monotonically_increasing_id().alias("id"), "tokens", "bad", "n"))
    held = sets.select("id", "bad", "n", F.explode("tokens").alias("token"))
    where = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"in{k}") for k in (0, 1)]
    single = held.groupBy("token").agg(F.sum("bad").alias("support"), F.sum("n").alias("often"), *where)
    single = cut(single.filter(F.col("support") >= min_count).withColumn("confidence", F.col("support") / F.col("often")))
    part = F.array(F.array("token"))
    alone = single.filter(F.col("confidence") >= min_confidence)
    alone = alone.select(F.array("token").alias("antecedent"), part.alias("parts"), F.array("token").alias("rarest"), "support", "confidence")
    # A combination with one of these in it adds nothing. Of the others, those in the same URLs are one item.
    items = single.filter(F.col("confidence") < min_confidence).groupBy("in0", "in1").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("part"), F.first("often").alias("often"))
    items = cut(items.select("item", "part", "often"))
    named = items.select("item", "often", F.explode("part").alias("token"))
    holding = held.join(named, "token").groupBy("id", "bad", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))
    holding = cut(holding)
    bad = holding.filter("bad > 0").select("items", F.explode(F.sequence(F.lit(1), F.col("bad").cast("int")))).select("items")
    n = bad.count()
    # Half a URL less, so that no rounding asks for one more than min_count.
    least = min(1.0, (min_count - 0.5) / n) if n else 1.0
    frequent = FPGrowth(itemsCol="items", minSupport=least).fit(bad).freqItemsets
    found = frequent.filter((F.col("freq") >= min_count) & (F.size("items") > 1)).select(F.sort_array("items").alias("items"), F.col("freq").alias("support"))
    found = cut(found)
    # A combination is counted in the sets that hold its rarest item.
    by_item = found.select("items", "support", F.explode("items").alias("item")).join(items.select("item", "often"), "item")
    filed = by_item.groupBy("items", "support").agg(F.min_by("item", F.struct("often", "item")).alias("item"))
    looked_at = holding.select(F.col("items").alias("all"), "n", F.explode("items").alias("item"))
    counted = filed.join(looked_at, "item").filter(F.size(F.array_except("items", "all")) == 0).groupBy("items", "support", "item").agg(F.sum("n").alias("freq"))
    joint = cut(counted.withColumn("confidence", F.col("support") / F.col("freq")).filter(F.col("confidence") >= min_confidence))
    # One that holds a shorter one adds nothing: that has matched already. Only those with the shorter one's rarest item can hold it.
    shorter = joint.select(F.col("items").alias("inner"), "item")
    covered = joint.select("items", F.explode("items").alias("item")).join(shorter, "item")
    covered = covered.filter((F.size("inner") < F.size("items")) & (F.size(F.array_except("inner", "items")) == 0)).select("items").distinct()
    joint = joint.join(covered, "items", "left_anti")
    parts = joint.select("items", "support", "confidence", F.col("item").alias("least"), F.explode("items").alias("item")).join(items.select("item", "part"), "item")
    joint = parts.groupBy("items", "support", "confidence").agg(F.collect_list("part").alias("parts"), F.max(F.when(F.col("item") == F.col("least"), F.col("part"))).alias("rarest"))
    rules = alone.unionByName(joint.withColumnRenamed("items", "antecedent"))
    return cut(rules.select(F.md5(F.to_json("antecedent")).alias("rule_id"), "antecedent", "parts", "rarest", "support", "confidence"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Per URL (url, tokens) that some rule fits: the highest confidence and the rule that has it. A rule is filed under each token of its rarest part."""
    filed = rules.select("rule_id", "antecedent", "parts", "confidence", F.explode("rarest").alias("token"))
    hits = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(filed, "token").filter(F.forall("parts", lambda x: F.arrays_overlap(x, F.col("tokens"))))
    best = F.max_by(F.array_join("antecedent", " & "), F.struct("confidence", "rule_id"))
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"), best.alias("mined_rule"))


def judge(pages: DataFrame, labelled_urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, **mining) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and what the mined rules say (mined_rule, confidence).

    ``labelled_urls`` has url and bad (boolean); rows without a label are left out.
    """
    known = with_parts(labelled_urls.filter(F.col("bad").isNotNull() & F.col("url").isNotNull()).select("url", "bad"))
    mined = mine(known.select(tokens().alias("tokens"), "bad"), **mining)
    parts = with_parts(pages.select("page_id", "url"))
    urls = parts.filter("host != ''").select("url", "host", "path").distinct().select("url", tokens().alias("tokens"))
    found = matched(urls, mined)
    rule, verdict = explicit(rules)
    method = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    judged = parts.join(found, "url", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "mined_rule", "confidence")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and bad of the pages whose document has a quality label; the number in the path's last segment is its doc_id."""
    number = F.regexp_extract("path", r"/([0-9]{1,18})[^/]*/?$", 1)
    numbered = with_parts(pages.select("url")).filter(number != "").select("url", number.cast("long").alias("doc_id"))
    marks = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    return numbered.join(marks, "doc_id").select("url", "bad")
