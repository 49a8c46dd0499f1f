"""URL filtering by listed rules and by association rules that FP-growth mines.

A listed rule is a host and a path prefix with a verdict. It fits its host and all subdomains of it; the longest fitting rule wins. Rules are met by
equality: a url is looked up with the last labels of its host and the first letters of its path, once for each (labels, letters) that rules have.

A url that no listed rule fits is judged by association rules. The labelled urls are baskets of tokens (labels of the host from the right, words of the path, shapes of
numbers, names of parameters, the extension) and their label; FP-growth finds the frequent combinations, and combinations that imply a label are kept by
support and confidence. An inverted index from one token of each rule, the rarest, to the rule finds the rules that a url may hold; all others
of the rule's tokens are then checked. The strongest rule decides; without one the verdict is ``default``.

Only DataFrame and SQL functions: no Python worker runs.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.llm._store import broadcast_below, cut

BROADCAST_ROWS = 100_000
#: A labelled url's label as an item of its basket.
MARK = "label="


def host_of(url: Column) -> Column:
    """From behind the first :// to the next /, ? or #, A-Z lower-cased; '' for null and for urls without ://."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), upper, lower)


def path_of(url: Column) -> Column:
    """From the end of the host to the next ? or #; '' where host_of() is for want of ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url: h0:, h1:, ... labels of the host from the right, p: words of the path and n: its numbers as first digit and length,
    x: the extension, q: names of parameters."""
    host, path = host_of(url), F.lower(path_of(url))
    labels = F.filter(F.reverse(F.split(host, r"\.")), lambda x: x != "")
    labels = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    words = F.filter(F.split(F.regexp_replace(path, r"\.[a-z0-9]{1,5}$", ""), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    words = F.transform(words, lambda x: F.when(x.rlike(r"^\p{N}+$"), F.concat(F.lit("n:"), F.substring(x, 1, 1), F.lit("x"), F.length(x).cast("string"))).otherwise(F.concat(F.lit("p:"), x)))
    ending = F.regexp_extract(path, r"\.([a-z0-9]{1,5})$", 1)
    query = F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "[&;]")
    names = F.transform(F.filter(query, lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(labels, words, F.when(ending != "", F.array(F.concat(F.lit("x:"), ending))).otherwise(F.array().cast("array<string>")), names))


def listed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with __host and __path) and __rule, __verdict of the longest fitting rule of ``rules`` (host, path, verdict); null where none fits.

    ``rules`` are a list made by people; equal rules must agree (else the block wins). One map-side join for each pair of (labels of the host, letters of the path) that occurs.
    """
    told = rules.groupBy(F.concat("host", "path").alias("rule"), "host", "path").agg(F.max("verdict").alias("verdict")).withColumns({"labels": F.size(F.split("host", r"\.")), "letters": F.length("path")})
    told = cut(told)
    shapes = told.groupBy("labels", "letters").count().collect()
    out, found = pages, []
    for k, s in enumerate(shapes):
        mine = told.where((F.col("labels") == s.labels) & (F.col("letters") == s.letters)).select(
            F.col("host").alias(f"__h{k}"), F.col("path").alias(f"__p{k}"), F.struct(F.length("rule").alias("length"), "rule", "verdict").alias(f"__r{k}"))
        suffix, prefix = F.substring_index("__host", ".", -s.labels), F.substring("__path", 1, s.letters)
        out = out.join(broadcast_below(mine, s["count"], BROADCAST_ROWS), (suffix == F.col(f"__h{k}")) & (prefix == F.col(f"__p{k}")), "left")
        found.append(F.col(f"__r{k}"))
    best = F.array_max(F.filter(F.array(*found), lambda r: r.isNotNull())) if found else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return out.select(*pages.columns, best.alias("__best")).select(*pages.columns, F.col("__best.rule").alias("__rule"), F.col("__best.verdict").alias("__verdict"))


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.9, min_urls: int = 5) -> DataFrame:
    """Association rules of ``labelled`` (tokens array<string>, label string): (rule_tokens, label, confidence, support).

    A combination is frequent in ``min_support`` of the urls and in ``min_urls`` at least. Tokens of one and the same set of urls are told by one of them (the least): they add no information, and their
    combinations would double the frequent sets with every token; tokens that all urls hold tell nothing. A rule stays if no smaller part of it gives the same label with at least its confidence.
    Every labelled url counts; null labels don't.
    """
    rows = cut(labelled.where("label is not null").select("tokens", "label"))
    n = rows.count()
    schema = "rule_tokens array<string>, label string, confidence double, support double"
    if not n:
        return labelled.sparkSession.createDataFrame([], schema)
    support = max(min_support, min_urls / n)
    if support > 1:
        return labelled.sparkSession.createDataFrame([], schema)
    each = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    single = each.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("rows"))
    single = single.where((F.col("n") >= support * n) & (F.col("n") < n)).groupBy("n", "rows").agg(F.min("token").alias("token"))
    known = broadcast_below(single.select("token"), int(single.count()), BROADCAST_ROWS)
    items = each.select("row", "label", F.explode_outer("tokens").alias("token")).join(known, "token", "left_semi").groupBy("row", "label").agg(F.collect_set("token").alias("tokens"))
    baskets = items.select(F.concat("tokens", F.array(F.concat(F.lit(MARK), "label"))).alias("items"))
    bare = each.join(items.select("row"), "row", "left_anti").select(F.array(F.concat(F.lit(MARK), "label")).alias("items"))
    baskets = cut(baskets.unionByName(bare))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    sets = cut(model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n")))
    mark = F.filter("items", lambda x: x.startswith(MARK))
    plain = sets.where(F.size(mark) == 0).select(F.col("items").alias("rule_tokens"), F.col("n").alias("n_all"))
    marked = sets.where((F.size(mark) == 1) & (F.size("items") > 1)).select(F.filter("items", lambda x: ~x.startswith(MARK)).alias("rule_tokens"), F.substring(F.get(mark, F.lit(0)), len(MARK) + 1, 1 << 30).alias("label"), "n")
    rules = marked.join(plain, "rule_tokens").select("rule_tokens", "label", (F.col("n") / F.col("n_all")).alias("confidence"), (F.col("n") / n).alias("support")).where(F.col("confidence") >= min_confidence)
    rules = cut(rules)
    # a rule without one of its tokens that is as sure makes it superfluous
    parts = rules.where(F.size("rule_tokens") > 1).select("rule_tokens", "label", "confidence", F.explode("rule_tokens").alias("token"))
    parts = parts.select("label", F.col("rule_tokens").alias("longer"), F.col("confidence").alias("mine"), F.array_remove("rule_tokens", F.col("token")).alias("rule_tokens"))
    weak = parts.join(rules, ["rule_tokens", "label"]).where("confidence >= mine").select(F.col("longer").alias("rule_tokens"), "label").distinct()
    return rules.join(weak, ["rule_tokens", "label"], "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame, row_col: str = "row", tokens_col: str = "tokens") -> DataFrame:
    """(row, label, rule_tokens, confidence) of the strongest of ``rules`` whose tokens ``urls`` (a unique row, tokens) hold: by confidence, support, length, then tokens; rows without one are missing.

    Inverted index: each rule stands under the token that is rarest among the rules' tokens in ``urls``, so that a token of a third of all urls brings only the rules that have no rarer one.
    """
    posted = rules.select("*", F.explode("rule_tokens").alias("token"))
    tokens = urls.select(F.col(row_col).alias("__row"), F.explode(tokens_col).alias("token"))
    frequency = tokens.join(F.broadcast(posted.select("token").distinct()) if rules.count() <= BROADCAST_ROWS else posted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = posted.join(frequency, "token").groupBy("rule_tokens", "label").agg(F.min(F.struct("urls", "token")).alias("pivot"), F.count("*").alias("seen"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    index = cut(rarest.where(F.col("seen") == F.size("rule_tokens")).select(F.col("pivot.token").alias("token"), F.struct("confidence", "support", F.size("rule_tokens").alias("length"), "rule_tokens", "label").alias("rule")))
    # candidates travel without the url's tokens, which meet them by row: a long url isn't copied for each of its tokens
    asked = tokens.join(broadcast_below(index, index.count(), BROADCAST_ROWS), "token").select("__row", "rule")
    held = asked.join(urls.select(F.col(row_col).alias("__row"), F.col(tokens_col).alias("__tokens")), "__row").where(F.size(F.array_except("rule.rule_tokens", "__tokens")) == 0)
    best = held.groupBy("__row").agg(F.max("rule").alias("rule"))
    return best.select(F.col("__row").alias(row_col), "rule.label", "rule.rule_tokens", "rule.confidence")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", min_support: float = 0.002, min_confidence: float = 0.9) -> DataFrame:
    """One row per page: (id, host, path, rule, verdict, mined), judged by ``rules`` (host, path, verdict of allow or block), else by association rules mined from the urls that rules fit, else ``default``.

    Null urls and urls without :// have empty host and path; no listed rule with a path fits them. Repeated rows each have a row; ties of listed rules don't occur as equal
    rules are merged. ``mined`` are the tokens of the association rule that decided. Only id and url are read; an empty table gives an empty one.
    """
    url = F.col(url_col).cast("string")
    read = pages.select(F.col(id_col).alias("__id"), host_of(url).alias("__host"), path_of(url).alias("__path"), tokens_of(url).alias("tokens"))
    each = cut(listed(read, rules).withColumn("row", F.monotonically_increasing_id()))
    mined = cut(mine_rules(each.select("tokens", F.col("__verdict").alias("label")), min_support, min_confidence))
    found = match_rules(each.where("__rule is null").select("row", "tokens"), mined)
    out = each.join(found, "row", "left")
    return out.select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"),
                      F.coalesce("__verdict", "label", F.lit(default)).alias("verdict"), F.col("rule_tokens").alias("mined"))
