"""URL verdicts: fixed rules first, then association rules mined by FP-growth and matched by an inverted index. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, LOWER, UPPER, written

#: (verdict, host, path prefix)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Mining reads at most about so many distinct labelled urls, drawn by a hash of the url.
MAX_LABELLED = 500_000
MIN_SUPPORT = 0.005
#: Labelled urls that a rule needs at least, and classes of tokens of one url that FP-growth combines.
MIN_COUNT, MOST_ITEMS = 3, 8
MIN_CONFIDENCE = 0.9
DEFAULT = "allow"


def split_url(pages: DataFrame) -> DataFrame:
    """pages with host and path (after the host up to ?, # or the end); both empty for a null url or one without ://."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    out = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    host = F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER)
    return out.withColumn("host", host).withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)).drop("_rest")


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages (host, path) with rule, the longest rule that fits the host or a parent domain and the start of the path, and ruled, its verdict."""
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def first(value) -> Column:
        fits = [(((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p)), F.lit(value(v, h, p))) for v, h, p in by_length]
        return F.coalesce(F.lit(None).cast("string"), *(F.when(c, x) for c, x in fits))

    return pages.withColumn("rule", first(lambda v, h, p: h + p)).withColumn("ruled", first(lambda v, h, p: v))


def tokens() -> Column:
    """Distinct url tokens from url, host and path: host labels by their place from the right, path segments by depth (digit runs as #, ends as
    they are), and names of query parameters."""
    labels = F.transform(F.reverse(F.split("host", r"\.")), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    parts = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^[^=]*", 0)))
    return F.array_distinct(F.concat(F.filter(labels, lambda x: x != "h0:"), parts, names))


def token_classes(labelled: DataFrame, least: float) -> DataFrame:
    """token, cls, telling: tokens that at least so many labelled rows (url, tokens, verdict) have. Tokens that the same rows have, by their number and 128
    bits of hashes, are one class, named after the least of them: to mining they are one item, however deep a path is. telling is how far a class's
    verdicts are from those of all rows, in standard deviations."""
    one = labelled.select(F.explode("tokens").alias("token"), (F.col("verdict") == DEFAULT).cast("int").alias("usual"), F.xxhash64("url", "verdict").alias("a"), F.xxhash64("verdict", "url", F.lit(1)).alias("b"))
    seen = one.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.avg("usual").alias("share")).filter(F.col("n") >= least)
    share = labelled.agg(F.avg((F.col("verdict") == DEFAULT).cast("int"))).first()[0] or 0.0
    names = seen.groupBy("n", "a", "b").agg(F.min("token").alias("cls"))
    return seen.join(names, ["n", "a", "b"]).select("token", "cls", F.round(F.abs(F.col("share") - share) * F.sqrt("n"), 6).alias("telling"))


def in_classes(rows: DataFrame, classes: DataFrame, *keys: str) -> DataFrame:
    """keys and items, the classes of each row's tokens with how telling they are, most telling first; rows without any are left out."""
    found = rows.select(*keys, F.explode("tokens").alias("token")).join(classes, "token")
    items = F.sort_array(F.collect_set(F.struct(-F.col("telling"), "cls")))
    return found.groupBy(*keys).agg(items.alias("items")).select(*keys, F.col("items.cls").alias("items"))


def mined_rules(labelled: DataFrame, classes: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """rid, verdict, antecedent (classes), confidence, support: rules whose consequent is a verdict, of labelled rows (url, tokens, verdict).

    Spark's FP-growth runs with the verdict as one more item, over the MOST_ITEMS most telling classes of each row: it lists all subsets of what a row has.
    Where rows had more, the rules' support and confidence are counted again over all their classes, and rules_beyond adds those of sets that only a row
    with more has. Rules need MIN_COUNT rows at least. A rule that a rule with fewer classes and no less confidence implies is pruned by the matcher's order."""
    whole = written(labelled.select("url", "verdict").join(in_classes(labelled, classes, "url", "verdict"), ["url", "verdict"], "left"), "url-baskets")
    n = whole.count()
    support = max(min_support, MIN_COUNT / max(1, n))
    items = F.concat(F.slice(F.coalesce("items", F.array().cast("array<string>")), 1, MOST_ITEMS), F.array(F.concat(F.lit("="), F.col("verdict"))))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(whole.select(items.alias("items")))
    rules = model.associationRules.filter(F.startswith(F.element_at("consequent", 1), F.lit("=")))
    rules = rules.filter(~F.exists("antecedent", lambda x: F.startswith(x, F.lit("="))))
    verdict = F.substring(F.element_at("consequent", 1), 2, 100)
    rules = rules.select(verdict.alias("verdict"), F.sort_array("antecedent").alias("antecedent"), "confidence", "support")
    if whole.filter(F.size("items") > MOST_ITEMS).take(1):
        rules = written(rules.withColumn("rid", F.monotonically_increasing_id()), "url-rules")
        hits = fitting(whole.filter("items IS NOT NULL").select("url", F.col("verdict").alias("was"), F.col("items").alias("tokens")), rules)
        counts = hits.groupBy("rid").agg(F.count("*").alias("n"), F.count_if(F.col("was") == F.col("verdict")).alias("ok"))
        rules = rules.join(counts, "rid").select("verdict", "antecedent", (F.col("ok") / F.col("n")).alias("confidence"), (F.col("ok") / n).alias("support"))
        rules = rules.filter((F.col("confidence") >= min_confidence) & (F.col("support") >= support))
        rules = rules.unionByName(rules_beyond(whole, n, support, min_confidence)).dropDuplicates(["verdict", "antecedent"])
    return rules.select("verdict", "antecedent", F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support")).withColumn("rid", F.monotonically_increasing_id())


def rules_beyond(whole: DataFrame, n: int, support: float, min_confidence: float) -> DataFrame:
    """verdict, antecedent, confidence, support: rules of sets of classes that some row (url, verdict, items) with more than MOST_ITEMS has, counted over all
    n rows, however many classes they have.

    Sets grow by a class at a time, in the rows that hold them. A set is left out, with all larger ones, where no verdict has support, where it has the
    rows of a set with a class less, or where such a one is always right: for every url that meets it, that shorter rule comes first. So the classes of a
    deep path, each with the rows of the next and some more, make no sets of two."""
    rows = whole.filter("items IS NOT NULL").withColumn("long", F.size("items") > MOST_ITEMS)
    held = rows.select("url", "verdict", "long", F.explode("items").alias("x")).select("url", "verdict", "long", F.array("x").alias("antecedent"))
    size, before, found = 1, None, []
    while True:
        held = written(held, "url-sets")
        per = held.groupBy("antecedent", "verdict").agg(F.count("*").alias("ok"), F.max("long").alias("long"))
        sets = per.groupBy("antecedent").agg(F.sum("ok").alias("n"), F.max("ok").alias("top"), F.max("long").alias("long"), F.collect_list(F.struct("verdict", "ok")).alias("by"))
        sets = sets.filter(F.col("long") & (F.col("top") / n >= support))
        if before is not None:
            without = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.filter("antecedent", lambda _, i: i != k))
            parts = sets.select("antecedent", "n", F.explode(without).alias("part")).join(before.select(F.col("antecedent").alias("part"), F.col("n").alias("more")), "part")
            new = parts.groupBy("antecedent").agg(F.count("*").alias("parts"), F.min(F.col("more") - F.col("n")).alias("fewer")).filter((F.col("parts") == size) & (F.col("fewer") > 0))
            sets = sets.join(new.select("antecedent"), "antecedent")
        sets = written(sets, "url-sets")
        found.append(sets.select("antecedent", "n", F.explode("by").alias("x")).select("x.verdict", "antecedent", (F.col("x.ok") / F.col("n")).alias("confidence"), (F.col("x.ok") / n).alias("support")))
        before = sets.filter("top < n")
        if before.count() < 2:
            break
        lists = held.join(before.select("antecedent"), "antecedent").groupBy("url", "verdict", "long").agg(F.sort_array(F.collect_list("antecedent")).alias("sets"))
        after = lambda i: F.slice("sets", i + 2, F.size("sets"))
        start = lambda a: F.slice(a, 1, size - 1)  # noqa: B023, E731
        joined = F.transform("sets", lambda a, i: F.transform(F.filter(after(i), lambda b: start(a) == start(b)), lambda b: F.concat(a, F.slice(b, -1, 1))))
        held = lists.select("url", "verdict", "long", F.explode(F.flatten(joined)).alias("antecedent"))
        size += 1
    return reduce(DataFrame.unionByName, found).filter((F.col("confidence") >= min_confidence) & (F.col("support") >= support))


def fitting(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (tokens and others) with each of the rules that they meet. The index has each rule under its rarest token; a row opens the rules of its own
    tokens and checks the rest of them."""
    common = rules.select(F.explode("antecedent").alias("token"), "support").groupBy("token").agg(F.max("support").alias("often"))
    posts = rules.withColumn("token", F.explode("antecedent")).join(common, "token")
    index = posts.groupBy("rid", "verdict", "antecedent", "confidence", "support").agg(F.min(F.struct("often", "token"))["token"].alias("token"))
    index = written(index, "url-index")
    size = index.agg(F.sum(F.length(F.concat_ws(" ", "antecedent")) + 200)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        index = F.broadcast(index)
    found = rows.withColumn("token", F.explode("tokens")).join(index, "token")
    return found.filter(F.size(F.array_except("antecedent", "tokens")) == 0)


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, verdict, by the best mined rule that each distinct url (url, tokens) meets: most confident, then best supported, then shortest, then
    block before allow."""
    order = F.struct(F.col("confidence"), F.col("support"), -F.size("antecedent"), F.col("verdict"))
    return fitting(urls, rules).groupBy("url").agg(F.max(order).alias("best")).select("url", F.col("best.verdict").alias("verdict"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict, by, one row for each input row.

    Rules decide where they fit. The other urls are judged by association rules mined from labels (url, verdict); without labels, from the urls
    that the rules decide, with their verdicts. A url counts once with each verdict that it is labelled with, however often it occurs. Mining reads a
    sample of about max_labelled distinct labelled urls at most, drawn by a hash of the url, so that reruns agree; all urls are judged. A url that meets
    no mined rule gets DEFAULT. by is rule, mined or default.

    A null url has an empty host and path, and gets DEFAULT; urls are read whole, whatever their length; repeated rows get the same verdict; an empty
    table gives no rows; columns other than page_id and url are not read."""
    rows = written(with_rule(split_url(pages.select("page_id", "url")), rules), "url-rows")
    known = rows.filter(F.col("ruled").isNotNull()).select("url", "host", "path", F.col("ruled").alias("verdict"))
    if labels is not None:
        known = split_url(labels.select("url", "verdict")).filter(F.col("url").isNotNull())
    known = written(known.distinct(), "url-labelled")
    n = known.count()
    if n > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < F.lit(int((1 << 30) * max_labelled / n)))
    open_ = rows.filter(F.col("ruled").isNull() & F.col("url").isNotNull()).select("url", "host", "path").distinct()
    if n:
        labelled = written(known.select("url", tokens().alias("tokens"), "verdict"), "url-tokens")
        classes = written(token_classes(labelled, max(MIN_COUNT, MIN_SUPPORT * labelled.count())), "url-classes")
        mined = mined_rules(labelled, classes)
        own = in_classes(open_.select("url", tokens().alias("tokens")), classes, "url")
        best = matched(own.withColumnRenamed("items", "tokens"), written(mined, "url-rules"))
    else:
        best = open_.select("url", F.lit(None).cast("string").alias("verdict")).limit(0)
    out = rows.alias("r").join(best.alias("b"), F.col("r.url") == F.col("b.url"), "left")
    by = F.when(F.col("ruled").isNotNull(), "rule").when(F.col("b.verdict").isNotNull(), "mined").otherwise("default")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "b.verdict", F.lit(DEFAULT)).alias("verdict"), by.alias("by"))


def op2_url_filter(spark, sf_dir):
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
