"""URL filter: longest-match rules, and gradient-boosted trees on lexical features for every other URL.

The trees are trained on the URLs that a rule labels. All features come from the URL alone: length, depth, digit ratio,
entropy, parameter counts, and statistics of the host's suffix over the whole table.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.catalog import query
from strandlake.llm.common import ascii_lower, keep, table

#: (host and path prefix, verdict): a rule holds for its host and all subdomains.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: The trees are fitted on so many labelled URLs at most, those with the smallest hashes.
TRAINING_ROWS = 20_000
#: Number of labels of the host that make its suffix.
SUFFIX_LABELS = 2
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "hyphen_ratio", "entropy", "parameters",
    "has_fragment", "secure", "suffix_share", "suffix_length", "suffix_depth", "suffix_digits", "suffix_parameters",
)


def url_parts(url="url"):
    """``(host, path)`` columns; both empty for null or where no ``://`` occurs."""
    whole = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(whole, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(rules=RULES):
    """The longest rule that fits ``host`` and ``path``, else null."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        host, slash, path = rule.partition("/")
        inside = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        fits.append(F.when(inside & F.startswith("path", F.lit(slash + path)), F.lit(rule)))
    return F.coalesce(*fits)


def lexical_features(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, host, path)`` with the columns of FEATURES and ``suffix``."""
    n = F.greatest(F.length("whole"), F.lit(1))
    # One pass per distinct character: a URL has few.
    share = "(length(whole) - length(replace(whole, c, ''))) / length(whole)"
    entropy = F.expr(
        f"aggregate(filter(array_distinct(split(whole, '')), c -> c <> ''), 0D, (a, c) -> a - {share} * log2({share}))"
    )
    own = pages.withColumn("whole", F.coalesce("url", F.lit(""))).withColumns({
        "url_length": F.length("whole").cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
        "host_labels": F.regexp_count("host", F.lit("[^.]+")).cast("double"),
        "digit_ratio": F.regexp_count("whole", F.lit("[0-9]")) / n,
        "hyphen_ratio": F.regexp_count("whole", F.lit("[-_]")) / n,
        "entropy": entropy,
        "parameters": F.regexp_count("whole", F.lit("[?&][^?&#=]+=")).cast("double"),
        "has_fragment": F.contains("whole", F.lit("#")).cast("double"),
        "secure": F.startswith("whole", F.lit("https")).cast("double"),
        "suffix": F.substring_index("host", ".", -SUFFIX_LABELS),
    })
    # Statistics of a suffix are summed before the shuffle; a suffix with most URLs is one row a task.
    by_suffix = own.groupBy("suffix").agg(
        F.count("*").alias("suffix_urls"),
        *[F.avg(c).alias(s) for c, s in (
            ("url_length", "suffix_length"), ("depth", "suffix_depth"), ("digit_ratio", "suffix_digits"), ("parameters", "suffix_parameters"),
        )],
    )
    total = pages.agg(F.count("*").alias("all_urls")).first().all_urls
    return own.join(by_suffix, "suffix").withColumn("suffix_share", F.log1p("suffix_urls") / F.log1p(F.lit(float(max(total, 1)))))


def judge(pages: DataFrame, rules=RULES, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``: the rule's verdict, else that of the trees (block from 0.5 on).

    ``score`` is the trees' probability of a block (null where no trees could be trained). Null URLs and URLs without
    ``://`` have an empty host and path, fit no rule and are scored by their features. If the rules label no URL, or
    all alike, there is nothing to learn: other URLs are allowed. The trees are fitted on at most ``training_rows`` distinct
    labelled URLs, half of them for each verdict. Repeated rows are judged alike; an empty table gives
    no rows. Columns other than page_id and url are not read.
    """
    host, path = url_parts()
    parsed = pages.select("page_id", "url").withColumns({"host": host, "path": path}).withColumn("rule", matching_rule(rules))
    ready = keep(lexical_features(parsed).select("page_id", "url", "host", "path", "rule", *FEATURES))
    verdicts = {rule: verdict for rule, verdict in rules}
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in verdicts.items()])
    # One row a URL, so that copies of one don't fill the sample; half of it for each verdict, so that both are there.
    labelled = keep(
        ready.where("rule is not null").withColumn("label", (by_rule == "block").cast("double")).dropDuplicates(["url"]).select("url", "label", *FEATURES)
    )
    half = max(1, training_rows // 2)
    sampled = labelled.limit(0)
    for found in labelled.groupBy("label").agg(F.count("*").alias("n")).collect():
        # A share of the URLs by one hash leaves about twice as many as wanted, the smallest of another one are taken.
        share = min(1 << 20, (2 * half << 20) // found.n + 1)
        own = labelled.where((F.col("label") == found.label) & (F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < share))
        sampled = sampled.union(own.orderBy(F.xxhash64("url", F.lit(5)), "url").limit(half))
    training = keep(sampled.select("label", *FEATURES))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    if training.agg(F.count_distinct("label").alias("n")).first().n < 2:
        scored = ready.withColumn("score", F.lit(None).cast("double"))
    else:
        trees = GBTClassifier(maxIter=20, maxDepth=4, seed=5, featuresCol="features", labelCol="label")
        model = trees.fit(vectors.transform(training))
        scored = model.transform(vectors.transform(ready)).withColumn("score", vector_to_array("probability")[1])
    learned = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce(by_rule, learned).alias("verdict"), "score")


@query("op5_url_trees")
def run(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))
