"""URL filtering: longest matching rule first, gradient-boosted trees on lexical features for the rest.

A rule names a host, with all its subdomains, and a path prefix; the longest that fits wins. URLs that a rule decides
are the labelled ones: boosted trees learn from at most `SAMPLE` of them what allowed and blocked URLs look like
(lengths, depth, digit and sign ratios, entropy, parameters, statistics of the host's suffix), and decide where no
rule fits. Suffix statistics count blocked and labelled URLs over all rows in a fixed number of buckets. A labelled URL
gets them from the folds that it isn't in, so its own label is no part of its features; other URLs get them from all folds.

Nulls and odd rows: a null URL or one without ``://`` has an empty host and path and no rule; a null ``page_id``
stays null; repeated rows are judged each; without URLs of both verdicts the trees' verdict is the one verdict there
is, or ``allow``; an empty table gives an empty result. Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Labelled URLs that the trees are fitted on, at most, and buckets of suffix statistics.
SAMPLE, SUFFIX_BUCKETS = 6000, 1024
#: Folds of the suffix statistics, by a hash of the URL.
FOLDS = 5
_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789-._/?&=#%:~+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host between ``://`` and the next ``/``, ``?`` or ``#`` with A-Z lower-cased; path up to ``?`` or ``#``."""
    after = F.expr("CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest of ``rules`` (verdict, host, path) that fits; null if none does.

    Rules are a list of the program, so the test is one expression on the row.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of a URL as numbers; everything stays in built-in expressions."""
    text = F.lower(F.coalesce(url, F.lit("")))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    count = lambda c, of=text: (F.length(of) - F.length(F.replace(of, F.lit(c), F.lit("")))).cast("double")
    digits = (F.length(text) - F.length(F.translate(text, "0123456789", ""))).cast("double")
    entropy = F.lit(0.0)
    for sign in _SIGNS:
        share = count(sign) / size
        entropy = entropy - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    return {
        "length": size, "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": count("/", path), "labels": count(".", host), "digit_ratio": digits / size, "entropy": entropy,
        "parameters": count("&") + count("?"), "signs": count("-") + count("_") + count("%"), "fragment": count("#"),
        "secure": text.startswith("https:").cast("double"),
        "first_part": F.pmod(F.xxhash64(F.regexp_extract(path, "^/([^/]*)", 1)), F.lit(32)).cast("double"),
        "ending": F.pmod(F.xxhash64(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)), F.lit(16)).cast("double"),
    }


def suffix_bucket(host: Column) -> Column:
    """Bucket of the host's last label."""
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -1)), F.lit(SUFFIX_BUCKETS)).cast("int")


def url_fold() -> Column:
    """Fold of a URL; copies share it."""
    return F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)).cast("int")


FEATURES = [
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "signs", "fragment", "secure", "first_part",
    "ending", "suffix_share", "suffix_count",
]


def with_features(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, url, host, path, rule, the rule's verdict (``ruled``), and the lexical features."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", ruled).withColumn("bucket", suffix_bucket(F.col("host")))
    rows = rows.withColumn("slot", F.when(F.col("ruled").isNotNull(), url_fold()).otherwise(FOLDS))
    found = rows.where("ruled IS NOT NULL").groupBy("bucket", "slot").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == BLOCK).alias("blocked"))
    table, total = {}, {}
    for r in found.collect():  # a row per bucket and fold at most
        table[r["bucket"], r["slot"]] = (r["n"], r["blocked"])
        n, blocked = total.get(r["bucket"], (0, 0))
        total[r["bucket"]] = (n + r["n"], blocked + r["blocked"])
    stats = []
    for bucket, (n, blocked) in total.items():
        for slot in range(FOLDS + 1):
            own, own_blocked = table.get((bucket, slot), (0, 0))
            stats.append((bucket, slot, (blocked - own_blocked + 1) / (n - own + 2), float((n - own).bit_length())))
    # Bounded by the number of buckets and folds.
    shares = F.broadcast(pages.sparkSession.createDataFrame(stats, "bucket int, slot int, share double, number double"))
    rows = rows.join(shares, ["bucket", "slot"], "left")
    values = lexical(F.col("url"), F.col("host"), F.col("path"))
    return rows.select(
        "page_id", "url", "host", "path", "rule", "ruled", *(v.alias(k) for k, v in values.items()),
        F.coalesce("share", F.lit(0.5)).alias("suffix_share"),
        F.coalesce("number", F.lit(0.0)).alias("suffix_count"),
    )


def train(rows: DataFrame, sample: int = SAMPLE) -> GBTClassificationModel | str:
    """Boosted trees on a bounded sample of the URLs that a rule decides, or the only verdict there is."""
    labelled = rows.where("ruled IS NOT NULL")
    counts = {r["ruled"]: r["count"] for r in labelled.groupBy("ruled").count().collect()}
    if len(counts) < 2:
        return next(iter(counts), ALLOW)
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, sample / 2 / n)))[F.col("ruled")]
    order = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30))
    chosen = labelled.where(order < share * (1 << 30)).orderBy(order, "page_id", "url").limit(2 * sample)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(chosen.withColumn("label", (F.col("ruled") == BLOCK).cast("double")))
    trees = GBTClassifier(maxIter=12, maxDepth=4, maxBins=32, seed=7, subsamplingRate=1.0)
    return trees.fit(vectors.select("features", "label").repartition(6))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, and the trees' share of block (null where a rule decided)."""
    rows = with_features(pages, rules)
    model = train(rows)
    if isinstance(model, str):
        scored = rows.withColumn("block_score", F.lit(1.0 if model == BLOCK else 0.0))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        scored = model.transform(vectors).withColumn("block_score", vector_to_array("probability")[1])
    by_trees = F.when(F.col("block_score") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_trees).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("block_score")).alias("block_score")
    )
