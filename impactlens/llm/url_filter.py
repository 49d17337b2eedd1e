"""URL filter: rules where they reach, a character language-model ratio elsewhere.

A rule ``host/path`` fits its host and all subdomains where the URL's path
starts with the rule's; the longest fitting rule decides. The other URLs are
judged by two variable-order Markov models over characters, one of the URLs
that rules accept, one of those they reject: a model's probability of a
character mixes the counts after its longest known context with those after
every shorter one, each by the number of different characters seen there
(Witten-Bell), down to equal shares of all characters. A URL's score is the
mean of the log ratios (accepted to rejected) of its characters and its end, so
long URLs weigh no more than short ones. The threshold is calibrated on rule
URLs that were kept out of the models: the cut with the fewest errors of both
kinds, each as a share of its class, in the middle between its neighbours.

Everything is DataFrame work: one pass counts the distinct windows of ORDER + 1
characters, all shorter contexts come from those, and every window gets its log
ratio once, in millionths, so sums are exact in any order. The windows of the
URLs to judge are joined to that table, which Spark broadcasts only while its
stored size allows; beyond that it is a sort-merge join in which adaptive
execution splits a window that very many URLs share.

Defined results: a null URL, or one without ``://``, has an empty host and an
empty path, fits no rule and is judged as its text (null: empty). Without URLs
of both kinds outside the models the threshold is 0; without any model every
score is 0 and the verdict allow. Equal URLs get equal verdicts, each row one;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

ORDER = 4
MILLION = 1_000_000
#: Width of the calibration's bins, in millionths (scores lie within +-20).
BIN = 10_000
_START, _END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(rules: dict[str, str], host: Column, path: Column) -> Column:
    """The longest rule that fits, else null. For lists of rules short enough
    to be one expression."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def windows(rows: DataFrame, text: str, *keep: str, order: int = ORDER) -> DataFrame:
    """One row per character of ``text`` and one for its end: ``keep`` and the
    ``window`` of the ``order`` characters before it and itself."""
    chars = F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    padded = rows.select(*keep, F.concat(F.array_repeat(F.lit(_START), order), chars, F.array(F.lit(_END))).alias("_chars"))
    several = F.arrays_zip(*[F.slice("_chars", 1 + i, F.size("_chars") - order).alias(f"_c{i}") for i in range(order + 1)])
    return (padded.select(*keep, F.inline(several))
            .select(*keep, F.concat(*[f"_c{i}" for i in range(order + 1)]).alias("window")))


def _grams(rows: DataFrame, order: int, *columns: str) -> DataFrame:
    """Every row once for each length of context, with that end of its window."""
    return (rows.select("window", *columns, F.explode(F.sequence(F.lit(1), F.lit(order + 1))).alias("n"))
            .withColumn("gram", F.expr("right(window, n)")))


def log_ratios(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(window, ratio): the log ratio, in millionths, of the last character of
    every window, from its numbers of accepted and rejected places."""
    grams = _grams(counted, order, "accepted", "rejected").groupBy("gram").agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    context = F.expr("left(gram, length(gram) - 1)")
    known = [F.struct(F.sum(c).alias("places"), F.count_if(F.col(c) > 0).alias("kinds")).alias(f"all_{c}")
             for c in ("accepted", "rejected")]
    contexts = grams.groupBy(context.alias("context")).agg(*known, F.count(F.lit(1)).alias("symbols"))
    told = grams.join(contexts, context == F.col("context")).select(
        "gram", "symbols", *(F.struct(F.col(c).alias("here"), f"all_{c}.places", f"all_{c}.kinds").alias(c)
                             for c in ("accepted", "rejected")))
    steps = (_grams(counted, order).join(told, "gram").groupBy("window")
             .agg(F.array_sort(F.collect_list(F.struct("n", "accepted", "rejected", "symbols"))).alias("steps")))

    def probability(model: str) -> Column:
        def longer(p, step):
            s = step[model]
            return F.when(s["places"] > 0, (s["here"] + s["kinds"] * p) / (s["places"] + s["kinds"])).otherwise(p)
        # The shortest context is the empty one: its symbols are all there are.
        return F.reduce("steps", F.lit(1.0) / (F.get("steps", F.lit(0))["symbols"] + 1), longer)

    ratio = F.log(probability("accepted")) - F.log(probability("rejected"))
    return steps.select("window", F.round(ratio * MILLION).cast("long").alias("ratio"))


def calibrate(scored: DataFrame) -> int:
    """The threshold, in millionths, from (accepted boolean, total, places):
    the cut between two bins that hold scores with the least sum of both error
    shares, in the middle of the gap; the nearest to 0 of equals."""
    bins = scored.groupBy(F.floor(F.col("total") / F.col("places") / BIN).alias("bin")).agg(
        F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.coalesce(F.lag("bin").over(Window.orderBy("bin")) + 1, F.col("bin"))
    sums = bins.select(((gap + F.col("bin")) * (BIN // 2)).alias("cut"), F.coalesce(F.sum("good").over(below), F.lit(0)).alias("lost"),
                       F.coalesce(F.sum("bad").over(below), F.lit(0)).alias("caught"),
                       F.sum("good").over(whole).alias("goods"), F.sum("bad").over(whole).alias("bads"))
    errors = F.col("lost") * F.col("bads") + (F.col("bads") - F.col("caught")) * F.col("goods")
    best = sums.where("goods > 0 and bads > 0").orderBy(errors, F.abs("cut"), "cut").first()
    return best["cut"] if best else 0


def judge_urls(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url",
               order: int = ORDER) -> DataFrame:
    """One row per page: host, path, rule, verdict, and for pages without a
    rule score (mean log ratio in millionths, as total / places)."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    parsed = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    said = F.create_map(*[F.lit(x) for item in rules.items() for x in item])
    held_out = F.substring(F.md5("url"), 1, 1).isin("0", "1", "2")
    urls = materialise(
        parsed.withColumn("rule", rule_of(rules, F.col("host"), F.col("path")))
        .withColumn("accepted", said[F.col("rule")] == "allow")
        .withColumn("learnt", F.col("rule").isNotNull() & ~held_out)
        .withColumn("text", F.translate(F.regexp_replace("url", "(?s)^.*?://", ""), _UPPER, _LOWER))
        .drop("url").withColumn("row", F.monotonically_increasing_id()), "urls")

    counted = materialise(windows(urls, "text", "accepted", "learnt", order=order).groupBy("window").agg(
        F.count_if(F.col("learnt") & F.col("accepted")).alias("accepted"),
        F.count_if(F.col("learnt") & ~F.col("accepted")).alias("rejected")), "url-windows")
    ratios = materialise(log_ratios(counted, order), "url-ratios")
    asked = windows(urls.where("not learnt"), "text", "row", "page_id", "host", "path", "rule", "accepted", order=order)
    scored = materialise(asked.join(ratios, "window").groupBy("row", "page_id", "host", "path", "rule", "accepted").agg(
        F.sum("ratio").alias("total"), F.count(F.lit(1)).alias("places")), "url-scores")
    threshold = calibrate(scored.where("rule is not null"))

    none = F.lit(None).cast("long")
    ruled = urls.where("rule is not null").select(
        "page_id", "host", "path", "rule", said[F.col("rule")].alias("verdict"), none.alias("total"), none.alias("places"))
    judged = scored.where("rule is null").select(
        "page_id", "host", "path", "rule",
        F.when(F.col("total") >= F.col("places") * threshold, "allow").otherwise("block").alias("verdict"), "total", "places")
    return ruled.unionByName(judged).withColumnRenamed("page_id", id_col)
