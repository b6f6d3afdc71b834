"""URL filter: rules first, then the ratio of two character language models.

Accepted and rejected URLs are those that a rule allows or blocks.  For each class a variable-order Markov model
gives the probability of a character after up to ``ORDER`` characters: counts of the longest context are smoothed by
the next shorter one, down to the uniform distribution.  A URL's score is the mean over its characters of the log
probability under the accepted model minus that under the rejected one, compared with a threshold that is calibrated
on labelled URLs the models have not seen.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import lower_ascii, store

ORDER = 4
WEIGHT = 2.0  # how many observations the shorter context counts as
ALPHABET = 256.0
HOLD = 5  # one labelled URL in so many calibrates the threshold
STEP = 0.01  # thresholds tried
PAD = "\x02"
PIECE = 2048  # characters of a long URL that are cut into contexts together
#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for URLs without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def whole(url: Column) -> Column:
    """The text that the models read: the whole URL with scheme and host lower-cased; empty for null."""
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.coalesce(F.concat(lower_ascii(head), F.substring(url, F.length(head) + 1, F.length(url))), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, of equals the first; nulls when none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def contexts(text: Column, order: int = ORDER) -> Column:
    """Every character of a text with the ``order`` characters before it, padded at the front; none for an empty text.

    A substring is found by counting from the front, so long texts are cut into overlapping pieces first.
    """
    padded = F.concat(F.lit(PAD * order), text)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(PIECE))
    pieces = F.transform(starts, lambda at: F.substring(padded, at + 1, F.lit(PIECE + order)))
    grams = F.flatten(F.transform(pieces, lambda piece: F.transform(F.sequence(F.lit(1), F.length(piece) - order), lambda i: F.substring(piece, i, F.lit(order + 1)))))
    return F.when(F.length(text) > 0, grams).otherwise(F.array().cast("array<string>"))


def log_ratios(urls: DataFrame, order: int = ORDER, weight: float = WEIGHT) -> DataFrame:
    """(text, n_allow, n_block) -> (gram, ratio) for every gram of ``order`` + 1 characters of any URL.

    ``n_allow`` and ``n_block`` count the URLs with that text which train either model.
    """
    sides = ("allow", "block")
    grams = urls.select(F.explode(contexts(F.col("text"), order)).alias("gram"), "n_allow", "n_block")
    grams = store(grams.groupBy("gram").agg(*[F.sum(f"n_{s}").alias(f"n_{s}") for s in sides]), "url-grams")
    level = None
    for k in range(order + 1):
        counts = grams.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("g")).agg(*[F.sum(f"n_{s}").alias(f"n_{s}") for s in sides])
        seen = counts.groupBy(F.substring("g", 1, k).alias("c")).agg(*[F.sum(f"n_{s}").alias(f"t_{s}") for s in sides])
        counts = counts.withColumn("c", F.substring("g", 1, k)).join(seen.hint("merge"), "c")
        if level is None:
            shorter = counts.select("*", *[F.lit(1 / ALPHABET).alias(f"p_{s}") for s in sides])
        else:
            shorter = counts.withColumn("tail", F.substring("g", 2, k)).join(level.hint("merge"), "tail")
        level = shorter.select(F.col("g").alias("tail"), *[((F.col(f"n_{s}") + weight * F.col(f"p_{s}")) / (F.col(f"t_{s}") + weight)).alias(f"p_{s}") for s in sides])
    return level.select(F.col("tail").alias("gram"), (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def scores(urls: DataFrame, ratios: DataFrame, order: int = ORDER) -> DataFrame:
    """(text) -> (text, score): mean log ratio per character, rounded so that the order of addition cannot show."""
    grams = urls.select("text", F.explode(contexts(F.col("text"), order)).alias("gram"))
    return grams.join(ratios.hint("merge"), "gram").groupBy("text").agg(F.round(F.avg("ratio"), 9).alias("score"))


def threshold(labelled: DataFrame, step: float = STEP) -> DataFrame:
    """(score, n_allow, n_block) -> one row ``limit``: the grid value with the best balanced accuracy, the nearest to zero of equals.

    Without URLs of both classes the limit is zero.
    """
    bins = labelled.groupBy(F.floor(F.col("score") / step).alias("bin")).agg(F.sum("n_allow").alias("a"), F.sum("n_block").alias("b"))
    steps = F.sort_array(F.collect_list(F.struct("bin", "a", "b")))  # one entry per grid value between the extreme scores
    packed = bins.agg(steps.alias("s"), F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    best = F.transform("s", lambda x: F.struct(
        (F.aggregate(F.filter("s", lambda y: y["bin"] >= x["bin"]), F.lit(0).cast("double"), lambda t, y: t + y["a"]) / F.col("all_a")
         + F.aggregate(F.filter("s", lambda y: y["bin"] < x["bin"]), F.lit(0).cast("double"), lambda t, y: t + y["b"]) / F.col("all_b")).alias("good"),
        (-F.abs(x["bin"])).alias("near"), (x["bin"] * step).alias("limit")))
    return packed.select(F.coalesce(F.when((F.col("all_a") > 0) & (F.col("all_b") > 0), F.array_max(best)["limit"]), F.lit(0.0)).alias("limit"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per input row: ``page_id``, ``host``, ``path``, ``rule``, ``score``, ``verdict``.

    URLs under a rule get its verdict; the others are allowed when their score reaches the threshold.  Rules look at host and path,
    the models at the whole URL with its scheme, query and fragment.  URLs without ``://`` have an empty host and path and
    are scored like all others; null and empty ones are no evidence either way: score zero.  With no labelled
    URL on a side both models are alike in what they lack, and the threshold is zero.  Repeated URLs count as
    often as they occur and are judged alike; an empty table gives an empty result.  Other columns are ignored.
    """
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), whole(F.col(url_col)).alias("text"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    texts = rows.groupBy("text", "host", "path").agg(F.count("*").alias("n"))
    texts = texts.select("text", "n", rule.alias("rule"), verdict.alias("ruled"))
    texts = store(texts.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(HOLD)) == 0), "url-texts")
    trained = texts.select("text", *[F.when((F.col("ruled") == s) & ~F.col("held"), F.col("n")).otherwise(0).alias(f"n_{s}") for s in ("allow", "block")])
    ratios = log_ratios(trained)
    scored = store(scores(texts.where("text <> '' and (ruled is null or held)").select("text").distinct(), ratios), "url-scores")
    check = texts.where("held and ruled is not null").join(scored.hint("merge"), "text").select("score", *[F.when(F.col("ruled") == s, F.col("n")).otherwise(0).alias(f"n_{s}") for s in ("allow", "block")])
    limit = threshold(check).scalar()
    judged = texts.join(scored.hint("merge"), "text", "left").select("text", "rule", "ruled", F.coalesce("score", F.lit(0.0)).alias("score"))
    judged = judged.withColumn("verdict", F.coalesce("ruled", F.when(F.col("score") >= limit, "allow").otherwise("block")))
    return rows.join(judged.drop("ruled").hint("merge"), "text").select("page_id", "host", "path", "rule", "verdict", "score")
