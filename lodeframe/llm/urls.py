"""URL verdicts: rules first, then a character language-model ratio.

Two variable-order Markov models over URL characters, one of accepted and one
of rejected URLs, give each character a probability after the up to
``ORDER`` characters before it. Orders are interpolated by Witten-Bell
smoothing; a context rarer than ``MIN_CONTEXT`` hands over to the next shorter
one. A URL's score is the mean difference of log probabilities, and the
threshold is calibrated on a held-out fifth of the labelled URLs.

Everything is DataFrame work. Characters fold to ``len(ALPHABET) + 1`` symbols,
so a gram of ORDER + 1 symbols is one long and there are at most
63 ** (ORDER + 1) of them whatever the data; only gram tables within
``BROADCAST_GRAMS`` are broadcast, others are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import ASCII_UPPER, settled

ORDER = 3
MIN_CONTEXT = 2
#: Symbols 1 to 42; digits fold to 0, anything else to symbol 43, and symbol 0 stands before the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0.-_/:?=&#%~+@,;"
OTHER = len(ALPHABET) + 1
BITS = 6
BROADCAST_GRAMS = 2_000_000
#: Scores fall into steps of this size when the threshold is sought.
STEP = 1e-3
#: (host, path prefix, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def host(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*", 0)
    return F.when(at > 0, F.translate(rest, ASCII_UPPER, ASCII_UPPER.lower())).otherwise(F.lit(""))


def path(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; both null if none fits. Of equally long rules a block wins."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] == "allow", r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = rule.when(fits, h + p) if rule is not None else F.when(fits, h + p)
        verdict = verdict.when(fits, v) if verdict is not None else F.when(fits, v)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of ``url``: the code of it and the ORDER symbols before it."""
    folded = F.translate(F.lower(F.col("url")), "123456789", "000000000")
    chars = F.filter(F.split(folded, ""), lambda c: c != "")
    codes = F.transform(chars, lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c)).otherwise(OTHER).cast("long"))
    u = urls.select(*keep, codes.alias("_codes"))

    def gram(c: Column, i: Column) -> Column:
        code = c
        for back in range(1, ORDER + 1):
            code = code + F.shiftleft(F.coalesce(F.get(F.col("_codes"), i - back), F.lit(0).cast("long")), BITS * back)
        return code

    return u.select(*keep, F.explode(F.transform("_codes", gram)).alias("gram"))


def _lower(order: int) -> Column:
    """The last ``order`` + 1 symbols of a gram."""
    return F.col("gram").bitwiseAND((1 << BITS * (order + 1)) - 1)


def gram_scores(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, diff): log P accepted - log P rejected of each gram of ``wanted``.

    ``counts``: (gram, accepted, rejected) of the training URLs. Tables here
    have at most one row a gram, so their size has the bound of the alphabet.
    """
    total = wanted.select("gram")
    prior = 1.0 / (OTHER + 1)
    total = total.withColumn("_pa", F.lit(prior)).withColumn("_pr", F.lit(prior))
    for order in range(ORDER + 1):
        code, context = _lower(order), F.shiftright(_lower(order), BITS)
        seen = counts.groupBy(code.alias("_code")).agg(F.sum("accepted").alias("_ca"), F.sum("rejected").alias("_cr"))
        ctx = seen.groupBy(F.shiftright("_code", BITS).alias("_ctx")).agg(F.sum("_ca").alias("_na"), F.sum("_cr").alias("_nr"), F.count(F.when(F.col("_ca") > 0, 1)).alias("_ta"), F.count(F.when(F.col("_cr") > 0, 1)).alias("_tr"))
        total = total.withColumn("_k", code).withColumn("_c", context)
        total = total.join(seen, F.col("_k") == F.col("_code"), "left").join(ctx, F.col("_c") == F.col("_ctx"), "left")
        for x in "ar":
            n, t, c = (F.coalesce(F.col(f"_{y}{x}"), F.lit(0)) for y in "ntc")
            smooth = (c + t * F.col(f"_p{x}")) / (n + t)
            total = total.withColumn(f"_p{x}", F.when(n >= (MIN_CONTEXT if order else 1), smooth).otherwise(F.col(f"_p{x}")))
        total = total.select("gram", "_pa", "_pr")
    return total.select("gram", (F.log("_pa") - F.log("_pr")).alias("diff"))


def url_scores(urls: DataFrame, labelled: DataFrame) -> tuple[DataFrame, float]:
    """(url, score) of each distinct non-null url, and the calibrated threshold.

    ``labelled``: (url, accepted boolean). Four in five of its distinct urls,
    by hash, train the models; the fifth gives the threshold: of the steps with
    the best sum of accepted kept and rejected dropped, the middle one. Without
    labels of both kinds the threshold is 0. An empty url has score 0.
    """
    distinct = urls.where("url is not null").select("url").distinct()
    labels = labelled.where("url is not null").groupBy("url").agg(F.max(F.col("accepted").cast("int")).alias("_y"))
    fold = F.pmod(F.xxhash64("url"), F.lit(5))
    counts = grams(labels.where(fold != 0), "_y").groupBy("gram").agg(F.sum("_y").alias("accepted"), F.sum(1 - F.col("_y")).alias("rejected"))
    counts = settled(counts)
    wanted = grams(distinct.select("url")).select("gram").distinct()
    model = settled(gram_scores(counts, wanted))
    small = F.broadcast if model.count() <= BROADCAST_GRAMS else (lambda x: x)
    scored = grams(distinct, "url").join(small(model), "gram").groupBy("url").agg(F.avg("diff").alias("score"))
    scored = settled(distinct.join(scored, "url", "left").select("url", F.coalesce("score", F.lit(0.0)).alias("score")))

    held = labels.where(fold == 0).join(scored, "url")
    steps = held.groupBy(F.floor(F.col("score") / STEP).alias("step")).agg(F.sum("_y").alias("good"), F.sum(1 - F.col("_y")).alias("bad"))
    # The mean of bounded log ratios: a few tens of thousands of steps at most.
    best, low, high, good, bad = None, 0.0, 0.0, 0, 0
    table = sorted((r.step, r.good, r.bad) for r in steps.collect())
    all_good, all_bad = sum(r[1] for r in table), sum(r[2] for r in table)
    if not all_good or not all_bad:
        return scored, 0.0
    good, bad = all_good, 0
    for step, g, b in table:
        won = good / all_good + bad / all_bad
        if best is None or won > best:
            best, low, high = won, step, step
        elif won == best:
            high = step
        good, bad = good - g, bad + b
    return scored, (low + high) / 2 * STEP


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict, url_score.

    A url is judged by the longest rule that fits, else allowed if its score
    reaches the threshold. ``labelled`` defaults to the urls that rules decide.
    A null url has empty host and path, no rule, no score, and is blocked;
    repeated urls share one judgement; an empty table gives none. Existing
    columns of these names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "url_score")
    url = F.col("url")
    p = pages.withColumn("host", F.coalesce(host(url), F.lit(""))).withColumn("path", F.coalesce(path(url), F.lit("")))
    rule, ruling = ruled(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", rule).withColumn("_ruling", ruling)
    if labelled is None:
        labelled = p.where("_ruling is not null").select("url", (F.col("_ruling") == "allow").alias("accepted"))
    scored, threshold = url_scores(p, labelled)
    scored = scored.select(F.col("url").alias("_url"), F.col("score").alias("url_score"))
    p = p.join(scored, F.col("url") == F.col("_url"), "left").drop("_url")
    method = F.when(F.col("url_score") >= threshold, "allow").otherwise("block")
    return p.withColumn("verdict", F.coalesce("_ruling", method)).select(*pages.columns, "host", "path", "rule", "verdict", "url_score")
