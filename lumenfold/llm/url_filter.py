"""URL filtering: rules, and for the rest a ratio of two character language models.

Rules block or allow a host with all its subdomains below a path prefix; the longest that fits wins. URLs that
rules decide train two variable-order Markov models over characters, one of accepted and one of rejected URLs:
every context of up to `order` characters, each order smoothed towards the next lower one. Counts are of hosts, not
of URLs, so that a host with many pages says no more than one with few. The mean over characters of the
log-likelihood difference judges the others.

What rules can match is left out of every URL's characters alike, or the models would learn the rules: labels that
a rule's host has, from the end of the host, and as many first parts of the path as the deepest rule has.

The threshold is calibrated on hosts that the models haven't seen: hosts are dealt into two folds, each is scored
with the counts of the other one, and at most a share `error` of the accepted URLs may lie above the threshold.
Verdicts come from the counts of both folds, so a host whose other URLs were rejected is judged by them, too.

DataFrame operations only: n-grams are counted over all URLs, with sums made before the shuffle, and each distinct
URL is scored by a join of its n-grams with the models. Models grow with the n-grams of the input and are never
gathered in one place; the driver gets a histogram of scores in steps of 0.001.

Defined results: a null URL, or one without "://", has an empty host and path; empty characters are scored like
any others; a score at the threshold is allowed; repeated rows are each judged; if either class has no URL, the
method allows, as it does if all accepted URLs are in one fold; the empty table gives the empty table; other columns
are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

# The contract's rules (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Marks the begin and the end of a URL's characters.
BEGIN, FINAL = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def deciding_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<action, host, path> of the longest rule that fits, or null; equally long ones: the first given."""
    found = F.lit(None)
    out = None
    for action, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(action).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return found.cast("struct<action:string,host:string,path:string>") if out is None else out


def grams(text: Column, order: int) -> Column:
    """Every character of the marked text with the `order` characters before it."""
    marked = F.concat(F.lit(BEGIN * order), text, F.lit(FINAL))
    return F.transform(F.sequence(F.lit(1), F.length(marked) - order), lambda i: marked.substr(i, F.lit(order + 1)))


def _tails(gram: Column, order: int) -> Column:
    """The gram with shorter and shorter contexts."""
    return F.array(*[F.substring(gram, order + 1 - k, k + 1) for k in range(order + 1)])


def without_rules(host: str, path: str, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Host and path (names of columns) without what rules can match."""
    labels = "|".join(sorted({re.escape(x) for _, h, _ in rules for x in h.split(".")}))
    deepest = max((p.count("/") - 1 for _, _, p in rules), default=0)
    parted = F.regexp_replace(host, rf"(?:(?:^|\.)(?:{labels}))+$", "") if labels else F.col(host)
    return parted, F.regexp_replace(path, rf"^(?:/[^/]*){{0,{max(0, deepest)}}}", "")


COUNTS = ("r0", "r1", "a0", "a1")  # hosts with rejected and with accepted URLs, by fold


def log_ratios(types: DataFrame, seen: DataFrame, order: int, strength: float) -> DataFrame:
    """types: gram; seen: gram, host, COUNTS (0 or 1) -> gram and log P(last | before) of rejected less accepted: ratio by all hosts, without0 and without1 by the other fold's."""
    by_host = seen.select(F.explode(_tails(F.col("gram"), order)).alias("tail"), "host", *COUNTS).groupBy("tail", "host").agg(*[F.max(c).alias(c) for c in COUNTS])
    ends = by_host.groupBy("tail").agg(*[F.sum(c).alias(c) for c in COUNTS])
    before = F.expr("left(tail, length(tail) - 1)")
    contexts = ends.groupBy(before.alias("context")).agg(*[F.sum(c).alias(f"c{c}") for c in COUNTS])
    asked = types.select("gram", F.explode(_tails(F.col("gram"), order)).alias("tail")).join(ends, "tail", "left").withColumn("context", before)
    # one in order + 1 rows has the empty context: its sums are one row, which is broadcast; the others are parted by their contexts
    none = asked.where("context = ''").join(F.broadcast(contexts.where("context = ''")), "context", "left")
    found = asked.where("context <> ''").join(contexts, "context", "left").unionByName(none).na.fill(0, [*COUNTS, *[f"c{c}" for c in COUNTS]])
    chain = found.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct(F.length("tail").alias("n"), *COUNTS, *[f"c{c}" for c in COUNTS]))).alias("levels"))  # order + 1 levels

    def ratio(folds: tuple[int, ...]) -> Column:
        total = lambda level, c: sum((level[f"{c}{k}"] for k in folds[1:]), level[f"{c}{folds[0]}"])
        p = F.aggregate(
            "levels", F.struct(F.lit(1 / 256).alias("r"), F.lit(1 / 256).alias("a")),
            lambda x, level: F.struct(*[((total(level, c) + strength * x[c]) / (total(level, f"c{c}") + strength)).alias(c) for c in "ra"]),
        )
        return F.log(p["r"]) - F.log(p["a"])

    return chain.select("gram", ratio((0, 1)).alias("ratio"), ratio((1,)).alias("without0"), ratio((0,)).alias("without1"))


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules: Sequence[tuple[str, str, str]] = RULES, order: int = 3, strength: float = 5.0, error: float = 0.01
) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict, score (of the models)."""
    work = Workspace(pages.sparkSession, "urls")
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), url.alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    site, rest = without_rules("host", "path", rules)
    rows = rows.withColumn("by", deciding_rule(F.col("host"), F.col("path"), rules)).withColumn("site", site).withColumn("chars", F.concat("site", rest))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat_ws("\n", "site", "chars"))))
    count = lambda action: F.count_if(F.col("by.action") == action)
    texts = rows.groupBy("key").agg(F.first("chars").alias("chars"), F.xxhash64(F.first("site")).alias("host"), count("block").alias("rejected"), count("allow").alias("accepted"))
    texts = work.write(texts.withColumn("fold", F.pmod("host", F.lit(2))), "urls")
    name = F.concat("by.host", "by.path")
    known = texts.groupBy("fold").agg(F.sum("rejected").alias("r"), F.sum("accepted").alias("a")).collect()  # two rows
    if not (sum(k["r"] for k in known) and sum(k["a"] for k in known)):
        return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce("by.action", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    each = texts.select("key", "host", "fold", "rejected", "accepted", F.explode(grams(F.col("chars"), order)).alias("gram"))
    flag = lambda c, k: F.max(((F.col(c) > 0) & (F.col("fold") == k)).cast("int"))
    seen = work.write(each.groupBy("gram", "host").agg(*[flag({"r": "rejected", "a": "accepted"}[c[0]], int(c[1])).alias(c) for c in COUNTS]), "grams")
    ratios = work.write(log_ratios(seen.select("gram").distinct(), seen.where("r0 + r1 + a0 + a1 > 0"), order, strength), "ratios")
    unseen = F.when(F.col("fold") == 0, F.col("without0")).otherwise(F.col("without1"))
    scores = work.write(each.join(ratios, "gram").groupBy("key").agg(F.avg("ratio").alias("score"), F.avg(unseen).alias("unseen"), F.first("accepted").alias("accepted")), "scores")
    steps = scores.where("accepted > 0").groupBy(F.ceil(F.col("unseen") * 1000).alias("step")).agg(F.sum("accepted").alias("n")).collect()  # |score| is under 20 or so: at most some 40,000 steps
    above, threshold, total = 0, None, sum(r["n"] for r in steps)
    for r in sorted(steps, key=lambda r: -r["step"]):
        threshold = r["step"] / 1000
        above += r["n"]
        if above > error * total:
            break
    judged = rows.join(scores.select("key", "score"), "key")
    blocked = F.col("score") > threshold if all(k["a"] for k in known) and len(known) == 2 else F.lit(False)
    verdict = F.coalesce(F.col("by.action"), F.when(blocked, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), "score")
