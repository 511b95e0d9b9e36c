"""URL filters: rules, and a path-template tree for everything no rule decides.

*Tree.* Each host has a tree of path segments. Level by level, a segment stays as
it is if it holds at least ``SHARE`` of the urls that reached its parent and
``SUPPORT`` urls; any other one is generalised to a wildcard for its shape (digits,
letters, other; an ending after the last dot is kept). Segments below ``DEPTH``
levels fall under one ``**``.

*Merging.* A template whose share of good labels does not differ from that of the
host's other labelled urls by more than ``DEVIATION`` standard errors is merged
with them: all such templates of a host are judged together.

*Purity.* The share of good labels of a branch is smoothed by ``PRIOR`` labels that
are as good as all labels on average; a branch below ``PURITY`` is blocked.
Without any label the average is taken as 1, so nothing is blocked.

Counting is by partial aggregation on (host, template, segment); no host, however
large, meets in one task. Null and malformed urls have an empty host and path and
form a branch of their own. Repeated pages are judged alike and kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import materialise

SHARE, SUPPORT, DEPTH = 0.02, 20, 4
PRIOR, PURITY, DEVIATION = 10.0, 0.5, 2.0
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    allow: bool
    prefix: str  # host/path

    @property
    def host(self) -> str:
        return self.prefix.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.prefix.partition("/")[2]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` in small letters, and path up to ``?`` or ``#``; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.coalesce(F.substring(url, F.length(rest) + 4, F.length(url)), F.lit(""))
    return F.translate(F.regexp_extract(after, "^[^/?#]*", 0), CAPITALS, SMALL), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: list[Rule]) -> Column:
    """(allow, prefix) of the longest rule that fits columns ``host`` and ``path``; null if none does."""
    found = F.lit(None).cast("struct<allow:boolean,prefix:string>")
    for rule in sorted(rules, key=lambda r: (len(r.prefix), r.prefix)):  # later ones are longer and win
        fits = ((F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))) & F.startswith(F.col("path"), F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.allow).alias("allow"), F.lit(rule.prefix).alias("prefix"))).otherwise(found)
    return found


def wildcard(segment: Column) -> Column:
    """Shape of a segment: ``*9`` for digits, ``*a`` for letters, ``*`` for others, with a short ending."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z0-9]{1,5})$", 1)
    stem = F.substring(segment, F.lit(1), F.length(segment) - F.length(ending))
    shape = F.when(stem.rlike(r"^[0-9]+$"), F.lit("*9")).when(stem.rlike(r"^[A-Za-z]+$"), F.lit("*a")).when(stem == "", F.lit("")).otherwise(F.lit("*"))
    return F.concat(shape, ending)


def templates(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Add ``template`` to rows with ``host`` and ``path``."""
    rows = pages.withColumn("__segments", F.split(F.regexp_replace("path", "^/", ""), "/")).withColumn("template", F.lit(""))
    for level in range(1, depth + 1):
        segment = F.get("__segments", F.lit(level - 1))
        rows = materialise(rows.withColumn("__segment", segment))  # read three times below; else each level would repeat all before it
        counts = rows.where("__segment IS NOT NULL").groupBy("host", "template", "__segment").agg(F.count("*").alias("__n"))
        totals = counts.groupBy("host", "template").agg(F.sum("__n").alias("__all"))
        literal = (
            counts.join(totals, ["host", "template"])
            .where((F.col("__n") >= SUPPORT) & (F.col("__n") >= SHARE * F.col("__all")))
            .select("host", "template", "__segment", F.lit(True).alias("__literal"))
        )
        step = F.when(F.col("__literal"), F.col("__segment")).otherwise(wildcard(F.col("__segment")))
        rows = (
            rows.join(literal, ["host", "template", "__segment"], "left")
            .withColumn("template", F.when(F.col("__segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), step)))
            .drop("__segment", "__literal")
        )
    deeper = F.size("__segments") > depth
    return rows.withColumn("template", F.when(deeper, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop("__segments")


def branches(rows: DataFrame) -> DataFrame:
    """(host, template, branch, labelled, purity) from rows with host, template and label (1 good, 0 not, or null)."""
    leaves = rows.groupBy("host", "template").agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).cast("double").alias("good"))
    hosts = leaves.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    mean = leaves.agg(F.coalesce(F.sum("good") / F.nullif(F.sum("n"), F.lit(0)), F.lit(1.0)).alias("mean"))
    others = F.col("host_n") - F.col("n")
    rest = (F.col("host_good") - F.col("good")) / F.nullif(others, F.lit(0))
    own = F.col("good") / F.nullif(F.col("n"), F.lit(0))
    pooled = F.col("host_good") / F.nullif(F.col("host_n"), F.lit(0))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(F.col("n"), F.lit(0)) + 1 / F.nullif(others, F.lit(0))))
    alike = F.coalesce(F.abs(own - rest) <= DEVIATION * error, F.lit(True))
    named = leaves.join(hosts, "host").withColumn("branch", F.when(alike, F.lit("**")).otherwise(F.col("template")))
    judged = named.groupBy("host", "branch").agg(F.sum("n").alias("labelled"), F.sum("good").alias("__good"))
    purity = (F.col("__good") + PRIOR * mean.scalar()) / (F.col("labelled") + PRIOR)
    return named.select("host", "template", "branch").join(judged.select("host", "branch", "labelled", purity.alias("purity")), ["host", "branch"])


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, template, branch, labelled, purity of every page.

    ``labels`` has (id, label): the first number in a url's path names the id.
    Labels of equal id count as one, good if any is; null labels are left out.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path")).withColumn("id", F.expr(r"try_cast(nullif(regexp_extract(path, '([0-9]+)', 1), '') AS bigint)"))
    known = labels.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    tree = materialise(templates(rows.join(known, "id", "left").drop("id")))
    parts = branches(tree)
    rule = longest_rule(rules)
    judged = tree.join(parts, ["host", "template"]).withColumn("__rule", rule)
    allow = F.coalesce(F.col("__rule.allow"), F.col("purity") >= PURITY)
    return judged.select(
        "page_id", "host", "path", F.col("__rule.prefix").alias("rule"), F.when(allow, F.lit("allow")).otherwise(F.lit("block")).alias("verdict"), "template", "branch", "labelled", F.round("purity", 6).alias("purity")
    )
