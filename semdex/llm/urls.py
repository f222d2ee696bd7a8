"""URL filter: stated rules first, then trees of path templates.

Segments of a path that look variable (digits, escapes, long) become wildcards, and so do rare ones.
Level by level, as deep as paths go, siblings whose shares of allowed and blocked pages differ alike
from their parent's are merged. Such a tree is grown for each host, and for the hosts that share the
last two labels, the last label, and for all hosts. The only labels are the rules' own verdicts.

A template's share of blocked pages is smoothed in this order: the table's share of blocked pages;
the page's branches in the tree of all hosts, from its root to the leaf, where pages without a label
count as good to the extent ``unlabelled_weight``; then its branches in each narrower tree, where only
labels count. So what the rules say of ``/es/`` on some hosts is evidence on ``/es/`` of others, as far
as these have none of their own. A template is rejected where the smoothed purity, one minus that
share, is at most ``least_purity``.

Everything is a Spark expression, a grouping or a join. Pages are grouped to distinct lexical
templates before any other work, so a hot host arrives as few rows; branches are classes of a
grouping, so the children of a template are never ordered or held together in a task.

Defined results: a null url, or one without "://", has an empty host and path and meets no rule but
is judged by the method like any other; repeated urls get the same verdict; an empty table gives an
empty result; columns other than page_id and url are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (verdict, host and path)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return host, path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null where none does."""
    name, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for kind, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0] == "allow", r[1])):
        of_host, slash, of_path = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + of_path)
        name, verdict = name.when(fits, F.lit(rule)), verdict.when(fits, F.lit(kind))
    return name, verdict


def lexical(segment: Column, longest: int = 24) -> Column:
    """The segment, or a wildcard with its file ending if it looks variable."""
    variable = segment.rlike(r"[0-9%]") | (F.length(segment) > longest)
    return F.when(variable, F.concat(F.lit("*"), F.regexp_extract(segment, r"\.[A-Za-z]{1,5}$", 0))).otherwise(segment)


_KEY = ("scope", "name", "template")


def _scoped(leaves: DataFrame) -> DataFrame:
    """Each leaf once for each of its scopes: all hosts, the host's last label, its last two, the host."""
    names = [F.lit(""), F.substring_index("host", ".", -1), F.substring_index("host", ".", -2), F.col("host")]
    scopes = F.array(*[F.struct(F.lit(i).alias("scope"), n.alias("name")) for i, n in enumerate(names)])
    return leaves.withColumn("_scope", F.explode(scopes)).select("_scope.*", "*").drop("_scope")


def _grown(leaves: DataFrame, least_support: int, z: float) -> DataFrame:
    """From (host, segments, n, good, bad): (scope, name, segments, template, path) of every scope's tree.

    ``path`` has the counts of the branches from the root's on. A level at a time, each open branch
    is split by the next segment: wildcards and rare segments are one branch; the others are merged
    where they differ alike from the whole in their shares of bad and of good pages, or don't differ.
    A branch stays open while it has the support for two and its pages aren't labelled alike.
    """
    sums = [F.sum(x).alias(x) for x in ("n", "good", "bad")]
    rows = _scoped(leaves).groupBy("scope", "name", "segments").agg(*sums)
    empty = F.array().cast("array<struct<n:bigint,good:bigint,bad:bigint>>")
    rows = materialize(rows.withColumns({"template": F.lit(""), "path": empty, "open": F.lit(True)}), "templates")
    level = 0
    while not (active := rows.filter(F.col("open") & (F.size("segments") > level))).isEmpty():
        kids = active.groupBy(*_KEY, F.get("segments", level).alias("segment")).agg(*sums)
        kids = materialize(kids, "templates")  # read three times, and joined by keys that may be hot
        whole = kids.groupBy(*_KEY).agg(*[F.sum(x).alias(f"_{x}") for x in ("n", "good", "bad")])
        kids = kids.join(whole, list(_KEY))

        def differs(x: str) -> Column:
            rate = F.col(f"_{x}") / F.col("_n")
            more = F.col(x) / F.col("n") - rate
            return F.when(F.abs(more) > z * F.sqrt(rate * (1 - rate) / F.col("n")), F.signum(more)).otherwise(0.0)

        loose = (F.col("n") < least_support) | (F.col("segment") == "*")
        kids = kids.withColumn("_branch", F.when(loose, F.lit("*")).otherwise(F.concat_ws(" ", differs("bad"), differs("good")))).drop("_n", "_good", "_bad")
        branches = kids.groupBy(*_KEY, "_branch").agg(F.count(F.lit(1)).alias("_members"), F.min("segment").alias("_least"), F.struct(*sums).alias("_counts"))
        label = F.when(F.col("_branch") == "*", F.lit("/*")).when(F.col("_members") == 1, F.concat(F.lit("/"), "_least")).otherwise(F.concat(F.lit("/{"), "_least", F.lit("~}")))
        alike = (F.col("_counts.bad") == F.col("_counts.n")) | (F.col("_counts.good") == F.col("_counts.n")) | (F.col("_counts.bad") + F.col("_counts.good") == 0)
        branches = branches.select(*_KEY, "_branch", label.alias("_label"), "_counts", (~alike & (F.col("_counts.n") >= 2 * least_support)).alias("_on"))
        step = materialize(kids.select(*_KEY, "segment", "_branch").join(branches, [*_KEY, "_branch"]).select(*[F.col(k).alias(f"_{k}") for k in _KEY], F.col("segment").alias("_segment"), "_label", "_counts", "_on"), "templates")
        same = F.get("segments", level) == F.col("_segment")
        for k in _KEY:
            same &= F.col(k) == F.col(f"_{k}")
        more = F.size("segments") - (level + 1)
        rest = F.when(F.col("_on") | (more == 0), F.lit("")).when(more == 1, F.lit("/*")).otherwise(F.lit("/**"))
        grown = active.join(step, same).select(
            "scope", "name", "segments", "n", "good", "bad", F.concat("template", "_label", rest).alias("template"), F.concat("path", F.array("_counts")).alias("path"), F.col("_on").alias("open")
        )
        done = rows.filter(~(F.col("open") & (F.size("segments") > level)))
        rows = materialize(done.unionByName(grown), "templates")
        level += 1
    return rows.select("scope", "name", "segments", "template", "path")


def template_verdicts(leaves: DataFrame, least_support: int, z: float, strength: float, unlabelled_weight: float, least_purity: float) -> DataFrame:
    """From (host, segments, n, good, bad) of lexical templates: (host, segments, template, purity, rejected)."""
    n, bad = (x or 0 for x in leaves.agg(F.sum("n"), F.sum("bad")).first())
    found = _grown(leaves, least_support, z).select(*[F.col(c).alias(f"_{c}") for c in ("scope", "name", "segments")], "template", "path")
    rows = _scoped(leaves.select("host", "segments"))
    rows = rows.join(found, (F.col("scope") == F.col("_scope")) & (F.col("name") == F.col("_name")) & (F.col("segments") == F.col("_segments")))
    rows = rows.groupBy("host", "segments").agg(F.sort_array(F.collect_list(F.struct("scope", "path", "template"))).alias("scopes"))  # four of each

    def smoothed(share: Column, node: Column, weight: float) -> Column:
        labelled = node["bad"] + node["good"]
        return (node["bad"] + strength * share) / (labelled + weight * (node["n"] - labelled) + strength)

    share = F.lit((bad + 1) / (n + 2))
    share = F.aggregate(F.get("scopes", 0)["path"], share, lambda s, x: smoothed(s, x, unlabelled_weight))
    narrower = F.flatten(F.transform(F.slice("scopes", 2, 3), lambda s: s["path"]))
    share = F.aggregate(narrower, share, lambda s, x: smoothed(s, x, 0.0))
    rows = rows.select("host", "segments", F.get("scopes", 3)["template"].alias("template"), (1 - share).alias("purity"))
    return rows.withColumn("rejected", F.col("purity") <= least_purity)


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, least_support: int = 3, z: float = 1.96, strength: float = 2.0, unlabelled_weight: float = 0.25, least_purity: float = 0.5,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity."""
    host, path = parse(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = F.transform(F.slice(F.split("path", "/"), 2, 1 << 30), lambda x: lexical(x))
    rows = rows.withColumns({"rule": name, "_by_rule": verdict, "segments": parts})
    of = lambda kind: F.count_if(F.coalesce(F.col("_by_rule") == kind, F.lit(False)))
    leaves = materialize(rows.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), of("allow").alias("good"), of("block").alias("bad")), "templates")
    found = materialize(template_verdicts(leaves, least_support, z, strength, unlabelled_weight, least_purity), "templates")
    out = rows.join(found, ["host", "segments"])
    verdict = F.coalesce(F.col("_by_rule"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
