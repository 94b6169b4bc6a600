"""URL filters: rules first, and for the rest a tree of path templates per host. DataFrame operations only.

The paths of a host form a tree of segments. Level by level, under each parent,
a segment that holds a fair share of the parent's pages stays as it is; where many
others are left, they are variable and become one wildcard, which keeps a file
ending. Numbers are always variable. Then, from the deepest level up, branches of one parent whose
continuations are distributed alike are merged: each is held against all branches
that mostly go on in the same way, up to what its size lets one tell. The rules' verdicts are the labels: a
template is rejected when its share of blocked pages among labelled ones,
smoothed towards the share in the whole table, is high enough.

There is no limit of depth. A parent all of whose pages go on in one and the same way has nothing to
generalise but numbers, and is finished at once; so there are as many rounds as the deepest place where two
different paths still share a parent, not as many as the longest path has segments.

Defined results for odd input: a null url, or one without ``://``, has an empty
host and path, fits no rule, has no template and is allowed. Repeated rows count
as often as they stand there, as pages do. An empty table gives an empty one. Very long urls are read whole. Of equally frequent names of merged branches, and
continuations, the greatest continuation and the first name count, so that ties do not depend on the order of rows.
Columns of ``pages`` other than page_id and url are not read; ``passed`` keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..staging import stage
from .words import fresh

# Fixed values: (host, path, verdict); a rule holds for the host and its subdomains.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

# Numbers and long hexadecimal names, with or without a file ending, are variable wherever they stand.
NUMBER_LIKE = r"^([0-9]+|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{32,36})(\.[A-Za-z][A-Za-z0-9]{0,4})?$"


@dataclass(frozen=True)
class Limits:
    keep_share: float = 0.05  # of the parent's pages, for a segment to stay as it is in a variable place
    variable_from: int = 8  # different segments below that share, for a place to be variable
    distance: float = 0.1  # total variation between a branch and all its parent's branches, ...
    slack: float = 1.0  # ... and as many times 1 / sqrt(pages of the branch)
    smoothing: float = 20.0  # pages of the table's average that every template is given
    reject: float = 0.8


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # later ones come first
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _wildcard(segment: Column) -> Column:
    return F.concat(F.lit("*"), F.lower(F.regexp_extract(segment, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", 0)))


def _part(segment: Column) -> Column:
    """How a segment that is the only one in its place stands in a template."""
    return F.when(segment.rlike(NUMBER_LIKE), _wildcard(segment)).otherwise(F.concat(F.lit("="), segment))


def _generalised(pages: DataFrame, limits: Limits) -> tuple[DataFrame, int]:
    """``pages`` (host, path, ...) with ``parts``, the segments of its template; and the levels at which paths part."""
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    rows = pages.withColumn("segments", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(segments))
    rows = rows.withColumns({"parts": F.array().cast("array<string>"), "parent": F.lit("")})
    level = 0
    while True:
        at, rest = F.get("segments", F.lit(level)), F.slice("segments", level + 1, F.size("segments"))
        # Parents whose pages all go on alike are finished.
        tails = rows.where(at.isNotNull()).groupBy("host", "parent").agg(
            F.min(F.concat_ws("/", rest)).alias("low"), F.max(F.concat_ws("/", rest)).alias("high"))
        alone = tails.where("low = high").select("host", "parent", F.lit(True).alias("alone"))
        rows = rows.join(alone, ["host", "parent"], "left").withColumn("alone", F.col("alone") & at.isNotNull())
        rows = rows.withColumns({
            "parts": F.when(F.col("alone"), F.concat("parts", F.transform(rest, _part))).otherwise(F.col("parts")),
            "segments": F.when(F.col("alone"), F.slice("segments", 1, level)).otherwise(F.col("segments"))}).drop("alone")
        rows = stage(rows, "paths")
        here = rows.where(at.isNotNull()).groupBy("host", "parent", at.alias("segment")).agg(F.count(F.lit(1)).alias("n"))
        children = stage(here, "segments")
        if children.isEmpty():
            return rows.drop("segments", "parent"), level
        total = children.groupBy("host", "parent").agg(F.sum("n").alias("total"))
        rare = F.col("n") < limits.keep_share * F.col("total")
        judged = children.join(total, ["host", "parent"]).withColumn("rare", rare)
        variable = judged.groupBy("host", "parent").agg(F.sum(F.col("rare").cast("long")).alias("others"))
        kept = judged.join(variable, ["host", "parent"]).where(~F.col("rare") | (F.col("others") < limits.variable_from))
        kept = kept.where(~F.col("segment").rlike(NUMBER_LIKE))
        # At most 1 / keep_share segments of a parent, or variable_from of them.
        kept = stage(kept.select("host", "parent", "segment", F.lit(True).alias("kept")), "kept")
        rows = rows.withColumn("segment", at).join(kept, ["host", "parent", "segment"], "left")
        part = F.when(F.col("kept"), F.concat(F.lit("="), "segment")).otherwise(_wildcard(F.col("segment")))
        rows = rows.withColumn("parts", F.when(F.col("segment").isNotNull(), F.array_append("parts", part)).otherwise(F.col("parts")))
        rows = rows.withColumn("parent", F.concat_ws("/", "parts")).drop("segment", "kept")
        level += 1


def _merged(templates: DataFrame, limits: Limits, levels: int) -> DataFrame:
    """``templates`` (host, parts, n, ...) with ``merged``: parts in which similar branches have one name.

    The table has a row for each template of each host, so that this no longer
    depends on the number of pages. From ``levels`` on no two templates share all that
    is above, so that nothing can merge there.
    """
    rows = templates.withColumn("merged", F.col("parts"))
    for level in reversed(range(levels)):
        rows = stage(rows.withColumns({
            "above": F.to_json(F.slice("merged", 1, level)) if level else F.lit("[]"),
            "branch": F.get("merged", F.lit(level)),
            "below": F.to_json(F.slice("merged", level + 2, F.size("merged")))}), "branches")
        literal = rows.where(F.col("branch").startswith("="))
        own = literal.groupBy("host", "above", "branch", "below").agg(F.sum("n").alias("n"))
        # Branches are weighed with those that mostly go on in the same way.
        size = own.groupBy("host", "above", "branch").agg(F.sum("n").alias("size"), F.max(F.struct("n", "below"))["below"].alias("mode"))
        own = own.join(size, ["host", "above", "branch"])
        group = ["host", "above", "mode"]
        pool = own.groupBy(*group, "below").agg(F.sum("n").alias("pool"))
        whole = own.groupBy(*group).agg(F.sum("n").alias("whole"))
        shares = own.join(pool, [*group, "below"]).join(whole, group)
        # Total variation: what the branch has above the pool's share.
        excess = F.greatest(F.lit(0.0), F.col("n") / F.col("size") - F.col("pool") / F.col("whole"))
        distance = shares.groupBy(*group, "branch").agg(F.sum(excess).alias("distance"), F.first("size").alias("size"))
        alike = distance.where(F.col("distance") <= limits.distance + limits.slack / F.sqrt("size"))
        # One name for them, if there are two at least: that of the first.
        groups = alike.groupBy(*group).agg(F.min("branch").alias("name"), F.count(F.lit(1)).alias("count")).where("count > 1")
        names = alike.join(groups, group).select("host", "above", "branch", F.concat(F.lit("~"), F.substring("name", 2, 1 << 30)).alias("name"))
        rows = rows.join(names, ["host", "above", "branch"], "left")
        renamed = F.transform("merged", lambda part, i: F.when(i == level, F.coalesce("name", part)).otherwise(part))
        rows = rows.withColumn("merged", renamed).drop("above", "branch", "below", "name")
    return rows


def judged(pages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """page_id, host, path, rule, verdict, and for pages with a host template, labelled pages and purity of it."""
    host, path = parsed(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    rows, levels = _generalised(rows, limits)
    rows = stage(rows, "pages")
    seen = lambda what: F.sum((F.col("ruled") == what).cast("long"))
    templates = rows.where("host != ''").groupBy("host", "parts").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(seen("allow"), F.lit(0)).alias("allowed"), F.coalesce(seen("block"), F.lit(0)).alias("blocked"))
    merged = stage(_merged(templates, limits, levels), "templates")
    labelled, blocked = merged.agg(F.sum(F.col("allowed") + F.col("blocked")), F.sum("blocked")).first()
    average = (blocked or 0) / labelled if labelled else 0.0
    sums = merged.groupBy("host", "merged").agg(F.sum(F.col("allowed") + F.col("blocked")).alias("labelled"), F.sum("blocked").alias("blocked"))
    purity = (F.col("blocked") + F.lit(limits.smoothing * average)) / (F.col("labelled") + limits.smoothing)
    known = merged.select("host", "parts", "merged").join(sums.withColumn("purity", purity), ["host", "merged"])
    readable = F.concat(F.lit("/"), F.concat_ws("/", F.transform("merged", lambda p: F.regexp_replace(p, "^=", ""))))
    known = known.select("host", "parts", readable.alias("template"), "labelled", "purity")
    out = rows.join(known, ["host", "parts"], "left")
    method = F.when(F.col("purity") >= limits.reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "labelled", "purity")


def passed(pages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``pages`` whose url is allowed."""
    blocked = judged(pages.select(F.col("url").alias("page_id"), "url"), limits).where("verdict = 'block'").select("page_id").distinct()
    name = fresh(pages, "_url")
    return pages.join(blocked.select(F.col("page_id").alias(name)), pages["url"] == F.col(name), "left_anti")
