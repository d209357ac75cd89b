"""URL filters from a tree of path templates.

The paths of a host form a tree of segments.  Digits inside a segment are
replaced by ``{n}`` first, and paths of one shape are counted together, so the
tree is built from shapes with counts and not from pages.  Going down the tree,

1. a branch with too few pages at its node is a variable segment: it becomes
   the wildcard ``*``;
2. a branch whose share of blocked pages and whose share of pages that end
   there do not differ significantly from those of its node is merged into the
   wildcard as well;
3. any other branch stays as it is.

What a path becomes is its template.  Known verdicts label the pages; a
template is rejected when its share of blocked among labelled pages, smoothed
towards the share over all pages, is over a half.

All counts cover all pages.  A host that holds a third of all rows is counted
by partial aggregation over its shapes, and the joins are on host and shape,
which adaptive execution splits where a key is hot.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docketry.llm.frames import named, written

ALLOW, BLOCK = "allow", "block"

#: Rules as (host and path, verdict); a rule holds for the host and its subdomains.
RULES = (
    ("org/", ALLOW),
    ("example.org/es/", BLOCK),
    ("example.org/en/1", BLOCK),
    ("com/fr/", ALLOW),
    ("com/de/", BLOCK),
)

#: Levels of the tree; deeper segments share one branch ``**``.
DEPTH = 3
#: A branch stays literal with so many pages and this share of its node's pages.
MIN_PAGES = 20
MIN_SHARE = 0.02
#: Squared z score (95 %) from which two shares differ.
CRITICAL = 3.841459
#: Pages' worth of the overall share that smooths a template's share.
PRIOR = 10.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://`` or URL."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    known = F.coalesce(at > 0, F.lit(False))

    def part(group: int) -> Column:
        return F.when(known, F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", group)).otherwise("")

    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, NULL without one."""
    found = verdict = None
    for rule, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if found is None else (found, verdict)


def path_shape(path: Column, depth: int = DEPTH) -> Column:
    """The first segments, digits as ``{n}``; what is deeper is one ``**``."""
    parts = F.split(F.regexp_replace(path, "[0-9]+", "{n}"), "/", -1)
    deep = F.when(F.size(parts) > depth + 1, F.array(F.lit("**"))).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_join(F.concat(F.slice(parts, 2, depth), deep), "/")


def differs(part: Column, of: Column, all_part: Column, all_of: Column) -> Column:
    """Whether part/of is significantly off all_part/all_of."""
    share = F.try_divide(all_part, all_of)
    off = F.try_divide(part, of) - share
    return F.coalesce(off * off * of > F.lit(CRITICAL) * share * (F.lit(1.0) - share), F.lit(False))


def templates(judged: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``host, shape, template, pages, labelled, blocked`` from pages that carry
    ``host, shape, verdict`` (NULL where no rule fits)."""
    shapes = written(
        judged.groupBy("host", "shape").agg(
            F.count("*").cast("double").alias("pages"),
            F.count("verdict").cast("double").alias("labelled"),
            F.count(F.when(F.col("verdict") == BLOCK, 1)).cast("double").alias("blocked"),
        ),
        "url-shapes",
    )
    tree = shapes.withColumns(
        {"segs": F.split("shape", "/", -1), "template": F.lit("")}
    )
    for level in range(depth + 1):
        seg = F.get("segs", F.lit(level))
        tree = tree.withColumn("seg", seg)
        ends = F.when(F.size("segs") == level + 1, F.col("pages")).otherwise(0.0)
        branches = (
            tree.filter(F.col("seg").isNotNull())
            .groupBy("host", "template", "seg")
            .agg(
                F.sum("pages").alias("n"), F.sum("labelled").alias("k"),
                F.sum("blocked").alias("b"), F.sum(ends).alias("e"),
            )
        )
        nodes = branches.groupBy("host", "template").agg(
            F.sum("n").alias("all_n"), F.sum("k").alias("all_k"),
            F.sum("b").alias("all_b"), F.sum("e").alias("all_e"),
        )
        own = differs(F.col("b"), F.col("k"), F.col("all_b"), F.col("all_k")) | differs(
            F.col("e"), F.col("n"), F.col("all_e"), F.col("all_n")
        )
        often = (F.col("n") >= MIN_PAGES) & (F.col("n") >= F.lit(MIN_SHARE) * F.col("all_n"))
        kept = branches.join(nodes, ["host", "template"]).filter(often & own)
        kept = kept.select("host", "template", "seg", F.lit(True).alias("literal"))
        step = F.when(F.col("literal"), F.col("seg")).otherwise("*")
        tree = written(
            tree.join(kept, ["host", "template", "seg"], "left").select(
                "host", "shape", "pages", "labelled", "blocked", "segs",
                F.when(F.col("seg").isNull(), F.col("template"))
                .otherwise(F.concat("template", F.lit("/"), step)).alias("template"),
            ),
            "url-tree",
        )
    return tree.select("host", "shape", "template", "pages", "labelled", "blocked")


def filter_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    depth: int = DEPTH,
) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, template, purity``.

    ``verdict`` is the rule's where one fits, else ``block`` for a template
    whose smoothed blocked share (``purity``) is over a half, else ``allow``.
    A NULL URL or one without ``://`` has empty host and path and is judged by
    the template of the empty host.  Without any labelled page all is allowed.
    Columns of the input with these names are replaced; every row comes back
    once, repeated ones as well; an empty input gives an empty result.
    """
    new = ("host", "path", "rule", "verdict", "template", "purity", "shape")
    kept = [named(c) for c in pages.columns if c.lower() not in new]
    host, path = host_and_path(named(url).cast("string"))
    parsed = pages.select(*kept, host.alias("host"), path.alias("path"))
    found, says = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.select(
        "*", found.alias("rule"), says.alias("verdict"), path_shape(F.col("path"), depth).alias("shape")
    )
    tree = templates(judged, depth)
    labelled, blocked = tree.agg(F.sum("labelled"), F.sum("blocked")).first()
    prior = F.lit(blocked / labelled if labelled else 0.0)
    purity = (F.sum("blocked") + F.lit(PRIOR) * prior) / (F.sum("labelled") + F.lit(PRIOR))
    pure = tree.groupBy("host", "template").agg(purity.alias("purity"))
    verdicts = tree.select("host", "shape", "template").join(pure, ["host", "template"])
    own = F.when(F.col("purity") > 0.5, BLOCK).otherwise(ALLOW)
    return judged.join(verdicts, ["host", "shape"]).select(
        *kept, "host", "path", "rule",
        F.coalesce(F.col("verdict"), own).alias("verdict"), "template", "purity",
    )
