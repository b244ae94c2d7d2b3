"""URL filter: fixed rules first, then a tree of path templates per host, judged by labelled purity.

Paths are grown level by level, down to the deepest. At each node (host and template so far) a segment that looks like a number, a
hash or a date is a wildcard from the start; of the others, a segment with at least ``MIN_URLS`` urls or ``MIN_LABELLED`` labelled ones
stays literal, whatever its share of the node, and only the sparse rest becomes the wildcard. Literal children whose subtrees are alike
(same kinds of following segments, and unwanted shares that a two-sample test can't tell apart) are merged into one branch. The test
runs over the counts (labelled, unwanted) that occur, not over the children: children with the same counts are one kind, and those with
fewer than ``MIN_LABELLED`` labelled urls, which no test tells apart, are one kind too, so that chance doesn't sort them by outcome. Kinds
are tested in lists of about ``LANE``, cut by share. A template is rejected if the share of unwanted urls among its labelled ones, smoothed
towards the share of its host and that towards the corpus, reaches ``purity``.

The tree works on counts of distinct paths with variable segments already folded, never on urls; verdicts are joined back to
the urls by host and folded path.

Defined cases: a null url or one without ``://`` has an empty host and path; the empty host has no rule and no template and is
allowed; ids without a label, null ids among them, only count as urls; of several labels of one id the unwanted one
counts; repeated rows are counted and judged one by one; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.llm.tables import carried, small, stored

MIN_URLS = 5
#: Labelled urls from which a segment's unwanted share is tested.
MIN_LABELLED = 3
PURITY = 0.8
#: Weight of the prior in labelled urls.
STRENGTH = 4.0
#: Two-sample z below which unwanted shares count as alike, and the children up to which it holds; more children raise it.
ALIKE, FEW = 1.64, 20
#: Kinds of children of a node that are tested in one list.
LANE = 10_000
#: Segments that a branch's name lists; the name of a larger branch has its first segment, their number and a hash of all.
NAMED = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VARIABLE = r"^([0-9]+|[0-9]{4}-[0-9]{2}(-[0-9]{2})?|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{32,})(\.[a-z0-9]{1,5})?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path, both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    plain = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(plain, pattern, 1), _UPPER, _LOWER), F.regexp_extract(plain, pattern, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; ``rules`` are (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def folded(path: Column) -> Column:
    """Segments of a path with variable ones as ``*`` and their ending."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(s, _VARIABLE, "*$3"))


def _merge_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group of each kind of literal children of a node: kinds of one shape with shares that can't be told apart share a group."""
    for b in batches:
        out: list[tuple] = []
        for r in b.to_pylist():
            limit = ALIKE if r["tested"] <= FEW else max(ALIKE, NormalDist().inv_cdf(1 - 0.05 * FEW / r["tested"]))
            groups: dict[int, dict] = {}
            for number, c in enumerate(sorted(r["kinds"], key=lambda c: ((c["bad"] + 0.5) / (c["labelled"] + 1), c["kind"]["labelled"], c["kind"]["bad"], c["shape"]))):
                last = groups.get(c["shape"])
                alike = False
                if last:
                    bad, n = last["bad"] + c["bad"], last["labelled"] + c["labelled"]
                    p = (bad + 0.5) / (n + 1)
                    gap = (c["bad"] + 0.5) / (c["labelled"] + 1) - (last["bad"] + 0.5) / (last["labelled"] + 1)
                    alike = abs(gap) <= limit * math.sqrt(p * (1 - p) * (1 / (c["labelled"] + 1) + 1 / (last["labelled"] + 1)))
                if alike:
                    last["bad"], last["labelled"] = last["bad"] + c["bad"], last["labelled"] + c["labelled"]
                else:
                    last = groups[c["shape"]] = {"bad": c["bad"], "labelled": c["labelled"], "number": number}
                out.append((r["host"], r["template"], c["shape"], c["kind"], f"{r['lane']}.{last['number']}"))
        yield pa.RecordBatch.from_pylist([dict(zip(_GROUPS.names, o)) for o in out], schema=_GROUPS)


_KIND = pa.struct([("labelled", pa.int64()), ("bad", pa.int64())])
_GROUPS = pa.schema([("host", pa.string()), ("template", pa.string()), ("shape", pa.int32()), ("kind", _KIND), ("group", pa.string())])
_NODE = ["host", "template"]


def _branches(children: DataFrame, min_urls: int) -> DataFrame:
    """(host, template, segment, branch) of the literal children."""
    weak = F.col("labelled") < MIN_LABELLED
    kind = F.struct(*[F.when(weak, F.lit(-1)).otherwise(F.col(c)).cast("long").alias(c) for c in ("labelled", "bad")])
    literal = stored(children.filter(((F.col("n") >= min_urls) | ~weak) & ~F.col("segment").startswith("*")).withColumn("kind", kind))
    kinds = literal.groupBy(*_NODE, "shape", "kind").agg(
        F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.sum((~weak).cast("long")).alias("tested"))
    nodes = kinds.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("_kinds"), F.sum("tested").alias("_tested"))
    lane = F.floor(F.col("bad") / F.greatest(F.col("labelled"), F.lit(1)) * F.floor(F.col("_kinds") / LANE))
    lists = kinds.join(nodes, _NODE).groupBy(*_NODE, lane.alias("lane")).agg(
        F.first("_tested").alias("tested"), F.collect_list(F.struct("shape", "kind", "labelled", "bad")).alias("kinds"))
    groups = stored(lists.mapInArrow(_merge_kinds, "host string, template string, shape int, kind struct<labelled:bigint,bad:bigint>, group string"))
    grouped = stored(literal.join(small(groups), [*_NODE, "shape", "kind"]).select(*_NODE, "segment", "group"))
    sizes = grouped.groupBy(*_NODE, "group").agg(
        F.count(F.lit(1)).alias("_m"), F.min("segment").alias("_first"), F.bit_xor(F.xxhash64("segment")).alias("_all"))
    few = grouped.join(small(stored(sizes.filter(F.col("_m") <= NAMED))), [*_NODE, "group"]).groupBy(*_NODE, "group").agg(F.array_sort(F.collect_list("segment")).alias("_list"))
    many = F.concat(F.lit("{"), "_first", F.lit("|+"), (F.col("_m") - 1).cast("string"), F.lit("~"), F.lower(F.hex("_all")), F.lit("}"))
    listed = F.when(F.size("_list") == 1, F.col("_list")[0]).otherwise(F.concat(F.lit("{"), F.array_join("_list", "|"), F.lit("}")))
    names = stored(sizes.join(few, [*_NODE, "group"], "left").select(*_NODE, "group", F.when(F.col("_list").isNull(), many).otherwise(listed).alias("branch")))
    return grouped.join(small(names), [*_NODE, "group"]).drop("group")


def path_templates(paths: DataFrame, min_urls: int = MIN_URLS) -> DataFrame:
    """(host, segments, n, labelled, bad) to the same with the template of each folded path.

    A level is one round. Paths leave the rounds when they end or are settled: alone at their node, or at a node too sparse for a literal.
    """
    grown = stored(paths.withColumns({"template": F.lit(""), "_open": F.size("segments") > 0}))
    done, level = [grown.filter(~F.col("_open")).drop("_open")], 0
    while not (open_ := grown.filter("_open").drop("_open")).isEmpty():
        level += 1
        wild = lambda s: F.when(s.startswith("*"), s).otherwise("*")
        nodes = open_.groupBy(*_NODE).agg(F.sum("n").alias("_n"), F.sum("labelled").alias("_labelled"), F.count(F.lit(1)).alias("_paths"))
        dense = (F.col("_n") >= min_urls) | (F.col("_labelled") >= MIN_LABELLED)
        settled = small(stored(nodes.select(*_NODE, dense.alias("_dense"), (~dense | (F.col("_paths") == 1)).alias("_settled"))))
        open_ = stored(open_.join(settled, _NODE))
        rest = F.slice("segments", level, F.size("segments"))
        tail = F.array_join(F.transform(rest, lambda s: F.when(F.col("_dense"), s).otherwise(wild(s))), "/")
        done.append(open_.filter("_settled").withColumn("template", F.concat("template", F.lit("/"), tail)).drop("_dense", "_settled"))
        split = open_.filter(~F.col("_settled")).drop("_dense", "_settled").withColumn("segment", F.element_at("segments", level))
        after = F.when(F.size("segments") > level, F.when(F.get("segments", F.lit(level)).startswith("*"), 2).otherwise(4)).otherwise(1)
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
        children = split.groupBy(*_NODE, "segment").agg(*sums, F.bit_or(after).alias("shape"))
        named = split.join(_branches(children, min_urls), [*_NODE, "segment"], "left")
        named = named.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("branch", wild(F.col("segment"))))).drop("segment", "branch")
        grown = stored(named.withColumn("_open", F.size("segments") > level))
        done.append(grown.filter(~F.col("_open")).drop("_open"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def judged_templates(paths: DataFrame, purity: float = PURITY, strength: float = STRENGTH) -> DataFrame:
    """(host, template, rejected) with the smoothed share of unwanted urls."""
    seen = paths.agg(F.sum("bad"), F.sum("labelled")).first()
    base = (seen[0] or 0) / max(1, seen[1] or 0)
    by_template = paths.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    by_host = by_template.groupBy("host").agg(((F.sum("bad") + base * strength) / (F.sum("labelled") + strength)).alias("prior"))
    rate = (F.col("bad") + F.col("prior") * strength) / (F.col("labelled") + strength)
    return by_template.join(by_host, "host").select("host", "template", rate.alias("purity"), ((F.col("labelled") > 0) & (rate >= purity)).alias("rejected"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = (), id_col: str = "page_id", url_col: str = "url",
               purity: float = PURITY) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template. ``labels`` are (id, unwanted 0/1)."""
    host, path = host_and_path(pages[url_col])
    known = labels.filter(F.col("id").isNotNull() & F.col("unwanted").isNotNull()).groupBy("id").agg(F.max(F.col("unwanted").cast("int")).alias("_bad"))
    named = ("host", "path", "rule", "verdict", "template")
    keyed = carried(pages, "", host=host, path=path, id=pages[id_col]).withColumn("segments", folded(F.col("path")))
    rows = keyed.select("id", "host", "segments").join(known, "id", "left").filter(F.col("host") != "")
    paths = rows.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"), F.count("_bad").alias("labelled"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    grown = stored(path_templates(paths))
    verdicts = grown.select("host", "segments", "template").join(judged_templates(grown, purity), ["host", "template"]).select(
        "host", "segments", "template", "rejected")
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    out = keyed.join(small(stored(verdicts)), ["host", "segments"], "left")
    method = F.when(F.coalesce("rejected", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    out = out.withColumn("rule", rule).withColumn("verdict", F.coalesce(said, method))
    return out.select(*[F.col("row").getField(c).alias(c) for c in pages.columns if c not in named], *named)
