"""Mixing sources to target weights by hierarchical budgets over a tree of domains, languages and sources.

A mix's size is spread over its sources by their shares (which are scaled to add up to 1) and over a source's languages by
their sizes. Each leaf (domain, language, source) can give its size times the cap on repeats. What a leaf cannot give
goes to its siblings, sources of the same domain and language, by their weights; what these cannot give goes to the
domain's other languages, then to other domains. A leaf takes whole epochs, each in a seeded order of its own, and of the last one the
prefix that comes nearest to its budget.

The prefix is found without ordering a leaf: sizes are summed by ranges of the seeded hash, whole ranges are taken, and only
the range with the cut is ordered by rows. Budgets are planned by the driver on one row for each source and language.

Null texts are not part of any mix, empty ones add nothing and are taken with their place in the order; missing or odd
languages count as 'und'; a source without documents passes its share on; null or negative shares count as 0.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm import tokens
from lexmill.storage import materialize

SEED = 20_240_117
#: Rows that one range of the seeded hash holds about; rows of targets and of (source, language), at most, that the driver plans with.
RANGE_ROWS, MOST_LEAVES = 20_000, 200_000


def language(lang: Column) -> Column:
    code = F.regexp_extract(F.lower(F.coalesce(lang, F.lit(""))), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(code == "", F.lit("und")).otherwise(code)


def _fill(budget: float, children: dict, weight, room) -> dict:
    """Spread a budget over children by weight, none beyond its room; what one cannot take goes to the others."""
    given = dict.fromkeys(children, 0.0)
    open_children = {c for c in children if room(c) > 0}
    while budget > 1e-9 and open_children:
        total = sum(weight(c) for c in open_children)
        if total <= 0:
            total, weight = sum(room(c) - given[c] for c in open_children), lambda c: room(c)  # noqa: B023
        full = {c for c in open_children if room(c) - given[c] <= budget * weight(c) / total + 1e-9}
        if not full:
            for c in open_children:
                given[c] += budget * weight(c) / total
            break
        for c in full:
            budget -= room(c) - given[c]
            given[c] = room(c)
        open_children -= full
    return given


def budgets(leaf_sizes: dict[tuple[str, str], int], targets: dict[str, tuple[float, int]], total: float, domains: dict[str, str]) -> dict[tuple[str, str], float]:
    """Tokens to take of each leaf (language, source) of one mix. targets: by source, share and most repeats; domains: of sources, others form one of their own."""
    whole = sum(share for share, _ in targets.values()) or 1.0
    by_source: dict[str, int] = defaultdict(int)
    for (_, source), size in leaf_sizes.items():
        by_source[source] += size
    weight: dict[tuple, float] = defaultdict(float)
    room: dict[tuple, float] = defaultdict(float)
    tree: dict[tuple, set] = defaultdict(set)
    for source, (share, repeats) in targets.items():
        domain = domains.get(source, "other")
        # a source without documents still weighs for its domain, so its siblings come first
        leaves = [(lang, size) for (lang, s), size in leaf_sizes.items() if s == source] or [("und", 0)]
        for lang, size in leaves:
            path = ((), (domain,), (domain, lang), (domain, lang, source))
            part = share / whole * (size / by_source[source] if by_source[source] else 1.0)
            for parent, child in zip(path, path[1:]):
                tree[parent].add(child)
                weight[child] += part
                room[child] += size * max(repeats, 0)
    out: dict[tuple[str, str], float] = {}

    def down(node: tuple, budget: float) -> None:
        if len(node) == 3:
            out[node[1], node[2]] = budget
            return
        given = _fill(budget, dict.fromkeys(sorted(tree[node])), lambda c: weight[c], lambda c: room[c])
        for child, part in given.items():
            down(child, part)

    down((), min(total, sum(room[c] for c in tree[()])))
    return out


def mix(documents: DataFrame, mix_targets: DataFrame, domains: DataFrame | None = None, vocabulary: str = tokens.VOCABULARY, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(taken (mix_id, doc_id, source, tokens, times), plan (mix_id, source, target_share, max_repeats, planned_tokens)).

    domains: (source, domain), the upper level of the tree; without it, and for sources that it lacks, there is one domain.
    """
    spark = documents.sparkSession
    sized = tokens.token_sizes(documents.select("doc_id", "source", language(F.col("lang")).alias("language"), "text"), "text", ["doc_id", "source", "language"], vocabulary)
    sized = materialize(sized, "mix-sizes")
    leaves = sized.where("source is not null").groupBy("language", "source").agg(F.sum("tokens").alias("size"), F.count("*").alias("rows")).limit(MOST_LEAVES + 1).collect()
    targets = mix_targets.limit(MOST_LEAVES + 1).collect()
    branches = domains.where("source is not null and domain is not null").limit(MOST_LEAVES + 1).collect() if domains is not None else []
    domain_of = {r.source: r.domain for r in sorted(branches)}
    if max(len(leaves), len(targets), len(branches)) > MOST_LEAVES:
        raise ValueError("too many sources and languages to plan with")
    everything = sized.agg(F.sum("tokens")).first()[0] or 0
    leaf_sizes = {(r.language, r.source): r["size"] for r in leaves}
    leaf_rows = {(r.language, r.source): r["rows"] for r in leaves}
    plans, planned = [], []
    mixes: dict[str, dict[str, tuple[float, int]]] = defaultdict(dict)
    factors: dict[str, float] = {}
    for r in targets:
        mixes[r.mix_id][r.source] = (max(r.target_share or 0.0, 0.0), int(r.max_repeats or 0))
        factors[r.mix_id] = float(r.total_factor or 0.0)
    for mix_id, wanted in sorted(mixes.items()):
        found = budgets(leaf_sizes, wanted, factors[mix_id] * everything, domain_of)
        by_source: dict[str, float] = defaultdict(float)
        for (lang, source), budget in sorted(found.items()):
            by_source[source] += budget
            size = leaf_sizes.get((lang, source), 0)
            if size:
                whole = min(int(budget // size), wanted[source][1])
                rest = budget - whole * size if whole < wanted[source][1] else 0.0
                ranges = max(1, leaf_rows[lang, source] // RANGE_ROWS)
                plans.append((mix_id, lang, source, whole, float(rest), ranges))
        planned += [(mix_id, s, share, repeats, by_source[s]) for s, (share, repeats) in sorted(wanted.items())]
    plan_table = spark.createDataFrame(plans, "mix_id string, language string, source string, whole int, rest double, ranges int")
    planned_table = spark.createDataFrame(planned, "mix_id string, source string, target_share double, max_repeats int, planned_tokens double")
    # the seeded order of the epoch in which the leaf's budget ends
    place = F.xxhash64(F.lit(seed), "mix_id", "whole", "doc_id")
    # a row for each mix and leaf: sent to the workers only while that is bounded
    rows = sized.join(F.broadcast(plan_table) if len(plans) <= MOST_LEAVES else plan_table, ["language", "source"]).withColumn("place", place)
    rows = rows.withColumn("range", F.pmod(F.shiftrightunsigned("place", 40), F.col("ranges")).cast("int"))
    leaf = ["mix_id", "language", "source"]
    summed = rows.where("rest > 0").groupBy(*leaf, "range").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = materialize(summed.withColumn("ahead", ahead).select(*leaf, "range", "n", "ahead", ((F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("n") > F.col("rest"))).alias("cut")), "mix-ranges")
    marked = rows.join(summed, [*leaf, "range"], "left")
    whole_rows = marked.where(~F.coalesce("cut", F.lit(False))).withColumn("extra", F.coalesce((F.col("ahead") + F.col("n") <= F.col("rest")).cast("int"), F.lit(0)))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(*leaf, "range").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut_rows = marked.where("cut").withColumn("extra", (F.col("ahead") + before + F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    picked = ["mix_id", "doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).cast("int").alias("times")]
    return whole_rows.select(*picked).unionByName(cut_rows.select(*picked)).where("times > 0"), planned_table


def shares(taken: DataFrame, planned: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, planned_tokens, tokens, actual_share, documents, most_times): the shares reached."""
    reached = taken.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.count("*").alias("documents"), F.max("times").alias("most_times"))
    whole = Window.partitionBy("mix_id")
    joined = planned.join(reached, ["mix_id", "source"], "left").na.fill(0, ["tokens", "documents", "most_times"])
    share = F.when(F.sum("tokens").over(whole) > 0, F.col("tokens") / F.sum("tokens").over(whole)).otherwise(0.0)
    return joined.select("mix_id", "source", "target_share", "planned_tokens", "tokens", share.alias("actual_share"), "documents", "most_times")
