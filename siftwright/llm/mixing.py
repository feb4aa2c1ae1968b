"""Mixing sources to target weights, by hierarchical budgets and seeded epochs.

Weights go down a tree of domains, languages and sources. Where a branch can't give its part, what
is short goes to its siblings first and to the branches of its ancestors only when these are full
too. Each leaf gives whole epochs of its texts and, of one more epoch in a seeded order, the prefix
whose size is nearest to what is left of its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm.tokens import VOCABULARY, with_tokens
from siftwright.session import stage

#: Leaves (domain, language, source) that the driver plans for; their number doesn't follow the number of texts.
MOST_LEAVES = 100_000


def spread(amount: float, children: list[tuple[float, float]]) -> list[float]:
    """The parts of ``amount`` for children of (weight, capacity), by weight; what one can't take goes to the others."""
    given = [0.0] * len(children)
    open_ = [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    while open_ and amount > 1e-9:
        weight = sum(children[i][0] for i in open_)
        full = [i for i in open_ if amount * children[i][0] / weight >= children[i][1]]
        if not full:
            for i in open_:
                given[i] = amount * children[i][0] / weight
            break
        for i in full:
            given[i] = children[i][1]
        amount -= sum(children[i][1] for i in full)
        open_ = [i for i in open_ if i not in full]
    return given


def budgets(leaves: dict[tuple, tuple[float, float]], total: float) -> dict[tuple, float]:
    """The budget of each leaf, by its path, of (weight, capacity)."""

    def down(amount: float, here: dict[tuple, tuple[float, float]], level: int) -> dict[tuple, float]:
        if len(here) == 1 and len(next(iter(here))) == level:
            ((path, (_, cap)),) = here.items()
            return {path: min(amount, cap)}
        branches: dict[str, dict] = {}
        for path, x in here.items():
            branches.setdefault(path[level], {})[path] = x
        parts = spread(amount, [(sum(w for w, _ in b.values()), sum(c for _, c in b.values())) for b in branches.values()])
        return {k: v for b, part in zip(branches.values(), parts, strict=True) for k, v in down(part, b, level + 1).items()}

    return down(total, leaves, 0) if leaves else {}


def mix(docs: DataFrame, targets: DataFrame, domain: Column, total_tokens: int | None = None, seed: int = 1, buckets: int = 4096, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, uses): how often each text of ``docs(doc_id, text, lang, source)`` is used.

    ``targets(source, target_share, max_repeats)``; texts of other or no sources aren't used, and
    sources without texts leave their share to the others of their domain, then of all. ``domain``
    is an expression over ``source``, the one column that texts and targets have in common. Null
    languages are one language; texts without an id are left out. Texts without tokens are used in no epoch. ``total_tokens``: the
    size to reach; if none is given, the most at which every source that has texts can hold its
    share. Shares can differ from their targets by half a text for each leaf, a text at the end of a prefix being
    used where that brings the leaf nearer to its budget.

    A leaf's last epoch is ordered by a seeded hash in ``buckets`` ranges; sums of these decide all
    but one range, in which a running sum does, so that no leaf is ever brought together.
    """
    spark = docs.sparkSession
    lang = F.coalesce("lang", F.lit("und"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", lang.alias("lang"), "text").filter("source is not null and doc_id is not null").withColumn("domain", domain)
    known = targets.select("source", "target_share", "max_repeats").withColumn("domain", domain).filter("target_share > 0 and max_repeats > 0").dropDuplicates(["source"])
    sized = stage(with_tokens(rows.join(known.select("source"), "source", "left_semi"), "doc_id", "text", ["source", "lang", "domain"], vocabulary).filter("n_tokens > 0"), "sizes")
    leaf = ["domain", "lang", "source"]
    stats = sized.groupBy(*leaf).agg(F.sum("n_tokens").alias("avail")).limit(MOST_LEAVES + 1).collect()
    if len(stats) > MOST_LEAVES:
        raise ValueError("too many leaves: is the language or the domain a free text?")
    asked = {r.source: r for r in known.collect()}
    whole: dict[str, int] = {}
    for r in stats:
        whole[r.source] = whole.get(r.source, 0) + r.avail
    leaves = {(r.domain, r.lang, r.source): (asked[r.source].target_share * r.avail / whole[r.source], r.avail * asked[r.source].max_repeats) for r in stats}
    # What has a target but no texts is leaves that can give nothing, spread like its domain's languages.
    spoken: dict[str, dict[str, float]] = {}
    for (d, lg, _), (weight, _) in leaves.items():
        spoken.setdefault(d, {})[lg] = spoken.get(d, {}).get(lg, 0.0) + weight
    for s, r in asked.items():
        if s not in whole:
            here = spoken.get(r.domain, {"und": 1.0})
            leaves |= {(r.domain, lg, s): (r.target_share * x / sum(here.values()), 0) for lg, x in here.items()}
    if total_tokens is None:
        parts: dict[str, float] = {}
        for path, b in budgets({p: (w, 1.0 if c else 0.0) for p, (w, c) in leaves.items()}, 1.0).items():
            parts[path[2]] = parts.get(path[2], 0.0) + b
        total_tokens = min((n * asked[s].max_repeats / parts[s] for s, n in whole.items() if parts.get(s)), default=0)
    avail = {(r.domain, r.lang, r.source): r.avail for r in stats}
    plan = []
    for path, b in budgets(leaves, total_tokens).items():
        if path not in avail:
            continue
        full = int(b // avail[path])
        plan.append((*path, full, int(round(b - full * avail[path]))))
    schema = "domain string, lang string, source string, full int, rest long"
    # The plan has one row a leaf and at most MOST_LEAVES; Spark sees its size.
    keyed = sized.join(spark.createDataFrame(plan, schema), leaf).withColumn("_at", F.xxhash64(F.lit(seed), "full", "doc_id"))
    keyed = keyed.withColumn("_bucket", F.floor((F.shiftright("_at", 32) + F.lit(2**31)) * F.lit(buckets) / F.lit(2**32)).cast("int"))
    sums = keyed.groupBy(*leaf, "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    w = Window.partitionBy(*leaf).orderBy("_bucket")
    edges = sums.withColumn("_end", F.sum("_sum").over(w)).withColumn("_start", F.col("_end") - F.col("_sum")).drop("_sum")
    placed = keyed.join(edges, [*leaf, "_bucket"])
    edge = (F.col("_start") < F.col("rest")) & (F.col("_end") > F.col("rest"))
    inside = Window.partitionBy(*leaf, "_bucket").orderBy("_at", "doc_id")
    over = F.col("_start") + F.sum("n_tokens").over(inside) - F.col("rest")
    # Of the text that the budget ends in, as much must be inside as outside at least.
    cut = placed.filter(edge).withColumn("_over", over).withColumn("_more", (2 * F.col("_over") <= F.col("n_tokens")).cast("int")).drop("_over")
    rest = placed.filter(~edge).withColumn("_more", (F.col("_end") <= F.col("rest")).cast("int"))
    uses = cut.unionByName(rest).withColumn("uses", F.col("full") + F.col("_more")).filter("uses > 0")
    return uses.select("doc_id", "domain", "lang", "source", "n_tokens", "uses")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, texts, tokens, actual_share, most_uses) of every target."""
    by = mixed.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return targets.select("source", "target_share", "max_repeats").join(by, "source", "left").select(
        "source", "target_share", "max_repeats", zero("texts").alias("texts"), zero("tokens").alias("tokens"),
        F.round(zero("tokens") / total, 6).alias("actual_share"), zero("most_uses").alias("most_uses"),
    )
