"""Mixing sources to target weights by hierarchical budgets, in built-in functions only.

Documents lie in a tree of domain, language and source. The token budget of a node is shared among its children by weight;
a child that can't use its share (its tokens, as often as epochs may repeat them) gets what it can, and what is left goes to
its siblings by weight before any other part of the tree sees it, as each node's budget is first limited by what its whole
subtree can use. Each leaf then takes whole epochs, and of one more epoch the longest prefix in a seeded order that fits.

Tokens of a text are estimated as its UTF-8 bytes over four, rounded up, one at least.

Defined cases: null text has one token; null domain, language or source is `none`; a node without a weight gets the weight
`other`; weights of 0 or less get nothing; rows that repeat are counted and copied each; no tokens, no rows; a very long text
is measured, and taken or left as a whole; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.prefix import bucket_offsets
from tessella.llm.storage import written

TREE = ("domain", "lang", "source")
WEIGHTS = {
    "domain": {"web": 0.4, "books": 0.3, "code": 0.2, "forum": 0.1, "other": 0.05},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1, "other": 0.05},
    "source": {"other": 1.0},
}
EPOCHS = 4
SEED = 17
#: The domain of a source by its number, in steps of five.
DOMAINS = ("web", "books", "code", "forum")
#: A prefix is found within these many hash ranges of a leaf.
RANGES = 1024
#: Parts of a leaf's documents that meet its budget apart.
SALTS = 64


def domain_of(source: Column) -> Column:
    number = F.floor(F.regexp_extract(F.coalesce(source, F.lit("")), r"^src(\d{1,6})$", 1).try_cast("int") / 5)
    out = F.lit("other")
    for i, name in enumerate(DOMAINS):
        out = F.when(number == i, name).otherwise(out)
    return F.when(source.isNull(), "none").otherwise(out)


def leaves_of(docs: DataFrame) -> DataFrame:
    """doc_id, the leaf's path and the tokens of each document."""
    tokens = F.greatest(F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4), F.lit(1)).cast("long")
    return docs.select("doc_id", domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), tokens.alias("tokens"))


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    own = weights[level]
    out = F.lit(float(own.get("other", 0.0)))
    for name, w in own.items():
        if name != "other":
            out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return F.greatest(out, F.lit(0.0))


def _filled(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes (w, cap, parent_budget) with budget: children fill up in order of cap over weight; all that don't share one level."""
    nodes = nodes.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0.0))
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(0.0), name)
    used = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = nodes.withColumns({"used_": used, "left_": left})
    share = F.when(F.col("left_") > 0, (F.col("parent_budget") - F.col("used_")) / F.col("left_")).otherwise(0.0)
    levels = levels.withColumn("share_", share).withColumn("full_", F.col("cap") <= F.col("share_") * F.col("w"))
    level = F.min(F.when(~F.col("full_"), F.struct("used_", "share_"))).over(by)["share_"]
    return levels.withColumn("level_", level).withColumn("budget", F.when(F.col("full_"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level_") * F.col("w")))).drop("used_", "left_", "share_", "full_", "level_")


def budgets(leaves: DataFrame, part: float, epochs: int, weights: dict[str, dict[str, float]] | float) -> DataFrame:
    """Per leaf its supply and its budget in tokens; the root's budget is that part of all tokens.

    weights: by level and name, or one power: a node then weighs its tokens to that power."""
    supply = leaves.groupBy(*TREE).agg(F.sum("tokens").alias("supply"))
    usable = F.lit(True)
    for level in TREE if isinstance(weights, dict) else ():
        usable = usable & (_weight(level, weights) > 0)
    supply = supply.withColumn("cap", F.when(usable, (F.col("supply") * epochs).cast("double")).otherwise(0.0))
    above = supply.agg(F.least(F.sum("supply") * part, F.sum("cap")).alias("budget"))
    for depth, level in enumerate(TREE):
        path, parents = list(TREE[: depth + 1]), list(TREE[:depth])
        own = _weight(level, weights) if isinstance(weights, dict) else F.pow(F.col("tokens"), F.lit(weights))
        nodes = supply.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("supply").cast("double").alias("tokens")).withColumn("w", own).drop("tokens")
        parent = above.select(*parents, F.col("budget").alias("parent_budget"))
        # the root is one row
        nodes = nodes.join(parent, parents) if parents else nodes.join(F.broadcast(parent))
        above = _filled(nodes, parents, level)
    return supply.select(*TREE, "supply").join(above.select(*TREE, "budget"), list(TREE)).select(*TREE, "supply", F.floor(F.col("budget") + 1e-6).cast("long").alias("leaf_budget"))


def mix(docs: DataFrame, part: float = 1.0, epochs: int = EPOCHS, seed: int = SEED, weights: dict[str, dict[str, float]] | float | None = None) -> DataFrame:
    """Each document's leaf, tokens, its leaf's budget, and copies: how often the mix has it."""
    leaves = written(leaves_of(docs), "leaves")
    planned = budgets(leaves, part, epochs, weights or WEIGHTS)
    # a hot leaf's documents are spread over salts, and each leaf's one row is repeated for them
    salted = planned.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = leaves.withColumn("salt_", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    placed = spread.join(salted, [*TREE, "salt_"]).drop("salt_").withColumn("epochs", F.floor(F.col("leaf_budget") / F.col("supply")).cast("long"))
    hexed = F.md5(F.concat_ws(":", F.lit(seed), "epochs", F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    placed = placed.withColumn("draw_", F.conv(F.substring(hexed, 1, 12), 16, 10).cast("long")).withColumn("range_", F.shiftright("draw_", 38))
    offsets = bucket_offsets(placed, list(TREE), "range_", F.col("tokens"))
    within = Window.partitionBy(*TREE, "range_").orderBy("draw_", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    prefix = F.col("offset_") + F.col("through_") <= F.col("leaf_budget") - F.col("epochs") * F.col("supply")
    return placed.withColumn("through_", F.sum("tokens").over(within)).join(offsets, [*TREE, "range_"]).select(
        "doc_id", *TREE, "tokens", "leaf_budget", (F.col("epochs") + prefix.cast("int")).cast("int").alias("copies")
    )


def mixed(docs: DataFrame, part: float, weights: dict[str, dict[str, float]] | float | None = None, seed: int = SEED) -> DataFrame:
    """The documents, all columns, that one epoch's mix has, once each."""
    chosen = mix(docs, part, 1, seed, weights).where("copies > 0").select(F.col("doc_id").alias("tessella_id_")).distinct()
    return docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("tessella_id_")), "left_semi")


def op8_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_hierarchical_mixing": op8_hierarchical_mixing}


def _sql_weight(level: str) -> str:
    own = WEIGHTS[level]
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in own.items() if k != "other") + f" WHEN NULL THEN 0 ELSE {own['other']} END::DOUBLE"


def _sql_fill(name: str, source: str, parents: str, level: str) -> str:
    by, keys = (f"PARTITION BY {parents}", f"{parents}, ") if parents else ("", "")
    return f"""
        {name}_a AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft
            FROM {source} WINDOW o AS ({by} ORDER BY cap / w, {level})),
        {name}_b AS (SELECT *, (parent_budget - used) / lft AS share FROM {name}_a),
        {name}_c AS (SELECT *, arg_min(share, used) FILTER (cap > share * w) OVER ({by}) AS lvl FROM {name}_b),
        {name} AS (SELECT {keys}{level}, CASE WHEN cap <= share * w THEN cap ELSE least(cap, lvl * w) END AS budget FROM {name}_c)"""


SQL = {
    "op8_hierarchical_mixing": f"""
        WITH l AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'none' ELSE coalesce(['web', 'books', 'code', 'forum'][1 + try_cast(regexp_extract(source, '^src(\\d{{1,6}})$', 1) AS INT) // 5], 'other') END AS domain,
                   coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, greatest(ceil(coalesce(strlen(text), 0) / 4), 1)::BIGINT AS tokens FROM documents),
        s AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS supply, sum(tokens)::DOUBLE * {EPOCHS} AS cap FROM l GROUP BY ALL),
        r AS (SELECT least(sum(supply)::DOUBLE, sum(cap)) AS parent_budget FROM s),
        d0 AS (SELECT domain, sum(cap) AS cap, {_sql_weight("domain")} AS w, any_value(r.parent_budget) AS parent_budget FROM s, r GROUP BY domain),{_sql_fill("d", "d0", "", "domain")},
        g0 AS (SELECT domain, lang, sum(cap) AS cap, {_sql_weight("lang")} AS w, any_value(d.budget) AS parent_budget FROM s JOIN d USING (domain) GROUP BY domain, lang),{_sql_fill("g", "g0", "domain", "lang")},
        h0 AS (SELECT domain, lang, source, cap, 1.0::DOUBLE AS w, g.budget AS parent_budget FROM s JOIN g USING (domain, lang)),{_sql_fill("h", "h0", "domain, lang", "source")},
        p AS (SELECT l.*, supply, floor(budget + 1e-6)::BIGINT AS leaf_budget, (floor(budget + 1e-6)::BIGINT // supply) AS epochs FROM l JOIN s USING (domain, lang, source) JOIN h USING (domain, lang, source)),
        x AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY ('0x' || substr(md5('{SEED}:' || epochs || ':' || doc_id), 1, 12))::BIGINT, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS through FROM p)
        SELECT doc_id, domain, lang, source, tokens, leaf_budget, (epochs + CASE WHEN through <= leaf_budget - epochs * supply THEN 1 ELSE 0 END)::INT AS copies FROM x"""
}
