"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions alone.

The tree is domain, language, source. A token budget enters at the root and is split among the children of each node
by their weights, but no child gets more than its subtree can give (its tokens times ``max_epochs``): what one child
lacks goes to its siblings, and leaves the parent only when all of them are full. Siblings are filled in closed form:
ordered by capacity over weight, a child is full as long as that ratio is at most what is left over the weights left.

A leaf with ``t`` tokens and a budget ``b`` gives each document ``b div t`` times and, in one more epoch, the longest
prefix of its documents, in the order of a seeded digest for that epoch, whose tokens stay within the rest.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}
SEED, FRACTION, MAX_EPOCHS = 17, 0.5, 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_NAME = "^[^0-9./:_-]+"


def domain_of(source: Column) -> Column:
    """The default domain of a source: its name before the first digit or separator, else ``?``."""
    name = F.regexp_extract(source, _NAME, 0)
    return F.when(name != "", name).otherwise("?")


def _weight(col: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, w in sorted(weights.items()):
        out = F.when(col == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def leaf_budgets(
    leaves: DataFrame, fraction: float, max_epochs: int, weights: Mapping[str, Mapping[str, int]]
) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``budget`` long, ``full`` epochs and ``rest`` tokens."""
    tree = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))  # one row
    up = tree.crossJoin(F.broadcast(total)).withColumn("got", F.floor(F.col("all_tokens") * F.lit(float(fraction))).cast("double"))
    for depth, level in enumerate(LEVELS):
        path, parent = LEVELS[: depth + 1], LEVELS[:depth]
        node = up.groupBy(*path).agg(F.sum("cap").alias("c"), F.max("got").alias("b"))
        node = node.withColumn("w", _weight(F.col(level), weights.get(level, {})))
        kin = Window.partitionBy(*(parent or [F.lit(0)]))
        order = kin.orderBy(F.col("c").cast("double") / F.col("w"), level)
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        node = (
            node.withColumn("c_before", F.coalesce(F.sum("c").over(before), F.lit(0)))
            .withColumn("w_left", F.sum("w").over(after))
            .withColumn("sat", F.col("c") * F.col("w_left") <= F.col("w") * (F.col("b") - F.col("c_before")))
            .withColumn("open_w", F.sum(F.when(~F.col("sat"), F.col("w")).otherwise(0)).over(kin))
            .withColumn("full_c", F.sum(F.when(F.col("sat"), F.col("c")).otherwise(0)).over(kin))
            .withColumn(
                "give",
                F.when(F.col("sat"), F.col("c").cast("double")).otherwise(
                    F.col("w") * (F.col("b") - F.col("full_c")) / F.col("open_w")
                ),
            )
        )
        up = up.drop("got").join(node.select(*path, F.col("give").alias("got")), list(path))
    budget = F.floor(F.col("got")).cast("long")
    return up.select(
        *LEVELS,
        "tokens",
        budget.alias("budget"),
        F.when(F.col("tokens") > 0, F.expr("cast(floor(got) as bigint) div tokens")).otherwise(0).alias("full"),
    ).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))


def _leaf(df: DataFrame, domain: Column | None) -> dict[str, Column]:
    src = F.coalesce(F.col("source").cast("string"), F.lit("?"))
    return {
        "domain": domain_of(src) if domain is None else F.coalesce(domain, F.lit("?")),
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit("?")),
        "source": src,
    }


def _key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.col("doc_id").cast("long")))


def draws(docs: DataFrame, fraction: float, max_epochs: int, seed: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """For each leaf of ``docs`` (doc_id, domain, lang, source, n_tokens): ``leaf_budget``, ``full`` epochs and the ``last`` key of
    one more epoch, null if it draws nothing.

    A leaf's documents are dealt out by leaf and the first three digits of their digest, so a leaf with a third of all rows is
    4,096 groups; only their sums are accumulated over a leaf.
    """
    leaves = saved(docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    budgets = saved(leaf_budgets(leaves, fraction, max_epochs, weights), "mix-budgets")
    keyed = docs.join(budgets, list(LEVELS)).withColumn("key", _key(seed, F.col("full") + 1)).withColumn("slice", F.substring("key", 1, 3))
    group = [*LEVELS, "slice"]
    sums = keyed.groupBy(*group).agg(F.sum("n_tokens").alias("slice_tokens"))
    over = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("slice_tokens").over(over), F.lit(0))).drop("slice_tokens")
    run = F.sum("n_tokens").over(Window.partitionBy(*group).orderBy("key"))  # equal keys count together
    drawn = keyed.withColumn("run", run).join(starts, group).filter(F.col("start") + F.col("run") <= F.col("rest"))
    last = drawn.groupBy(*group).agg(F.max("key").alias("last")).groupBy(*LEVELS).agg(F.max("last").alias("last"))
    return budgets.join(last, list(LEVELS), "left").select(*LEVELS, F.col("budget").alias("leaf_budget"), "full", "last")


def _epochs(seed: int) -> Column:
    return (F.col("full") + F.coalesce((_key(seed, F.col("full") + 1) <= F.col("last")).cast("long"), F.lit(0))).cast("long")


def _prepared(df: DataFrame, domain: Column | None) -> DataFrame:
    leaf = _leaf(df, domain)
    return saved(df.select(F.col("doc_id").cast("long").alias("doc_id"), *(leaf[x].alias(x) for x in LEVELS), n_words(F.col("text")).alias("n_tokens")), "mix-docs")


def mix(
    df: DataFrame,
    fraction: float = FRACTION,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    weights: Mapping[str, Mapping[str, int]] | None = None,
    domain: Column | None = None,
) -> DataFrame:
    """Documents chosen, with the number of epochs: ``doc_id, domain, lang, source, n_tokens, epochs, leaf_budget``.

    ``fraction`` of all tokens (words) is the budget. Weights are positive integers by level and name, else 1.
    Null language or source is a leaf named ``?``; null or empty texts count no token and come along with an epoch's
    prefix; rows of one leaf with one doc_id (null as any other) are chosen or left together; an empty table gives no row; extra
    columns are not read.
    """
    docs = _prepared(df, domain)
    told = saved(draws(docs, fraction, max_epochs, seed, {"lang": LANGUAGE_WEIGHTS} if weights is None else weights), "mix-draws")
    return docs.join(told, list(LEVELS)).withColumn("epochs", _epochs(seed)).filter("epochs > 0").select("doc_id", *LEVELS, "n_tokens", "epochs", "leaf_budget")


def mixed_rows(
    df: DataFrame,
    fraction: float = FRACTION,
    seed: int = SEED,
    weights: Mapping[str, Mapping[str, int]] | None = None,
    domain: Column | None = None,
) -> DataFrame:
    """The rows of ``df`` that ``mix`` draws in at most one epoch, with all their columns.

    Each row is decided by its own leaf and key against what its leaf draws, so texts are not joined by id; where the leaves are
    many, rows are joined with them by leaf.
    """
    told = draws(_prepared(df, domain), fraction, 1, seed, {"lang": LANGUAGE_WEIGHTS} if weights is None else weights)
    told = saved(told.select(*(F.col(x).alias(f"mix_{x}") for x in LEVELS), "full", "last"), "mix-draws")
    leaf = _leaf(df, domain)
    rows = df.select(F.struct(*df.columns).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), *(leaf[x].alias(f"mix_{x}") for x in LEVELS))
    return rows.join(told, [f"mix_{x}" for x in LEVELS]).filter(_epochs(seed) > 0).select(*(F.col("own")[c].alias(c) for c in df.columns))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the corpus's words, mixed from all ``documents`` by the default weights."""
    return mix(table(spark, sf_dir, "documents"))


def _level_sql(depth: int) -> str:
    path, parent = LEVELS[: depth + 1], LEVELS[:depth]
    level = LEVELS[depth]
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(LANGUAGE_WEIGHTS.items())) if level == "lang" else ""
    weight = f"CASE {level} {cases} ELSE 1 END" if cases else "1"
    kin = f"PARTITION BY {', '.join(parent)}" if parent else ""
    cols = ", ".join(path)
    return f"""
n{depth} AS (SELECT {cols}, sum(cap)::BIGINT AS c, max(got) AS b, ({weight})::BIGINT AS w FROM u{depth} GROUP BY {cols}),
o{depth} AS (SELECT *,
  coalesce(sum(c) OVER ({kin} ORDER BY c::DOUBLE / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c_before,
  (sum(w) OVER ({kin} ORDER BY c::DOUBLE / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_left FROM n{depth}),
s{depth} AS (SELECT *, (c * w_left)::DOUBLE <= w * (b - c_before) AS sat FROM o{depth}),
g{depth} AS (SELECT {cols}, CASE WHEN sat THEN c::DOUBLE ELSE
  w * (b - (sum(CASE WHEN sat THEN c ELSE 0 END) OVER ({kin}))::BIGINT) / (sum(CASE WHEN sat THEN 0 ELSE w END) OVER ({kin}))::BIGINT END AS got FROM s{depth}),
u{depth + 1} AS (SELECT u{depth}.* EXCLUDE (got), g{depth}.got FROM u{depth} JOIN g{depth} USING ({cols})),"""


OP10_SQL = rf"""
WITH docs AS (
  SELECT doc_id::BIGINT AS doc_id, coalesce(nullif(regexp_extract(coalesce(source, '?'), '{_NAME}'), ''), '?') AS domain, coalesce(lang, '?') AS lang,
    coalesce(source, '?') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
u0 AS (SELECT *, (tokens * {MAX_EPOCHS})::BIGINT AS cap, floor((SELECT sum(tokens) FROM leaves)::DOUBLE * {FRACTION})::DOUBLE AS got FROM leaves),
{_level_sql(0)}{_level_sql(1)}{_level_sql(2)}
budgets AS (SELECT domain, lang, source, tokens, floor(got)::BIGINT AS budget,
  CASE WHEN tokens > 0 THEN floor(got)::BIGINT // tokens ELSE 0 END AS epochs_full FROM u3),
run AS (SELECT d.*, b.budget, b.epochs_full, b.budget - b.epochs_full * b.tokens AS rest,
  sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source
    ORDER BY md5('{SEED}:' || (b.epochs_full + 1)::VARCHAR || ':' || doc_id::VARCHAR), doc_id) AS run
  FROM docs d JOIN budgets b ON d.domain = b.domain AND d.lang = b.lang AND d.source = b.source)
SELECT doc_id, domain, lang, source, n_tokens, (epochs_full + CASE WHEN run <= rest THEN 1 ELSE 0 END)::BIGINT AS epochs,
  budget AS leaf_budget
FROM run WHERE epochs_full + CASE WHEN run <= rest THEN 1 ELSE 0 END > 0
"""
