"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.
DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import WORD, unused
from rollcall.session import forget, saved

NONE = "(none)"
#: Sweeps between two written tables.
SWEEPS_A_ROUND = 4
#: Up to so many cells are raked in one task: no sweep shuffles them then, which spares the driver a job for
#: each window. More cells are dealt by category, with the same steps.
CELLS_A_TASK = 100_000
#: Topics by surface form, the first that holds.
TOPICS = (("table", " | "), ("licence", "License"), ("contact", "@"), ("secret", "token ="))


def topic_of(text_col: str = "text") -> Column:
    found = F.lit(None).cast("string")
    for name, mark in reversed(TOPICS):
        found = F.when(F.col(text_col).contains(mark), F.lit(name)).otherwise(found)
    return F.coalesce(found, F.lit("prose"))


def described(docs: DataFrame, dims: dict[str, Column], text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_tokens (words of the text, 0 if null) and dim_<name> for each dimension, all under
    prefix; a null value is a category of its own."""
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({f"{prefix}n_tokens": tokens} | {f"{prefix}dim_{k}": F.coalesce(c.cast("string"), F.lit(NONE)) for k, c in dims.items()})


def smoothed_targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(dim, target): each category's share of tokens to the given power, scaled to sum to 1. A power
    of 1 keeps the corpus, 0 makes categories equal."""
    shares = cells.groupBy(dim).agg(F.sum("n").alias("m")).where("m > 0")
    total = shares.agg(F.sum(F.pow("m", F.lit(power))).alias("all"))
    return shares.crossJoin(F.broadcast(total)).select(dim, (F.pow("m", F.lit(power)) / F.col("all")).alias("target"))


def gathered(cells: DataFrame, few: bool) -> DataFrame:
    """cells in one partition if they are few: groups and windows need no exchange there."""
    return cells.coalesce(1) if few else cells


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float, sweeps: int = 20, tolerance: float = 1e-9) -> DataFrame:
    """cells (dimensions, n) with share and w, the share of tokens each cell should have.

    Starts from the cells' own shares and scales them in turn to each dimension's target shares
    (dim, target), which need not cover all categories: one without a target gets none, and a target
    whose category has no tokens, or only cells that another dimension's targets leave out, gets none
    either. After each sweep w is held to share / budget, so that no probability exceeds 1 and the next
    sweep deals the excess to others; where too many cells are held, the marginals fall short of
    their targets, which `residuals` tells. Ends when no w has moved by more than `tolerance` in a
    sweep, or after `sweeps`. Only that largest move comes to the driver, once for several sweeps. The
    cells are far fewer than documents, but stay a distributed table above CELLS_A_TASK.
    """
    few = cells.count() <= CELLS_A_TASK
    total = cells.agg(F.sum("n").alias("all"))
    dims = list(targets)
    now = gathered(cells, few).where("n > 0").crossJoin(F.broadcast(total)).select(*dims, "n", (F.col("n") / F.col("all")).alias("share"))
    for k, d in enumerate(dims):
        now = now.join(targets[d].select(d, F.col("target").alias(f"_t{k}")), d, "left")
    now = gathered(saved(now.select(*dims, "n", "share", *[F.coalesce(f"_t{k}", F.lit(0.0)).alias(f"_t{k}") for k in range(len(dims))], F.col("share").alias("w")), "cells"), few)
    done = 0
    while done < sweeps:
        step = min(SWEEPS_A_ROUND, sweeps - done)
        after = now
        for _ in range(step):
            after = after.withColumn("_w", F.col("w"))
            for k, d in enumerate(dims):
                have = F.sum("w").over(Window.partitionBy(d))
                after = after.withColumn("w", F.coalesce(F.try_divide(F.col("w") * F.col(f"_t{k}"), have), F.lit(0.0)))
            after = after.withColumn("w", F.least("w", F.col("share") / budget))
        after = gathered(saved(after, "cells"), few)
        forget(now)
        now, done = after.drop("_w"), done + step
        if (after.agg(F.max(F.abs(F.col("w") - F.col("_w")))).first()[0] or 0.0) <= tolerance:
            break
    return now.drop(*[f"_t{k}" for k in range(len(dims))])


def residuals(sampled: DataFrame, targets: dict[str, DataFrame], prefix: str = "") -> DataFrame:
    """(dim, category, target, got, residual): for each category of each dimension the share of tokens
    aimed at, the share expected by the probabilities of the rows of sample(), and the difference. Shows
    how far a budget too large for the targets keeps the mixture from them."""
    out = None
    for d, t in targets.items():
        weight = F.sum(F.col(f"{prefix}probability") * F.col(f"{prefix}n_tokens"))
        got = sampled.groupBy(F.col(d).alias("category")).agg(weight.alias("w"))
        all_ = got.agg(F.sum("w").alias("all"))
        got = got.crossJoin(F.broadcast(all_)).select("category", F.try_divide("w", "all").alias("got"))
        both = got.join(t.select(F.col(d).alias("category"), "target"), "category", "full").select(F.lit(d).alias("dim"), "category", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("got", F.lit(0.0)).alias("got"))
        out = both if out is None else out.union(both)
    return out.withColumn("residual", F.col("got") - F.col("target"))


def wanted_shares(cells: DataFrame, dims: dict[str, str], power: float, targets: dict[str, dict[str, float]] | None = None) -> dict[str, DataFrame]:
    """The target shares (column, target) by column for each dimension (name, column): those given by
    hand, scaled to sum to 1 (all 0 stay so, and take nothing), or else smoothed ones."""
    spark, out = cells.sparkSession, {}
    for k, name in dims.items():
        given = (targets or {}).get(k)
        total = sum(given.values()) if given else 0
        out[name] = spark.createDataFrame([(c, float(v) / total if total else 0.0) for c, v in given.items()], f"`{name}` string, target double") if given else smoothed_targets(cells, name, power)
    return out


def sample(docs: DataFrame, dims: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", power: float = 0.7, budget: float = 0.8, sweeps: int = 20, seed: int = 42, targets: dict[str, dict[str, float]] | None = None, prefix: str = "") -> DataFrame:
    """docs with n_tokens, the dimensions (dim_<name>), probability and selected, their names under
    prefix; columns of docs with the same names are replaced.

    Cells are the combinations of categories. Their token weights are raked to the target shares
    (given by hand, or smoothed shares of the corpus), and a document of a cell is selected with
    probability budget * w / share, at most 1, decided by a hash of seed and id: the same run after
    run and wherever the row lies. Rows with the same id share their fate; a null id counts as one
    id; documents without words (null or empty text) have no tokens to weigh and share their cell's
    probability, or are kept where nothing in the cell has words; a text of any length counts by all its words; a probability that falls on a row's own number leaves the row out.
    Other columns stay as they are; an empty table gives no rows.
    """
    known = described(docs, dims, text_col, prefix)
    names = [f"{prefix}dim_{k}" for k in dims]
    cells = saved(known.groupBy(*names).agg(F.sum(f"{prefix}n_tokens").alias("n")), "mix-cells")
    cells = gathered(cells, cells.count() <= CELLS_A_TASK)
    wanted = wanted_shares(cells, dict(zip(dims, names)), power, targets)
    chance = unused(known, "chance")
    raked = rake(cells, wanted, budget, sweeps).select(*names, F.least(F.lit(1.0), budget * F.col("w") / F.col("share")).alias(chance))
    p = F.floor(F.coalesce(F.col(chance), F.lit(1.0)) * 1e6 + 0.5) / 1e6
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(NONE)))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    added = [f"{prefix}n_tokens", *names, f"{prefix}probability", f"{prefix}selected"]
    out = known.join(raked, names, "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], *added[: 1 + len(names)], p.alias(added[-2]), (u < p).alias(added[-1]))
