"""Mixing sources to target weights by iterative proportional fitting (raking)."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, materialise

DIMENSIONS = ("source", "lang", "topic")
#: Each marginal's target share grows with the observed share to this power, so large groups shrink.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def surface_topic(text: Column, n_words: Column) -> Column:
    """A topic from the look of a text, for tables without one: empty, table, loud, numbers, short, prose."""
    length = F.length(text)
    times = lambda mark: length - F.length(F.replace(text, F.lit(mark), F.lit("")))
    digits = length - F.length(F.translate(text, "0123456789", ""))
    return (
        F.when(n_words == 0, "empty")
        .when(times("|") * 20 > n_words, "table")
        .when(times("!") * 4 > n_words, "loud")
        .when(digits * 50 > length, "numbers")
        .when(n_words < 120, "short")
        .otherwise("prose")
    )


def tempered_targets(cells: list[tuple], temper: dict = TEMPER) -> dict[str, dict]:
    """Target shares of each marginal: observed token shares to a power, made to sum to 1."""
    targets = {}
    for k, dimension in enumerate(DIMENSIONS):
        sums = defaultdict(float)
        for *keys, tokens in cells:
            sums[keys[k]] += tokens
        powered = {v: s ** temper[dimension] for v, s in sums.items() if s > 0}
        total = sum(powered.values())
        targets[dimension] = {v: p / total for v, p in powered.items()}
    return targets


def _marginal(cells: list[tuple], weights: list[float], k: int) -> dict:
    sums = defaultdict(float)
    for c, w in zip(cells, weights):
        sums[c[k]] += w
    return sums


def marginal_error(cells: list[tuple], weights: list[float], targets: dict[str, dict]) -> float:
    """Largest difference between a marginal's share and its target."""
    total = sum(weights) or 1.0
    shares = ((d, v, s / total) for k, d in enumerate(DIMENSIONS) for v, s in _marginal(cells, weights, k).items())
    return max((abs(s - targets[d].get(v, 0.0)) for d, v, s in shares), default=0.0)


def rake(cells: list[tuple], targets: dict[str, dict], rounds: int = 100, tolerance: float = 1e-6) -> list[float]:
    """Token weights whose marginals approach the targets: each round scales to one marginal after the
    other, until no share is further than tolerance from its target, or for so many rounds."""
    total = sum(c[-1] for c in cells)
    weights = [float(c[-1]) for c in cells]
    for _ in range(rounds):
        for k, dimension in enumerate(DIMENSIONS):
            scale = {v: targets[dimension].get(v, 0.0) * total / s if s else 0.0 for v, s in _marginal(cells, weights, k).items()}
            weights = [w * scale[c[k]] for c, w in zip(cells, weights)]
        if marginal_error(cells, weights, targets) <= tolerance:
            break
    return weights


def calibrate(cells: list[tuple], weights: list[float], budget: float) -> list[float]:
    """Sampling probability of each cell: its weight a token times one factor, at most 1, so that the
    expected tokens are the budget's share of all (all of them where that can't be reached)."""
    ratio = [w / c[-1] if c[-1] else 0.0 for c, w in zip(cells, weights)]
    left = budget * sum(c[-1] for c in cells)
    rest = sum(c[-1] * r for c, r in zip(cells, ratio))
    factor = 0.0
    for k in sorted(range(len(cells)), key=lambda k: -ratio[k]):
        factor = left / rest if rest > 0 else 0.0
        if factor * ratio[k] <= 1:
            break
        left, rest = left - cells[k][-1], rest - cells[k][-1] * ratio[k]
    return [min(1.0, max(0.0, factor) * r) if c[-1] else 1.0 for c, r in zip(cells, ratio)]


def _rake_table(cells: DataFrame, targets: DataFrame | None, rounds: int, tolerance: float, budget: float, temper: dict) -> DataFrame:
    """The same over a table of cells that is too large for the driver: a join and an aggregate a marginal,
    and the same exact factor.  targets: dimension, value, share."""
    total = cells.agg(F.sum("tokens")).first()[0]
    state = cells.withColumn("w", F.col("tokens").cast("double"))
    wanted = {}
    for d in DIMENSIONS:
        if targets is None:
            powered = cells.groupBy(d).agg(F.sum("tokens").alias("s")).where("s > 0").select(d, F.pow("s", F.lit(temper[d])).alias("p"))
            whole = powered.agg(F.sum("p")).first()[0]
            wanted[d] = materialise(powered.select(d, (F.col("p") / whole * total).alias("target")), "rake-target")
        else:
            wanted[d] = targets.where(F.col("dimension") == d).select(F.col("value").alias(d), (F.col("share") * total).alias("target"))
    for _ in range(rounds):
        for d in DIMENSIONS:
            scale = state.groupBy(d).agg(F.sum("w").alias("s")).join(wanted[d], d, "left")
            scale = scale.select(d, F.when(F.col("s") > 0, F.coalesce("target", F.lit(0.0)) / F.col("s")).otherwise(0.0).alias("scale"))
            state = state.join(scale, d).withColumn("w", F.col("w") * F.col("scale")).drop("scale")
        state = materialise(state, "rake")
        apart = [
            state.groupBy(d).agg(F.sum("w").alias("s")).join(wanted[d], d, "left").agg(F.max(F.abs(F.col("s") - F.coalesce("target", F.lit(0.0)))))
            for d in DIMENSIONS
        ]
        if max(x.first()[0] or 0.0 for x in apart) <= tolerance * total:
            break
    state = state.withColumn("r", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0))
    # Between low and high lies the factor; the cells that it caps are known once no 1 / r lies there too.
    low, high = 0.0, 1.0 / max(1e-300, state.where("r > 0").agg(F.min("r")).first()[0] or 1.0)
    for _ in range(12):  # 64 probes a pass
        grid = [low + (high - low) * k / 64 for k in range(65)]
        sums = state.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("r") * g)) for g in grid]).first()
        at = sum(s < budget * total for s in sums[1:-1])
        low, high = grid[at], grid[at + 1]
        if state.where((F.col("r") * high > 1) & (F.col("r") * low < 1)).isEmpty():
            break
    capped = F.col("r") * (low + high) / 2 >= 1
    full, rest = state.agg(F.sum(F.when(capped, F.col("tokens"))), F.sum(F.when(~capped, F.col("w")))).first()
    factor = (budget * total - (full or 0)) / rest if rest else high
    return state.select(*DIMENSIONS, F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("r") * factor)).otherwise(1.0).alias("p"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that the id and the seed decide, so a rerun samples the same documents."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def measure(docs: DataFrame) -> DataFrame:
    """docs with n_tokens (words), and with a topic where there is none."""
    docs = docs.withColumn("n_tokens", count_words(F.col("text")))
    if "topic" in docs.columns:
        return docs
    return docs.withColumn("topic", surface_topic(F.coalesce("text", F.lit("")), F.col("n_tokens")))


def _targets_table(spark, targets) -> DataFrame | None:
    """Given shares as rows (dimension, value, share)."""
    if targets is None or isinstance(targets, DataFrame):
        return targets
    rows = [(d, v, float(s)) for d, shares in targets.items() for v, s in shares.items()]
    return spark.createDataFrame(rows, "dimension string, value string, share double")


def mix(
    docs: DataFrame,
    budget: float = 0.5,
    rounds: int = 100,
    seed: int = 42,
    temper: dict = TEMPER,
    targets: dict[str, dict] | DataFrame | None = None,
    most_cells: int = 100_000,
    tolerance: float = 1e-6,
) -> DataFrame:
    """docs with topic, n_tokens (words), probability and sampled; columns of these names are replaced,
    but a topic column that is there is used.

    Tokens are summed by source, language and topic; raking fits the cells' weights to the targets of
    all three marginals, until all shares are within tolerance or for so many rounds; each document of
    a cell is then sampled with the cell's calibrated probability.  targets are shares by dimension and
    value, as a dict of dicts or a table (dimension, value, share); without them, observed shares to a
    power.  Values without a target get weight 0.  Up to most_cells cells are raked on the driver and
    broadcast; more are raked as tables, with the same result.  Sampling is the feature: sampled marks
    rows and drops none.

    Null source, language or topic counts as an empty one.  Texts without words weigh nothing and have
    probability 1.  Rows of equal doc_id are sampled together.  An empty table gives an empty table.
    """
    return mix_measured(measure(docs), budget, rounds, seed, temper, targets, most_cells, tolerance)


def mix_measured(docs: DataFrame, budget, rounds=100, seed=42, temper=TEMPER, targets=None, most_cells=100_000, tolerance=1e-6) -> DataFrame:
    """mix() of documents that have n_tokens and topic; their text is not read."""
    key = [f"__{d}" for d in DIMENSIONS]
    docs = docs.withColumns({k: F.coalesce(F.col(d).cast("string"), F.lit("")) for k, d in zip(key, DIMENSIONS)})
    cells = docs.groupBy(*[F.col(k).alias(d) for k, d in zip(key, DIMENSIONS)]).agg(F.sum("n_tokens").alias("tokens"))
    cells = materialise(cells, "mix-cells")
    wanted = _targets_table(docs.sparkSession, targets)
    if cells.count() <= most_cells:
        rows = sorted(map(tuple, cells.collect()))
        shares = tempered_targets(rows, temper)
        if wanted is not None:  # of the values that are there, so as few as the cells
            there = [(d, v) for k, d in enumerate(DIMENSIONS) for v in {c[k] for c in rows}]
            there = F.broadcast(docs.sparkSession.createDataFrame(there, "dimension string, value string"))
            shares = {d: {} for d in DIMENSIONS}
            for d, v, s in wanted.join(there, ["dimension", "value"]).select("dimension", "value", "share").collect():
                shares[d][v] = s
        fitted = calibrate(rows, rake(rows, shares, rounds, tolerance), budget)
        table = [(*c[:-1], p) for c, p in zip(rows, fitted)]
        found = F.broadcast(docs.sparkSession.createDataFrame(table, "source string, lang string, topic string, p double"))
    else:
        found = _rake_table(cells, wanted, rounds, tolerance, budget, temper)
    found = found.select(*[F.col(d).alias(k) for d, k in zip(DIMENSIONS, key)], F.round("p", 9).alias("probability"))
    return (
        docs.drop("probability", "sampled")
        .join(found, key)
        .withColumn("sampled", uniform(F.col("doc_id"), seed) < F.col("probability"))
        .drop(*key)
    )


def reached_shares(mixed: DataFrame) -> DataFrame:
    """dimension, value, share: the expected token shares that a mixture's probabilities give."""
    weight = F.col("n_tokens") * F.col("probability")
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")) for d in DIMENSIONS]))
    sums = mixed.select(each.alias("m"), weight.alias("w")).groupBy("m.dimension", "m.value").agg(F.sum("w").alias("s"))
    whole = mixed.agg(F.sum(weight).alias("whole"))
    return sums.crossJoin(F.broadcast(whole)).select("dimension", "value", F.when(F.col("whole") > 0, F.col("s") / F.col("whole")).otherwise(0.0).alias("share"))


def op3_rake_mixture(spark, sf_dir: str) -> DataFrame:
    """Per document its cell, tokens, calibrated probability (twelve rounds) and whether it is sampled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = materialise(measure(docs).select("doc_id", "source", "lang", "topic", "n_tokens"), "measured")
    mixed = mix_measured(narrow, 0.5, rounds=12, tolerance=0.0)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 7).alias("probability"), "sampled")
