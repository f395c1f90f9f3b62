"""Two-phase features: ``fit_*`` learns a small parameter table, ``apply_*`` uses it.

All learned values live in one table ``(step, feature, key, value, place)``, saved and loaded as
parquet. Rows per feature are few, except segment medians and the categories of wide columns, which
are therefore joined, never collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.functions.expressions import as_number
from lendscope.operators.features import drop_columns, require_columns, stateless
from lendscope.operators.quantiles import collected_quantiles, exact_quantiles, unpivot_numbers
from lendscope.operators.splits import split_frame
from lendscope.operators.wide import join_places, number_categories, sparse_vector, wide_columns
from lendscope.sources.workspace import ensure_checkpoint_dir, settle

SCHEMA = "step string, feature string, key string, value double, place int"
SEGMENT_MEDIAN = "segment_median"
WIDE_CATEGORY, WIDE_SIZE, WIDE_ROWS = "wide_category", "wide_size", "wide_rows"
#: Categories that become a column each, over all nominal columns; the widest columns beyond become sparse vectors.
MAX_CATEGORIES = 10_000


def _local(spark, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), SCHEMA)


def _rows(params: DataFrame) -> dict[str, dict[str, list]]:
    """Collected parameters without the large tables: ``{step: {feature: rows by place}}``."""
    out: dict[str, dict[str, list]] = {}
    for r in params.where(~F.col("step").isin(SEGMENT_MEDIAN, WIDE_CATEGORY)).collect():
        out.setdefault(r["step"], {}).setdefault(r["feature"], []).append(r)
    for features in out.values():
        for rows in features.values():
            rows.sort(key=lambda r: r["place"])
    return out


def _overall(df: DataFrame, medians: Sequence[str], caps: Sequence[str], quantile: float) -> list[tuple]:
    """Ungrouped medians and caps from one shared pair of passes."""
    wanted = list(dict.fromkeys([*medians, *caps]))
    if not wanted:
        return []
    probs = sorted({*([0.5] if medians else []), *([quantile] if caps else [])})
    found = collected_quantiles(df, wanted, probs)
    rows = [("median", c, None, found[c][probs.index(0.5)], 0) for c in medians if c in found]
    return rows + [("cap", c, None, found[c][probs.index(quantile)], 0) for c in caps if c in found]


def _segment_rows(df: DataFrame, segments: Mapping[str, str]) -> list[DataFrame]:
    parts = []
    for group in dict.fromkeys(segments.values()):
        cols = [c for c, g in segments.items() if g == group]
        parts.append(
            exact_quantiles(df.where(F.col(group).isNotNull()), cols, [0.5], [group]).select(
                F.lit(SEGMENT_MEDIAN).alias("step"), F.col("name").alias("feature"),
                F.col(group).cast("string").alias("key"), F.col("quantiles")[0].alias("value"),
                F.lit(0).alias("place"),
            )
        )
    return parts


def _present(df: DataFrame, columns):
    if isinstance(columns, Mapping):
        return {c: g for c, g in columns.items() if c in df.columns}
    return [c for c in columns if c in df.columns]


def fit_segment_medians(df: DataFrame, segments: Mapping[str, str]) -> DataFrame:
    """Median of each column per value of its segment column, and over all rows."""
    present = _present(df, segments)
    overall = _local(df.sparkSession, _overall(df, list(present), [], 0.5))
    return reduce(DataFrame.unionByName, [overall, *_segment_rows(df, present)])


def apply_segment_medians(df: DataFrame, params: DataFrame, segments: Mapping[str, str]) -> DataFrame:
    """Fill nulls with the segment's median, else with the overall one."""
    overall = _rows(params).get("median", {})
    for col, group in segments.items():
        if col not in df.columns or col not in overall:
            continue
        medians = settle(
            params.where((F.col("step") == SEGMENT_MEDIAN) & (F.col("feature") == col)).select(
                F.col("key").alias("_segment"), F.col("value").alias("_median")
            )
        )
        joined = df.join(medians, df[group].cast("string") == medians["_segment"], "left")
        filled = F.coalesce(F.col(col), F.col("_median"), F.lit(overall[col][0]["value"]))
        df = joined.withColumn(col, filled).select(*df.columns)
    return df


def fit_caps(df: DataFrame, columns: Sequence[str], quantile: float = 0.99) -> DataFrame:
    return _local(df.sparkSession, _overall(df, [], _present(df, columns), quantile))


def apply_caps(df: DataFrame, params: DataFrame) -> DataFrame:
    """Cut values above the learned cap; nulls and columns without a cap stay as they are."""
    caps = {c: rows[0]["value"] for c, rows in _rows(params).get("cap", {}).items() if c in df.columns}
    return df.withColumns({
        c: F.when(as_number(c) > F.lit(cap), F.lit(cap)).otherwise(as_number(c)) for c, cap in caps.items()
    }) if caps else df


def fit_base(train: DataFrame, config: Mapping) -> DataFrame:
    """Imputation medians and caps, learned from the training rows only.

    A column that is both imputed and capped is capped at the quantile of its imputed values, as
    the steps follow each other; all other caps share the passes of the medians.
    """
    segments = _present(train, config.get("impute", {}))
    caps, quantile = _present(train, config.get("cap_columns", ())), config.get("cap_quantile", 0.99)
    overall = _local(
        train.sparkSession, _overall(train, list(segments), [c for c in caps if c not in segments], quantile)
    )
    params = reduce(DataFrame.unionByName, [overall, *_segment_rows(train, segments)])
    late = [c for c in caps if c in segments]
    if late:
        params = settle(params)
        params = params.unionByName(fit_caps(apply_segment_medians(train, params, segments), late, quantile))
    return params


def apply_base(df: DataFrame, params: DataFrame, config: Mapping) -> DataFrame:
    df = apply_segment_medians(df, params, config.get("impute", {}))
    df = apply_caps(df, params)
    return drop_columns(df, config.get("leakage", ()), config.get("drop", ()), [config["date_col"]])


def _fit_numeric(df: DataFrame, columns: Sequence[str]) -> list[tuple]:
    """Median, and mean and population spread after filling nulls with it.

    The spread of the filled column follows from the moments of the present values and the number
    of nulls, so the fill value need not be known while they are gathered.
    """
    if not columns:
        return []
    medians = {c: m[0] for c, m in collected_quantiles(df, columns, [0.5]).items()}
    moments = unpivot_numbers(df, columns, keep_nulls=True).groupBy("name").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("n"),
        F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    rows = [("fill", c, None, m, 0) for c, m in medians.items()]
    for r in moments.where("n > 0").collect():
        total, n, fill = r["rows"], r["n"], medians[r["name"]]
        missing = total - n
        mean = (n * r["mean"] + missing * fill) / total
        var = (n * (r["var"] + (r["mean"] - mean) ** 2) + missing * (fill - mean) ** 2) / total
        rows.append(("center", r["name"], None, mean, 0))
        rows.append(("spread", r["name"], None, var**0.5 or 1.0, 0))
    return rows


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([], list(columns), "name", "key").where(F.col("key").isNotNull())
    return long.groupBy("name", "key").agg(F.count(F.lit(1)).alias("n"))


def _fit_categories(
    df: DataFrame, nominal: Sequence[str], ordinal: Mapping[str, Sequence[str]], most: int
) -> tuple[list[tuple], list[DataFrame]]:
    """Parameter rows, and the tables of the wide columns' categories."""
    columns = [*nominal, *ordinal]
    if not columns:
        return [], []
    counts = settle(category_counts(df, columns))
    modes = counts.groupBy("name").agg(F.min(F.struct(-F.col("n"), F.col("key")))["key"].alias("key"))
    rows = [("mode", r["name"], r["key"], None, 0) for r in modes.collect()]
    tables = []
    if nominal:
        wide = wide_columns(counts, nominal, most)
        narrow = [c for c in nominal if c not in wide]
        found = counts.where(F.col("name").isin(narrow)).select("name", "key").orderBy("name", "key").collect()
        for c in narrow:
            keys = [r["key"] for r in found if r["name"] == c]
            rows += [("category", c, key, None, i) for i, key in enumerate(keys)]
        if wide:
            numbered = number_categories(counts.where(F.col("name").isin(wide)))
            ensure_checkpoint_dir(df.sparkSession)
            numbered = numbered.checkpoint()
            for r in numbered.groupBy("name").agg(F.max("size").alias("size"), F.sum("n").alias("n")).collect():
                rows += [(WIDE_SIZE, r["name"], None, float(r["size"]), 0), (WIDE_ROWS, r["name"], None, float(r["n"]), 0)]
            tables.append(numbered.select(
                F.lit(WIDE_CATEGORY).alias("step"), F.col("name").alias("feature"), "key", F.col("n").cast("double").alias("value"), "place"))
    for c, levels in ordinal.items():
        rows += [("level", c, level, None, i) for i, level in enumerate(levels)]
    return rows, tables


def fit_encoder(
    train: DataFrame, numeric: Sequence[str], nominal: Sequence[str], ordinal: Mapping[str, Sequence[str]],
    most: int = MAX_CATEGORIES,
) -> DataFrame:
    """Fill values, scales, modes and categories for ``apply_encoder``.

    Nominal columns with at most ``most`` categories together become 0/1 columns. Where there are more, the widest
    columns are encoded as sparse vectors, whose categories are a table of any length.
    """
    require_columns(train, [*numeric, *nominal, *ordinal])
    rows, tables = _fit_categories(train, list(nominal), ordinal, most)
    small = _local(train.sparkSession, _fit_numeric(train, list(numeric)) + rows)
    return reduce(DataFrame.unionByName, [small, *tables])


def encoder_expressions(
    params: DataFrame, numeric: Sequence[str], nominal: Sequence[str], ordinal: Mapping[str, Sequence[str]]
) -> dict:
    """Feature name → expression, in the order numeric, nominal, ordinal.

    Numbers are filled with the median and standardised by the population spread. Nominal columns
    become one 0/1 column per category, the first (in sorted order) left out. Ordinal columns become
    their 0-based position, -1 for an unknown level. Wide nominal columns are left to ``apply_encoder``.
    """
    known = _rows(params)
    out = {}
    for c in numeric:
        fill = known.get("fill", {}).get(c)
        if fill is None:
            continue
        center, spread = known["center"][c][0]["value"], known["spread"][c][0]["value"]
        value = F.coalesce(as_number(c), F.lit(fill[0]["value"]))
        out[f"numeric__{c}"] = (value - F.lit(center)) / F.lit(spread)
    for c in nominal:
        mode = known.get("mode", {}).get(c)
        value = F.coalesce(F.col(c).cast("string"), F.lit(mode[0]["key"] if mode else None))
        for r in known.get("category", {}).get(c, [])[1:]:
            out[f"categoric__{c}_{r['key']}"] = F.coalesce((value == r["key"]).cast("double"), F.lit(0.0))
    for c in ordinal:
        mode = known.get("mode", {}).get(c)
        value = F.coalesce(F.col(c).cast("string"), F.lit(mode[0]["key"] if mode else None))
        levels = F.array(*[F.lit(r["key"]) for r in known["level"][c]])
        out[f"cat_ord__{c}"] = F.coalesce(F.array_position(levels, value) - 1, F.lit(-1)).cast("double")
    return out


def apply_encoder(df: DataFrame, params: DataFrame, config: Mapping, keep: Sequence[str] = ()) -> DataFrame:
    """The feature table: encoded columns, all others dropped but those in ``keep``.

    A wide nominal column becomes one sparse vector ``categoric__<name>`` with a slot per category but the first; an
    unknown category has no slot.
    """
    exprs = encoder_expressions(params, config["numeric"], config["nominal"], config["ordinal"])
    known = _rows(params)
    wide = [c for c in config["nominal"] if c in known.get(WIDE_SIZE, {})]
    for c in wide:
        categories = params.where((F.col("step") == WIDE_CATEGORY) & (F.col("feature") == c)).select(
            "key", F.col("value").alias("n"), "place")
        value = F.coalesce(F.col(c).cast("string"), F.lit(known["mode"][c][0]["key"]))
        df = join_places(df, value, categories, int(known[WIDE_ROWS][c][0]["value"]), f"_place_{c}")
        size = int(known[WIDE_SIZE][c][0]["value"]) - 1
        place = F.col(f"_place_{c}")
        exprs[f"categoric__{c}"] = sparse_vector(size, F.when(place > 0, place - 1))
    return df.select(*keep, *[x.alias(name) for name, x in exprs.items()])


def build_features(df: DataFrame, config: Mapping, event: str, keep: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Stateless steps on all rows, split, then fitted steps learned from train and applied to both.

    ``config`` holds ``derived``, ``catalogues``, ``split``, ``date_col``, ``impute``,
    ``cap_columns``, ``cap_quantile``, ``leakage``, ``drop``, ``numeric``, ``nominal``, ``ordinal``.
    Returns ``train``, ``test`` (encoded), ``train_base``, ``test_base`` (original scale) and the
    parameter table ``params``; ``keep`` and the event column stay in all of them.
    """
    train_raw, test_raw = split_frame(stateless(df, config), config["split"], event)
    held = [*keep, event]
    base_config = {**config, "drop": [c for c in config.get("drop", ()) if c not in held]}
    base_params = fit_base(train_raw, base_config)
    base_params = settle(base_params)
    train_base = apply_base(train_raw, base_params, base_config)
    test_base = apply_base(test_raw, base_params, base_config)
    encoder = fit_encoder(train_base, config["numeric"], config["nominal"], config["ordinal"])
    params = base_params.unionByName(encoder)
    return {
        "train": apply_encoder(train_base, encoder, config, held),
        "test": apply_encoder(test_base, encoder, config, held),
        "train_base": train_base,
        "test_base": test_base,
        "params": params,
    }


def apply_fitted(df: DataFrame, params: DataFrame, config: Mapping, keep: Sequence[str] = ()) -> DataFrame:
    """The same steps on new rows, with saved parameters and nothing learned."""
    base_config = {**config, "drop": [c for c in config.get("drop", ()) if c not in keep]}
    base = apply_base(stateless(df, config), params, base_config)
    return apply_encoder(base, params, config, keep)


def fit_combined(df: DataFrame, config: Mapping) -> tuple[DataFrame, DataFrame]:
    """Five steps without a split: derive, clean, impute, cap, drop leakage and date only."""
    ready = stateless(df, config)
    slim = {**config, "drop": ()}
    params = settle(fit_base(ready, slim))
    return apply_base(ready, params, slim), params
