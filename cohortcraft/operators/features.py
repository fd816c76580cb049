"""Train-only feature preparation (M3-M8).

Fitting follows MLlib's estimator/model split: ``fit_*`` runs one
aggregation over the training rows and brings back only parameters whose
size does not depend on the number of rows (a mean and a standard
deviation per column, at most ``top`` values per column, the sorted labels
of an already-shrunk column); ``transform`` is a pure projection that uses
them as literals, so it is fused into whatever stage reads the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bucket_hash
from ..session import cut_lineage, written
from . import clean, profile

KEY = "loan_id"
LABEL = "interest_rate"
SPLIT_COLUMN = "is_test"
# Columns of the loan fixture that identify a row or its split, never features.
NON_FEATURES = (KEY, "split_bucket", LABEL, SPLIT_COLUMN)
TEST_PCT = 20
TOP_CATEGORIES = 15


def split(df: DataFrame, key: str = KEY, test_pct: int = TEST_PCT, buckets: int = 100) -> DataFrame:
    """M3: ``is_test`` = hash bucket of the key < test_pct (80:20 by default).
    Disjoint, exhaustive and reproducible under any partitioning."""
    return df.withColumn(SPLIT_COLUMN, bucket_hash(key, buckets) < test_pct)


@dataclass
class Standardizer:
    """M4: (x - mean) / population std, parameters from the training rows;
    a zero std divides by 1 (as scikit-learn does).  MLlib's StandardScaler
    is not used: it divides by the sample std."""
    means: dict = field(default_factory=dict)
    stds: dict = field(default_factory=dict)
    n_rows: int = 0              # training rows seen by the fit

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c).cast("double") - F.lit(self.means[c])) / F.lit(self.stds[c] or 1.0)
            for c in self.means})


def fit_standardize(train: DataFrame, cols) -> Standardizer:
    cols = list(cols)
    row = train.agg(F.count(F.lit(1)).alias("__n"),
                    *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]
                    ).first()
    return Standardizer({c: float(row[f"m{i}"]) for i, c in enumerate(cols)},
                        {c: float(row[f"s{i}"] or 0.0) for i, c in enumerate(cols)}, int(row["__n"]))


@dataclass
class Shrinker:
    """M5: values outside the training top-``top`` of a column become
    'other' (in training and test alike; unseen test values too)."""
    tops: dict = field(default_factory=dict)
    other: str = clean.OTHER
    kept: dict = field(default_factory=dict)     # training rows keeping their value

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.when(F.col(c).isin(vals), F.col(c)).otherwise(F.lit(self.other))
            for c, vals in self.tops.items()})


def fit_shrink(train: DataFrame, cols, top: int = TOP_CATEGORIES) -> Shrinker:
    """At most ``top`` rows per column come back (``top_values``)."""
    cols = list(cols)
    tops: dict = {c: [] for c in cols}
    kept: dict = {c: 0 for c in cols}
    if cols:
        for r in profile.top_values(train, cols, top).select("column_name", "value", "n").collect():
            tops[r["column_name"]].append(r["value"])
            kept[r["column_name"]] += r["n"]
    return Shrinker(tops, kept=kept)


def encoder_after_shrink(shr: Shrinker, n_train: int) -> "LabelEncoder":
    """M6 labels without another pass: after shrinking, a column's training
    values are its kept top values plus 'other' when any training row (NULL
    included) was outside them."""
    labels = {}
    for c, vals in shr.tops.items():
        s = set(vals)
        if shr.kept.get(c, 0) < n_train:
            s.add(shr.other)
        labels[c] = sorted(s, key=lambda v: v.encode("utf-8"))
    return LabelEncoder(labels)


@dataclass
class LabelEncoder:
    """M6: 0-based code in sorted (byte) order of the training values; a
    value not seen in training gets the next code (the reference would raise;
    MLlib's ``handleInvalid='keep'`` does the same as here).  Equivalent to
    ``StringIndexer(stringOrderType='alphabetAsc', handleInvalid='keep')``
    with integer output."""
    labels: dict = field(default_factory=dict)

    def code(self, c: str) -> Column:
        vals = self.labels[c]
        if not vals:
            return F.lit(0)
        m = F.create_map(*[x for i, v in enumerate(vals) for x in (F.lit(v), F.lit(i))])
        return F.coalesce(F.try_element_at(m, F.col(c)), F.lit(len(vals)))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.code(c).cast("int") for c in self.labels})


@dataclass
class TableEncoder:
    """M6 for columns with too many labels to inline: a (column_name, value,
    code) table - codes by ``dense_rank`` in byte order within each column -
    joined back once per column (AQE picks broadcast or sort-merge and splits
    skewed values).  Same codes as ``LabelEncoder``."""
    codes: DataFrame
    sizes: dict

    def transform(self, df: DataFrame) -> DataFrame:
        columns = df.columns
        for c, size in self.sizes.items():
            t = self.codes.filter(F.col("column_name") == c).select(
                F.col("value").alias("__value"), F.col("code").alias("__code"))
            df = (df.join(t, F.col(c) == F.col("__value"), "left")
                    .withColumn(c, F.coalesce(F.col("__code"), F.lit(size)).cast("int"))
                    .select(*columns))
        return df


def distributed_codes(distinct: DataFrame) -> DataFrame:
    """0-based rank of each distinct (column_name, value) in byte order of
    the value within its column, without one task per column: the pairs are
    range-partitioned, each range numbers its own rows, and per-range counts
    (a table of ranges x columns) give the offsets.  The ranged rows are
    written once, so that counts and ranks are of the same ranges."""
    try:
        n = max(distinct.sparkSession.sparkContext.defaultParallelism, 1)
    except Exception:  # noqa: BLE001  (Spark Connect)
        n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    keyed = distinct.withColumn("__b", F.col("value").cast("binary"))
    ranged = cut_lineage(keyed.repartitionByRange(n, "column_name", "__b")
                              .withColumn("__pid", F.spark_partition_id()))
    counts = ranged.groupBy("__pid", "column_name").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy("column_name").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", "column_name",
                            F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    local = Window.partitionBy("__pid", "column_name").orderBy("__b")
    return (ranged.withColumn("__r", F.row_number().over(local))
                  .join(offsets, ["__pid", "column_name"])
                  .select("column_name", "value", (F.col("__off") + F.col("__r") - 1).alias("code")))


def fit_encode(train: DataFrame, cols, bound: int | None = None):
    """Codes of the distinct training values per column, in byte order.

    The encoder is a code table that is joined back, whatever the number of
    labels.  A caller that knows that no column has more than ``bound``
    labels (as after ``fit_shrink``) says so and gets the same codes as
    literal maps; more labels than that are an error."""
    cols = list(cols)
    if not cols:
        return LabelEncoder({})
    distinct = profile._long(train, cols).distinct()
    if bound is None:
        sizes = {r["column_name"]: r["n"] for r in
                 distinct.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
        return TableEncoder(distributed_codes(distinct), {c: sizes.get(c, 0) for c in cols})
    labels: dict = {c: [] for c in cols}
    rows = distinct.limit(bound * len(cols) + 1).collect()
    if len(rows) > bound * len(cols):
        raise ValueError(f"more than {bound} labels per column")
    for r in rows:
        labels[r["column_name"]].append(r["value"])
    return LabelEncoder({c: sorted(v, key=lambda s: s.encode("utf-8")) for c, v in labels.items()})


@dataclass
class Prepared:
    """Result of ``prepare_loans``: the prepared rows and what was fitted."""
    df: DataFrame
    features: list
    numericals: list
    categoricals: list
    standardizer: Standardizer
    shrinker: Shrinker
    encoder: LabelEncoder

    def assembled(self, features: list | None = None, out: str = "features") -> DataFrame:
        """M7: ``features`` vector (table order) next to key, label, split."""
        cols = features or self.features
        va = VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error")
        return va.transform(self.df).select(KEY, LABEL, SPLIT_COLUMN, out)


def cleaned_split(raw: DataFrame) -> DataFrame:
    """Cleaned loans with the ratio feature and the split flag."""
    return split(clean.loans_with_ratio(raw))


def feature_columns(df: DataFrame) -> tuple[list, list, list]:
    feats = [c for c in df.columns if c not in NON_FEATURES]
    nums = [c for c in profile.numeric_columns(df) if c in feats]
    cats = [c for c in profile.text_columns(df) if c in feats]
    return feats, nums, cats


def _before_modes(raw: DataFrame) -> DataFrame:
    """The cleaned rows with split flag and ratio feature, but for the columns that are filled with their modes."""
    df = clean.loans_before_imputation(raw)
    df = clean.impute_constant(df, {**{c: 0 for c in clean.ZERO_FILL_COLUMNS}, "emp_title": clean.OTHER})
    return split(clean.add_ratio(df, "satis_pr_cred_lines", "num_satisfactory_accounts", "open_credit_lines"))


def filled_categories(raw: DataFrame) -> tuple[DataFrame, list]:
    """Key, split flag and the text columns of the cleaned rows, and those columns' names.

    Only these columns are written; the modes come from the written rows, so
    that ``raw`` is computed once.
    """
    df = _before_modes(raw)
    _, _, cats = feature_columns(df)
    df = written(df.select(KEY, SPLIT_COLUMN, *cats))
    return clean.impute_mode(df, [c for c in clean.MODE_FILL_COLUMNS if c in cats]), cats


def fit_statistics(df: DataFrame, nums: list, cats: list, mode_cols: list) -> DataFrame:
    """All that the preparation is fitted from, in one job: column_name, value, is_test, n, and the moments of ``nums``.

    One row per value of every column of ``cats`` and ``mode_cols`` (NULL
    too) and part of the split; the rows with column_name '' hold the moments
    (count, mean and m2, the sum of squared deviations, per column).  Partial
    before the shuffle, so a frequent value is combined in the map tasks.
    The two kinds of rows are aggregated apart, each from its own columns, so
    that the moments aren't carried along with every value.
    """
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in dict.fromkeys([*cats, *mode_cols])]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(nums):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), (F.var_pop(x) * F.count(x)).alias(f"q{i}")]
    moments = df.groupBy(SPLIT_COLUMN).agg(*aggs).withColumns({"column_name": F.lit(""), "value": F.lit(None).cast("string")})
    if not entries:
        return moments
    counts = df.select(SPLIT_COLUMN, F.inline(F.array(*entries))).groupBy("column_name", "value", SPLIT_COLUMN).agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(moments, allowMissingColumns=True)


def fitted_from(stats: DataFrame, nums: list, cats: list, mode_cols: list, top: int = TOP_CATEGORIES):
    """(modes, standardizer, shrinker) from ``fit_statistics``, as if the modes had been filled in beforehand.

    Filling k missing values of a column with its mode v adds k to the count
    of v and, for numbers, k values to the moments: n' = n + k, mean' = (n mean + k v) / n',
    m2' = m2 + (mean - v)^2 n k / n'.  What comes to the driver is one mode per
    column, at most ``top`` values per column and one row of moments.
    """
    filled = stats.filter(F.col("column_name").isin(mode_cols)) if mode_cols else stats.limit(0)
    per_value = filled.groupBy("column_name", "value").agg(F.sum("n").alias("n"), F.sum(F.when(~F.col(SPLIT_COLUMN), F.col("n"))).alias("train"))
    numeric = F.col("column_name").isin([c for c in mode_cols if c in nums])
    # ties go to the smaller value, of numbers to the smaller number
    best = F.min(F.when(F.col("value").isNotNull(), F.struct(
        (-F.col("n")).alias("neg_n"), F.when(numeric, F.col("value").try_cast("double")).alias("number"), "value")))
    of_mode = {r["column_name"]: r for r in per_value.groupBy("column_name").agg(
        best["value"].alias("mode"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("train"))), F.lit(0)).alias("missing")).collect()}
    modes = {c: of_mode[c]["mode"] if c in of_mode else None for c in mode_cols}

    moments = stats.filter((F.col("column_name") == "") & ~F.col(SPLIT_COLUMN)).first()
    means, stds = {}, {}
    for i, c in enumerate(nums):
        n, mean, m2 = (moments[f"n{i}"], moments[f"m{i}"] or 0.0, moments[f"q{i}"] or 0.0) if moments else (0, 0.0, 0.0)
        k = of_mode[c]["missing"] if c in modes and modes[c] is not None else 0
        if k:
            v = float(modes[c])
            mean, m2, n = (n * mean + k * v) / (n + k), m2 + (mean - v) ** 2 * n * k / (n + k), n + k
        means[c], stds[c] = float(mean), (max(m2, 0.0) / n) ** 0.5 if n else 0.0
    std = Standardizer(means, stds, int(moments["n"]) if moments else 0)

    fill = F.lit(None).cast("string")
    for c in mode_cols:
        fill = F.when((F.col("column_name") == c) & F.col("value").isNull(), F.lit(modes[c])).otherwise(fill)
    train = stats.filter(F.col("column_name").isin(cats) & ~F.col(SPLIT_COLUMN)).select(
        "column_name", F.coalesce("value", fill).alias("value"), "n").filter("value IS NOT NULL")
    counts = train.groupBy("column_name", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    shr = Shrinker({c: [] for c in cats}, kept={c: 0 for c in cats})
    for r in counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).orderBy("column_name", "rank").collect():
        shr.tops[r["column_name"]].append(r["value"])
        shr.kept[r["column_name"]] += r["n"]
    return modes, std, shr


def prepare_loans(raw: DataFrame) -> Prepared:
    """M8: the whole preparation in the reference's order - cleaning
    (clean.loans_with_ratio), split, standardisation of numeric columns,
    shrinking and label-encoding of text columns, each fitted on training
    rows only.  Label codes are not scaled (encoding comes after scaling).

    The joined rows are written once, read by one job that fits everything
    (``fit_statistics``) and once more to apply it.
    """
    df = written(_before_modes(raw))
    feats, nums, cats = feature_columns(df)
    mode_cols = [c for c in clean.MODE_FILL_COLUMNS if c in df.columns]
    modes, std, shr = fitted_from(written(fit_statistics(df, nums, cats, mode_cols)), nums, cats, mode_cols)
    enc = encoder_after_shrink(shr, std.n_rows)
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in modes.items() if v is not None})
    out = enc.transform(shr.transform(std.transform(filled)))
    out = out.select(KEY, LABEL, *feats, SPLIT_COLUMN)
    return Prepared(out, feats, nums, cats, std, shr, enc)
