"""Log-linear hedonic regression.

Sums of products are formed by Spark, one small matrix per task, and added up;
only matrices of the number of features reach the driver. A second pass, with
the estimate broadcast, gives robust errors and residual moments.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proratio.session import attach

# Categories in alphabetical order; the first is the baseline.
CATEGORIES = {
    "vista": ["mar", "parque", "rua"],
    "orientacao": ["L", "N", "O", "S"],
    "posicao": ["frente", "fundos", "lateral"],
    "fase_obra": ["acabamento", "construcao", "lancamento", "pronto"],
}
CENTRE_FLOOR = 10
TEST_SHARE = 5
READ_LIMITS = (5000, 50, 20000)


# --- tables and view ------------------------------------------------------


def first_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, always the same one whatever the order of reading: the lowest."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def developments(rows: DataFrame, source: str) -> DataFrame:
    """One development per name, with the lowest or highest attribute of its rows."""
    return rows.groupBy(F.col("empreendimento").alias("id")).agg(
        F.min("bairro").alias("bairro"), F.min("fase_obra").alias("stage"), F.max("andar").alias("total_floors"),
        F.min("padrao_score").alias("quality_score"), F.min("lazer_score").alias("amenities_score"),
        F.min("localizacao_score").alias("location_score"),
    ).withColumn("name", F.concat(F.lit("Empreendimento "), F.col("id"))).withColumn("source", F.lit(source))


def units(rows: DataFrame, source: str) -> DataFrame:
    """One unit per development, tower and apartment."""
    found = rows.select(
        F.col("empreendimento").alias("development_id"), F.col("apartamento").alias("apartment"), F.col("torre").alias("tower"),
        F.col("andar").alias("floor"), F.col("area").alias("private_area_m2"), F.col("quartos").alias("bedrooms"),
        F.col("suite").alias("suites"), F.col("vagas").alias("parking_spaces"), F.col("varanda_m2").alias("balcony_area_m2"),
        F.col("cobertura").alias("is_penthouse"), F.col("vista").alias("view_type"), F.col("orientacao").alias("orientation"),
        F.col("posicao").alias("position_type"), F.lit(source).alias("source"),
    )
    return first_of(found, ["development_id", "tower", "apartment"])


def observations(rows: DataFrame, source: str, reference_date: str, first_sale: Column | None = None) -> DataFrame:
    """Prices seen on a day; ``first_sale`` tells which rows are no resale (all, if it is not given)."""
    key = ["development_id", "tower", "apartment"]
    found = rows.select(
        F.col("empreendimento").alias("development_id"), F.col("torre").alias("tower"), F.col("apartamento").alias("apartment"),
        F.lit(reference_date).cast("date").alias("reference_date"), F.col("meses_lancamento").alias("months_since_launch"),
        F.col("preco_m2").alias("price_m2"), F.col("desconto_pct").alias("discount_pct"), (F.lit(True) if first_sale is None else first_sale).alias("first_sale"),
        F.lit("hybrid").alias("record_origin"), F.lit(source).alias("source"),
    )
    return first_of(found, key + ["reference_date", "source"])


def view(observed: DataFrame, unit_rows: DataFrame, development_rows: DataFrame, bound) -> DataFrame:
    """First-sale observations with the attributes of unit and development, under the contract's names.

    ``bound`` proves the number of developments.
    """
    d = development_rows.select(
        F.col("id").alias("development_id"), "bairro", "stage", "quality_score", "amenities_score", "location_score"
    )
    sold = observed.where("first_sale").join(unit_rows.drop("source"), ["development_id", "tower", "apartment"])
    joined = attach(sold, d, "development_id", bound, "inner")
    return joined.select(
        F.sha2(F.concat_ws(":", "development_id", "tower", "apartment", "reference_date"), 256).alias("id"),
        F.col("development_id").alias("empreendimento"), F.col("apartment").alias("apartamento"), "bairro",
        F.col("tower").alias("torre"), F.col("floor").alias("andar"), F.col("private_area_m2").alias("area"),
        F.col("bedrooms").alias("quartos"), F.col("parking_spaces").alias("vagas"), F.col("suites").alias("suite"),
        F.col("balcony_area_m2").alias("varanda_m2"), F.when(F.col("is_penthouse"), 1).otherwise(0).alias("cobertura"),
        F.col("view_type").alias("vista"), F.col("orientation").alias("orientacao"), F.col("position_type").alias("posicao"),
        F.col("quality_score").alias("padrao_score"), F.col("amenities_score").alias("lazer_score"),
        F.col("location_score").alias("localizacao_score"), F.col("stage").alias("fase_obra"),
        F.col("months_since_launch").alias("meses_lancamento"), "discount_pct", F.col("price_m2").alias("preco_m2"),
        F.col("record_origin").alias("origem"), "reference_date",
    )


def clamped_limit(asked) -> int:
    """A row limit within its bounds; anything that is no number, or zero, gives the default."""
    default, low, high = READ_LIMITS
    try:
        value = float(asked) or default
    except (TypeError, ValueError):
        value = default
    if math.isnan(value):
        value = default
    return int(min(max(value, low), high))


def read(rows: DataFrame, limit=None) -> DataFrame:
    """The first rows by development, tower, floor and apartment."""
    return rows.orderBy("empreendimento", "torre", "andar", "apartamento").limit(clamped_limit(limit))


# --- features -------------------------------------------------------------


def features() -> dict[str, Column]:
    """Regressors by name."""
    number = lambda c: F.col(c).cast("double")
    floor = number("andar") - CENTRE_FLOOR
    found = {
        "intercept": F.lit(1.0), "andar_c": floor, "andar_c2": floor * floor, "ln_area": F.ln(number("area")),
        "vagas": number("vagas"), "suite": number("suite"), "varanda_m2": number("varanda_m2"), "cobertura": number("cobertura"),
        "qualidade": (number("padrao_score") + number("lazer_score")) / 2, "localizacao": number("localizacao_score"),
        "meses": number("meses_lancamento"),
    }
    for column, values in CATEGORIES.items():
        for v in values[1:]:
            # A value outside the list is an error, not the baseline; a missing one has no row in the fit.
            unknown = F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.col(column))).cast("double")
            dummy = F.when(F.col(column) == v, 1.0).when(F.col(column).isin(values), 0.0).when(F.col(column).isNotNull(), unknown)
            found[f"{column}_{v}"] = dummy
            if column == "vista":
                found[f"andar_x_{v}"] = floor * dummy
    return found


def design(rows: DataFrame, key: str = "id", test: Column | None = None, xs: dict[str, Column] | None = None) -> DataFrame:
    """Key, target ``ln(price)``, regressors as one array, and whether the row is held out."""
    xs = features() if xs is None else xs
    held = (F.pmod(F.xxhash64(key), F.lit(TEST_SHARE)) == 0) if test is None else test
    return rows.select(
        F.col(key).alias("key"), F.ln(F.col("preco_m2").cast("double")).alias("y"), F.col("preco_m2").cast("double").alias("price"),
        F.array(*xs.values()).alias("x"), held.alias("held_out"),
    )


# --- sums over tasks ------------------------------------------------------


def _summed(df: DataFrame, block: Callable[[pd.DataFrame], tuple[np.ndarray, dict[str, float]]]) -> tuple[np.ndarray, dict[str, float]]:
    """Add up a matrix and named sums over all rows; each task sends one small table."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, sums = None, {}
        for batch in batches:
            if len(batch):
                m, s = block(batch)
                matrix = m if matrix is None else matrix + m
                sums = {k: sums.get(k, 0.0) + v for k, v in s.items()}
        if matrix is not None:
            i, j = np.indices(matrix.shape)
            yield pd.DataFrame({"name": "", "i": i.ravel(), "j": j.ravel(), "v": matrix.ravel()})
            yield pd.DataFrame({"name": list(sums), "i": 0, "j": 0, "v": list(sums.values())})

    rows = df.mapInPandas(run, "name string, i int, j int, v double").groupBy("name", "i", "j").agg(F.sum("v").alias("v"))
    got = rows.toPandas()
    cells = got[got["name"] == ""]
    if cells.empty:
        raise ValueError("no observations")
    matrix = np.zeros((cells["i"].max() + 1, cells["j"].max() + 1))
    matrix[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    return matrix, dict(got[got["name"] != ""].set_index("name")["v"])


@dataclass
class Model:
    """A fitted regression; every matrix has the size of the feature list."""

    names: list[str]
    dropped: list[str]
    beta: np.ndarray
    inverse: np.ndarray
    n: int
    r2: float
    sigma2: float
    vif: dict[str, float]
    robust: np.ndarray | None = None
    jarque_bera: float | None = None

    @property
    def max_vif(self) -> float:
        return max(self.vif.values(), default=1.0)

    def errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.robust))

    def table(self) -> pd.DataFrame:
        """Coefficients with robust errors, t and p values."""
        se = self.errors()
        t = self.beta / se
        return pd.DataFrame(
            {"term": self.names, "beta": self.beta, "std_error": se, "t": t, "p": [t_p_value(v, self.n - len(self.beta)) for v in t]}
        )

    @property
    def f_statistic(self) -> float:
        k = len(self.beta) - 1
        return (self.r2 / k) / ((1 - self.r2) / (self.n - k - 1))

    @property
    def f_p_value(self) -> float:
        k = len(self.beta) - 1
        return f_p_value(self.f_statistic, k, self.n - k - 1)


def fit(rows: DataFrame, names: list[str], robust: bool = True) -> Model:
    """Least squares on the rows not held out. Regressors that do not vary are dropped.

    ``rows`` comes from ``design`` and is read twice with ``robust``.
    """
    train = rows.where("not held_out").select("x", "y")
    p = len(names)

    def products(batch):
        x = np.column_stack([np.vstack(batch["x"].to_numpy()), batch["y"].to_numpy()])
        return x.T @ x, {"n": float(len(x))}

    gram, sums = _summed(train, products)
    n = int(sums["n"])
    mean = gram[:p, 0] / n
    spread = np.diag(gram)[:p] / n - mean**2
    keep = [i for i in range(p) if i == 0 or spread[i] > 1e-12 * max(1.0, np.diag(gram)[i] / n)]
    g, b = gram[np.ix_(keep, keep)], gram[keep, p]
    # Equal scales make the solution stable: floors squared and dummies differ by orders of magnitude.
    scale = 1 / np.sqrt(np.diag(g))
    scaled = g * np.outer(scale, scale)
    if np.linalg.matrix_rank(scaled) < len(keep):
        raise ValueError("regressors are linearly dependent")
    inverse = np.linalg.inv(scaled) * np.outer(scale, scale)
    beta = inverse @ b
    ssr = gram[p, p] - beta @ b
    sst = gram[p, p] - gram[0, p] ** 2 / n
    kept = [names[i] for i in keep]
    cov = gram[np.ix_(keep, keep)] / n - np.outer(mean[keep], mean[keep])
    dev = np.sqrt(np.diag(cov)[1:])
    corr = cov[1:, 1:] / np.outer(dev, dev)
    vif = dict(zip(kept[1:], np.diag(np.linalg.inv(corr)))) if len(kept) > 1 else {}
    model = Model(kept, [names[i] for i in range(p) if i not in keep], beta, inverse, n, 1 - ssr / sst, ssr / (n - len(keep)), vif)
    return with_residuals(model, train, keep) if robust else model


def with_residuals(model: Model, train: DataFrame, keep: list[int]) -> Model:
    """Second pass: HC3 covariance and the Jarque-Bera statistic of the residuals."""
    beta, inverse = model.beta, model.inverse

    def block(batch):
        x = np.vstack(batch["x"].to_numpy())[:, keep]
        e = batch["y"].to_numpy() - x @ beta
        leverage = np.einsum("ij,jk,ik->i", x, inverse, x)
        weighted = x * (e / (1 - leverage))[:, None]
        return weighted.T @ weighted, {f"m{k}": float((e**k).sum()) for k in (1, 2, 3, 4)}

    meat, m = _summed(train, block)
    n = model.n
    mean = m["m1"] / n
    m2 = m["m2"] / n - mean**2
    m3 = m["m3"] / n - 3 * mean * m["m2"] / n + 2 * mean**3
    m4 = m["m4"] / n - 4 * mean * m["m3"] / n + 6 * mean**2 * m["m2"] / n - 3 * mean**4
    model.robust = inverse @ meat @ inverse
    model.jarque_bera = n / 6 * ((m3 / m2**1.5) ** 2 + (m4 / m2**2 - 3) ** 2 / 4)
    return model


# --- inference ------------------------------------------------------------


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def t_p_value(t: float, df: int) -> float:
    """Two-sided."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_p_value(f: float, d1: int, d2: int) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


# --- certificate ----------------------------------------------------------


def certificate(rows: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """The estimate judged from its residuals alone, one row per regressor asked for.

    ``residual_product`` is the regressor's product with the residuals over both lengths, 0 for
    least squares whatever the fit was computed by; ``std_error`` is the HC3 error and ``vif`` the
    inflation of the variance, from the inverse and the regressor's own spread. ``rows`` comes from
    ``design``; each task adds up four sums per regressor. Regressors the fit dropped have ``kept``
    false and nothing else; so has every regressor where there are no rows.
    """
    at = {n: i for i, n in enumerate(names)}
    x = F.array(*[F.element_at("x", at[n] + 1) for n in model.names])

    def numbers(values) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    def dot(a, b) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    train = rows.where("not held_out").select("y", x.alias("x"))
    turned = train.select(
        "x", (F.col("y") - dot("x", numbers(model.beta))).alias("e"),
        F.transform(F.array(*[numbers(r) for r in model.inverse]), lambda r: dot(r, F.col("x"))).alias("z"),
    )
    long = turned.select(
        "e", (F.col("e") / (1 - dot("x", "z"))).alias("w"), F.posexplode(F.arrays_zip("x", "z")).alias("i", "c")
    ).select("i", "e", "w", "c.x", "c.z")
    sums = long.groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("e") * F.col("e")).alias("ee"), F.sum(F.col("x") * F.col("e")).alias("xe"),
        F.sum(F.col("x") * F.col("x")).alias("xx"), F.var_pop("x").alias("spread"), F.sum(F.pow(F.col("z") * F.col("w"), F.lit(2.0))).alias("zw"),
    )
    known = [(n, i, float(model.beta[i]), float(model.inverse[i, i])) for i, n in enumerate(model.names)]
    asked = rows.sparkSession.createDataFrame(
        known + [(n, None, None, None) for n in model.dropped], "term string, i int, beta double, inverse double"
    )
    # One row per regressor on either side.
    return asked.join(F.broadcast(sums), "i", "left").select(
        "term", F.col("n").isNotNull().alias("kept"), F.when(F.col("n").isNotNull(), F.col("beta")).alias("beta"),
        F.try_divide(F.col("xe"), F.sqrt(F.col("xx") * F.col("ee"))).alias("residual_product"), F.sqrt("zw").alias("std_error"),
        F.when(F.col("i") > 0, F.col("inverse") * F.col("spread") * F.col("n")).alias("vif"),
    )


# --- use ------------------------------------------------------------------


def predict(rows: DataFrame, model: Model, names: list[str], z: float = 1.96) -> DataFrame:
    """Fitted price and an approximate interval from the residual variance, as expressions."""
    at = {n: i for i, n in enumerate(names)}
    score = F.lit(0.0)
    for name, b in zip(model.names, model.beta):
        score = score + F.element_at("x", at[name] + 1) * F.lit(float(b))
    wide = F.lit(z * math.sqrt(model.sigma2))
    return rows.withColumn("score", score).select(
        "key", "price", "held_out", F.exp("score").alias("predicted"), F.exp(F.col("score") - wide).alias("low"),
        F.exp(F.col("score") + wide).alias("high"),
    )


def holdout_metrics(predicted: DataFrame) -> DataFrame:
    """RMSE, MAE and MAPE of the held-out rows, in price per square metre."""
    error = F.col("price") - F.col("predicted")
    return predicted.where("held_out").agg(
        F.count("*").alias("test_n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        (F.avg(F.abs(error) / F.col("price")) * 100).alias("mape"),
    )


def check_model(model: Model, rows: int, development_count: int, test_n: int, mape: float) -> list[str]:
    """Ways in which a fit is not believable."""
    tests = {
        "fewer than 500 rows": rows < 500, "fewer than 10 developments": development_count < 10,
        "coefficients are not finite": not np.all(np.isfinite(model.beta)), "fewer than 100 test rows": test_n < 100,
        "MAPE out of range": not 5 < mape < 25, "fit too good": model.r2 >= 0.98,
    }
    return [name for name, failed in tests.items() if failed]
