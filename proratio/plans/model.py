"""Hedonic queries over observations derived from whole orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from proratio.operators import hedonic
from proratio.plans import sql
from proratio.plans.registry import query
from proratio.session import checkpoint_root, stage
from proratio.sources import files
from proratio.sources.tables import SCHEMAS

SOURCE, DAY = "seed-hybrid-v1", "2026-08-29"


def observed(d):
    """Units as market observations, typed as the stored ones."""
    u = F.col("unit_id")
    dev = F.col("development_id")

    def pick(i, values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))

    half = F.lit("0.5").cast("decimal(2,1)")
    score = "decimal(3,1)"
    return d.units.select(
        F.concat(F.lit("NOVO-"), dev.cast("string")).alias("empreendimento"), F.col("unit_code").alias("apartamento"),
        F.concat(F.lit("R"), (dev % 5).cast("string")).alias("bairro"), F.col("tower").alias("torre"), F.col("floor").alias("andar"),
        F.col("private_area_m2").cast("decimal(9,2)").alias("area"), (u % 4 + 1).cast("int").alias("quartos"),
        (F.floor(u / 7) % 4).cast("int").alias("vagas"), (F.floor(u / 11) % 3).cast("int").alias("suite"),
        F.col("uncovered_area_m2").cast("decimal(8,2)").alias("varanda_m2"), ((F.col("floor") == 10) & (u % 3 == 0)).alias("cobertura"),
        pick(u % 3, ["rua", "parque", "mar"]).alias("vista"), pick(F.floor(u / 3) % 4, ["N", "S", "L", "O"]).alias("orientacao"),
        F.when(F.col("position") == "F", "frente").when(F.col("position") == "O", "fundos").otherwise("lateral").alias("posicao"),
        (dev % 5 * half + 3).cast(score).alias("padrao_score"), (dev % 7 * half + 2).cast(score).alias("lazer_score"),
        (dev % 9 * half + 1).cast(score).alias("localizacao_score"),
        F.when(F.col("typology") == "1-URGENT", "lancamento").when(F.col("typology") == "2-HIGH", "construcao")
        .when(F.col("typology") == "3-MEDIUM", "acabamento").otherwise("pronto").alias("fase_obra"),
        ((2001 - F.year("order_date")) * 12 + 8 - F.month("order_date")).cast("int").alias("meses_lancamento"),
        ((u % 80).cast("decimal(4,0)") * F.lit("0.1").cast("decimal(2,1)")).cast("decimal(6,2)").alias("desconto_pct"),
        F.round(F.try_divide("order_total", "private_area_m2"), 2).cast("decimal(12,2)").alias("preco_m2"),
    )


OBSERVED = sql.UNITS + f""",
observed AS (SELECT 'NOVO-' || development_id AS empreendimento, unit_code AS apartamento, 'R' || (development_id % 5) AS bairro, tower AS torre,
    floor AS andar, CAST(private_area_m2 AS DECIMAL(9,2)) AS area, CAST(unit_id % 4 + 1 AS INTEGER) AS quartos, CAST((unit_id // 7) % 4 AS INTEGER) AS vagas,
    CAST((unit_id // 11) % 3 AS INTEGER) AS suite, CAST(uncovered_area_m2 AS DECIMAL(8,2)) AS varanda_m2, floor = 10 AND unit_id % 3 = 0 AS cobertura,
    ['rua','parque','mar'][unit_id % 3 + 1] AS vista, ['N','S','L','O'][(unit_id // 3) % 4 + 1] AS orientacao,
    CASE position WHEN 'F' THEN 'frente' WHEN 'O' THEN 'fundos' ELSE 'lateral' END AS posicao,
    CAST(development_id % 5 * 0.5 + 3 AS DECIMAL(3,1)) AS padrao_score, CAST(development_id % 7 * 0.5 + 2 AS DECIMAL(3,1)) AS lazer_score,
    CAST(development_id % 9 * 0.5 + 1 AS DECIMAL(3,1)) AS localizacao_score,
    CASE typology WHEN '1-URGENT' THEN 'lancamento' WHEN '2-HIGH' THEN 'construcao' WHEN '3-MEDIUM' THEN 'acabamento' ELSE 'pronto' END AS fase_obra,
    CAST((2001 - year(order_date)) * 12 + 8 - month(order_date) AS INTEGER) AS meses_lancamento,
    CAST((unit_id % 80) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(6,2)) AS desconto_pct,
    CAST({sql.cents(sql.half_up('(order_total * 100)::HUGEINT * 100', '(private_area_m2 * 100)::HUGEINT'))} AS DECIMAL(12,2)) AS preco_m2, unit_id
  FROM units)"""

VIEW = OBSERVED + f""",
devs AS (SELECT empreendimento AS id, min(bairro) AS bairro, min(fase_obra) AS stage, max(andar) AS total_floors, min(padrao_score) AS quality_score,
    min(lazer_score) AS amenities_score, min(localizacao_score) AS location_score FROM observed GROUP BY 1),
viewed AS (SELECT sha256(empreendimento || ':' || torre || ':' || apartamento || ':{DAY}') AS id, empreendimento, apartamento, d.bairro, torre, andar, area,
    quartos, vagas, suite, varanda_m2, CASE WHEN cobertura THEN 1 ELSE 0 END AS cobertura, vista, orientacao, posicao, d.quality_score AS padrao_score,
    d.amenities_score AS lazer_score, d.location_score AS localizacao_score, d.stage AS fase_obra, meses_lancamento, desconto_pct AS discount_pct, preco_m2,
    'hybrid' AS origem, DATE '{DAY}' AS reference_date FROM observed o JOIN devs d ON d.id = o.empreendimento)"""


def loaded(d):
    rows = stage(observed(d))
    return hedonic.view(
        hedonic.observations(rows, SOURCE, DAY), hedonic.units(rows, SOURCE), hedonic.developments(rows, SOURCE), d.bound
    )


@query("hedonic_developments", f"""WITH {VIEW} SELECT id, bairro, stage, total_floors, quality_score, amenities_score, location_score,
    'Empreendimento ' || id AS name, '{SOURCE}' AS source FROM devs""")
def hedonic_developments(d):
    return hedonic.developments(observed(d), SOURCE)


@query("hedonic_load", f"""WITH {OBSERVED} SELECT empreendimento AS development_id, count(*) AS units, CAST(sum(area) AS DECIMAL(18,2)) AS area FROM observed GROUP BY 1""")
def hedonic_load(d):
    """Units of a source that holds every row twice."""
    rows = observed(d)
    return hedonic.units(rows.unionByName(rows), SOURCE).groupBy("development_id").agg(
        F.count("*").alias("units"), F.sum("private_area_m2").cast("decimal(18,2)").alias("area")
    )


@query("hedonic_view", f"WITH {VIEW} SELECT * FROM viewed")
def hedonic_view(d):
    return loaded(d)


@query("hedonic_read", f"WITH {VIEW} SELECT * FROM viewed ORDER BY empreendimento, torre, andar, apartamento LIMIT 5000")
def hedonic_read(d):
    return hedonic.read(loaded(d))


@query("csv_source", f"WITH {OBSERVED} SELECT * EXCLUDE (unit_id) FROM observed")
def csv_source(d):
    """Observations written as a CSV report and read back by schema."""
    import uuid

    folder = f"{checkpoint_root(d.spark)}/proratio/{uuid.uuid4().hex}"
    files.write_reports({"observations": observed(d)}, folder)
    return files.read_csv(d.spark, f"{folder}/observations", SCHEMAS["hedonic.observations"])


SIMPLE = OBSERVED + """,
pts AS (SELECT ln(CAST(preco_m2 AS DOUBLE)) AS y, ln(CAST(area AS DOUBLE)) AS x, CAST(preco_m2 AS DOUBLE) AS price, unit_id % 5 = 0 AS test FROM observed),
fit AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, regr_r2(y, x) AS r2, count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM pts WHERE NOT test),
res AS (SELECT y - b0 - b1 * x AS e, 1.0 / n + (x - mx) * (x - mx) / sxx AS h, x - mx AS dx, sxx, n FROM pts, fit WHERE NOT test),
mom AS (SELECT avg(e) AS m FROM res),
m24 AS (SELECT avg((e - m) ^ 2) AS m2, avg((e - m) ^ 3) AS m3, avg((e - m) ^ 4) AS m4, max(n) AS n, sqrt(sum(dx * dx * e * e / ((1 - h) * (1 - h))) / (max(sxx) * max(sxx))) AS se FROM res, mom),
hold AS (SELECT count(*) AS test_n, sqrt(avg((price - p) ^ 2)) AS rmse, avg(abs(price - p)) AS mae, avg(abs(price - p) / price) * 100 AS mape
  FROM (SELECT price, exp(b0 + b1 * x) AS p FROM pts, fit WHERE test))"""


def simple_model(d):
    rows = observed(d).withColumn("id", F.col("apartamento").cast("bigint"))
    xs = {k: hedonic.features()[k] for k in ("intercept", "ln_area")}
    design = stage(hedonic.design(rows, "id", F.col("id") % 5 == 0, xs))
    return design, hedonic.fit(design, list(xs)), list(xs)


@query("hedonic_simple", f"""WITH {SIMPLE} SELECT n, round(b0, 6) AS intercept, round(b1, 6) AS slope, round(r2, 8) AS r2, round(se, 8) AS slope_error,
    round(m24.n / 6.0::DOUBLE * ((m3 / m2 ^ 1.5) ^ 2 + (m4 / (m2 * m2) - 3) ^ 2 / 4), 3) AS jarque_bera FROM fit JOIN m24 USING (n)""")
def hedonic_simple(d):
    """ln(price) on ln(area) alone: estimate, fit, HC3 error and residual normality."""
    model = simple_model(d)[1]
    row = (model.n, round(float(model.beta[0]), 6), round(float(model.beta[1]), 6), round(float(model.r2), 8),
           round(float(model.errors()[1]), 8), round(float(model.jarque_bera), 3))
    return d.spark.createDataFrame([row], "n bigint, intercept double, slope double, r2 double, slope_error double, jarque_bera double")


@query("hedonic_simple_holdout", f"WITH {SIMPLE} SELECT test_n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape, 6) AS mape FROM hold")
def hedonic_simple_holdout(d):
    design, model, names = simple_model(d)
    found = hedonic.holdout_metrics(hedonic.predict(design, model, names))
    return found.select("test_n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("mape", 6).alias("mape"))


# The whole specification in SQL: sums of products, swept once per regressor (which leaves the inverse, the estimate and
# the squared residuals), then residuals, leverages and the continued fraction of the incomplete beta function.
TERMS = [
    ("intercept", "1"), ("andar_c", "andar - 10"), ("andar_c2", "(andar - 10) * (andar - 10)"), ("ln_area", "ln(CAST(area AS DOUBLE))"),
    ("vagas", "vagas"), ("suite", "suite"), ("varanda_m2", "varanda_m2"), ("cobertura", "CAST(cobertura AS INTEGER)"),
    ("qualidade", "(CAST(padrao_score AS DOUBLE) + CAST(lazer_score AS DOUBLE)) / 2"), ("localizacao", "localizacao_score"),
    ("meses", "meses_lancamento"), ("vista_parque", "CAST(vista = 'parque' AS INTEGER)"),
    ("andar_x_parque", "CASE WHEN vista = 'parque' THEN andar - 10 ELSE 0 END"), ("vista_rua", "CAST(vista = 'rua' AS INTEGER)"),
    ("andar_x_rua", "CASE WHEN vista = 'rua' THEN andar - 10 ELSE 0 END"), ("orientacao_N", "CAST(orientacao = 'N' AS INTEGER)"),
    ("orientacao_O", "CAST(orientacao = 'O' AS INTEGER)"), ("orientacao_S", "CAST(orientacao = 'S' AS INTEGER)"),
    ("posicao_fundos", "CAST(posicao = 'fundos' AS INTEGER)"), ("posicao_lateral", "CAST(posicao = 'lateral' AS INTEGER)"),
    ("fase_obra_construcao", "CAST(fase_obra = 'construcao' AS INTEGER)"), ("fase_obra_lancamento", "CAST(fase_obra = 'lancamento' AS INTEGER)"),
    ("fase_obra_pronto", "CAST(fase_obra = 'pronto' AS INTEGER)"),
    # A regressor that does not vary: the fit has to leave it out.
    ("constante", "4"),
]
P = len(TERMS)


def full_sql(body: str) -> str:
    names = ", ".join(f"'{n}'" for n, _ in TERMS)
    xs = ", ".join(f"CAST({e} AS DOUBLE)" for _, e in TERMS)
    step = f"""list_transform(range(1, {P + 2}), lambda i: list_transform(range(1, {P + 2}), lambda j: CASE
        WHEN i = k AND j = k THEN 1 / m[k][k] WHEN i = k THEN m[k][j] / m[k][k] WHEN j = k THEN -m[i][k] / m[k][k]
        ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END))"""
    return f"""WITH RECURSIVE {OBSERVED},
pts AS (SELECT unit_id % 5 = 0 AS test, CAST(preco_m2 AS DOUBLE) AS price, [{xs}, ln(CAST(preco_m2 AS DOUBLE))] AS x FROM observed),
names AS (SELECT unnest([{names}]) AS term, unnest(range(1, {P + 1})) AS i),
products AS (SELECT i.i, j.j, fsum(x[i.i] * x[j.j]) AS v FROM pts, range(1, {P + 2}) i(i), range(1, {P + 2}) j(j) WHERE NOT test GROUP BY ALL),
size AS (SELECT v AS n FROM products WHERE i = 1 AND j = 1),
spreads AS (SELECT d.i, d.v - n * (o.v / n) ^ 2 AS sst, d.i = 1 OR d.v / n - (o.v / n) ^ 2 > 1e-12 * greatest(1, d.v / n) AS kept
    FROM products d JOIN products o ON o.i = d.i AND o.j = 1, size WHERE d.j = d.i),
gram AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM products GROUP BY i)),
kept AS (SELECT list(i ORDER BY i) AS ks FROM spreads WHERE kept AND i <= {P}),
sweep AS (SELECT 0 AS s, 1 AS k, m FROM gram UNION ALL
    SELECT s + 1, k, {step} FROM (SELECT s, ks[s + 1] AS k, m FROM sweep, kept WHERE s < len(ks))),
solved AS (SELECT m, len(ks) AS p, n, m[{P + 1}][{P + 1}] AS rss FROM sweep, kept, size WHERE s = len(ks)),
fit AS (SELECT p, n, rss, rss / (n - p) AS sigma2, 1 - rss / sst AS r2,
    list_transform(range(1, {P + 1}), lambda i: CASE WHEN list_contains(ks, i) THEN m[i][{P + 1}] ELSE 0 END) AS beta,
    list_transform(range(1, {P + 1}), lambda i: list_transform(range(1, {P + 1}), lambda j:
        CASE WHEN list_contains(ks, i) AND list_contains(ks, j) THEN m[i][j] ELSE 0 END)) AS inv
    FROM solved, kept, spreads WHERE i = {P + 1}),
turned AS (SELECT test, price, x[1:{P}] AS x, x[{P + 1}] - list_dot_product(x[1:{P}], beta) AS e,
    list_transform(inv, lambda r: list_dot_product(r, x[1:{P}])) AS z FROM pts, fit),
weighed AS (SELECT test, price, x, e, z, (e / (1 - list_dot_product(x, z))) ^ 2 AS w FROM turned WHERE NOT test),
estimates AS (SELECT i, term, any_value(beta[i]) AS beta, sqrt(fsum(z[i] * z[i] * w)) AS se, fsum(x[i] * e) AS xe, fsum(x[i] * x[i]) AS xx
    FROM weighed, names, fit WHERE beta[i] <> 0 GROUP BY ALL),
terms AS (SELECT i, term, estimates.beta, se, estimates.beta / se AS t, xe / sqrt(xx * rss) AS xe, CASE WHEN i > 1 THEN inv[i][i] * sst END AS vif
    FROM estimates JOIN spreads USING (i), fit),
centred AS (SELECT avg(e) AS c FROM weighed),
moments AS (SELECT avg((e - c) ^ 2) AS m2, avg((e - c) ^ 3) AS m3, avg((e - c) ^ 4) AS m4 FROM weighed, centred),
overall AS (SELECT p, n, r2, sigma2, rss, (r2 / (p - 1)) / ((1 - r2) / (n - p)) AS f, n / 6 * ((m3 / m2 ^ 1.5) ^ 2 + (m4 / (m2 * m2) - 3) ^ 2 / 4) AS jb,
    (SELECT max(vif) FROM terms) AS max_vif FROM fit, moments),
asked AS (SELECT term AS q, (n - p) / 2 AS a, 0.5::DOUBLE AS b, (n - p) / (n - p + t * t) AS x FROM terms, fit
    UNION ALL SELECT 'f', (n - p) / 2, (p - 1) / 2.0::DOUBLE, (n - p) / (n - p + (p - 1) * f) FROM overall),
sided AS (SELECT q, x > (a + 1) / (a + b + 2) AS far, CASE WHEN far THEN b ELSE a END AS a1, CASE WHEN far THEN a ELSE b END AS b1,
    CASE WHEN far THEN 1 - x ELSE x END AS x1 FROM asked),
fraction AS (SELECT q, 0 AS s, 1.0::DOUBLE AS f, 1.0::DOUBLE AS c, 0.0::DOUBLE AS d, a1, b1, x1 FROM sided UNION ALL
    SELECT q, s + 1, f * (1 + g / c) / (1 + g * d), 1 + g / c, 1 / (1 + g * d), a1, b1, x1 FROM (SELECT *, CASE WHEN s = 0 THEN 1
        WHEN s % 2 = 0 THEN (s // 2) * (b1 - s // 2) * x1 / ((a1 + s - 1) * (a1 + s))
        ELSE -(a1 + s // 2) * (a1 + b1 + s // 2) * x1 / ((a1 + 2 * (s // 2)) * (a1 + 2 * (s // 2) + 1)) END AS g FROM fraction WHERE s < 200)),
tails AS (SELECT q, exp(a1 * ln(x1) + b1 * ln(1 - x1) - lgamma(a1) - lgamma(b1) + lgamma(a1 + b1)) / a1 * (f - 1) AS part, far,
    CASE WHEN far THEN 1 - part ELSE part END AS p FROM fraction JOIN sided USING (q, a1, b1, x1) WHERE s = 200),
hold AS (SELECT price, exp(ln(price) - e) AS predicted, exp(ln(price) - e - 1.96 * sqrt(sigma2)) AS low, exp(ln(price) - e + 1.96 * sqrt(sigma2)) AS high
    FROM turned, fit WHERE test),
metrics AS (SELECT count(*) AS test_n, sqrt(avg((price - predicted) ^ 2)) AS rmse, avg(abs(price - predicted)) AS mae,
    avg(abs(price - predicted) / price) * 100 AS mape, count(*) FILTER (price BETWEEN low AND high) AS covered FROM hold)
{body}"""


def full_model(d):
    """Design, fit and regressors of the whole specification, and one regressor that does not vary."""
    rows = observed(d).withColumn("id", F.col("apartamento").cast("bigint"))
    xs = {**hedonic.features(), "constante": F.lit(4.0)}
    design = stage(hedonic.design(rows, "id", F.col("id") % 5 == 0, xs))
    return design, hedonic.fit(design, list(xs)), list(xs)


@query("hedonic_ols", full_sql("""SELECT term, round(beta, 6) AS beta, round(se, 6) AS std_error, round(t, 4) AS t, round(p, 5) AS p
    FROM terms JOIN tails ON q = term"""))
def hedonic_ols(d):
    """The whole specification: coefficients, HC3 errors, t and p values; what does not vary is dropped."""
    table = d.spark.createDataFrame(full_model(d)[1].table())
    return table.select("term", F.round("beta", 6).alias("beta"), F.round("std_error", 6).alias("std_error"), F.round("t", 4).alias("t"),
                        F.round("p", 5).alias("p"))


@query("hedonic_diagnostics", full_sql("""SELECT unnest(['n', 'r2', 'jarque_bera', 'max_vif', 'f', 'f_p', 'sigma2']) AS measure,
    unnest([n, round(r2, 8), round(jb, 2), round(max_vif, 6), round(f, 5), round(p2, 5), round(sigma2, 8)]) AS value
    FROM (SELECT o.*, t.p AS p2 FROM overall o, tails t WHERE q = 'f')"""))
def hedonic_diagnostics(d):
    model = full_model(d)[1]
    rows = [("n", float(model.n), 0), ("r2", model.r2, 8), ("jarque_bera", model.jarque_bera, 2), ("max_vif", model.max_vif, 6),
            ("f", model.f_statistic, 5), ("f_p", model.f_p_value, 5), ("sigma2", model.sigma2, 8)]
    return d.spark.createDataFrame([(k, round(float(v), places)) for k, v, places in rows], "measure string, value double")


@query("hedonic_metrics", full_sql("SELECT test_n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape, 6) AS mape FROM metrics"))
def hedonic_metrics(d):
    design, model, names = full_model(d)
    found = hedonic.holdout_metrics(hedonic.predict(design, model, names))
    return found.select("test_n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("mape", 6).alias("mape"))


@query("hedonic_certificate", full_sql("""SELECT n.term, t.term IS NOT NULL AS kept, round(t.beta, 6) AS beta, round(xe, 6) AS residual_product,
    round(se, 6) AS std_error, round(vif, 5) AS vif FROM names n LEFT JOIN terms t USING (term)"""))
def hedonic_certificate(d):
    """The fit checked from its own residuals, regressor by regressor."""
    design, model, names = full_model(d)
    found = hedonic.certificate(design, model, names)
    return found.select("term", "kept", F.round("beta", 6).alias("beta"), (F.round("residual_product", 6) + 0.0).alias("residual_product"),
                        F.round("std_error", 6).alias("std_error"), F.round("vif", 5).alias("vif"))


@query("hedonic_interval", full_sql("SELECT test_n, covered FROM metrics"))
def hedonic_interval(d):
    """Held-out prices within the interval of their prediction."""
    design, model, names = full_model(d)
    found = hedonic.predict(design, model, names).where("held_out")
    return found.agg(F.count("*").alias("test_n"), F.count_if(F.col("price").between(F.col("low"), F.col("high"))).alias("covered"))


@query("hedonic_findings", full_sql("""SELECT unnest(list_filter([CASE WHEN n + test_n < 500 THEN 'fewer than 500 rows' END,
    CASE WHEN (SELECT count(DISTINCT empreendimento) FROM observed) < 10 THEN 'fewer than 10 developments' END,
    CASE WHEN test_n < 100 THEN 'fewer than 100 test rows' END, CASE WHEN NOT (mape > 5 AND mape < 25) THEN 'MAPE out of range' END,
    CASE WHEN r2 >= 0.98 THEN 'fit too good' END], lambda x: x IS NOT NULL)) AS finding FROM overall, metrics"""))
def hedonic_findings(d):
    """What makes the fit hard to believe."""
    design, model, names = full_model(d)
    metrics = hedonic.holdout_metrics(hedonic.predict(design, model, names)).first()
    developments = observed(d).agg(F.count_distinct("empreendimento")).first()[0]
    found = hedonic.check_model(model, model.n + metrics["test_n"], developments, metrics["test_n"], metrics["mape"])
    return d.spark.createDataFrame([(f,) for f in found], "finding string")
