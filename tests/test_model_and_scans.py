import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proratio.functions.text import normalize_name
from proratio.operators import hedonic, privacy, quality, similarity


def test_fit_agrees_with_least_squares(spark):
    rng = np.random.default_rng(3)
    n = 800
    x = np.column_stack([np.ones(n), rng.normal(size=n), rng.normal(size=n) * 50 + 7, np.full(n, 4.0)])
    y = x[:, :3] @ [2.0, 0.5, -0.01] + rng.normal(size=n) * (0.1 + 0.1 * np.abs(x[:, 1]))
    held = np.arange(n) % 5 == 0
    rows = [(int(i), float(y[i]), float(np.exp(y[i])), [float(v) for v in x[i]], bool(held[i])) for i in range(n)]
    design = spark.createDataFrame(rows, "key long, y double, price double, x array<double>, held_out boolean").repartition(5)
    names = ["intercept", "a", "b", "constant"]
    model = hedonic.fit(design, names)
    xt, yt = x[~held][:, :3], y[~held]
    beta = np.linalg.lstsq(xt, yt, rcond=None)[0]
    e = yt - xt @ beta
    inv = np.linalg.inv(xt.T @ xt)
    h = np.einsum("ij,jk,ik->i", xt, inv, xt)
    robust = inv @ (xt.T @ (xt * (e**2 / (1 - h) ** 2)[:, None])) @ inv
    z = (e - e.mean()) / e.std()
    assert model.dropped == ["constant"] and model.n == len(yt)
    np.testing.assert_allclose(model.beta, beta, rtol=1e-8)
    np.testing.assert_allclose(model.robust, robust, rtol=1e-6)
    np.testing.assert_allclose(model.jarque_bera, len(e) / 6 * ((z**3).mean() ** 2 + ((z**4).mean() - 3) ** 2 / 4), rtol=1e-6)
    np.testing.assert_allclose(model.r2, 1 - (e**2).sum() / ((yt - yt.mean()) ** 2).sum(), rtol=1e-9)
    r = np.corrcoef(xt[:, 1], xt[:, 2])[0, 1]
    np.testing.assert_allclose(model.max_vif, 1 / (1 - r * r), rtol=1e-8)
    m = hedonic.holdout_metrics(hedonic.predict(design, model, names)).collect()[0]
    p, price = np.exp(x[held][:, :3] @ beta), np.exp(y[held])
    np.testing.assert_allclose([m["rmse"], m["mae"], m["mape"]],
                               [np.sqrt(((price - p) ** 2).mean()), np.abs(price - p).mean(), 100 * (np.abs(price - p) / price).mean()], rtol=1e-8)
    assert m["test_n"] == held.sum()


def test_certificate_tells_the_fit_from_others(spark):
    rng = np.random.default_rng(8)
    n = 600
    x = np.column_stack([np.ones(n), rng.normal(size=n) + 3, rng.normal(size=n), np.full(n, 2.0)])
    x[:, 2] += 0.8 * x[:, 1]
    y = x[:, :3] @ [1.0, 0.3, -0.2] + rng.normal(size=n) * 0.2
    rows = [(i, float(y[i]), float(np.exp(y[i])), [float(v) for v in x[i]], i % 4 == 0) for i in range(n)]
    design = spark.createDataFrame(rows, "key long, y double, price double, x array<double>, held_out boolean").repartition(6)
    names = ["intercept", "a", "b", "constant"]
    model = hedonic.fit(design, names)
    found = {r["term"]: r for r in hedonic.certificate(design, model, names).collect()}
    assert set(found) == set(names) and not found["constant"]["kept"] and found["constant"]["beta"] is None
    for name, error in zip(model.names, model.errors()):
        assert abs(found[name]["residual_product"]) < 1e-9 and abs(found[name]["std_error"] - error) < 1e-9
    assert found["intercept"]["vif"] is None
    assert all(abs(found[k]["vif"] - model.vif[k]) < 1e-7 for k in ("a", "b"))
    model.beta[1] += 0.01
    assert all(abs(r["residual_product"]) > 1e-3 for r in hedonic.certificate(design, model, names).where("kept and term <> 'b'").collect())
    none = hedonic.certificate(design.limit(0), model, names).collect()
    assert len(none) == 4 and not any(r["kept"] for r in none)


def test_p_values():
    # Published table values.
    assert abs(hedonic.t_p_value(2.228, 10) - 0.05) < 1e-4
    assert abs(hedonic.t_p_value(1.0, 1) - 0.5) < 1e-9
    assert abs(hedonic.f_p_value(3.3258, 5, 10) - 0.05) < 1e-4


def test_collinear_regressors_are_refused(spark):
    rows = [(i, float(i), 1.0, [1.0, float(i), 2.0 * i], False) for i in range(1, 20)]
    with pytest.raises(ValueError):
        hedonic.fit(spark.createDataFrame(rows, "key long, y double, price double, x array<double>, held_out boolean"), ["c", "a", "b"])


@pytest.mark.parametrize("asked, limit", [(None, 5000), ("x", 5000), (0, 5000), (10, 50), ("700", 700), (10**9, 20000), (-3, 50)])
def test_limits(asked, limit):
    assert hedonic.clamped_limit(asked) == limit


def test_implausible_fits_are_named(spark):
    model = hedonic.Model(["c"], [], np.array([1.0]), np.eye(1), 626, 0.90, 0.1, {})
    assert hedonic.check_model(model, 626, 12, 125, 13.7) == []
    assert len(hedonic.check_model(model, 10, 2, 5, 40.0)) == 4


def test_names_by_brute_force(spark):
    rng = random.Random(5)
    words = ["preco", "preco m2", "area", "area total", "andar", "unidade", "torre", "código", "Preço total", "vagas", "x", "9", "valor (R$)"]
    books = [f"w{i}" for i in range(4)]
    fields = [(b, s, f"{rng.choice(words)}{rng.choice(['', ' 1', '_b'])}", i) for b in books for s in ("Tabela", "Tab. Vendas", "zz") for i in range(6)]
    df = spark.createDataFrame(fields, "workbook_id string, sheet_name string, field_name string, ordinal int")
    pairs = spark.createDataFrame([("w0", "w1"), ("w1", "w2"), ("w0", "w3")], "workbook_a string, workbook_b string")
    got = {tuple(r) for r in similarity.cross_workbook_mapping(pairs, df.select("workbook_id", "sheet_name").distinct(), df).select(
        "workbook_a", "sheet_a", "workbook_b", "sheet_b", "field_a", "field_b", "similarity_score").collect()}

    def norm(s):
        return "".join(c for c in s.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")

    def ratio(a, b):
        return difflib.SequenceMatcher(None, norm(a), norm(b)).ratio()

    expected = set()
    listed = {}
    for b, s, f, _ in fields:
        listed.setdefault((b, s), dict())[f] = None
    for a, b in (("w0", "w1"), ("w1", "w2"), ("w0", "w3")):
        for (wa, sa), fa in listed.items():
            for (wb, sb), fb in listed.items():
                if (wa, wb) == (a, b) and ratio(sa, sb) >= 0.4:
                    expected.add((a, sa, b, sb, "", "", round(ratio(sa, sb), 2)))
                    for f in fa:
                        best = max(fb, key=lambda g: ratio(f, g))
                        if ratio(f, best) >= 0.5:
                            expected.add((a, sa, b, sb, f, best, round(ratio(f, best), 2)))
    assert got == expected


def test_upper_bound_is_one(spark):
    rng = random.Random(1)
    rows = [tuple("".join(rng.choices("abc1", k=rng.randrange(0, 9))) for _ in range(2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", similarity.upper_bound(F.col("a"), F.col("b")).alias("u")).collect():
        exact = difflib.SequenceMatcher(None, r["a"], r["b"]).quick_ratio()
        assert abs(r["u"] - exact) < 1e-12 and r["u"] >= difflib.SequenceMatcher(None, r["a"], r["b"]).ratio() - 1e-12


def test_private_texts(spark):
    texts = [(1, "x PGPASSWORD = abc"), (2, "postgres://u:p@h/db"), (3, "a" * 64), (4, "see Book.XLSX now"), (8, "nothing"), (9, "b" * 65),
             (10, "DATABASE_URL=" + "z" * 99)]
    df = spark.createDataFrame(texts, "id int, t string")
    got = {r["id"]: r for r in privacy.pattern_scan(df, "id", "t").collect()}
    assert set(got) == {1, 2, 3, 4, 10} and len(got[10]["excerpt"]) == 112 and got[4]["excerpt"] == "Book.XLSX"
    twice = privacy.pattern_scan(df.where("id = 3").selectExpr("id", "t || ' ' || t AS t"), "id", "t").collect()
    assert [(r["label"], r["matches"]) for r in twice] == [("64 hex digits", 2)]
    with pytest.raises(ValueError):
        privacy.gate(privacy.pattern_scan(df, "id", "t"))
    privacy.gate(privacy.pattern_scan(df.where("id = 8"), "id", "t"))
    marks = privacy.marker_scan(df, "id", "t", privacy.parse_markers(["# c", "", " nothing "]))
    assert [tuple(r) for r in marks.collect()] == [(8, "noth***")]
    assert privacy.marker_scan(df, "id", "t", []).count() == 0
    paths = spark.createDataFrame([("a/.env.local",), ("b/x.sql",), ("c/x.html",)], "p string")
    assert {tuple(r) for r in privacy.name_rules(paths, "p").collect()} == {("a/.env.local", "arquivo de ambiente"), ("b/x.sql", "extensao proibida")}
    docs = spark.createDataFrame([(1, '{"meta":{"mode":"DEMO"}}'), (2, '{"meta":{}}'), (3, "{")], "id int, t string")
    assert {tuple(r) for r in privacy.mode_check(docs, "id", "t").collect()} == {(2, "meta.mode is missing"), (3, "invalid JSON")}


def test_constraints(spark):
    widgets = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    orders = spark.createDataFrame([(1, 1, 5), (2, 9, 1), (3, None, 0), (4, 2, None)], "id int, widget_id int, quantity int")
    rules = [quality.foreign(["widget_id"], widgets, ["id"]), quality.check("quantity_positive", "quantity > 0", "quantity"), quality.not_null("quantity")]
    got = {(r["rule_id"], r["key"]) for r in quality.violations(orders, rules, ["id"]).collect()}
    assert got == {("widget_id_foreign", "2"), ("quantity_positive", "3"), ("quantity_not_null", "4")}
    quality.require(widgets, [quality.unique("name"), quality.not_null("name")], ["id"])
    with pytest.raises(ValueError):
        quality.require(widgets.unionByName(widgets), [quality.unique("name")], ["id"])
    # a key with NULL is never repeated
    towers = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (1, 2, "x")], "d int, t int, c string")
    assert quality.violations(towers, [quality.unique("d", "t", "c")], ["c"]).count() == 0


def test_entity_rules_name_only_declared_columns():
    from proratio.sources.tables import SCHEMAS

    for table, rules in quality.ENTITY_RULES.items():
        declared = {f.strip().split()[0] for f in SCHEMAS[table].replace("(", "_").split(",") if " " in f.strip()}
        for rule in rules:
            assert set(rule.columns) <= declared, (table, rule.id)


def test_entity_rules_on_rows(spark):
    from proratio.sources.tables import SCHEMAS

    p = spark.createDataFrame([], SCHEMAS["pricing.parameters"])
    assert quality.violations(p, quality.ENTITY_RULES["pricing.parameters"], ["id"]).count() == 0
    rows = spark.createDataFrame([("1", "NUMERIC", 1.0, None), ("2", "NUMERIC", None, "x"), ("3", "TEXT", None, "x"), ("4", "TEXT", 1.0, "x")],
                                 "id string, value_type string, numeric_value double, text_value string")
    rule = quality.one_of("typed", "value_type", {"NUMERIC": "numeric_value", "TEXT": "text_value"})
    assert {r["key"] for r in quality.violations(rows, [rule], ["id"]).collect()} == {"2", "4"}
    assert normalize_name is not None
