from lakeloom.operators import lineage, models


def test_trees_hold_parts_of_a_fixed_size(spark, monkeypatch):
    """However few partitions the table has, no task holds more than about DEALT of its rows."""
    monkeypatch.setattr(lineage, "DEALT", 50)
    rows = [(float(100 + i % 7 * 50), float(i % 7), "ab"[i % 2], i % 5 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "price double, mileage double, make string, held boolean").coalesce(1)
    parts, own = [], models.GBTRegressor.fit
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda self, rows: (parts.append([len(p) for p in rows.rdd.glom().collect()]), own(self, rows))[1])
    for validation in (None, "held"):
        model = models.fit_trees(df, "price", ["mileage"], ["make"], rounds=3, depth=3, validation=validation)
        assert models.predict(model, df, ["mileage"], ["make"]).columns == [*df.columns, "predicted"]
    assert all(sum(p) == 600 and max(p) <= 100 for p in parts) and len(parts) == 2
