import pytest

from lakeloom.contract import Column, Contract, ContractError

C = Contract("t", (Column("id", "string", False), Column("n", "double"), Column("level", "string", levels=("a", "b"))))


def test_conform_selects_casts_and_blanks_foreign_levels(spark):
    df = spark.createDataFrame([("b", 1, "x", "1"), ("a", None, "y", "2")], "level string, n int, other string, id string")
    out = C.conform(df)
    assert out.columns == ["id", "n", "level"] and dict(out.dtypes)["n"] == "double"
    assert C.problems(out) == []
    assert [r["level"] for r in C.conform(df.withColumnRenamed("level", "l").withColumnRenamed("other", "level")).collect()] == [None, None]


def test_all_problems_are_told_at_once(spark):
    df = spark.createDataFrame([(None, "c", 1), ("1", "a", 2)], "id string, level string, extra int")
    assert C.problems(df) == ["missing column n", "unexpected column extra", "id has 1 nulls", "level has 1 values outside its levels"]
    with pytest.raises(ContractError, match="nulls in"):
        Contract("u", (Column("id", "string", False),)).conform(df)
    with pytest.raises(ContractError, match="missing columns"):
        C.conform(df)


def test_algebra():
    assert C.select("n", "id").names == ["n", "id"] and C.drop("n").names == ["id", "level"]
    assert C.extend(Column("z", "int")).names[-1] == "z" and C.renamed("u").name == "u"
    assert C.with_type("n", "int").schema()["n"].dataType.simpleString() == "int"
    assert Contract.from_dicts("t", C.to_dicts()) == C
    assert C.as_category("n", ["x"]).columns[1].levels == ("x",)
    for bad in (lambda: C.extend(Column("id", "int")), lambda: C.select("q"), lambda: C.with_type("level", "int"), lambda: C.excludes(["n"])):
        with pytest.raises(ContractError):
            bad()
