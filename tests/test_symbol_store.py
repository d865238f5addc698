"""Symbols written, read and replaced in place."""

from thicket.operators import symbols


def test_saved_over_itself(spark, tmp_path):
    rows = [("a.rs", "function", "f", 1, 3, 1, 4, "fn f() {}"), ("a.rs", "struct", "S", 1, 1, 1, 2, None), ("b.rs", "enum", "E", 1, 5, 1, 6, "enum E {}")]
    path = str(tmp_path / "symbols")
    symbols.save(spark.createDataFrame(rows, symbols.SCHEMA), path)
    held = symbols.load(spark, path)
    assert [r.name for r in symbols.of_file(held, "a.rs").collect()] == ["S", "f"]
    assert symbols.counts(held).first() == (2, 3)
    symbols.save(symbols.drop_files(held, spark.createDataFrame([("b.rs",)], "path string")), path)
    assert [tuple(r) for r in symbols.load(spark, path).collect()] == [rows[2]]
