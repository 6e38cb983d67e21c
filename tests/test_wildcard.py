"""The cap on the names that a file gets from wildcard imports."""

from terrane.operators import change


def test_wildcard_bindings_keep_a_thousand_names_of_a_file(spark):
    imports = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 8, 1)], "file long, target long, seq long")
    exports = spark.createDataFrame([(t, f"n{t}_{k:04}", t) for t in (7, 8) for k in range(600)], "target long, name string, symbol long")
    got = [(r.file, r["name"]) for r in change.wildcard_bindings(imports, exports).collect()]
    assert sorted(got) == sorted(
        [(1, f"n7_{k:04}") for k in range(600)] + [(1, f"n8_{k:04}") for k in range(400)] + [(2, f"n8_{k:04}") for k in range(600)]
    )
