import pytest

from lectern.operators import units

Q = [(1, "chamber pressure", "pressure", "kPa"), (2, "bath temperature", "temperature", "K"), (3, "dry mass", "mass", "g"), (4, "run-down torque|seating torque", "torque", "N m"), (5, "purge flow", "flow", "L/min"), (6, None, "flow", "L/min")]


def found(spark, texts):
    c = spark.createDataFrame([(f"c{i}", t, 7) for i, t in enumerate(texts)], "chunk_id string, content string, k int")
    q = spark.createDataFrame(Q, "quantity_id int, names string, dimension string, common_unit string")
    return {(r.chunk_id, r.quantity_id, r.value_common) for r in units.reading_integers(c, q).collect()}


def test_notations(spark):
    texts = [
        "[T] A chamber pressure of\n144,662 mbar was logged.", "With 7,03 ounces of dry mass the run went on.", "DRY MASS, as found, 15.90kilograms.", "Bath temperature = 1.194 × 10^2 degrees Fahrenheit", "run-\ndown torque: 12.5 ft-lb.",
        "| Chamber Pressure in lbf/in² | Purge flow (L/s) |\n|---|---|\n| 263.5 | 1,5 |\n", "Unless stated, temperature is in °F. Bath temperature 200.9; other 3.", "chamber pressure in thousands of kPa: 2.5", "| Quantity | Value | Unit |\n|---|---|---|\n| purge flow | 6.60 | L/s |",
        "The storekeeper read 26.56 m³/h (purge flow).", "Bath temperature: −3.0 °C.",
    ]
    assert found(spark, texts) == {
        ("c0", 1, 14466), ("c1", 3, 199), ("c2", 3, 15900), ("c3", 2, 322), ("c4", 4, 17), ("c5", 1, 1817), ("c5", 5, 90), ("c6", 2, 367), ("c7", 1, 2500), ("c8", 5, 396), ("c9", 5, 443), ("c10", 2, 270),
    }


@pytest.mark.parametrize("t", [None, "", "dry mass 843 (unit illegible on the sheet).", "Chamber pressure was not recorded.", "The dry mass gauge was returned after 17 minutes.", "dry mass of 12 kPa", "x" * 300_000])
def test_no_reading(spark, t):
    assert found(spark, [t]) == set()


def test_repeats_and_empty(spark):
    assert found(spark, []) == set()
    c = spark.createDataFrame([("c", "dry mass: 2 kg. Dry mass: 2000 g."), ("c", "dry mass: 2 kg. Dry mass: 2000 g.")], "chunk_id string, content string")
    q = spark.createDataFrame(Q, "quantity_id int, names string, dimension string, common_unit string")
    assert [tuple(r) for r in units.reading_integers(c, q).collect()] == [("c", 3, 2000)]


def test_source_default(spark):
    c = spark.createDataFrame([("a", "Dry mass 5."), ("b", "Dry mass 5.")], "chunk_id string, content string")
    q = spark.createDataFrame(Q, "quantity_id int, names string, dimension string, common_unit string")
    d = spark.createDataFrame([("a", "mass", "kg")], "chunk_id string, dimension string, alias string")
    assert {tuple(r) for r in units.reading_integers(c, q, default_units=d).collect()} == {("a", 3, 5000)}
