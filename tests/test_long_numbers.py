"""Numbers of any length against Python's own."""

import random

from docflow.operators import numbers


def test_values_of_any_length(spark):
    rng, rows, want = random.Random(5), [], {}
    for key, (base, whole, part) in enumerate([(2, 700, 300), (256, 120, 40), (10, 512, 0), (64, 1, 90), (16, 0, 5), (8, 3, 0), (10, 2_000, 2_000)]):
        top, low = [rng.randrange(base) for _ in range(whole)], [rng.randrange(base) for _ in range(part)]
        rows += [(key, whole - 1 - i, d, base) for i, d in enumerate(top)] + [(key, -1 - i, d, base) for i, d in enumerate(low)]
        value = lambda digits: sum(d * base ** (len(digits) - 1 - i) for i, d in enumerate(digits))
        want[key] = str(value(top)), str(value(low)), str(base**part)
    rng.shuffle(rows)
    rows += [(0, None, 1, 2), (0, 3, None, 2)]
    df = spark.createDataFrame(rows, "k int, position int, digit int, base int").repartition(5)
    got = {r["k"]: (r["integer"], r["numerator"], r["denominator"]) for r in numbers.positional_text(df, ["k"]).collect()}
    assert got == want
    assert numbers.positional_text(df.limit(0), ["k"]).collect() == []
