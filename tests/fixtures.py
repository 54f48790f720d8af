"""Small labelled tables with known bins and trees: (label, f0, f1, f2)."""

DATA1 = [
    (0, 0, 0, -52.28), (0, 1, 0, -32.16), (1, 2, 0, -73.68), (1, 3, 0, -26.38), (2, 4, 0, 13.69), (2, 0, 1, 42.07),
    (2, 1, 1, 22.96), (3, 2, 1, -33.43), (3, 3, 1, -61.80), (0, 4, 1, -81.34), (2, 0, 1, -68.49), (2, 1, 1, 64.17),
    (3, 2, 1, 20.88), (3, 3, 1, 27.75), (0, 4, 1, 59.07), (0, 0, 2, -53.55), (1, 1, 2, 25.89), (1, 2, 2, 22.62),
    (2, 3, 2, -5.63), (2, 4, 2, 81.67), (0, 0, 2, -72.87), (1, 1, 2, 25.51), (1, 2, 2, 43.14), (2, 3, 2, 60.53),
    (2, 4, 2, 88.94), (0, 0, 2, 17.08), (1, 1, 2, 69.48), (1, 2, 2, -76.47), (2, 3, 2, 90.90), (2, 4, 2, -79.67),
]
NAN = float("nan")
DATA2 = [r[:3] for r in DATA1]
DATA3 = [(({3: 1.1, 5: 2.3, 8: 3.5, 13: 3.2}).get(i, r[0]), *r[1:]) for i, r in enumerate(DATA2)]
DATA6 = [(y, NAN if i in (7, 8, 24) else a, NAN if i in (2, 3) else b) for i, (y, a, b) in enumerate(DATA2)]


def frame(spark, rows):
    fields = ", ".join(["row_id bigint", "label double", *(f"f{j} double" for j in range(len(rows[0]) - 1))])
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], fields)
