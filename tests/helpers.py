"""Small matrices in and out of Spark."""

import numpy as np

from gridmat.matrix import CellMatrix, VectorMatrix


def cells_of(spark, array, keep=None) -> CellMatrix:
    """The non-zero cells of an array, or those where ``keep`` is true."""
    array = np.asarray(array, dtype=float)
    keep = array != 0 if keep is None else keep
    rows = [(int(i), int(j), float(array[i, j])) for i, j in zip(*np.nonzero(keep))]
    df = spark.createDataFrame(rows, "i bigint, j bigint, v double")
    return CellMatrix(df, *array.shape)


def vectors_of(spark, array, by="row") -> VectorMatrix:
    array = np.asarray(array, dtype=float)
    source = array if by == "row" else array.T
    rows = [(k, [float(x) for x in vec]) for k, vec in enumerate(source)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    return VectorMatrix(df, *array.shape, by=by)


def array_of(m) -> np.ndarray:
    out = np.zeros((m.n_rows, m.n_cols))
    seen = set()
    for i, j, v in m.cells().df.select("i", "j", "v").collect():
        assert (i, j) not in seen, f"cell {(i, j)} appears twice"
        seen.add((i, j))
        out[i, j] = v
    return out


def places_of(m) -> set:
    return {(r["i"], r["j"]) for r in m.cells().df.collect()}


def random_pair(seed, n=7, k=5, m=9, empty_k=2):
    """Two sparse whole-number arrays; A has an empty column, B an empty row."""
    rng = np.random.default_rng(seed)
    a = rng.integers(-4, 5, (n, k)).astype(float) * (rng.random((n, k)) < 0.6)
    b = rng.integers(-4, 5, (k, m)).astype(float) * (rng.random((k, m)) < 0.6)
    a[:, empty_k] = 0
    b[(empty_k + 1) % k, :] = 0
    return a, b


def structural(a, b) -> set:
    """Cells of the product for which some k has both factors."""
    hits = (a != 0).astype(int) @ (b != 0).astype(int)
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(hits))}
