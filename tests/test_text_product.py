"""From text to text in one call, and indices that counts must see too."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException

from gridmat import multiply_text, sinks, sources
from gridmat.operators import profile
from gridmat.operators.joins import block_sizes
from gridmat.sources import from_table
from helpers import array_of, cells_of, random_pair


def _lines(path):
    return sorted(line for f in os.listdir(path) if f.startswith("part-") for line in open(f"{path}/{f}"))


@pytest.mark.parametrize("method", ["naive", "IPB", "OPB", "auto"])
@pytest.mark.parametrize("sparsity", [0, 60])
def test_text_to_text(spark, tmp_path, method, sparsity):
    a, b = random_pair(6)
    paths = [str(tmp_path / x) for x in "ABC"]
    write = sinks.write_row_text if sparsity else sinks.write_dense_text
    for m, path in zip((a, b), paths):
        write(cells_of(spark, m), path, **({"all_rows": True} if sparsity else {}))
    c = multiply_text(spark, *paths, a.shape, b.shape, method=method, sparsity=sparsity, files=2)
    assert (c.n_rows, c.n_cols) == (a.shape[0], b.shape[1])
    assert np.array_equal(array_of(c), a @ b)
    if sparsity:
        assert np.array_equal(array_of(sources.read_dense_id(spark, paths[2], (c.n_rows, c.n_cols))), a @ b)
        scratch = f"{spark.conf.get('spark.checkpoint.dir')}/gridmat"
        assert not [x for x in os.listdir(scratch) if x.startswith("sparse-text")] if os.path.isdir(scratch) else True
    else:
        assert np.array_equal(array_of(sources.read_dense(spark, paths[2], (c.n_rows, c.n_cols))), a @ b)
        assert all(x.split(".")[1].startswith("000") for x in _lines(paths[2]))


def test_wrong_arguments_are_refused_before_any_work(spark, tmp_path):
    out = str(tmp_path / "C")
    for kind, options in ((ValueError, {"method": "OPC"}), (ValueError, {"sparsity": 101}), (ValueError, {"sparsity": -1})):
        with pytest.raises(kind):
            multiply_text(spark, "/none/A", "/none/B", out, (2, 2), (2, 2), **options)
    assert not os.path.exists(out)


def test_counts_see_an_index_outside_the_shape(spark):
    m = from_table(spark.createDataFrame([(0, 0, 1.0), (1, 25, 1.0)], "i long, j long, v double"), "i", "j", "v", (3, 3))
    for count in (profile.nnz, profile.matrix_profile, lambda x: block_sizes(x, 2, 2)):
        with pytest.raises(PySparkException, match="outside the shape"):
            count(m).collect()
