"""The .h5ad source over a small stand-in for the h5py library, which isn't installed here."""

import importlib.util
import os
import pickle
import sys

import numpy as np
import pytest
from pyspark import SparkFiles

from tesserae.sources import h5ad

STAND_IN = '''
import pickle

class Data:
    def __init__(self, values, **attrs):
        self.values, self.attrs, self.dtype, self.shape = values, attrs, values.dtype, values.shape
    def __getitem__(self, at):
        return self.values[at]
    def __len__(self):
        return len(self.values)

class Group(dict):
    attrs = {}
    def __enter__(self):
        return self
    def __exit__(self, *error):
        return False

def File(path, mode):
    content, attrs = pickle.load(open(path, "rb"))
    def made(node):
        if isinstance(node, tuple):
            group = Group({k: made(v) for k, v in node[0].items()})
            group.attrs = node[1]
            return group
        return Data(node)
    return made((content, attrs))
'''


@pytest.fixture(scope="module")
def stand_in(spark, tmp_path_factory):
    if importlib.util.find_spec("h5py") is not None:
        pytest.skip("h5py is installed")
    folder = tmp_path_factory.mktemp("h5py")
    (folder / "h5py.py").write_text(STAND_IN)
    sys.path.insert(0, str(folder))
    spark.sparkContext.addPyFile(str(folder / "h5py.py"))
    yield folder
    sys.path.remove(str(folder))
    sys.modules.pop("h5py", None)
    os.remove(SparkFiles.get("h5py.py"))  # other tests ask whether the library is there
    importlib.invalidate_caches()


DENSE = np.array([[0.0, 1.0, 0.0], [2.0, 0.0, 3.0], [0.0, 0.0, 0.0], [4.0, 5.0, 6.0]])


def sparse(dense, by_columns):
    lines = dense.T if by_columns else dense
    at = [np.flatnonzero(line) for line in lines]
    parts = {"data": np.concatenate([line[a] for line, a in zip(lines, at)]), "indices": np.concatenate(at), "indptr": np.cumsum([0, *map(len, at)])}
    return parts, {"encoding-type": b"csc_matrix" if by_columns else "csr_matrix", "shape": np.array(dense.shape)}


def written(folder, name, x, **more):
    group = ({"codes": np.array([0, 1, -1, 0], np.int8), "categories": np.array([b"A", b"B"], object)}, {"encoding-type": "categorical"})
    score = ({"values": np.array([1, 2, 3, 4]), "mask": np.array([False, True, False, False])}, {"encoding-type": "nullable-integer"})
    obs = ({"cell": np.array([b"c0", b"c1", b"c2", b"c3"], object), "group": group, "score": score, "OBS_ID": np.array([1.5, 2.5, np.nan, 0.0]), "ok": np.array([True, False, True, True])}, {"_index": b"cell", "column-order": np.array(["score", "group", "OBS_ID", "ok"], object)})
    var = ({"_index": np.array(["g0", "g1", "g2"], object)}, {})
    path = folder / name
    path.write_bytes(pickle.dumps(({"X": x, "obs": obs, "var": var, **more}, {})))
    return str(path)


def entries(rows):
    return sorted((r["obs_id"], r["var_id"], r["value"]) for r in rows.collect())


@pytest.mark.parametrize("how", ["rows", "columns", "dense"])
def test_matrix_of_each_encoding(spark, stand_in, monkeypatch, how):
    x = DENSE if how == "dense" else sparse(DENSE, how == "columns")
    path = written(stand_in, f"{how}.h5ad", x, layers=({"twice": sparse(2 * DENSE, True)}, {}), obsm=({"pca": np.arange(8.0).reshape(4, 2)}, {}))
    data = h5ad.read_h5ad(spark, path)
    want = [(int(i), int(j), DENSE[i, j]) for i, j in zip(*np.nonzero(DENSE))]
    assert entries(data.x) == want
    assert entries(data.layers["twice"]) == [(i, j, 2 * v) for i, j, v in want]
    assert sorted(tuple(r) for r in data.obsm["pca"].collect()) == [(i, [2.0 * i, 2.0 * i + 1]) for i in range(4)]


def test_columns_of_axes(spark, stand_in):
    data = h5ad.read_h5ad_memory(spark, written(stand_in, "axes.h5ad", sparse(DENSE, False)))
    assert data.obs.columns == ["obs_id", "obs_idx", "obs_name", "score", "group", "OBS_ID_1", "ok"]
    rows = [tuple(r) for r in data.obs.orderBy("obs_id").collect()]
    assert rows[0] == (0, 0, "c0", 1, "A", 1.5, True) and rows[1][3:5] == (None, "B") and rows[2][4] is None and np.isnan(rows[2][5])
    assert [tuple(r) for r in data.var.orderBy("var_id").collect()] == [(0, 0, "g0"), (1, 1, "g1"), (2, 2, "g2")]
    assert data.x.is_cached and h5ad.read_h5ad(spark, written(stand_in, "again.h5ad", DENSE)).layers == {}


def test_matrices_that_do_not_fit(spark, stand_in):
    for x in (DENSE.T.copy(), (sparse(DENSE, False)[0], {"encoding-type": "other"})):
        with pytest.raises(Exception):
            h5ad.read_h5ad(spark, written(stand_in, "wrong.h5ad", x)).x.count()
