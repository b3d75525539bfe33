"""Index arrays in files, written and read in pieces."""

import numpy as np
import pytest

from graphloom import Graph
from graphloom.sources import binary
from graphloom.sources import edges as E

from .test_graph import TRIANGLE, test_bad_arrays

BAD = next(m for m in test_bad_arrays.pytestmark if m.name == "parametrize").args[1]


def _files(folder, indptr, indices, bits=64):
    for name, a in (("indptr", indptr), ("indices", indices)):
        (folder / f"{name}_u{bits}.bin").write_bytes(np.array(a, f"<u{bits // 8}").tobytes())


@pytest.mark.parametrize("bits", [64, 32])
def test_read(spark, tmp_path, bits):
    _files(tmp_path, *TRIANGLE, bits)
    assert sorted(map(tuple, Graph.from_csr_files(spark, str(tmp_path)).edges.collect())) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


@pytest.mark.parametrize("arrays,why", [x for x in BAD if len(x[0]) == 2 and not isinstance(x[0][0][0], list)])
def test_bad_files(spark, tmp_path, arrays, why):
    _files(tmp_path, *arrays)
    with pytest.raises(ValueError, match=why):
        Graph.from_csr_files(spark, str(tmp_path))


def test_pieces(spark, tmp_path, monkeypatch):
    """Many parts and pieces give the arrays of one, and the driver never has them: collect and toPandas are not used."""
    rows = [(i, (i * 7 + k) % 200) for i in range(200) for k in range(1, 9)]
    g = Graph.from_edges(spark.createDataFrame(rows, "src long, dst long"), dense=True)
    want = sorted(map(tuple, g.edges.collect()))
    monkeypatch.setattr(binary, "PART", 300)
    meta, kind = g.exact_metadata(), type(g.edges)
    whole = kind.collect
    few = lambda df: rows if len(rows := whole(df)) < 10 else pytest.fail("on the driver")
    monkeypatch.setattr(kind, "toPandas", lambda df: pytest.fail("on the driver"))
    monkeypatch.setattr(kind, "collect", few)
    assert g.save_binary(str(tmp_path / "g")) == meta
    monkeypatch.undo()
    ptr, idx = (np.fromfile(tmp_path / "g" / f"{n}_u64.bin", "<u8") for n in ("indptr", "indices"))
    E.check_csr(ptr, idx)
    assert list(zip(np.repeat(np.arange(len(ptr) - 1), np.diff(ptr.astype(int))), idx)) == want
    assert np.fromfile(tmp_path / "g" / "triangle_u64.bin", "<u8").sum() == 6 * meta.num_triangle > 0
    assert (np.fromfile(tmp_path / "g" / "degree_u32.bin", "<u4") == np.diff(ptr)).all()
    monkeypatch.setattr(binary, "PART", 300)
    h = Graph.from_preprocessed(spark, str(tmp_path / "g"))
    assert h.metadata == meta and sorted(map(tuple, h.edges.collect())) == want
    g.unpersist()


def test_pieces_hold_whole_lists(monkeypatch):
    import pyarrow as pa

    rows = [(i, j) for i in range(40) for j in range(40) if i != j and (i + j) % 3]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[::-1]], pa.int64()) for k in (0, 1)], ["src", "dst"])
    monkeypatch.setattr(binary, "PIECE", 60)
    pieces = list(binary._cut(iter([batch])))
    of = lambda n: np.concatenate([np.frombuffer(b.column(n)[0].as_py(), "<u8") for b in pieces]).tolist()
    assert len(pieces) > 10 and of("indices") == [d for _, d in rows]
    assert of("degree") == [sum(s == v for s, _ in rows) for v in range(40)] and of("offset") == [sum(s == v and d < s for s, d in rows) for v in range(40)]
    ptr = np.concatenate([[0], np.cumsum(of("degree"))])
    lists = list(binary._lists(ptr, np.array(of("indices")), 0))
    assert len(lists) == len(pieces) and [(int(a), int(b)) for x, y in lists for a, b in zip(x, y)] == rows


def test_edges_are_shuffled_once_for_storage(spark, tmp_path, monkeypatch):
    """The written plan ranges the edges, groups them where they are and joins nothing; dense ids are given to an edge once."""
    from pyspark.sql.readwriter import DataFrameWriter

    rows = [(i, (i * 7 + k) % 90) for i in range(90) for k in range(1, 6)]
    g = Graph.from_edges(spark.createDataFrame(rows, "src long, dst long"), dense=True)
    assert g._base.storageLevel.useMemory and g._base.count() * 2 == g.num_edges
    plans, write = [], DataFrameWriter.parquet

    def seen(self, path, *a, **k):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    meta = g.save(str(tmp_path / "g"))
    assert "Join" not in plans[0].split("InMemoryRelation")[0] and plans[0].split("InMemoryRelation")[0].count("rangepartitioning") == 1
    h = Graph.from_preprocessed(spark, str(tmp_path / "g"))
    assert h.metadata == meta and sorted(map(tuple, h.edges.collect())) == sorted(map(tuple, g.edges.collect()))
    stored = {r.vid: r for r in spark.read.parquet(str(tmp_path / "g" / "adjacency.parquet")).collect()}
    assert {v: r.triangles for v, r in stored.items()} == {r.vid: r.triangles for r in g.raw_triangles().collect()}
    assert {v: (r.degree, r.offset) for v, r in stored.items()} == {r.vid: (r.degree, r.offset) for r in g.degrees().collect()}
    g.unpersist()
    assert not g._base.storageLevel.useMemory
