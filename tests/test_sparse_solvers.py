import json
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparktile import cli
from sparktile.operators import layout
from sparktile.operators.levels import levels_of
from sparktile.operators.sparse import Matrix
from sparktile.operators.tensor import Tensor
from sparktile.solvers import blocks
from sparktile.solvers.config import from_json, strip_comments
from sparktile.solvers.distributed import Image, solve
from sparktile.solvers.local import Csr, Ilu, LocalSolver, Sweep
from sparktile.sources import matrix_market
from sparktile.types import FLOAT32, FLOAT64

BICGSTAB = {"type": "PBiCGStab", "relResidual": 1e-10, "maxIterations": 100}


def dense(matrix):
    out = np.zeros((matrix.n_rows, matrix.n_cols))
    for r in matrix.df.collect():
        out[r.row, r.col] += r.val
    return out


def vector(t):
    return np.array([r.v for r in t.df.orderBy("i").collect()])


def from_dense(spark, a):
    rows = [(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if a[i, j]]
    return Matrix.from_coo(spark.createDataFrame(rows, "row long, col long, val double"), n_rows=a.shape[0], n_cols=a.shape[1])


def test_poisson(spark):
    a = Matrix.poisson3d(spark, 4, 4, 4)
    r = a.df.agg(F.count("*").alias("n"), F.sum("val").alias("s")).first()
    assert (r.n, r.s) == (352, 96)
    d = dense(a)
    assert (d == d.T).all() and (np.linalg.eigvalsh(d) > 0).all()


def test_spmv_keeps_empty_rows_and_sums_duplicates(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (2, 0, 1.0)], "row long, col long, val double")
    a = Matrix.from_coo(df, n_rows=4, n_cols=2)
    x = Tensor.from_numpy(spark, np.array([10.0, 1.0]))
    assert vector(a @ x).tolist() == [5, 0, 10, 0]
    with pytest.raises(ValueError):
        a @ Tensor.from_numpy(spark, np.array([1.0]))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 2**32 - 1))
def test_spmv_is_linear(spark, seed):
    rng = np.random.default_rng(seed)
    m = rng.integers(-3, 4, (5, 4)) * (rng.random((5, 4)) < 0.6)
    x, y = rng.integers(-5, 6, 4).astype(float), rng.integers(-5, 6, 4).astype(float)
    a = from_dense(spark, m)
    both = vector(a @ Tensor.from_numpy(spark, x + 2 * y))
    assert both.tolist() == (m @ x + 2 * (m @ y)).tolist()


def test_residual_and_ldu(spark):
    a = Matrix.poisson3d(spark, 3, 3, 2)
    x, b = Tensor.from_numpy(spark, np.arange(18.0)), Tensor.from_numpy(spark, np.ones(18))
    assert np.allclose(vector(a.residual(x, b)), 1 - dense(a) @ np.arange(18.0))
    diag, faces = a.to_ldu()
    assert (dense(Matrix.from_ldu(diag, faces, 18)) == dense(a)).all()


MARKET = {
    "general": ("%%MatrixMarket matrix coordinate real general\n% a comment\n3 3 3\n1 1 2.5\n3 1 -1\n2 3 4e0\n", [[2.5, 0, 0], [0, 0, 4], [-1, 0, 0]]),
    "symmetric": ("%%MatrixMarket matrix coordinate integer symmetric\n2 2 2\n1 1 3\n2 1 5\n", [[3, 5], [5, 0]]),
    "skew": ("%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 5\n", [[0, -5], [5, 0]]),
    "pattern": ("%%MatrixMarket matrix coordinate pattern general\n2 2 2\n1 2\n2 1\n", [[0, 1], [1, 0]]),
    "array": ("%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n", [[1, 3], [2, 4]]),
}


@pytest.mark.parametrize("name", MARKET)
def test_matrix_market(spark, tmp_path, name):
    text, expected = MARKET[name]
    (tmp_path / "a.mtx").write_text(text)
    assert dense(Matrix.from_matrix_market(spark, str(tmp_path / "a.mtx"))).tolist() == expected


def test_matrix_market_vector_and_round_trip(spark, tmp_path):
    (tmp_path / "v.mtx").write_text("%%MatrixMarket vector coordinate real general\n4 2\n2 1.5\n4 -1\n")
    frame, n = matrix_market.read_vector(spark, str(tmp_path / "v.mtx"))
    assert [r.v for r in matrix_market.densify(frame, n).orderBy("i").collect()] == [0, 1.5, 0, -1]
    a = Matrix.poisson3d(spark, 3, 2, 2)
    matrix_market.write_triplets(a.df, str(tmp_path / "out"), 12, 12)
    assert (dense(Matrix.from_matrix_market(spark, str(tmp_path / "out"))) == dense(a)).all()
    (tmp_path / "bad.mtx").write_text("1 1 1\n")
    with pytest.raises(ValueError):
        Matrix.from_matrix_market(spark, str(tmp_path / "bad.mtx"))


def test_layout(spark):
    a = Matrix.poisson3d(spark, 6, 1, 1)
    part = layout.partition_rows(a, 3)
    assert layout.imbalance(part).first().most <= 3
    rows = layout.tile_layout(a, part).collect()
    owned = [r for r in rows if r.kind != layout.HALO]
    assert sorted(r.global_row for r in owned) == list(range(6))
    for tile in {r.tile for r in rows}:
        mine = sorted((r.local_row, r.kind) for r in rows if r.tile == tile)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1] for m in mine] == sorted(m[1] for m in mine)
    x = spark.range(6).select(F.col("id").alias("i"), (F.col("id") * 10.0).alias("v"))
    halo = layout.exchange_halo(layout.tile_layout(a, part), x).collect()
    at = {(r.tile, r.local_row): r.global_row for r in rows}
    assert halo and all(h.v == 10 * at[h.tile, h.local_row] for h in halo)
    assert layout.tile_layout(a, layout.partition_rows(a, 1)).where("kind <> 0").isEmpty()


def test_levels_of_a_box(spark):
    a = Matrix.poisson3d(spark, 4, 3, 2)
    wrong = layout.row_levels(a, layout.partition_rows(a, 1)).where("level <> row % 4 + floor(row / 4) % 3 + floor(row / 12)")
    assert wrong.isEmpty()
    apart = layout.row_levels(a, layout.partition_box(spark, 4, 3, 2, (1, 1, 2)))
    assert apart.agg(F.max("level")).first()[0] == 5


def test_running_total_over_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    found = [r.total for r in layout.running_total(df, "k", "v", 1000, block=64).orderBy("k").collect()]
    assert found == np.cumsum(np.arange(1000) % 7).tolist()


def test_ilu_of_a_tridiagonal_matrix_is_exact():
    n = 30
    a = np.diag(np.full(n, 4.0)) + np.diag(np.full(n - 1, -1.0), 1) + np.diag(np.full(n - 1, -2.0), -1)
    i, j = np.nonzero(a)
    csr = Csr(i, j, a[i, j], n)
    b = np.arange(n) + 1.0
    for diagonal_based in (False, True):  # on a tridiagonal pattern both factorisations are exact
        assert np.allclose(a @ Ilu(csr, diagonal_based).apply(b), b)


def test_missing_diagonal_raises():
    csr = Csr(np.array([0, 1]), np.array([0, 0]), np.array([1.0, 1.0]), 2)
    with pytest.raises(ZeroDivisionError):
        Ilu(csr, False)
    with pytest.raises(ZeroDivisionError):
        LocalSolver(csr, from_json({"type": "GaussSeidel"}))


@pytest.mark.parametrize(
    "config",
    [
        BICGSTAB,
        BICGSTAB | {"preconditioner": {"type": "ILU"}},
        BICGSTAB | {"preconditioner": {"type": "ILU", "diagonalBased": True}, "norm": "LINF"},
        {"type": "GaussSeidel", "relResidual": 1e-10, "maxIterations": 500, "norm": "L1"},
        {"type": "IterativeRefinement", "relResidual": 1e-10, "maxIterations": 50, "innerSolver": {"type": "ILU"}},
        {"type": "restarter", "maxRestarts": 4, "innerSolver": BICGSTAB | {"maxIterations": 8}},
    ],
)
def test_local_solvers_match_dense(config):
    rng = np.random.default_rng(5)
    n = 60
    a = (rng.random((n, n)) < 0.1) * rng.normal(size=(n, n))
    np.fill_diagonal(a, np.abs(a).sum(1) + 1)
    i, j = np.nonzero(a)
    b = rng.normal(size=n)
    solver = LocalSolver(Csr(i, j, a[i, j], n), from_json(config))
    assert np.allclose(solver.solve(np.zeros(n), b), np.linalg.solve(a, b), atol=1e-7)


def test_distributed_matches_local(spark):
    a = Matrix.poisson3d(spark, 3, 3, 2).materialize()
    b = a.spmv(Tensor.from_numpy(spark, np.arange(18.0)))
    config = from_json({"type": "PBiCGStab", "relResidual": 1e-6, "maxIterations": 4})
    x1, s1 = solve(a, b, config, where="local")
    x2, s2 = solve(a, b, config, where="distributed")
    assert np.allclose(vector(x1), vector(x2)) and s1.iterations == s2.iterations
    sweeps = from_json({"type": "GaussSeidel", "numFixedIterations": 2})
    y1, _ = solve(a, b, sweeps, where="local")
    y2, _ = solve(a, b, sweeps, where="distributed")
    assert np.allclose(vector(y1), vector(y2))
    z, stats = solve(a, b, from_json({"type": "IterativeRefinement", "relResidual": 1e-2, "maxIterations": 9, "innerSolver": {"type": "ILU"}}), tiles=2)
    assert stats.converged and np.allclose(vector(z), np.arange(18.0), atol=0.5)


@pytest.mark.parametrize(
    ("config", "dtype"),
    [
        ({"type": "GaussSeidel", "numFixedIterations": 3, "workingType": "float32"}, FLOAT64),
        ({"type": "GaussSeidel", "relResidual": 1e-3, "maxIterations": 9}, FLOAT32),
        ({"type": "PBiCGStab", "workingType": "float32", "relResidual": 1e-3, "maxIterations": 5}, FLOAT64),
        ({"type": "IterativeRefinement", "relResidual": 1e-6, "maxIterations": 5, "innerSolver": {"type": "ILU"}}, FLOAT32),
        ({"type": "restarter", "maxRestarts": 2, "innerSolver": {"type": "PBiCGStab", "relResidual": 1e-4, "maxIterations": 2, "preconditioner": {"type": "ILU", "diagonalBased": True}}}, FLOAT64),
    ],
)
def test_both_places_behave_alike(spark, capsys, config, dtype):
    """The same values in the same precision, iterations, residuals and lines, in one task and distributed."""
    a = Matrix.poisson3d(spark, 3, 3, 2, dtype).materialize()
    b = Matrix.poisson3d(spark, 3, 3, 2).spmv(Tensor.from_numpy(spark, np.arange(18.0) / 7))
    told = config | ({} if config["type"] == "restarter" else {"verbose": True})
    x, s = solve(a, b, from_json(told), where="local")
    said = capsys.readouterr().out
    y, t = solve(a, b, from_json(told), tiles=1, where="distributed")
    again = capsys.readouterr().out
    assert np.allclose(vector(x), vector(y), atol=1e-5, rtol=1e-5)
    single = config.get("workingType") == "float32" or (dtype == FLOAT32 and config["type"] != "IterativeRefinement" and config["type"] != "GaussSeidel")
    assert all((v == v.astype(np.float32)).all() for v in (vector(x), vector(y))) or not single
    assert s.iterations == t.iterations and s.converged == t.converged and np.allclose(s.history, t.history, rtol=1e-2)
    plain = lambda text: [line.split(" seconds=")[0].split("residual=")[0].split("first=")[0] for line in text.splitlines()]
    assert plain(said) == plain(again) and s.seconds > 0 and t.seconds > 0


def test_multicolour_switches_change_the_schedule_only():
    rng = np.random.default_rng(1)
    n = 80
    a = (rng.random((n, n)) < 0.08) * rng.normal(size=(n, n))
    np.fill_diagonal(a, np.abs(a).sum(1) + 1)
    i, j = np.nonzero(a)
    b, csr = rng.normal(size=n), Csr(i, j, a[i, j], n)
    x = np.zeros(n)
    for _ in range(3):  # row by row
        for r in range(n):
            x[r] += (b[r] - a[r] @ x) / a[r, r]
    for mode in ("on", "off", "auto"):
        sweep, y = Sweep(csr, mode), np.zeros(n)
        for _ in range(3):
            y = sweep(y, b)
        assert np.allclose(x, y)
        ilu = Ilu(csr, False, mode, mode)
        f = np.zeros((n, n))
        f[ilu.a.rows, ilu.a.cols] = ilu.vals
        low, up = np.tril(f, -1) + np.eye(n), np.triu(f)
        assert np.allclose((low @ up)[i, j], a[i, j]) and np.allclose(low @ (up @ ilu.apply(b)), b)  # exact on the pattern


def test_whole_levels_are_levels():
    rng = np.random.default_rng(2)
    rows, cols = rng.integers(0, 200, 900), rng.integers(0, 200, 900)
    keep = cols < rows
    rows, cols = rows[keep], cols[keep]
    level = np.zeros(200, int)
    for r in range(200):
        level[r] = max((level[c] + 1 for c in cols[rows == r]), default=0)
    pairs = np.unique(np.stack([rows, cols], 1), axis=0)
    assert (levels_of(pairs[:, 0], pairs[:, 1], 200) == level).all()


def test_repeated_vector_entries(spark, tmp_path):
    """Of entries with one index the later line's value counts."""
    path = tmp_path / "v.mtx"
    path.write_text("%%MatrixMarket vector coordinate real general\n5 4\n2 1.5\n4 9.0\n2 0.5\n5 3.0\n")
    v, n = matrix_market.read_vector(spark, str(path))
    assert [r.v for r in matrix_market.densify(v, n).orderBy("i").collect()] == [0.0, 0.5, 0.0, 9.0, 3.0]


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    from sparktile import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_config(spark, tmp_path, capsys):
    with pytest.raises(ValueError):
        from_json({"maxIterations": 3})
    with pytest.raises(ValueError):
        from_json({"type": "CG"})
    with pytest.raises(ValueError):
        from_json({"type": "restarter"})
    with pytest.warns(UserWarning):
        assert from_json({"type": "ILU", "mixedPrecision": True}).type == "ILU"
    assert from_json({"type": "GaussSeidel", "solveMulticolor": True}).solveMulticolor == "on"
    text = '{"a": "x//y", // note\n "b": 1 /* two */}'
    assert json.loads(strip_comments(text)) == {"a": "x//y", "b": 1}
    (tmp_path / "c.jsonc").write_text('{"x": 1.0, "benchmark": "solve", // here\n "solver": ' + json.dumps(BICGSTAB) + "}")
    assert cli.main(["-c", str(tmp_path / "c.jsonc"), "-p", "3,3,2"]) == 0
    assert "converged=True" in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.run(spark, {"benchmark": "sort"}, Matrix.poisson3d(spark, 2, 2, 2))


def test_nan_stops(spark):
    a = from_dense(spark, np.array([[1.0, 0], [0, 1.0]]))
    b = Tensor.from_numpy(spark, np.array([np.nan, 1.0]))
    _, stats = solve(a, b, from_json(BICGSTAB), where="local")
    assert stats.iterations == 0 and not stats.converged
    assert FLOAT64.is_float


def coupled(n, seed, chain):
    """A random diagonally dominant matrix with a chain below the diagonal."""
    rng = np.random.default_rng(seed)
    a = (rng.random((n, n)) < 4 / n) * rng.normal(size=(n, n)) * 0.1
    a += np.diag(np.full(n - 1, chain), -1) + np.diag(np.full(n - 1, -0.5), 1)
    np.fill_diagonal(a, np.abs(a).sum(1) + 0.5)
    return a


@pytest.mark.parametrize("weight", [-0.1, -1.0])  # settles at once; never, and is taken row by row
def test_a_chain_is_solved_as_a_whole(weight):
    n = 300
    rows, cols, b = np.arange(1, n), np.arange(n - 1), np.arange(n) + 1.0
    dense_l = np.eye(n) + np.diag(np.full(n - 1, weight), -1)
    for back in (False, True):
        r, c, l = (rows, cols, dense_l) if not back else (cols, rows, dense_l.T)
        x = blocks.triangle(r, c, np.full(n - 1, weight), lambda i, s: b[i] - s, b, back)
        assert np.allclose(l @ x, b) and x.dtype == b.dtype


@pytest.mark.parametrize("chain", [-0.5, -1e3])
@pytest.mark.parametrize("based", [False, True])
def test_factors_by_chunks_are_those_of_the_whole(chain, based):
    n = 150
    a = coupled(n, 3, -0.5)
    if chain == -1e3:  # pivots that each row passes on in full
        a = np.diag(np.full(n, 2.0)) + np.diag(np.full(n - 1, -1.0), 1) + np.diag(np.full(n - 1, -1.0), -1)
    i, j = np.nonzero(a)
    whole, found = Ilu(Csr(i, j, a[i, j], n), based), blocks.Factors(n, based)
    made = [found.add(i[(i >= lo) & (i < lo + 70)], j[(i >= lo) & (i < lo + 70)], a[i, j][(i >= lo) & (i < lo + 70)], min(70, n - lo)) for lo in range(0, n, 70)]
    assert np.allclose(np.concatenate(made), whole.vals, rtol=1e-10)
    with pytest.raises(ZeroDivisionError):
        blocks.Factors(2, based).add(np.array([0, 1]), np.array([0, 0]), np.array([1.0, 1.0]), 2)


def test_tiles_begin_where_rows_are_dealt(spark):
    a = np.zeros((50, 50))
    a[7], a[30, :9] = 1.0, 1.0  # a row of half the weight: a tile may stay empty
    for matrix, tiles in ((Matrix.poisson3d(spark, 5, 4, 3), 4), (Matrix.poisson3d(spark, 30, 30, 10), 7), (from_dense(spark, a), 5), (from_dense(spark, a), 1)):
        dealt = layout.partition_rows(matrix, tiles).groupBy("tile").agg(F.min("row").alias("row")).orderBy("tile").collect()
        starts, entries = layout.tile_starts(matrix, tiles)
        assert starts.tolist() == [r.row for r in dealt] and entries == matrix.df.count()


@pytest.mark.parametrize(
    "config",
    [
        {"type": "GaussSeidel", "numFixedIterations": 2},
        {"type": "IterativeRefinement", "maxIterations": 2, "innerSolver": {"type": "ILU"}},
        {"type": "IterativeRefinement", "maxIterations": 2, "innerSolver": {"type": "ILU", "diagonalBased": True}},
        {"type": "PBiCGStab", "maxIterations": 2, "preconditioner": {"type": "GaussSeidel", "numFixedIterations": 1}},
    ],
)
def test_tiles_of_many_chunks(spark, monkeypatch, config):
    """Tiles cut into chunks, and rows dealt to tiles out of order, against the tiles' own dense kernels."""
    monkeypatch.setattr(blocks, "CHUNK_ROWS", 7)
    n, rng = 60, np.random.default_rng(8)
    a, b, x0 = coupled(n, 4, -0.5), rng.normal(size=60), rng.normal(size=60)
    a[11, :], a[11, 11] = 0.0, 1.0
    tile = (np.arange(n) * 7 + 3) % 60 // 20
    parts = spark.createDataFrame([(int(k), int(t)) for k, t in enumerate(tile)], "row long, tile int")
    frame = lambda v: spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "i long, v double")
    same = tile[:, None] == tile[None, :]
    own = a * same
    i, j = np.nonzero(own)
    sweep = lambda x, r: np.linalg.solve(np.tril(own), r - (a - np.tril(own)) @ x)
    if config["type"] == "GaussSeidel":
        wanted = sweep(sweep(x0, b), b)
    elif config["type"] == "PBiCGStab":
        wanted = None
    else:
        ilu, wanted = Ilu(Csr(i, j, own[i, j], n), config["innerSolver"].get("diagonalBased", False)), x0
        for _ in range(2):
            wanted = wanted + ilu.apply(b - a @ wanted)
    got, stats = solve(from_dense(spark, a), frame(b), from_json(config), x0=frame(x0), tiles=3, where="distributed", partition=parts)
    if wanted is not None:
        assert np.allclose(vector(got), wanted)
    if config["type"] != "GaussSeidel":
        assert np.isclose(stats.final_residual, np.linalg.norm(b - a @ vector(got)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 40])
def test_order_system_is_summed_without_a_shuffle(spark, tmp_path, monkeypatch, n):
    """Neighbours and picks that fall on one place, as they do in tiny tables, against sums by place."""
    from sparktile.plans import matrices

    customers = [(3 * k + 1) % 5 - 6 * k for k in range(n)] if n == 9 else [(3 * k + 1) % 5 for k in range(n)]  # 9: picks of the order itself and its neighbours
    spark.createDataFrame(list(enumerate(customers)), "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(Matrix, "materialize", lambda self: self)
    a, x = matrices._order_system(spark, str(tmp_path))
    assert "Exchange" not in a.df._jdf.queryExecution().executedPlan().toString()
    wanted = np.zeros((n, n))
    for k, c in enumerate(customers):
        for col, val in ((k, 16.0), ((k + 1) % n, -1.0), ((k + n - 1) % n, -2.0), (math.fmod(7 * k + c, n), -1.0)):
            if col >= 0:
                wanted[k, int(col)] += val
    got = np.zeros((n, n))
    found = a.df.where("col >= 0").collect()
    for r in found:
        got[r.row, r.col] = r.val
    assert (got == wanted).all() and len({(r.row, r.col) for r in found}) == len(found)
    assert [r.v for r in x.orderBy("i").collect()] == [math.fmod(c, 7) + 1 for c in customers]


def test_long_products_are_not_summed_before_the_shuffle(spark, monkeypatch):
    """Behind a shuffled join such sums hold nearly every entry, and spill."""
    from sparktile.operators import sparse

    rng = np.random.default_rng(5)
    dense, x = (rng.random((30, 30)) < 0.2) * rng.normal(size=(30, 30)), rng.normal(size=30)
    monkeypatch.setattr(sparse, "BROADCAST_ROWS", 10)
    y = from_dense(spark, dense).products(spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i long, v double"))
    plan = y._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan[plan.index("Union") :].split("Join")[0] and plan.index("Exchange hashpartitioning(i") > plan.rindex("HashAggregate", 0, plan.index("Union"))
    assert np.allclose([r.v for r in y.orderBy("i").collect()], dense @ x)


def test_order_system_computes_a_column_once(spark, sf_dir, monkeypatch):
    """Expressions inside one another would repeat a column's remainder wherever the column is compared."""
    from sparktile.plans import matrices

    monkeypatch.setattr(Matrix, "materialize", lambda self: self)
    a, _ = matrices._order_system(spark, sf_dir)
    assert a.df._jdf.queryExecution().executedPlan().toString().count(" % ") == 3


@pytest.mark.parametrize("place", ["local", "distributed"])
def test_right_hand_side_as_an_image(spark, monkeypatch, place):
    """A right-hand side by its x is A x in both places; distributed, frames are not joined for it."""
    x = np.arange(60.0) - 7
    a = np.tril(coupled(60, 6, -0.5))
    monkeypatch.setattr(blocks, "CHUNK_ROWS", 7)
    if place == "distributed":
        monkeypatch.setattr(Matrix, "products", None)
    y, _ = solve(from_dense(spark, a), Image(Tensor.from_numpy(spark, x)), from_json({"type": "ILU"}), tiles=1, where=place)
    assert np.allclose(vector(y), x)  # a triangle's factors are exact


def test_numbers_of_chunks_and_tiles_need_no_python_workers(spark, monkeypatch):
    """What the driver knows goes to the JVM as it is, and tiles' starts are found there."""
    plans, keep, a = [], blocks.Blocks._keep, Matrix.poisson3d(spark, 4, 3, 2)
    monkeypatch.setattr(blocks.Blocks, "_keep", lambda self, df, order="key": plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df, order))
    x = spark.range(24).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))
    solve(a, Image(x), from_json({"type": "GaussSeidel", "numFixedIterations": 1}), tiles=2, where="distributed")
    assert plans and not [p for p in plans if "ExistingRDD" in p]
    wanted = [r.row for r in layout.partition_rows(a, 4).groupBy("tile").agg(F.min("row").alias("row")).orderBy("tile").collect()]
    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInPandas", None)
    assert layout.tile_starts(a, 4)[0].tolist() == wanted


@pytest.mark.parametrize("config", [{"numFixedIterations": 3}, {"numSweeps": 2, "maxIterations": 4, "relResidual": 1e-12}])
def test_a_sweep_is_one_pass(spark, monkeypatch, config):
    """One table a sweep, and of the last sweep's successor nothing is in the result."""
    monkeypatch.setattr(blocks, "CHUNK_ROWS", 7)
    kept, keep, n = [], blocks.Blocks._keep, 40
    monkeypatch.setattr(blocks.Blocks, "_keep", lambda self, df, order="key": kept.append(df.columns) or keep(self, df, order))
    a, b = coupled(n, 9, -0.5), np.random.default_rng(9).normal(size=n)
    got, stats = solve(from_dense(spark, a), Tensor.from_numpy(spark, b), from_json({"type": "GaussSeidel"} | config), tiles=1, where="distributed")
    x, residuals = np.zeros(n), [np.linalg.norm(b)]
    for _ in range(stats.iterations):
        x = np.linalg.solve(np.tril(a), b - np.triu(a, 1) @ x)
        residuals.append(np.linalg.norm(b - a @ x))
    assert np.allclose(vector(got), x, rtol=1e-12, atol=0)
    fixed = "numFixedIterations" in config
    assert stats.iterations == (3 if fixed else 4) and (fixed or np.allclose(stats.history, residuals[::2], rtol=1e-9))
    assert len(kept) == 4 + stats.iterations + (not fixed)  # matrix, plan, b and zeros come before
