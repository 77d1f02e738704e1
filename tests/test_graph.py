import numpy as np
import pytest

from densegraph.functions import vectors as V
from densegraph.operators import evaluate, graph, hierarchy, knn, mst
from densegraph.plans import clustering
from densegraph.sources import files


def points(spark, xs):
    return spark.createDataFrame([(i, [float(v) for v in np.atleast_1d(x)]) for i, x in enumerate(xs)], "vec_id long, embedding array<float>")


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_line_of_six(spark):
    v = points(spark, [0, 1, 2, 10, 11, 12])
    g = knn.exact_knn(v, 2)
    assert [r[:2] for r in rows(g, "q", "nbr", "rank") if r[0] == 0] == [(0, 1), (0, 2)]
    assert dict(rows(graph.in_degree(g))) == {i: 2 for i in range(6)}
    assert dict(rows(graph.core_distance(g, 2))) == {0: 2.0, 1: 1.0, 2: 2.0, 3: 2.0, 4: 1.0, 5: 2.0}
    assert dict(rows(graph.core_distance(g, 2, include_self=True))) == {i: 1.0 for i in range(6)}
    with pytest.raises(ValueError):
        graph.core_distance(g, 3)


def test_blocks_do_not_change_the_result(spark):
    v = points(spark, np.random.default_rng(0).normal(size=(150, 5)))
    assert rows(knn.exact_knn(v, 7)) == rows(knn.exact_knn(v.repartition(5), 7, block=20))
    want = rows(knn.ranked(knn.pairwise(v, v), 7), "q", "nbr", "rank")
    assert rows(knn.exact_knn(v, 7), "q", "nbr", "rank") == want


def test_pairs_by_dot(spark):
    """Copies, far vectors with near ones (the product alone loses their digits), a null vector, any blocks."""
    x = np.random.default_rng(3).normal(size=(40, 6)) + 1e6
    v = points(spark, [*x, x[0], x[1] + 1e-4]).union(spark.createDataFrame([(42, None)], "vec_id long, embedding array<double>"))
    want = {(r["q"], r["nbr"]): r["dist"] for r in knn.pairwise(v, v).collect()}
    for block in (1024, 7):
        got = rows(knn.pairwise_by_dot(v.where("vec_id < 41"), v, block=block), "q", "nbr")
        assert got == sorted(p for p in want if p[0] < 41)
        dist = {(r["q"], r["nbr"]): r["dist"] for r in knn.pairwise_by_dot(v, v, block=block).collect()}
        assert dist.keys() == want.keys() and all((d is None) == (want[p] is None) and (d is None or abs(d - want[p]) < 1e-6) for p, d in dist.items())


def test_fewer_points_than_neighbours_and_duplicates(spark):
    assert len(rows(knn.exact_knn(points(spark, [0, 0, 5]), 8))) == 6
    tree = mst.kruskal(graph.mutual_reachability(graph.symmetrised(g := knn.exact_knn(points(spark, [0, 0, 0]), 1)), graph.core_distance(g, 1)).select("src", "dst", "weight"))
    assert {r["weight"] for r in tree.collect()} == {0.0}
    assert spark.range(1).select(V.lambda_of(V.F.lit(0.0))).first()[0] == V.INFINITE_LAMBDA


def test_trees_agree_and_ties_are_ordered(spark):
    rng = np.random.default_rng(1)
    e = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 500), rng.integers(0, 60, 500), rng.integers(1, 6, 500), strict=True) if a != b]
    df = spark.createDataFrame(e, mst.EDGE)
    want = sorted(map(tuple, mst.forest(mst.simple(df).toPandas()).itertuples(index=False)))
    assert rows(mst.kruskal(df)) == want == rows(mst.boruvka(df)) == rows(mst.kruskal(df.repartition(7), partitions=4))
    square = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (0, 3, 1.0)], mst.EDGE)
    assert rows(mst.boruvka(square, nodes=4)) == [(0, 1, 1.0), (0, 3, 1.0), (1, 2, 1.0)]


def test_disconnected(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0)], mst.EDGE)
    for build in (mst.kruskal, mst.boruvka):
        with pytest.raises(mst.DisconnectedGraphError):
            build(e, nodes=4)
    assert dict(rows(mst.components(e, spark.range(5)))) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert rows(mst.boruvka(e.limit(0))) == []


def test_hierarchy_by_hand(spark):
    t = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (3, 4, 1.0), (4, 5, 2.0), (2, 3, 8.0)], mst.EDGE)
    link = hierarchy.single_linkage(t)
    assert rows(link) == [(6, 0, 1, 1.0, 2), (7, 6, 2, 1.0, 3), (8, 3, 4, 1.0, 2), (9, 8, 5, 2.0, 3), (10, 7, 9, 8.0, 6)]
    c = hierarchy.condensed_tree(link, 3).cache()
    assert sorted(r for r in rows(c) if r[3] > 1) == [(6, 7, 0.125, 3), (6, 8, 0.125, 3)]
    s = dict(rows(hierarchy.stability(c)))
    assert s == pytest.approx({6: 0.75, 7: 3 * 0.875, 8: 3 * 0.375})
    assert hierarchy.selected(c, hierarchy.stability(c)) == [7, 8]
    assert dict(rows(hierarchy.flat_labels(c, [7, 8]))) == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}


def test_clusters_of_the_generator(spark):
    v = files.generated(spark, 700).cache()
    g = knn.exact_knn(v, 400).cache()  # far groups are joined too
    edges = graph.mutual_reachability(graph.symmetrised(g), graph.core_distance(g, 16))
    tree = mst.kruskal(edges.select("src", "dst", "weight"), nodes=700)
    c = hierarchy.condensed_tree(hierarchy.single_linkage(tree), 16).cache()
    got = hierarchy.flat_labels(c, hierarchy.selected(c, hierarchy.stability(c)))
    assert got.select("label").distinct().where("label >= 0").count() == 7
    both = got.join(v.select(V.F.col("vec_id").alias("id"), "truth"), "id")
    assert evaluate.adjusted_rand(both, "label", "truth").first()[0] > 0.9


def test_descent_recall(spark):
    v = files.generated(spark, 400).select("vec_id", "embedding").cache()
    assert evaluate.recall_at_k(knn.nndescent(v, 8, iterations=6), knn.exact_knn(v, 8), 8).first()[0] > 0.9


def test_descent_widens_short_lists(spark):
    """Vectors without clusters: lists of 8 get stuck, so they grow until the points asked have their neighbours."""
    v = points(spark, np.random.default_rng(5).normal(size=(400, 16))).cache()
    truth = knn.exact_knn(v, 8).cache()
    found = knn.refine(v, knn.random_knn(v, 8), 8, sample=4, least_list=8, iterations=8)
    assert evaluate.recall_at_k(found, truth, 8).first()[0] > 0.95


def test_lists_are_completed(spark):
    """Lists of far points, too short ones, none at all and many copies; any blocks."""
    x = np.random.default_rng(7).normal(size=(60, 5))
    v = points(spark, [*x, *[x[0]] * 30]).cache()
    want = rows(knn.exact_knn(v, 6))
    far = knn.pairwise(v, v).withColumn("dist", -V.F.col("dist"))
    poor = knn.ranked(far, 9).withColumn("dist", -V.F.col("dist")).where("q <> 3 and (q <> 4 or rank < 3)")
    for graph_, block in ((poor, 4096), (poor, 25), (knn.exact_knn(v, 6), 25)):
        got = rows(knn.completed(v, graph_, 6, block=block))
        assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
        assert [r[2] for r in got] == pytest.approx([r[2] for r in want])


@pytest.mark.parametrize("query", ["knn_sharded", "nndescent_refine"])
def test_each_point_has_its_neighbours(spark, tmp_path, monkeypatch, query):
    """The points asked have their neighbours and others don't: the query's lists are right all the same."""
    from densegraph.plans import registry

    points(spark, np.random.default_rng(8).normal(size=(400, 16))).write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(knn, "_found", lambda *a: 1.0)
    monkeypatch.setattr(knn, "local_join", lambda sample, *a, **b: sample.sparkSession.createDataFrame([], "q long, nbr long, dist double"))
    got = rows(registry.queries()[query](spark, str(tmp_path)), "q", "listed", "right", "half")
    assert got == [(i, registry.K, True, True) for i in range(400)]


def test_merge_is_exact_after_one_descent(spark, tmp_path, monkeypatch):
    """Points asked never have their neighbours: the descent isn't repeated with longer lists, and the merged lists are whole all the same."""
    from densegraph.plans import registry

    x = np.random.default_rng(9).normal(size=(300, 16))
    v = points(spark, [*x, *[x[0]] * 20]).cache()
    v.write.parquet(str(tmp_path / "embeddings.parquet"))
    descents, join = [], knn.local_join
    monkeypatch.setattr(knn, "_found", lambda *a: 0.0)
    monkeypatch.setattr(knn, "local_join", lambda *a, **b: descents.append(1) or join(*a, **b))
    a, b = v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1")
    poor = knn.exact_knn(b, 8).where("q > 5 and rank % 2 = 0")  # given lists that lack some, or all
    assert rows(knn.merge_knn(a, knn.exact_knn(a, 8), b, poor, 8, exact=True), "q", "nbr", "rank") == rows(knn.exact_knn(v, 8), "q", "nbr", "rank")
    assert len(descents) <= 11
    got = rows(registry.queries()["knn_merge"](spark, str(tmp_path)), "q", "listed", "right", "half")
    assert got == [(i, registry.K, True, True) for i in range(320)] and len(descents) <= 22


def test_join_gives_each_point_its_neighbours(spark, tmp_path, monkeypatch):
    """A descent that finds nothing, points asked that say it found all, many copies: added points and old ones have whole lists."""
    from densegraph.plans import registry

    x = np.random.default_rng(10).normal(size=(300, 16))
    v = points(spark, [*x, *[x[0]] * 50]).cache()
    v.write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(knn, "_found", lambda *a: 1.0)
    monkeypatch.setattr(knn, "local_join", lambda sample, *a, **b: sample.sparkSession.createDataFrame([], "q long, nbr long, dist double"))
    a, b = v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1")
    assert rows(knn.join_knn(a, knn.exact_knn(a, 8), b, 8, exact=True), "q", "nbr", "rank") == rows(knn.exact_knn(v, 8), "q", "nbr", "rank")
    got = rows(registry.queries()["knn_join"](spark, str(tmp_path)), "q", "listed", "right", "half")
    assert got == [(i, registry.K, True, True) for i in range(350)]


def test_files(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "a.fvecs").write_bytes(files.fvecs_bytes(x))
    assert [r[1] for r in rows(files.read_fvecs(spark, str(tmp_path / "a.fvecs")))] == x.tolist()
    (tmp_path / "a.ivecs").write_bytes(files.fvecs_bytes(x.astype(int)))
    assert [r[1] for r in rows(files.read_ivecs(spark, str(tmp_path / "a.ivecs")))] == x.astype(int).tolist()
    (tmp_path / "a.kgraph").write_bytes(files.kgraph_bytes(x, x.astype(int)) + b"\0" * 64)
    got = rows(files.read_kgraph(spark, str(tmp_path / "a.kgraph"), 4))
    assert len(got) == 12 and got[0] == (0, 0, 0.0, 1)
    (tmp_path / "d").write_bytes(files.distances_bytes(x.ravel()))
    assert [r[1] for r in rows(files.read_distances(spark, str(tmp_path / "d")))] == x.ravel().tolist()
    files.write_text_vectors(points(spark, x), str(tmp_path / "t"))
    assert [r[1] for r in rows(files.read_text_vectors(spark, str(tmp_path / "t/part*")))] == x.tolist()


def test_files_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BLOCK_ROWS", 3)
    x = np.random.default_rng(0).normal(size=(10, 4)).astype(np.float32)
    path, v = str(tmp_path / "v.fvecs"), points(spark, x)
    assert files.write_fvecs(v.repartition(3), path) == 10 and open(path, "rb").read() == files.fvecs_bytes(x)
    assert [r[1] for r in rows(files.read_fvecs_slice(spark, path, 2, 9))] == x[2:9].tolist()
    assert [r[0] for r in rows(files.read_fvecs_slice(spark, path))] == list(range(10)) and files.rows_in(path, "fvecs") == (10, 4)
    assert files.write_fvecs(v, path, first=10) == 10 and open(path, "rb").read() == files.fvecs_bytes(x) * 2
    g = knn.exact_knn(v, 3)
    assert files.write_kgraph(g, str(tmp_path / "g")) == 10
    got = rows(files.read_kgraph_slice(spark, str(tmp_path / "g"), 4, 6), "q", "nbr", "rank")
    assert got == [r for r in rows(g, "q", "nbr", "rank") if r[0] in (4, 5)]
    flags = graph.mutual_flags(g)
    assert files.write_mutual(g, flags, str(tmp_path / "m")) == 10
    want = {(r["q"], r["rank"]): r["mutual"] for r in g.join(flags, ["q", "nbr"]).collect()}
    assert {(r["vec_id"], i + 1): f for r in files.read_ivecs(spark, str(tmp_path / "m")).collect() for i, f in enumerate(r["ids"])} == want
    files.write_text_vectors(v, str(tmp_path / "t"))
    assert files.prepare(spark, str(tmp_path / "t/part*"), str(tmp_path / "p")) == 10 and rows(files.read_fvecs_slice(spark, str(tmp_path / "p"), 9)) == [(9, x[9].tolist())]
    with pytest.raises(ValueError):
        files.write_fvecs(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>"), path)
    assert graph.largest_list(g).first()[0] == 3
    degree = spark.createDataFrame([(0, 1), (1, 2), (2, 2), (3, 5)], "id long, in_degree long")
    assert rows(graph.boundary_ties(degree, 2)) == [(1, 2), (2, 2)] and rows(graph.boundary_ties(degree, 4)) == [(3, 5)]


def test_weights_lines_and_runs(spark):
    lines = spark.createDataFrame([("2\t0.5\t1\t0.7\t3",)], "line string")
    assert files.without_marks(lines).first()[0] == "2\t1\t0.7"
    runs = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "config string, seconds double")
    assert rows(evaluate.averaged(runs, ["config"])) == [("a", 2.0, 2), ("b", 5.0, 1)]
    g = spark.createDataFrame([(0, 1, 0.004, 1), (1, 0, 0.004, 1)], knn.KNN)
    digits = graph.weight_digits(g)
    assert digits == 5 and graph.quantised_graph(spark.createDataFrame([(0, 1, 0.004)], mst.EDGE), digits).first()["weight_q"] == 400
    assert spark.range(1).select(V.dequantised(V.F.lit(400), digits)).first()[0] == pytest.approx(0.004)
    assert V.shards_for_memory(10**9, 24.0, 3) == 3 and V.shards_for_memory(10**9, 6.0, 3) == 9


def test_sql_functions_and_validation(spark):
    V.register(spark)
    assert spark.sql("SELECT l2(array(0D, 3D), array(4D, 0D)), l2_sq(array(1D), array(3D))").first()[:] == (5.0, 4.0)
    with pytest.raises(ValueError):
        V.validated(spark.createDataFrame([(1, [1.0]), (1, [2.0, 3.0])], "vec_id long, embedding array<double>"))
    assert V.shard_sizes(10, 3) == [3, 3, 4] and V.shards_for(10, 3, 4) == 3 and V.shards_for(100, 3, 4) == 25


def test_every_oracle_has_a_query():
    from densegraph.plans.registry import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())


def test_condensed_tree_splits(spark):
    """Clusters of a split tree by hand: both sides large, then one small."""
    rows = [(8, 9, 0.5, 4), (8, 10, 0.5, 4), (9, 0, 1.0, 1), (9, 1, 1.0, 1), (9, 2, 2.0, 1), (9, 3, 2.0, 1), (10, 4, 1.0, 1), (10, 5, 1.0, 1), (10, 6, 4.0, 1), (10, 7, 4.0, 1)]
    c = spark.createDataFrame(rows, hierarchy.CONDENSED)
    assert dict(rows_of := rows_sorted(hierarchy.stability(c))) == {8: 4.0, 9: 4.0, 10: 8.0} and len(rows_of) == 3
    assert hierarchy.selected(c, hierarchy.stability(c)) == [9, 10]
    assert hierarchy.tree_extrema(c).first()[:] == (10, 10, 8, 4.0)


def rows_sorted(df):
    return sorted(map(tuple, df.collect()))


def test_vectors_to_labels(spark):
    v = files.generated(spark, 350).cache()
    out = clustering.cluster(v, k=40, mpts=8, exact=True, min_cluster_size=16)
    joined = out.labels.join(v.select(V.F.col("vec_id").alias("id"), "truth"), "id")
    assert out.labels.count() == 350 and evaluate.adjusted_rand(joined.where("label >= 0"), "label", "truth").first()[0] > 0.9
    offsets = graph.csr_offsets(out.core_sg).orderBy("id").collect()
    assert offsets[0]["start"] == 0 and sum(r["degree"] for r in offsets) == 2 * out.core_sg.count()
    assert rows(clustering.reweighted_labels(out, 8, min_cluster_size=16)) == rows(out.labels)


def test_sql_steps():
    from densegraph.plans.registry import written

    assert written("SELECT 1") == "SELECT 1"
    sql = written("SELECT * FROM mst")
    assert "prim AS (" in sql and "mst AS MATERIALIZED" in sql and "sg0" not in sql
