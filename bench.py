"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``stages`` times each step over $BENCH_POINTS generated vectors from inputs already written (0 leaves that out).
"""

import json
import os
import time

from densegraph.operators import graph, hierarchy, knn, mst
from densegraph.plans import clustering, tables
from densegraph.plans.registry import queries
from densegraph.plans.session import session
from densegraph.sources import files

NAMES = ["knn_exact", "in_degree", "antihubs", "enhanced_graph", "edge_sort", "mst_kruskal", "core_sg_edges", "single_linkage", "condensed_tree", "cluster_labels", "nndescent"]


def stages(spark, n: int, k: int = 16) -> dict[str, float]:
    """Seconds of each step from neighbours to the condensed tree; what a step needs is written before."""
    took = {}

    def timed(name, make):
        began = time.time()
        out = tables.settled(make())
        took[name] = round(time.time() - began, 3)
        return out

    v = tables.settled(files.generated(spark, n).select("vec_id", "embedding"))
    near = timed("nndescent", lambda: knn.nndescent(v, k))
    timed("in_degree", lambda: graph.in_degree(near))
    edges = timed("enhanced_graph", lambda: graph.enhanced_graph(v, near, k)).select("src", "dst", "weight")
    timed("edge_sort", lambda: edges.orderBy("weight", "src", "dst"))
    tree = timed("kruskal", lambda: mst.kruskal(edges))
    timed("boruvka", lambda: mst.boruvka(edges))
    joined = tables.settled(clustering.connected(tree, n))
    link = timed("single_linkage", lambda: hierarchy.single_linkage(joined))
    timed("condensed_tree", lambda: hierarchy.condensed_tree(link, k))
    return took


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    every, took = queries(), {}
    every["header_metadata"](spark, folder).collect()
    for name in NAMES:
        began = time.time()
        every[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    points = int(os.environ.get("BENCH_POINTS", "20000"))
    scale = stages(spark, points) if points else {}
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "points": points, "stages": scale}))
    tables.clear(spark)


if __name__ == "__main__":
    main()
