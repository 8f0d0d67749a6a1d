import uuid

import numpy as np
import pyarrow as pa
import pytest
from conftest import plan
from pyspark.sql import functions as F

from nearfield.functions import predicates as p
from nearfield.functions.encode import Bm25Encoder, HashingEncoder, ModelEncoder, query_weights
from nearfield.operators import search, topk


def brute(vectors, query, distance, k, keep=lambda i: True, threshold=None):
    hits = []
    for i, v in enumerate(vectors):
        if not keep(i):
            continue
        if distance == "Cosine":
            length = np.linalg.norm(v) * np.linalg.norm(query)
            score = None if length == 0 else round(v @ query / length, 6) + 0.0
        else:
            score = round(v @ query if distance == "Dot" else np.linalg.norm(v - query), 6) + 0.0
        sign = 1 if distance == "Euclid" else -1
        if threshold is not None and (score is None or sign * score > sign * threshold):
            continue
        hits.append((np.inf if score is None else sign * score, i, score))
    return [(i, s) for _, i, s in sorted(hits)[:k]]


def found(results):
    rows = sorted(results.collect(), key=lambda r: (r.query_id, r["rank"]))
    out = {}
    for r in rows:
        hits = out.setdefault(r.query_id, [])
        assert r["rank"] == len(hits) + 1
        hits.append((r.id, None if r.score is None else pytest.approx(r.score, abs=1e-9)))
    return out


@pytest.mark.parametrize("distance", ["Cosine", "Dot", "Euclid"])
@pytest.mark.parametrize("parts", [1, 7])
def test_equals_brute_force(points, vectors, distance, parts):
    queries = points.select(F.col("id").alias("query_id"), "dense")
    got = found(search.dense_search(points.repartition(parts), queries, 40, distance))
    for i, v in enumerate(vectors):
        assert got[i] == brute(vectors, v, distance, 40)


@pytest.mark.parametrize("distance", ["Cosine", "Euclid"])
def test_many_queries_pass_in_blocks(points, vectors, distance, monkeypatch):
    monkeypatch.setattr(topk, "MAX_SHIPPED_QUERIES", 7)
    monkeypatch.setattr(topk, "FLOOR_POINTS", 25)
    queries = points.select(
        F.col("id").alias("query_id"), "dense", F.when(F.col("id") % 2 == 0, F.lit("a")).alias("label")
    )
    results = search.dense_search(points, queries, 4, distance)
    # Blocks of hits come from storage; no point is shuffled to meet them.
    assert "CoGroup" not in plan(results)
    got = found(results)
    labelled = {r.id: r.label for r in points.collect()}
    for i, v in enumerate(vectors):
        keep = (lambda j: labelled[j] == "a") if i % 2 == 0 else (lambda j: True)
        assert got[i] == brute(vectors, v, distance, 4, keep)


def test_options_per_query(spark, points, vectors):
    rows = [(0, vectors[4].tolist(), "a", 0.3, 2), (1, vectors[4].tolist(), None, None, 9), (2, vectors[9].tolist(), "b", None, None)]
    queries = spark.createDataFrame(rows, "query_id bigint, dense array<double>, label string, threshold double, k int")
    got = found(search.dense_search(points, queries, 3))
    labelled = {r.id: r.label for r in points.collect()}
    assert got[0] == brute(vectors, vectors[4], "Cosine", 2, lambda i: labelled[i] == "a", 0.3)
    assert got[1] == brute(vectors, vectors[4], "Cosine", 9)
    assert got[2] == brute(vectors, vectors[9], "Cosine", 3, lambda i: labelled[i] == "b")


def test_threshold_is_an_upper_bound_for_euclid(spark, points, vectors):
    queries = spark.createDataFrame([(0, vectors[3].tolist(), 3.5)], "query_id bigint, dense array<double>, threshold double")
    got = found(search.dense_search(points, queries, 50, "Euclid"))
    want = brute(vectors, vectors[3], "Euclid", 50, threshold=3.5)
    assert 1 < len(want) < 40
    assert got[0] == want


def test_ties_go_to_the_smaller_id_and_negative_scores_stay(points, spark, vectors):
    queries = spark.createDataFrame([(0, vectors[4].tolist())], "query_id bigint, dense array<double>")
    got = found(search.dense_search(points, queries, 40))[0]
    assert [i for i, _ in got[:3]] == [4, 5, 6]
    assert got[-2] == (7, -1.0)
    assert got[-1] == (8, None)


def test_result_shape(points, spark, vectors):
    queries = spark.createDataFrame([(0, vectors[10].tolist())], "query_id bigint, dense array<double>")
    rows = {r.id: r for r in search.dense_search(points, queries, 40).collect()}
    assert (rows[10].label, rows[10].text) == ("unknown", "text 10")
    assert rows[11].label == "a"


def test_other_sizes_and_missing_vectors_are_no_candidates(spark):
    points = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0]), (2, None), (3, [0.0, 1.0])], "id bigint, dense array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, dense array<double>")
    assert [i for i, _ in found(search.dense_search(points, queries))[0]] == [0, 3]
    odd = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "query_id bigint, dense array<double>")
    with pytest.raises(ValueError, match="differ in size"):
        search.dense_search(points, odd)


def test_no_queries(spark, points):
    queries = points.select(F.col("id").alias("query_id"), "dense").filter("id < 0")
    assert search.dense_search(points, queries).count() == 0


def test_filter_reaches_the_scan_and_only_needed_columns_are_read(spark):
    from conftest import SF

    points = spark.read.parquet(f"{SF}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("dense"), "label"
    )
    queries = points.limit(3).select(F.col("id").alias("query_id"), "dense")
    text = plan(search.dense_search(points, queries, condition=F.col("label") == 3))
    assert "EqualTo(label,3)" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "WindowGroupLimit" in text


def texts(spark):
    rows = [(0, "red apple pie"), (1, "green apple"), (2, "blue sky blue sea"), (3, ""), (4, "Red, RED apple!")]
    return spark.createDataFrame(rows, "id bigint, text string")


def test_hashing_encoder(spark):
    rows = HashingEncoder(16).transform(texts(spark), "text").orderBy("id").collect()
    lengths = [np.linalg.norm(r.dense) for r in rows]
    assert lengths == pytest.approx([1, 1, 1, 0, 1], abs=1e-6)
    raw = HashingEncoder(16, normalise=False).transform(texts(spark), "text").orderBy("id").collect()
    assert sum(map(abs, raw[4].dense)) in (1, 3)


def test_model_encoder_loads_per_worker_and_takes_empty_input(spark):
    def load():
        return lambda batch: [[float(len(t)), 1.0] for t in batch]

    encoder = ModelEncoder(load, normalise=False)
    rows = encoder.transform(texts(spark), "text", "my-model").orderBy("id").collect()
    assert [r["my-model"] for r in rows] == [[13.0, 1.0], [11.0, 1.0], [17.0, 1.0], [0.0, 1.0], [15.0, 1.0]]
    assert encoder.transform(texts(spark).filter("id > 9"), "text").count() == 0


def test_bm25_by_hand(spark):
    docs = texts(spark)
    encoded = Bm25Encoder.fit(docs, "text").transform(docs, "text")
    queries = spark.createDataFrame([(0, "red pie"), (1, "apple"), (2, "nothing here")], "query_id bigint, text string")
    got = found(search.sparse_search(encoded, query_weights(queries, encoded)))
    words = [["red", "apple", "pie"], ["green", "apple"], ["blue", "sky", "blue", "sea"], [], ["red", "red", "apple"]]
    mean = sum(map(len, words)) / 5

    def score(query, doc):
        total = 0.0
        for w in query:
            df = sum(w in d for d in words)
            tf = doc.count(w)
            idf = np.log(1 + (5 - df + 0.5) / (df + 0.5))
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
        return total

    for query_id, query in ((0, ["red", "pie"]), (1, ["apple"])):
        scored = [(i, score(query, d)) for i, d in enumerate(words)]
        want = sorted([(i, s) for i, s in scored if s > 0], key=lambda x: (-round(x[1], 5), x[0]))
        assert [i for i, _ in got[query_id]] == [i for i, _ in want]
    assert 2 not in got


def test_hybrid_fuses_two_rankings(spark):
    docs = texts(spark)
    points = HashingEncoder(32).transform(Bm25Encoder.fit(docs, "text").transform(docs, "text"), "text")
    queries = spark.createDataFrame([(0, "red apple")], "query_id bigint, text string")
    queries = HashingEncoder(32).transform(query_weights(queries, points), "text")
    one = found(search.dense_search(points, queries, 4))[0]
    two = found(search.sparse_search(points, queries, 4))[0]
    fused = {}
    for ranking in (one, two):
        for place, (i, _) in enumerate(ranking):
            fused[i] = fused.get(i, 0) + 1 / (2 + place)
    want = sorted(((i, round(s, 6)) for i, s in fused.items()), key=lambda x: (-x[1], x[0]))[:2]
    assert found(search.hybrid_search(points, queries, 2))[0] == want


def test_the_repeated_half_of_a_table_ties_by_id(spark):
    """A third of all rows are one and the same point."""
    rows = [(i, [1.0, 0.0] if i % 3 == 0 else [0.0, float(i)]) for i in range(3000)]
    points = spark.createDataFrame(rows, "id bigint, dense array<double>").repartition(5)
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, dense array<double>")
    assert [i for i, _ in found(search.dense_search(points, queries, 5))[0]] == [0, 3, 6, 9, 12]


def test_a_model_is_loaded_once_in_a_worker_process(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return lambda texts: [[float(len(t))] for t in texts]

    texts = spark.range(400).select(F.col("id").cast("string").alias("text")).repartition(40)
    encoded = ModelEncoder(load, normalise=False).transform(texts, "text")
    assert encoded.where(F.col("dense")[0] != F.length("text")).count() == 0
    loads, cores = len(list(tmp_path.iterdir())), spark.sparkContext.defaultParallelism
    assert 1 <= loads <= 2 * cores


def test_places(spark):
    rows = [(1, '{"lon": 179.5, "lat": 0}'), (2, '{"lon": -179.5, "lat": 0.0}'), (3, '{"lon": 0, "lat": 0}'), (4, "no"), (5, None)]
    points = spark.createDataFrame(rows, "id bigint, place string").withColumn("at", p.place(F.col("place")))
    near = points.filter(p.in_radius(F.col("at"), 179.9, 0, 100_000))
    assert {r.id for r in near.collect()} == {1, 2}
    assert {r.id for r in points.filter(p.in_box(F.col("at"), 179, -1, -179.6, 1)).collect()} == {1}
    assert {r.id for r in points.filter(p.must_not(p.in_box(F.col("at"), -1, -1, 1, 1))).collect()} == {1, 2, 4, 5}


def test_many_queries_move_no_points(spark, points, vectors, monkeypatch):
    """Beyond what is shipped at once: blocks of queries pass over the points, with floors from a sample."""
    monkeypatch.setattr(topk, "MAX_SHIPPED_QUERIES", 16)
    monkeypatch.setattr(topk, "FLOOR_POINTS", 25)
    queries = points.select(F.col("id").alias("query_id"), "dense", (F.col("id") % 4 + 1).alias("k"), F.when(F.col("id") % 2 == 0, "a").alias("label"))
    for distance in ("Cosine", "Euclid", "Dot"):
        hits, _ = topk.topk(points, queries, topk.Branch(distance=distance), 3)
        many = sorted(map(tuple, hits.collect()))
        with monkeypatch.context() as m:
            m.setattr(topk, "MAX_SHIPPED_QUERIES", 4096)
            once, _ = topk.topk(points, queries, topk.Branch(distance=distance), 3)
            assert sorted(map(tuple, once.collect())) == many and many
    blocks = list(topk.query_blocks(queries, 16, "query_id"))
    assert sum(b.num_rows for b in blocks) == 40 and max(b.num_rows for b in blocks) <= 16


def test_sparse_scores_of_common_and_rare_indices(spark):
    """Weights of any sign, indices that all, some or one query has, rows that share none."""
    rng = np.random.default_rng(6)

    def vectors(n, wide):
        rows = [(i, sorted(rng.choice(wide, rng.integers(0, 12), replace=False).tolist()) + ([900] if i % 3 else [])) for i in range(n)]
        return [(i, index, rng.normal(size=len(index)).round(3).tolist()) for i, index in rows]

    data, asked = vectors(80, 60), vectors(150, 400)
    schema = "struct<indices: array<int>, values: array<float>>"
    table = lambda rows, key: spark.createDataFrame([(i, (x, v)) for i, x, v in rows], f"{key} bigint, sparse {schema}")
    found = {}
    for r in search.sparse_search(table(data, "id"), table(asked, "query_id"), 5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    for q, x, v in asked:
        want = dict(zip(x, np.float32(v).astype(float)))
        scored = [(round(sum(want[k] * w for k, w in zip(i, np.float32(ws).astype(float)) if k in want), 6) + 0.0, p) for p, i, ws in data if want.keys() & set(i)]
        best = sorted(scored, key=lambda s: (-s[0], s[1]))[:5]
        assert [(n, p) for n, p, _ in sorted(found.get(q, []))] == [(n, p) for n, (_, p) in enumerate(best, 1)], q


@pytest.mark.parametrize("distance", ["Cosine", "Euclid", "Dot"])
def test_many_queries_take_a_pass_for_each_block_of_points(spark, points, vectors, distance, monkeypatch):
    """As many queries as points: what is written does not grow with the queries' blocks."""
    monkeypatch.setattr(topk, "MAX_SHIPPED_QUERIES", 3)
    monkeypatch.setattr(topk, "MAX_SHIPPED_BYTES", 2000)
    monkeypatch.setattr(topk, "FEED_ROWS", 5)
    monkeypatch.setattr(topk, "PENDING_HITS", 4)
    written, stored = [], topk.stored
    monkeypatch.setattr(topk, "stored", lambda df: written.append(1) or stored(df))
    queries = points.select(F.col("id").alias("query_id"), "dense", F.when(F.col("id") % 2 == 0, 0.1).alias("threshold"))
    got = found(search.dense_search(points, queries, 4, distance))
    # both tables, the blocks of points, and the hits of two or three of these
    assert len(written) <= 6
    if distance != "Euclid":
        for i, v in enumerate(vectors):
            assert got.get(i, []) == brute(vectors, v, distance, 4, **({} if i % 2 else {"threshold": 0.1}))
    short = queries.withColumn("dense", F.slice("dense", 1, F.when(F.col("query_id") == 1, 3).otherwise(8)))
    with pytest.raises(ValueError, match="differ in size"):
        topk.topk(points, short, topk.Branch(distance=distance), 4)


def test_sparse_points_are_scored_a_few_at_a_time(monkeypatch):
    """A batch of very many rows makes no matrix of all of them, however many indices are common."""
    sparse = pa.StructArray.from_arrays([pa.array([[1, 2, 3]] * 5000, pa.list_(pa.int32())), pa.array([[1.0, 2.0, 0.5]] * 5000, pa.list_(pa.float32()))], names=["indices", "values"])
    asked = pa.table({"query_id": [0, 1], "query_sparse": sparse[:2], "query_label": pa.nulls(2, pa.string()), "threshold": pa.nulls(2, pa.float64()), "k": pa.array([3, 2], pa.int32())})
    sizes, gain = [], topk._SparseScorer.gain
    monkeypatch.setattr(topk._SparseScorer, "gain", lambda self, points: sizes.append(len(points)) or gain(self, points))
    running = topk.Search(asked, [topk.Branch("sparse", "Dot")])
    running.feed(pa.table({"id": pa.array(range(5000)), "sparse": sparse}))
    assert sum(sizes) == 5000 and max(sizes) <= 2048
    (hits,) = running.hits()
    assert [(r["query_id"], r["id"], r["gain"]) for r in hits.to_pylist()] == [(0, 0, 5.25), (0, 1, 5.25), (0, 2, 5.25), (1, 0, 5.25), (1, 1, 5.25)]


@pytest.mark.parametrize("size", [3, 16, 64, 200])
def test_packed_scores_miss_no_wanted_pair(size):
    """Four points share a product: every pair that reaches the least score is a candidate, however close."""
    rng = np.random.default_rng(size)
    points, queries = topk._unit(rng.normal(size=(1001, size))), topk._unit(rng.normal(size=(1500, size)))
    # the same, opposite, near and lopsided vectors, and whole numbers' halves
    points[5], points[300], points[600] = queries[7], -queries[8], queries[9]
    points[700:750] = topk._unit(queries[700:750] + rng.normal(size=(50, size)) * 0.1)
    points[10] = queries[10] = np.eye(size)[0]
    points[900:950] = topk._unit((rng.integers(-9, 9, size=(50, size)) + 0.5) / topk.WHOLE_LENGTH)
    score = queries @ points.T
    # some queries want just what one of their points has, up to the last place
    least = np.where(np.arange(1500) % 3 == 0, 0.3, np.clip(np.sort(score, axis=1)[:, -5], 0.3, None))
    packed = topk._Packed(topk._Whole(queries), points, least)
    assert packed.tells
    room, found = np.empty(topk.TILE * topk.TILE // 2), set()
    for first in range(0, 1500, topk.TILE):
        rows, asked = packed.candidates(first, room)
        assert rows.max() < 1001 and asked.max() < 1500
        found |= set(zip(asked.tolist(), rows.tolist()))
    wanted = set(zip(*map(np.ndarray.tolist, np.nonzero(score >= least[:, None]))))
    assert (7, 5) in wanted and (9, 600) in wanted
    assert wanted <= found
    if size == 64:
        assert len(found) < 1500 * 1001 / 20


def test_packed_scores_do_not_tell_where_they_cannot():
    vectors = topk._unit(np.random.default_rng(1).normal(size=(8, 16)))
    for points, least in ((vectors, 0.05), (vectors, -np.inf), (2 * vectors, 0.5), (0 * vectors, 0.5)):
        assert not topk._Packed(topk._Whole(vectors), points, np.full(8, least)).tells


@pytest.mark.parametrize("tile", [20, 64])
@pytest.mark.parametrize("telling", [0, 1, 10**9])
def test_tiles_of_queries_and_points_equal_brute_force(tile, telling, monkeypatch):
    """Copies, opposites, null and zero vectors, other sizes, nulls in a vector: by digits or by single precision."""
    monkeypatch.setattr(topk, "TILE", tile)
    monkeypatch.setattr(topk, "TELLING", telling)
    monkeypatch.setattr(topk, "FEED_ROWS", 100)
    monkeypatch.setattr(topk, "PENDING_HITS", 50)
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(700, 6)).round(2)
    vectors[100:160] = vectors[40:100]
    vectors[200:230] = -vectors[:30]
    vectors[[3, 77, 300, 699]] = 0
    lists = [v.tolist() for v in vectors]
    for i in (20, 330):
        lists[i] = None
    lists[21] = [1.0, 2.0]
    labels = ["ab"[i % 2] for i in range(700)]
    held = pa.table({"id": range(700), "dense": pa.array(lists, pa.list_(pa.float64())), "label": labels})
    queries = [i for i in range(150) if lists[i] and len(lists[i]) == 6]
    depth = [i % 7 for i in queries]
    label = ["a" if i % 5 == 0 else None for i in queries]
    asked = pa.table({
        "query_id": queries, "query_dense": [lists[i] for i in queries], "query_label": pa.array(label, pa.string()),
        "threshold": pa.array([0.9 if i % 4 == 0 else None for i in queries], pa.float64()), "k": pa.array(depth, pa.int32()),
    })
    running = topk.Search(asked, [topk.Branch()])
    running.feed(held)
    (hits,) = running.hits()
    got = {}
    for r in hits.to_pylist():
        got.setdefault(r["query_id"], []).append((r["id"], r["gain"]))
    for i, k, wanted in zip(queries, depth, label):
        keep = lambda j: lists[j] is not None and len(lists[j]) == 6 and wanted in (None, labels[j])  # noqa: B023, E731
        # An undefined score is below every threshold.
        best = brute(vectors, vectors[i], "Cosine", k, keep, 0.9 if i % 4 == 0 else None)
        assert [(j, s if s is None else pytest.approx(s, abs=1e-9)) for j, s in best] == got.get(i, []), i


def test_blocks_of_points_make_one_pass_together(spark, points, vectors, monkeypatch):
    """As many blocks as are fetched from the driver's side at a time are shared by the tasks of one pass."""
    monkeypatch.setattr(topk, "MAX_SHIPPED_QUERIES", 3)
    monkeypatch.setattr(topk, "MAX_SHIPPED_BYTES", 500)
    passes, met = [], topk._met_by_block
    monkeypatch.setattr(topk, "_met_by_block", lambda *given: passes.append(1) or met(*given))
    queries = points.select(F.col("id").alias("query_id"), "dense")
    got = found(search.dense_search(points, queries, 4))
    assert len(passes) == 1
    for i, v in enumerate(vectors):
        assert got[i] == brute(vectors, v, "Cosine", 4)
    blocks = [pa.table({"id": range(i)}) for i in (3, 4, 5, 100, 1)]
    assert [b.num_rows for b in topk._joined(iter(blocks), 100)] == [12, 100, 1]
