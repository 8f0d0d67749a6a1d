"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import distance as dist
from nearfield.functions import predicates as p
from nearfield.functions.encode import Bm25Encoder, HashingEncoder, ModelEncoder, SparseModelEncoder, query_weights
from nearfield.functions.text import clean_text, tokens
from nearfield.functions.text import lookup as lookup_value
from nearfield.operators import analytics, lookup, mutate, neighbours, pairs, recommend, report, search, validate
from nearfield.plans import tables as t
from nearfield.plans.ingest import ingest
from nearfield.schema import Scenario
from nearfield.session import broadcast_if_small, shared_dir
from nearfield.sources import changes
from nearfield.sources import collection as c
from nearfield.sources import parquet as src
from nearfield.streaming import ingest as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The default examples of a recommendation.
POSITIVE_IDS = [1, 2, 3, 5, 8, 13, 21]
NEGATIVE_IDS = [10, 15, 20, 25]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _hits(results: DataFrame) -> DataFrame:
    """Hits of points that have no text."""
    return results.drop("text")


def _elements(rows: DataFrame, vector: str = "dense") -> DataFrame:
    """A vector column as (id, i, x) rows."""
    # the outer form: the plain one adds a filter on the vector, which would be made twice
    return rows.select("id", F.posexplode_outer(vector).alias("i", "x")).select(
        "id", "i", (F.round(F.col("x").cast("double"), 6) + 0.0).alias("x")
    )


def _entries(points: DataFrame) -> DataFrame:
    """A payload column as (id, key, value) rows."""
    return points.select("id", F.explode("payload").alias("key", "value"))


# -- similarity search ------------------------------------------------------------


@query
def dense_topk_cosine(spark, sf):
    return _hits(search.dense_search(t.embeddings(spark, sf), t.centroids(spark, sf)))


@query
def dense_topk_dot(spark, sf):
    return _hits(search.dense_search(t.embeddings(spark, sf), t.centroids(spark, sf), distance="Dot"))


@query
def dense_topk_euclid(spark, sf):
    return _hits(search.dense_search(t.embeddings(spark, sf), t.centroids(spark, sf), distance="Euclid"))


@query
def dense_topk_filtered(spark, sf):
    queries = t.centroids(spark, sf).withColumn("label", F.col("query_id").cast("string"))
    return _hits(search.dense_search(t.embeddings(spark, sf), queries))


@query
def dense_topk_condition(spark, sf):
    points = t.embeddings(spark, sf)
    wanted = p.should(p.match_any(p.field(points, "label"), ["1", "3", "5"]), p.in_range(F.col("id"), lt=100))
    return _hits(search.dense_search(points, t.centroids(spark, sf), condition=wanted))


@query
def dense_topk_threshold(spark, sf):
    queries = t.centroids(spark, sf).withColumn("threshold", F.lit(0.2))
    return _hits(search.dense_search(t.embeddings(spark, sf), queries, 1000))


@query
def dense_topk_batch(spark, sf):
    points = t.embeddings(spark, sf)
    queries = points.select(F.col("id").alias("query_id"), "dense")
    return _hits(search.dense_search(points, queries, 5))


@query
def dense_topk_many(spark, sf):
    """More queries than tasks are sent at once: every point in ten turns of its elements."""
    points = t.embeddings(spark, sf)
    turned = points.select("id", "dense", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("turn"))
    dense = F.expr("concat(slice(dense, turn + 1, 64), slice(dense, 1, turn))")
    queries = turned.select((F.col("id") * 10 + F.col("turn")).alias("query_id"), dense.alias("dense"))
    return _hits(search.dense_search(points, queries, 5))


@query
def distances(spark, sf):
    """All distances of every point to the centroid of its label."""
    centre = t.centroids(spark, sf).select(
        F.col("query_id").cast("string").alias("label"), F.col("dense").alias("centre")
    )
    rows = t.embeddings(spark, sf).join(broadcast_if_small(centre), "label")
    return rows.select(
        "id", *[dist.score(F.col("dense"), F.col("centre"), d).alias(d.lower()) for d in dist.DISTANCES]
    )


@query
def text_search_dense(spark, sf):
    return search.dense_search(t.dense_documents(spark, sf), t.dense_queries(spark, sf))


def _options(spark, sf) -> DataFrame:
    """Benchmark texts with a label, threshold and limit each, some of them not valid."""
    item = F.col("query_id")
    return t.text_queries(spark, sf).select(
        "query_id",
        F.when(item % 7 == 3, "   ").otherwise(F.concat(F.lit("  "), "text")).alias("text"),
        F.when(item % 3 == 0, " EN ").when(item % 3 == 1, "fr").alias("label"),
        ((item % 12) / 10.0).alias("threshold"),
        (item % 6).cast("int").alias("k"),
    )


@query
def search_with_options(spark, sf):
    valid = validate.valid(validate.check_queries(_options(spark, sf)))
    return search.dense_search(t.dense_documents(spark, sf), HashingEncoder().transform(valid, "text"))


@query
def query_validation(spark, sf):
    return validate.check_queries(_options(spark, sf))


@query
def sparse_topk_bm25(spark, sf):
    points = t.encoded_documents(spark, sf, dense=False)
    queries = query_weights(t.text_queries(spark, sf), points)
    return search.sparse_search(points, queries, payload=t.documents(spark, sf))


@query
def hybrid_rrf(spark, sf):
    points = t.encoded_documents(spark, sf)
    queries = HashingEncoder().transform(query_weights(t.text_queries(spark, sf), points), "text")
    return search.hybrid_search(points, queries, payload=t.documents(spark, sf))


@query
def hybrid_rrf_filtered(spark, sf):
    points = t.encoded_documents(spark, sf)
    languages = F.array(*map(F.lit, ["en", "fr", "de", "es"]))
    language = F.element_at(languages, (F.col("query_id") % 4 + 1).cast("int"))
    queries = HashingEncoder().transform(query_weights(t.text_queries(spark, sf), points), "text")
    queries = queries.withColumn("label", language)
    return search.hybrid_search(points, queries, payload=t.documents(spark, sf))


# -- recommendation ---------------------------------------------------------------


def _default_examples(points: DataFrame, negative: bool = True) -> DataFrame:
    """The default request, of which only ids that are points count."""
    ids = POSITIVE_IDS + (NEGATIVE_IDS if negative else [])
    return lookup.by_ids(points, ids, False).select(
        F.lit(0).cast("bigint").alias("query_id"), "id", F.col("id").isin(POSITIVE_IDS).alias("positive")
    )


@query
def recommend_ids(spark, sf):
    points = t.embeddings(spark, sf)
    return _hits(recommend.recommend(points, _default_examples(points)))


@query
def recommend_ids_positive_only(spark, sf):
    points = t.embeddings(spark, sf)
    return _hits(recommend.recommend(points, _default_examples(points, negative=False)))


@query
def recommend_filtered(spark, sf):
    points = t.embeddings(spark, sf)
    options = spark.range(1).select(
        F.col("id").alias("query_id"), F.lit("3").alias("label"), F.lit(0.01).alias("threshold")
    )
    return _hits(recommend.recommend(points, _default_examples(points), options=options))


@query
def recommend_by_quality(spark, sf):
    """One request per label of the points; examples are the rated documents."""
    rated = t.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality"), F.col("toxic")
    )
    points = t.embeddings(spark, sf)
    examples = points.join(rated, "id").select(
        F.col("label").cast("bigint").alias("query_id"),
        "id",
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("positive"),
    )
    return _hits(recommend.recommend(points, examples))


@query
def recommend_by_label(spark, sf):
    points = t.embeddings(spark, sf)
    label = F.col("label").cast("bigint")
    requests = points.select(
        label.alias("query_id"),
        F.col("label").alias("positive_label"),
        ((label + 1) % 10).cast("string").alias("negative_label"),
    ).distinct()
    return _hits(recommend.recommend_by_label(points, requests))


@query
def label_request_reasons(spark, sf):
    """Requests by label, some of labels that no point has: which can be answered, and why not."""
    points = t.embeddings(spark, sf)
    requests = points.select(
        F.col("id").alias("query_id"),
        F.when(F.col("id") % 7 == 0, F.concat(F.lit("x"), "label")).otherwise(F.col("label")).alias("positive_label"),
        F.when(F.col("id") % 3 == 0, F.lit("none")).when(F.col("id") % 3 == 1, "1").alias("negative_label"),
    )
    return recommend.label_reasons(points, requests).select("query_id", "reason")


# -- approximate search -----------------------------------------------------------

APPROX_BITS, APPROX_PROBES = 6, 46


@query
def approx_topk(spark, sf):
    """Every twentieth point against all, in a collection laid out by code; only probed cells are read."""
    name = _fresh_name("coded")
    points = t.embeddings(spark, sf)
    c.create_collection(spark, name, 64, code_bits=APPROX_BITS, external=True)
    c.add_points(spark, name, points)
    queries = points.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "dense")
    return _hits(neighbours.approximate_search(c.open_collection(spark, name), queries, APPROX_BITS, APPROX_PROBES))


# -- similar pairs ----------------------------------------------------------------


@query
def similar_pairs(spark, sf):
    return pairs.most_similar_pairs(t.embeddings(spark, sf), 50)


@query
def similar_document_pairs(spark, sf):
    return pairs.most_similar_pairs(t.dense_documents(spark, sf), 50)


@query
def approx_similar_pairs(spark, sf):
    return pairs.approximate_similar_pairs(t.embeddings(spark, sf), 50, bits=7, bands=64)


# -- encoders and text ------------------------------------------------------------


@query
def dense_encode_hash(spark, sf):
    return _elements(t.dense_documents(spark, sf))


@query
def dense_encode_raw(spark, sf):
    encoder = HashingEncoder(dim=32, normalise=False)
    rows = t.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    return _elements(encoder.transform(src.spread(rows), "text"))


@query
def l2_normalise(spark, sf):
    scaled = F.transform("dense", lambda x: x.cast("double") * (F.col("id") % 5))
    points = t.embeddings(spark, sf).withColumn("dense", scaled)
    return _elements(points.withColumn("dense", dist.l2_normalise(F.col("dense"))))


@query
def sparse_encode(spark, sf):
    texts = src.spread(t.documents(spark, sf))
    encoded = Bm25Encoder.fit(texts, "text").transform(texts, "text")
    weights = F.explode_outer(F.arrays_zip("sparse.indices", "sparse.values")).alias("e")
    rows = encoded.select("id", weights).filter("e is not null")
    return rows.select(
        "id", F.col("e.indices").alias("word"), F.round(F.col("e.values").cast("double"), 6).alias("weight")
    )


@query
def text_clean(spark, sf):
    return src.spread(t.documents(spark, sf)).select("id", clean_text(F.col("text")).alias("clean"))


@query
def text_clean_stopwords(spark, sf):
    words = tokens(F.col("text"), drop_stop_words=True)
    rows = src.spread(t.documents(spark, sf)).select("id", words.alias("words"))
    return rows.select("id", F.size("words").alias("words_left"), F.array_join("words", " ").alias("clean"))


def _letter_model():
    """Stands for a user's model: code points, letters e and spaces of each text."""
    return lambda texts: [[len(x), x.count("e"), x.count(" ")] for x in texts]


@query
def user_model_encode(spark, sf):
    encoder = ModelEncoder(_letter_model, normalise=False)
    return _elements(encoder.transform(src.spread(t.documents(spark, sf)), "text", "letters"), "letters")


def _vowel_model():
    """A stand-in for a user's sparse model: how often each vowel occurs, at its place in the alphabet."""
    return lambda texts: [([ord(v) - 97 for v in "aeiou"], [t.count(v) for v in "aeiou"]) for t in texts]


@query
def user_sparse_encode(spark, sf):
    encoder = SparseModelEncoder(_vowel_model, batch_rows=64)
    points = encoder.transform(src.spread(t.documents(spark, sf)), "text")
    return points.select("id", F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("w")).select(
        "id", F.col("w.indices").alias("index"), F.col("w.values").cast("double").alias("weight")
    )


# -- sources ----------------------------------------------------------------------


@query
def scenario_projection(spark, sf):
    mapped = src.map_columns(t.table(spark, sf, "documents"), t.DOCUMENTS, keep=["doc_id"])
    return mapped.select(
        "doc_id", "text", "label", F.col("metadata")["source"].alias("source"),
        F.col("metadata")["n_chars"].alias("n_chars"),
    )


@query
def payload_assembly(spark, sf):
    """Payloads of the documents with their quality, which many do not have."""
    rated = t.table(spark, sf, "documents").join(t.table(spark, sf, "labels"), "doc_id", "left")
    scenario = Scenario("rated", "text", "rated", "quality", ("lang", "toxic"))
    mapped = src.map_columns(rated, scenario, keep=["doc_id"])
    return _entries(mapped.select(F.col("doc_id").alias("id"), src.payload().alias("payload")))


def _records(spark, sf) -> DataFrame:
    """Rated documents, whole texts under another name, and a blank record beside each."""
    rated = t.table(spark, sf, "documents").join(t.table(spark, sf, "labels"), "doc_id", "left")
    blank = rated.withColumn("doc_id", F.col("doc_id") + 1_000_000).withColumn("text", F.lit(" \n "))
    rated = rated.unionByName(blank)
    label = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("  "), F.upper("source"))).otherwise(
        F.col("quality").cast("string")
    )
    return rated.select("doc_id", F.col("text").alias("sentence"), label.alias("label"))


@query
def validated_records(spark, sf):
    return src.validated_records(_records(spark, sf))


@query
def record_validity_counts(spark, sf):
    checked = src.checked_records(_records(spark, sf))
    return checked.agg(
        F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid")
    )


@query
def row_ids(spark, sf):
    numbered = src.with_row_ids(t.table(spark, sf, "documents"), start_id=100)
    return numbered.select("id", "doc_id")


@query
def point_validation(spark, sf):
    """Vectors of the positive elements, of many sizes, and ids shifted below zero."""
    points = t.embeddings(spark, sf).select(
        (F.col("id") - 10).alias("id"),
        F.filter("dense", lambda x: x > F.col("label").cast("int") * 0.04).alias("dense"),
    )
    checked = validate.check_points(points, dim=20)
    return checked.select("id", F.size("dense").alias("size"), "reason")


@query
def search_gaps(spark, sf):
    """Points that lost their id, their vector or a part of it, and would be missing from results without a word."""
    points = t.embeddings(spark, sf).select(
        F.when(F.col("id") % 50 != 0, F.col("id")).alias("id"),
        F.when(F.col("id") % 11 == 0, F.slice("dense", 1, 20)).when(F.col("id") % 7 != 0, F.col("dense")).alias("dense"),
    )
    return analytics.search_gaps(points, 64)


@query
def row_counts(spark, sf):
    return analytics.row_count(t.table(spark, sf, "documents"))


# -- points by id, filter and page ------------------------------------------------


@query
def points_by_ids(spark, sf):
    good = t.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return lookup.by_ids(t.documents(spark, sf), good)


@query
def point_by_id(spark, sf):
    return lookup.by_id(t.documents(spark, sf), 42)


@query
def points_with_vectors(spark, sf):
    rated = t.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    found = lookup.by_ids(t.embeddings(spark, sf), rated, with_payload=False, with_vectors=True)
    return _elements(found)


@query
def general_filter(spark, sf):
    points = t.payload_points(spark, sf)
    condition = p.must(
        p.should(p.match(p.field(points, "lang"), "en"), p.match_any(p.field(points, "lang"), ["de", "es"])),
        p.in_range(p.number(p.field(points, "n_chars")), gte=500, lt=5000),
        p.must_not(p.match(p.field(points, "source"), "src1"), p.match(p.field(points, "label"), "0")),
    )
    return points.filter(condition).select("id", "label")


@query
def geo_filter(spark, sf):
    """Points at places made from their ids: within 3,000 km of one, or about the date line."""
    place = F.to_json(F.struct((F.col("id") * 37 % 360 - 180).alias("lon"), (F.col("id") * 17 % 180 - 90).alias("lat")))
    points = t.embeddings(spark, sf).withColumn("payload", F.create_map(F.lit("where"), place))
    where = p.place(p.field(points, "where"))
    wanted = p.should(p.in_radius(where, 10, 50, 3_000_000), p.in_box(where, 160, -30, -160, 30))
    return points.filter(wanted).select("id", "label")


@query
def scroll_page(spark, sf):
    return lookup.scroll(t.documents(spark, sf), offset=50)


@query
def scroll_filtered(spark, sf):
    english = p.match(F.col("label"), "en")
    return lookup.scroll(t.documents(spark, sf), offset=20, condition=english)


@query
def scroll_pages(spark, sf):
    pages = lookup.scroll_all(t.documents(spark, sf))
    return pages.select("id", "page")


@query
def scroll_pages_filtered(spark, sf):
    pages = lookup.scroll_all(t.documents(spark, sf), condition=p.match(F.col("label"), "en"))
    return pages.select("id", "page")


# -- statistics and reports -------------------------------------------------------


@query
def label_distribution(spark, sf):
    return analytics.label_distribution(t.payload_points(spark, sf))


@query
def collection_stats(spark, sf):
    return analytics.collection_stats(t.embeddings(spark, sf))


@query
def result_stats(spark, sf):
    return analytics.result_stats(dense_topk_cosine(spark, sf))


@query
def result_labels(spark, sf):
    return analytics.result_labels(dense_topk_cosine(spark, sf))


@query
def result_report(spark, sf):
    return report.result_report(text_search_dense(spark, sf))


# -- changes ----------------------------------------------------------------------


@query
def upsert_points(spark, sf):
    """Even labels are replaced, one id in three twice, and as many new ids come in."""
    base = t.embeddings(spark, sf)
    even = base.filter(F.col("label").cast("int") % 2 == 0)
    change = even.select("id", F.reverse("dense").alias("dense"), F.lit("first").alias("label"), F.lit(1).alias("seq"))
    again = even.filter("id % 3 = 0").select("id", "dense", F.lit("second").alias("label"), F.lit(2).alias("seq"))
    fresh = even.select((F.col("id") + 1_000_000).alias("id"), "dense", F.lit("new").alias("label"), F.lit(3).alias("seq"))
    new = change.unionByName(again).unionByName(fresh)
    return _elements_with_label(mutate.upsert(base, new, "seq"))


def _elements_with_label(points: DataFrame) -> DataFrame:
    rows = points.select("id", "label", F.posexplode("dense").alias("i", "x"))
    return rows.select("id", "label", "i", (F.round(F.col("x").cast("double"), 6) + 0.0).alias("x"))


@query
def collection_changes(spark, sf):
    """A saved collection after an upsert, a payload merge and a delete, some merged into its parts, some pending."""
    name = _fresh_name("changing")
    points = t.embeddings(spark, sf)
    odd = F.col("label").cast("int") % 2 == 1
    c.create_collection(spark, name, 64, parts=8, external=True)
    c.add_points(spark, name, points)
    turned = points.filter(odd).select("id", F.reverse("dense").alias("dense"), F.lit("turned").alias("label"))
    changes.upsert_into(spark, name, turned)
    checked = points.filter("id % 5 = 0").select("id", F.create_map(F.lit("checked"), F.lit("yes")).alias("payload"))
    changes.set_payloads_in(spark, name, checked)
    changes.compact(spark, name)
    changes.delete_from(spark, name, points.filter("id % 11 = 0").select("id"))
    held = c.open_collection(spark, name)
    rows = held.select("id", "label", F.try_element_at("payload", F.lit("checked")).alias("checked"), F.posexplode("dense").alias("i", "x"))
    return rows.select("id", "label", "checked", "i", (F.round(F.col("x").cast("double"), 6) + 0.0).alias("x"))


@query
def delete_ids(spark, sf):
    toxic = t.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return mutate.delete_ids(t.documents(spark, sf), toxic).select("id", "label")


@query
def delete_filter(spark, sf):
    points = t.payload_points(spark, sf)
    return mutate.delete_where(points, p.match(p.field(points, "label"), "0")).select("id", "label")


@query
def payload_merge(spark, sf):
    points = t.payload_points(spark, sf)
    french = p.match(p.field(points, "lang"), "fr")
    return _entries(mutate.set_payload(points, french, {"lang": "français", "checked": "yes"}))


@query
def payload_set_field(spark, sf):
    return _entries(mutate.set_payload_field(t.payload_points(spark, sf), 7, "checked", "yes"))


@query
def payload_lookup(spark, sf):
    """A payload value that all points have, and one that none has, by name."""
    payload = F.col("payload")
    return t.payload_points(spark, sf).select(
        "id", lookup_value(payload, "lang").alias("lang"), lookup_value(payload, "tone", "unknown").alias("tone")
    )


@query
def payload_merge_batch(spark, sf):
    """Ratings merged into payloads, first quality and toxicity, then a verdict over it."""
    rated = t.table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    text = {name: F.col(name).cast("string") for name in ("quality", "toxic")}
    first = F.create_map(F.lit("quality"), text["quality"], F.lit("source"), F.concat(F.lit("rated "), text["toxic"]))
    second = F.create_map(F.lit("quality"), F.lit("good"))
    updates = rated.select("id", F.lit(1).alias("seq"), first.alias("payload")).unionByName(
        rated.filter("quality = 1").select("id", F.lit(2).alias("seq"), second.alias("payload"))
    )
    return _entries(mutate.set_payloads(t.payload_points(spark, sf), updates, "seq"))


@query
def payload_drop_fields(spark, sf):
    points = t.payload_points(spark, sf)
    german = p.match(p.field(points, "lang"), "de")
    return _entries(mutate.delete_fields(points, german, ["source", "n_chars", "absent"]))


# -- collections and streams ------------------------------------------------------


def _fresh_name(stem: str) -> str:
    return f"{stem}_{uuid4().hex}"


@query
def ingest_collection(spark, sf):
    """Source to collection and back: each text, label, vector element, weight and payload value."""
    scenario = replace(t.DOCUMENTS, collection_name=_fresh_name("documents"))
    path = f"{sf}/documents.parquet"
    sparse = Bm25Encoder.fit(src.spread(src.read_source(spark, path)), "text")
    ingest(spark, path, scenario, HashingEncoder(), 64, sparse, external=True)
    points = c.open_collection(spark, scenario.collection_name)

    def part(name: str, rows: DataFrame, key: Column, number: Column, value: Column) -> DataFrame:
        return rows.select(
            "id", F.lit(name).alias("part"), key.cast("string").alias("key"),
            (F.round(number.cast("double"), 6) + 0.0).alias("number"), value.cast("string").alias("value"),
        )

    none = F.lit(None)
    dense = points.select("id", F.posexplode("dense").alias("key", "number"))
    weights = points.select("id", F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("w"))
    return (
        part("text", points, none, none, F.col("text"))
        .unionByName(part("label", points, none, none, F.col("label")))
        .unionByName(part("dense", dense, F.col("key"), F.col("number"), none))
        .unionByName(part("sparse", weights, F.col("w.indices"), F.col("w.values"), none))
        .unionByName(part("payload", _entries(points), F.col("key"), none, F.col("value")))
    )


@query
def ingest_counters(spark, sf):
    """Valid and invalid records, counted by an Observation while they are read."""
    counts = Observation()
    src.validated_records(_records(spark, sf), counts=counts).write.format("noop").mode("overwrite").save()
    found = counts.get
    return spark.createDataFrame([(found["valid"], found["invalid"])], "valid bigint, invalid bigint")


def _searched(spark, sf, distance: str, vector: str = "dense") -> DataFrame:
    """Search of a saved collection that knows its distance and vector."""
    name = _fresh_name("searched")
    c.create_collection(spark, name, 64, distance=distance, external=True, vector=vector)
    c.add_points(spark, name, t.embeddings(spark, sf).withColumnRenamed("dense", vector))
    return _hits(search.search_collection(spark, name, t.centroids(spark, sf)))


@query
def collection_search_euclid(spark, sf):
    return _searched(spark, sf, "Euclid")


@query
def collection_search_dot(spark, sf):
    return _searched(spark, sf, "Dot")


@query
def named_vector_search(spark, sf):
    return _searched(spark, sf, "Cosine", "my-model")


@query
def shard_search(spark, sf):
    """Search within one shard key value, which reads that partition only."""
    name = _fresh_name("sharded")
    c.create_collection(spark, name, 64, shard_key="label", external=True)
    c.add_points(spark, name, t.embeddings(spark, sf))
    shard = c.open_collection(spark, name, shards=["3"])
    return _hits(search.dense_search(shard, t.centroids(spark, sf)))


@query
def described_collection(spark, sf):
    """Statistics of a saved collection, after an upsert was saved as its new version."""
    name = _fresh_name("described")
    c.create_collection(spark, name, 64, distance="Dot", external=True)
    c.add_points(spark, name, t.embeddings(spark, sf))
    points = c.open_collection(spark, name)
    fresh = points.withColumn("id", F.col("id") + 1_000_000).withColumn("label", F.lit(None).cast("string"))
    c.replace_points(spark, name, mutate.upsert(points, fresh))
    return c.describe_collection(spark, name).drop("collection")


@query
def typed_field_filter(spark, sf):
    """Payload fields as typed columns of a collection that is laid out by them."""
    name = _fresh_name("typed")
    c.create_collection(spark, name, 64, external=True)
    c.add_points(spark, name, t.payload_points(spark, sf))
    c.declare_field(spark, name, "lang", "keyword")
    c.declare_field(spark, name, "n_chars", "integer")
    points = c.open_collection(spark, name)
    return points.filter((F.col("lang") == "en") & (F.col("n_chars") >= 2000)).select("id", "lang", "n_chars")


@query
def incremental_ingest(spark, sf):
    """All points, then even labels changed, then some again; each run takes up what is new."""
    source, path, checkpoint = (shared_dir(spark, part) for part in ("arriving", "stream", "progress"))
    base = t.embeddings(spark, sf)
    even = base.filter(F.col("label").cast("int") % 2 == 0)
    first = even.withColumns({"dense": F.reverse("dense"), "label": F.lit("first")})
    second = even.filter("id % 3 = 0").withColumn("label", F.lit("second"))
    for arriving in (base, first, second):
        arriving.write.mode("append").parquet(source)
        points = spark.readStream.schema(base.schema).parquet(source)
        stream.stream_points(points, path, checkpoint).awaitTermination()
    return _elements_with_label(stream.read_streamed(spark, path))


@query
def incremental_ingest_numbered(spark, sf):
    path, checkpoint = shared_dir(spark, "stream"), shared_dir(spark, "progress")
    schema = t.table(spark, sf, "documents").schema
    # A pattern of that one name: the table may be a file, which a plain path may not, or a folder.
    files = spark.readStream.schema(schema).parquet(f"{sf}/{{documents}}.parquet")
    points = files.select("doc_id", "lang", "n_chars")
    stream.stream_points(points, path, checkpoint, number_by="doc_id").awaitTermination()
    return stream.read_streamed(spark, path).select("id", "doc_id", "lang", "n_chars")


@query
def stream_collection(spark, sf):
    """Three batches into a collection: new points, replacements, and vectors of a wrong size, which are set aside."""
    source, checkpoint = shared_dir(spark, "arriving"), shared_dir(spark, "progress")
    name = _fresh_name("streamed")
    c.create_collection(spark, name, 64, parts=8, external=True)
    base = t.embeddings(spark, sf)
    even = base.filter(F.col("label").cast("int") % 2 == 0)
    short = F.when(F.col("id") % 4 == 0, F.slice("dense", 1, 20)).otherwise(F.reverse("dense"))
    first = even.withColumns({"dense": short, "label": F.lit("first")})
    second = even.filter("id % 3 = 0").withColumn("label", F.lit("second"))
    for arriving in (base, first, second):
        arriving.write.mode("append").parquet(source)
        points = spark.readStream.schema(base.schema).parquet(source)
        stream.stream_into(points, name, checkpoint).awaitTermination()
    held = _elements_with_label(c.open_collection(spark, name)).select("*", F.lit(None).cast("string").alias("reason"))
    aside = stream.rejected_points(spark, name)
    aside = aside.select("id", F.lit(None).cast("string").alias("label"), F.col("size").alias("i"), F.lit(None).cast("double").alias("x"), "reason")
    total = F.lit(stream.stream_ledger(spark, name)["total"]).cast("bigint")
    return held.unionByName(aside).withColumn("total", total)
