"""Queries over the catalogue: files, labels, identifiers, splits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalogue
from ..sources import bags as source
from .registry import query, table

# Parts stand for files: their names make paths, and names repeat.
_PATHS = "f AS (SELECT p_partkey AS id, p_brand || '/' || replace(p_type, ' ', '_') || '/' || replace(p_name, ' ', '_') || '.pt' AS path FROM part)"


def _paths(spark, sf_dir):
    clean = lambda c: F.regexp_replace(c, " ", "_")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("/"), clean("p_type"), F.lit("/"), clean("p_name"), F.lit(".pt")).alias("path"))


@query(f"WITH {_PATHS}, s AS (SELECT regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM f) SELECT stem, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 1")
def dup_names(spark, sf_dir):
    return source.duplicate_names(_paths(spark, sf_dir))


@query(f"WITH {_PATHS} SELECT id, string_split(path, '/')[-2] AS label FROM f")
def label_from_path(spark, sf_dir):
    return _paths(spark, sf_dir).select("id", catalogue.folder_label(F.col("path")).alias("label"))


@query("SELECT c_custkey, (CASE WHEN starts_with(c_mktsegment, 'AUTO') THEN 0 WHEN starts_with(c_mktsegment, 'BUILD') THEN 1 ELSE 2 END)::INT AS label FROM customer WHERE starts_with(c_mktsegment, 'AUTO') OR starts_with(c_mktsegment, 'BUILD') OR starts_with(c_mktsegment, 'MACH')")
def label_from_prefix(spark, sf_dir):
    return catalogue.prefix_label(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", {"AUTO": 0, "BUILD": 1, "MACH": 2}).select("c_custkey", "label")


@query("SELECT doc_id, (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))::INT AS label FROM documents")
def membership_label(spark, sf_dir):
    return catalogue.membership_label(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("SELECT o_orderkey AS id, 'train' AS split FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'test' FROM orders WHERE o_orderkey % 2 = 1")
def catalog_union(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return orders.where("id % 2 = 0").withColumn("split", F.lit("train")).unionByName(orders.where("id % 2 = 1").withColumn("split", F.lit("test")))


def _label_sides(spark, sf_dir, files):
    return catalogue.join_labels(files, table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT d.doc_id, source, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def label_join(spark, sf_dir):
    return _label_sides(spark, sf_dir, table(spark, sf_dir, "documents").select("doc_id", "source"))[0]


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages)")
def missing_files(spark, sf_dir):
    """Pages stand for the files, of which there are fewer than labels."""
    return _label_sides(spark, sf_dir, table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")))[1]


@query("SELECT doc_id, source, (dense_rank() OVER (ORDER BY source) - 1)::INT AS label FROM documents")
def label_encode(spark, sf_dir):
    return catalogue.dense_labels(table(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", "source", F.col("label").cast("int").alias("label"))


@query("SELECT c_custkey, array_to_string(string_split('SITE-' || c_nationkey || '-' || c_custkey || '-01-DX', '-')[1:3], '-') AS patient FROM customer")
def patient_id(spark, sf_dir):
    name = F.concat(F.lit("SITE-"), "c_nationkey", F.lit("-"), "c_custkey", F.lit("-01-DX"))
    return table(spark, sf_dir, "customer").select("c_custkey", catalogue.patient(name).alias("patient"))


@query("SELECT c_custkey, 'patient_' || c_custkey AS grp FROM customer")
def group_column(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", catalogue.group_column(F.concat(F.lit("patient_"), "c_custkey", F.lit("_node_1"))).alias("grp"))


@query("SELECT source, count(DISTINCT lang)::BIGINT AS labels FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def mixed_labels(spark, sf_dir):
    return catalogue.mixed_labels(table(spark, sf_dir, "documents"), "source", "lang")


@query("SELECT e.vec_id, l_quantity::DOUBLE AS px, round(l_extendedprice::DOUBLE, 2) AS py FROM embeddings e JOIN (SELECT l_orderkey, arg_min(l_quantity, (l_linenumber, l_quantity, l_extendedprice)) AS l_quantity, arg_min(l_extendedprice, (l_linenumber, l_quantity, l_extendedprice)) AS l_extendedprice FROM lineitem GROUP BY 1) o ON o.l_orderkey = e.vec_id")
def coord_join(spark, sf_dir):
    """Orders' first lines stand for coordinates."""
    first = F.min(F.struct("l_linenumber", "l_quantity", "l_extendedprice"))
    places = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("vec_id")).agg(first.alias("m")).select("vec_id", F.col("m.l_quantity").cast("double").alias("px"), F.round(F.col("m.l_extendedprice").cast("double"), 2).alias("py"))
    return source.with_coordinates(table(spark, sf_dir, "embeddings").select("vec_id"), places, "vec_id")


@query("SELECT label AS bag, vec_id AS index FROM embeddings JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) USING (label) WHERE vec_id >= 0 AND vec_id < n")
def bounded_indices(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("bag"), F.col("vec_id").alias("index"))
    return source.bounded(rows, rows.groupBy("bag").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT DISTINCT o_custkey AS bag FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def pending_slides(spark, sf_dir):
    done = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("bag"))
    return source.pending(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bag")).distinct(), done)


@query("SELECT bag::VARCHAR AS bag, 'd' || (CASE WHEN bag % 2 = 0 THEN 'a/' ELSE 'b/' END) || bag || (CASE WHEN bag % 2 = 0 THEN '' ELSE '.x' END) || '.npy' AS path, 2::BIGINT AS candidates FROM (SELECT n_nationkey AS bag FROM nation)")
def pick_file(spark, sf_dir):
    """Each nation has two files: an exact name and a longer one, or two longer ones."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("bag"), (F.col("n_nationkey") % 2 == 0).alias("even"))
    names = F.when(F.col("even"), F.array(F.struct(F.concat(F.lit("da/"), "bag", F.lit(".npy")).alias("path"), F.col("bag").alias("stem")), F.struct(F.concat(F.lit("aa/"), "bag", F.lit(".x.npy")).alias("path"), F.concat("bag", F.lit(".x")).alias("stem")))).otherwise(
        F.array(F.struct(F.concat(F.lit("db/"), "bag", F.lit(".x.npy")).alias("path"), F.concat("bag", F.lit(".x")).alias("stem")), F.struct(F.concat(F.lit("ec/"), "bag", F.lit(".y.npy")).alias("path"), F.concat("bag", F.lit(".y")).alias("stem")))
    )
    files = nations.select(F.explode(names).alias("f")).select("f.*")
    return source.pick_file(nations.select("bag"), files)


# Splits: labelled documents by quality; customers by nation as groups; orders of customers as members.

_D = "d AS (SELECT doc_id, quality AS label FROM labels)"


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))


@query(f"WITH {_D} SELECT doc_id, label, ((row_number() OVER (ORDER BY label, md5('42|' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM d")
def stratified_kfold(spark, sf_dir):
    return catalogue.stratified_folds(_labelled(spark, sf_dir), "doc_id", "label").select("doc_id", "label", "fold")


_SHUFFLE = """c AS (SELECT label, count(*) AS n, ceil(0.2::DOUBLE * sum(count(*)) OVER ()) AS goal, round(count(*) * ceil(0.2::DOUBLE * sum(count(*)) OVER ()) / sum(count(*)) OVER (), 9) AS ideal FROM d GROUP BY 1),
q AS (SELECT label, floor(ideal) + (row_number() OVER (ORDER BY round(ideal - floor(ideal), 9) DESC, label) <= goal - sum(floor(ideal)) OVER ())::INT AS test FROM c),
r AS (SELECT d.*, fold, row_number() OVER (PARTITION BY fold, label ORDER BY md5('42|' || fold || '|' || doc_id), doc_id) AS k FROM d, range(5) t(fold))"""


@query(f"WITH {_D}, {_SHUFFLE} SELECT doc_id, label, fold::INT AS fold, CASE WHEN k <= test THEN 'test' ELSE 'train' END AS split FROM r JOIN q USING (label)")
def stratified_shuffle(spark, sf_dir):
    return catalogue.stratified_shuffles(_labelled(spark, sf_dir), "doc_id", "label").select("doc_id", "label", "fold", "split")


@query(f"WITH {_D}, {_SHUFFLE} SELECT doc_id, label, fold::INT AS fold, CASE WHEN k <= test THEN 'test' ELSE 'train' END AS split FROM r JOIN q USING (label)")
def saved_splits(spark, sf_dir):
    """Repeated splits, made and written by a first call and read by a second."""
    from ..sources.results import splits_once
    from ..sources.tables import shared_dir

    root = f"{shared_dir(spark)}/splits-{uuid.uuid4().hex}"
    first, again = (splits_once(_labelled(spark, sf_dir), root, "documents", "stratified_shuffle", "doc_id", "label") for _ in range(2))
    return again.select("doc_id", "label", "fold", "split")


def _members(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("label"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc_id")).join(people, "doc_id")


_G = "m AS (SELECT o_orderkey, c_custkey AS doc_id, c_mktsegment AS label FROM orders JOIN customer ON o_custkey = c_custkey), d AS (SELECT doc_id, min(label) AS label FROM m GROUP BY 1)"


@query(f"WITH {_G}, f AS (SELECT doc_id, ((row_number() OVER (ORDER BY label, md5('42|' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM d) SELECT o_orderkey, m.doc_id, fold FROM m JOIN f USING (doc_id)")
def grouped_kfold(spark, sf_dir):
    return catalogue.grouped_folds(_members(spark, sf_dir), "doc_id", "label").select("o_orderkey", "doc_id", "fold")


@query(f"WITH {_G}, {_SHUFFLE}, s AS (SELECT doc_id, fold::INT AS fold, CASE WHEN k <= test THEN 'test' ELSE 'train' END AS split FROM r JOIN q USING (label)) SELECT o_orderkey, m.doc_id, fold, split FROM m JOIN s USING (doc_id)")
def grouped_shuffle(spark, sf_dir):
    return catalogue.grouped_shuffles(_members(spark, sf_dir), "doc_id", "label").select("o_orderkey", "doc_id", "fold", "split")


@query("SELECT doc_id, f.lang AS fold, CASE WHEN d.lang = f.lang THEN 'test' ELSE 'train' END AS split FROM documents d, (SELECT DISTINCT lang FROM documents) f")
def center_holdout(spark, sf_dir):
    return catalogue.holdout(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang").select("doc_id", "fold", "split")


@query("SELECT (n_nationkey % 3)::INT AS fold, n_name AS name, n_nationkey AS id FROM nation")
def fold_resolve(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    folds = nations.select((F.col("n_nationkey") % 3).cast("int").alias("fold"), F.col("n_name").alias("name"))
    return catalogue.resolve_folds(folds, nations.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id")), "name").select("fold", "name", "id")
