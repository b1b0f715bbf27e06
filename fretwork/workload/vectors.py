"""Vector and hybrid retrieval over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fretwork.operators import cells, term_lists, text_vectors, vectors
from fretwork.operators.search import catalog_search
from fretwork.plans import marts, staging
from fretwork.session import materialize, scratch_dir
from fretwork.sources.buckets import BucketTable
from fretwork.sources.keyed import upsert
from fretwork.workload import search, shop

DIMENSION = 64
K = 20
RECALL = 0.9
TEXT_BUCKETS = 128


def index(spark, sf_dir):
    """Every given vector, as the vector of the product with the same number."""
    rows = shop.table(spark, sf_dir, "embeddings").select(
        shop.product_key(F.col("vec_id")).alias("item_id"), "embedding"
    )
    return vectors.check_dimension(rows, "embedding", DIMENSION)


def queries(spark, sf_dir):
    """One query per label: the mean of all vectors that carry it."""
    cells = shop.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("decimal(20,12)")).cast("double").alias("x"))
    packed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m"))
    return packed.select(F.col("label").cast("bigint").alias("query_id"), F.transform("m", lambda e: e["x"]).alias("embedding"))


def _rounded(hits):
    rank = F.col("rank").cast("bigint").alias("rank")
    return hits.select("query_id", rank, "item_id", F.round("similarity", 6).alias("similarity"))


def cosine_top20(spark, sf_dir):
    return _rounded(vectors.cosine_top_k(index(spark, sf_dir), queries(spark, sf_dir), K))


def similar_products(spark, sf_dir):
    """The five nearest products of every product, of all products."""
    asked = index(spark, sf_dir).withColumnRenamed("item_id", "query_id")
    return _rounded(vectors.cosine_top_k(index(spark, sf_dir), asked, 5))


def _text_weights(spark, sf_dir):
    products = staging.stg_products(shop.raw_products(spark, sf_dir))
    texts = products.select(F.col("product_id").alias("item_id"), text_vectors.embedding_text().alias("text"))
    return text_vectors.term_weights(texts, TEXT_BUCKETS)


def similar_texts(spark, sf_dir):
    """The five products with the most similar texts, of all products; the inverted lists skip most pairs."""
    return _rounded(term_lists.nearest_by_terms(_text_weights(spark, sf_dir), 5, TEXT_BUCKETS)[0])


def cell_index(spark, sf_dir):
    """The given vectors as an inverted file, written and opened."""
    path = scratch_dir(spark, "cell-index")
    cells.write_index(index(spark, sf_dir), path, k=K)
    return cells.open_index(spark, path)


def ann_recall(spark, sf_dir):
    """The inverted file asked for the nearest items of every item whose number is divisible by 20, against all pairs.

    Per query the number of true neighbours, and whether all queries together found at least ``RECALL`` of theirs.
    """
    rows = index(spark, sf_dir)
    asked = materialize(rows.where(F.substring("item_id", 2, 20).cast("bigint") % 20 == 0).withColumnRenamed("item_id", "query_id"), "asked")
    hits = cells.search(cell_index(spark, sf_dir), asked, K).select("query_id", "item_id", F.lit(1).alias("hit"))
    exact = vectors.cosine_top_k(rows, asked, K)
    both = exact.join(hits, ["query_id", "item_id"], "left")
    found = materialize(both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found")), "found")
    total = found.agg((F.sum("n_found") >= F.sum("n_exact") * RECALL).alias("reached"))
    reached = total.first()["reached"]
    return found.select("query_id", "n_exact", F.lit(reached).alias("reached"))


def search_hybrid(spark, sf_dir):
    """Semantic candidates of each label query from the inverted file, then the structured filters and the order rule."""
    asked = materialize(queries(spark, sf_dir), "queries")
    nearest = cells.search(cell_index(spark, sf_dir), asked, K, exact=True)
    nearest = materialize(vectors.as_candidates(nearest), "candidates")
    label = F.col("label")
    requests = shop.table(spark, sf_dir, "embeddings").select(label.cast("bigint").alias("request_id")).distinct()
    odd = F.col("request_id") % 2 == 1
    requests = requests.select(
        "request_id",
        F.when(odd, "intermediate").alias("skill_level"),
        (F.col("request_id") * 400).alias("min_price"),
        F.when(F.col("request_id") > 6, F.col("request_id") * 250).alias("target_price"),
    )
    return search._result(catalog_search(search.catalog_mart(spark, sf_dir), requests, nearest))


def vector_upsert(spark, sf_dir):
    """The index after half of the labels were embedded anew: one row per item, the new vector where there is one."""
    rows = shop.table(spark, sf_dir, "embeddings")
    old = rows.select(shop.product_key(F.col("vec_id")).alias("item_id"), "embedding", F.lit(1).alias("version"))
    anew = rows.where("label >= 5").select(
        shop.product_key(F.col("vec_id")).alias("item_id"),
        F.transform("embedding", lambda x: -x).alias("embedding"),
        F.lit(2).alias("version"),
    )
    index = upsert(upsert(old, anew, ["item_id"], ["version"]), anew, ["item_id"], ["version"])
    first = F.element_at("embedding", 1).cast("double")
    return index.select("item_id", "version", F.round(first, 6).alias("first"), F.size("embedding").cast("bigint").alias("n"))


def vector_table(spark, sf_dir):
    """The index as a table in buckets: written and compacted, then half of the labels embedded anew, one update too late, read by key.

    The new vectors of label 9 are compacted as well, the others still stand in the log.
    """
    rows = shop.table(spark, sf_dir, "embeddings").select(shop.product_key(F.col("vec_id")).alias("item_id"), "embedding", F.lit(1).alias("version"), "label")
    names = ["item_id", "embedding", "version"]
    table = BucketTable(spark, scratch_dir(spark, "vector-table"), rows.select(*names).schema, ["item_id"], ["version"], buckets=16)
    turned = rows.withColumns({"embedding": F.transform("embedding", lambda x: -x), "version": F.lit(2)})
    table.append(rows.select(*names))
    table.compact()
    table.append(turned.where("label = 9").select(*names))
    table.compact()
    table.append(turned.where("label between 5 and 8").select(*names))
    table.append(rows.where("label < 3").withColumn("version", F.lit(0)).select(*names))
    asked = rows.where("label <> 4").select("item_id")
    first = F.element_at("embedding", 1).cast("double")
    return table.read(among=asked).select("item_id", "version", F.round(first, 6).alias("first"), F.size("embedding").cast("bigint").alias("n"))


def embedding_text(spark, sf_dir):
    products = marts.dim_products(staging.stg_products(shop.raw_products(spark, sf_dir)))
    meta = vectors.vector_metadata()
    return products.select(
        "product_id",
        text_vectors.embedding_text().alias("text"),
        meta["price"].alias("price"),
        meta["type"].alias("type"),
    )


def text_vectors_tfidf(spark, sf_dir):
    """Vectors of all product texts."""
    products = staging.stg_products(shop.raw_products(spark, sf_dir))
    texts = products.select(F.col("product_id").alias("item_id"), text_vectors.embedding_text().alias("text"))
    weights = text_vectors.term_weights(texts)
    return weights.select("item_id", "bucket", F.round("weight", 6).alias("weight"))


def text_search(spark, sf_dir):
    """Top products for the mean text vector of each brand's products: text to vector to ranking."""
    products = staging.stg_products(shop.raw_products(spark, sf_dir))
    texts = products.select(F.col("product_id").alias("item_id"), text_vectors.embedding_text().alias("text"))
    weights = materialize(text_vectors.term_vectors(texts, 128), "weights")
    brands = products.select(F.col("product_id").alias("item_id"), "brand")
    branded = weights.join(brands, "item_id").select("brand", F.inline("entries"))
    per_brand = branded.groupBy("brand", "bucket").agg(F.avg("weight").alias("weight"))
    asked = text_vectors.dense_vectors(per_brand.withColumnRenamed("brand", "item_id"), 128)
    return _rounded(
        vectors.cosine_top_k(text_vectors.dense(weights, 128), asked.withColumnRenamed("item_id", "query_id"), K)
    )


QUERIES = {
    "cosine_top20": cosine_top20,
    "similar_products": similar_products,
    "similar_texts": similar_texts,
    "ann_recall": ann_recall,
    "search_hybrid": search_hybrid,
    "vector_upsert": vector_upsert,
    "vector_table": vector_table,
    "embedding_text": embedding_text,
    "text_vectors_tfidf": text_vectors_tfidf,
    "text_search": text_search,
}

_NEAREST = f"""queries AS (
  SELECT label, list(x ORDER BY i) AS q FROM (
    SELECT label, i, CAST(sum(CAST(x AS DECIMAL(20,12))) AS DOUBLE) / count(*) AS x
    FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL)
  GROUP BY label),
 nearest AS (
  SELECT CAST(q.label AS BIGINT) AS query_id, {shop.sql_product_key("vec_id")} AS item_id,
         list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.q) AS s,
         row_number() OVER (PARTITION BY q.label ORDER BY s DESC, vec_id) AS nth
  FROM embeddings, queries q QUALIFY nth <= {K})"""

_TEXT = """concat_ws('. ', product_name, brand || ' ' || subcategory, description, 'Skill level: ' || skill_level,
             'Use case: ' || use_case, 'Category: ' || category)"""



def _weights_sql(buckets: int) -> str:
    return f"""{shop.with_sql("stg_products")},
  words AS (SELECT product_id, unnest(string_split_regex(lower({_TEXT}), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM stg_products),
  counts AS (SELECT product_id, CAST('0x' || substr(md5(word), 1, 7) AS BIGINT) % {buckets} AS bucket, count(*) AS tf
             FROM words WHERE word <> '' GROUP BY ALL),
  idf AS (SELECT bucket, ln(((SELECT count(*) FROM stg_products) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf
          FROM counts GROUP BY bucket),
  raw AS (SELECT product_id, bucket, tf * idf AS w FROM counts JOIN idf USING (bucket)),
  weights AS (SELECT product_id AS item_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY product_id)) AS weight FROM raw)"""


_SIMILAR = """scored AS (SELECT q.id AS query_id, i.id AS item_id, list_cosine_similarity(q.v, i.v) AS s FROM items q, items i)
      SELECT query_id, item_id, round(s, 6) AS similarity,
             row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, item_id) AS rank
      FROM scored WHERE NOT isnan(s) QUALIFY rank <= 5"""

ORACLE = {
    "cosine_top20": f"WITH {_NEAREST} SELECT query_id, nth AS rank, item_id, round(s, 6) AS similarity FROM nearest",
    "similar_products": f"""
      WITH items AS (SELECT {shop.sql_product_key("vec_id")} AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), {_SIMILAR}""",
    "ann_recall": f"""
      WITH items AS (SELECT {shop.sql_product_key("vec_id")} AS id, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      scored AS (SELECT q.id AS query_id, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, i.v) DESC, i.id) AS rank
                 FROM items q, items i WHERE q.vec_id % 20 = 0 AND NOT isnan(list_cosine_similarity(q.v, i.v)))
      SELECT query_id, count(*) AS n_exact, true AS reached FROM scored WHERE rank <= {K} GROUP BY query_id""",
    "search_hybrid": shop.with_sql("dim_products")
    + f""", {_NEAREST}, requests AS (
      SELECT DISTINCT CAST(label AS BIGINT) AS request_id, CASE WHEN label % 2 = 1 THEN 'intermediate' END AS skill_level,
             label * 400 AS min_price, CASE WHEN label > 6 THEN label * 250 END AS target_price FROM embeddings)
      SELECT r.request_id, p.product_id, p.product_name, p.brand, p.subcategory, CAST(p.price AS DOUBLE) AS price,
             p.skill_level, p.use_case, p.price_tier,
             row_number() OVER (PARTITION BY r.request_id ORDER BY
               coalesce(abs(p.price - r.target_price), n.nth), p.product_id) AS rank
      FROM requests r JOIN nearest n ON n.query_id = r.request_id JOIN dim_products p ON p.product_id = n.item_id
      WHERE p.in_stock AND p.price >= r.min_price
        AND (r.skill_level IS NULL OR contains(p.skill_level, r.skill_level)) QUALIFY rank <= 3""",
    "vector_upsert": f"""
      SELECT {shop.sql_product_key("vec_id")} AS item_id, CASE WHEN label >= 5 THEN 2 ELSE 1 END AS version,
             round(CAST(CASE WHEN label >= 5 THEN -embedding[1] ELSE embedding[1] END AS DOUBLE), 6) AS first,
             len(embedding) AS n FROM embeddings""",
    "embedding_text": shop.with_sql("dim_products")
    + f" SELECT product_id, {_TEXT} AS text, CAST(price AS DOUBLE) AS price, 'product' AS type FROM dim_products",
    "text_vectors_tfidf": _weights_sql(1024) + " SELECT item_id, bucket, round(weight, 6) AS weight FROM weights",
    "text_search": _weights_sql(128)
    + f""", items AS (SELECT item_id, bucket, CAST(CAST(weight AS FLOAT) AS DOUBLE) AS w FROM weights),
      asked AS (SELECT brand, bucket, CAST(CAST(avg(weight) AS FLOAT) AS DOUBLE) AS w
                FROM weights JOIN stg_products ON product_id = item_id GROUP BY ALL),
      item_norm AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM items GROUP BY 1),
      asked_norm AS (SELECT brand, sqrt(sum(w * w)) AS n FROM asked GROUP BY 1),
      dots AS (SELECT brand, item_id, sum(a.w * i.w) AS d FROM asked a JOIN items i USING (bucket) GROUP BY ALL)
      SELECT brand AS query_id, item_id, round(d / (a.n * i.n), 6) AS similarity,
             row_number() OVER (PARTITION BY brand ORDER BY round(d / (a.n * i.n), 12) DESC, item_id) AS rank
      FROM dots JOIN asked_norm a USING (brand) JOIN item_norm i USING (item_id) QUALIFY rank <= {K}""",
}
ORACLE["vector_table"] = f"{ORACLE['vector_upsert']} WHERE label <> 4"
ORACLE["similar_texts"] = (
    _weights_sql(128)
    + f""", places AS (SELECT item_id, b AS bucket FROM (SELECT DISTINCT item_id FROM weights), range(128) r(b)),
      cells AS (SELECT item_id, bucket, coalesce(CAST(CAST(weight AS FLOAT) AS DOUBLE), 0) AS w FROM places LEFT JOIN weights USING (item_id, bucket)),
      items AS (SELECT item_id AS id, list(w ORDER BY bucket) AS v FROM cells GROUP BY 1),
      {_SIMILAR}"""
)
