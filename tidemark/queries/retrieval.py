"""Queries of search, fusion, graph, resolution and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text, vectors
from tidemark.operators import asof, context, fusion, graph, projection, resolve, search
from tidemark.plans.tables import spread, table
from tidemark.queries.bindings import CLAIMS, ENTITIES, VALID, claims, entities, sourced

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("content"))


def _asked(spark, d) -> DataFrame:
    """Evaluation passages whose id is divisible by 50 are the lexical queries."""
    return table(spark, d, "eval_items").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _score(c: str) -> Column:
    return F.round(c, 6).alias(c)


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
_TOKENS = f"list_filter(regexp_extract_all(lower(%s), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({_STOP}, w))"
_ANCHOR = "(SELECT query_id, max(term) AS term FROM qt GROUP BY 1)"
_BM25 = f"""WITH q AS (SELECT item_id AS query_id, text AS query FROM eval_items WHERE item_id % 50 = 0),
 qt AS (SELECT DISTINCT query_id, unnest({_TOKENS % 'query'}) AS term FROM q),
 w AS (SELECT doc_id, length(text) AS chars, unnest({_TOKENS % 'text'}) AS term FROM documents),
 p AS (SELECT doc_id, term, count(*) AS tf, any_value(chars) AS chars FROM w WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
 pool AS (SELECT count(*)::DOUBLE AS n, greatest(coalesce(avg(length(text)), 1), 1) AS avgdl FROM documents),
 df AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY 1),
 an AS {_ANCHOR},
 h AS (SELECT qt.query_id, p.doc_id AS record_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * chars / avgdl))) AS score, count(*) AS found,
   count(an.term) AS anchored FROM p JOIN df USING (term) JOIN qt USING (term) CROSS JOIN pool LEFT JOIN an ON an.query_id = qt.query_id AND an.term = qt.term GROUP BY 1, 2),
 need AS (SELECT query_id, count(*) AS terms FROM qt GROUP BY 1)"""


def _ranked(source: str, k: int, order: str = "round(score, 6) DESC, record_id") -> str:
    return f"SELECT query_id, record_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {k}"


def _first(hits: DataFrame, k: int) -> DataFrame:
    return search.top(hits, k, F.round("score", 6).desc(), F.col("record_id")).select("query_id", "record_id", _score("score"), "rank")


def _anchors(spark, d) -> DataFrame:
    return search.query_terms(_asked(spark, d)).groupBy("query_id").agg(F.max("term").alias("term"))


@query(_BM25 + _ranked("h", 20))
def bm25_topk(spark, d):
    return _first(search.bm25(_documents(spark, d), _asked(spark, d), k=20), 20)


@query(_BM25 + " SELECT query_id, record_id, round(score, 6) AS score FROM h JOIN need USING (query_id) WHERE found = terms")
def bm25_strict(spark, d):
    return search.bm25(_documents(spark, d), _asked(spark, d), "all").select("query_id", "record_id", _score("score"))


@query(_BM25 + _ranked("(SELECT * FROM h JOIN need USING (query_id) WHERE anchored = 1 AND (found > 1 OR terms = 1))", 20))
def bm25_anchored(spark, d):
    return _first(search.bm25(_documents(spark, d), _asked(spark, d), "anchored", _anchors(spark, d), 20), 20)


@query(_BM25 + f""", t AS (SELECT query_id, record_id, score, CASE WHEN found = terms THEN 1 WHEN anchored = 1 AND (found > 1 OR terms = 1) THEN 2 ELSE 3 END AS tier FROM h JOIN need USING (query_id))
 SELECT query_id, record_id, tier, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, round(score, 6) DESC, record_id) AS rank FROM t) WHERE rank <= 60""")
def lexical_ladder(spark, d):
    return search.ladder(_documents(spark, d), _asked(spark, d), _anchors(spark, d), 20).select("query_id", "record_id", "tier", "rank")


_GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower(%s), '[\\p{L}\\p{N}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _like(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) > 0 THEN len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) ELSE 0 END"


@query(f"""WITH q AS (SELECT item_id AS query_id, answer AS query, {_GRAMS % 'answer'} AS qg FROM eval_items WHERE answer <> ''),
 h AS (SELECT query_id, doc_id AS record_id, {_GRAMS % 'text'} AS g, qg, length(text) AS chars FROM documents JOIN q ON contains(lower(text), lower(query)))
 SELECT query_id, record_id, chars::INT AS chars, round({_like('g', 'qg')}, 6)::DOUBLE AS score FROM h""")
def exact_substring(spark, d):
    q = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("answer").alias("query")).dropna()
    return search.exact(_documents(spark, d), q).select("query_id", "record_id", "chars", _score("score"))


@query(f"""WITH {ENTITIES}, n AS (SELECT entity_id, entity_type, canonical_name, {_GRAMS % 'canonical_name'} AS g FROM en WHERE canonical_name IS NOT NULL),
 q AS (SELECT * FROM n WHERE entity_type = 'place')
 SELECT q.entity_id AS query_id, n.entity_id AS record_id, round({_like('n.g', 'q.g')}, 6)::DOUBLE AS score FROM n, q WHERE {_like('n.g', 'q.g')} >= 0.55""")
def fuzzy_alias(spark, d):
    e = entities(spark, d)
    names = e.select(F.col("entity_id").alias("record_id"), F.col("canonical_name").alias("content"))
    q = e.filter("entity_type = 'place'").select(F.col("entity_id").alias("query_id"), F.col("canonical_name").alias("query"))
    return search.similar(names, q).select("query_id", "record_id", _score("score"))


@query(f"WITH {ENTITIES}, n AS (SELECT entity_id, trim(regexp_replace(lower(canonical_name), '\\s+', ' ', 'g')) AS alias FROM en WHERE canonical_name IS NOT NULL) SELECT alias, count(*) AS entities, min(entity_id) AS first_id FROM n GROUP BY 1 HAVING count(*) > 1")
def exact_alias(spark, d):
    a = entities(spark, d).filter("canonical_name is not null").select("entity_id", text.normalize_alias(F.col("canonical_name")).alias("alias"))
    return a.groupBy("alias").agg(F.count("*").alias("entities"), F.min("entity_id").alias("first_id")).filter("entities > 1")


_DOUBLE = "list_transform(%s, lambda x: x::DOUBLE)"
_VEC = f"""WITH e AS (SELECT vec_id, label, {_DOUBLE % 'embedding'} AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS m FROM e),
 h AS (SELECT q.vec_id AS query_id, a.vec_id AS record_id, a.label, q.label AS q_label, list_dot_product(a.v, q.v) / (a.m * q.m) AS score FROM n a, n q WHERE q.vec_id % 50 = 0 AND a.m > 0 AND q.m > 0)"""


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("record_id"), "embedding", "label"), e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(_VEC + _ranked("h", 10))
def vector_topk(spark, d):
    records, q = _vectors(spark, d)
    return search.nearest(records, q, 10).select("query_id", "record_id", _score("score"), "rank")


@query(_VEC + _ranked("(SELECT * FROM h WHERE label < 5)", 10))
def vector_topk_filtered(spark, d):
    records, q = _vectors(spark, d)
    return search.nearest(records.filter("label < 5"), q, 10).select("query_id", "record_id", _score("score"), "rank")


@query(_VEC + _ranked("(SELECT * FROM h WHERE score >= 0.3)", 1000))
def vector_min_score(spark, d):
    records, q = _vectors(spark, d)
    return search.nearest(records, q, None, least=0.3).select("query_id", "record_id", _score("score"), "rank")


@query()
def vector_index_topk(spark, d):
    """By an inverted file; the number of cells looked into reaches 0.95 of the exact answers of queries of its own."""
    records, q = _vectors(spark, d)
    own = table(spark, d, "embeddings").filter("vec_id % 50 = 25").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = search.VectorIndex(records)
    return index.search(q, 10, index.probes_for(own, 10)).select("query_id", "record_id", _score("score"), "rank")


@query(f"WITH e AS (SELECT vec_id, {_DOUBLE % 'embedding'} AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS m FROM e) SELECT vec_id, len(v)::INT AS size, (len(v) = 64) AS valid, round(m, 6) AS norm, round(list_sum(list_transform(v, lambda x: x / m)), 6) AS unit_sum FROM n")
def vector_normalize(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.size(e).alias("size"), vectors.valid(e, 64).alias("valid"), F.round(vectors.norm(e), 6).alias("norm"), F.round(F.aggregate(vectors.normalized(e), F.lit(0.0), lambda a, x: a + x), 6).alias("unit_sum"))


# fusion: three retrievers over documents for the same queries


FNV = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(regexp_extract_all(hex(encode(%s)), '..'), lambda h: ('0x' || h)::UBIGINT)), lambda a, b: (xor(a, b) * 16777619) %% 4294967296)"


def hashed(source: str, name: str) -> str:
    """CTEs that end in ``name`` (id, bucket, weight): the hashed embeddings of source (id, content)."""
    return f""" {name}_w AS (SELECT id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]{{2,}}')) AS word FROM {source}),
 {name}_t AS (SELECT id, word, count(*) AS tf FROM {name}_w GROUP BY 1, 2), {name}_k AS (SELECT word, {FNV % "word"} AS h FROM (SELECT DISTINCT word FROM {name}_t)),
 {name}_b AS (SELECT id, (h % 1536)::INT AS bucket, sum(CASE WHEN h >= 2147483648 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * (1 + ln(tf))) AS w FROM {name}_t JOIN {name}_k USING (word) GROUP BY 1, 2),
 {name}_n AS (SELECT id, sqrt(sum(w * w)) AS n FROM {name}_b GROUP BY 1),
 {name} AS (SELECT id, bucket, w / n AS weight FROM {name}_b JOIN {name}_n USING (id) WHERE n > 0)"""


_LEGS = _BM25 + f""",
 qd AS (SELECT query_id AS id, query AS content FROM q), dd AS (SELECT doc_id AS id, text AS content FROM documents), {hashed("qd", "qv")}, {hashed("dd", "dv")},
 vh AS (SELECT qv.id AS query_id, dv.id AS record_id, sum(qv.weight * dv.weight) AS score FROM qv JOIN dv USING (bucket) GROUP BY 1, 2),
 vx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, record_id) AS rank FROM vh WHERE round(score, 9) > 0),
 eq AS (SELECT item_id AS query_id, answer, {_GRAMS % 'answer'} AS qg FROM eval_items WHERE item_id % 50 = 0 AND answer <> ''),
 eh AS (SELECT query_id, doc_id AS record_id, {_GRAMS % 'text'} AS g, qg, length(text) AS chars FROM documents JOIN eq ON contains(lower(text), lower(answer))),
 ex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chars, record_id) AS rank FROM (SELECT query_id, record_id, chars, {_like('g', 'qg')} AS score FROM eh)),
 lx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, record_id) AS rank FROM h),
 cand AS (SELECT query_id, 'lexical' AS mode, record_id, rank, round(score, 6) AS score FROM lx WHERE rank <= 40
   UNION ALL SELECT query_id, 'exact', record_id, rank, round(score, 6) FROM ex WHERE rank <= 40
   UNION ALL SELECT query_id, 'vector', record_id, rank, round(score, 6) FROM vx WHERE rank <= 40),
""" + """ best AS (SELECT *, max(score) OVER (PARTITION BY query_id, mode) AS best FROM cand),
 marked AS (SELECT *, (best > 0 AND score < best * 0.35 AND mode <> 'exact') AS weak FROM best),
 again AS (SELECT query_id, mode, record_id, score, weak, row_number() OVER (PARTITION BY query_id, mode, weak ORDER BY rank, record_id) AS rank FROM marked),
 part AS (SELECT *, max(score) OVER (PARTITION BY query_id, mode, weak) AS top FROM again),
 con AS (SELECT query_id, mode, record_id, weak, rank, CASE mode WHEN 'exact' THEN 1.4 ELSE 1.0 END::DOUBLE / (60 + rank) * CASE WHEN mode = 'exact' OR top <= 0 THEN 1 ELSE 0.4 + 0.6 * least(1, score / top) END / (1 + 0.5 * (record_id % 2)) AS c FROM part),
 fu AS (SELECT query_id, record_id, weak, sum(c) AS score, count(DISTINCT mode) AS retrievers FROM con GROUP BY 1, 2, 3),
 strong AS (SELECT query_id, record_id, score, retrievers, false AS tail FROM fu WHERE NOT weak),
 tl AS (SELECT f.query_id, f.record_id, f.score / (SELECT max(score) FROM fu x WHERE x.weak AND x.query_id = f.query_id) * (SELECT min(score) FROM strong s WHERE s.query_id = f.query_id) * 0.9 AS score, retrievers, true AS tail
   FROM fu f WHERE weak AND NOT EXISTS (SELECT 1 FROM strong s WHERE s.query_id = f.query_id AND s.record_id = f.record_id))"""
_PLACED = "SELECT query_id, record_id, round(score, 6) AS score, retrievers, row_number() OVER (PARTITION BY query_id ORDER BY tail, round(score, 12) DESC, retrievers DESC, record_id)::INT AS position FROM %s"


def _legs(spark, d) -> DataFrame:
    """Words, literal answers and hashed embeddings, each over all documents."""
    q, docs = _asked(spark, d), _documents(spark, d)
    answers = table(spark, d, "eval_items").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("answer").alias("query"))
    lexical = search.top(search.bm25(docs, q, k=40), 40, F.round("score", 6).desc(), F.col("record_id")).withColumn("mode", F.lit("lexical"))
    exact = search.top(search.exact(docs, answers), 40, F.round("score", 6).desc(), F.col("chars"), F.col("record_id")).withColumn("mode", F.lit("exact")).drop("chars")
    asked = projection.hashed_embedding(q.select(F.col("query_id").alias("record_id"), F.col("query").alias("content"))).withColumnRenamed("record_id", "query_id")
    vector = search.nearest_sparse(projection.hashed_embedding(spread(docs)), asked, 40).withColumn("mode", F.lit("vector"))
    rows = lexical.unionByName(exact).unionByName(vector).withColumn("score", F.round("score", 6))
    return rows.withColumn("stream", F.lit(0)).withColumn("surface", F.when(F.col("record_id") % 2 == 0, "chunk").otherwise("assertion")).withColumn("depth", (F.col("record_id") % 2).cast("int"))


def _shown(fused: DataFrame) -> DataFrame:
    return fused.select("query_id", "record_id", _score("score"), "retrievers", "position")


@query(_LEGS + _PLACED % "strong")
def rrf_fusion(spark, d):
    return _shown(fusion.fuse(_legs(spark, d)))


@query(_LEGS + _PLACED % "(SELECT * FROM strong UNION ALL SELECT * FROM tl)")
def rrf_weak_tail(spark, d):
    return _shown(fusion.fuse(_legs(spark, d), keep_tail=True))


@query(_LEGS + "SELECT query_id, mode, count(*) AS candidates, count(*) FILTER (weak) AS weak FROM again GROUP BY 1, 2")
def weak_tail_split(spark, d):
    return fusion.split_tails(_legs(spark, d)).groupBy("query_id", "mode").agg(F.count("*").alias("candidates"), F.count(F.when(F.col("weak"), 1)).alias("weak"))


@query(_LEGS + """, pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, retrievers DESC, record_id) AS position, record_id % 2 AS surface FROM strong),
 hd AS (SELECT *, position <= 10 AS head FROM pl),
 ct AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY query_id, surface) AS held, row_number() OVER (PARTITION BY query_id, surface, head ORDER BY position) AS nth, row_number() OVER (PARTITION BY query_id, surface, head ORDER BY position DESC) AS from_end FROM hd),
 mv AS (SELECT *, NOT head AND nth <= 2 - held AS comes, head AND from_end <= held - 2 AS goes FROM ct),
 ch AS (SELECT *, least(count(*) FILTER (comes) OVER (PARTITION BY query_id), count(*) FILTER (goes) OVER (PARTITION BY query_id), 5) AS n,
   row_number() OVER (PARTITION BY query_id, comes ORDER BY position) AS c_no, row_number() OVER (PARTITION BY query_id, goes ORDER BY position DESC) AS g_no FROM mv)
 SELECT query_id, record_id, round(score, 6) AS score, retrievers, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, record_id)::INT AS position FROM ch WHERE CASE WHEN head THEN NOT (goes AND g_no <= n) ELSE comes AND c_no <= n END""")
def diversified(spark, d):
    return _shown(fusion.diversify(fusion.fuse(_legs(spark, d)), 10, 2))


@query(_LEGS + """, pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, retrievers DESC, record_id) AS place FROM strong),
 hit AS (SELECT pl.*, coalesce(contains(lower(d.text), an.term), false) AS anchored FROM pl JOIN documents d ON d.doc_id = pl.record_id LEFT JOIN an USING (query_id)),
 ps AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY anchored DESC, place)::INT AS position FROM hit)
 SELECT query_id, record_id, round(score, 6) AS score, retrievers, position FROM ps WHERE position <= 20""")
def anchored_first(spark, d):
    anchors = _anchors(spark, d).withColumnRenamed("term", "anchor")
    return _shown(fusion.anchored_first(fusion.fuse(_legs(spark, d)), _documents(spark, d), anchors, 20))


# graph: suppliers supply parts, customers and suppliers belong to nations, nations to regions


def _edges(spark, d) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    o = table(spark, d, "customer").select(name("customer", "c_custkey").alias("src"), F.lit("IN").alias("predicate"), name("nation", "c_nationkey").alias("dst"))
    s = table(spark, d, "supplier").select(name("supplier", "s_suppkey").alias("src"), F.lit("IN").alias("predicate"), name("nation", "s_nationkey").alias("dst"))
    n = table(spark, d, "nation").select(name("nation", "n_nationkey").alias("src"), F.lit("IN").alias("predicate"), name("region", "n_regionkey").alias("dst"))
    return o.unionByName(s).unionByName(n)


_EDGES = """e AS (SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
 b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"""


def _walk(depth: int) -> str:
    return f"""WITH RECURSIVE {_EDGES},
 k AS (SELECT src AS root, src AS entity_id, 0 AS depth FROM b WHERE src LIKE 'region:%' OR src LIKE 'supplier:%0'
   UNION SELECT k.root, b.dst, k.depth + 1 FROM k JOIN b ON b.src = k.entity_id WHERE k.depth < {depth})
 SELECT root, entity_id, min(depth)::INT AS depth FROM k GROUP BY 1, 2 HAVING min(depth) > 0"""


def _roots(spark, d) -> DataFrame:
    e = _edges(spark, d)
    return e.select(F.col("src").alias("entity_id")).union(e.select("dst")).distinct().filter("entity_id like 'region:%' or entity_id like 'supplier:%0'")


@query(_walk(1))
def graph_expand_1hop(spark, d):
    return graph.expand(_edges(spark, d), _roots(spark, d), 1)


@query(_walk(2))
def graph_expand_2hop(spark, d):
    return graph.expand(_edges(spark, d), _roots(spark, d), 2)


@query("""WITH s AS (SELECT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY 1, 2)
 SELECT src AS root, dst AS entity_id, 1 AS depth FROM s WHERE lo <= TIMESTAMP '1996-06-01' AND hi > TIMESTAMP '1996-06-01' AND src LIKE 'supplier:%0'""")
def graph_expand_valid_at(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_shipdate").alias("valid_from"), F.max("l_shipdate").alias("valid_to"))
    e = s.filter(asof.valid_at(asof.instant("1996-06-01 00:00:00"))).select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst"))
    return graph.expand(e, e.filter("src like 'supplier:%0'").select(F.col("src").alias("entity_id")), 1)


_CHASE = f"""WITH RECURSIVE {ENTITIES}, ids AS (SELECT DISTINCT entity_id FROM entities),
 t AS (SELECT entity_id, max(merged_into_id) AS nx FROM en WHERE merged_into_id IS NOT NULL AND merged_into_id <> entity_id GROUP BY 1),
 tt AS (SELECT * FROM t WHERE nx IN (SELECT entity_id FROM ids)),
 c AS (SELECT entity_id, entity_id AS node, 0 AS n FROM ids UNION ALL SELECT c.entity_id, tt.nx, n + 1 FROM c JOIN tt ON tt.entity_id = c.node WHERE n < 64),
 x AS (SELECT entity_id, max_by(node, n) AS last, max(n) AS n, min(node) AS least FROM c GROUP BY 1),
 canon AS (SELECT entity_id, CASE WHEN n >= 64 THEN least ELSE last END AS canonical_id FROM x)"""


@query(_CHASE + " SELECT entity_id, canonical_id FROM canon")
def canonical_ids(spark, d):
    return graph.canonical(entities(spark, d))


@query(_CHASE + " SELECT canonical_id, count(*) AS members, min(entity_id) AS first_id FROM canon GROUP BY 1 HAVING count(*) > 1")
def identity_clusters(spark, d):
    return graph.canonical(entities(spark, d)).groupBy("canonical_id").agg(F.count("*").alias("members"), F.min("entity_id").alias("first_id")).filter("members > 1")


@query(_CHASE + f", {CLAIMS.replace('c AS (', 'cl AS (', 1)} SELECT canonical_id, count(*) AS claims, count(DISTINCT subject_id) AS subjects FROM cl JOIN canon ON canon.entity_id = cl.subject_id WHERE status IN ('active', 'disputed') GROUP BY 1")
def merged_identity_query(spark, d):
    c = graph.canonical(entities(spark, d)).withColumnRenamed("entity_id", "subject_id")
    believed = claims(spark, d).filter(F.col("status").isin(*asof.BELIEVABLE))
    return believed.join(c, "subject_id").groupBy("canonical_id").agg(F.count("*").alias("claims"), F.countDistinct("subject_id").alias("subjects"))


# resolution: mentions are identifier rows of one source with the names of their entities


def _mentions(spark, d) -> DataFrame:
    e = entities(spark, d).select("entity_id", "canonical_name", "entity_type")
    i = table(spark, d, "entity_identifiers").distinct().join(e, "entity_id")
    up = F.col("kind") == "upstream"
    n = F.ascii(F.substring("identifier_id", 1, 1)) % 4
    hide = lambda c, m: F.when(n == m, F.lit(None)).otherwise(c)
    return i.select(
        F.col("identifier_id").alias("mention_id"), "graph_space_id", F.col("canonical_name").alias("name"), F.when(n == 2, "unknown").otherwise(F.col("entity_type")).alias("entity_type"),
        F.when(up, F.col("id_namespace")).alias("source_namespace"), hide(F.when(up, F.col("id_value")), 1).alias("external_id"),
        F.when(~up, F.col("id_namespace")).alias("key_namespace"), hide(F.when(~up, F.col("id_value")), 1).alias("key_value"),
    )


_ALIAS = "trim(regexp_replace(lower(%s), '\\s+', ' ', 'g'))"
_RESOLVE = f"""WITH {ENTITIES}, idn AS (SELECT DISTINCT * FROM entity_identifiers),
 x AS (SELECT idn.*, canonical_name, entity_type, kind = 'upstream' AS up, ascii(substr(identifier_id, 1, 1)) % 4 AS n FROM idn JOIN en USING (entity_id)),
 m AS (SELECT identifier_id AS mention_id, x.graph_space_id AS g, canonical_name AS name, {_ALIAS % 'canonical_name'} AS alias, CASE WHEN n = 2 THEN 'unknown' ELSE entity_type END AS entity_type,
   CASE WHEN up THEN id_namespace END AS s_ns, lower(trim(CASE WHEN up AND n <> 1 THEN id_value END)) AS s_id, CASE WHEN NOT up THEN id_namespace END AS k_ns, lower(trim(CASE WHEN NOT up AND n <> 1 THEN id_value END)) AS k_id FROM x),
 v AS (SELECT *, lower(trim(id_value)) AS value FROM idn WHERE trim(id_value) <> ''),
 b AS (SELECT graph_space_id AS g, kind, id_namespace AS ns, value, arg_min(entity_id, (created_at, identifier_id, entity_id)) AS bound FROM v WHERE graph_space_id IS NOT NULL AND kind IS NOT NULL AND id_namespace IS NOT NULL GROUP BY 1, 2, 3, 4),
 al AS (SELECT graph_space_id AS g, entity_id AS candidate, canonical_name AS name, {_ALIAS % 'canonical_name'} AS alias, coalesce(entity_type, 'unknown') AS type FROM en WHERE canonical_name IS NOT NULL),
 own AS (SELECT mention_id, g, 'upstream' AS kind, s_ns AS ns, s_id AS mine FROM m WHERE s_id <> '' UNION ALL SELECT mention_id, g, 'domain', k_ns, k_id FROM m WHERE k_id <> ''),
 named AS (SELECT DISTINCT m.mention_id, candidate, m.g FROM m JOIN al ON al.g = m.g AND al.alias = m.alias WHERE m.entity_type IS NULL OR m.entity_type IN ('', 'unknown') OR type = m.entity_type OR type = 'unknown'),
 strange AS (SELECT DISTINCT named.mention_id, candidate FROM named JOIN b ON b.g = named.g AND b.bound = candidate JOIN own ON own.mention_id = named.mention_id AND own.g = named.g AND own.kind = b.kind AND own.ns = b.ns WHERE value <> mine),
 ex AS (SELECT mention_id, min(candidate) AS alias_entity, count(*) AS exact FROM named WHERE NOT EXISTS (SELECT 1 FROM strange s WHERE s.mention_id = named.mention_id AND s.candidate = named.candidate) GROUP BY 1),
 st AS (SELECT m.mention_id, m.name, m.g, bs.bound AS by_source, bk.bound AS by_key, alias_entity, exact FROM m
   LEFT JOIN b bs ON bs.g = m.g AND bs.kind = 'upstream' AND bs.ns = m.s_ns AND bs.value = m.s_id LEFT JOIN b bk ON bk.g = m.g AND bk.kind = 'domain' AND bk.ns = m.k_ns AND bk.value = m.k_id LEFT JOIN ex ON ex.mention_id = m.mention_id),
 op AS (SELECT mention_id, g, {_GRAMS % 'name'} AS qg FROM st WHERE by_source IS NULL AND by_key IS NULL AND exact IS NULL AND name <> ''),
 ag AS (SELECT DISTINCT g, candidate, {_GRAMS % 'name'} AS gr FROM al),
 fz AS (SELECT mention_id, count(DISTINCT candidate) AS fuzzy FROM op JOIN ag ON ag.g = op.g WHERE {_like('gr', 'qg')} >= 0.55 GROUP BY 1),
 rs AS (SELECT st.mention_id, CASE WHEN by_source IS NOT NULL THEN 'source_identifier' WHEN by_key IS NOT NULL THEN 'domain_key' WHEN exact = 1 THEN 'exact_alias' WHEN exact > 1 THEN 'ambiguous' WHEN fuzzy > 0 THEN 'fuzzy_candidates' ELSE 'created' END AS method,
   coalesce(by_source, by_key, CASE WHEN exact = 1 THEN alias_entity END) AS entity_id, CASE WHEN by_source IS NOT NULL THEN 1.0 WHEN by_key IS NOT NULL THEN 0.99 WHEN exact = 1 THEN 0.9 END::DOUBLE AS confidence,
   coalesce(exact, least(fuzzy, 10), 0)::BIGINT AS candidates FROM st LEFT JOIN fz ON fz.mention_id = st.mention_id)"""


@query(_RESOLVE + " SELECT * FROM rs")
def resolve_ladder(spark, d):
    bindings = resolve.first_bindings(table(spark, d, "entity_identifiers").distinct())
    aliases = entities(spark, d).filter("canonical_name is not null").select("graph_space_id", "entity_id", F.col("canonical_name").alias("name"), F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"))
    return resolve.resolve(_mentions(spark, d), bindings, aliases)


@query(_RESOLVE + " SELECT * FROM rs WHERE method IN ('ambiguous', 'fuzzy_candidates')")
def ambiguous_mentions(spark, d):
    return resolve.for_review(resolve_ladder(spark, d))


@query("""WITH i AS (SELECT DISTINCT *, lower(trim(id_value)) AS value FROM entity_identifiers WHERE trim(id_value) <> '')
 SELECT graph_space_id, kind, id_namespace, value, arg_min(entity_id, (created_at, identifier_id, entity_id)) AS entity_id, count(DISTINCT entity_id) - 1 AS conflicts FROM i GROUP BY 1, 2, 3, 4""")
def identifier_bindings(spark, d):
    return resolve.first_bindings(table(spark, d, "entity_identifiers").distinct())


# context


def _candidates(spark, d) -> DataFrame:
    """Believed and past claims about the subjects of open conflicts, a query per graph space."""
    rows = sourced(spark, d).filter("status not in ('quarantined', 'proposed')")
    slots = table(spark, d, "conflict_sets").select("subject_id").distinct()
    rows = rows.join(slots, "subject_id", "left_semi")
    at = asof.instant(VALID)
    names = entities(spark, d).select(F.col("entity_id").alias("subject_id"), F.col("canonical_name").alias("name"))
    rows = rows.join(names, "subject_id", "left")
    content = projection.prompt_text(F.coalesce("name", "subject_id"), F.col("predicate_name"), projection.value_of(F.col("object_key")), F.col("valid_from"), F.col("valid_to"))
    from tidemark.functions import intervals, scores

    return rows.withColumn("content", content).select(
        F.col("graph_space_id").alias("query_id"), F.col("assertion_id").alias("record_id"), context.section(F.col("status"), F.col("conflict_set_id"), F.col("valid_from"), F.col("valid_to"), at, F.lit(False)).alias("section"),
        F.col("confidence").alias("relevance"), "confidence", scores.trust_weight(F.col("trust_level")).alias("evidence"), intervals.temporal_fit("valid_from", "valid_to", at).alias("temporal"), scores.memory_priority(F.col("memory_kind")).alias("priority"),
        text.focus(F.col("content"), ["seat", "tier"]).alias("focus"), F.lit(False).alias("required"), (F.col("status") == "disputed").alias("disputed"), text.token_estimate(F.col("content")).alias("tokens"), text.terms(F.col("content")).alias("terms"),
        F.array("subject_id").alias("subjects"), F.col("predicate_name").alias("predicate"), F.concat_ws("/", "subject_id", "predicate_name").alias("slot"), "object_key", "content",
    )


@query()
def context_selection(spark, d):
    return context.select(_candidates(spark, d), budget=1200)


@query()
def context_block(spark, d):
    rows = _candidates(spark, d)
    return context.render(context.select(rows, budget=1200), rows)


_AT = f"TIMESTAMP '{VALID}'"


@query(f"""WITH {CLAIMS}, n AS (SELECT *, try_cast(regexp_extract(object_key, '^(integer|decimal):(.*)$', 2) AS DECIMAL(38, 6)) AS v FROM c WHERE status IN ('active', 'disputed'))
 SELECT subject_id, predicate_name, arg_min(v, (valid_from, assertion_id)) AS first_value, arg_max(v, (valid_from, assertion_id)) AS last_value, arg_max(v, (valid_from, assertion_id)) - arg_min(v, (valid_from, assertion_id)) AS delta, count(*) AS values
 FROM n WHERE v IS NOT NULL AND valid_from IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def comparison_proof(spark, d):
    return context.comparisons(claims(spark, d).filter(F.col("status").isin(*asof.BELIEVABLE)), ["subject_id", "predicate_name"])


@query(f"""WITH {CLAIMS} SELECT DISTINCT subject_id, predicate_name FROM c x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.subject_id = x.subject_id AND c.predicate_name = x.predicate_name AND status IN ('active', 'disputed')
 AND (valid_from IS NULL OR valid_from <= {_AT}) AND (valid_to IS NULL OR valid_to > {_AT}))""")
def absence_proof(spark, d):
    return context.absences(claims(spark, d), ["subject_id", "predicate_name"], asof.instant(VALID))


_TERMS = "list_distinct(list_filter(list_transform(regexp_split_to_array(lower(%s), '\\s+'), lambda w: regexp_replace(regexp_replace(w, '^[.,;:!?\"''()\\[\\]{}]+', ''), '[.,;:!?\"''()\\[\\]{}]+$', '')), lambda w: length(w) >= 3))"


@query(f"""WITH s AS (SELECT DISTINCT artifact_id, section_no, {_TERMS % 'content'} AS g FROM handbook_sections WHERE content IS NOT NULL), x AS (SELECT *, lead(section_no) OVER w AS next_no, lead(g) OVER w AS h FROM s WINDOW w AS (PARTITION BY artifact_id ORDER BY section_no))
 SELECT artifact_id, section_no, next_no, round({_like('g', 'h')}, 6)::DOUBLE AS redundancy FROM x WHERE next_no IS NOT NULL""")
def redundancy_pairs(spark, d):
    """How much each section repeats the one before it."""
    w = Window.partitionBy("artifact_id").orderBy("section_no")
    s = table(spark, d, "handbook_sections").filter("content is not null").select("artifact_id", "section_no", text.terms(F.col("content")).alias("g")).distinct()
    s = s.withColumn("next_no", F.lead("section_no").over(w)).withColumn("h", F.lead("g").over(w)).filter("next_no is not null")
    return s.select("artifact_id", "section_no", "next_no", F.round(text.jaccard(F.col("g"), F.col("h")), 6).alias("redundancy"))
