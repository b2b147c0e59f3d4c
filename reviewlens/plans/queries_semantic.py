"""Registered queries of the soft-cosine family.

Sentences are the turns of ``conversations``, numbered in (conv_id, turn) order; a sentence's vector and
cluster are those of its number (modulo the number of vectors).  The second model reverses the vectors and
labels by ``number % 7``.  Word vectors come from the md5 of the word.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.functions.hashing import sql_randint
from reviewlens.operators import soft_cosine as SC
from reviewlens.operators.common import cut_lineage, dense_index
from reviewlens.plans.catalog import normalise, register
from reviewlens.plans.queries_io import SQL_WORD_VECTOR, md5_vector
from reviewlens.plans.queries_text import SQL_STOP_WORDS, sql_whitespace_tokens
from reviewlens.sources.tables import table

THRESHOLD, EXPONENT, N_BEST = 0.5, 2.0, 20


def sentences(spark, sf_dir):
    """doc, text, vec, label of every turn; only the keys are moved to number the turns."""
    cv = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    ids = dense_index(cv.select("conv_id", "turn"), ["conv_id", "turn"], name="doc")
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    n = max(e.count(), 1)
    vectors = e.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("bigint").alias("label"))
    return (cv.join(ids, ["conv_id", "turn"]).withColumn("vec_id", F.col("doc") % n).join(vectors, "vec_id")
            .select("doc", "conv_id", "turn", "text", "vec", "label"))


def similar_words(bag):
    words = bag.select("word").distinct()
    return cut_lineage(SC.term_similarity(words.select("word", md5_vector(F.col("word")).alias("vec")),
                                          THRESHOLD, EXPONENT, N_BEST))


SENTENCES = f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS doc FROM conversations),
sentences AS (SELECT doc, conv_id, turn, text, embedding::DOUBLE[] AS vec, label::BIGINT AS label
              FROM numbered JOIN embeddings ON vec_id = doc % (SELECT count(*) FROM embeddings)),
bag AS (SELECT doc, w AS word, count(*) AS n FROM (
          SELECT doc, unnest(list_filter({sql_whitespace_tokens('text')}, lambda t: NOT list_contains({SQL_STOP_WORDS}, t))) AS w
          FROM sentences) GROUP BY doc, w)
"""
SIMILAR = f"""
wv AS (SELECT w AS word, {SQL_WORD_VECTOR} AS v FROM (SELECT DISTINCT word AS w FROM bag)),
close AS (SELECT a.word, b.word AS other, list_cosine_similarity(a.v, b.v) AS cos FROM wv a JOIN wv b ON a.word <> b.word
          WHERE round(list_cosine_similarity(a.v, b.v), 9) >= {THRESHOLD}),
near AS (SELECT * FROM close QUALIFY row_number() OVER (PARTITION BY word ORDER BY round(cos, 9) DESC, other) <= {N_BEST}),
similar_words AS (SELECT a.word, a.other, pow(greatest(0.0, a.cos), {EXPONENT}) AS sim
                  FROM near a JOIN near b ON a.word = b.other AND a.other = b.word
                  UNION ALL SELECT word, word, 1.0 FROM wv),
spread AS (SELECT doc, s.other AS word, sum(b.n * s.sim) AS weight FROM bag b JOIN similar_words s USING (word) GROUP BY doc, s.other),
norms AS (SELECT doc, sqrt(sum(s.weight * b.n)) AS norm FROM spread s JOIN bag b USING (doc, word) GROUP BY doc)
"""


@register("term_similarity", f"""
WITH {SENTENCES.strip()},
{SIMILAR.strip()}
SELECT word, other, round(sim, 6) AS sim FROM similar_words
""")
def q_term_similarity(spark, sf_dir):
    """the similarity table of all words of the sentences."""
    return normalise(similar_words(SC.bags(sentences(spark, sf_dir), "text", ["doc"])))


@register("soft_cosine", f"""
WITH {SENTENCES.strip()},
{SIMILAR.strip()},
pairs AS (SELECT x.doc AS a, y.doc AS b FROM sentences x JOIN sentences y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1),
products AS (SELECT a, b, sum(s.weight * g.n) AS product FROM pairs JOIN spread s ON s.doc = a
             JOIN bag g ON g.doc = b AND g.word = s.word GROUP BY a, b)
SELECT a, b, round(least(1.0, coalesce(product / (x.norm * y.norm), 0.0)), 6) AS similarity
FROM pairs LEFT JOIN products USING (a, b) LEFT JOIN norms x ON x.doc = a LEFT JOIN norms y ON y.doc = b
""")
def q_soft_cosine(spark, sf_dir):
    """soft cosine of every two turns that follow each other."""
    s = sentences(spark, sf_dir)
    bag = cut_lineage(SC.bags(s, "text", ["doc"]))
    a = s.select("conv_id", F.col("turn"), F.col("doc").alias("a"))
    b = s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("doc").alias("b"))
    return normalise(SC.soft_cosine(cut_lineage(a.join(b, ["conv_id", "turn"]).select("a", "b")), bag, similar_words(bag)))


_ASKED = """
own AS (SELECT corpus, doc, word, n, norm FROM bag JOIN norms USING (doc) JOIN members USING (doc)),
words AS (SELECT DISTINCT corpus, word FROM own),
known AS (SELECT query, corpus, word, n FROM asked JOIN words USING (corpus, word)),
wide AS (SELECT k.query, k.corpus, s.other AS word, sum(k.n * s.sim) AS weight FROM known k
         JOIN similar_words s USING (word) JOIN words w ON w.corpus = k.corpus AND w.word = s.other GROUP BY k.query, k.corpus, s.other),
qn AS (SELECT query, corpus, sqrt(sum(w.weight * k.n)) AS norm FROM wide w JOIN known k USING (query, corpus, word) GROUP BY query, corpus),
scored AS (SELECT query, corpus, doc, least(1.0, sum(w.weight * o.n) / (any_value(qn.norm) * any_value(o.norm))) AS similarity
           FROM wide w JOIN own o USING (corpus, word) JOIN qn USING (query, corpus) GROUP BY query, corpus, doc),
best AS (SELECT *, row_number() OVER (PARTITION BY query, corpus ORDER BY round(similarity, 9) DESC, doc) AS rank
         FROM scored QUALIFY rank <= 10),
top3 AS (SELECT query, corpus, sum(similarity) / 3 AS score FROM best WHERE rank <= 3 GROUP BY query, corpus)
"""


@register("soft_cosine_top3", f"""
WITH {SENTENCES.strip()},
{SIMILAR.strip()},
members AS (SELECT label AS corpus, doc FROM sentences),
asked AS (SELECT doc AS query, label AS corpus, word, n FROM bag JOIN sentences USING (doc)),
{_ASKED.strip()}
SELECT query, corpus, round(coalesce(score, 0.0), 6) AS score
FROM (SELECT DISTINCT query, corpus FROM asked) LEFT JOIN top3 USING (query, corpus)
""")
def q_soft_cosine_top3(spark, sf_dir):
    """Every sentence against the corpus of its cluster."""
    s = cut_lineage(sentences(spark, sf_dir).select("doc", "text", "label"))
    bag = cut_lineage(SC.bags(s, "text", ["doc"]))
    similar = similar_words(bag)
    members = s.select(F.col("label").alias("corpus"), "doc")
    index = SC.corpus_index(bag, members, similar)
    asked = bag.join(members, "doc").select(F.col("doc").alias("query"), "corpus", "word", "n")
    return normalise(SC.corpus_similarity(asked, index, similar))


@register("cluster_dictionaries", f"""
WITH {SENTENCES.strip()}
SELECT label AS corpus, word, row_number() OVER (PARTITION BY label ORDER BY word) - 1 AS idx,
       count(*) AS docs, CAST(sum(n) AS BIGINT) AS total
FROM bag JOIN sentences USING (doc) GROUP BY label, word
""")
def q_cluster_dictionaries(spark, sf_dir):
    """A dictionary of each cluster's sentences."""
    s = sentences(spark, sf_dir).select("doc", "text", F.col("label").alias("corpus"))
    return SC.dictionaries(SC.bags(s, "text", ["doc", "corpus"]))


_N = 200


@register("stratified_corpus", f"""
WITH {SENTENCES.strip()},
sizes AS (SELECT label, count(*) AS size FROM sentences GROUP BY label),
shares AS (SELECT *, {_N} / count(*) OVER () AS even, {_N} * size / sum(size) OVER () AS prop FROM sizes),
dealt AS (SELECT 'even' AS how, label, size, even AS share FROM shares UNION ALL SELECT 'proportional', label, size, prop FROM shares),
quotas AS (SELECT how, label, size, CAST(floor(share) + CASE WHEN row_number() OVER (
             PARTITION BY how ORDER BY round(share - floor(share), 9) DESC, size DESC, label)
             <= {_N} - sum(floor(share)) OVER (PARTITION BY how) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM dealt),
draws AS (SELECT how, label, size, unnest(range(0, quota)) AS m FROM quotas),
drawn AS (SELECT how, label, {sql_randint('0', 'size', "'0'", 'label', 'm')} AS rank FROM draws),
ranked AS (SELECT label, doc, row_number() OVER (PARTITION BY label ORDER BY doc) - 1 AS rank FROM sentences)
SELECT how, label, doc, count(*) AS times FROM drawn JOIN ranked USING (label, rank) GROUP BY how, label, doc
""")
def q_stratified_corpus(spark, sf_dir):
    """200 sentences drawn from the clusters, with equal and with proportional quotas."""
    s = cut_lineage(sentences(spark, sf_dir).select("doc", "label"))
    how = {"even": False, "proportional": True}
    parts = [SC.stratified_corpus(s, "doc", _N, proportional=p).withColumn("how", F.lit(name)) for name, p in how.items()]
    return parts[0].unionByName(parts[1]).select("how", "label", "doc", "times")


@register("corpus_comparison", f"""
WITH {SENTENCES.strip()},
{SIMILAR.strip()},
labels AS (SELECT 'first' AS model, doc, label, vec FROM sentences UNION ALL SELECT 'second', doc, doc % 7, list_reverse(vec) FROM sentences),
members AS (SELECT model || '/' || label AS corpus, doc FROM labels),
cells AS (SELECT model, label, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM labels),
centres AS (SELECT model, label, list(x ORDER BY dim) AS centre
            FROM (SELECT model, label, dim, avg(x) AS x FROM cells GROUP BY ALL) GROUP BY model, label),
ranked AS (SELECT model, label, doc, row_number() OVER (PARTITION BY model, label ORDER BY list_distance(vec, centre), doc) - 1 AS rank,
                  count(*) OVER (PARTITION BY model, label) AS size FROM labels JOIN centres USING (model, label)),
chosen AS (SELECT *, 'near' AS zone FROM ranked WHERE rank < 3
           UNION ALL SELECT *, 'mid' FROM ranked WHERE rank >= size // 2 - 1 AND rank < size // 2 + 2
           UNION ALL SELECT *, 'far' FROM ranked WHERE rank >= size - 3),
asked AS (SELECT doc AS query, corpus, word, n FROM (SELECT DISTINCT doc FROM chosen) JOIN members USING (doc) JOIN bag USING (doc)),
{_ASKED.strip()}
SELECT model, label AS cluster, zone, doc, round(coalesce(a.score, 0.0), 6) AS own, round(coalesce(b.score, 0.0), 6) AS other
FROM chosen c LEFT JOIN top3 a ON a.query = c.doc AND split_part(a.corpus, '/', 1) = c.model
LEFT JOIN top3 b ON b.query = c.doc AND split_part(b.corpus, '/', 1) <> c.model
""")
def q_corpus_comparison(spark, sf_dir):
    """J13 + M15: near, middle and far members of both models' clusters against their own corpus and the other model's."""
    s = cut_lineage(sentences(spark, sf_dir).select("doc", "text", "vec", "label"))
    bag = cut_lineage(SC.bags(s, "text", ["doc"]))
    models = {"first": s.select("doc", "vec", "label"),
              "second": s.select("doc", F.reverse("vec").alias("vec"), (F.col("doc") % 7).alias("label"))}
    return normalise(SC.semantic_comparison(models, bag, similar_words(bag)).select(
        "model", "cluster", "zone", "doc", "own", "other"))
