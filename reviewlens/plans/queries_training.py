"""Registered training-table queries (mk1, mk2).

Texts are compared through their md5; labels rounded to 6 places.  mk2 runs
with the .5 / .8 bands (the defaults select 4 and 0 rows at sf0.01) and the
class guard off, since n_bad >= n_helpful there; the guard is unit-tested.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.functions.hashing import sql_normal, sql_randint, sql_sample, sql_uniform
from reviewlens.operators import training_set as TS
from reviewlens.plans.catalog import normalise, register, with_reviews
from reviewlens.sources.tables import reviews

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

MK1_SQL = with_reviews(f"""
act AS (SELECT * FROM reviews WHERE asin IN (SELECT asin FROM reviews GROUP BY asin HAVING sum(inters) > 40)),
rated AS (SELECT asin, doc_id, review_text, (ups + 1.0) / (inters + 3.0) AS ratio FROM act WHERE inters > 3),
cnt AS (SELECT asin, count(*) AS n_rated FROM rated GROUP BY asin HAVING count(*) >= 2),
ranked AS (SELECT r.*, c.n_rated,
             row_number() OVER (PARTITION BY r.asin ORDER BY ratio DESC, doc_id DESC) AS rk_hi,
             row_number() OVER (PARTITION BY r.asin ORDER BY ratio ASC, doc_id ASC) AS rk_lo
           FROM rated r JOIN cnt c ON r.asin = c.asin),
real AS (SELECT asin, 'helpful' AS kind, doc_id AS item, review_text, ratio AS label FROM ranked
         WHERE rk_hi <= least(n_rated // 2, 5)
         UNION ALL
         SELECT asin, 'unhelpful', doc_id, review_text, ratio FROM ranked
         WHERE rk_lo <= least(n_rated // 2, 5)),
per AS (SELECT asin, count(*) AS n_real, sum(label) AS total_help,
               CAST(floor(count(*) / 1.5) AS BIGINT) AS n_fake FROM real GROUP BY asin),
per2 AS (SELECT *, (0.5 * (n_fake + n_real) - total_help) / n_fake AS balance FROM per WHERE n_fake > 0),
pieces AS (SELECT asin, doc_id, (ups + 1.0) / (inters + 3.0) AS ratio, unnest(p) AS piece,
                  generate_subscripts(p, 1) - 1 AS pos
           FROM (SELECT *, string_split(review_text, '.') AS p FROM act)),
sents AS (SELECT asin, doc_id, ratio, pos, {_STRIP.format(x='piece')} AS sentence FROM pieces
          WHERE length(piece) > 20),
nsent AS (SELECT asin, count(*) AS n_sent FROM sents GROUP BY asin),
fakes AS (SELECT p.asin, p.balance, n.n_sent, f.fake,
                 {sql_randint('least(4, n.n_sent)', 'least(20, n.n_sent) + 1', "'0'", "'mk1k'", 'p.asin', 'f.fake')} AS k
          FROM per2 p JOIN nsent n USING (asin),
               LATERAL (SELECT unnest(range(0, p.n_fake)) AS fake) f),
placed AS (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY doc_id, pos) - 1 AS sidx FROM sents),
picks AS (SELECT asin, fake, unnest(d) AS sidx, generate_subscripts(d, 1) AS r FROM (
            SELECT asin, fake, {sql_sample('k', 'n_sent', "'0'", "'mk1s'", 'asin', 'fake')} AS d FROM fakes)),
cand AS (SELECT p.asin, p.fake, p.r, s.sentence, s.ratio FROM picks p JOIN placed s USING (asin, sidx)),
fk AS (SELECT asin, fake, string_agg(sentence, '. ' ORDER BY r) || '.' AS review_text,
              avg(ratio) AS rating FROM cand GROUP BY asin, fake),
fk2 AS (SELECT fk.asin, 'fake' AS kind, fk.fake AS item, fk.review_text,
               greatest(0.0, {sql_normal(0.0, 1.0, "'0'", "'mk1n'", 'fk.asin', 'fk.fake')} * 0.1
                        + fk.rating * f.balance) AS label
        FROM fk JOIN (SELECT DISTINCT asin, fake, balance FROM fakes) f USING (asin, fake))
SELECT asin, kind, item, md5(review_text) AS text_md5, round(label, 6) AS label FROM real
UNION ALL
SELECT asin, kind, item, md5(review_text), round(label, 6) FROM fk2
""")


@register("training_set_mk1", MK1_SQL)
def q_training_set_mk1(spark, sf_dir):
    t = TS.make_dataset_mk1(reviews(spark, sf_dir), seed=0)
    return normalise(t.select("asin", "kind", "item", F.md5("review_text").alias("text_md5"), "label"))


MK2_SQL = with_reviews(f"""
b AS (SELECT doc_id, review_text, inters, ups,
             CASE WHEN inters = 0 THEN NULL ELSE CAST(ups AS DOUBLE) / inters END AS raw,
             (ups + 1.0) / (inters + 3.0) AS smooth FROM reviews),
real AS (SELECT CASE WHEN inters > 4 AND raw < .5 THEN 'unhelpful' ELSE 'helpful' END AS kind,
                doc_id AS item, review_text,
                CASE WHEN inters > 4 AND raw < .5 THEN raw ELSE smooth END AS label
         FROM b WHERE (inters > 4 AND raw < .5) OR (inters > 8 AND smooth > .8)),
nh AS (SELECT count(*) FILTER (WHERE kind = 'helpful') AS n FROM real),
pos AS (SELECT * FROM reviews WHERE overall >= 4 AND asin IN (
          SELECT asin FROM reviews WHERE overall >= 4 GROUP BY asin HAVING count(*) > 15)),
pieces AS (SELECT asin, doc_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS pos
           FROM (SELECT *, string_split(review_text, '.') AS p FROM pos)),
sents AS (SELECT asin, {_STRIP.format(x='piece')} AS sentence,
                 row_number() OVER (PARTITION BY asin ORDER BY doc_id, pos) - 1 AS sidx
          FROM pieces WHERE length(piece) > 30),
prods AS (SELECT asin, count(*) AS n_sent, row_number() OVER (ORDER BY asin) - 1 AS pidx
          FROM sents GROUP BY asin),
np AS (SELECT count(*) AS c FROM prods),
f0 AS (SELECT r.fake, {sql_randint('0', 'np.c', "'0'", "'mk2p'", 'r.fake')} AS pidx
       FROM (SELECT unnest(range(0, (SELECT n FROM nh))) AS fake) r, np),
f1 AS (SELECT f0.fake, p.asin, p.n_sent,
              {sql_randint('least(2, p.n_sent)', 'least(24, p.n_sent) + 1', "'0'", "'mk2k'", 'f0.fake')} AS k,
              {sql_uniform("'0'", "'mk2r'", 'f0.fake')} < .01 AS redraw
       FROM f0 JOIN prods p USING (pidx)),
draws AS (SELECT f1.*, i,
                 {sql_randint('0', 'f1.n_sent', "'0'", "'mk2s'", 'f1.fake', 'i')} AS first_sidx,
                 CASE WHEN redraw THEN {sql_randint('0', 'f1.k', "'0'", "'mk2j'", 'f1.fake', 'i')} ELSE i END AS j
          FROM f1, LATERAL (SELECT unnest(range(0, f1.k)) AS i) x),
picks AS (SELECT d.fake, d.asin, d.i, b.first_sidx AS sidx FROM draws d
          JOIN draws b ON b.fake = d.fake AND b.i = d.j),
fk AS (SELECT p.fake, string_agg(s.sentence, '. ' ORDER BY p.i) || '.' AS review_text
       FROM picks p JOIN sents s ON s.asin = p.asin AND s.sidx = p.sidx GROUP BY p.fake),
alld AS (SELECT kind, item, review_text, label FROM real
         UNION ALL
         SELECT 'fake', fake, review_text, greatest(0.0, {sql_normal(.05, .02, "'0'", "'mk2n'", 'fake')}) FROM fk)
SELECT kind, item, md5(review_text) AS text_md5, round(label, 6) AS label,
       CASE WHEN {sql_uniform("'0'", "'split'", 'kind', 'item')} < 0.8 THEN 'train' ELSE 'val' END AS split
FROM alld WHERE label IS NOT NULL AND review_text IS NOT NULL
""")


@register("training_set_mk2", MK2_SQL)
def q_training_set_mk2(spark, sf_dir):
    t = TS.make_dataset_mk2(reviews(spark, sf_dir), seed=0, bad_ratio=.5, good_ratio=.8,
                            check_balance=False)
    return normalise(t.select("kind", "item", F.md5("review_text").alias("text_md5"), "label", "split"))
