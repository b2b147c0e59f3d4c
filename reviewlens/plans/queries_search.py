"""Registered search and model queries.

Candidates per product are its review sentences longer than 40 characters,
numbered 0..n-1 in (doc_id, pos) order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.functions import text as T
from reviewlens.functions.hashing import sql_free_id, sql_hash32, sql_randint, sql_sample, sql_uniform
from reviewlens.functions.text import length_penalty
from reviewlens.operators import mixture as X
from reviewlens.operators import models as M
from reviewlens.operators import search as S
from reviewlens.operators import topics as P
from reviewlens.operators import training_set as TS
from reviewlens.operators import ward as W
from reviewlens.operators.common import cut_lineage, group_rank, new_path
from reviewlens.operators.text_ops import dot_sentences
from reviewlens.plans.catalog import normalise, register, with_reviews
from reviewlens.plans.queries_vectors import vectors
from reviewlens.sources.tables import reviews

CFG = S.SearchConfig()


def every_candidate(spark, sf_dir):
    """The candidate sentences of all reviews; those without a product are numbered together, under a null ``grp``."""
    r = reviews(spark, sf_dir).select(F.struct("asin").alias("key"), "doc_id", "review_text")  # a struct is not null
    s = dot_sentences(r, "review_text", ["key", "doc_id"], min_chars=40)
    s = group_rank(s, ["key"], ["doc_id", "pos"], name="sidx")
    return s.select(F.col("key.asin").alias("grp"), "sidx", "sentence")


def candidate_sentences(spark, sf_dir):
    return every_candidate(spark, sf_dir).filter("grp IS NOT NULL")


def _cands(spark, sf_dir):
    r = reviews(spark, sf_dir).select("asin", "doc_id", "review_text")
    s = dot_sentences(r, "review_text", ["asin", "doc_id"], min_chars=40)
    return s.groupBy(F.col("asin").alias("grp")).agg(F.count(F.lit(1)).alias("n_cand"))


_CANDS_SQL = """
cands AS (SELECT asin AS grp, count(*) AS n_cand
          FROM (SELECT asin, unnest(string_split(review_text, '.')) AS piece FROM reviews)
          WHERE length(piece) > 40 GROUP BY asin),
inds AS (SELECT grp, n_cand, unnest(range(0, 96)) AS ind FROM cands)
"""
_LEN = sql_randint("5", "20", "'0'", "'len'", "grp", "ind")


@register("length_penalty", with_reviews(_CANDS_SQL + f"""
SELECT grp, ind, {_LEN} AS n_genes,
       round(0.4 + (1 - pow(({_LEN} - 5) / 15.0, 1.5)) * 0.6, 6) AS penalty
FROM inds
"""))
def q_length_penalty(spark, sf_dir):
    pop = S.initial_population(_cands(spark, sf_dir), CFG)
    n = F.size("genes")
    return normalise(pop.select("grp", "ind", n.cast("bigint").alias("n_genes"),
                                length_penalty(n).alias("penalty")))


_POP_SQL = _CANDS_SQL + f""",
pop AS (SELECT grp, n_cand, ind, CASE WHEN {_LEN} <= n_cand
    THEN {sql_sample(_LEN, "n_cand", "'0'", "'new'", "grp", "ind")}
    ELSE list_transform(range(1, {_LEN} + 1), lambda i:
           {sql_randint('0', 'n_cand', "'0'", "'rep'", 'grp', 'ind', 'i')}) END AS genes
FROM inds)
"""


def _sql_crossover(p: str, coin: str) -> str:
    return (f"CASE WHEN {coin} < 0.5 THEN x1[1:{p}] || x2[{p} + 1:len(x2)] "
            f"ELSE x2[1:{p}] || x1[{p} + 1:len(x1)] END")


def _sql_mutate(x: str, *parts: str) -> str:
    """Thirds of replace, remove (not at 5 genes) and add (not at 20)."""
    u, size = sql_uniform(*parts, "'op'"), f"len({x})"
    idx, val = sql_randint("0", size, *parts, "'idx'"), sql_randint("0", "n_cand", *parts, "'val'")
    rm = f"CASE WHEN {size} <= 5 THEN 0.0::DOUBLE ELSE 0.33::DOUBLE END"
    add = f"CASE WHEN {size} > 5 AND {size} >= 20 THEN 0.0::DOUBLE ELSE 0.33::DOUBLE END"
    tot = f"(0.33::DOUBLE + {rm} + {add})"
    return f"""CASE WHEN {u} < 0.33::DOUBLE / {tot}
        THEN {x}[1:{idx}] || [{val}] || {x}[{idx} + 2:{size}]
      WHEN {u} < (0.33::DOUBLE + {rm}) / {tot} THEN {x}[1:{idx}] || {x}[{idx} + 2:{size}]
      ELSE {x}[1:{idx}] || [{val}] || {x}[{idx} + 1:{size}] END"""


def _sql_without_repeats(x: str, *parts: str) -> str:
    at = (f"list_transform({x}, lambda g, i: {{'g': g, 'h': "
          f"{sql_hash32(*parts, chr(39) + 'stay' + chr(39), 'i - 1')}, 'i': i - 1}})")
    again = (f"list_filter({at}, lambda a: len(list_filter({at}, lambda b: b.g = a.g AND "
             f"(b.h < a.h OR (b.h = a.h AND b.i < a.i)))) > 0)")
    free = "(n_cand - len(list_distinct(held)))"
    new = sql_free_id("list_distinct(held)", sql_randint("0", free, *parts, "'fill'", "place[1]"))
    return f"""list_reduce(list_transform({again}, lambda a: [a.i]), lambda held, place:
        CASE WHEN {free} > 0 THEN list_transform(held, lambda g, i:
            CASE WHEN i - 1 = place[1] THEN {new} ELSE g END) ELSE held END, {x})"""


@register("initial_population", with_reviews(_POP_SQL + """
SELECT grp, ind, array_to_string(genes, ' ') AS genes FROM pop
"""))
def q_initial_population(spark, sf_dir):
    pop = S.initial_population(_cands(spark, sf_dir), CFG)
    return pop.select("grp", "ind", F.array_join(F.col("genes").cast("array<string>"), " ").alias("genes"))


def _scored_population(spark, sf_dir):
    """Initial population with a cheap, deterministic fitness (candidate length
    share), used by the single-step operators below."""
    cands = _cands(spark, sf_dir)
    pop = S.initial_population(cands, CFG)
    fit = (F.size("genes") / F.lit(20.0)) * (F.lit(1.0) - F.col("ind") / F.lit(200.0))
    return pop.withColumn("fitness", fit), cands


_FIT = "(len(genes) / 20.0::DOUBLE) * (1.0::DOUBLE - ind / 200.0::DOUBLE)"
_W = "(a.fitness * b.fitness + 0.1::DOUBLE)"


def _sql_parents(n_pairs: int) -> str:
    u = f"(({sql_hash32(chr(39) + '0' + chr(39), chr(39) + '0' + chr(39), chr(39) + 'sel' + chr(39), 'a.grp', 'a.ind', 'b.ind')} + 1) / 4294967297.0::DOUBLE)"
    return f""",
scored AS (SELECT *, {_FIT} AS fitness FROM pop),
parents AS (SELECT a.grp, row_number() OVER (PARTITION BY a.grp ORDER BY -ln({u}) / {_W}, a.ind, b.ind) - 1 AS child,
              a.ind AS i, b.ind AS j
            FROM scored a JOIN scored b ON a.grp = b.grp AND a.ind >= b.ind
            QUALIFY child < {n_pairs})
"""


def _sql_breed(crossings: str) -> str:
    """CTEs from (grp, child, n_cand, x1, x2) to kids (grp, child, genes)."""
    parts = ("'0'", "'0'", "grp", "child")
    p = sql_randint("0", "least(len(x1), len(x2))", *parts, "'cx'")
    return f""",
crossings AS ({crossings}),
crossed AS (SELECT grp, child, n_cand, {_sql_crossover(p, sql_uniform(*parts, "'coin'"))} AS x FROM crossings),
mutated AS (SELECT grp, child, n_cand, {_sql_mutate('x', *parts)} AS x FROM crossed),
kids AS (SELECT grp, child, {_sql_without_repeats('x', *parts)} AS genes FROM mutated)
"""


_NEIGHBOURS = """SELECT a.grp, a.ind AS child, a.n_cand, a.genes AS x1, b.genes AS x2
                 FROM pop a JOIN pop b ON a.grp = b.grp AND b.ind = a.ind + 1"""


def _neighbours(pop, cands):
    a = pop.select("grp", F.col("ind").alias("child"), F.col("genes").alias("x1"))
    b = pop.select("grp", (F.col("ind") - 1).alias("child"), F.col("genes").alias("x2"))
    return a.join(b, ["grp", "child"]).join(cands, "grp")


def _joined(genes):
    return F.array_join(genes.cast("array<string>"), " ")


@register("select_parents", with_reviews(_POP_SQL + _sql_parents(91) + "SELECT grp, child, i, j FROM parents"))
def q_select_parents(spark, sf_dir):
    """G3 + G4: 91 weighted parent pairs per product (i >= j)."""
    pop, _ = _scored_population(spark, sf_dir)
    return S.selection_pairs(pop, CFG.population - CFG.n_elite, CFG.seed, 0)


@register("crossover", with_reviews(_POP_SQL + f"""
SELECT grp, child AS ind, len(x1) AS n1, len(x2) AS n2, array_to_string({_sql_crossover(
    sql_randint("0", "least(len(x1), len(x2))", "'0'", "'0'", "grp", "child", "'cx'"),
    "(child % 2 / 2.0 + 0.25)")}, ' ') AS child
FROM ({_NEIGHBOURS})
"""))
def q_crossover(spark, sf_dir):
    """Children of consecutive individuals (ind, ind + 1)."""
    j = _neighbours(*_scored_population(spark, sf_dir))
    point = S.crossover_point(F.col("x1"), F.col("x2"), 0, 0, F.col("grp"), F.col("child"), "cx")
    child = S.crossover(F.col("x1"), F.col("x2"), point, F.col("child").cast("double") % 2 / 2.0 + .25)
    return normalise(j.select("grp", F.col("child").alias("ind"), F.size("x1").alias("n1"),
                              F.size("x2").alias("n2"), _joined(child).alias("child")))


@register("mutate", with_reviews(_POP_SQL + f"""
SELECT grp, ind, len(genes) AS n_before, len(x) AS n_after, array_to_string(x, ' ') AS genes
FROM (SELECT *, {_sql_mutate("genes", "'0'", "'0'", "grp", "ind", "'mut'")} AS x FROM pop)
"""))
def q_mutate(spark, sf_dir):
    """One mutation of every individual; length stays in 5..20."""
    pop, cands = _scored_population(spark, sf_dir)
    m = S.mutate(F.col("genes"), F.col("n_cand"), CFG, 0, 0, F.col("grp"), F.col("ind"), "mut")
    j = pop.join(cands, "grp").withColumn("x", m)
    return normalise(j.select("grp", "ind", F.size("genes").alias("n_before"), F.size("x").alias("n_after"),
                              _joined(F.col("x")).alias("genes")))


@register("dedupe_genes", with_reviews(_POP_SQL + f"""
SELECT grp, ind, len(list_distinct(doubled)) AS distinct_before, len(list_distinct(x)) AS distinct_after,
       array_to_string(x, ' ') AS genes
FROM (SELECT *, {_sql_without_repeats("doubled", "'0'", "grp", "ind")} AS x
      FROM (SELECT *, genes || genes[1:3] AS doubled FROM pop))
"""))
def q_dedupe_genes(spark, sf_dir):
    """Duplicates of a doubled individual replaced by unused candidates."""
    pop, cands = _scored_population(spark, sf_dir)
    j = pop.join(cands, "grp").withColumn("doubled", F.concat("genes", F.slice("genes", 1, 3)))
    j = j.withColumn("x", S.without_repeats(F.col("doubled"), F.col("n_cand"), 0, F.col("grp"), F.col("ind")))
    return normalise(j.select("grp", "ind", F.size(F.array_distinct("doubled")).alias("distinct_before"),
                              F.size(F.array_distinct("x")).alias("distinct_after"),
                              _joined(F.col("x")).alias("genes")))


@register("breed_children", with_reviews(_POP_SQL + _sql_breed(_NEIGHBOURS) + """
SELECT grp, child AS ind, len(genes) AS n_genes, len(list_distinct(genes)) AS n_distinct,
       array_to_string(genes, ' ') AS genes
FROM kids
"""))
def q_breed_children(spark, sf_dir):
    """G5 + G6 + G7 in one step: children of pairs (ind, ind + 1)."""
    kids = S.breed(_neighbours(*_scored_population(spark, sf_dir)), CFG, 0)
    return normalise(kids.select("grp", F.col("child").alias("ind"), F.size("genes").alias("n_genes"),
                                 F.size(F.array_distinct("genes")).alias("n_distinct"),
                                 _joined(F.col("genes")).alias("genes")))


_PAIRED = """SELECT p.grp, p.child, a.n_cand, a.genes AS x1, b.genes AS x2 FROM parents p
             JOIN pop a ON a.grp = p.grp AND a.ind = p.i JOIN pop b ON b.grp = p.grp AND b.ind = p.j"""


@register("next_generation", with_reviews(_POP_SQL + _sql_parents(91) + _sql_breed(_PAIRED) + """
SELECT grp, ind, array_to_string(genes, ' ') AS genes FROM (
  SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY fitness DESC, scored.ind) - 1 AS ind, genes
  FROM scored QUALIFY row_number() OVER (PARTITION BY grp ORDER BY fitness DESC, scored.ind) <= 5
  UNION ALL SELECT grp, child + 5, genes FROM kids)
"""))
def q_next_generation(spark, sf_dir):
    """5 elites and 91 children of every product."""
    pop, cands = _scored_population(spark, sf_dir)
    nxt = S.next_generation(pop, cands, CFG, 0)
    return nxt.select("grp", "ind", _joined(F.col("genes")).alias("genes"))


def _helpfulness_model(spark, sf_dir):
    """Scorer for the search: fit on every review, labelled with its smoothed vote ratio."""
    from reviewlens.operators.votes import smoothed_ratio
    train = reviews(spark, sf_dir).select("review_text", smoothed_ratio().alias("label"))
    return M.fit_helpfulness(train, max_iter=10)


@register("helpfulness_model_mae")
def q_helpfulness_model_mae(spark, sf_dir):
    """M11 + M12 + F22 + S14: fit on mk2's train split, save and reload the
    model (shared checkpoint folder), MAE on the validation split."""
    data = TS.make_dataset_mk2(reviews(spark, sf_dir), seed=0, bad_ratio=.5, good_ratio=.8,
                               check_balance=False)
    model = M.fit_helpfulness(data.filter("split = 'train'"), max_iter=10)
    path = new_path(spark, "model")
    M.save_model(model, path)
    loaded = M.load_model(path)
    pred = M.score(loaded, data.filter("split = 'val'"), text_col="review_text")
    return M.mae(pred)


@register("genetic_summary")
def q_genetic_summary(spark, sf_dir):
    """G1 + G2 + G8 + J11 + F8: 96 x 10 generations per product, scored by the
    helpfulness model times the length penalty; best candidate per product."""
    model = _helpfulness_model(spark, sf_dir)
    sents = candidate_sentences(spark, sf_dir)
    best = S.genetic_search(sents, lambda df: M.score(model, df), CFG).filter("rank = 1")
    texts = S.candidate_texts(best, sents)
    return best.join(texts, ["grp", "ind"]).select(
        F.col("grp").alias("asin"), "fitness", F.size("genes").alias("n_sentences"), "text")


LOCAL_STEPS = 10


@register("local_search_summary")
def q_local_search_summary(spark, sf_dir, k_max: int = LOCAL_STEPS):
    """G9 + G10: annealing and Metropolis local search of every product's 96 individuals, ``k_max`` steps
    each; both share the memo of scored states."""
    model = _helpfulness_model(spark, sf_dir)
    sents = cut_lineage(candidate_sentences(spark, sf_dir))
    scorer = lambda df: M.score(model, df)
    memo = S.Memo()
    found = [S.local_search(sents, scorer, CFG, k_max, S.Strategy(acceptance=a), memo=memo).withColumn("method", F.lit(name))
             for name, a in (("anneal", S.annealing), ("metropolis", S.metropolis()))]
    return found[0].unionByName(found[1]).filter("rank = 1").select(
        "method", F.col("grp").alias("asin"), "fitness", F.size("genes").alias("n_sentences"))


@register("kmeans")
def q_kmeans(spark, sf_dir):
    return M.kmeans_labels(vectors(spark, sf_dir).drop("label"), "vec", 10).select("vec_id", "label")


@register("hierarchical")
def q_hierarchical(spark, sf_dir):
    """M7: Ward's dendrogram of all vectors, cut at 10 clusters."""
    v = vectors(spark, sf_dir).select(F.lit("all").alias("grp"), "vec_id", "vec")
    merges = cut_lineage(W.ward(v, ["grp"], "vec_id"))
    return W.cut(v, merges, ["grp"], "vec_id", 10).select("vec_id", "label")


@register("ward_dendrogram")
def q_ward_dendrogram(spark, sf_dir):
    """M7: the merges of each product's vectors."""
    v = vectors(spark, sf_dir).select("grp", "vec_id", "vec")
    return normalise(W.ward(v, ["grp"], "vec_id").select("grp", "id", "gone", "height", "size"))


@register("gmm")
def q_gmm(spark, sf_dir):
    """M5: weights and means (in the space of the vectors) of five components."""
    _, comps = M.gmm(vectors(spark, sf_dir).drop("label"), "vec", 5)
    return comps.select("label", F.round("weight", 6).alias("weight"), F.size("mean").alias("dims"))


@register("bayes_gmm")
def q_bayes_gmm(spark, sf_dir):
    """M6: a variational mixture of five components from k-means labels; each vector's component."""
    start = M.kmeans_labels(vectors(spark, sf_dir).drop("label"), "vec", 5)
    model = X.fit(start, "vec", 5, start="label", max_iter=10)
    return normalise(X.assign(start, "vec", model, "vec_id"))


@register("cluster_topics")
def q_cluster_topics(spark, sf_dir):
    """M8: 2 topics x 5 words of every cluster of sentences (labels from embeddings)."""
    from reviewlens.plans.queries_vectors import q_labelled_sentences
    words = F.regexp_extract_all(F.lower("sentence"), F.lit(T.WORD_PATTERN), 0)
    bag = (q_labelled_sentences(spark, sf_dir).select("label", F.col("sentence_id").alias("doc"), F.explode(words).alias("word"))
           .filter((F.length("word") > 1) & ~F.col("word").isin(T.STOP_WORDS))
           .groupBy("label", "doc", "word").agg(F.count(F.lit(1)).alias("n")))
    return P.top_words(P.fit(bag)).groupBy("label", "topic").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " ").alias("words"))


@register("encode_sentences")
def q_encode_sentences(spark, sf_dir):
    """M9: unit-length hashed TF-IDF vectors of every candidate sentence."""
    sents = every_candidate(spark, sf_dir)
    enc = M.encode_sentences(sents, "sentence")
    from reviewlens.functions.vectors import norm
    return normalise(enc.select("grp", "sidx", F.size("vec").alias("dims"), norm(F.array_remove("vec", 0.0)).alias("norm"), "vec"))


@register("summarise_all_products")
def q_summarise_all_products(spark, sf_dir):
    """§3.1 end to end for every product of two datasets (English and other reviews) in one job: summaries
    written as JSON per dataset (S12/S13), read back and scored with ROUGE against the most helpful review."""
    from reviewlens.operators.rouge import ROUGE_TYPES
    from reviewlens.plans import summariser as U
    from reviewlens.plans.queries_rouge import summary_pairs
    from reviewlens.plans.stages import Stages
    root = new_path(spark, "summaries")
    source = reviews(spark, sf_dir).select(
        F.when(F.col("asin").endswith("-en"), "english").otherwise("other").alias("dataset"), "asin", "doc_id", "review_text", "ups", "inters")
    found = U.summarise(cut_lineage(source), U.SummariseConfig(), Stages(spark, f"{root}/stages"))
    U.write_summaries(found, f"{root}/json")
    back = cut_lineage(U.read_summaries(spark, f"{root}/json"))
    scores = U.evaluate(back, summary_pairs(spark, sf_dir).select("asin", "ref"))
    return (scores.groupBy("asin").pivot("rouge_type", list(ROUGE_TYPES)).agg(F.first("f"))
            .join(back.select("dataset", "asin", F.length("summary").cast("bigint").alias("summary_chars")), "asin"))
