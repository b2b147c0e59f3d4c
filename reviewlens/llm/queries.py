"""The registered queries of this package: thin digests of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op1_quality_rules")
def op1_quality_rules(spark, sf_dir):
    from reviewlens.llm import quality
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@register("op9_byte_bpe")
def op9_byte_bpe(spark, sf_dir):
    import public_tokenizers
    from pyspark.sql import functions as F

    from reviewlens.llm import bpe
    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), *vocab), *vocab).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@register("op8_token_records")
def op8_token_records(spark, sf_dir):
    import public_tokenizers
    from pyspark.sql import functions as F

    from reviewlens.llm import records, shared
    folder = shared.new_folder(spark, "records")
    manifest = records.write_records(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"), folder)
    read = records.with_starts(records.read_records(manifest, folder), manifest)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       records.crc32_long("ids").alias("ids_crc32"))


MARKED = "</s>[INST] ok [/INST]"
_ESCAPED = r"replace(replace(replace(replace({}, '\', '\\'), '<', '\l'), '[', '\b'), ']', '\e')"


@register("op4_chat_format", f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{MARKED}' UNION ALL SELECT -7, 1, 'assistant', '{MARKED}')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(11 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT)
         AS formatted_chars
FROM c GROUP BY conv_id
""")
def op4_chat_format(spark, sf_dir):
    from reviewlens.llm import chat
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).selectExpr(
        "-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{MARKED}' AS text")
    return chat.read_back(chat.render(chat.fold(chat.events_from_turns(turns.unionByName(marked)))))


@register("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    from reviewlens.llm import toxicity
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@register("op10_language_id")
def op10_language_id(spark, sf_dir):
    from reviewlens.llm import langid
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


@register("op2_decontaminate")
def op2_decontaminate(spark, sf_dir):
    from reviewlens.llm import decontaminate
    index = decontaminate.build(table(spark, sf_dir, "benchmark"))
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), index)


@register("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    from reviewlens.llm import suffix_dedup
    return suffix_dedup.removed(table(spark, sf_dir, "documents")).drop("kept")


@register("op7_ngram_join")
def op7_ngram_join(spark, sf_dir):
    from reviewlens.llm import ngram_join
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@register("op5_lm_score")
def op5_lm_score(spark, sf_dir):
    from reviewlens.llm import pitman_yor
    docs = table(spark, sf_dir, "documents")
    return pitman_yor.score_documents(docs, pitman_yor.fit(docs))


@register("op13_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op13_exact_dedup(spark, sf_dir):
    from reviewlens.llm import exact_dedup
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@register("op11_collocations", rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
spans AS (SELECT lang, w, i, unnest(range(1, 6)) AS k FROM places),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM spans WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM grams WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM grams WHERE a >= 100),
cuts AS (
  SELECT lang, k, phrase, a, unnest(range(1, k)) AS j, string_split(phrase, ' ') AS w FROM often WHERE k > 1),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.j, x.a AS l, y.a AS r, t.n,
         (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN totals t USING (lang)
  JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ')
  JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
stay AS (
  SELECT * FROM lowest g WHERE NOT EXISTS (
    SELECT 1 FROM often h WHERE h.lang = g.lang AND h.k > g.k AND 100 * h.a >= 100 * g.a
      AND contains(' ' || h.phrase || ' ', ' ' || g.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM stay QUALIFY rank <= 2000
""")
def op11_collocations(spark, sf_dir):
    from reviewlens.llm import collocations
    return collocations.ranked(collocations.mine(table(spark, sf_dir, "documents")))


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({key}) + 1), lambda i: unicode({key}[i])::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
_BLANK = r"\x20\x09-\x0D"


@register("op12_conversation_repair", rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT *, {_CRC32.format(key='key')} % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, role[1] AS c,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS c0,
         regexp_extract(text, '([^{_BLANK}])[{_BLANK}]*$', 1) AS tail FROM placed),
r AS (
  SELECT *, CASE WHEN tail = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN tail NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault
  FROM seen),
rows_of AS (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id),
b AS (
  SELECT conv_id, n + 1 AS i, 0 AS v0, 10 AS v1, 5 AS v2, 0 AS v3 FROM rows_of
  UNION ALL
  SELECT conv_id, i, least(e0, 5 + e2, 10 + e3), least(e1, 5 + e2, 10 + e3), least(e2, 5 + e3), least(e3, 5 + e2)
  FROM (
    SELECT conv_id, i,
           least(2 + v0, CASE c WHEN 's' THEN t + v1 WHEN 'u' THEN t + v2 END, 1 + t + v2) AS e0,
           least(2 + v1, CASE c WHEN 'u' THEN t + v2 END, 1 + t + v2) AS e1,
           least(2 + v2, CASE c WHEN 'a' THEN t + v3 END, 1 + t + v3) AS e2,
           least(2 + v3, CASE c WHEN 'u' THEN t + v2 END, 1 + t + v2) AS e3
    FROM (SELECT b.* EXCLUDE (i), r.i, r.c, CASE fault WHEN '-' THEN 0 WHEN 't' THEN 5 ELSE 1000000000 END AS t
          FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1) x) y),
costs AS (SELECT conv_id, i, [v0, v1, v2, v3] AS v FROM b),
walk AS (
  SELECT conv_id, 1::BIGINT AS i, 0 AS s, '' AS audit, 0 AS cost, []::VARCHAR[] AS said FROM rows_of
  UNION ALL
  SELECT conv_id, CASE e WHEN 'I' THEN i ELSE i + 1 END,
         CASE e WHEN 'D' THEN s WHEN 'K' THEN kept ELSE ins END, audit || e,
         cost + CASE e WHEN 'D' THEN 2 WHEN 'I' THEN 5 WHEN 'K' THEN t ELSE 1 + t END,
         CASE e WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text)
           ELSE list_append(said, CASE ins WHEN 2 THEN 'user:' ELSE 'assistant:' END
                                  || CASE e WHEN 'R' THEN text ELSE '' END) END
  FROM (
    SELECT *, CASE WHEN 2 + w[s + 1] = v[s + 1] THEN 'D' WHEN 5 + v[ins + 1] = v[s + 1] THEN 'I'
                   WHEN t + w[kept + 1] = v[s + 1] THEN 'K' ELSE 'R' END AS e
    FROM (
      SELECT k.*, x.v, y.v AS w, r.role, r.text, CASE k.s WHEN 2 THEN 3 ELSE 2 END AS ins,
             CASE WHEN r.c = 's' AND k.s = 0 THEN 1 WHEN r.c = 'u' AND k.s <> 2 THEN 2 WHEN r.c = 'a' AND k.s = 2 THEN 3 END AS kept,
             CASE r.fault WHEN '-' THEN 0 WHEN 't' THEN 5 ELSE 1000000000 END AS t
      FROM walk k JOIN costs x ON x.conv_id IS NOT DISTINCT FROM k.conv_id AND x.i = k.i
      LEFT JOIN costs y ON y.conv_id IS NOT DISTINCT FROM k.conv_id AND y.i = k.i + 1
      LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM k.conv_id AND r.i = k.i
      WHERE r.i IS NOT NULL OR k.s IN (1, 2)) z) zz),
ended AS (SELECT w.* FROM walk w JOIN rows_of o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = o.n + 1 WHERE w.s IN (0, 3)),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE i > 1 AND c0 || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id
""")
def op12_conversation_repair(spark, sf_dir):
    from reviewlens.llm import repair
    turns = table(spark, sf_dir, "conversations")
    return repair.digest(repair.steps(repair.damage(turns), turns))
