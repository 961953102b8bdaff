"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.llm import bpe, decontaminate, embedding_dedup, features, html_text, jaccard_join, line_dedup, quality, shard_tree, spelling, token_align, token_files, topk, toxicity
from tablewise.llm.common import documents, stage, work_folder


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_chars=20, min_docs=3)
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return out.select("doc_id", "n_lines", "n_dropped", kept)


def op2_shard_tree(spark, sf_dir):
    rows = shard_tree.assign(documents(spark, sf_dir), shard_tree.standard_tree(40))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_token_files(spark, sf_dir):
    folder = work_folder(spark, "token-files")
    token_files.write(documents(spark, sf_dir), folder, word_tokenizer(), end_id=2)
    return token_files.read_checksums(spark, folder)


def op4_topk(spark, sf_dir):
    return topk.search(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""


def op5_html_text(spark, sf_dir):
    return html_text.extract(documents(spark, sf_dir, "pages"))


def op6_jaccard_join(spark, sf_dir):
    return jaccard_join.link(documents(spark, sf_dir), width=4, percent=85)


def _classified(scores, threshold):
    return scores.select(
        "doc_id", features.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op7_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return _classified(toxicity.score(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels"))), 0.5)


def op8_decontaminate(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.find_leaks(docs, documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op9_quality(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return _classified(quality.score(docs, quality.fit(docs, documents(spark, sf_dir, "labels"))), 0.3)


def op10_bpe(spark, sf_dir):
    out = bpe.encode_and_decode(documents(spark, sf_dir).select("doc_id", "text"), word_tokenizer())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_token_align(spark, sf_dir):
    import public_tokenizers

    ranks, json, model = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
    out = token_align.align(documents(spark, sf_dir).select("doc_id", "text"), ranks, json, model, public_tokenizers.PATTERN)
    out = out.withColumn("groups_sha256", token_align.digest(F.col("groups"))).drop("text", "groups")
    out = stage(out.withColumn("row", F.monotonically_increasing_id()), "token-align")
    sums = token_align.counted(out, *token_align.sizes(ranks, model), row="row")
    return out.drop("pairs", "times").join(sums, "row").drop("row")


def op12_embedding_dedup(spark, sf_dir):
    out = embedding_dedup.near_duplicates(documents(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.9)
    return out.select("vec_id", "n_links", "component_id", "kept")


OP12_SQL = """
WITH RECURSIVE
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
          UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op13_spelling_variants(spark, sf_dir):
    return spelling.group(spelling.words_of(documents(spark, sf_dir), every=31))


OP13_SQL = """
WITH RECURSIVE
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]{7,}')) AS run FROM documents),
l AS (SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM r GROUP BY ALL),
k AS (SELECT row_number() OVER () AS id, w, n,
        flatten(list_transform(string_split(doc || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b
      FROM l),
tab AS (SELECT range AS i, 0 AS k, CAST(range AS BIGINT) AS c FROM range(256)
        UNION ALL SELECT i, k + 1, CAST(xor(c >> 1, 3988292384 * (c & 1)) AS BIGINT) FROM tab WHERE k < 8),
t8 AS (SELECT i, c FROM tab WHERE k = 8),
crc AS (SELECT id, 0 AS j, 4294967295::BIGINT AS c FROM k
        UNION ALL SELECT crc.id, j + 1, CAST(xor(crc.c >> 8, t8.c) AS BIGINT)
        FROM crc JOIN k USING (id) JOIN t8 ON t8.i = xor(crc.c, k.b[j + 1]) & 255 WHERE j < len(k.b)),
h AS (SELECT k.w, k.n, xor(crc.c, 4294967295) AS h FROM k JOIN crc ON crc.id = k.id AND crc.j = len(k.b)),
e AS (SELECT CASE WHEN h % 31 = 0 THEN w[: h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS w, n FROM h),
v AS (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
s AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
cut AS (SELECT word, n, i, word[: i - 1] AS a, word[i + 1 :] AS z FROM s),
pairs AS (
  SELECT x.word, x.n, y.word AS o, y.n AS o_n FROM cut x JOIN cut y ON x.a = y.a AND x.z = y.z AND x.i = y.i AND x.word <> y.word
  UNION SELECT c.word, c.n, v.word, v.n FROM cut c JOIN v ON v.word = c.a || c.z
  UNION SELECT v.word, v.n, c.word, c.n FROM cut c JOIN v ON v.word = c.a || c.z),
near AS (SELECT word, count(*) AS n_near, arg_min(o, {'a': -o_n, 'b': encode(o)}) AS o, max(o_n) AS o_n FROM pairs GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN o_n >= 10 * n THEN o END AS form, CASE WHEN o_n >= 10 * n THEN o_n END AS form_n
      FROM v LEFT JOIN near USING (word)),
way AS (SELECT word, coalesce(form, word) AS root, form IS NOT NULL AS more FROM f
        UNION ALL SELECT way.word, coalesce(f.form, f.word), f.form IS NOT NULL FROM way JOIN f ON f.word = way.root WHERE more)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN way ON way.word = f.word AND NOT more
"""


QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_shard_tree": op2_shard_tree, "op3_token_files": op3_token_files, "op4_topk": op4_topk, "op5_html_text": op5_html_text, "op6_jaccard_join": op6_jaccard_join, "op7_toxicity": op7_toxicity, "op8_decontaminate": op8_decontaminate, "op9_quality": op9_quality, "op10_bpe": op10_bpe, "op11_token_align": op11_token_align, "op12_embedding_dedup": op12_embedding_dedup, "op13_spelling_variants": op13_spelling_variants}
SQL: dict[str, str] = {"op4_topk": OP4_SQL, "op12_embedding_dedup": OP12_SQL, "op13_spelling_variants": OP13_SQL}
