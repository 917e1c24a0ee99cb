"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import bloom_lookup, crf_quality, decontaminate, language_id, lsh_forest, packing, personal_data, ppm, spelling, substrings, tool_calls, warc, whitening

from cadenza.llm.common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = (crc_mod(F.col("doc_id"), language_id.FOLD) == language_id.HELD_OUT).alias("held_out")
    return language_id.predict(docs, language_id.learn(docs)).select("doc_id", held_out, "lang_pred", "score")


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.digest(packing.pack_documents(_table(spark, sf_dir, "documents"), path))


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.summary(warc.build_derivatives(_table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def op5_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = crf_quality.score(docs, crf_quality.learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (crc_mod(F.col("doc_id"), crf_quality.FOLD) == 0).alias("held_out"), "score",
        (F.col("score") >= crf_quality.CUT).cast("int").alias("predicted"),
    )


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(_table(spark, sf_dir, "documents"))
    # One argument only: Spark hands a second one of a filter's function the element's index.
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    counts = (of_kind(k).alias(f"n_{name}") for k, name in enumerate(personal_data.KINDS))
    digest = F.sha2(personal_data.joined(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, personal_data.joined(F.col("spans")).alias("spans"))


def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_bloom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bloom_lookup.edited_fingerprints(_table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return out.select("doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


#: Tools of the calls that ``op10_tool_links`` reads out of the conversations.
TOOLS = {
    "search": {"limit": ("integer", True), "query": ("string", True)},
    "summarise": {"limit": ("integer", False), "query": ("string", True)},
    "translate": {"limit": ("integer", True), "query": ("string", True), "to": ("string", True)},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of conversations: what a user says is a call, the next assistant turn its result.

    The turn picks the tool and, now and then, arguments of a wrong type or of another tool; a call depends on the
    one at half its turn, which need not exist.
    """
    name = F.element_at(F.array(F.lit("search"), F.lit("summarise"), F.lit("translate")), (F.col("turn") % 3 + 1).cast("int"))
    call_id = lambda turn: F.concat_ws("_", F.lit("call"), "conv_id", turn.cast("string"))
    arguments = F.when(F.col("turn") % 5 == 4, F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").cast("string").alias("limit")))).otherwise(
        F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").alias("limit")))
    )
    depends = F.when(F.col("turn") > 1, F.array(call_id(F.floor(F.col("turn") / 2))))
    calls = turns.where("role = 'user'").select(
        "conv_id", call_id(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"), depends.alias("depends_on"), F.col("turn").alias("position")
    )
    results = turns.where("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"), F.col("turn").alias("position"))
    return calls, results


def op10_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link_calls(*conversation_calls(_table(spark, sf_dir, "conversations")), TOOLS)


def op11_incremental_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors)).withColumn("deviation", F.col("deviation").cast("bigint"))


def op12_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), ppm.FOLD) == 0
    scored = ppm.score(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_asymmetric_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(_table(spark, sf_dir, "documents"), damage=199))


QUERIES = {
    "op1_byte_network": op1_byte_network,
    "op2_vector_packing": op2_vector_packing,
    "op3_recompression": op3_recompression,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_suffix_automaton": op5_suffix_automaton,
    "op6_line_crf": op6_line_crf,
    "op7_weak_supervision": op7_weak_supervision,
    "op8_lsh_forest": op8_lsh_forest,
    "op9_bloom_lookup": op9_bloom_lookup,
    "op10_tool_links": op10_tool_links,
    "op11_incremental_whitening": op11_incremental_whitening,
    "op12_partial_matching": op12_partial_matching,
    "op13_asymmetric_chunks": op13_asymmetric_chunks,
}

ORACLES = {
    "op3_recompression": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
             FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
     late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
     gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late) GROUP BY 1),
     each AS (SELECT doc_id, w, ps, unnest(range(1, len(w) + 1)) AS p FROM d LEFT JOIN gone USING (doc_id)),
     kept AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS t FROM each WHERE ps IS NULL OR NOT list_contains(ps, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op5_suffix_automaton": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
             FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
     ks AS (SELECT DISTINCT k FROM win),
     dwin AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
              FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
     hit AS (SELECT d.doc_id, d.i, d.k, w.item_id FROM dwin d JOIN win w USING (k, s)),
     pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
     its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS joined
             FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op8_lsh_forest": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
     pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
     link AS (SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE shared >= 0.8 * (nx.n + ny.n - shared) - 1e-9),
     reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(y) FROM reach WHERE reach.x = d.doc_id), d.doc_id)) AS class_id,
       (SELECT count(*) FROM link WHERE link.x = d.doc_id) AS n_links
FROM documents d""",
    "op10_tool_links": r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, text, 'call_' || conv_id || '_' || turn AS call_id, list_extract(['search', 'summarise', 'translate'], CAST(turn % 3 + 1 AS BIGINT)) AS name
                     FROM conversations WHERE role = 'user'),
     r AS (SELECT conv_id, 'call_' || conv_id || '_' || (turn - 1) AS call_id, arg_min(text, turn) AS result, count(*) AS n_results
           FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
     lev AS (SELECT c.conv_id, c.turn, 0 AS level FROM c LEFT JOIN c d ON d.conv_id = c.conv_id AND d.turn = c.turn // 2 AND c.turn > 1 WHERE d.turn IS NULL
             UNION ALL SELECT c.conv_id, c.turn, level + 1 FROM lev JOIN c ON c.conv_id = lev.conv_id AND c.turn // 2 = lev.turn AND c.turn > 1),
     e AS (SELECT c.*, level, result, n_results, list_sort(list_filter([
             CASE WHEN c.turn > 1 AND NOT EXISTS (SELECT 1 FROM c d WHERE d.conv_id = c.conv_id AND d.turn = c.turn // 2) THEN 'unknown dependency' END,
             CASE WHEN c.turn % 5 = 4 THEN 'limit is not integer' END,
             CASE WHEN c.name = 'translate' THEN 'missing to' END,
             CASE WHEN c.text IS NULL THEN 'missing query' END], lambda x: x IS NOT NULL)) AS errors
           FROM c JOIN lev USING (conv_id, turn) LEFT JOIN r USING (conv_id, call_id))
SELECT conv_id, call_id, name, CAST(level AS INTEGER) AS level, turn AS position,
       CASE WHEN len(errors) > 0 THEN 'invalid' WHEN n_results IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
       array_to_string(errors, ';') AS errors, coalesce(n_results, 0) AS n_results,
       '{"arguments":{"limit":' || CASE WHEN turn % 5 = 4 THEN '"' || turn || '"' ELSE CAST(turn AS VARCHAR) END
         || CASE WHEN text IS NULL THEN '' ELSE ',"query":' || CAST(to_json(text) AS VARCHAR) END || '},"call_id":"' || call_id || '","name":"' || name || '"'
         || CASE WHEN result IS NULL THEN '' ELSE ',"result":' || CAST(to_json(result) AS VARCHAR) END || '}' AS json
FROM e
UNION ALL
SELECT r.conv_id, r.call_id, NULL, NULL, NULL, 'orphan', '', r.n_results,
       '{"call_id":"' || r.call_id || '"' || CASE WHEN r.result IS NULL THEN '' ELSE ',"result":' || CAST(to_json(r.result) AS VARCHAR) END || '}'
FROM r ANTI JOIN c USING (conv_id, call_id)""",
}
