"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curve_packing, decontam, gru_lm, langid, line_quality, merkle, rindex_dedup, simhash, source_mix, sstable, template_dedup, toxicity, treap_search
from .common import documents, held_out

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", held_out(4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_table(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), end_id=0)


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("n_removed_lines").cast("long").alias("n_removed_lines"), F.col("n_words_left").cast("long").alias("n_words_left"))


def op5_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, total, dropped = template_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", F.col(total).cast("long").alias("n_lines"), F.col(dropped).cast("long").alias("n_dropped"), F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op6_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rindex_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op7_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.train(docs)).select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score")


def op9_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), end_id=1)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(documents(spark, sf_dir))


def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n_docs = treap_search.build(documents(spark, sf_dir))
    return treap_search.search(index, n_docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_sstable": op3_sstable,
    "op4_line_quality": op4_line_quality,
    "op5_template_lines": op5_template_lines,
    "op6_run_index": op6_run_index,
    "op7_gru_lm": op7_gru_lm,
    "op8_language": op8_language,
    "op9_curve_packing": op9_curve_packing,
    "op10_simhash": op10_simhash,
    "op11_pivotal_mix": op11_pivotal_mix,
    "op12_treap_search": op12_treap_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT r, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
hw AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM m)) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)""",
    "op4_line_quality": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, text, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS l FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM again) GROUP BY r),
ln AS (SELECT r, source, len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n,
              trim(regexp_replace(regexp_replace(lower(x), '\p{Nd}+', '0', 'g'), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) AS line
       FROM (SELECT r, source, text, unnest(l) AS x FROM w)),
often AS (SELECT source, line FROM ln GROUP BY source, line HAVING count(DISTINCT r) > 5),
gone AS (SELECT r, count(*) AS lines, sum(n) AS n FROM ln JOIN often o ON ln.source IS NOT DISTINCT FROM o.source AND ln.line = o.line GROUP BY r),
x AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(w.t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(w.t) - length(regexp_replace(w.t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(w.l) - len(list_distinct(w.l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS gone, CAST(coalesce(gone.lines, 0) AS BIGINT) AS n_removed_lines
      FROM w LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - gone >= 10 AND n_words - gone >= n_words * 0.3 AS kept, n_removed_lines, n_words - gone AS n_words_left FROM x""",
    "op12_treap_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
it AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)),
df AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
s AS (SELECT item_id, r, CAST(sum(df.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.w) * n) // l)))) AS BIGINT) AS score FROM it JOIN df USING (t) JOIN p USING (t) JOIN d USING (r), c GROUP BY item_id, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50""",
    # the crc32 of an identifier is reduced from its digits' bits
    "op13_merkle_manifest": r"""
WITH RECURSIVE c AS (SELECT *, 4294967295 - list_reduce([4294967295] || [ascii(x) for x in string_split(CAST(doc_id AS VARCHAR), '')], lambda c, b: list_reduce([xor(c, b)] || [0 for k in range(8)], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)) AS crc FROM documents),
e AS (SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
      n_chars AS n, n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS m, coalesce(strlen(text) || ':' || text, '-') AS tail FROM c),
leaf AS (SELECT doc_id, lang, leaf, other, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM (SELECT doc_id, lang,
      sha256(head || coalesce(strlen(CAST(n AS VARCHAR)) || ':' || n, '-') || tail) AS leaf, sha256(head || coalesce(strlen(CAST(m AS VARCHAR)) || ':' || m, '-') || tail) AS other FROM e)),
t(lang, k, nodes) AS (SELECT lang, 0, list(leaf ORDER BY i) FROM leaf GROUP BY lang UNION ALL
      SELECT lang, k + 1, [sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], '')) for j in range(0, (len(nodes) + 1) // 2)] FROM t WHERE len(nodes) > 1),
sub AS (SELECT lang, k AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM t WHERE len(nodes) = 1),
u(k, nodes) AS (SELECT 0, list(subroot ORDER BY g) FROM sub UNION ALL SELECT k + 1, [sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], '')) for j in range(0, (len(nodes) + 1) // 2)] FROM u WHERE len(nodes) > 1),
lv AS (SELECT s.lang, s.g, s.height, k AS step, nodes FROM t JOIN sub s ON t.lang IS NOT DISTINCT FROM s.lang WHERE len(nodes) > 1 UNION ALL SELECT lang, g, height, height + k, nodes FROM sub, u WHERE len(nodes) > 1),
f(doc_id, lang, i, step, leaf, h, sib) AS (SELECT doc_id, lang, i, 0, leaf, other, '' FROM leaf UNION ALL
      SELECT doc_id, f.lang, i, f.step + 1, leaf, sha256(CASE WHEN p % 2 = 1 THEN nodes[p] || h ELSE h || coalesce(nodes[p + 2], '') END), sib || coalesce(nodes[xor(p, 1) + 1], '')
      FROM (SELECT f.*, nodes, CASE WHEN f.step < height THEN i >> f.step ELSE g >> (f.step - height) END AS p FROM f JOIN lv ON f.lang IS NOT DISTINCT FROM lv.lang AND f.step = lv.step) f),
top AS (SELECT nodes[1] AS root, k AS more FROM u WHERE len(nodes) = 1)
SELECT f.doc_id, f.leaf, s.subroot, root, sha256(sib) AS proof_sha256, h AS folded_root, h = root AS verified FROM f JOIN sub s ON f.lang IS NOT DISTINCT FROM s.lang, top WHERE f.step = s.height + top.more""",
}
