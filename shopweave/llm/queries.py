"""Registered queries of the training-data operators: ``QUERIES`` and ``ORACLE_SQL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced, conversations, decontaminate, huffman, langid, linededup, minhash, packing, quality, ranking, substrings, toxicity, wrappers
from .common import held_out, new_path, read_table


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabularies lie; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = docs.where(F.col("lang").isNotNull() & ~held_out("doc_id", 4, 2)).select("doc_id", "lang")
    model = langid.train(docs, labels)
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """The quality model learned from the labels that are not held out."""
    labels = read_table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2))
    return quality.train(docs, labels)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality_model(spark, docs, sf_dir))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.drop_common_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    out = toxicity.score(docs, toxicity.train(docs, labels))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.to_json("spans").alias("spans"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substrings.remove_repeats(docs, length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.match(docs, read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.link(docs, k=4, percent=80)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(read_table(spark, sf_dir, "embeddings"), k=10)


def op9_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    where = new_path(spark, "token-codes")
    huffman.encode_documents(docs, tokenizer_path("byte_bpe_50k.json"), where)
    return huffman.read(spark, where)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(read_table(spark, sf_dir, "conversations"), damage=True)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranking.rank(docs, read_table(spark, sf_dir, "benchmark"), k=20)


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c ON keyed.key = c.key GROUP BY doc_id
"""

OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS m FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[s : s + m - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM sized)),
grams AS (SELECT doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') AS g
          FROM (SELECT *, unnest(range(1, greatest(1, len(w) - m + 2))) AS s FROM dw, (SELECT DISTINCT m FROM sized))),
hits AS (SELECT doc_id, item_id, s, win.m FROM grams JOIN win ON grams.m = win.m AND grams.g = win.g),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS l
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""

OP3_SQL = r"""
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, b, unnest(range(0, greatest(0, octet_length(b) - 399))) AS s FROM raw),
keyed AS (SELECT doc_id, s, md5_number(array_slice(b, CAST(s + 1 AS BIGINT), CAST(s + 400 AS BIGINT))) AS k FROM starts),
twice AS (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1),
hits AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM keyed SEMI JOIN twice USING (k)),
runs AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM hits),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS z FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS last FROM spans),
cut AS (
  SELECT doc_id, count(*) AS n, sum(z - a) AS gone, max(z) AS stop,
         string_agg(CASE WHEN a > last THEN hex(array_slice(b, CAST(last + 1 AS BIGINT), CAST(a AS BIGINT))) ELSE '' END, '' ORDER BY a) AS rest
  FROM gaps JOIN raw USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN hex(b) WHEN stop < octet_length(b) THEN rest || hex(array_slice(b, CAST(stop + 1 AS BIGINT), octet_length(b))) ELSE rest END)) AS kept_sha256
FROM raw LEFT JOIN cut USING (doc_id)
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 3) + 1), lambda s: array_to_string(w[s : s + 3], ' '))) END AS g FROM w),
alike AS (SELECT g, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(g) AS g FROM sets WHERE len(g) > 0) GROUP BY g),
grams AS (SELECT rep, len(g) AS n, unnest(g) AS x FROM alike),
pairs AS (SELECT a.rep AS u, b.rep AS v, any_value(a.n) + any_value(b.n) AS total, count(*) AS common FROM grams a JOIN grams b ON a.x = b.x AND a.rep < b.rep GROUP BY ALL),
links AS (
  SELECT u, v FROM pairs WHERE 100 * common >= 80 * (total - common)
  UNION ALL SELECT v, u FROM pairs WHERE 100 * common >= 80 * (total - common)
  UNION ALL SELECT s.doc_id, a.rep FROM sets s JOIN alike a ON list_sort(s.g) = a.g WHERE s.doc_id <> a.rep),
reach(doc_id, other) AS (
  SELECT u, v FROM links UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON r.other = l.u)
SELECT s.doc_id, len(s.g) AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id,
       least(s.doc_id, coalesce(min(r.other), s.doc_id)) = s.doc_id AS kept
FROM sets s LEFT JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.g
"""

OP8_SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.n, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.n <> b.n AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

# The wrappers themselves are beyond SQL; on the driver's pages the article can be cut out by its tags.
OP12_SQL = r"""
WITH cut AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1)>') AS b FROM pages),
plain AS (SELECT page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(
  replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&lt;', '<'), '&gt;', '>'),
  '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM cut),
texts AS (SELECT page_id, url, regexp_replace(array_to_string(b, chr(10) || chr(10)), '&amp;?', '&', 'g') AS text FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS dn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
q AS (
  SELECT row_number() OVER () AS qn, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                 '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
total AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
qt AS (SELECT qn, item_id, t, count(*) AS times FROM (SELECT qn, item_id, unnest(w) AS t FROM q) GROUP BY ALL),
dt AS (SELECT dn, doc_id, n, t, count(*) AS tf FROM (SELECT dn, doc_id, len(w) AS n, unnest(w) AS t FROM d) SEMI JOIN qt USING (t) GROUP BY ALL),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM dt, total GROUP BY t),
scored AS (
  SELECT qn, item_id, dn, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM qt JOIN dt USING (t) JOIN weights USING (t), total GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qn ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

def _op11_sql() -> str:
    """A recursion over rows: for each state the cheapest edits so far, the least audit first, and their text."""

    def edit(state: str, cost: str, letter: str, text: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {text}}}"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def only(test: str, option: str) -> str:
        return f"CASE WHEN {test} THEN {option} END"

    def insert(state: str, role: str) -> str:
        return edit(state, "3", "I", f"chr(10) || '{role}:'")

    gone = {q: edit(q, "4", "D", "''") for q in ("q0", "q1", "u", "a")}
    keep = lambda q, x: only(f"NOT must AND initial = '{x}'", edit(q, "late", "K", "chr(10) || role || ':' || text"))
    name = lambda q, role: only("NOT must", edit(q, "late + 3", "R", f"chr(10) || '{role}:' || text"))
    user, answer = least("q2", insert("q0", "user"), insert("q1", "user"), insert("q3", "user")), least("q3", insert("u", "assistant"))
    closed = f"(SELECT *, {answer} AS a FROM (SELECT *, {user} AS u FROM steps))"
    return f"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))) AS b FROM conversations),
fates AS (SELECT *, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 20 AS fate FROM base, tab),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM fates WHERE fate <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ends FROM damaged),
facts AS (SELECT *, ends = '' AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, right(ends, 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS initial FROM numbered),
rows_ AS (SELECT *, is_blank OR again AS must, CASE WHEN cut THEN 3 ELSE 0 END AS late, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY n) AS pair FROM facts),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (again AND NOT is_blank) AS duplicate,
    count(*) FILTER (cut AND NOT must) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows_ GROUP BY conv_id),
none AS (SELECT {{'c': CAST(1000000 AS BIGINT), 'a': '', 't': ''}} AS x),
steps AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS q0, x AS q1, x AS q2, x AS q3 FROM sums, none
  UNION ALL
  SELECT s.conv_id, r.n, {gone["q0"]}, {least(gone["q1"], keep("q0", "s"))},
    {least(gone["u"], *[keep(q, "u") for q in ("q0", "q1", "a")], *[name(q, "user") for q in ("q0", "q1", "a")])}, {least(gone["a"], keep("u", "a"), name("u", "assistant"))}
  FROM {closed} s JOIN rows_ r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = s.n + 1),
best AS (SELECT s.conv_id, {least("q0", "a")} AS x FROM {closed} s JOIN sums ON s.conv_id IS NOT DISTINCT FROM sums.conv_id AND s.n = sums.n)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(x.c, 0) AS cost, coalesce(x.a, '') AS audit, sha256(substr(coalesce(x.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums ON o.conv_id IS NOT DISTINCT FROM sums.conv_id LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
"""


QUERIES = {"op1_langid": op1_langid, "op2_quality": op2_quality, "op10_toxicity": op10_toxicity, "op3_repeats": op3_repeats, "op4_packing": op4_packing, "op5_decontamination": op5_decontamination, "op6_line_dedup": op6_line_dedup, "op7_near_dup": op7_near_dup, "op8_topk": op8_topk, "op9_token_codes": op9_token_codes,
           "op11_conversations": op11_conversations, "op12_main_text": op12_main_text, "op13_ranking": op13_ranking}
ORACLE_SQL = {"op3_repeats": OP3_SQL, "op7_near_dup": OP7_SQL, "op5_decontamination": OP5_SQL, "op6_line_dedup": OP6_SQL, "op8_topk": OP8_SQL, "op11_conversations": _op11_sql(), "op12_main_text": OP12_SQL, "op13_ranking": OP13_SQL}
