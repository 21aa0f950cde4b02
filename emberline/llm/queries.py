"""One query per operator, over whole tables, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.llm import cascade, hmm, htmltext, langid, ledger, minhash, mixing, tokencount, warc, winnow
from emberline.llm.common import table

URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_lm_scores(spark, sf_dir):
    return hmm.score(table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    rows = mixing.by_position(mixing.assign(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.round("first_position", 9).alias("first_position"))


def op4_token_counts(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_decontamination(spark, sf_dir):
    rows = winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = ledger.measure(docs, terms=ledger.learned_terms(docs, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_toxic", ledger.fails("base").alias("base_failed"), (~ledger.fails("v2")).alias("kept"), "fail_bits")


def op8_html_text(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.remainder("doc_id", 5) == 0)
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", F.transform("langs", lambda x: x["lang"]).alias("langs"))


def op10_url_filter(spark, sf_dir):
    return cascade.judge(table(spark, sf_dir, "pages"), URL_RULES)


def queries():
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}


_WORD = r"[^\x20\x09-\x0D]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r AS (SELECT a AS doc_id, a AS reach FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
m AS (SELECT doc_id, min(reach) AS least FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

OP3 = rf"""
WITH base AS (
  SELECT doc_id, coalesce('s' || source, 't') AS sk, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents),
src AS (SELECT sk, sum(size)::BIGINT AS source_size FROM base GROUP BY sk),
ranked AS (SELECT *, row_number() OVER (ORDER BY sk) - 1 AS rank FROM src),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS most FROM ranked),
lv AS (
  SELECT *, most / weight AS full_at,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT sk, source_size, CASE rank % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope, CASE WHEN level > full_at THEN most ELSE weight * max(CASE WHEN level <= full_at THEN level END) OVER () END AS target FROM lv),
placed AS (
  SELECT b.*, g.source_size, g.target, g.slope, coalesce(sum(b.size) OVER (PARTITION BY b.sk ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS rounds
  FROM base b JOIN goal g USING (sk)),
found AS (
  SELECT *, (CASE WHEN size > 0 THEN rounds * size + greatest(0, least(size, floor(target) - rounds * source_size - start)) ELSE 0 END)::BIGINT AS taken,
    CASE WHEN target > 0 THEN start / target END AS demand FROM placed)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(2 * demand / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * demand)), 9) END AS first_position
FROM found"""

OP6 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id::VARCHAR AS item, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
wh AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN wh USING (doc_id) LEFT JOIN it USING (doc_id)"""


OP5 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to FROM w"""


def _op7() -> str:
    rules = " + ".join(f"(CASE WHEN {fails} THEN {1 << bit} ELSE 0 END)" for bit, fails in ledger.RULES.values())
    base, v2 = ledger.mask_of("base"), ledger.mask_of("v2")
    leading = ledger.LEADING.replace("'", "''")
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, p, w[p : p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM t)),
r AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
k AS (SELECT doc_id, p, regexp_extract(lower(ltrim(w[p], '{leading}')), '^\p{{L}}+') AS term, coalesce(w[p - 1], '') AS before FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM t)),
lab0 AS (SELECT doc_id, toxic FROM labels WHERE toxic IS NOT NULL),
lab AS (SELECT * FROM lab0 WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT * (SELECT count(*) FROM lab0) < {ledger.SAMPLE * (1 << 32)}),
lk AS (SELECT k.*, toxic FROM k JOIN lab USING (doc_id) WHERE length(term) >= {ledger.LETTERS}),
terms AS (SELECT term FROM lk GROUP BY term HAVING {ledger.PURE[1]} * count(DISTINCT doc_id) FILTER (toxic = 1) >= {ledger.PURE[0]} * count(DISTINCT doc_id)
      AND count(DISTINCT before) FILTER (toxic = 1) >= (SELECT greatest({ledger.CONTEXTS}, coalesce(sum(toxic), 0) // {ledger.ONE_IN}) FROM lab)),
x AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM k SEMI JOIN terms USING (term)),
tx AS (SELECT doc_id, count(*) AS n_toxic, count(*) FILTER (gap < {ledger.NEAR}) AS n_toxic_near FROM x GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars0,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(rw.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '\p{{Lu}}'))::BIGINT AS n_upper, len(regexp_extract_all(text, '!'))::BIGINT AS n_shouts,
  coalesce(n_toxic, 0)::BIGINT AS n_toxic, coalesce(n_toxic_near, 0)::BIGINT AS n_toxic_near
  FROM t LEFT JOIN l USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN tx USING (doc_id)),
b AS (SELECT *, ({rules})::BIGINT AS fail_bits FROM (SELECT *, coalesce(word_chars0, 0)::BIGINT AS word_chars FROM m))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_toxic, (fail_bits & {base}) <> 0 AS base_failed, (fail_bits & {v2}) = 0 AS kept, fail_bits FROM b"""


def _op10() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)://(.*)', 1) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
r(verdict, rh, rp) AS (VALUES {rules}),
f AS (SELECT page_id, host, path, rh || rp AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1"""


def oracle_sql():
    return {"op1_near_duplicates": OP1, "op3_mixing": OP3, "op5_warc": OP5, "op6_decontamination": OP6, "op7_quality_rules": _op7(), "op10_url_filter": _op10()}
