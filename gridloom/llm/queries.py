"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws]
           ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(v, r) AS (SELECT a, a FROM sym UNION SELECT s.b, reach.r FROM reach JOIN sym s ON s.a = reach.v),
comp AS (SELECT v, min(r) AS r FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.r, d.doc_id)::BIGINT AS component_id,
       d.doc_id = coalesce(comp.r, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.v = d.doc_id
"""


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.suffix import repeated_bytes

    return repeated_bytes(_table(spark, sf_dir, "documents"), length=50)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.mixing import mixture

    return mixture(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.pieces import piece_report

    return piece_report(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.common import shared_dir
    from gridloom.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"), shared_dir(spark), least=0)


OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::BIGINT, 1)), '') AS payload_digest,
        max(page_id) OVER (PARTITION BY hex) AS largest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM largest AND largest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM largest AND largest IS NOT NULL THEN largest END AS refers_to
FROM d
"""


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.fingerprint import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op7_cover_tree_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.covertree import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


OP7_SQL = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
         WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
n AS (SELECT a, count(*) AS c FROM link GROUP BY 1),
reach(v, r) AS (SELECT a, a FROM link UNION SELECT l.b, reach.r FROM reach JOIN link l ON l.a = reach.v),
comp AS (SELECT v, min(r) AS r FROM reach GROUP BY 1)
SELECT x.vec_id, coalesce(n.c, 0)::BIGINT AS n_links, coalesce(comp.r, x.vec_id)::BIGINT AS component_id, coalesce(comp.r, x.vec_id) = x.vec_id AS kept
FROM embeddings x LEFT JOIN n ON n.a = x.vec_id LEFT JOIN comp ON comp.v = x.vec_id
"""


def op9_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.chat import preference_report

    return preference_report(_table(spark, sf_dir, "conversations"))


OP9_SQL = r"""
WITH c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
l AS (SELECT conv_id, t, list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant') AS pos FROM c),
x AS (SELECT conv_id, floor(conv_id / 64.0) AS near, t[1:pos[len(pos)]] AS t, {'role': 'assistant', 'text': t[pos[len(pos)]].text} AS answer, pos[1 + (conv_id % len(pos) + len(pos)) % len(pos)] AS k FROM l WHERE len(pos) > 0),
o AS (SELECT conv_id, t, k, coalesce(lead(answer) OVER w, first_value(answer) OVER w) AS other, count(*) OVER (PARTITION BY near) AS n FROM x WINDOW w AS (PARTITION BY near ORDER BY conv_id)),
m AS (SELECT conv_id AS pair_id, t AS a, list_append(t[1:k - 1], other) AS b, CASE WHEN t[k].text IS NOT DISTINCT FROM other.text THEN k ELSE k - 1 END AS n FROM o WHERE n > 1),
r AS (SELECT pair_id, n, list_transform(a, lambda x: {'role': x.role, 'head': '<|' || coalesce(x.role, '') || '|>' || chr(10), 'body': coalesce(x.text, '') || '<|end|>'}) AS a,
             list_transform(b, lambda x: {'role': x.role, 'head': '<|' || coalesce(x.role, '') || '|>' || chr(10), 'body': coalesce(x.text, '') || '<|end|>'}) AS b FROM m),
s AS (SELECT pair_id, n, a[1:n] AS p, a[n + 1:] AS a, b[n + 1:] AS b FROM r),
z AS (SELECT *, list_transform(a, lambda x: length(x.head) + length(x.body) + 1) AS za, list_transform(b, lambda x: length(x.head) + length(x.body) + 1) AS zb FROM s)
SELECT pair_id, n::INTEGER AS n_common,
  array_to_string(list_transform(p, lambda x: x.head || x.body || chr(10)), '') AS prompt,
  array_to_string(list_transform(a, lambda x: x.head || x.body || chr(10)), '') AS chosen,
  array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: a[i].role = 'assistant'), lambda i: (coalesce(list_sum(za[1:i - 1]), 0) + length(a[i].head))::BIGINT::VARCHAR || '-' || (list_sum(za[1:i]) - 1)::BIGINT::VARCHAR), ',') AS chosen_spans,
  array_to_string(list_transform(b, lambda x: x.head || x.body || chr(10)), '') AS rejected,
  array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda i: b[i].role = 'assistant'), lambda i: (coalesce(list_sum(zb[1:i - 1]), 0) + length(b[i].head))::BIGINT::VARCHAR || '-' || (list_sum(zb[1:i]) - 1)::BIGINT::VARCHAR), ',') AS rejected_spans
FROM z
"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.license import scan

    return scan(_table(spark, sf_dir, "documents"))


def _op10_sql() -> str:
    from gridloom.llm import license as lic

    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def canonical(x):
        x = f"translate({x}, '{lic.UPPER}', '{lic.LOW}')"
        x = f"regexp_replace({x}, {quote(lic.COPYRIGHT_LINE)}, ' ', 'g')"
        for old, new in lic.SPELLINGS:
            x = f"replace({x}, {quote(old)}, {quote(new)})"
        return f"trim(regexp_replace({x}, {quote(lic.PUNCTUATION)}, ' ', 'g'))"

    rows = lambda xs: ", ".join(f"({i}, {quote(n)}, {quote(t)})" for i, (n, t) in enumerate(xs))
    return f"""
WITH texts AS (SELECT sha256({canonical('t')}) AS digest, arg_min(n, i) AS license_id FROM (VALUES {rows(lic.TEXTS)}) v(i, n, t) GROUP BY 1),
notices AS (SELECT sha256({canonical('t')}) AS digest, arg_min(n, i) AS id FROM (VALUES {rows(lic.NOTICES)}) v(i, n, t) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d),
said AS (SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) AS notices FROM
  (SELECT doc_id, sha256({canonical('x')}) AS digest FROM line WHERE translate(x, '{lic.UPPER}', '{lic.LOW}') LIKE '%licen%') JOIN notices USING (digest) GROUP BY 1),
w AS (SELECT doc_id, sha256({canonical('text')}) AS digest FROM d)
SELECT doc_id, digest, license_id, coalesce(notices, '') AS notices FROM w LEFT JOIN texts USING (digest) LEFT JOIN said USING (doc_id)
"""


def queries() -> dict:
    found = (op1_mixing, op2_sentencepiece, op3_suffix_array_dedup, op4_warc, op5_minhash_near_dedup, op6_fingerprints,
             op7_cover_tree_near_dedup, op8_toxicity, op9_chat_preferences, op10_license_scan)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op5_minhash_near_dedup": OP5_SQL, "op7_cover_tree_near_dedup": OP7_SQL,
            "op9_chat_preferences": OP9_SQL, "op10_license_scan": _op10_sql()}
