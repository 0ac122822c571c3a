"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, cover_tree, html_lstm, lang_rank, line_runs, mixing, phrases, secret_scan, simhash_mih, topk_norm, url_rank, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(spark: SparkSession) -> bpe.Tokenizer:
    import public_tokenizers
    return bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@register
def op1_topk(spark, sf_dir):
    return topk_norm.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


@register
def op2_html(spark, sf_dir):
    return html_lstm.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@register
def op3_mixing(spark, sf_dir):
    mixed = mixing.repetitions(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"))


@register
def op4_simhash(spark, sf_dir):
    return simhash_mih.near_dedup(table(spark, sf_dir, "documents"), k=3, max_bits=3)


@register
def op5_embeddings(spark, sf_dir):
    return cover_tree.near_dedup(table(spark, sf_dir, "embeddings"), threshold=0.93)


@register
def op6_bpe(spark, sf_dir):
    coded = bpe.recode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer(spark))
    return coded.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op7_line_dedup(spark, sf_dir):
    out = line_runs.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@register
def op8_chat(spark, sf_dir):
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_chats(turns))


@register
def op9_secrets(spark, sf_dir):
    found = secret_scan.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["kind"] != "entropy")
    count = secret_scan.count_kind
    return found.select("doc_id", count(spans, "assign").alias("n_assign"), count(spans, "access").alias("n_access"),
                        count(spans, "hex").alias("n_hex"), F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
                        secret_scan.spans_text(spans).alias("spans"))


@register
def op10_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return lang_rank.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


#: the rules of op11
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@register
def op11_urls(spark, sf_dir):
    return url_rank.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


@register
def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), scale=64.0, offset=1_000_000, components=32)


@register
def op13_phrases(spark, sf_dir):
    return phrases.mine(table(spark, sf_dir, "documents").select("text", "lang"), max_words=3, min_count=10, covered=50, top=2000)


ORACLE_SQL["op7_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, i, line, lower_key AS key FROM (
    SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))),
often AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, coalesce(l.doc_id <> o.keeper, false) AS gone FROM lines l LEFT JOIN often o ON l.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _mixing_sql(weights=(5, 2, 1), share=1.5, epochs=2.0, seed=3, rounds=mixing.ROUNDS) -> str:
    parts = [f"""
sized AS (SELECT row_number() OVER () AS nth, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                 left(md5('{seed}-' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '-' || coalesce(md5(text), 'null')), 16) AS h FROM documents),
srcs AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighted AS (SELECT *, list_extract([{', '.join(f'{float(w)}::DOUBLE' for w in weights)}], CAST(place % {len(weights)} + 1 AS INT)) AS weight,
                    source_size * {epochs}::DOUBLE AS cap FROM srcs),
ordered AS (SELECT *, cap / weight AS clamps_at FROM weighted),
levels AS (SELECT *, ((SELECT sum(source_size) FROM srcs) * {share}::DOUBLE
                  - coalesce(sum(cap) OVER (ORDER BY clamps_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (ORDER BY clamps_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ordered),
reached AS (SELECT level FROM levels WHERE level <= clamps_at ORDER BY clamps_at, source NULLS LAST LIMIT 1),
plan0 AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM reached) * weight), cap) AS target FROM levels),
w0 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM plan0),
want0 AS (SELECT *, target - whole * source_size AS want, 'infinity'::DOUBLE AS largest FROM w0),
left0 AS (SELECT nth, source, size, h FROM sized WHERE size > 0)"""]
    for r in range(len(rounds)):
        parts.append(f"""
run{r} AS (SELECT d.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) - d.size * count(*) OVER (PARTITION BY d.source, d.h)
                  + d.size * row_number() OVER (PARTITION BY d.source, d.h ORDER BY d.nth) AS upto, w.want
           FROM left{r} d JOIN want{r} w ON d.source IS NOT DISTINCT FROM w.source WHERE d.size <= w.largest),
got{r} AS MATERIALIZED (SELECT nth, source, size FROM run{r} WHERE upto <= want),
left{r + 1} AS MATERIALIZED (SELECT * FROM left{r} WHERE nth NOT IN (SELECT nth FROM got{r})),
want{r + 1} AS MATERIALIZED (SELECT w.source, source_size, target, whole, want - coalesce(got, 0) AS want, (want - coalesce(got, 0)) * {[*rounds, 1.0][r + 1]}::DOUBLE AS largest
           FROM want{r} w LEFT JOIN (SELECT source, sum(size) AS got FROM got{r} GROUP BY source) g ON w.source IS NOT DISTINCT FROM g.source)""")
    return "WITH " + ",".join(parts) + f"""
SELECT d.doc_id, d.size, w.source_size, w.target,
       CAST(d.size * (w.whole + CASE WHEN d.size > 0 AND d.nth NOT IN (SELECT nth FROM left{len(rounds)}) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN w0 w ON d.source IS NOT DISTINCT FROM w.source
"""


ORACLE_SQL["op3_mixing"] = _mixing_sql()

ORACLE_SQL["op1_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLE_SQL["op5_embeddings"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
         AND coalesce(list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))), false)
         AND coalesce(list_bool_or(list_transform(e, lambda x: x <> 0)), false)),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.n * b.n) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
part AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v LEFT JOIN part ON v.vec_id = part.x LEFT JOIN n ON v.vec_id = n.x
"""

ORACLE_SQL["op13_phrases"] = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(ps) AS p FROM (SELECT lang, doc_id, string_split_regex(
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)),
worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
spans AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM worded WHERE len(w) > 0),
grams AS (SELECT lang, w[i] AS phrase, 1 AS k FROM spans
          UNION ALL SELECT lang, w[i] || ' ' || w[i + 1], 2 FROM spans WHERE i + 1 <= len(w)
          UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 3 FROM spans WHERE i + 2 <= len(w)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
longer AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, f AS a, 1 AS cut, w[1] AS lhs, array_to_string(w[2:], ' ') AS rhs FROM longer
         UNION ALL SELECT lang, phrase, f, 2, array_to_string(w[:2], ' '), w[3] FROM longer WHERE k = 3),
scored AS (SELECT c.*, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
           FROM cuts c JOIN f x ON c.lang = x.lang AND c.lhs = x.phrase JOIN f y ON c.lang = y.lang AND c.rhs = y.phrase),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM scored) WHERE nth = 1),
inner_ AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM longer WHERE k = 3
           UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM longer WHERE k = 3),
covering AS (SELECT lang, phrase, max(f) AS f FROM inner_ GROUP BY ALL),
kept AS (SELECT s.* FROM weakest s LEFT JOIN covering c ON s.lang = c.lang AND s.phrase = c.phrase WHERE c.f IS NULL OR 100 * c.f < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, t.n, score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE rank <= 2000
"""


def _urls_sql(rules=URL_RULES, damping=url_rank.DAMPING, rounds=url_rank.ROUNDS, block_at=url_rank.BLOCK_AT) -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    given = ", ".join(f"('{v}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in rules)
    link, no_links = url_rank.LINK.replace("'", "''"), url_rank.NO_LINKS.replace("'", "''")
    return rf"""
WITH RECURSIVE parts AS (SELECT row_number() OVER () AS nth, page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
split_ AS (SELECT nth, page_id, html, coalesce({lower.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host,
                  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
rules(verdict, rule, rule_host, rule_path) AS (VALUES {given}),
fits AS (SELECT nth, rule, verdict, row_number() OVER (PARTITION BY nth ORDER BY length(rule) DESC, length(rule_host) DESC) AS place
         FROM split_ JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)),
ruled AS (SELECT s.*, f.rule, f.verdict FROM split_ s LEFT JOIN fits f ON s.nth = f.nth AND f.place = 1),
seeds AS (SELECT host, avg((verdict IS NOT DISTINCT FROM 'allow')::INT) AS trust, avg((verdict IS NOT DISTINCT FROM 'block')::INT) AS distrust
          FROM ruled WHERE host <> '' GROUP BY host),
named AS (SELECT DISTINCT nth, host AS src, {lower.format("unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '" + no_links + "', ' ', 'g'), '" + link + "', 1))")} AS dst FROM split_),
links AS (SELECT src, dst, count(*) AS n FROM named WHERE src <> '' AND src <> dst GROUP BY ALL),
arcs AS (SELECT 'trust' AS kind, src AS host, dst AS dest, n / sum(n) OVER (PARTITION BY src) AS share FROM links
         UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM links),
walk AS (SELECT 'trust' AS kind, host, trust::DOUBLE AS score, 0 AS step FROM seeds WHERE trust > 0
         UNION ALL SELECT 'distrust', host, distrust, 0 FROM seeds WHERE distrust > 0
         UNION ALL SELECT a.kind, a.dest, {damping} * sum(w.score * a.share), w.step + 1 FROM walk w JOIN arcs a ON w.kind = a.kind AND w.host = a.host
                   WHERE w.step < {rounds} GROUP BY a.kind, a.dest, w.step),
scores AS (SELECT host, round(coalesce(sum(score) FILTER (kind = 'trust'), 0), 6) AS trust, round(coalesce(sum(score) FILTER (kind = 'distrust'), 0), 6) AS distrust
           FROM walk GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(verdict, CASE WHEN distrust >= {block_at} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN scores s ON r.host = s.host
"""


ORACLE_SQL["op11_urls"] = _urls_sql()
