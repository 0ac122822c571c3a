"""Derived fixtures (FIXTURES.md section 3) over the given test tables.

Every fixture exists twice: a Spark builder (used by the registered
queries) and the equivalent DuckDB SQL (used by the oracle).  The Spark
builders go through the library's own operators, so the oracle checks them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PY_WHITESPACE, WS_CLASS, py_strip, words
from ..operators.nbest import group_nbest
from ..operators.scan import positioned_lines
from ..session import spread


TEXT_TABLES = ("documents", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """A test table; text tables are spread over the cores when the file is
    a single split (CPU-bound text work must not run in one task)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return spread(df) if name in TEXT_TABLES else df


# ---------------------------------------------------------------------------
# Spark builders
# ---------------------------------------------------------------------------
def lines(spark, d, even: bool = True) -> DataFrame:
    """FX1: documents split on newline, position kept; corpus = source.  ``even=False`` leaves
    the documents in their splits, for work that only sorts the lines."""
    columns = ["source", "lang", "doc_id", "text"]
    docs = table(spark, d, "documents", columns) if even else spark.read.parquet(f"{d}/documents.parquet").select(*columns)
    return (docs.select(F.col("source").alias("corpus"), "lang", "doc_id",
                        F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
            .select("corpus", "lang", "doc_id",
                    (F.col("pos") + 1).cast("long").alias("line_no"),
                    py_strip("raw").alias("text")))


def positioned(spark, d, total=None) -> DataFrame:
    """FX1 with each line's position in its corpus (and the corpus's line count)."""
    docs = table(spark, d, "documents", ["source", "lang", "doc_id", "text"])
    docs = docs.select(F.col("source").alias("corpus"), "lang", "doc_id", F.split("text", "\n", -1).alias("parts"))
    out = positioned_lines(docs, ["corpus"], "parts", item="raw", total=total)
    return out.withColumn("text", py_strip("raw")).drop("raw")


def pairs_parts(spark, d) -> DataFrame:
    """FX2: part p aligned with part p+1: hyp = p_name, ref = next p_name."""
    p = table(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("seg_id"), F.col("p_name").alias("hyp"))
    b = p.select((F.col("p_partkey") - 1).alias("seg_id"), F.col("p_name").alias("ref"))
    return a.join(b, "seg_id")


def pairs_conv(spark, d) -> DataFrame:
    """FX3: user turn t aligned with assistant turn t+1 of the same conversation."""
    c = table(spark, d, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("source"))
    a = (c.where(F.col("role") == "assistant")
         .select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target")))
    return u.join(a, ["conv_id", "turn"])


def pairs_docs(spark, d) -> DataFrame:
    """FX4: lines of document d aligned with lines of document d+1 by line_no.

    Whole documents meet, once each way and straight from the scan, and are cut
    afterwards, so that no line is moved; a side whose text nobody reads
    travels as its number of lines."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n_lines = F.size(F.split("text", "\n", -1))
    src = docs.select(F.col("source").alias("corpus"), "lang", "doc_id", n_lines.alias("__n"), F.col("text").alias("__s")).where("__s IS NOT NULL")
    tgt = docs.select((F.col("doc_id") - 1).alias("doc_id"), n_lines.alias("__m"), F.col("text").alias("__t")).where("__t IS NOT NULL")
    both = src.repartition("doc_id").join(tgt, "doc_id")
    cut = both.select("doc_id", "corpus", "lang", F.split("__s", "\n", -1).alias("__s"), F.split("__t", "\n", -1).alias("__t"),
                      F.explode(F.sequence(F.lit(1), F.least("__n", "__m"))).alias("__i"))
    at = lambda side: py_strip(F.element_at(side, F.col("__i")))
    return cut.select("doc_id", F.col("__i").cast("long").alias("line_no"), "corpus", "lang", at("__s").alias("source"), at("__t").alias("target"))


def subwords(spark):
    """A column function text -> ids with the pieces of a public vocabulary of 32,000."""
    import public_tokenizers
    from ..functions.pieces import piece_encoder
    return piece_encoder(spark, public_tokenizers.path("piece_bpe_32k.model"))


def line_systems(spark, d) -> DataFrame:
    """Two systems on whole lines: line n of documents d+1 and d+2 as outputs for line n of document d.

    Whole documents meet and are cut afterwards, down to the shortest one's last line.  The parts are
    numbered, so that those of few bytes, but dear work, are not put together."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL")
    side = lambda k, name: docs.select((F.col("doc_id") - k).alias("doc_id"), F.col("text").alias(name))
    both = side(0, "__r").repartition(parts, "doc_id").join(side(1, "__a"), "doc_id").join(side(2, "__b"), "doc_id")
    cut = both.select("doc_id", F.posexplode_outer(F.arrays_zip(*[F.split(c, "\n", -1).alias(c) for c in ("__a", "__b", "__r")])).alias("__i", "__x"))
    out = cut.select(F.concat_ws("-", "doc_id", (F.col("__i") + 1).cast("long")).alias("seg_id"),
                     *[F.col(f"__x.{c}").alias(c) for c in ("__a", "__b", "__r")]).where("__a IS NOT NULL AND __b IS NOT NULL AND __r IS NOT NULL")
    return out.select("seg_id", *[py_strip(c).alias(n) for c, n in (("__a", "hyp_a"), ("__b", "hyp_b"), ("__r", "ref"))])


def nbest(spark, d) -> DataFrame:
    """FX5: part as a flat n-best list of stride 5."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("flat_pos"),
                                       F.col("p_name").alias("text"),
                                       F.col("p_size").cast("double").alias("loss"))
    return group_nbest(p, "flat_pos", 5)


def vlog(spark, d) -> DataFrame:
    """FX6: validation log: run = user, task = event type, step = event id."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("run"), F.col("event_type").alias("task"),
                    F.col("event_id").alias("step"), F.col("value").alias("bleu"),
                    F.get_json_object("props", "$.k").cast("double").alias("chrf"),
                    (F.col("value") / 100.0).alias("loss"))


def ckpt(spark, d) -> DataFrame:
    """FX7: checkpoint listing: run, kind, step, ctime."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("run"), F.col("event_type").alias("kind"),
                    F.col("event_id").alias("step"), F.col("ts").alias("ctime"))


def line_labels(spark, d) -> DataFrame:
    """FX8: one language label per line, ``__label__{lang}``."""
    return lines(spark, d).select("doc_id", "line_no",
                                  F.concat(F.lit("__label__"), "lang").alias("label"))


def tokens(spark, d) -> DataFrame:
    """FX10: lines as integer ids (word length stands in for a subword id)."""
    return lines(spark, d).select("corpus", "doc_id", "line_no",
                                  F.transform(words("text"), lambda w: F.length(w)).alias("ids"))


def two_systems(spark, d) -> DataFrame:
    """FX11: system A = FX2 hyp; B = first word of ref + second word of hyp."""
    p = pairs_parts(spark, d)
    b = F.concat_ws(" ", F.try_element_at(F.split("ref", " "), F.lit(1)),
                    F.try_element_at(F.split("hyp", " "), F.lit(2)))
    return p.select("seg_id", F.col("hyp").alias("hyp_a"), b.alias("hyp_b"), "ref")


# ---------------------------------------------------------------------------
# DuckDB SQL for the same fixtures
# ---------------------------------------------------------------------------
WS_SQL = "||".join(f"chr({ord(c)})" for c in PY_WHITESPACE)
WS_RE_SQL = "'" + WS_CLASS + "'"


def sql_words(expr: str) -> str:
    s = f"trim(regexp_replace({expr}, {WS_RE_SQL} || '+', ' ', 'g'))"
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split({s}, ' ') END)"


FIXTURE_SQL = {
    "lines": f"""
        SELECT corpus, lang, doc_id, CAST(i AS BIGINT) AS line_no, trim(parts[i], {WS_SQL}) AS text
        FROM (SELECT source AS corpus, lang, doc_id, parts, unnest(generate_series(1, len(parts))) AS i
              FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents))""",
    "pairs_parts": """
        SELECT a.p_partkey AS seg_id, a.p_name AS hyp, b.p_name AS ref
        FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""",
    "pairs_conv": """
        SELECT u.conv_id, u.turn, u.text AS source, a.text AS target
        FROM conversations u JOIN conversations a
          ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    "pairs_docs": """
        SELECT s.corpus, s.lang, s.doc_id, s.line_no, s.text AS source, t.text AS target
        FROM lines s JOIN lines t ON t.doc_id = s.doc_id + 1 AND t.line_no = s.line_no""",
    "nbest": """
        SELECT CAST(p_partkey // 5 AS BIGINT) AS sent_id, CAST(p_partkey % 5 AS INTEGER) AS hyp_idx,
               p_name AS text, CAST(p_size AS DOUBLE) AS loss
        FROM part""",
    "vlog": """
        SELECT user_id AS run, event_type AS task, event_id AS step, value AS bleu,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS chrf, value / 100.0 AS loss
        FROM events""",
    "ckpt": """
        SELECT user_id AS run, event_type AS kind, event_id AS step, ts AS ctime FROM events""",
    "line_labels": """
        SELECT doc_id, line_no, '__label__' || lang AS label FROM lines""",
    "tokens": f"""
        SELECT corpus, doc_id, line_no, list_transform({sql_words('text')}, lambda w: CAST(length(w) AS INTEGER)) AS ids
        FROM lines""",
    "two_systems": """
        SELECT seg_id, hyp AS hyp_a,
               concat_ws(' ', string_split(ref, ' ')[1], string_split(hyp, ' ')[2]) AS hyp_b, ref
        FROM pairs_parts""",
}

# dependency order for the WITH clause
FIXTURE_ORDER = ["lines", "pairs_parts", "pairs_conv", "pairs_docs", "nbest", "vlog", "ckpt",
                 "line_labels", "tokens", "two_systems"]


def with_fixtures(sql: str, extra_ctes: list[tuple[str, str]] | None = None,
                  recursive: bool = False) -> str:
    """Prefix ``sql`` with the fixture CTEs it mentions (and their deps)."""
    import re
    text = sql + " ".join(b for _, b in (extra_ctes or []))
    needed: set[str] = set()

    def need(name):
        if name in needed:
            return
        needed.add(name)
        body = FIXTURE_SQL[name]
        for other in FIXTURE_ORDER:
            if other != name and re.search(rf"\b{other}\b", body):
                need(other)

    for name in FIXTURE_ORDER:
        if re.search(rf"\b{name}\b", text):
            need(name)
    ctes = [f"{n} AS ({FIXTURE_SQL[n]})" for n in FIXTURE_ORDER if n in needed]
    ctes += [f"{n} AS ({b})" for n, b in (extra_ctes or [])]
    if not ctes:
        return sql
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + "\n" + sql


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_regex_chain(expr: str, rules) -> str:
    """The same ordered (pattern, replacement) chain as DuckDB SQL."""
    import re
    for pat, rep in rules:
        rep = re.sub(r"\$(\d)", r"\\\1", rep)
        expr = f"regexp_replace({expr}, {sql_str(pat)}, {sql_str(rep)}, 'g')"
    return expr
