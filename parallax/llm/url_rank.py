"""URL filters: allow and block rules, and for what no rule judges, trust and distrust spread over the link graph of hosts.

Trust is personalised PageRank from the hosts that rules allow, along the
links; distrust the same from the hosts that rules block, against the links
(who links to a bad host is suspect).  Hosts and links are Spark tables; a
round joins scores with arcs and sums them by host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import broadcast_if_small
from ._common import remove, save

#: part of a score that goes on along the links
DAMPING = 0.85
#: scores are summed until what a round adds is this part of the seeds, in at most so many rounds
TOLERANCE, ROUNDS = 1e-3, 60
#: distrust from which a host is blocked, if it is above its trust; a host with all pages blocked has 1 by itself
BLOCK_AT = 0.5
#: arcs of one host that meet its score in one task
ARCS_A_PART = 100_000

#: text that holds no links
NO_LINKS = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)"
#: the host of an absolute link
LINK = r"""(?i)<(?:a|area)[ \t\n\f\r/](?:[^<>]*?[ \t\n\f\r"'/])?href[ \t\n\f\r]*=[ \t\n\f\r]*["']?[ \t\n\f\r]*(?:https?:)?//([^/?#"'<> \t\n\f\r]+)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``, null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def linked_hosts(html: Column) -> Column:
    """The distinct hosts that a page's absolute links name."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), NO_LINKS, " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER)))


def _rules(spark: SparkSession, rules) -> tuple[DataFrame, list[int]]:
    """One row a host: its rules; and the numbers of labels that hosts have."""
    given = not isinstance(rules, DataFrame)
    df = spark.createDataFrame(list(rules), "verdict string, rule string") if given else rules.select("verdict", "rule")
    host = F.lower(F.substring_index("rule", "/", 1))
    one = F.struct(F.length("rule").alias("size"), F.length(host).alias("host_size"), "rule", "verdict",
                   F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("path"))
    by_host = df.where("rule is not null").groupBy(host.alias("rule_host")).agg(F.collect_set(one).alias("fits"))
    saved, _ = save(by_host, "rules")
    depths = sorted(r[0] for r in saved.select(F.size(F.split("rule_host", r"\.")).alias("d")).distinct().collect())
    return saved, depths


def apply_rules(pages: DataFrame, rules) -> DataFrame:
    """``pages`` with ``host`` and ``path`` -> the same with ``rule`` and its ``verdict``, null where none fits.

    A rule ``host/path`` fits its host and all below it if the page's path
    starts with the rule's; of several the longest wins, of those the one
    with the longer host.  ``rules`` is a list of ``(verdict, rule)`` or a
    DataFrame of such rows, joined once for each number of labels its hosts have."""
    table, depths = _rules(pages.sparkSession, rules)
    table = broadcast_if_small(table)
    out = pages.withColumn("fits", F.array().cast(table.schema["fits"].dataType))
    for d in depths:
        some = table.select("rule_host", F.col("fits").alias("more"))
        fitting = F.filter("more", lambda r: F.col("path").startswith(r["path"]))
        out = (out.join(some, F.substring_index("host", ".", -d) == F.col("rule_host"), "left")
               .withColumn("fits", F.concat("fits", F.coalesce(fitting, F.slice("fits", 1, 0)))).drop("rule_host", "more"))
    best = F.array_max("fits")
    return out.select(*pages.columns, best["rule"].alias("rule"), best["verdict"].alias("verdict"))


def spread_scores(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int = ROUNDS,
                  arcs_a_part: int = ARCS_A_PART) -> DataFrame:
    """``links(src, dst, n)`` and ``seeds(host, trust, distrust)`` -> ``(host, trust, distrust)``.

    Each score is its seed, plus ``damping`` times what links bring: trust
    goes from a host to those it links to, distrust to those that link to
    it, in proportion to ``n``.  A score without a link to go along ends
    there.  Scores that are not above zero may be missing.  The arcs of one
    host are dealt in parts of about ``arcs_a_part``, to which its score is copied."""
    spark = links.sparkSession
    arcs = links.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n"),
                                          F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))).alias("a")).select("a.*")
    out = arcs.groupBy("kind", "host").agg(F.sum("n").alias("all"), F.ceil(F.count("*") / arcs_a_part).alias("parts"))
    out, out_path = save(out, "hosts")
    dealt = arcs.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("share"), F.pmod(F.xxhash64("to"), "parts").alias("part"))
    dealt, arcs_path = save(dealt, "arcs")
    now = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust").cast("double"), F.lit("distrust"), F.col("distrust").cast("double")))
                       .alias("kind", "score")).where("score > 0")
    now, path = save(now.select("kind", "host", "score"), "scores")
    all_, paths = now, [path]
    start = now.agg(F.sum("score")).first()[0] or 0.0
    for _ in range(rounds):
        sent = now.join(out, ["kind", "host"]).select("kind", "host", "score", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        step = (sent.join(dealt, ["kind", "host", "part"]).groupBy("kind", F.col("to").alias("host"))
                .agg((F.sum(F.col("score") * F.col("share")) * F.lit(damping)).alias("score")))
        now, path = save(step, "scores")
        paths.append(path)
        added = now.agg(F.sum("score")).first()[0] or 0.0
        if not added:
            break
        all_ = all_.unionByName(now)
        if added <= tolerance * start:
            break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    total, _ = save(all_.groupBy("host").agg(of("trust"), of("distrust")), "trust")
    remove(spark, out_path, arcs_path, *paths)
    return total


def judge(pages: DataFrame, rules, id_col: str = "page_id", url: str = "url", html: str = "html", block_at: float = BLOCK_AT, **spreading) -> DataFrame:
    """``(<id>, host, path, rule, verdict)``, one row for each row of ``pages``.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or
    the end, A-Z lower-cased, the path what follows up to ``?``, ``#`` or the
    end; both are empty for a null url or one without ``://``.  Where no rule
    fits (see :func:`apply_rules`) the host is judged: it is blocked if its
    distrust is ``block_at`` or more and above its trust (both rounded to six
    places), else allowed, as are pages without a host.  A host starts with
    the part of its pages that rules allow as trust, and the part they block
    as distrust (:func:`spread_scores`); links are the absolute ones
    of ``<a>`` and ``<area>`` outside comments, scripts and styles, each once
    a page, to other hosts.  A null html has none; repeated rows count
    each time; other columns are not read; an empty table gives no rows."""
    spark = pages.sparkSession
    parts = pages.select(F.col(id_col).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = apply_rules(parts, rules)
    share = lambda v: F.avg((F.coalesce("verdict", F.lit("")) == v).cast("double"))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    links = (pages.select(host_of(F.col(url)).alias("src"), F.explode(linked_hosts(F.col(html))).alias("dst"))
             .where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n")))
    links, path = save(links, "links")
    scores = spread_scores(links, seeds, **spreading)
    remove(spark, path)
    bad, _ = save(scores.where((F.round("distrust", 6) >= block_at) & (F.round("distrust", 6) > F.round("trust", 6)))
                  .select(F.col("host").alias("bad_host")), "blocked")
    return (ruled.join(broadcast_if_small(bad), F.col("host") == F.col("bad_host"), "left")
            .select(F.col("id").alias(id_col), "host", "path", "rule",
                    F.coalesce("verdict", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict")))
