"""SimHash near-dedup by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32.  Two fingerprints
that differ in at most three bits differ in at most one bit of some segment,
so looking up the ball of radius one around each segment finds every pair;
the complete distance is verified.  The relation is symmetric, so only the
half of the ball that sets a bit is enumerated."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._common import bound_batches, free_prefix, remove, save
from .components import connected_components

SEED = 42
#: members of one segment value that are compared in one task; larger tables of
#: a value are searched by enumerating the whole ball instead
MAX_TABLE = 8192
#: shingles hashed at once
PIECE = 1 << 16
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, k: int = 3) -> int:
    """Unsigned SimHash of the k-word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) >= k:
        starts, ends = starts[:len(words) - k + 1], ends[k - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    sums, digest = np.zeros((8, 8), np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), PIECE):
        spans = zip(starts[at:at + PIECE].tolist(), ends[at:at + PIECE].tolist())
        raw = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
        for j in range(8):
            sums[j] += np.bincount(raw[:, j], minlength=256) @ _BYTE_BITS
    bits = (2 * sums.reshape(64) > len(starts)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprint_udf(k: int = 3):
    """Column function text -> fingerprint as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, k) for t in texts], np.uint64).view(np.int64))

    return simhash


def _ball(bits: range, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _table_links(fp: np.ndarray, member: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Stars that connect a table's linked fingerprints (members first); each is expanded once."""
    src, dst = [], []
    left = np.arange(len(fp))
    while len(left):
        root, frontier = left[0], left[:1]
        left = left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for f in frontier:
                near |= (np.bitwise_count(fp[left] ^ fp[f]) <= max_bits) & (member[f] | member[left])
            frontier, left = left[near], left[~near]
            src += fp[frontier].view(np.int64).tolist()
            dst += [int(fp[root:root + 1].view(np.int64)[0])] * len(frontier)
    return src, dst


def _linker(max_bits: int, small: int = 16):
    """For rows ``(seg, key, prober, fp)`` sorted so: verified links inside each table."""

    def links_of(key: np.ndarray, member: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        src, dst = [], []
        group = np.repeat(size, size)
        for d in range(1, small):  # pairs d apart in small tables, members come first
            i = np.flatnonzero((key[d:] == key[:-d]) & member[:-d] & (group[:-d] <= small))
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits]
            src.append(fp[i].view(np.int64))
            dst.append(fp[i + d].view(np.int64))
        for a, n in zip(first[size > small], size[size > small]):
            if member[a]:
                s, t = _table_links(fp[a:a + n], member[a:a + n], max_bits)
                src.append(np.array(s, np.int64))
                dst.append(np.array(t, np.int64))
        none = [np.empty(0, np.int64)]
        return pd.DataFrame({"src": np.concatenate(src or none), "dst": np.concatenate(dst or none)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep: list[np.ndarray] | None = None
        for batch in batches:
            now = [(batch["seg"].to_numpy(np.int64) << 32) | batch["key"].to_numpy(np.int64),
                   batch["prober"].to_numpy(np.int64) == 0, batch["fp"].to_numpy(np.int64).view(np.uint64)]
            now = now if keep is None else [np.concatenate(x) for x in zip(keep, now)]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last table may go on in the next batch
            keep = [x[last:] for x in now]
            if last:
                yield links_of(*[x[:last] for x in now])
        if keep is not None and len(keep[0]):
            yield links_of(*keep)

    return run


def near_links(fps: DataFrame, max_bits: int = 3, max_table: int = MAX_TABLE) -> DataFrame:
    """``fps(fp)``, distinct signed longs -> links ``(src, dst)`` that connect whatever lies within ``max_bits``.

    Inside a large table of one segment value a spanning set of links stands
    for all of them, so the components are exact while the rows stay few.
    ``max_bits`` up to 3 (radius one in either of two segments)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with balls of radius one find distances up to 3")
    halves = F.explode(F.array(
        F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("key")),
        F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")))).alias("s")
    members, path = save(fps.select("fp", halves).select("fp", "s.seg", "s.key"), "segments")
    hot = members.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > max_table).select("seg", "key")
    crowded = members.join(hot, ["seg", "key"], "left_semi")
    any_hot = not hot.isEmpty()
    calm = members.join(hot, ["seg", "key"], "left_anti") if any_hot else members
    bits = F.explode(F.array([F.lit(1 << b) for b in range(32)])).alias("bit")
    probes = (calm.select("fp", "seg", "key", bits).where(F.col("key").bitwiseAND(F.col("bit")) == 0)
              .select("fp", "seg", F.col("key").bitwiseOR(F.col("bit")).alias("key"), F.lit(1).alias("prober")))
    table = calm.withColumn("prober", F.lit(0)).unionByName(probes).repartition("seg", "key")
    links = table.sortWithinPartitions("seg", "key", "prober", "fp").mapInPandas(_linker(max_bits), "src long, dst long")
    if any_hot:
        found = []
        for seg, own, rest in ((0, range(32, 64), range(32)), (1, range(32), range(32, 64))):
            masks = {a | b for a in _ball(own, 1) for b in _ball(rest, max_bits - bin(a).count("1")) if a | b}
            balls = F.explode(F.array([F.lit(_signed(m)) for m in sorted(masks)])).alias("mask")
            near = crowded.where(F.col("seg") == seg).select("fp", balls)
            found.append(near.select(F.col("fp").alias("src"), F.col("fp").bitwiseXOR(F.col("mask")).alias("dst")))
        reach = found[0].unionByName(found[1])
        links = links.unionByName(reach.join(fps.select(F.col("fp").alias("dst")), "dst", "left_semi").select("src", "dst"))
    out, _ = save(links, "links")
    remove(fps.sparkSession, path)
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3, max_bits: int = 3,
               max_table: int = MAX_TABLE) -> DataFrame:
    """``(<id>, fingerprint, component_id)``, one row for each row of ``docs``.

    The fingerprint is 16 lower-case hex digits.  Documents whose
    fingerprints differ in at most ``max_bits`` bits are linked; the component
    is the smallest id reachable.  A null, empty or wordless text has
    fingerprint zero and links like any other.  Rows with a null id get a
    component but never name it (null where all its ids are null).  Repeated
    rows repeat; an empty table gives an empty one."""
    bound_batches(docs.sparkSession)
    marked, _ = save(docs.select(F.col(id_col).alias("doc"), fingerprint_udf(k)(F.col(text)).alias("fp")), "fingerprints")
    groups, _ = save(marked.groupBy("fp").agg(F.min("doc").alias("least")), "groups")
    parts = connected_components(near_links(groups.select("fp"), max_bits, max_table))
    named = groups.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.join(least, "component").select("fp", "component_id")
    return (marked.join(of_fp, "fp")
            .select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` without the near copies: of each component the rows with the smallest id stay.

    Rows with a null id stay only if no row of their component has an id.
    Rows that repeat the kept id all stay.  Where an id bears several texts,
    each is judged by its own component."""
    found = near_dedup(docs, id_col, text, k, max_bits)
    print_of = F.lower(F.lpad(F.hex(fingerprint_udf(k)(F.col(text))), 16, "0"))
    lost = found.where(F.col(id_col) != F.col("component_id")).select(id_col, "fingerprint").distinct()
    both = lost.select(id_col).distinct().join(found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct(), id_col, "left_semi")
    nameless = docs.where(F.col(id_col).isNull())
    out = docs.join(lost.select(id_col).distinct(), id_col, "left_anti").where(F.col(id_col).isNotNull()).select(*docs.columns)
    # only rows of ids that are lost by one text and kept by another need their fingerprint again
    f = f"{free_prefix(docs)}fingerprint"
    split = docs.join(both, id_col, "left_semi").withColumn(f, print_of)
    split = split.join(lost.withColumnRenamed("fingerprint", f), [id_col, f], "left_anti").select(*docs.columns)
    alone = found.where(F.col(id_col).isNull() & F.col("component_id").isNull()).select("fingerprint").distinct()
    kept = nameless.withColumn(f, print_of).join(alone.withColumnRenamed("fingerprint", f), f, "left_semi").drop(f)
    return out.unionByName(split).unionByName(kept.select(*docs.columns))
