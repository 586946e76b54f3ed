"""Operator 12: URL filters with a blocked Bloom filter and an exact hash join.

A list holds canonical URLs (host and path, like ``example.com/en/``), each with a verdict. An entry fits
its host and all its subdomains where the page's path starts with the entry's; the longest fitting entry
decides.

1. The list becomes a blocked Bloom filter: blocks of 512 bits, one block a key, one bit in each of its eight
   words. Tasks build partial blocks, Spark ORs them (``bit_or``), so only the filter itself meets the
   driver. FILTER_BLOCKS bounds it (16 MB); a longer list makes more false hits, never a wrong verdict.
2. Every suffix of a page's host, then every listed path length under the suffixes that may be listed, is looked up
   in the filter. Most pages have no hit and are done without a shuffle.
3. Hits meet the list in a hash join on (host, path), which removes the false ones. A list of at most
   LIST_BYTES travels to the hits. A longer one is joined with the distinct hits, counted before they are
   shuffled; the most frequent confirmed keys (HOT_KEYS at most) travel, the others are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import words as W
from threadloom.llm.common import finish, mix, stage, staged_so_far, utf8

WORDS = 8  # 64-bit words of a block
KEY_BITS = 16  # bits of filter for each key
FILTER_BLOCKS = 1 << 18
LIST_BYTES = 8 << 20
HOT_KEYS, HOT_ROWS = 1024, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TURNS = np.array([W.BASE * (2 * k + 3) % (1 << 64) | 1 for k in range(WORDS)], np.uint64)
PARTIAL = "block int, " + ", ".join(f"w{k} bigint" for k in range(WORDS))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://``, up to ``/``, ``?`` or ``#``, A-Z lower-cased; then up to ``?`` or ``#``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def listed_keys(rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` from ``rules(rule, verdict)``, one row a key; of two verdicts block wins.

    A rule is ``host/path``; its host is lower-cased, without a ``/`` its path is empty. Null rules are left out.
    """
    host = F.translate(F.regexp_extract("rule", "^[^/]*", 0), UPPER, LOWER)
    path = F.regexp_extract("rule", "^[^/]*((?s:.*))", 1)
    return (rules.where("rule is not null").select(host.alias("host"), path.alias("path"), "verdict")
            .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
            .select("host", "path", F.concat("host", "path").alias("rule"), "verdict"))


# ---------------------------------------------------------------- the filter


def _places(key: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key and, for each of its words, the one bit that is set."""
    block = ((key >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    with np.errstate(over="ignore"):
        bit = (key[:, None] * TURNS) >> np.uint64(58)
    return block, np.uint64(1) << bit


def host_key(h: np.ndarray) -> np.ndarray:
    return mix(h ^ W.GOLDEN)


def url_key(host: np.ndarray, path: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(host ^ mix(path + W.GOLDEN))


def _hashes(column: pa.Array) -> np.ndarray:
    data, off = utf8(column)
    return W.span_hash(data, off[:-1], off[1:])


def _partial(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path = _hashes(batch.column("host")), _hashes(batch.column("path"))
            block, bits = _places(np.unique(np.concatenate([host_key(host), url_key(host, path)])), blocks)
            order = np.argsort(block, kind="stable")
            block, bits = block[order], bits[order]
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
            words = np.bitwise_or.reduceat(bits, first) if len(first) else bits
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[first].astype(np.int32))] + [pa.array(words[:, k].copy().view(np.int64)) for k in range(WORDS)],
                names=["block"] + [f"w{k}" for k in range(WORDS)])
    return run


def blocked_filter(keys: DataFrame, count: int) -> np.ndarray:
    """The filter of ``count`` listed keys as an array of blocks by WORDS, FILTER_BLOCKS blocks at most."""
    blocks = min(FILTER_BLOCKS, 1 << max(0, int(2 * count * KEY_BITS // (64 * WORDS)).bit_length()))
    filled = (keys.select("host", "path").mapInArrow(_partial(blocks), PARTIAL).groupBy("block")
              .agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)]).toPandas())
    out = np.zeros((blocks, WORDS), np.int64)
    out[filled["block"].to_numpy(np.int64)] = filled[[f"w{k}" for k in range(WORDS)]].to_numpy(np.int64)
    return out.view(np.uint64)


def may_hold(filled: np.ndarray, key: np.ndarray) -> np.ndarray:
    block, bits = _places(key, len(filled))
    return ((filled[block] & bits) == bits).all(1)


# ---------------------------------------------------------------- the lookup


def possible_hits(filled: np.ndarray, lengths: list[int], hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, place where the host's suffix begins, bytes of the path) of all keys that may be listed."""
    data, off = utf8(hosts)
    tail, toff = utf8(paths)
    dots = np.flatnonzero(data == 0x2E) + 1
    own = np.searchsorted(off, dots - 1, "right") - 1
    start = np.concatenate([off[:-1], dots])
    row = np.concatenate([np.arange(len(off) - 1), own])
    host = W.span_hash(data, start, off[row + 1])
    some = np.flatnonzero(may_hold(filled, host_key(host)))
    start, row, host = start[some], row[some], host[some]
    found = []
    size = np.diff(toff)
    for length in lengths:
        at = np.flatnonzero(size[row] >= length)
        begin = toff[row[at]]
        hit = at[may_hold(filled, url_key(host[at], W.span_hash(tail, begin, begin + length)))]
        found.append((row[hit], start[hit] - off[row[hit]], np.full(len(hit), length)))
    rows, starts, sizes = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    order = np.argsort(rows, kind="stable")
    return rows[order], starts[order], sizes[order]


def _probe(shared, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            rows, starts, sizes = possible_hits(filled, lengths, batch.column("host"), batch.column("path"))
            host, path = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            # listed lengths are byte lengths of whole code points, but may fall inside one of another path
            keys = [(host[r].encode()[s:].decode(), path[r].encode()[:n].decode(errors="replace"))
                    for r, s, n in zip(rows.tolist(), starts.tolist(), sizes.tolist())]
            pairs = pa.StructArray.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string())],
                                               names=["host", "path"])
            off = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(off), pairs)],
                                             names=[*batch.schema.names, "hits"])
    return run


def _confirmed(hits: DataFrame, keys: DataFrame, list_bytes: int) -> DataFrame:
    """``_row, rule, verdict`` of the hits that are listed."""
    on = ["host", "path"]
    if list_bytes <= LIST_BYTES:
        return hits.join(F.broadcast(keys), on).select("_row", "rule", "verdict")
    met = stage(hits.groupBy(*on).agg(F.count("*").alias("c")).join(keys.hint("shuffle_hash"), on), "url-keys")
    hot = stage(met.where(f"c > {HOT_ROWS}").orderBy(F.desc("c"), "rule").limit(HOT_KEYS), "url-hot-keys")
    rest = met.join(F.broadcast(hot.select(*on)), on, "left_anti")
    both = hits.join(F.broadcast(hot), on).unionByName(hits.join(rest.hint("shuffle_hash"), on))
    return both.select("_row", "rule", "verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)``; other columns are ignored.

    ``rules(rule, verdict)`` lists canonical URLs. The longest fitting rule decides; a page that no rule fits
    has a null rule and the ``default`` verdict. A null url, or one without ``://``, has an empty host and path,
    which only rules of an empty host and path fit. Repeated rows, and rows with a null id, are judged one by one;
    empty tables give empty results, an empty list the default for all.
    """
    first_step = staged_so_far()
    keys = stage(listed_keys(rules), "url-list")
    count, size, lengths = keys.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("rule") + 40), F.lit(0)),
                                    F.collect_set(F.octet_length("path"))).first()
    shared = pages.sparkSession.sparkContext.broadcast(blocked_filter(keys, count))
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col("page_id").alias("page_id"), host.alias("host"), path.alias("path"))
    schema = f"page_id {parts.schema['page_id'].dataType.simpleString()}, host string, path string, hits array<struct<host:string,path:string>>"
    # the row number is read back from files, so a task that runs again cannot change it
    probed = stage(parts.mapInArrow(_probe(shared, sorted(lengths)), schema).withColumn("_row", F.monotonically_increasing_id()), "url-hits")
    hits = probed.select("_row", F.explode("hits").alias("k")).select("_row", "k.host", "k.path")
    best = (_confirmed(hits, keys, size).groupBy("_row")
            .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best")).select("_row", "best.rule", "best.verdict"))
    some = probed.where("size(hits) > 0").drop("hits").join(best, "_row", "left")
    none = probed.where("size(hits) = 0").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    out = some.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")).unionByName(none)
    return finish(first_step, out)[0]
