"""URL filter: sorted digest array of rules, memory-mapped, probed by binary search.

A rule is a host and a path prefix; it fits the host, all its subdomains, and every path
that starts with its path. The longest fitting rule decides, else ``default`` does.
Rules are stored as their 64-bit xxhash keys in one sorted array beside the strings
themselves. A url's candidates are its host suffixes joined with its path's prefixes, of
just those lengths that some rule of the index has. A batch probes all candidates by one
vectorised binary search and compares the stored string, so a collision can't decide.

The index is one file in the shared folder, mapped by every task; it holds what the given
rules hold, whatever the size of the table.

A null url, or one without ``://``, has an empty host and path; null ids keep their rows, and
a url's length is unbounded. Repeated rows are judged row by row. Of the input only the id and the url are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_file, shared_folder, small_batches, write_file


def build_index(uri: str, rules: Iterable[tuple[str, str, str]]) -> str:
    """Write the index of (action, host, path) rules. Of equal rules the last one counts."""
    last = {(host + path).encode(): (action == "block", len(host.encode()), host.count(".") + 1) for action, host, path in rules}
    keys = sorted((xxhash.xxh64_intdigest(k), k) for k in last)
    at = np.zeros(len(keys) + 1, np.int64)
    np.cumsum([len(k) for _, k in keys], out=at[1:])
    write_file(
        uri,
        {
            "digest": np.array([h for h, _ in keys], np.uint64),
            "at": at,
            "text": np.frombuffer(b"".join(k for _, k in keys), np.uint8),
            "block": np.array([last[k][0] for _, k in keys], np.uint8),
            "host_len": np.array([last[k][1] for _, k in keys], np.int64),
            "path_lens": np.array(sorted({len(k) - v[1] for k, v in last.items()}), np.int64),
            "labels": np.array(sorted({v[2] for v in last.values()}), np.int64),
        },
    )
    return uri


def find(index: dict[str, np.ndarray], pairs: list[tuple[str, str]]) -> list[tuple[str | None, bool]]:
    """The deciding rule of each (host, path), as its string and whether it blocks."""
    digest, at, text = index["digest"], index["at"], index["text"]
    lens, depths = index["path_lens"].tolist(), set(index["labels"].tolist())
    keys: list[bytes] = []
    hosts: list[int] = []
    owner: list[int] = []
    for i, (host, path) in enumerate(pairs):
        h, p = host.encode(), path.encode()
        fits = [n for n in lens if n <= len(p)]
        parts = h.split(b".")
        for k in range(len(parts)):
            if len(parts) - k in depths:
                tail = b".".join(parts[k:])
                for n in fits:
                    keys.append(tail + p[:n])
                    hosts.append(len(tail))
                    owner.append(i)
    best: list[tuple[str | None, bool]] = [(None, False)] * len(pairs)
    if not keys or not len(digest):
        return best
    probe = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
    place = np.searchsorted(digest, probe)
    hit = np.flatnonzero((place < len(digest)) & (digest[np.minimum(place, len(digest) - 1)] == probe))
    size = [-1] * len(pairs)
    for j in hit.tolist():
        r = int(place[j])
        while r < len(digest) and digest[r] == probe[j]:  # rules whose digests collide stand side by side
            stored = text[at[r] : at[r + 1]].tobytes()
            if stored == keys[j] and int(index["host_len"][r]) == hosts[j]:
                i = owner[j]
                if len(stored) > size[i]:
                    size[i], best[i] = len(stored), (stored.decode(), bool(index["block"][r]))
                break
            r += 1
    return best


def judge_urls(
    df: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row."""
    spark = df.sparkSession
    small_batches(spark, 10_000)
    uri = build_index(f"{shared_folder(spark)}/urls.idx", rules)
    url = F.col(url_col).cast("string")
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    parts = df.select(
        F.col(id_col).alias("page_id"),
        F.coalesce(F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = map_file(uri)  # mapped by each task, kept by none
        for b in batches:
            found = find(index, list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)))
            verdict = [default if r is None else "block" if bad else "allow" for r, bad in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([r for r, _ in found], pa.string()), pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    kind = parts.schema["page_id"].dataType.simpleString()
    return parts.mapInArrow(judged, f"page_id {kind}, host string, path string, rule string, verdict string")
