"""The N highest-scoring items of every group, with a consistent tie rule, by skipping on statistics.

Items are laid out once in Parquet files clustered by group; a group of any size is spread over as many files as it needs, by falling score. A file
holds sections of some consecutive groups each (the smallest groups apart, a large one alone), and within a section items go by falling score, so that each of its
row groups covers a range of scores. A manifest lists the files, their sections and each row group's statistics; a file's footer lists its groups and how
many items each has. Reading then goes by the statistics:

- Of row groups with one group only, a smallest score with N items above it bounds that group's N-th from below before anything is read; row groups of that
  group with a maximum strictly below the bound are left out of the plan.
- Each task reads a section's row groups by falling maximum score and skips those whose maximum is strictly below the present N-th score of every group that they
  may contain: the section's groups of which items are left unread.
- What remains, at most N items per group and file, meets in a final ranking.

The layout can be kept and asked again for any N.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse, urlunparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panewright.sources import scratch_path

#: Items in a file, at least and at most; in a section, about; in a row group, at least and at most; in a group that is kept with other small ones.
FILE_ROWS, FILE_ROWS_MOST = 50_000, 1_000_000
SECTION_ROWS, ROW_GROUP_ROWS, ROW_GROUP_ROWS_MOST, SMALL_GROUP = 16_384, 2_048, 65_536, 16
#: Bytes of files that a task reads, about.
TASK_BYTES = 64 * 1024 * 1024

#: Schemes of Hadoop's file systems and of pyarrow's.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss"}


def _key(columns: list[Column]) -> Column:
    """One string that stands for the values of the group columns, nulls included, and for no others."""
    return F.concat(*(F.when(c.isNull(), "N").otherwise(F.concat(F.lit("V"), F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns))


def _file_system(path: str):  # noqa: ANN202
    """pyarrow's file system of a path and the path in it. Executors need what it needs: credentials in the environment, for hdfs libhdfs."""
    from pyarrow import fs

    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    if parts.scheme not in _SCHEMES:
        raise ValueError(f"files of {parts.scheme}:// can't be opened; give cluster() a path of another file system that executors share")
    return fs.FileSystem.from_uri(urlunparse(parts._replace(scheme=_SCHEMES[parts.scheme])))


_ROW_GROUP = "struct<k: int, n: bigint, s_least: bigint, s_most: bigint, section: int, own: string>"
_MANIFEST = f"path string, items bigint, bytes bigint, g_least string, g_most string, row_groups array<{_ROW_GROUP}>"


def _sections(counts: np.ndarray) -> np.ndarray:
    """The section of each group of a file: groups of at most SMALL_GROUP items together first, groups of a section's size alone."""
    large, small = counts >= SECTION_ROWS, counts <= SMALL_GROUP
    label = np.empty(len(counts), dtype=np.int64)
    for who, base in ((small, -(1 << 40)), (~small & ~large, 0)):
        held = np.where(who, counts, 0)
        label[who] = base + ((np.cumsum(held) - held) // SECTION_ROWS)[who]
    label[large] = (1 << 40) + np.arange(int(large.sum()))
    return np.unique(label, return_inverse=True)[1]


def _write(folder: str):  # noqa: ANN202
    """Writes each partition as one file under a name of its own, so that a repeated task leaves no part of a file that the manifest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [b for b in batches if b.num_rows]
        if not read:
            return
        t = pa.Table.from_batches(read).unify_dictionaries()
        keys = t.column("g").combine_chunks().dictionary_encode()
        groups = keys.dictionary
        ranks = np.asarray(pc.rank(groups, sort_keys="ascending")).astype(np.int64) - 1
        groups, c = groups.take(pa.array(np.argsort(ranks))), ranks[np.asarray(keys.indices)]
        s, i = (t.column(x).combine_chunks().to_numpy() for x in ("s", "i"))
        counts = np.bincount(c, minlength=len(groups))
        section_of = _sections(counts)
        order = np.lexsort((i, ~s, section_of[c]))  # ~s falls as s rises, without overflow
        c, s, i = c[order], s[order], i[order]
        cuts = np.searchsorted(section_of[c], np.arange(section_of.max() + 2))
        sizes = np.bincount(section_of)

        listed = pa.table({"g": groups, "n": counts, "section": section_of.astype(np.int32)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, listed.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(listed)
        schema = pa.schema([("c", pa.int32()), ("s", pa.int64()), ("i", pa.int64())])
        path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.parquet"
        system, local = _file_system(path)
        system.create_dir(local.rsplit("/", 1)[0], recursive=True)
        stats: list[dict] = []
        with system.open_output_stream(local) as f:
            with pq.ParquetWriter(f, schema, compression="zstd", store_schema=False) as writer:
                writer.add_key_value_metadata({b"groups": sink.getvalue().to_pybytes()})
                for k, (low, high) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
                    rows = min(max((high - low) // 8, ROW_GROUP_ROWS), ROW_GROUP_ROWS_MOST)
                    writer.write_table(pa.table([pa.array(c[low:high], pa.int32()), s[low:high], i[low:high]], schema=schema), row_group_size=rows)
                    own = groups[int(c[low])].as_py() if sizes[k] == 1 else None
                    for at in range(low, high, rows):
                        end = min(at + rows, high)
                        stats.append({"k": len(stats), "n": end - at, "s_least": int(s[end - 1]), "s_most": int(s[at]), "section": k, "own": own})
            size = f.tell()
        kind = pa.list_(pa.struct([("k", pa.int32()), ("n", pa.int64()), ("s_least", pa.int64()), ("s_most", pa.int64()), ("section", pa.int32()), ("own", pa.string())]))
        columns = [[path], [len(c)], [size], [groups[0].as_py()], [groups[-1].as_py()], pa.array([stats], kind)]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["path", "items", "bytes", "g_least", "g_most", "row_groups"])

    return run


def cluster(df: DataFrame, groups: list[Column], score: Column, item: Column, path: str, file_rows: int = FILE_ROWS) -> str:
    """Writes the clustered layout of (group, score, item) to `path`: data files and the manifest. Runs at once.

    score: bigint; items without a score don't compete and are left out. item: bigint, the smaller one wins a tie. Items that repeat stay, as rows of their own. Null
    group values are values of their own. A task holds one file's rows, at most about FILE_ROWS_MOST.
    """
    held = df.select(_key(groups).alias("g"), score.cast("bigint").alias("s"), item.cast("bigint").alias("i")).where("s is not null")
    rows = df.count()
    files = max(1, min(-(-rows // file_rows), max(-(-rows // FILE_ROWS_MOST), 3 * df.sparkSession.sparkContext.defaultParallelism)))
    spread = held.repartitionByRange(files, "g", F.col("s").desc(), "i")
    spread.mapInArrow(_write(f"{path.rstrip('/')}/data"), _MANIFEST).write.parquet(f"{path.rstrip('/')}/manifest")
    return path


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row per file of the layout."""
    return spark.read.schema(_MANIFEST).parquet(f"{path.rstrip('/')}/manifest")


def bounds(files: DataFrame, n: int) -> DataFrame:
    """Of each group, a score that its N-th one reaches at least: the smallest of a row group that holds only that group and has N items or more."""
    own = files.select(F.explode("row_groups").alias("r")).where((F.col("r.own").isNotNull()) & (F.col("r.n") >= n))
    return own.groupBy(F.col("r.own").alias("g")).agg(F.max("r.s_least").alias("bound"))


def planned(files: DataFrame, n: int) -> DataFrame:
    """The files' row groups that may hold one of the N first, `row_groups`, and how many there were, `n_all`; files without any are left out."""
    limit = bounds(files, n)
    rows = files.select("path", "bytes", F.size("row_groups").alias("n_all"), F.explode("row_groups").alias("r"))
    joined = rows.join(limit, F.col("r.own") == F.col("g"), "left")
    kept = joined.where("bound is null or r.s_most >= bound")
    return kept.groupBy("path", "bytes", "n_all").agg(F.sort_array(F.collect_list(F.struct("r.k", "r.section", "r.s_most"))).alias("row_groups"))  # a file's: bounded


@dataclass
class _Found:
    """What a file gave: its first N items of each group, and how many row groups were read."""

    table: pa.Table
    read: int


def _firsts(path: str, row_groups: list[dict], n: int) -> _Found:
    """Reads a file's row groups section by section, by falling maximum score, and skips those strictly below the N-th score of every group
    they may contain."""
    system, local = _file_system(path)
    with system.open_input_file(local) as f:
        source = pq.ParquetFile(f)
        listed = pa.ipc.open_stream(source.metadata.metadata[b"groups"]).read_all()
        groups, left = listed.column("g").combine_chunks(), listed.column("n").to_numpy().copy()
        section_of = listed.column("section").to_numpy()
        seen = np.zeros(len(left), dtype=np.int64)
        nth, known = np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=bool)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        read = 0
        by_section: dict[int, list[dict]] = {}
        for r in row_groups:
            by_section.setdefault(r["section"], []).append(r)
        for section, own in by_section.items():
            members = np.flatnonzero(section_of == section)
            for r in sorted(own, key=lambda r: (-r["s_most"], r["k"])):
                open_ = members[left[members] > 0]
                if known[open_].all() and (nth[open_] > r["s_most"]).all():
                    break  # those after it have no higher maximum
                t = source.read_row_group(r["k"], columns=["c", "s", "i"], use_threads=False)
                read += 1
                c, s, i = (t.column(x).to_numpy() for x in ("c", "s", "i"))
                order = np.argsort(c, kind="stable")
                sorted_c = c[order]
                starts = np.flatnonzero(np.diff(sorted_c, prepend=-1))
                lengths = np.diff(np.append(starts, len(c)))
                rank = np.empty(len(c), dtype=np.int64)
                rank[order] = np.arange(len(c)) - np.repeat(starts, lengths) + seen[sorted_c]
                kept = rank < n
                parts.append((c[kept], s[kept], i[kept]))
                last = rank == n - 1
                nth[c[last]], known[c[last]] = s[last], True
                who = sorted_c[starts]
                seen[who] += lengths
                left[who] -= lengths
        c, s, i = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
        return _Found(pa.table({"g": groups.take(pa.array(c)), "s": pa.array(s, pa.int64()), "i": pa.array(i, pa.int64())}), read)


def _tasks(spark: SparkSession, files: DataFrame) -> int:
    """Reading tasks: by the files' bytes, and enough for the cores; one file is the least."""
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return max(1, min(n, max(-(-size // TASK_BYTES), 3 * spark.sparkContext.defaultParallelism)))


def top_n(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The N first items of every group of a layout: `g`, `s`, `i` and `rank`.

    By falling score, then rising item. Groups with fewer items give all. A layout without items gives no rows.
    """
    if n < 1:
        raise ValueError("n is at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield from _firsts(r["path"], r["row_groups"], n).table.to_batches(max_chunksize=50_000)

    files = manifest(spark, path)
    parts = planned(files, n).repartition(_tasks(spark, files), "path").mapInArrow(run, "g string, s bigint, i bigint")
    w = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i"))
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def skipped(spark: SparkSession, path: str, n: int) -> DataFrame:
    """What `top_n` does with the layout's row groups: `row_groups`, and of these `not_planned`, `skipped` while reading, and `read`. One row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [_firsts(r["path"], r["row_groups"], n).read for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(r["row_groups"]) for r in b.to_pylist()], pa.int64()), pa.array(read, pa.int64())], names=["planned", "read"])

    files = manifest(spark, path)
    every = files.agg(F.coalesce(F.sum(F.size("row_groups")), F.lit(0)).alias("row_groups"))
    done = planned(files, n).repartition(_tasks(spark, files), "path").mapInArrow(run, "planned bigint, read bigint")
    some = done.agg(F.coalesce(F.sum("planned"), F.lit(0)).alias("planned"), F.coalesce(F.sum("read"), F.lit(0)).alias("read"))
    parts = every.select("row_groups", F.lit(0).alias("planned"), F.lit(0).alias("read")).unionByName(some.select(F.lit(0).alias("row_groups"), "planned", "read"))
    total = parts.agg(*(F.sum(c).alias(c) for c in ("row_groups", "planned", "read")))
    return total.select("row_groups", (F.col("row_groups") - F.col("planned")).alias("not_planned"), (F.col("planned") - F.col("read")).alias("skipped"), "read")


def kept_layout(df: DataFrame, groups: list[Column], score: Column, item: Column, path: str, file_rows: int = FILE_ROWS) -> str:
    """The layout at `path`, written at once if it isn't there. The manifest is written last, so that a layout that broke off isn't taken for one."""
    try:
        manifest(df.sparkSession, path).schema  # noqa: B018
        return path
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return cluster(df, groups, score, item, path, file_rows)


def top_n_of(df: DataFrame, groups: list[Column], score: Column, item: Column, n: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """Clusters `df` in the shared folder, at once, and asks for its N first items per group: `i`, `s` and `rank`.

    An empty table gives no rows; columns besides those of the expressions aren't read.
    """
    path = cluster(df, groups, score, item, scratch_path(df.sparkSession, "topn"), file_rows)
    return top_n(df.sparkSession, path, n).select("i", "s", "rank")
