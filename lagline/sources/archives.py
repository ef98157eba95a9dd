"""ZIP archives of delimited event files, read in parallel by member.

The file listing and the checksums are plain Spark reads. Only unpacking needs Python on
the executors: every member of a large archive is one row, placed on its own, those of a small one
stay together, and text streams through in blocks, so neither a large archive nor a large member is held whole.
"""

from __future__ import annotations

import csv
import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv as arrow_csv, fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lagline import schema as S
from lagline.operators.contracts import ContractError, enforce, parse_rules, typed_events
from lagline.sources.work import materialize

BLOCK_ROWS = 20_000
MEMBER = "archive string, path string, member string, bytes bigint, problem string"
FOUND = MEMBER + ", small boolean"
SMALL_BYTES = 16 << 20  # unpacked members of an archive that one task reads without dealing them out
WHOLE_BYTES = 4 << 20  # of a member that is parsed at once
SHOWN = 20  # unfit files shown with an error; all are counted
HASH_BLOCK = 1 << 20


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, archive, bytes) of every ZIP file, whatever the case of its suffix."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[zZ][iI][pP]")
        .load(folder)
        .select("path", F.col("length").alias("bytes"))
    )
    # The path is the file's own, not an encoded one: "+" and "%" are letters of its name.
    return files.withColumn("archive", F.element_at(F.split("path", "/"), -1)).orderBy(F.lower("archive"), "archive")


def checksums(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, bytes, sha256) of files of any size: each streams through its hash in blocks."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    )
    return files.repartition(_tasks(spark), "path").mapInPandas(_hash, "file string, bytes bigint, sha256 string")


def _tasks(spark: SparkSession) -> int:
    """Tasks that files are dealt to.

    Given as a number, because adaptive execution knows only the bytes of the names, and would
    bring all files together in one task.
    """
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sums = []
        for path in batch["path"]:
            digest, (system, inner) = hashlib.sha256(), _locate(path)
            with system.open_input_stream(inner) as stream:
                while block := stream.read(HASH_BLOCK):
                    digest.update(block)
            sums.append(digest.hexdigest())
        yield batch[["file", "bytes"]].assign(sha256=sums)


def _locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path; whatever a URI may not hold as it stands is quoted first."""
    scheme, mark, rest = path.partition(":")
    system, inner = fs.FileSystem.from_uri(scheme + mark + quote(rest, safe="/:@=+,"))
    return system, inner


def _open(path: str) -> zipfile.ZipFile:
    system, inner = _locate(path)
    return zipfile.ZipFile(system.open_input_file(inner))


def _text(stream) -> io.TextIOWrapper:
    return io.TextIOWrapper(stream, encoding="utf-8-sig", newline="")


class _Opened:
    """The archive opened last; members of one archive come one after another."""

    def __init__(self):
        self.path, self.archive = None, None

    def __call__(self, path: str) -> zipfile.ZipFile:
        if self.path != path:
            self.close()
            self.archive, self.path = _open(path), path
        return self.archive

    def close(self) -> None:
        if self.archive is not None:
            self.archive.close()
        self.path, self.archive = None, None


def _inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per CSV member, or one row with the reason an archive is refused."""
    for batch in batches:
        rows = []
        for path, name in zip(batch["path"], batch["archive"]):
            try:
                with _open(path) as archive:
                    found = [m for m in archive.infolist() if not m.is_dir() and m.filename.lower().endswith(".csv")]
            except (zipfile.BadZipFile, ValueError) as error:
                rows.append((name, path, None, None, f"not a readable archive: {error}", True))
                continue
            if not found:
                rows.append((name, path, None, None, "no CSV file", True))
            small = sum(m.file_size for m in found) <= SMALL_BYTES
            rows += [
                (name, path, m.filename, m.file_size, "encrypted" if m.flag_bits & 1 else None, small)
                for m in sorted(found, key=lambda m: m.filename.casefold())
            ]
        yield pd.DataFrame(rows, columns=["archive", "path", "member", "bytes", "problem", "small"])


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Header contract and checksum of each member; reading to the end verifies the CRC."""
    opened = _Opened()
    for batch in batches:
        problems = list(batch["problem"])
        for i, (path, member) in enumerate(zip(batch["path"], batch["member"])):
            if problems[i] is None:
                try:
                    with opened(path).open(member) as stream:
                        header = next(csv.reader(text := _text(stream)), None)
                        if header != S.RAW_COLUMNS:
                            problems[i] = f"unexpected header: {header}"
                        else:
                            while stream.read(1 << 20):
                                pass
                        text.detach()
                except (zipfile.BadZipFile, ValueError) as error:
                    problems[i] = str(error)
        yield batch.assign(problem=pd.Series(problems, batch.index, object))
    opened.close()


def _by_member(members: DataFrame) -> DataFrame:
    """Members spread over tasks: one hot archive does not hold the others up; one known as small is opened once."""
    apart = F.when(~F.col("small"), F.col("member")) if "small" in members.columns else F.col("member")
    return members.repartition(_tasks(members.sparkSession), "archive", apart).sortWithinPartitions("archive", "path", "member")


def inspect(archives: DataFrame) -> DataFrame:
    """Every member with its size and, if it must be refused, the reason; whether its archive is small."""
    members = archives.select("path", "archive").repartition(_tasks(archives.sparkSession), "archive").mapInPandas(_inspect, FOUND)
    return _by_member(members).mapInPandas(_check, FOUND)


_PARSED = arrow_csv.ConvertOptions(column_types={c: pa.string() for c in S.RAW_COLUMNS}, null_values=[], strings_can_be_null=False)
_SERIAL = arrow_csv.ReadOptions(use_threads=False, block_size=WHOLE_BYTES + 1)
_PLAIN = arrow_csv.ParseOptions(quote_char=False)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows; those of small members go on together."""
    held, rows = [], 0
    for block in _blocks(batches):
        held.append(block)
        rows += block.num_rows
        if rows >= BLOCK_ROWS:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    opened = _Opened()
    for batch in batches:
        for row in batch.to_pylist():
            first = 2  # the header is row 1
            for block in _parsed(opened(row["path"]), row["member"], row["bytes"]):
                n = block.num_rows
                own = [
                    pa.repeat(pa.scalar(row["archive"], pa.string()), n),
                    pa.repeat(pa.scalar(row["member"].rsplit("/", 1)[-1], pa.string()), n),
                    pa.array(np.arange(first, first + n)),
                ]
                yield pa.table([*own, *block.columns], S.PROVENANCE + S.RAW_COLUMNS)
                first += n
    opened.close()


def _parsed(archive: zipfile.ZipFile, member: str, size: int) -> Iterator[pa.Table]:
    """Text columns of a member.

    Arrow's parser takes plain text, for which it is the faster one. Quotes, and whatever it refuses,
    such as short and long rows, are for that of pandas to read, to fill or to refuse.
    """
    if size <= WHOLE_BYTES:
        with archive.open(member) as stream:
            text = stream.read()
        try:
            if not (b'"' in text or b"\0" in text or text.count(b"\r") > text.count(b"\r\n")):
                yield arrow_csv.read_csv(pa.BufferReader(text), _SERIAL, _PLAIN, _PARSED)
                return
        except pa.ArrowInvalid:
            pass
    with archive.open(member) as stream:
        blocks = pd.read_csv(
            stream, dtype=str, encoding="utf-8-sig", chunksize=BLOCK_ROWS, keep_default_na=False, on_bad_lines="error",
        )
        for block in blocks:
            yield pa.table([pa.array(block[c], pa.string(), from_pandas=True) for c in S.RAW_COLUMNS], S.RAW_COLUMNS)


def text_records(members: DataFrame) -> DataFrame:
    """All-text records of the members with their provenance."""
    ddl = ", ".join(
        f"{c} {'bigint' if c == 'source_row_number' else 'string'}" for c in S.PROVENANCE + S.RAW_COLUMNS
    )
    return _by_member(members).select("archive", "path", "member", "bytes").mapInArrow(_records, ddl)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Typed events of all archives in a folder; refuses the folder if any file is unfit."""
    # Written once: the problem list, the guard and the reading below share one unpacking.
    members = materialize(inspect(list_archives(spark, folder)), "archive-members")
    unfit = members.where("problem IS NOT NULL")
    found, refused = members.agg(F.count(F.lit(1)), F.count("problem")).first()
    if refused:
        shown = unfit.select("archive", "member", "problem").orderBy("archive", "member").limit(SHOWN).collect()
        raise ContractError({"unfit_files": refused}, [r.asDict() for r in shown])
    if not found:
        raise FileNotFoundError(f"no ZIP archives in {folder}")
    _distinct_names(members)
    text = materialize(text_records(members), "archive-text")
    enforce(text, parse_rules())
    return typed_events(text)


def _distinct_names(members: DataFrame) -> None:
    """Provenance is the archive, the member's base name and the row: a pair must occur once."""
    base = F.element_at(F.split("member", "/"), -1)
    twice = (
        members.groupBy("archive", base.alias("file"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("first"), F.max("member").alias("last"))
        .where("n > 1")
    )
    n = twice.count()
    if n:
        shown = twice.orderBy("archive", "file").limit(SHOWN).collect()
        raise ContractError({"repeated_file_names": n}, [r.asDict() for r in shown])


def read_csv_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Typed events of plain CSV files: header checked, over-long and short rows refused.

    Row numbers count within a file in reading order; files are not split, because a row's
    number is only known by reading from the start.
    """
    members = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .load(folder)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("member"))
    )
    # Spark's own reader enforces the header and the row shape before rows are numbered.
    (
        spark.read.schema(S.RAW_TEXT_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(folder)
        .agg(F.count(F.lit(1)), *[F.max(c) for c in S.RAW_COLUMNS])
        .collect()
    )
    ddl = ", ".join(
        f"{c} {'bigint' if c == 'source_row_number' else 'string'}" for c in S.PROVENANCE + S.RAW_COLUMNS
    )
    text = members.repartition(_tasks(spark), "path").mapInPandas(_plain_records, ddl)
    enforce(text, parse_rules())
    return typed_events(text)


def _plain_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, member in zip(batch["path"], batch["member"]):
            system, inner = _locate(path)
            with system.open_input_stream(inner) as stream:
                first = 2
                for block in pd.read_csv(
                    stream, dtype=str, encoding="utf-8-sig", chunksize=BLOCK_ROWS, keep_default_na=False,
                    on_bad_lines="error",
                ):
                    block.insert(0, "source_archive", "")
                    block.insert(1, "source_file", member)
                    block.insert(2, "source_row_number", range(first, first + len(block)))
                    first += len(block)
                    yield block


# ---- writing ------------------------------------------------------------------------------


def as_text(events: DataFrame) -> DataFrame:
    """Raw columns as the text a delimited file holds; missing values become empty fields."""

    def text(c: str):
        if c in S.TIMESTAMPS:
            return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
        return F.date_format(c, "M/d/yyyy") if c == "service_date" else F.col(c).cast("string")

    others = [c for c in events.columns if c not in S.RAW_COLUMNS]
    return events.select(*others, *[F.coalesce(text(c), F.lit("")).alias(c) for c in S.RAW_COLUMNS])


def _lines(fields: list[pa.Array]) -> pa.Array:
    """Rows as CSV lines; fields with a comma, a quote or a line break are quoted."""
    fields = [f.cast(pa.large_string()).fill_null("") for f in fields]
    unusual, nothing, quote, comma, end = '[,"\r\n]', *(pa.scalar(x, pa.large_string()) for x in ("", '"', ",", "\r\n"))
    if pc.any(pc.match_substring_regex(pc.binary_join_element_wise(*fields, nothing), unusual)).as_py():
        quoted = [pc.binary_join_element_wise(quote, pc.replace_substring(f, '"', '""'), quote, nothing) for f in fields]
        fields = [pc.if_else(pc.match_substring_regex(f, unusual), q, f) for f, q in zip(fields, quoted)]
    return pc.binary_join_element_wise(pc.binary_join_element_wise(*fields, comma), end, nothing)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, str, int, int]]:
    """(archive, member, first row, end) of rows that follow each other."""
    a, m = batch.column(0), batch.column(1)
    n = batch.num_rows
    changes = pc.or_(pc.not_equal(a.slice(1), a.slice(0, n - 1)), pc.not_equal(m.slice(1), m.slice(0, n - 1)))
    bounds = [0, *(np.flatnonzero(changes.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
    for first, end in zip(bounds, bounds[1:]):
        yield a[first].as_py(), m[first].as_py(), first, end


def write_archives(text: DataFrame, folder: str, archive: str, member: str, order: str) -> DataFrame:
    """One ZIP file per value of ``archive``, one CSV per ``member`` in it; returns (archive, files, rows).

    An archive is one task's stream, in the order of ``order``, and no more than a batch of it
    is held: choose archives that are small against the table. Each is written beside its place and moved there
    when complete, so a task that runs again replaces its own file. The names must be safe as
    file names; rows without one are refused.
    """
    columns = list(S.RAW_COLUMNS)
    header = (",".join(columns) + "\r\n").encode()
    spark = text.sparkSession
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(location)
    base = system.makeQualified(location).toString()

    def write(batches):
        done, current = [], None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                lines = _lines(batch.columns[2:])
                _, offsets, data = lines.buffers()
                at = np.frombuffer(offsets, np.int64)[lines.offset : lines.offset + len(lines) + 1]
                for name, inner, first, end in _runs(batch):
                    if current is None or current.name != name:
                        if current is not None:
                            done.append(current.close())
                        current = None
                        current = _Archive(base, name)
                    current.add(inner, header, memoryview(data)[at[first] : at[end]], end - first)
            if current is not None:
                done.append(current.close())
                current = None
        finally:
            if current is not None:
                current.abandon()
        if done:
            names, files, rows = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(files), pa.array(rows)], ["archive", "files", "rows"])

    named = text.select(
        F.coalesce(archive, F.raise_error("an archive without a name").cast("string")).alias("a"),
        F.coalesce(member, F.raise_error("a file without a name").cast("string")).alias("m"),
        F.col(order).alias("o"), *columns,
    )
    # Names often begin alike; their hashes differ early, so fewer rows are compared by whole names.
    placed = named.repartition(_tasks(spark), "a").sortWithinPartitions(F.xxhash64("a"), "a", "m", "o").drop("o")
    written = placed.mapInArrow(write, "archive string, files bigint, rows bigint")
    return materialize(written, "written-archives")


class _Archive:
    """A ZIP file that grows at a name of its own until it is complete."""

    def __init__(self, base: str, name: str):
        self.name, self.rows, self.members, self.entry, self.member = name, 0, 0, None, None
        self.system, self.place = _locate(f"{base}/{name}")
        self.growing = f"{self.place}.{uuid.uuid4().hex}.part"
        self.stream = self.system.open_output_stream(self.growing)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_DEFLATED)

    def add(self, member: str, header: bytes, lines: memoryview, count: int) -> None:
        if member != self.member:
            self._end_member()
            self.member, self.members = member, self.members + 1
            self.entry = self.zip.open(member, "w", force_zip64=True)
            self.entry.write(header)
        self.entry.write(lines)
        self.rows += count

    def _end_member(self) -> None:
        if self.entry is not None:
            self.entry.close()
            self.entry = None

    def close(self) -> tuple[str, int, int]:
        self._end_member()
        self.zip.close()
        self.stream.close()
        self.system.move(self.growing, self.place)
        return self.name, self.members, self.rows

    def abandon(self) -> None:
        self.stream.close()
        self.system.delete_file(self.growing)
