"""DICOM bytes as DataFrames: files, elements and diagnostics in, datasets and files out."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from voxelake.codec.dataset import Reader, encode_dataset, encode_file, parse_dataset, parse_file, swapped, to_raw, values_of, write_encoding
from voxelake.codec.file_bytes import FileBytes
from voxelake.dictionary import SEED, TRANSFER_SYNTAXES, Dictionary, parse_tag
from voxelake.errors import SyntaxUnknownError
from voxelake.log import logger

PATH_TYPE = pa.list_(pa.struct([("tag", pa.int64()), ("item", pa.int32())]))
FIELDS = (
    ("is_meta", pa.bool_(), "boolean"),
    ("path", PATH_TYPE, "array<struct<tag:bigint,item:int>>"),
    ("depth", pa.int32(), "int"),
    ("pos", pa.int32(), "int"),
    ("tag", pa.int64(), "bigint"),
    ("vr", pa.string(), "string"),
    ("private_creator", pa.string(), "string"),
    ("undefined_length", pa.bool_(), "boolean"),
    ("deferred", pa.bool_(), "boolean"),
    ("value_offset", pa.int64(), "bigint"),
    ("value_length", pa.int64(), "bigint"),
    ("raw", pa.binary(), "binary"),
    ("strings", pa.list_(pa.string()), "array<string>"),
    ("charsets", pa.list_(pa.string()), "array<string>"),
    ("value_error", pa.string(), "string"),
)
TYPES, SQL_TYPES = {n: t for n, t, _ in FIELDS}, {n: t for n, _, t in FIELDS}
DIAGNOSTICS = "kind string, tag bigint, vr string, `offset` bigint, path array<struct<tag:bigint,item:int>>, need bigint, have bigint, message string"
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


def path_array(paths: list[tuple | None]) -> pa.Array:
    """Paths of (tag, item) pairs as an Arrow array, without an object per step."""
    offsets = np.zeros(len(paths) + 1, np.int32)
    np.cumsum([len(p or ()) for p in paths], out=offsets[1:])
    steps = [s for p in paths if p for s in p]
    values = pa.StructArray.from_arrays([pa.array([t for t, _ in steps], pa.int64()), pa.array([i for _, i in steps], pa.int32())], fields=list(PATH_TYPE.value_type))
    gone = pa.array([p is None for p in paths], pa.bool_()) if None in paths else None
    return pa.ListArray.from_arrays(pa.array(offsets), values, type=PATH_TYPE, mask=gone)


class Columns:
    """Element rows gathered by column, only those of the fields asked for."""

    def __init__(self, fields: tuple[str, ...], key: str):
        self.fields, self.key = fields, key
        self.clear()

    def clear(self) -> None:
        self.at: list[int] = []
        self.cols: dict[str, list] = {f: [] for f in self.fields}

    def add(self, i: int, r: Reader, wanted: frozenset | None = None) -> None:
        """All elements of one dataset, or those of the wanted tags at any depth; a value that doesn't
        convert keeps its bytes and the reason."""
        pairs = [(pos, e) for pos, e in enumerate(r.elements) if wanted is None or e.tag in wanted]
        self.at += [i] * len(pairs)
        simple = {
            "is_meta": lambda p, e: e.tag >> 16 == 2 and not e.path, "path": lambda p, e: e.path, "depth": lambda p, e: len(e.path), "pos": lambda p, e: p, "tag": lambda p, e: e.tag,
            "vr": lambda p, e: e.vr, "private_creator": lambda p, e: e.creator, "undefined_length": lambda p, e: e.undefined, "deferred": lambda p, e: e.deferred,
            "value_offset": lambda p, e: e.offset, "value_length": lambda p, e: e.length, "raw": lambda p, e: e.raw, "charsets": lambda p, e: e.charsets,
        }
        for f, col in self.cols.items():
            if f in simple:
                get = simple[f]
                col.extend([get(p, e) for p, e in pairs])
        if "strings" in self.cols or "value_error" in self.cols:
            for _, e in pairs:
                strings, error = None, None
                try:
                    strings = values_of(e.vr, e.raw, True if e.tag >> 16 == 2 else r.little, e.charsets)
                except (ValueError, LookupError) as x:
                    error = str(x)
                if "strings" in self.cols:
                    self.cols["strings"].append(strings)
                if "value_error" in self.cols:
                    self.cols["value_error"].append(error)

    def refuse(self, i: int, reason: Exception) -> None:
        """The row of data that is no file: nulls and the reason."""
        self.at.append(i)
        for f, col in self.cols.items():
            col.append(str(reason) if f == "value_error" else None)

    def batch(self, keys: pa.Array) -> pa.RecordBatch:
        arrays = [path_array(c) if f == "path" else pa.array(c, TYPES[f]) for f, c in self.cols.items()]
        out = pa.RecordBatch.from_arrays([keys.take(pa.array(self.at, pa.int32())), *arrays], names=[self.key, *self.fields])
        self.clear()
        return out


def _parse(data: bytes, uid: str | None, force: bool, options: dict) -> tuple[dict, Reader]:
    return parse_file(data, force, **options) if uid is None else ({}, parse_dataset(data, uid, **options))


def parse_elements(
    df: DataFrame,
    *,
    key: str,
    data: str = "content",
    transfer_syntax: str | None = None,
    tags: list[int] | None = None,
    stop_before_pixels: bool = False,
    defer_size: int = 0,
    force: bool = False,
    mode: str = "PERMISSIVE",
    refused: bool = False,
    dictionary: Dictionary = SEED,
    fields: tuple[str, ...] | None = None,
) -> DataFrame:
    """The elements of every byte string: `key` and FIELDS, nested ones with their path.

    transfer_syntax: that of bare datasets; None for Part 10 files. tags: keep only these (besides
    group 2 and the character set), at every depth, below kept sequences. defer_size: values longer
    than this stay out (`deferred`), to be fetched by `load_deferred`. dictionary: what implicit files
    are read by (`dictionary_of`). fields: the columns to build, all where None; an Arrow function
    hides its columns from the optimizer, so a query that needs few names them here.
    mode: PERMISSIVE keeps what was read before damage, DROPMALFORMED drops datasets with any
    diagnostic, FAILFAST raises. Null data gives no rows; data that is no file raises under FAILFAST
    and gives no rows otherwise, but with `refused` one row under PERMISSIVE: nulls and the reason as
    value_error. One narrow pass, a file at a time.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    names = tuple(TYPES) if fields is None else tuple(f for f in TYPES if f in fields)
    if fields is not None and len(names) != len(set(fields)):
        raise ValueError(f"fields are {tuple(TYPES)}")
    options = {"tags": None if tags is None else frozenset(tags), "stop_before_pixels": stop_before_pixels, "defer_size": defer_size, "dictionary": dictionary}
    if not {"raw", "strings", "value_error"} & set(names):
        options["values"] = frozenset()
    schema = ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", *(f"{n} {SQL_TYPES[n]}" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Columns(names, key)
            for i, blob in enumerate(batch.column(1)):
                if not blob.is_valid:
                    continue
                try:
                    _, r = _parse(blob.as_py(), transfer_syntax, force, options)
                except ValueError as x:
                    if mode == "FAILFAST":
                        raise
                    if refused and mode == "PERMISSIVE":
                        out.refuse(i, x)
                    continue
                if r.diagnostics and mode == "FAILFAST":
                    raise ValueError(f"damaged dataset: {r.diagnostics[0]}")
                if r.diagnostics and mode == "DROPMALFORMED":
                    continue
                out.add(i, r)
                if len(out.at) >= 20_000:
                    yield out.batch(batch.column(0))
            yield out.batch(batch.column(0))

    return df.select(key, data).mapInArrow(run, schema)


def parse_rows(
    df: DataFrame, *, key: str, columns: dict[int, str], data: str = "content", transfer_syntax: str | None = None, force: bool = False, dictionary: Dictionary = SEED
) -> DataFrame:
    """One wide row a dataset: `key` and the first value of each listed top-level tag as a string.

    What `parse_elements` and `image_rows` give together, in one narrow pass instead of a shuffle:
    other values are skipped, not read. Absent and empty elements are null, as are all columns of data
    that is no file; null data gives no row.
    """
    wanted = frozenset(columns)
    options = {"tags": wanted, "values": wanted, "dictionary": dictionary}
    schema = ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", *(f"`{n}` string" for n in columns.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cols = [], {t: [] for t in columns}
            for i, blob in enumerate(batch.column(1)):
                if not blob.is_valid:
                    continue
                at.append(i)
                found: dict[int, str | None] = {}
                try:
                    _, r = _parse(blob.as_py(), transfer_syntax, force, options)
                    for e in r.elements:
                        if not e.path and e.tag in wanted:
                            try:
                                found[e.tag] = next(iter(values_of(e.vr, e.raw, e.tag >> 16 == 2 or r.little, e.charsets) or ()), None)
                            except (ValueError, LookupError):
                                found[e.tag] = None
                except ValueError:
                    pass
                for t, c in cols.items():
                    c.append(found.get(t))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, pa.string()) for c in cols.values())], names=[key, *columns.values()])

    return df.select(key, data).mapInArrow(run, schema)


def parse_diagnostics(df: DataFrame, *, key: str, data: str = "content", transfer_syntax: str | None = None, force: bool = False) -> DataFrame:
    """What was wrong in every byte string: `key` and DIAGNOSTICS; no row for sound ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, blob in enumerate(batch.column(1).to_pylist()):
                if blob is None:
                    continue
                try:
                    got = _parse(blob, transfer_syntax, force, {})[1].diagnostics
                except ValueError as x:
                    rows.append(("not_dicom", None, None, 0, [], None, None, str(x)))
                    at.append(i)
                    continue
                rows += [(d.kind, d.tag, d.vr, d.offset, [{"tag": t[0], "item": t[1]} if isinstance(t, tuple) else {"tag": t, "item": None} for t in d.path], d.need, d.have, d.message) for d in got]
                at += [i] * len(got)
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), PATH_TYPE, pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=[key, "kind", "tag", "vr", "offset", "path", "need", "have", "message"],
            )

    return df.select(key, data).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {DIAGNOSTICS}")


def parse_files(df: DataFrame, *, key: str, data: str = "content", force: bool = False) -> DataFrame:
    """(key, preamble, transfer_syntax, implicit_vr, little_endian, charsets, read_error) of files."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("preamble", "transfer_syntax", "implicit_vr", "little_endian", "charsets")
        types = (pa.binary(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.string())
        for batch in batches:
            rows = []
            for blob in batch.column(1).to_pylist():
                try:
                    facts = parse_file(blob, force, stop_before_pixels=True)[0] if blob is not None else {}
                    rows.append((*(facts.get(n) for n in names), None if blob is not None else "no content"))
                except ValueError as x:
                    rows.append((None,) * 5 + (str(x),))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[key, *names, "read_error"])

    return df.select(key, data).mapInArrow(run, f"`{key}` {kind}, preamble binary, transfer_syntax string, implicit_vr boolean, little_endian boolean, charsets array<string>, read_error string")


def read_dicom(spark: SparkSession, path: str, **options) -> DataFrame:
    """The elements of all files below a path, keyed by file path; one row with the reason for a file
    that is none, unless `refused` is false."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parse_elements(files.select(F.col("path").alias("file"), "content"), key="file", **{"refused": True, **options})


def load_deferred(elements: DataFrame, contents: DataFrame, *, key: str, data: str = "content") -> DataFrame:
    """Deferred elements with their bytes, taken from the stored (offset, length) of the content; null
    where the content has become shorter. Values of undefined length are fetched like all others."""
    late = elements.where("deferred").drop("raw")
    return late.join(contents.select(key, data).hint("merge"), key).withColumn("raw", F.expr(f"substring(`{data}`, cast(value_offset + 1 as int), cast(value_length as int))")).drop(data)


def fetch_deferred(elements: DataFrame, *, file: str = "file") -> DataFrame:
    """Deferred elements with their bytes, read from the files they stand in by (offset, length).

    Nothing is joined: a task opens each file once for the elements of it that come one after another
    and reads their bytes alone. Not for deflated files, whose offsets count inflated bytes. A file
    that is gone or has become shorter leaves a null value with the reason as value_error.
    """
    late = elements.where("deferred")
    rest = [c for c in late.columns if c not in ("raw", "value_error")]
    names = [*rest, "raw", "value_error"]
    schema = ", ".join(f"`{c}` {late.schema[c].dataType.simpleString() if c in rest else SQL_TYPES[c]}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws, errors, name, handle = [], [], None, None
            for path, at, n in zip(*(b.column(rest.index(c)).to_pylist() for c in (file, "value_offset", "value_length")), strict=True):
                try:
                    if path != name or handle is None:
                        handle = None if handle is None else handle.close()
                        system, where = _system(path)
                        name, handle = path, system.open_input_file(where)
                    handle.seek(at)
                    got = handle.read(n)
                    if len(got) < n:
                        raise OSError("the file has become shorter")
                    raws.append(got)
                    errors.append(None)
                except (OSError, ValueError) as x:
                    raws.append(None)
                    errors.append(str(x))
            if handle is not None:
                handle.close()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raws, pa.binary()), pa.array(errors, pa.string())], names=names)

    return late.select(*rest).mapInArrow(run, schema)


def grouped_elements(elements: DataFrame, key: str) -> DataFrame:
    """(key, es): the rows of each key as one array, with those of the encoder's columns that are there."""
    there = [c for c in ("path", "tag", "vr", "raw", "strings", "charsets", "undefined_length") if c in elements.columns]
    return elements.groupBy(key).agg(F.collect_list(F.struct(*there)).alias("es"))


def encoder_rows(es: pa.Array, little: bool, foreign: bool = False) -> Iterator[list[tuple] | Exception]:
    """Per key the (path, tag, vr, raw, undefined) tuples that the encoder takes, or what its values
    can't be encoded for. Columns are read one by one instead of a dictionary per element."""
    flat, lengths = es.flatten(), [len(x) if x.is_valid else 0 for x in es] if es.null_count else np.diff(es.offsets.to_numpy()).tolist()
    names = {f.name for f in flat.type}
    tag, vr, raw, strings, charsets, undefined = (flat.field(n).to_pylist() if n in names else [None] * len(flat) for n in ("tag", "vr", "raw", "strings", "charsets", "undefined_length"))
    paths = flat.field("path") if "path" in names else None
    if paths is not None and len(paths.flatten()):
        steps, sizes = paths.flatten(), [0 if n is None else n for n in pc.list_value_length(paths).to_pylist()]
        pairs, path, at = list(zip(steps.field("tag").to_pylist(), steps.field("item").to_pylist(), strict=True)), [], 0
        for n in sizes:
            path.append(tuple(pairs[at : at + n]))
            at += n
    else:
        path = [()] * len(tag)
    start = 0
    for n in lengths:
        try:
            parts = []
            for k in range(start, start + n):
                body = raw[k]
                if vr[k] != "SQ":
                    body = to_raw(vr[k], strings[k] or [], little, charsets[k]) if body is None else swapped(vr[k], body, bool(undefined[k])) if foreign else body
                parts.append((path[k], tag[k], vr[k], body, bool(undefined[k])))
            yield parts
        except ValueError as x:
            yield x
        start += n


def _encoded(out: list, errors: list, mode: str, make) -> None:
    try:
        out.append(make())
        errors.append(None)
    except ValueError as x:
        if mode == "FAILFAST":
            raise
        out.append(None)
        errors.append(str(x))


def _raise(x: Exception) -> None:
    raise x


def encode_datasets(elements: DataFrame, *, key: str, transfer_syntax: str = "1.2.840.10008.1.2.1", big_endian_source: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """(key, content, write_error): the bytes of the dataset that the rows of each key make up.

    Rows need tag and vr; raw bytes are taken as they are where given, else `strings` are encoded.
    big_endian_source: raw bytes come from a big-endian file; numbers in them, those of OW and the
    like too, are swapped where the target's order differs. Optional columns: path, charsets,
    undefined_length. A value that can't be encoded leaves a null content and the reason, or raises
    under FAILFAST. One shuffle by key; a dataset must fit in a task.
    """
    if transfer_syntax not in TRANSFER_SYNTAXES:
        raise SyntaxUnknownError(transfer_syntax)
    _, little = write_encoding(transfer_syntax)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for parts in encoder_rows(batch.column(1), little, big_endian_source == little):
                _encoded(out, errors, mode, lambda p=parts: _raise(p) if isinstance(p, Exception) else encode_dataset(p, transfer_syntax))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=[key, "content", "write_error"])

    return grouped_elements(elements, key).mapInArrow(run, f"`{key}` {elements.schema[key].dataType.simpleString()}, content binary, write_error string")


def encode_files(datasets: DataFrame, elements: DataFrame, *, key: str, transfer_syntax: str = "1.2.840.10008.1.2.1", big_endian_source: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """(key, content, write_error): Part 10 files of the elements; `datasets` gives key, sop_class and
    sop_instance. Rows of group 2 among the elements are the file's own meta information and go before
    what is made here. Otherwise as `encode_datasets`, in the same single pass.
    """
    both = datasets.select(key, "sop_class", "sop_instance").join(grouped_elements(elements, key).hint("merge"), key)
    return encode_grouped(both, key=key, transfer_syntax=transfer_syntax, big_endian_source=big_endian_source, mode=mode)


def encode_grouped(grouped: DataFrame, *, key: str, transfer_syntax: str = "1.2.840.10008.1.2.1", big_endian_source: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """`encode_files` of rows (key, sop_class, sop_instance, es) that hold their elements as an array
    already. One narrow pass."""
    if transfer_syntax not in TRANSFER_SYNTAXES:
        raise SyntaxUnknownError(transfer_syntax)
    _, little = write_encoding(transfer_syntax)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, classes, instances, es = batch.columns
            out, errors = [], []
            for c, i, parts in zip(classes.to_pylist(), instances.to_pylist(), encoder_rows(es, little, big_endian_source == little), strict=True):
                _encoded(out, errors, mode, lambda c=c, i=i, p=parts: _raise(p) if isinstance(p, Exception) else encode_file(p, transfer_syntax, c, i, meta_among=True))
            yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=[key, "content", "write_error"])

    rows = grouped.select(key, "sop_class", "sop_instance", "es")
    return rows.mapInArrow(run, f"`{key}` {grouped.schema[key].dataType.simpleString()}, content binary, write_error string")


class DicomPartition(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), re.sub("^file:", "", path))


class DicomReader(DataSourceReader):
    """Files of any file system that Arrow knows, in partitions of about BYTES. Values that nobody asks
    for are not read: those behind the pixels with stopBeforePixels, those of tags other than `only` or
    `tags`, and long ones with deferSize.

    Filters are not pushed down: Spark 4.1 keeps a reader for every scan of one DataFrame, so a filter
    of one scan would take rows from the others.
    """

    BYTES, OPENING = 128 << 20, 1 << 20

    def __init__(self, options: dict):
        listed = lambda n: frozenset(parse_tag(t) for t in re.split("[;|]", options[n])) if options.get(n) else None
        self.root, self.wanted, self.tags = options["path"], listed("only"), listed("tags")
        self.stop = str(options.get("stopbeforepixels", "false")).lower() == "true"
        self.defer = int(options.get("defersize", 0))
        self.mode = str(options.get("mode", MODES[0])).upper()
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")

    def partitions(self):
        system, root = _system(self.root)
        info = system.get_file_info(root)
        found = [info] if info.is_file else [x for x in system.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file]
        parts: list[list] = []
        room = 0
        for x in sorted(found, key=lambda x: x.path):
            need = x.size + self.OPENING  # small files cost their opening
            if room < need or not parts:
                parts.append([])
                room = self.BYTES
            parts[-1].append((x.path, x.size))
            room -= need
        logger("reader").debug("files=%d partitions=%d", len(found), len(parts))
        return [DicomPartition(p) for p in parts]

    def read(self, partition):
        system, _ = _system(self.root)
        for name, size in partition.files:
            out = Columns(tuple(TYPES), "file")
            with system.open_input_file(name) as f:
                try:
                    _, r = parse_file(FileBytes(f, size), stop_before_pixels=self.stop, defer_size=self.defer, values=self.wanted, tags=self.tags)
                except ValueError as x:
                    if self.mode == "FAILFAST":
                        raise
                    if self.mode == "PERMISSIVE":
                        out.refuse(0, x)
                        yield out.batch(pa.array([name]))
                    continue
            if r.diagnostics and self.mode == "FAILFAST":
                raise ValueError(f"damaged dataset: {r.diagnostics[0]}")
            if r.diagnostics and self.mode == "DROPMALFORMED":
                continue
            out.add(0, r, self.wanted)
            yield out.batch(pa.array([name]))


class DicomWriter(DataSourceWriter):
    """Rows (file, content) as files below the path, which all executors must reach. A file keeps its
    folders: those below option `base`, else its whole path without scheme and root. Each is written
    beside its place and moved there, so a repeated task leaves whole files only."""

    def __init__(self, options: dict):
        self.root, self.base = options["path"], options.get("base")

    def place(self, file: str) -> str:
        name = posixpath.normpath(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", file))
        base = posixpath.normpath(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", self.base)) if self.base else ""
        if base and name.startswith(base.rstrip("/") + "/"):
            name = name[len(base.rstrip("/")) :]
        name = name.lstrip("/")
        if not name or name == "." or name.startswith(".."):
            raise ValueError(f"no file name below the folder: {file}")
        return name

    def write(self, iterator):
        system, root = _system(self.root)
        n = 0
        for row in iterator:
            if row["content"] is None:
                raise ValueError(f"no content for {row['file']}")
            target = posixpath.join(root, self.place(row["file"]))
            folder, name = posixpath.split(target)
            system.create_dir(folder, recursive=True)
            part = posixpath.join(folder, f".{name}.{os.getpid()}.part")
            with system.open_output_stream(part) as f:
                f.write(bytes(row["content"]))
            system.move(part, target)
            n += 1
        m = WriterCommitMessage()
        m.files = n
        return m


class DicomSource(DataSource):
    """spark.dataSource.register(DicomSource), then format("dicom") reads elements and writes files.

    Options mode, stopBeforePixels, deferSize and tags as for `parse_elements`; under PERMISSIVE a file
    that is none gives one row with the reason as value_error. only: the rows of these tags at any depth,
    the values of others skipped. Tags are hexadecimal or keywords, with semicolons between. Writing:
    option base."""

    @classmethod
    def name(cls) -> str:
        return "dicom"

    def schema(self) -> str:
        return ", ".join(["file string", *(f"{n} {t}" for n, _, t in FIELDS)])

    def reader(self, schema):
        return DicomReader(self.options)

    def writer(self, schema, overwrite):
        return DicomWriter(self.options)
