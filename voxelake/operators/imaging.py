"""From files to frames: descriptions, decoded and displayed frames, sample arrays, compression.

Each operator reads a file once, in one narrow Arrow pass, with the elements that images need; one
frame or all, the rest of the file is skipped. Codecs registered on the driver travel with the task.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelake.codec import frames as fr
from voxelake.codec import pixels as px
from voxelake.codec.dataset import encode_file, parse_file, swapped, write_encoding
from voxelake.dictionary import NATIVE, TRANSFER_SYNTAXES
from voxelake.errors import SyntaxUnknownError
from voxelake.log import logger

DESCRIPTION = (
    ("transfer_syntax", pa.string(), "string"), ("rows", pa.int32(), "int"), ("columns", pa.int32(), "int"), ("samples", pa.int32(), "int"), ("bits_allocated", pa.int32(), "int"),
    ("bits_stored", pa.int32(), "int"), ("signed", pa.bool_(), "boolean"), ("n_frames", pa.int32(), "int"), ("photometric", pa.string(), "string"), ("planar", pa.int32(), "int"),
    ("frame_bytes", pa.int64(), "bigint"), ("extended_table", pa.bool_(), "boolean"), ("missing", pa.list_(pa.string()), "array<string>"), ("read_error", pa.string(), "string"),
)


def _image(blob: bytes, without: frozenset = frozenset()) -> px.Image:
    facts, r = parse_file(blob, tags=px.TAGS, values=px.TAGS - without)
    return px.describe(r, facts["transfer_syntax"] or NATIVE[0])


def describe_images(files: DataFrame, *, key: str, data: str = "content") -> DataFrame:
    """One row a file: `key` and DESCRIPTION; what an image lacks in `missing`, files that are none with
    the reason in read_error. Pixel data are not copied; null data give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for blob in b.column(1):
                try:
                    if not blob.is_valid:
                        raise ValueError("no content")
                    i = _image(blob.as_py(), frozenset((px.PIXELS,)))
                    i.missing = [m for m in i.missing if m != "PixelData"]
                    rows.append((i.syntax, i.rows, i.columns, i.samples, i.bits, i.stored, i.signed, i.n_frames, i.photometric, i.planar, i.frame_bytes, i.table is not None, i.missing, None))
                except ValueError as x:
                    rows.append((*(None for _ in DESCRIPTION[1:]), str(x)))
            cols = list(zip(*rows, strict=True)) or [[]] * len(DESCRIPTION)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t, _) in zip(cols, DESCRIPTION, strict=True))], names=[key, *(n for n, _, _ in DESCRIPTION)])

    return files.select(key, data).mapInArrow(run, ", ".join([f"`{key}` {files.schema[key].dataType.simpleString()}", *(f"{n} {t}" for n, _, t in DESCRIPTION)]))


def _per_frame(files: DataFrame, key: str, data: str, index: int | None, make: Callable, kind: pa.DataType, sql: str) -> DataFrame:
    """(key, frame_idx, frame, frame_error) of every frame, or of one; a file that is no image gives one
    row with the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, idx, out, errors, held = [], [], [], [], 0
            for i, blob in enumerate(b.column(1)):
                if not blob.is_valid:
                    continue
                try:
                    img = _image(blob.as_py())
                    asked = range(img.n_frames) if index is None else [index]
                except ValueError as x:
                    img, asked = x, [None]
                for k in asked:
                    try:
                        if isinstance(img, Exception):
                            raise img
                        made, error = make(img, k), None
                    except ValueError as x:
                        made, error = None, str(x)
                    at.append(i)
                    idx.append(k)
                    out.append(made)
                    errors.append(error)
                    held += 0 if made is None else len(made)
                    if held > 32 << 20:  # frames of one long file leave in several batches
                        yield _batch(b, at, idx, out, errors)
                        at, idx, out, errors, held = [], [], [], [], 0
            yield _batch(b, at, idx, out, errors)

    def _batch(b: pa.RecordBatch, at: list, idx: list, out: list, errors: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(idx, pa.int32()), pa.array(out, kind), pa.array(errors, pa.string())], names=[key, "frame_idx", "frame", "frame_error"])

    return files.select(key, data).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, frame_idx int, frame {sql}, frame_error string")


def stored_frames(files: DataFrame, *, key: str, data: str = "content", index: int | None = None) -> DataFrame:
    """Frames as they are stored: native slices or the bytes of fragments, by extended table, basic
    table, fragments or end-of-image marks. index: one frame only, cut out by its table."""
    return _per_frame(files, key, data, index, px.stored_frame, pa.binary(), "binary")


def decoded_frames(files: DataFrame, *, key: str, data: str = "content", index: int | None = None, raw: bool = False) -> DataFrame:
    """Frames decoded by the codec of their transfer syntax; unless `raw`, colours as interleaved RGB."""
    codecs = fr.registered()
    return _per_frame(files, key, data, index, lambda img, k: px.decoded_frame(img, k, raw, codecs), pa.binary(), "binary")


def display_frames(files: DataFrame, *, key: str, data: str = "content", index: int | None = None, window: int = 0, prefer_lut: bool = True) -> DataFrame:
    """Frames as 8-bit samples to be shown: modality table or rescale, VOI table or window (`window`,
    `prefer_lut`), presentation shape, MONOCHROME1 inverted, packed; plain 8-bit colour as RGB."""
    codecs = fr.registered()
    return _per_frame(files, key, data, index, lambda img, k: px.display_frame(img, k, codecs, window, prefer_lut), pa.binary(), "binary")


def sample_frames(files: DataFrame, *, key: str, data: str = "content", index: int | None = None, raw: bool = False, modality: bool = False) -> DataFrame:
    """Frames as ARRAY<DOUBLE> in row, column, sample order; with `modality` in the modality's units.
    The number of samples must be the image's."""
    codecs = fr.registered()

    def make(img: px.Image, k: int) -> np.ndarray:
        v = fr.unpack_samples(px.decoded_frame(img, k, raw, codecs), img.bits, img.signed, img.little)
        if len(v) != img.rows * img.columns * img.samples:
            raise ValueError(f"{len(v)} samples instead of {img.rows * img.columns * img.samples}")
        return px.modality_values(v, img) if modality else v

    return _per_frame(files, key, data, index, make, pa.list_(pa.float64()), "array<double>")


def sample_rows(frames: DataFrame, images: DataFrame, *, key: str) -> DataFrame:
    """(key, frame_idx, row, col, sample, value) of `sample_frames`, with the shape from `describe_images`."""
    shaped = frames.where("frame IS NOT NULL").join(images.select(key, "columns", "samples").hint("merge"), key)
    s = shaped.select(key, "frame_idx", "columns", "samples", F.posexplode("frame").alias("__at", "value"))
    return s.select(key, "frame_idx", F.expr("__at div (columns * samples)").cast("int").alias("row"), F.expr("(__at div samples) % columns").cast("int").alias("col"), F.expr("__at % samples").alias("sample"), "value")


def joined_frames(frames: DataFrame, *, key: str) -> DataFrame:
    """(key, data): all frames of a file, in order, as one byte string; null where one failed. One
    shuffle by key; a file must fit in a task."""
    g = frames.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("frame_idx", "frame"))).alias("fs"), F.bool_or(F.col("frame").isNull()).alias("bad"))
    whole = F.aggregate("fs", F.lit(b""), lambda a, f: F.concat(a, f["frame"]))
    return g.select(key, F.when(~F.col("bad"), whole).alias("data"))


def fragment_counts(files: DataFrame, *, key: str, data: str = "content") -> DataFrame:
    """(key, fragments): of encapsulated pixel data; null for native data and files that are no images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for blob in b.column(1):
                try:
                    img = _image(blob.as_py()) if blob.is_valid else None
                    out.append(None if img is None or img.syntax in NATIVE or img.data is None else fr.count_fragments(img.data))
                except ValueError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int32())], names=[key, "fragments"])

    return files.select(key, data).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, fragments int")


def compress_images(files: DataFrame, *, key: str, transfer_syntax: str, data: str = "content", per_frame: int = 1, table: bool = True, extended: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, transfer_syntax, pixel_data, undefined_length, extended_offsets, extended_lengths,
    write_error): pixel data under another transfer syntax, to replace the elements of those names.

    Frames are decoded without colour changes and encoded by the codec of the target; encapsulated with
    a basic table (`table`) or an extended one, native targets joined and padded. An image that can't
    be decoded or encoded has the reason in write_error. carry: columns of `files` to hand on. One narrow pass.
    """
    if transfer_syntax not in TRANSFER_SYNTAXES:
        raise SyntaxUnknownError(transfer_syntax)
    if extended and per_frame != 1:
        raise ValueError("an extended offset table needs one fragment a frame")
    codecs = fr.registered()
    logger("pixels").debug("compress transfer_syntax=%s extended=%s", transfer_syntax, extended)

    def one(blob: bytes) -> tuple:
        img = _image(blob)
        return _packed(img, [px.decoded_frame(img, k, True, codecs) for k in range(img.n_frames)], transfer_syntax, per_frame, table, extended, codecs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, errors = [], []
            for blob in b.column(1):
                try:
                    if not blob.is_valid:
                        raise ValueError("no content")
                    rows.append(one(blob.as_py()))
                    errors.append(None)
                except ValueError as x:
                    rows.append((None,) * 4)
                    errors.append(str(x))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.binary(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([transfer_syntax] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array(errors, pa.string()), *(b.column(c) for c in carry)],
                names=[key, "transfer_syntax", "pixel_data", "undefined_length", "extended_offsets", "extended_lengths", "write_error", *carry],
            )

    kept = "".join(f", `{c}` {files.schema[c].dataType.simpleString()}" for c in carry)
    return files.select(key, data, *(c for c in carry if c != data)).mapInArrow(
        run, f"`{key}` {files.schema[key].dataType.simpleString()}, transfer_syntax string, pixel_data binary, undefined_length boolean, extended_offsets binary, extended_lengths binary, write_error string{kept}"
    )


def _packed(img: px.Image, frames: list[bytes], transfer_syntax: str, per_frame: int, table: bool, extended: bool, codecs: dict) -> tuple:
    """(pixel data, whether of undefined length, extended offsets, extended lengths) of decoded frames."""
    if transfer_syntax in NATIVE:
        body = b"".join(frames)
        return body + b"\0" * (len(body) % 2), False, None, None
    coded = [fr.encode_frame(transfer_syntax, f, img.rows, img.columns, img.samples, img.bits, codecs) for f in frames]
    if extended:
        body, offsets, lengths = fr.encapsulate_extended(coded)
        return body, True, *(struct.pack(f"<{len(v)}Q", *map(int, v)) for v in (offsets, lengths))
    return fr.encapsulate(coded, per_frame, table), True, None, None


def recompress_files(files: DataFrame, *, key: str, transfer_syntax: str, data: str = "content", per_frame: int = 1, table: bool = True, extended: bool = False) -> DataFrame:
    """(key, content, write_error): the files with their pixel data under another transfer syntax.

    What `compress_images`, `replace_pixels` and `encode_files` give together, in one narrow pass instead
    of shuffles of all elements. Preamble, group 2 and all other elements are kept; numbers are swapped
    where the byte order changes. A file that can't be read, decoded or encoded gives a null content
    and the reason.
    """
    if transfer_syntax not in TRANSFER_SYNTAXES:
        raise SyntaxUnknownError(transfer_syntax)
    if extended and per_frame != 1:
        raise ValueError("an extended offset table needs one fragment a frame")
    codecs = fr.registered()
    _, little = write_encoding(transfer_syntax)

    def one(blob: bytes) -> bytes:
        facts, r = parse_file(blob)
        if r.diagnostics:
            raise ValueError(f"damaged dataset: {r.diagnostics[0].kind}")
        img, foreign = px.describe(r, facts["transfer_syntax"] or NATIVE[0]), r.little != little
        frames = [px.decoded_frame(img, k, True, codecs) for k in range(img.n_frames)]
        if foreign and img.bits > 8:
            frames = [swapped("OW", f) for f in frames]
        body, undefined, offsets, lengths = _packed(img, frames, transfer_syntax, per_frame, table, extended, codecs)
        parts = [
            (e.path, e.tag, e.vr, swapped(e.vr, e.raw, e.undefined) if foreign and e.vr != "SQ" and (e.path or e.tag >> 16 != 2) else e.raw, e.undefined)
            for e in r.elements
            if e.path or e.tag not in (px.PIXELS, px.OFFSETS, px.LENGTHS)
        ]
        parts.append(((), px.PIXELS, "OB" if undefined else "OW", body, undefined))
        parts += [((), t, "OV", v, False) for t, v in ((px.OFFSETS, offsets), (px.LENGTHS, lengths)) if v is not None]
        return encode_file(parts, transfer_syntax, None, None, facts["preamble"], meta_among=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for blob in b.column(1):
                try:
                    if not blob.is_valid:
                        raise ValueError("no content")
                    out.append(one(blob.as_py()))
                    errors.append(None)
                except ValueError as x:
                    out.append(None)
                    errors.append(str(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=[key, "content", "write_error"])

    return files.select(key, data).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, content binary, write_error string")


def whole_images(files: DataFrame, *, key: str, data: str = "content", raw: bool = False) -> DataFrame:
    """(key, data, fragments, frame_error): all decoded frames of a file, in order, as one byte string
    and the fragments that hold them (null for native data). What `decoded_frames`, `joined_frames` and
    `fragment_counts` give together, in one narrow pass; a frame that can't be decoded leaves null data
    and the reason."""
    codecs = fr.registered()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, counts, errors = [], [], []
            for blob in b.column(1):
                whole = n = error = None
                try:
                    if not blob.is_valid:
                        raise ValueError("no content")
                    img = _image(blob.as_py())
                    n = None if img.syntax in NATIVE or img.data is None else fr.count_fragments(img.data)
                    whole = b"".join(px.decoded_frame(img, k, raw, codecs) for k in range(img.n_frames))
                except ValueError as x:
                    error = str(x)
                out.append(whole)
                counts.append(n)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(counts, pa.int32()), pa.array(errors, pa.string())], names=[key, "data", "fragments", "frame_error"])

    return files.select(key, data).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, data binary, fragments int, frame_error string")


def replace_pixels(elements: DataFrame, compressed: DataFrame, *, key: str) -> DataFrame:
    """Element rows (key, path, tag, vr, raw, undefined_length, ...) with the pixel data of
    `compress_images` and its tables in place of those there. Files that failed keep their own."""
    done = compressed.where("write_error IS NULL")
    kept = elements.join(done.select(key).withColumn("__new", F.lit(True)).hint("merge"), key, "left")
    old = F.coalesce("__new", F.lit(False)) & F.col("tag").isin(px.PIXELS, px.OFFSETS, px.LENGTHS) & (F.size("path") == 0)
    entry = lambda t, vr, c, u: F.struct(F.lit(t).cast("bigint").alias("tag"), vr.alias("vr"), F.col(c).alias("raw"), u.alias("undefined_length"))
    ov, no = F.lit("OV"), F.lit(False)
    parts = F.array(
        entry(px.PIXELS, F.when(F.col("undefined_length"), "OB").otherwise("OW"), "pixel_data", F.col("undefined_length")), entry(px.OFFSETS, ov, "extended_offsets", no), entry(px.LENGTHS, ov, "extended_lengths", no)
    )
    new = done.select(key, F.explode(F.filter(parts, lambda p: p["raw"].isNotNull())).alias("e")).select(key, "e.*")
    new = new.withColumn("path", F.array().cast("array<struct<tag:bigint,item:int>>"))
    return kept.where(~old).drop("__new").unionByName(new, allowMissingColumns=True)
