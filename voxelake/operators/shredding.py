"""Deeply nested DICOM JSON as flat, linked tables: adjacency-table shredding.

`shred` stores every dataset, element and scalar of a record as one row of a node table (node,
parent, label, ordinal, scalar). Flat tables come from joins of that table with itself: object
nodes with their elements, elements with their scalars, pivoted into one table per sequence.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG_KEY = re.compile(r"[0-9A-Fa-f]{1,8}\Z")
NODE_FIELDS = (
    ("node", pa.int32(), "int"),
    ("parent", pa.int32(), "int"),
    ("kind", pa.string(), "string"),
    ("label", pa.string(), "string"),
    ("ordinal", pa.int32(), "int"),
    ("vr", pa.string(), "string"),
    ("sequence_path", pa.string(), "string"),
    ("scalar", pa.string(), "string"),
)


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def is_dataset(value: object) -> bool:
    """An object that is keyed by tags: any key of one to eight hex digits."""
    return isinstance(value, dict) and any(TAG_KEY.match(k) for k in value)


def record_nodes(text: str | None) -> Iterator[tuple]:
    """The nodes of one record, in document order, as tuples of NODE_FIELDS.

    An explicit stack instead of recursion, so depth is bounded by the JSON parser alone.
    """
    if text is None:
        return
    try:
        root = json.loads(text)
    except (ValueError, RecursionError) as e:
        yield (0, None, "error", None, None, None, None, str(e)[:200])
        return
    # (value, parent node, kind, label, ordinal, path of the sequence it stands in)
    stack: list[tuple] = [(d, None, "object", None, i, None) for i, d in enumerate(root if isinstance(root, list) else [root])][::-1]
    node = -1
    while stack:
        value, parent, kind, label, ordinal, path = stack.pop()
        node += 1
        below: list[tuple] = []
        vr = None
        if kind == "object" and isinstance(value, dict):
            tagged = is_dataset(value)
            for i, (k, v) in enumerate(value.items()):
                if TAG_KEY.match(k) and (tagged or parent is None):
                    tag = k.upper().zfill(8)
                    here = tag if path is None else f"{path}/{ordinal}/{tag}"
                    below.append((v, node, "element", tag, i, here))
                else:
                    below.append((v, node, "scalar", k, i, None))
        elif kind == "element" and isinstance(value, dict):
            vr = value.get("vr") if isinstance(value.get("vr"), str) else None
            for k, v in value.items():
                if k == "Value":
                    for i, entry in enumerate(v if isinstance(v, list) else [v]):
                        if isinstance(entry, dict):
                            below.append((entry, node, "object", k, i, path))
                        else:
                            below.append((entry, node, "scalar", k, i, None))
                elif k != "vr":
                    below.append((v, node, "scalar", k, 0, None))
        elif kind == "element":  # a bare value instead of an element object
            below.append((value, node, "scalar", "Value", 0, None))
        yield (
            node,
            parent,
            kind,
            label,
            ordinal,
            vr,
            path if kind == "object" else None,
            _text(value) if kind == "scalar" or (kind == "object" and not isinstance(value, dict)) else None,
        )
        stack.extend(reversed(below))


def shred(records: DataFrame, *, key: str = "rec_id", text: str = "record_json") -> DataFrame:
    """The node table of `text`: `key`, node, parent, kind, label, ordinal, vr, sequence_path, scalar.

    kind `object`: a dataset (the record itself has no parent; an item's parent is its sequence
    element, its ordinal the place in Value from 0, and sequence_path the way to the sequence) or
    another object inside Value, such as a person name. kind `element`: label is the tag as eight
    upper-case hex digits, parent its dataset, ordinal the place among the members. kind `scalar`:
    an entry of Value, InlineBinary, BulkDataURI or a member of a plain object. kind `error`: the
    text is no JSON; scalar holds the message.

    Null text gives no nodes, an empty object one. Rows with null or repeated keys are shredded
    like all others, but joins by key only tie nodes of non-null, unique keys. Other columns are
    not carried. Every record is handled whole; the work is one narrow Arrow pass.
    """
    key_type = records.schema[key].dataType
    schema = ", ".join([f"`{key}` {key_type.simpleString()}", *(f"{n} {t}" for n, _, t in NODE_FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at: list[int] = []
            cols: list[list] = [[] for _ in NODE_FIELDS]
            for i, t in enumerate(texts.to_pylist()):
                for row in record_nodes(t):
                    at.append(i)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                if len(at) >= 50_000:
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *(pa.array(c, f[1]) for c, f in zip(cols, NODE_FIELDS, strict=True))], names=[key, *(f[0] for f in NODE_FIELDS)])
                    at, cols = [], [[] for _ in NODE_FIELDS]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), *(pa.array(c, f[1]) for c, f in zip(cols, NODE_FIELDS, strict=True))], names=[key, *(f[0] for f in NODE_FIELDS)])

    return records.select(key, text).mapInArrow(run, schema)


def item_elements(nodes: DataFrame, *, key: str = "rec_id") -> DataFrame:
    """One row per element inside an item: key, sequence_path, item_no, tag, vr, node, item_node.

    Object nodes joined with their element children; records' own top-level elements, which stand
    in no item, fall out because the record's object has no parent. The nodes are read twice, so a
    caller that has just shredded them writes them down first (`cut_lineage`).
    """
    items = nodes.where("kind = 'object' AND parent IS NOT NULL").select(
        key, F.col("node").alias("item_node"), "sequence_path", F.col("ordinal").alias("item_no")
    )
    elements = nodes.where("kind = 'element'").select(key, F.col("parent").alias("item_node"), F.col("label").alias("tag"), "vr", "node")
    return elements.join(items.hint("merge"), [key, "item_node"]).select(key, "sequence_path", "item_no", "tag", "vr", "node", "item_node")


def entity_table(nodes: DataFrame, sequence_tag: str, columns: dict[str, str], *, key: str = "rec_id") -> DataFrame:
    """The items of every sequence `sequence_tag`, one row each, with the listed tags as columns.

    Gives key, item_node, parent_node (the item or record that holds the sequence), sequence_path,
    item_no and one column per entry of `columns` (tag -> name): the element's values joined by a
    backslash, null where the element is missing or empty. Items without any listed element stay.
    """
    seqs = nodes.where((F.col("kind") == "element") & (F.col("label") == sequence_tag)).select(
        key, F.col("node").alias("seq_node"), F.col("parent").alias("parent_node")
    )
    items = nodes.where("kind = 'object' AND parent IS NOT NULL").select(
        key, F.col("parent").alias("seq_node"), F.col("node").alias("item_node"), "sequence_path", F.col("ordinal").alias("item_no")
    )
    elements = nodes.where((F.col("kind") == "element") & F.col("label").isin(*columns)).select(
        key, F.col("parent").alias("item_node"), F.col("node").alias("element_node"), F.col("label").alias("tag")
    )
    scalars = nodes.where("kind = 'scalar' AND label = 'Value' AND scalar IS NOT NULL").select(
        key, F.col("parent").alias("element_node"), F.col("ordinal").alias("place"), "scalar"
    )
    values = (
        elements.join(scalars.hint("merge"), [key, "element_node"])
        .groupBy(key, "item_node", "tag")
        .agg(F.sort_array(F.collect_list(F.struct("place", "scalar"))).alias("vs"))
        .select(key, "item_node", "tag", F.array_join(F.transform("vs", lambda v: v["scalar"]), "\\").alias("value"))
        .groupBy(key, "item_node")
        .pivot("tag", list(columns))
        .agg(F.first("value"))
    )
    for tag, name in columns.items():
        values = values.withColumnRenamed(tag, name)
    return seqs.join(items.hint("merge"), [key, "seq_node"]).drop("seq_node").join(values.hint("merge"), [key, "item_node"], "left").select(
        key, "item_node", "parent_node", "sequence_path", "item_no", *columns.values()
    )
