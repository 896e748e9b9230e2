"""Nested records to flat node tables with interval labels.

Every record is walked depth first; each node gets a pre-order and a post-order number, so that
``a`` is an ancestor of ``b`` exactly when ``a.pre < b.pre and a.post > b.post``. Node tables per
type are cut from the labelled nodes and linked by that containment.

Shapes accepted for ``annotations`` (all give the positions of a plain list): a list, one object,
a list encoded as a JSON string, a struct of parallel arrays, and any of these inside a wrapper
object ``{"example": {...}}``. ``short_answers`` may likewise be a list, one object, a string or a
struct of parallel arrays.

Defined results: NULL, blank and invalid payloads (also valid JSON with anything behind it, NaN or
Infinity literals) give no nodes; a NULL array gives no nodes; NULL elements are counted in the
numbering but give no node; offsets may be numbers or numeric strings, anything else counts as
missing. Input columns other than id and payload are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "record_id bigint, pre int, post int, depth int, parent_pre int, node_type string, item_no int, "
    "node_key string, start_byte bigint, end_byte bigint, start_token bigint, end_token bigint, "
    "candidate_index bigint, yes_no_answer bigint, text string"
)
_FIELDS = [f.split() for f in NODE_SCHEMA.split(", ")]
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
_SPAN = ("start_byte", "end_byte", "start_token", "end_token", "candidate_index")


def _refuse(name: str):
    raise ValueError(name)


def _loads(text):
    try:
        return json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError, TypeError):
        return None


def _integer(x):
    if isinstance(x, bool) or x is None:
        return None
    try:
        value = int(x) if not isinstance(x, float) else int(x) if x == int(x) else None
    except (ValueError, OverflowError):
        return None
    return value if value is not None and -(2**63) <= value < 2**63 else None


def as_list(value, columnar_keys: tuple[str, ...]) -> list:
    """The plain list that `value` stands for; see the module docstring for the shapes."""
    if isinstance(value, str):
        value = _loads(value)
    if isinstance(value, list):
        return [_loads(x) if isinstance(x, str) else x for x in value]
    if not isinstance(value, dict):
        return []
    lists = {k: v for k, v in value.items() if isinstance(v, list) and k in columnar_keys}
    if not lists:
        return [value]
    size = max(len(v) for v in lists.values())
    return [{k: v[i] for k, v in lists.items() if i < len(v)} for i in range(size)]


def label_record(record: object) -> list[dict]:
    """The labelled nodes of one parsed record: annotation, long_answer, short_answer.

    Labels count every visited node, the record itself (pre 0) included.
    """
    for _ in range(4):
        if isinstance(record, str):
            record = _loads(record)
        if isinstance(record, dict) and "annotations" not in record and "example" in record:
            record = record["example"]
        else:
            break
    if not isinstance(record, dict):
        return []
    nodes, pre, post = [], 1, 0

    def leaf(kind, no, parent, depth, fields):
        nonlocal pre, post
        nodes.append({"pre": pre, "post": post, "depth": depth, "parent_pre": parent, "node_type": kind, "item_no": no, **{k: _integer(fields.get(k)) for k in _SPAN}, "text": t if isinstance(t := fields.get("text"), str) else None})
        pre, post = pre + 1, post + 1

    # A struct of arrays is one whose ids or long answers are parallel lists; an object whose only list
    # is short_answers is a single annotation.
    for no, item in enumerate(as_list(record.get("annotations"), _columnar(record.get("annotations"))), 1):
        if not isinstance(item, dict):
            continue
        mine = pre
        node = {"pre": mine, "depth": 1, "parent_pre": 0, "node_type": "annotation", "item_no": no, "node_key": None if (k := item.get("id")) is None else str(k), "yes_no_answer": _integer(item.get("yes_no_answer"))}
        nodes.append(node)
        pre += 1
        long = item.get("long_answer")
        long = _loads(long) if isinstance(long, str) else long
        if isinstance(long, dict):
            leaf("long_answer", 0, mine, 2, long)
        for i, short in enumerate(as_list(item.get("short_answers"), ("start_byte", "end_byte", "start_token", "end_token", "text")), 1):
            if isinstance(short, dict):
                leaf("short_answer", i, mine, 2, short)
        node["post"], post = post, post + 1
    return nodes


def _columnar(value) -> tuple[str, ...]:
    if isinstance(value, str):
        value = _loads(value)
    if isinstance(value, dict) and any(isinstance(value.get(k), list) for k in ("id", "long_answer", "yes_no_answer")):
        return ("id", "long_answer", "yes_no_answer", "short_answers")
    return ()


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {name: [] for name, _ in _FIELDS}
        for rid, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not payload:
                continue
            for node in label_record(_loads(payload)):
                node["record_id"] = rid
                for name in out:
                    out[name].append(node.get(name))
        yield pa.RecordBatch.from_arrays([pa.array(out[n], type=_ARROW[t]) for n, t in _FIELDS], names=[n for n, _ in _FIELDS])


def label_nodes(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Interval-labelled nodes (NODE_SCHEMA) of the JSON texts in payload_col. Narrow: no shuffle."""
    rows = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(payload_col).alias("payload"))
    return rows.where("payload is not null").mapInArrow(_label, NODE_SCHEMA)


def node_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """One table per node type; answers carry the number of the annotation whose interval contains theirs.

    Siblings' intervals are disjoint, so the containing annotation is the last one opened before the
    answer whose post number is larger: one window per record, no range join.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("record_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("node_type") == "annotation", F.struct("pre", "post", "item_no", "node_key"))
    linked = nodes.withColumn("holder", F.last(opened, ignorenulls=True).over(w))
    inside = (F.col("holder.pre") < F.col("pre")) & (F.col("holder.post") > F.col("post"))
    span = ["start_byte", "end_byte", "start_token", "end_token"]
    link = [F.col("holder.item_no").alias("annotation_no"), F.col("holder.pre").alias("parent_pre"), "pre", "post"]
    answers = linked.where(inside)
    return {
        "annotation": nodes.where("node_type = 'annotation'").select("record_id", F.col("item_no").alias("annotation_no"), "pre", "post", F.col("node_key").alias("annotation_id"), "yes_no_answer"),
        "long_answer": answers.where("node_type = 'long_answer'").select("record_id", *link, *span, "candidate_index"),
        "short_answer": answers.where("node_type = 'short_answer'").select("record_id", *link, "item_no", *span, "text"),
        "linked": linked,
    }


def annotation_payloads(examples: DataFrame, raw: DataFrame) -> DataFrame:
    """(record_id, payload) of typed examples and raw payloads together; typed annotations become JSON
    with their NULL elements, read from the scan without the rest of the document."""
    typed = examples.select("record_id", F.concat(F.lit('{"annotations": '), F.to_json("annotations", {"ignoreNullFields": "false"}), F.lit("}")).alias("payload"))
    return typed.unionByName(raw.select("record_id", "payload"))


def answer_rows(nodes: DataFrame) -> DataFrame:
    """(record_id, kind, annotation_no, item_no) of annotations and of answers with start_byte >= 0."""
    linked = node_tables(nodes)["linked"]
    held = (F.col("holder.pre") < F.col("pre")) & (F.col("holder.post") > F.col("post")) & (F.col("start_byte") >= 0)
    is_note = F.col("node_type") == "annotation"
    return linked.where(is_note | held).select(
        "record_id",
        F.col("node_type").alias("kind"),
        F.when(is_note, F.col("item_no")).otherwise(F.col("holder.item_no")).alias("annotation_no"),
        F.when(F.col("node_type") == "short_answer", F.col("item_no")).otherwise(F.lit(0)).alias("item_no"),
    )
