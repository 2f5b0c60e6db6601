"""Nested JSON columns as related flat tables that keep parent and child together.

Spark parses the text once into typed lists. The lists reach the Python workers as Arrow buffers and are flattened
there by their offsets: ``list_parent_indices`` names each child's parent row, a subtraction of offsets gives its
place, and one ``take`` carries the keys down. No row is looked at on its own. Work stays within the partition, so a
hot key changes nothing and no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT = "struct<doc_id string, title string, score double, snippet string, source_path string>"
CALL = "struct<tool string, arguments string, success boolean, timestamp double, content string>"

CALLS_SCHEMA = "id bigint, call_no int, tool string, arguments string, success boolean, timestamp double, content string"
HITS_SCHEMA = "id bigint, call_no int, hit_no int, doc_id string, title string, score double, snippet string, source_path string"
LINKS_SCHEMA = "id bigint, call_no int, hit_no int, doc_id string"


def json_list(text: Column, element: str, around: str) -> Column:
    """``text`` as an array of ``element``, or null where it doesn't parse.

    The text may hold a list, one object alone, an object around the list (under the key ``around``), or one of these
    stored as a JSON string once more. Null elements keep their place as nulls; elements that are no objects become
    nulls too. A null or missing list under ``around`` is empty.
    """
    wrapped = lambda body: F.concat(F.lit('{"a":'), body, F.lit("}"))
    starts = lambda c, mark: F.ltrim(c).startswith(mark)
    plain = F.when(starts(text, '"'), F.get_json_object(wrapped(text), "$.a")).otherwise(text)
    inner = F.when(
        starts(plain, "{"),
        F.when(F.array_contains(F.json_object_keys(plain), around), F.coalesce(F.get_json_object(plain, f"$.{around}"), F.lit("[]"))).otherwise(plain),
    ).otherwise(plain)
    inner = F.when(starts(inner, "{"), F.concat(F.lit("["), inner, F.lit("]"))).otherwise(inner)
    corrupt = {"columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_json(wrapped(inner), f"a array<{element}>, _corrupt_record string", corrupt)
    # Elements or fields of other kinds spoil the list as a whole; then each element is read on its own.
    loose = F.from_json(wrapped(inner), "a array<string>, _corrupt_record string", corrupt)
    one_by_one = F.when(loose["_corrupt_record"].isNull(), F.transform(loose["a"], lambda e: F.when(starts(e, "{"), F.from_json(e, element))))
    return F.when(starts(inner, "["), F.when(parsed["_corrupt_record"].isNull(), parsed["a"]).otherwise(one_by_one))


def _children(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of all lists: the elements that aren't null, each one's parent row, and its place in the list."""
    parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(lists)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    heads = np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else np.zeros(0, dtype=np.int64)
    places = np.arange(len(parents)) - heads[parents]
    there = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
    return values.take(pa.array(there)), parents[there], places[there].astype(np.int32)


def _field(structs: pa.Array, name: str) -> pa.Array:
    return pc.struct_field(structs, name)


def _flatten(level: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            calls, of_row, call_no = _children(batch.column("calls"))
            call_ids = ids.take(pa.array(of_row))
            if level == "calls":
                fields = [_field(calls, f) for f in ("tool", "arguments", "success", "timestamp", "content")]
                yield pa.RecordBatch.from_arrays([call_ids, pa.array(call_no), *fields], names=["id", "call_no", "tool", "arguments", "success", "timestamp", "content"])
                continue
            inner, of_call, inner_no = _children(_field(calls, "hits"))
            outer, of_log, outer_no = _children(batch.column("hits"))
            rows = [
                (call_ids.take(pa.array(of_call)), call_no[of_call], inner_no, inner),
                (ids.take(pa.array(of_log)), np.full(len(of_log), -1, dtype=np.int32), outer_no, outer),
            ]
            if level == "links":
                rows.append((call_ids, call_no, np.full(len(call_no), -1, dtype=np.int32), None))
            for keys, call, place, hits in rows:
                if level == "links":
                    doc = pc.fill_null(_field(hits, "doc_id"), "") if hits is not None else pa.array([""] * len(keys), type=pa.string())
                    yield pa.RecordBatch.from_arrays([keys, pa.array(call), pa.array(place), doc], names=["id", "call_no", "hit_no", "doc_id"])
                else:
                    fields = [_field(hits, f) for f in ("doc_id", "title", "score", "snippet", "source_path")]
                    yield pa.RecordBatch.from_arrays([keys, pa.array(call), pa.array(place), *fields], names=["id", "call_no", "hit_no", "doc_id", "title", "score", "snippet", "source_path"])

    return run


def _parsed(df: DataFrame, row_id: Column, calls: Column, hits: Column, hit: str) -> DataFrame:
    call = F.transform(
        json_list(calls, CALL, "calls"),
        lambda c: F.when(c.isNotNull(), F.struct(c["tool"].alias("tool"), c["arguments"].alias("arguments"), c["success"].alias("success"), c["timestamp"].alias("timestamp"), c["content"].alias("content"), json_list(c["content"], hit, "results").alias("hits"))),
    )
    return df.select(row_id.cast("bigint").alias("id"), call.alias("calls"), json_list(hits, hit, "results").alias("hits"))


def flatten_calls(df: DataFrame, row_id: Column, calls: Column) -> DataFrame:
    """One row per tool call: id of the log row, call_no (place from 0) and the call's fields.

    Null elements keep their place and give no row; text that is null, empty or doesn't parse gives none. Repeated
    rows of ``df`` give repeated rows. Clashing names of other columns do no harm, as only the named ones are read.
    """
    return _parsed(df, row_id, calls, F.lit(None).cast("string"), "struct<doc_id string>").mapInArrow(_flatten("calls"), CALLS_SCHEMA)


def flatten_hits(df: DataFrame, row_id: Column, calls: Column, hits: Column) -> DataFrame:
    """One row per hit with its fields: hits inside a call have the call's place, those of ``hits`` have call_no -1."""
    return _parsed(df, row_id, calls, hits, HIT).mapInArrow(_flatten("hits"), HITS_SCHEMA)


def flatten_links(df: DataFrame, row_id: Column, calls: Column, hits: Column) -> DataFrame:
    """Keys alone, in one pass: each call with hit_no -1 and doc_id '', each hit as in ``flatten_hits``.

    doc_id is '' where it is absent or null.
    """
    return _parsed(df, row_id, calls, hits, "struct<doc_id string>").mapInArrow(_flatten("links"), LINKS_SCHEMA)
