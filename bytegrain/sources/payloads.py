"""Payload tables in, decoded tables out."""

from __future__ import annotations

import decimal
import json
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.values import DecodeError, Int, Some, Tagged, View, plain
from ..operators import format as N
from ..operators import formats as M


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path and payload of every file; a directory's files by a pattern of names."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).selectExpr("path", "content as payload")


def named(name: str) -> N.Format:
    """A registered format, by a name of any case; `sniff` tries them in order."""
    if name.lower() == "sniff":
        return M.sniffer()
    found = {k.lower(): v for k, v in M.REGISTRY.items()}.get(name.lower())
    if found is None:
        raise ValueError(f"unknown format {name}; known: {', '.join(sorted(M.REGISTRY))}")
    return found


ERRORS = "struct<kind:string,offset:bigint,message:string>"


Shaper = Callable[[Any], Any]


def shaper(kind: pa.DataType) -> Shaper:
    """Makes of a decoded value what a column of the type wants; fields that the type lacks are left out, which is how columns are pruned."""
    if pa.types.is_struct(kind):
        fields = [(f.name, shaper(f.type)) for f in kind]
        by_name = dict(fields)

        def make(v: Any) -> Any:
            if isinstance(v, Tagged):
                out = dict.fromkeys(by_name)
                if "tag" in out:
                    out["tag"] = v.tag
                if v.tag in by_name and v.tag != "tag":
                    out[v.tag] = by_name[v.tag](v.value)
                return out
            if isinstance(v, tuple):
                return {k: f(v[int(k[1:])]) for k, f in fields}
            return {k: f(v.get(k)) for k, f in fields}
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
        item = shaper(kind.value_type)

        def make(v: Any) -> Any:
            return [item(x) for x in v]
    elif pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        make = bytes
    elif pa.types.is_string(kind) or pa.types.is_large_string(kind):

        def make(v: Any) -> Any:
            if isinstance(v, (bytes, bytearray)):
                return v.decode("latin-1")
            return v if isinstance(v, str) else "".join(v) if isinstance(v, list) and all(isinstance(x, str) for x in v) else json.dumps(plain(v), ensure_ascii=False)
    elif pa.types.is_decimal(kind):
        make = decimal.Decimal
    else:

        def make(v: Any) -> Any:
            return v.offset if isinstance(v, View) else int(v) if isinstance(v, Int) else v

    def run(v: Any) -> Any:
        v = v.value if v.__class__ is Some else v
        return None if v is None else make(v)

    return run


def _row_by_row(values: list, errors: list, kind: pa.DataType) -> pa.Array:
    """The column where some value does not fit its type: that row gets an error, the others stay."""
    for k, v in enumerate(values):
        try:
            pa.array([v], kind)
        except (pa.ArrowException, OverflowError, TypeError, ValueError) as e:
            values[k], errors[k] = None, {"kind": "eval", "offset": None, "message": f"the value is no {kind}: {e}"[:200]}
    return pa.array(values, kind)


def spread(frame: DataFrame) -> DataFrame:
    """The rows over all cores, where Spark's estimate says that they come in fewer partitions than there are cores: decoding costs far more than
    a shuffle of so little. Larger inputs stay where they lie."""
    if frame.isStreaming or not hasattr(frame, "_jdf"):
        return frame
    spark = frame.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    part = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return frame.repartition(cores) if size < cores * part else frame


def decode_column(frame: DataFrame, fmt: N.Format | str, schema: str, payload: str = "payload", keep: list[str] | None = None, sniff: Any = None, even: bool = True) -> DataFrame:
    """Decodes each payload: the kept columns, then `value` (of the given Spark type), `error` (null where it went well) and `warnings`.

    schema: the type wanted, which may leave fields out; it is known before any data are read. sniff: a column; rows where it does not hold
    are dropped before decoding, natively, so that it can reach the scan. even: small inputs are spread over all cores. A null payload gives a null value without an error; rows are
    independent, so payloads spread over partitions as they lie. Whatever goes wrong with a row, a value that its column's type cannot hold
    included, is that row's error.
    """
    fmt = named(fmt) if isinstance(fmt, str) else fmt
    keep = [c for c in frame.columns if c != payload] if keep is None else keep
    frame = frame.filter(sniff) if sniff is not None else frame
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    out_schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"value {schema}", f"error {ERRORS}", f"warnings array<{ERRORS}>"])
    raw = pickle.dumps(fmt)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(schema))
    error_kind = pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("message", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program, shaped = pickle.loads(raw), shaper(kind)
        for batch in batches:
            values, errors, warnings = [], [], []
            for data in batch.column(payload):
                value, error, warned, data = None, None, [], data.as_py()
                if data is not None:
                    try:
                        value, warned = N.decode(program, data.encode() if isinstance(data, str) else data)
                        value = shaped(value)
                    except DecodeError as e:
                        value, error = None, {"kind": e.kind, "offset": e.offset, "message": e.message}
                    except (RecursionError, MemoryError, AttributeError, TypeError, ValueError, LookupError, OverflowError) as e:  # of one row; the others go on
                        value, error = None, {"kind": "eval", "offset": None, "message": f"{type(e).__name__}: {e}"[:200]}
                values.append(value)
                errors.append(error)
                warnings.append(warned)
            try:
                column = pa.array(values, kind)
            except (pa.ArrowException, OverflowError, TypeError, ValueError):
                column = _row_by_row(values, errors, kind)
            columns = [*(batch.column(c) for c in keep), column, pa.array(errors, error_kind), pa.array(warnings, pa.list_(error_kind))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "value", "error", "warnings"])

    frame = frame.select(*keep, payload)
    return (spread(frame) if even else frame).mapInArrow(run, out_schema)


#: Kinds of renderings and the types of their columns.
RENDERED = {"json": "string", "tree": "string", "flat": "array<struct<path:string,value:string>>", "located": "array<struct<path:string,start:bigint,stop:bigint>>"}


def render_column(frame: DataFrame, fmt: N.Format | str, *how: str, payload: str = "payload") -> DataFrame:
    """Decodes each payload and renders it: the other columns, one for each way of RENDERED that is asked for, and `error`.

    json and tree are texts, flat lists the leaves with their paths, located the fields with the places that they were read from. A null
    payload and one that fails give nulls.
    """
    fmt = named(fmt) if isinstance(fmt, str) else fmt
    keep = [c for c in frame.columns if c != payload]
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{h} {RENDERED[h]}" for h in how), f"error {ERRORS}"])
    raw = pickle.dumps(fmt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = pickle.loads(raw)
        shown = {
            "json": lambda v, _: to_json(v), "tree": lambda v, _: to_tree(v), "flat": lambda v, _: [{"path": k, "value": _leaf(x)} for k, x in flat(v)],
            "located": lambda _, data: [dict(zip(("path", "start", "stop"), x)) for x in N.located(program, data)],
        }
        arrow = {"json": pa.string(), "tree": pa.string(), "flat": pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())])), "located": pa.list_(pa.struct([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))}
        for batch in batches:
            out: dict[str, list] = {h: [] for h in how}
            errors = []
            for data in batch.column(payload):
                data, error, row = data.as_py(), None, dict.fromkeys(how)
                if data is not None:
                    try:
                        value = N.decode(program, data)[0]
                        row = {h: shown[h](value, data) for h in how}
                    except DecodeError as e:
                        error = {"kind": e.kind, "offset": e.offset, "message": e.message}
                    except (RecursionError, MemoryError, AttributeError, TypeError, ValueError, LookupError, OverflowError) as e:
                        error = {"kind": "eval", "offset": None, "message": f"{type(e).__name__}: {e}"[:200]}
                for h in how:
                    out[h].append(row[h])
                errors.append(error)
            columns = [*(batch.column(c) for c in keep), *(pa.array(out[h], arrow[h]) for h in how), pa.array(errors, pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("message", pa.string())]))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *how, "error"])

    return spread(frame.select(*keep, payload)).mapInArrow(run, schema)


def _leaf(x: Any) -> str | None:
    if isinstance(x, (bytes, bytearray)):
        return x.decode("ascii") if x.isascii() and x.decode("ascii").isprintable() else x.hex(" ")
    return None if x is None else str(plain(x))


def to_json(value: Any) -> str:
    return json.dumps(plain(value), ensure_ascii=False)


def to_tree(value: Any, name: str = "value", depth: int = 0, most: int = 8) -> str:
    """An indented tree of one value; long sequences show their ends."""
    pad = "  " * depth
    value = value.value if isinstance(value, Some) else value
    if isinstance(value, Tagged):
        return f"{pad}{name}: {{{value.tag}}}\n" + to_tree(value.value, value.tag, depth + 1, most)
    if isinstance(value, dict):
        return f"{pad}{name}\n" + "".join(to_tree(v, k, depth + 1, most) for k, v in value.items())
    if isinstance(value, bytes):
        body = value.decode("ascii") if value.isascii() and value.decode("ascii").isprintable() else value[:32].hex(" ") + (f" .. ({len(value)} bytes)" if len(value) > 32 else "")
        return f"{pad}{name}: {body!r}\n" if value.isascii() else f"{pad}{name}: {body}\n"
    if isinstance(value, (list, tuple, range)):
        if value and all(isinstance(x, str) for x in value):
            return f"{pad}{name}: {''.join(value)!r}\n"
        shown = list(enumerate(value))
        if len(shown) > most:
            shown = [*shown[: most // 2], (None, len(value) - most), *shown[-most // 2 :]]
        return f"{pad}{name} [{len(value)}]\n" + "".join(f"{pad}  .. skipping {x}\n" if i is None else to_tree(x, str(i), depth + 1, most) for i, x in shown)
    return f"{pad}{name}: {int(value) if isinstance(value, Int) else value}\n"


def flat(value: Any, path: str = "") -> list[tuple[str, Any]]:
    """(path, leaf) of every leaf."""
    value = value.value if isinstance(value, Some) else value
    if isinstance(value, Tagged):
        return flat(value.value, f"{path}/{value.tag}")
    if isinstance(value, dict):
        return [y for k, v in value.items() for y in flat(v, f"{path}.{k}" if path else k)]
    if isinstance(value, (list, tuple)):
        return [y for i, v in enumerate(value) for y in flat(v, f"{path}[{i}]")]
    return [(path, value)]


def census(spark: SparkSession) -> DataFrame:
    """Which kinds of nodes each registered format uses."""
    return spark.createDataFrame([(k, sorted(f.census())) for k, f in sorted(M.REGISTRY.items())], "format string, operators array<string>")


__all__ = ["census", "decode_column", "flat", "named", "read_files", "render_column", "shaper", "spread", "to_json", "to_tree"]
