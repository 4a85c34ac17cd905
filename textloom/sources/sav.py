"""SPSS system files (.sav): a reader and a writer after the published description of the format.

A file's dictionary is read on the driver from its first bytes, its rows by one executor task a file, in bounded batches:
compressed rows can only be read in order. Handled: both byte orders, uncompressed and bytecode-compressed rows, long
names, value labels of numeric variables, the declared encoding. Strings beyond 255 bytes and zlib-compressed files are refused.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 1024


class Dictionary:
    """Variables of a file in order (name, width in bytes or 0 if numeric, label, value labels), and how its rows are stored."""

    def __init__(self, data: bytes):
        if data[:4] != b"$FL2":
            raise ValueError("not an SPSS system file" if data[:4] != b"$FL3" else "zlib-compressed SPSS files aren't read here")
        self.order = "<" if struct.unpack_from("<i", data, 64)[0] in (2, 3) else ">"
        self.compressed = bool(self._int(data, 72))
        self.bias = struct.unpack_from(self.order + "d", data, 84)[0]
        self.encoding, at = "cp1252", 176
        found, labels, names, slots, pending = [], {}, {}, [], None
        while True:
            kind = self._int(data, at)
            at += 4
            if kind == 2:
                width, has_label, missing = struct.unpack_from(self.order + "3i", data, at)
                name, at = data[at + 20 : at + 28].rstrip(), at + 28
                label = b""
                if has_label:
                    n = self._int(data, at)
                    label, at = data[at + 4 : at + 4 + n], at + 4 + (n + 3) // 4 * 4
                at += 8 * abs(missing)
                slots.append(len(found) if width >= 0 else None)
                if width >= 0:
                    found.append((name, width, label))
            elif kind == 3:
                count, at, pending = self._int(data, at), at + 4, []
                for _ in range(count):
                    value, n = data[at : at + 8], data[at + 8]
                    pending.append((value, data[at + 9 : at + 9 + n]))
                    at += 8 + (n + 1 + 7) // 8 * 8
            elif kind == 4:
                count = self._int(data, at)
                for slot in struct.unpack_from(f"{self.order}{count}i", data, at + 4):
                    labels[slots[slot - 1]] = pending
                at += 4 + 4 * count
            elif kind == 6:
                at += 4 + 80 * self._int(data, at)
            elif kind == 7:
                subtype, size, count = struct.unpack_from(self.order + "3i", data, at)
                body, at = data[at + 12 : at + 12 + size * count], at + 12 + size * count
                if subtype == 13:
                    names = dict(x.split(b"=", 1) for x in body.split(b"\t") if b"=" in x)
                elif subtype == 14:
                    raise ValueError("strings of more than 255 bytes aren't read here")
                elif subtype == 20:
                    self.encoding = body.decode("ascii").strip("\0 ")
            elif kind == 999:
                self.start = at + 4
                break
            else:
                raise ValueError(f"unknown record {kind} in an SPSS system file")
        say = lambda b: b.decode(self.encoding, "replace").strip("\0 ")
        self.variables = []
        for i, (name, width, label) in enumerate(found):
            values = {} if width else {struct.unpack(self.order + "d", v)[0]: say(x) for v, x in labels.get(i, [])}
            self.variables.append((say(names.get(name, name)), width, say(label), values))

    def _int(self, data: bytes, at: int) -> int:
        return struct.unpack_from(self.order + "i", data, at)[0]

    def schema(self, value_labels: bool) -> T.StructType:
        """Numeric variables are doubles, or strings where they have value labels and these are applied."""
        kind = lambda width, values: T.StringType() if width or (values and value_labels) else T.DoubleType()
        return T.StructType([T.StructField(n, kind(w, v), True, {"label": x, "values": {f"{k:g}": y for k, y in v.items()}}) for n, w, x, v in self.variables])

    def _slots(self, data: bytes) -> Iterator[bytes | None]:
        """The rows' eight-byte slots; None is the missing number."""
        at = self.start
        if not self.compressed:
            yield from (data[k : k + 8] for k in range(at, len(data) - 7, 8))
            return
        while at + 8 <= len(data):
            codes, at = data[at : at + 8], at + 8
            for code in codes:
                if code == 252:
                    return
                if code == 253:
                    yield data[at : at + 8]
                    at += 8
                elif code == 254:
                    yield b" " * 8
                elif code == 255:
                    yield None
                elif code:
                    yield struct.pack(self.order + "d", code - self.bias)

    def rows(self, data: bytes, value_labels: bool) -> Iterator[tuple]:
        missing = -1.7976931348623157e308
        slots, row = self._slots(data), []
        widths = [(max(1, (w + 7) // 8), w, v) for _, w, _, v in self.variables]
        while widths:
            for n, width, values in widths:
                taken = [x for _, x in zip(range(n), slots)]
                if len(taken) < n:
                    return
                if width:
                    row.append(b"".join(x or b" " * 8 for x in taken)[:width].decode(self.encoding, "replace").rstrip())
                    continue
                x = None if taken[0] is None else struct.unpack(self.order + "d", taken[0])[0]
                x = None if x is None or x == missing or math.isnan(x) else x
                row.append(x if x is None or not (values and value_labels) else values.get(x, f"{x:g}"))
            yield tuple(row)
            row = []


def read_sav(spark: SparkSession, path: str, value_labels: bool = True) -> DataFrame:
    """The rows of an SPSS file, ``.sav`` added where it is missing; labels stand in the columns' metadata."""
    path = path if path.lower().endswith(".sav") else path + ".sav"
    try:
        files = spark.read.format("binaryFile").load(path).select("content")
        first = files.first()
    except Exception as e:
        raise ValueError(f"can't read {path}") from e
    if first is None:
        raise ValueError(f"no file {path}")
    schema = Dictionary(bytes(first["content"])).schema(value_labels)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, held = Dictionary(data).rows(data, value_labels), []
                for row in rows:
                    held.append(row)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    made = files.mapInArrow(run, schema)
    return made.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema])


def write_sav(df: DataFrame, path: str) -> None:
    """``df`` as one SPSS file on a local or mounted path, row by row as they come from the cluster: numbers as they are, all
    else as text of at most 255 bytes; labels and value labels come from the columns' metadata. Longer texts are refused."""
    fields = df.schema.fields
    numeric = [isinstance(f.dataType, (T.NumericType, T.BooleanType)) for f in fields]
    cast = df.select(*[F.col(f"`{f.name}`").cast("double" if n else "string").alias(f.name) for f, n in zip(fields, numeric)])
    longest = cast.agg(*[F.max(F.octet_length(f"`{f.name}`") if not n else F.lit(0)).alias(f"w{i}") for i, (f, n) in enumerate(zip(fields, numeric))], F.count(F.lit(1)).alias("n")).first()
    widths = [0 if n else max(1, longest[i] or 0) for i, n in enumerate(numeric)]
    if max(widths, default=0) > 255:
        raise ValueError("an SPSS string has at most 255 bytes")
    slots = [max(1, (w + 7) // 8) for w in widths]
    pack = struct.pack
    with open(path, "wb") as out:
        out.write(b"$FL2" + b"@(#) SPSS DATA FILE textloom".ljust(60) + pack("<5id", 2, sum(slots), 0, 0, longest["n"], 100.0))
        out.write(b"01 Jan 70" + b"00:00:00" + b" " * 64 + b"\0" * 3)
        for i, (f, w, n) in enumerate(zip(fields, widths, slots)):
            label = str(f.metadata.get("label", "")).encode()[:255]
            shape = (5 << 16) | (8 << 8) | 2 if not w else (1 << 16) | (w << 8)
            out.write(pack("<6i", 2, w, bool(label), 0, shape, shape) + f"V{i}".encode().ljust(8))
            if label:
                out.write(pack("<i", len(label)) + label.ljust((len(label) + 3) // 4 * 4))
            for _ in range(n - 1):
                out.write(pack("<6i", 2, -1, 0, 0, shape, shape) + b" " * 8)
        for i, (f, w) in enumerate(zip(fields, widths)):
            values = {} if w else f.metadata.get("values", {})
            if values:
                out.write(pack("<2i", 3, len(values)))
                for k, x in values.items():
                    x = str(x).encode()[:120]
                    out.write(pack("<d", float(k)) + (bytes([len(x)]) + x).ljust((len(x) + 8) // 8 * 8))
                out.write(pack("<3i", 4, 1, 1 + sum(slots[:i])))
        names = "\t".join(f"V{i}={f.name}" for i, f in enumerate(fields)).encode()
        out.write(pack("<4i", 7, 13, 1, len(names)) + names + pack("<4i", 7, 20, 1, 5) + b"UTF-8" + pack("<2i", 999, 0))
        for row in cast.toLocalIterator():
            for x, w, n in zip(row, widths, slots):
                out.write((x or "").encode().ljust(8 * n) if w else pack("<d", -1.7976931348623157e308 if x is None else x))
