"""Fixed record layouts: field types, offsets, masks, validation, and the codec between rows and record bytes.

A layout is a StructType whose fields carry their place in metadata; byte order is little unless told otherwise, so
results do not depend on the machine.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FieldError, LayoutError

COMPACT_FIELDS = 31
WORD_BITS = 31
MOST_BYTES = 2**31 - 1
MOST_VERSION = 2**53 - 1


@dataclass(frozen=True)
class Kind:
    """A field type: width in bytes, Spark type, numpy code and integer range (None: no range)."""

    width: int
    spark: T.DataType
    numpy: str
    low: int | None = None
    high: int | None = None


def _int(bits: int, signed: bool, spark: T.DataType) -> Kind:
    low = -(1 << (bits - 1)) if signed else 0
    return Kind(bits // 8, spark, f"{'i' if signed else 'u'}{bits // 8}", low, low + (1 << bits) - 1)


#: uint64 is exact as a decimal; uint64_bits is the raw two's complement view.
KINDS = {
    "int8": _int(8, True, T.ByteType()),
    "uint8": _int(8, False, T.ShortType()),
    "int16": _int(16, True, T.ShortType()),
    "uint16": _int(16, False, T.IntegerType()),
    "int32": _int(32, True, T.IntegerType()),
    "uint32": _int(32, False, T.LongType()),
    "int64": _int(64, True, T.LongType()),
    "uint64_bits": _int(64, True, T.LongType()),
    "uint64": _int(64, False, T.DecimalType(20, 0)),
    "float32": Kind(4, T.FloatType(), "f4"),
    "float64": Kind(8, T.DoubleType(), "f8"),
    "bool": Kind(1, T.BooleanType(), "u1"),
}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    length: int | None = None  # of bytes fields
    offset: int | None = None
    alignment: int | None = None

    @property
    def width(self) -> int:
        return self.length if self.kind == "bytes" else KINDS[self.kind].width

    @property
    def natural(self) -> int:
        return 1 if self.kind == "bytes" else KINDS[self.kind].width

    @property
    def spark(self) -> T.DataType:
        return T.BinaryType() if self.kind == "bytes" else KINDS[self.kind].spark


@dataclass(frozen=True)
class CustomField:
    """A value kept as bytes of a fixed width: encode and decode are column functions, changed tells two decoded values apart (by default, unlike bytes)."""

    name: str
    width: int
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    changed: Callable[[Column, Column], Column] | None = None

    def field(self) -> Field:
        """The field of a layout that holds it."""
        return Field(self.name, "bytes", self.width)

    def stored(self, value: Column) -> Column:
        """The value's bytes; null stays null (not written), and bytes of another width end the query."""
        raw = self.encode(value)
        fits = F.when(F.octet_length(raw) == self.width, raw).otherwise(F.raise_error(F.lit(f"{self.name}: encodes to another width than {self.width}")).cast("binary"))
        return F.when(value.isNotNull(), fits)

    def differs(self, now: Column, before: Column) -> Column:
        """Whether stored bytes hold another value than those before."""
        return self.changed(self.decode(now), self.decode(before)) if self.changed else ~now.eqNullSafe(before)


def _align(x: int, to: int) -> int:
    return -(-x // to) * to


class Layout:
    """Fields in order with resolved offsets, alignment, size and masks."""

    def __init__(self, name: str, fields: Sequence[Field], alignment: int | None = None, big_endian: bool = False, version: int = 1) -> None:
        if not name or not fields:
            raise LayoutError("a layout needs a name and fields")
        names = [f.name for f in fields]
        if len(set(names)) < len(names):
            raise LayoutError(f"duplicate field names in {names}")
        end, top, placed = 0, 1, []
        for f in fields:
            if f.kind != "bytes" and f.kind not in KINDS:
                raise LayoutError(f"unknown kind {f.kind}")
            if f.kind == "bytes" and not (f.length and f.length > 0):
                raise LayoutError(f"{f.name}: bytes need a positive length")
            a = f.alignment or f.natural
            if a < 1 or a & (a - 1):
                raise LayoutError(f"{f.name}: alignment {a} is no power of two")
            at = _align(end, a) if f.offset is None else f.offset
            if at < end or at % a:
                raise LayoutError(f"{f.name}: offset {at} overlaps or is not aligned to {a}")
            end, top = at + f.width, max(top, a)
            placed.append(dataclasses.replace(f, offset=at, alignment=a))
        if alignment is not None and (alignment < 1 or alignment & (alignment - 1) or alignment < top):
            raise LayoutError(f"layout alignment {alignment} is below {top} or no power of two")
        self.name, self.version, self.big_endian = name, version, big_endian
        self.fields: tuple[Field, ...] = tuple(placed)
        self.alignment = alignment or top
        self.size = _align(end, self.alignment)
        if self.size > MOST_BYTES:
            raise LayoutError("record is too large")
        self.index = {f.name: i for i, f in enumerate(placed)}

    @classmethod
    def of(cls, source: T.StructType | type, name: str | None = None, **more) -> Layout:
        """From a StructType (metadata ``kind`` and ``byte_length`` where the type alone does not tell) or a dataclass whose fields have metadata ``kind``."""
        if dataclasses.is_dataclass(source):
            fields = [Field(f.name, f.metadata["kind"], f.metadata.get("byte_length"), f.metadata.get("offset"), f.metadata.get("alignment")) for f in dataclasses.fields(source)]
            return cls(name or source.__name__, fields, **more)
        plain = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "boolean": "bool", "decimal(20,0)": "uint64", "binary": "bytes"}
        fields = []
        for f in source.fields:
            kind = f.metadata.get("kind") or plain.get(f.dataType.simpleString())
            if kind is None:
                raise LayoutError(f"{f.name}: {f.dataType.simpleString()} has no field type")
            fields.append(Field(f.name, kind, f.metadata.get("byte_length"), f.metadata.get("offset"), f.metadata.get("alignment")))
        return cls(name or "record", fields, **more)

    @property
    def wide(self) -> bool:
        return len(self.fields) > COMPACT_FIELDS

    def schema(self) -> T.StructType:
        meta = lambda i, f: {"kind": f.kind, "offset": f.offset, "width": f.width, "alignment": f.alignment, "index": i} | ({"byte_length": f.length} if f.length else {})
        return T.StructType([T.StructField(f.name, f.spark, False, meta(i, f)) for i, f in enumerate(self.fields)])

    def _bits(self, names: Iterable[str]) -> list[int]:
        for n in names:
            if n not in self.index:
                raise FieldError(f"{n} is no field of {self.name}")
        return [self.index[n] for n in names]

    def mask(self, *names: str) -> int:
        """Compact mask of the fields; a wide layout has none."""
        if self.wide:
            raise LayoutError(f"{self.name} has {len(self.fields)} fields; use selection()")
        return sum(1 << i for i in set(self._bits(names)))

    @property
    def all_mask(self) -> int:
        return self.mask(*self.index)

    def selection(self, *names: str) -> list[int]:
        """Bit set of any width, in words of WORD_BITS."""
        words = [0] * -(-len(self.fields) // WORD_BITS)
        for i in self._bits(names):
            words[i // WORD_BITS] |= 1 << (i % WORD_BITS)
        return words

    def selection_from_mask(self, mask: int) -> list[int]:
        self.check_mask(mask)
        return [mask] + [0] * (-(-len(self.fields) // WORD_BITS) - 1)

    def check_mask(self, mask: int) -> int:
        if mask < 0 or mask >> min(len(self.fields), COMPACT_FIELDS):
            raise FieldError(f"mask {mask:#x} has bits outside {self.name}")
        return mask

    def zero(self, name: str):
        f = self.fields[self.index[name]]
        return b"\0" * f.length if f.kind == "bytes" else False if f.kind == "bool" else 0.0 if f.kind.startswith("float") else 0

    def valid(self, name: str, value: Column) -> Column:
        """Whether a value fits its field: integer range or byte length; null fits none."""
        f = self.fields[self.index[name]]
        if f.kind == "bytes":
            ok = F.octet_length(value) == f.length
        elif KINDS[f.kind].low is None:
            ok = value.isNotNull()
        else:
            wide = T.DecimalType(38, 0)
            ok = value.cast(wide).between(F.lit(KINDS[f.kind].low).cast(wide), F.lit(KINDS[f.kind].high).cast(wide)) & (value == F.floor(value))
        return F.coalesce(ok, F.lit(False))

    def check(self, name: str, value: Column) -> Column:
        """The value, or an error that ends the query."""
        return F.when(self.valid(name, value), value).otherwise(F.raise_error(F.lit(f"{self.name}.{name}: value does not fit")))

    # codec

    def dtype(self) -> np.dtype:
        order = ">" if self.big_endian else "<"
        formats = [f"S{f.length}" if f.kind == "bytes" else order + KINDS[f.kind].numpy for f in self.fields]
        return np.dtype({"names": [f.name for f in self.fields], "formats": formats, "offsets": [f.offset for f in self.fields], "itemsize": self.size})

    def encode(self, rows: pd.DataFrame) -> list[bytes]:
        """Record bytes of rows; values outside their range raise FieldError."""
        out = np.zeros(len(rows), self.dtype())
        for f in self.fields:
            values = rows[f.name]
            if f.kind == "bytes":
                if any(v is None or len(v) != f.length for v in values):
                    raise FieldError(f"{f.name}: needs {f.length} bytes")
                flat = np.frombuffer(b"".join(values), np.uint8).reshape(len(rows), f.length)
                raw = out.view(np.uint8).reshape(len(rows), self.size)
                raw[:, f.offset : f.offset + f.length] = flat
                continue
            k = KINDS[f.kind]
            if k.low is not None:
                if values.dtype.kind not in "iu":  # decimals, and numbers beside nulls
                    if values.isna().any() or any(v != int(v) for v in values):
                        raise FieldError(f"{f.name}: value is no integer")
                    values = pd.Series([int(v) for v in values], dtype=object)
                if len(values) and not (k.low <= values.min() and values.max() <= k.high):
                    raise FieldError(f"{f.name}: value outside {k.low}..{k.high}")
            out[f.name] = np.array(values, out.dtype[f.name])
        raw, size = out.tobytes(), self.size
        return [raw[i : i + size] for i in range(0, len(raw), size)]

    def decode(self, images: Sequence[bytes]) -> pd.DataFrame:
        """Rows of record bytes of exactly the layout's size."""
        if any(len(b) != self.size for b in images):
            raise FieldError(f"{self.name}: a record has {self.size} bytes")
        raw = np.frombuffer(b"".join(images), self.dtype())
        out = {}
        for f in self.fields:
            if f.kind == "bytes":
                flat = raw.view(np.uint8).reshape(len(images), self.size)[:, f.offset : f.offset + f.length]
                out[f.name] = [r.tobytes() for r in flat]
            elif f.kind == "bool":
                out[f.name] = raw[f.name] != 0
            elif f.kind == "uint64":
                import decimal

                out[f.name] = [decimal.Decimal(int(v)) for v in raw[f.name]]
            else:
                plain = {T.ByteType: "i1", T.ShortType: "i2", T.IntegerType: "i4", T.LongType: "i8", T.FloatType: "f4", T.DoubleType: "f8"}
                out[f.name] = raw[f.name].astype(plain[type(f.spark)])
        return pd.DataFrame(out)

    def encoder(self):
        """Pandas UDF: the fields' columns, in order, to record bytes."""
        names, layout = [f.name for f in self.fields], self

        @F.pandas_udf(T.BinaryType())
        def encode(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                yield pd.Series(layout.encode(pd.DataFrame(dict(zip(names, columns, strict=True)))))

        return encode(*(F.col(n) for n in names))

    def decoder(self, image: str | Column):
        """Pandas UDF: record bytes to a struct of the fields."""
        layout = self

        @F.pandas_udf(T.StructType([T.StructField(f.name, f.spark) for f in self.fields]))
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for images in batches:
                yield layout.decode(list(images))

        return decode(image)
