"""Files of arrays: Zarr version 2 and classic NetCDF, a part of a variable at a time."""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd

FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".nc": "netcdf", ".nc4": "netcdf", ".netcdf": "netcdf", ".zarr": "zarr"}


def format_of(path: str, named: str = "auto") -> str:
    if named != "auto":
        return named
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"no reader for {path}")
    return FORMATS[suffix]


#: Values of each variable that one task reads at a time.
SLAB_VALUES = 1 << 20


@dataclass
class Variable:
    """A variable of an array file: its form, and a function that reads it between two places of its first dimension (of all, where it has none)."""

    dims: list[str]
    shape: tuple[int, ...]
    dtype: np.dtype
    attributes: dict
    read: Callable[[int, int], np.ndarray]
    #: places of the first dimension that are stored together
    together: int = 1


def zarr_variable(root: str, name: str) -> Variable:
    """A variable of a Zarr version 2 directory: raw or zlib chunks, C order, no filters. Only chunks of the wanted places are opened."""
    meta = json.loads(Path(root, name, ".zarray").read_text())
    attributes = Path(root, name, ".zattrs")
    attributes = json.loads(attributes.read_text()) if attributes.exists() else {}
    kind = (meta["compressor"] or {}).get("id")
    if kind not in (None, "zlib", "gzip") or meta.get("filters") or meta.get("order", "C") != "C":
        raise ValueError(f"{name}: only raw, zlib and gzip chunks in C order can be read")
    shape, chunks, dtype = meta["shape"], meta["chunks"], np.dtype(meta["dtype"])
    fill = meta.get("fill_value")
    fill = np.nan if fill == "NaN" else (0 if fill is None else fill)

    def read(first: int, last: int) -> np.ndarray:
        if not shape:
            first, last = 0, 1
        whole = [slice(first, last), *[slice(0, n) for n in shape[1:]]][: len(shape)]
        out = np.full([s.stop - s.start for s in whole], fill, dtype)
        for at in itertools.product(*[range(s.start // c, -(-s.stop // c)) for s, c in zip(whole, chunks)]):
            file = Path(root, name, meta.get("dimension_separator", ".").join(map(str, at)) or "0")
            if file.exists():
                raw = file.read_bytes()
                block = np.frombuffer(zlib.decompress(raw, 47) if kind else raw, dtype).reshape(chunks)
                both = [(max(i * c, s.start), min((i + 1) * c, s.stop)) for i, c, s in zip(at, chunks, whole)]
                out[tuple(slice(lo - s.start, hi - s.start) for (lo, hi), s in zip(both, whole))] = block[tuple(slice(lo - i * c, hi - i * c) for (lo, hi), i, c in zip(both, at, chunks))]
        return out

    return Variable(attributes.get("_ARRAY_DIMENSIONS", [f"dim_{i}" for i in range(len(shape))]), tuple(shape), dtype, attributes, read, chunks[0] if chunks else 1)


_NC_KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def netcdf_variables(path: str) -> dict[str, Variable]:
    """The variables of a classic NetCDF file (versions 1 and 2), mapped into memory: only what is read is loaded."""
    raw = np.memmap(path, np.uint8, "r")
    if bytes(raw[:3]) != b"CDF" or raw[3] not in (1, 2):
        raise ValueError("only the classic NetCDF format can be read")
    at = 4

    def integer() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(">i", raw, at - 4)[0]

    def name() -> str:
        nonlocal at
        n = integer()
        at += -(-n // 4) * 4
        start = at - -(-n // 4) * 4
        return bytes(raw[start : start + n]).decode()

    def attributes() -> dict:
        nonlocal at
        out = {}
        integer()
        for _ in range(integer()):
            key, kind, n = name(), integer(), 0
            n = integer()
            dtype = np.dtype(_NC_KINDS[kind])
            value = np.frombuffer(raw, dtype, n, at)
            at += -(-n * dtype.itemsize // 4) * 4
            out[key] = value.tobytes().decode() if kind == 2 else value
        return out

    records = integer()
    integer()
    dims = [(name(), integer()) for _ in range(integer())]
    attributes()
    integer()
    headers = []
    for _ in range(integer()):
        key = name()
        ids = [integer() for _ in range(integer())]
        extra, kind, size = attributes(), integer(), integer()
        begin = struct.unpack_from(">q" if raw[3] == 2 else ">i", raw, at)[0]
        at += 8 if raw[3] == 2 else 4
        headers.append((key, ids, extra, np.dtype(_NC_KINDS[kind]), size, begin))
    stride = sum(h[4] for h in headers if h[1] and dims[h[1][0]][1] == 0)
    out = {}
    for key, ids, extra, dtype, _, begin in headers:
        shape = tuple(dims[i][1] or records for i in ids)
        inner = np.cumprod([dtype.itemsize, *shape[:0:-1]])[::-1].tolist()
        steps = (stride if ids and dims[ids[0]][1] == 0 else inner[0], *inner[1:]) if ids else ()
        # A view of the file: rows of a record variable are a whole record apart.
        view = np.ndarray(shape, dtype, raw, begin, steps) if all(shape) else np.zeros(shape, dtype)
        out[key] = Variable([dims[i][0] for i in ids], shape, dtype, extra, lambda a, b, v=view: v[a:b] if v.ndim else v)
    return out


def array_variables(path: str, kind: str) -> dict[str, Variable]:
    if kind == "zarr":
        return {d.name: zarr_variable(path, d.name) for d in Path(path).iterdir() if (d / ".zarray").exists()}
    return netcdf_variables(path)


def position_dims(variables: dict[str, Variable], x: str, y: str) -> dict[str, int]:
    """The dimensions of the positions and their sizes: those of x or y, which must hold the other's."""
    one = max((variables[x], variables[y]), key=lambda v: len(v.dims))
    if not set(variables[x].dims) <= set(one.dims) or not set(variables[y].dims) <= set(one.dims):
        raise ValueError(f"{x} and {y} do not share dimensions")
    return dict(zip(one.dims, one.shape))


def flattened(variables: dict[str, Variable], columns: list[str], x: str, y: str, first: int = 0, last: int | None = None) -> pd.DataFrame:
    """Mapped variables spread over the dimensions of x and y and laid out row by row, between two places of the first of them; a bare dimension counts from 0."""
    sizes = position_dims(variables, x, y)
    dims = list(sizes)
    last = sizes[dims[0]] if last is None else last
    here = sizes | {dims[0]: last - first}
    out = {}
    for c in columns:
        if c in variables:
            v = variables[c]
            own, extra = v.dims, v.attributes
            if not set(own) <= set(dims):
                raise ValueError(f"{c} has a dimension that positions do not have")
            if own and own[0] == dims[0]:
                data = v.read(first, last)
            else:
                data = v.read(0, v.shape[0] if own else 1)
                data = np.take(data, range(first, last), own.index(dims[0])) if dims[0] in own else data
        elif c in sizes:
            data, own, extra = np.arange(first, last) if c == dims[0] else np.arange(sizes[c]), [c], {}
        else:
            raise ValueError(f"no variable {c}")
        data = np.transpose(data, [own.index(d) for d in dims if d in own])
        data = np.broadcast_to(data.reshape([here[d] if d in own else 1 for d in dims]), list(here.values())).ravel()
        units = str(extra.get("units", ""))
        if " since " in units:
            if extra.get("calendar", "standard") not in ("standard", "gregorian", "proleptic_gregorian"):
                raise ValueError(f"{c}: calendar {extra['calendar']}")
            step, _, origin = units.partition(" since ")
            unit = {"s": "s", "m": "min", "h": "h", "d": "D"}[step.strip()[0]]
            start = pd.Timestamp(origin)
            data = (start.tz_localize("UTC") if start.tz is None else start) + pd.to_timedelta(data.astype(float), unit=unit)
        out[c] = np.array([v.decode().strip("\0 ") for v in data]) if getattr(data, "dtype", None) is not None and data.dtype.kind == "S" else data
    return pd.DataFrame(out)
