"""Images with XML labels beside their data, and cubes with attached object labels."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .pds import CELLS, kind_of, parse_label, plane_rows

#: Fixed sample types of XML labels and cubes as numpy types.
XML_TYPES = {"UnsignedByte": "u1", "SignedByte": "i1", "UnsignedLSB2": "<u2", "UnsignedMSB2": ">u2", "SignedLSB2": "<i2", "SignedMSB2": ">i2", "SignedLSB4": "<i4", "SignedMSB4": ">i4", "UnsignedLSB4": "<u4", "UnsignedMSB4": ">u4", "IEEE754LSBSingle": "<f4", "IEEE754MSBSingle": ">f4", "IEEE754LSBDouble": "<f8", "IEEE754MSBDouble": ">f8"}
CUBE_TYPES = {"UnsignedByte": "u1", "SignedWord": "i2", "UnsignedWord": "u2", "SignedInteger": "i4", "Real": "f4", "Double": "f8"}
#: Fixed: reals below this are special pixels of cubes.
CUBE_LEAST = -3.4028225e38


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def parse_xml_label(text: str) -> dict:
    """file, offset, axes (name, elements), type, scale, add and missing of the first array of a label."""
    root = ET.fromstring(text)
    find = lambda e, n: next((x for x in e.iter() if _name(x) == n), None)
    array = next(x for x in root.iter() if _name(x).startswith("Array_"))
    get = lambda n, d=None: (x.text.strip() if (x := find(array, n)) is not None and x.text else d)
    axes = [(next(c.text.strip() for c in a if _name(c) == "axis_name"), int(next(c.text for c in a if _name(c) == "elements"))) for a in array.iter() if _name(a) == "Axis_Array"]
    name = find(root, "file_name")
    return {"file": name.text.strip() if name is not None else None, "offset": int(get("offset", 0)), "axes": axes, "type": get("data_type"), "scale": float(get("scaling_factor", 1)), "add": float(get("value_offset", 0)), "missing": get("missing_constant")}


def xml_samples(raw: bytes, label: dict) -> np.ndarray:
    """bands x lines x samples as doubles; missing values become NaN."""
    shape = [n for _, n in label["axes"]]
    x = np.frombuffer(raw, np.dtype(XML_TYPES[label["type"]]), int(np.prod(shape)), label["offset"]).reshape(shape).astype(float)
    order = [n.lower() for n, _ in label["axes"]]
    if "band" in order:
        x = np.moveaxis(x, [order.index("band"), order.index("line"), order.index("sample")], [0, 1, 2])
    else:
        x = x[None] if order == ["line", "sample"] else x.T[None]
    if label["missing"] is not None:
        x = np.where(x == float(label["missing"]), np.nan, x)
    return x * label["scale"] + label["add"]


def cube_samples(raw: bytes) -> np.ndarray:
    """bands x lines x samples of an attached cube (tiled or band sequential); special pixels become NaN."""
    label = parse_label(raw[: 1 << 16].split(b"\nEnd\n", 1)[0].decode("latin-1"))
    core = next(k.rsplit(".", 1)[0] for k in label if k.upper().endswith("CORE.STARTBYTE"))
    get = lambda k, d=None: next((v for n, v in label.items() if n.upper() == f"{core}.{k}".upper()), d)
    cols, lines, bands = (int(get(f"Dimensions.{n}")) for n in ("Samples", "Lines", "Bands"))
    order = ">" if get("Pixels.ByteOrder", "Lsb").lower() == "msb" else "<"
    kind = np.dtype(order + CUBE_TYPES[get("Pixels.Type")])
    start = int(get("StartByte")) - 1
    if get("Format", "BandSequential").lower() == "tile":
        th, tw = int(get("TileLines")), int(get("TileSamples"))
        down, across = -(-lines // th), -(-cols // tw)
        x = np.frombuffer(raw, kind, bands * down * across * th * tw, start).reshape(bands, down, across, th, tw).transpose(0, 1, 3, 2, 4).reshape(bands, down * th, across * tw)[:, :lines, :cols]
    else:
        x = np.frombuffer(raw, kind, bands * lines * cols, start).reshape(bands, lines, cols)
    x = x.astype(float)
    if kind.kind == "f":
        x = np.where(x < CUBE_LEAST, np.nan, x)
    return x * float(get("Pixels.Multiplier", 1)) + float(get("Pixels.Base", 0))


SCHEMA = CELLS
_cells = plane_rows


def read_cubes(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the cubes among the files; others are passed over."""

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, raw in zip(part.path, part.content):
                if kind_of(bytes(raw[:65536])) == "cube":
                    yield from _cells(name, cube_samples(bytes(raw)))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, SCHEMA)


def read_xml_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of a folder: each label is joined with the data file that it names, in its own folder."""
    where, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    files = spark.read.format("binaryFile").load(folder).select("path", "content", where.alias("folder"), name.alias("name"))

    @F.pandas_udf("string")
    def named(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: parse_xml_label(bytes(b).decode())["file"])

    labels = files.where(F.lower("name").endswith(".xml")).select("path", "folder", F.col("content").alias("label"), named("content").alias("name"))
    data = files.where(~F.lower("name").endswith(".xml")).select("folder", "name", "content")

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, label, raw in zip(part.path, part.label, part.content):
                yield from _cells(name, xml_samples(bytes(raw), parse_xml_label(bytes(label).decode())))

    return labels.join(data, ["folder", "name"]).select("path", "label", "content").mapInPandas(cells, SCHEMA)


def encode_cubes(cells: DataFrame, by: str = "tile", value: str = "value") -> DataFrame:
    """by, content: one attached band-sequential cube of float32 for each key; nulls become the special value.

    A cube is one task's; write the rows with any binary sink.
    """

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        lines, cols, bands = pdf.row.max() + 1, pdf.col.max() + 1, pdf.band.max()
        x = np.full((bands, lines, cols), np.float32(-3.4028226550889045e38), "<f4")
        ok = pdf[value].notna().to_numpy()
        x[pdf.band[ok] - 1, pdf.row[ok], pdf.col[ok]] = pdf[value][ok]
        head = f"Object = IsisCube\n  Object = Core\n    StartByte = 4097\n    Format = BandSequential\n    Group = Dimensions\n      Samples = {cols}\n      Lines = {lines}\n      Bands = {bands}\n    End_Group\n    Group = Pixels\n      Type = Real\n      ByteOrder = Lsb\n      Base = 0.0\n      Multiplier = 1.0\n    End_Group\n  End_Object\nEnd_Object\nEnd\n"
        return pd.DataFrame({by: [pdf[by].iloc[0]], "content": [head.encode().ljust(4096, b"\0") + x.tobytes()]})

    return cells.groupBy(by).applyInPandas(encode, f"{by} {cells.schema[by].dataType.simpleString()}, content binary")
