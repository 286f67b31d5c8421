"""Images with keyword labels, attached or detached, and raw sample planes.

Files are read with the binaryFile source and parsed where they lie, one task a file; a label is a
map of dotted keys, an image becomes cells (row, col, band, value).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed sample types of labels: (numpy kind, byte order).
SAMPLE_TYPES = {
    "UNSIGNED_INTEGER": ("u", ">"), "MSB_UNSIGNED_INTEGER": ("u", ">"), "LSB_UNSIGNED_INTEGER": ("u", "<"), "PC_UNSIGNED_INTEGER": ("u", "<"),
    "INTEGER": ("i", ">"), "MSB_INTEGER": ("i", ">"), "LSB_INTEGER": ("i", "<"), "PC_INTEGER": ("i", "<"),
    "REAL": ("f", ">"), "IEEE_REAL": ("f", ">"), "PC_REAL": ("f", "<"), "VAX_REAL": ("v", "<"),
}


def parse_label(text: str) -> dict[str, str]:
    """Dotted keys -> values of a keyword label; units stay in angle brackets, quotes go."""
    text = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
    out, path = {}, []
    statements = re.findall(r"^[ \t]*(\^?[A-Za-z][\w:]*)[ \t]*(?:=\s*(\"[^\"]*\"|\([^)]*\)|\{[^}]*\}|[^\r\n]*))?", text, flags=re.M)
    for key, value in statements:
        up, value = key.upper(), value.strip()
        if up in ("OBJECT", "GROUP"):
            path.append(value)
        elif up in ("END_OBJECT", "END_GROUP"):
            if path:
                path.pop()
        elif up == "END":
            break
        elif value:
            out[".".join([*path, up])] = re.sub(r"\s+", " ", value.strip('"').strip())
    return out


def vax_to_ieee(raw: np.ndarray) -> np.ndarray:
    """Little-endian 32-bit words in the VAX F layout to doubles."""
    w = raw.view("<u2").reshape(-1, 2).astype(np.int64)
    sign, exponent, fraction = w[:, 0] >> 15, (w[:, 0] >> 7) & 0xFF, ((w[:, 0] & 0x7F) << 16) | w[:, 1]
    value = np.ldexp(0.5 + fraction / 2.0**24, (exponent - 128).astype(int))
    return np.where(exponent == 0, 0.0, np.where(sign == 1, -value, value))


def samples(raw: bytes, label: dict[str, str], object_: str = "IMAGE") -> np.ndarray:
    """bands x lines x samples as doubles, scaled; special values become NaN."""
    get = lambda k, d=None: label.get(f"{object_}.{k}", d)
    lines, cols, bands = int(get("LINES")), int(get("LINE_SAMPLES")), int(get("BANDS", 1))
    bits = int(get("SAMPLE_BITS"))
    kind, order = SAMPLE_TYPES[get("SAMPLE_TYPE").upper()]
    at = label.get(f"^{object_}", "1")
    number = int(re.search(r"\d+", at.split(",")[-1])[0])
    start = number - 1 if "BYTES" in at.upper() else (number - 1) * int(label.get("RECORD_BYTES", 1))
    n, prefix, suffix = lines * cols * bands, int(get("LINE_PREFIX_BYTES", 0)), int(get("LINE_SUFFIX_BYTES", 0))
    size = bits // 8
    storage = get("BAND_STORAGE_TYPE", "BAND_SEQUENTIAL").upper()
    width = cols * size * (bands if storage == "SAMPLE_INTERLEAVED" else 1)
    rows = n * size // width
    block = np.frombuffer(raw, np.uint8, rows * (width + prefix + suffix), start).reshape(rows, -1)[:, prefix : prefix + width]
    flat = np.ascontiguousarray(block).ravel()
    x = vax_to_ieee(flat) if kind == "v" else flat.view(np.dtype(f"{order}{kind}{size}")).astype(float)
    if storage == "LINE_INTERLEAVED":
        x = x.reshape(lines, bands, cols).transpose(1, 0, 2)
    elif storage == "SAMPLE_INTERLEAVED":
        x = x.reshape(lines, cols, bands).transpose(2, 0, 1)
    else:
        x = x.reshape(bands, lines, cols)
    missing = [float(re.sub(r"<.*?>", "", get(k))) for k in ("MISSING_CONSTANT", "NULL", "CORE_NULL") if get(k) and re.match(r"[-+.\d]", get(k))]
    x = np.where(np.isin(x, missing), np.nan, x)
    return x * float(get("SCALING_FACTOR", 1.0)) + float(get("OFFSET", 0.0))


#: The statement that ends a label, on a line of its own.
_END = re.compile(rb"(?:^|\n)[ \t]*END[ \t]*(?:\r|\n|$)")


def label_of(raw: bytes) -> dict[str, str]:
    """The label at the head of a file, whatever its length."""
    end = _END.search(raw)
    return parse_label(raw[: end.start()].decode("latin-1") if end else raw.decode("latin-1"))


def data_file(label: dict[str, str], object_: str = "IMAGE") -> str | None:
    """The file that a detached label points to; None where the data are attached."""
    at = label.get(f"^{object_}", "")
    named = re.search(r'"([^"]+)"|\(\s*([^,"\s]+\.[^,"\s]+)|^([^,"(\s]+\.[A-Za-z0-9]+)$', at)
    return next((g for g in named.groups() if g), None) if named else None


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """path and label (map of dotted keys) of every file."""

    @F.pandas_udf("map<string,string>")
    def parse(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: label_of(bytes(b)))

    return spark.read.format("binaryFile").load(path).select("path", parse("content").alias("label"))


def plane_rows(name: str, x: np.ndarray, scale: float = 1.0, strip: int = 256) -> Iterator[pd.DataFrame]:
    """Cells (path, row, col, band, value) of bands x lines x samples, a strip at a time; NaN becomes null."""
    for b, plane in enumerate(x, 1):
        for start in range(0, plane.shape[0], strip):
            part = plane[start : start + strip]
            r, c = np.indices(part.shape)
            v = part.ravel() * scale
            yield pd.DataFrame({"path": name, "row": (r.ravel() + start).astype("int32"), "col": c.ravel().astype("int32"), "band": np.int32(b), "value": pd.array(np.where(np.isnan(v), None, v), dtype="Float64")})


CELLS = "path string, row int, col int, band int, value double"


def read_images(spark: SparkSession, path: str, object_: str = "IMAGE", scale: float = 1.0) -> DataFrame:
    """path, row, col, band (from 1), value of images with attached or detached labels; null for special values.

    A detached label names its data file, which is looked for in the label's own folder among the files of path; the
    path is the label's.  Labels are read in whole.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    folder, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lower(F.regexp_extract("path", r"([^/]*)$", 1))

    @F.pandas_udf("string")
    def points_to(raw: pd.Series) -> pd.Series:
        def find(b: bytes) -> str | None:
            label = label_of(bytes(b)) if b"=" in bytes(b[:4096]) else {}
            # a file without this object is data of another's label
            return None if f"^{object_}" not in label else (data_file(label, object_) or "").lower()

        return raw.map(find)

    marked = files.withColumn("to", points_to("content"))
    data = files.select(folder.alias("folder"), name.alias("to"), F.col("content").alias("data"))
    apart = marked.where("to != ''").withColumn("folder", folder).join(data, ["folder", "to"]).select("path", "content", "data")

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for label_path, head, raw in zip(part.path, part.content, part.data):
                head = bytes(head)
                label = label_of(head)
                if raw is not None:  # counted from the start of the data file
                    at = re.findall(r"\d+[^\d]*$", re.sub(r'"[^"]*"|[^,(\s]+\.[A-Za-z]\w*', "", label[f"^{object_}"]))
                    label = {**label, f"^{object_}": at[0] if at else "1"}
                yield from plane_rows(label_path, samples(bytes(raw) if raw is not None else head, label, object_), scale)

    whole = marked.where("to = ''").select("path", "content", F.lit(None).cast("binary").alias("data"))
    return whole.union(apart).mapInPandas(cells, CELLS)


def kind_of(head: bytes) -> str:
    """'label' (keyword), 'xml', 'cube' or 'unknown', by the first bytes of a file."""
    text = head[:65536].lstrip(b"\xef\xbb\xbf \t\r\n")
    if text.startswith(b"<?xml") or text.startswith(b"<Product"):
        return "xml"
    if re.match(rb"(?i)object\s*=\s*isiscube", text):
        return "cube"
    return "label" if re.match(rb"(?:/\*.*?\*/\s*)?[A-Za-z^][\w:]*\s*=", text, re.S) else "unknown"


def read_any(spark: SparkSession, folder: str, scale: float = 1.0) -> DataFrame:
    """Cells of all images of a folder, whatever their format: each file's first bytes decide which reader takes it."""
    from .xml_images import read_cubes, read_xml_images

    files = spark.read.format("binaryFile").load(folder)

    @F.pandas_udf("string")
    def kind(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: kind_of(bytes(b)))

    found = files.select("path", kind("content").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"), F.min("path").alias("path")).collect()  # one row a format
    kinds = {r["kind"] for r in found}
    out = spark.createDataFrame([], CELLS)
    if "label" in kinds:
        out = out.union(read_images(spark, folder))
    if "cube" in kinds:
        out = out.union(read_cubes(spark, folder))
    if "xml" in kinds:
        out = out.union(read_xml_images(spark, folder))
    return out.withColumn("value", F.col("value") * scale)


def write_label(values: dict[str, object]) -> str:
    """A keyword label of flat and dotted keys."""
    lines, groups = [], {}
    for k, v in values.items():
        head, _, rest = k.rpartition(".")
        if head:
            groups.setdefault(head, []).append((rest, v))
        else:
            lines.append(f"{k} = {v}")
    for g, items in groups.items():
        lines += [f"OBJECT = {g}", *[f"  {k} = {v}" for k, v in items], f"END_OBJECT = {g}"]
    return "\r\n".join([*lines, "END"]) + "\r\n"
