"""Scans: directory trees of images, decoded to gray pages, measured in Arrow batches."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels

GLOB = "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG]}"


def read_scans(spark: SparkSession, root: str, excluded: list[str] = ()) -> DataFrame:
    """``path, dir, file, height, width, image`` (row-major gray bytes; null where unreadable) below root, marker and reference images left out."""
    df = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).load(root)
    path = F.col("image.origin")
    out = df.select(path.alias("path"), F.regexp_replace(path, "/[^/]*$", "").alias("dir"), F.element_at(F.split(path, "/"), -1).alias("file"), "image.height", "image.width", "image.nChannels", F.col("image.data").alias("image"))
    if excluded:
        gone = spark.createDataFrame([(x.rpartition("/")[2], "/" + x.lstrip("/")) for x in excluded], "file string, gone string")  # a specification's files, hence few
        out = out.join(F.broadcast(gone).alias("g"), (out["file"] == F.col("g.file")) & out["path"].endswith(F.col("g.gone")), "left_anti")
    return out.withColumn("image", F.when(F.col("height") > 0, F.col("image")))


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    page = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return page[..., 0] if channels == 1 else np.rint(page[..., :3].astype(float) @ [0.114, 0.587, 0.299]).astype(np.uint8)


def load_markers(spark: SparkSession, chain: list[dict], folder: str, width: int) -> list[dict]:
    """The chain with the markers that it names by ``relativePath`` below ``folder``: read, scaled to the page's processing width, blurred, stretched and, unless told not to, without their erosion."""
    out = []
    for step in chain:
        options = dict(step.get("options", {}))
        if step["name"] == "CropOnMarkers" and "marker" not in options:
            name = options.get("relativePath", "omr_marker.jpg")
            try:
                found = read_scans(spark, f"{folder}/{name}").where("image is not null").take(1)  # one small file
            except AnalysisException:  # no such path
                found = []
            if not found:
                raise FileNotFoundError(f"Marker not found at path provided in template: {name}")
            marker = gray(bytes(found[0].image), found[0].height, found[0].width, found[0].nChannels)
            options["marker"] = pixels.prepared_marker(marker, int(width / int(options["sheetToMarkerWidthRatio"])) if "sheetToMarkerWidthRatio" in options else None, options.get("apply_erode_subtract", True)).tolist()
        out.append({**step, "options": options})
    return out


def page_spec(template, width: int, height: int, chain: list[dict] | None = None, turn: int = 0, fit: bool = False) -> dict:
    """What a task needs of a template: the chain of preprocessors, the processing size, the page and its bubbles.

    Pages are turned clockwise by ``turn`` degrees first. With ``fit`` the processing size is a box that each page is scaled down into, unless markers
    place the template, whose page then is the size.
    """
    if fit and any(p["name"] == "CropOnMarkers" for p in template.pre_processors):
        width, height, fit = *template.page, False
    return {"chain": template.pre_processors if chain is None else chain, "bubbles": [(b[1], b[3], b[5], b[6], b[7], b[8]) for b in template.bubbles], "page": template.page, "size": [width, height], "turn": turn, "fit": fit}


def measure_scans(scans: DataFrame, template, width: int | None = None, height: int | None = None, chain: list[dict] | None = None) -> DataFrame:
    """``sheet (path), strip (label), opt, m`` per bubble; pages that cannot be read or prepared give one row with null ``strip``."""
    spec = page_spec(template, width or template.page[0], height or template.page[1], chain)
    return measure_tree(scans.withColumn("template", F.lit("")), {"": spec})


def measure_tree(scans: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """The same for scans whose column ``template`` names one of several specifications: one pass over the images, whatever the number of templates."""
    packed = json.dumps(specs)
    schema = pa.schema([("sheet", pa.string()), ("strip", pa.string()), ("opt", pa.int32()), ("m", pa.float64())])

    def run(batches):
        every = {}
        for name, s in json.loads(packed).items():
            labels, opts, x, y, w, h = (list(v) for v in zip(*s["bubbles"], strict=True))
            every[name] = s, labels, opts, [np.array(v) for v in (x, y, w, h)]
        for batch in batches:
            for path, name, hh, ww, channels, data in zip(*(batch.column(c).to_pylist() for c in ("path", "template", "height", "width", "nChannels", "image")), strict=True):
                s, labels, opts, box = every[name]
                page = None if data is None else pixels.rotated(gray(data, hh, ww, channels), s["turn"])
                if page is not None:
                    size = s["size"]
                    if s["fit"]:
                        share = min(1.0, size[0] / page.shape[1], size[1] / page.shape[0])
                        size = [max(1, round(page.shape[1] * share)), max(1, round(page.shape[0] * share))]
                    page = pixels.preprocessed(page, s["chain"], *size)
                if page is None:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None], pa.string()), pa.array([None], pa.int32()), pa.array([None], pa.float64())], schema=schema)
                    continue
                page = pixels.normalize(pixels.resize(page, *s["page"]))
                m = pixels.rectangle_means(page, *box)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(m)), pa.array(labels), pa.array(opts, pa.int32()), pa.array(m)], schema=schema)

    return scans.select("path", "template", "height", "width", "nChannels", "image").mapInArrow(run, "sheet string, strip string, opt int, m double")


def png(page: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = page.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), page], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def drawn(template, marks: dict[str, str], ink: int = 40, paper: int = 235, faint: int = 215) -> np.ndarray:
    """A synthetic sheet: every bubble faint, the marked ones inked."""
    page = np.full((template.page[1], template.page[0]), paper, np.uint8)
    for _, label, _, _, value, x, y, w, h in template.bubbles:
        page[y : y + h, x : x + w] = ink if value in marks.get(label, "") else faint
    return page
