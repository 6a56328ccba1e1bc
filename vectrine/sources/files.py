"""File sources: text and Markdown, Office documents, vector files, synthetic clusters, JSON rows."""

from __future__ import annotations

import codecs
import io
import json
import zipfile
from datetime import datetime
from uuid import UUID
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.functions.text import chunk_id, content_hash, document_id, normalize_text
from vectrine.operators.chunking import ChunkOptions, chunk
from vectrine.schema import DomainError, check, kind_of

FORMATS = {".txt": "text", ".md": "text", ".markdown": "text", ".docx": "docx", ".pptx": "pptx"}
SECTION = "array<struct<sequence:int,location:string,heading:string,text:string>>"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def decode_text(data: bytes) -> str:
    """UTF-8, or what a byte order mark says."""
    for bom, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(bom):
            return data[len(bom) :].decode(name, "replace")
    return data.decode("utf-8", "replace")


def _sections(parts: list[tuple[str, str | None, str]]) -> list[dict]:
    return [{"sequence": i, "location": a, "heading": h, "text": t} for i, (a, h, t) in enumerate(parts)]


def text_sections(data: bytes) -> list[dict]:
    text = decode_text(data)
    return _sections([("Document", None, text)]) if text.strip() else []


def docx_sections(data: bytes) -> list[dict]:
    """A section a heading; its text begins with the heading."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    parts: list[list] = []
    for p in body.iter(f"{W}p"):
        text = "".join(t.text or "" if t.tag == f"{W}t" else "\t" if t.tag == f"{W}tab" else "\n" for t in p.iter() if t.tag in (f"{W}t", f"{W}tab", f"{W}br")).strip()
        style = p.find(f"{W}pPr/{W}pStyle")
        name = (style.get(f"{W}val") or "") if style is not None else ""
        if not text:
            continue
        if name.lower().startswith(("heading", "titre")) or not parts:
            heading = text if name.lower().startswith(("heading", "titre")) else None
            parts.append([f"Section {len(parts) + 1}", heading, [text]])
        else:
            parts[-1][2].append(text)
    return _sections([(a, h, "\n\n".join(t)) for a, h, t in parts])


def pptx_sections(data: bytes) -> list[dict]:
    """A section a slide; its first paragraph is the heading."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=lambda n: int("".join(c for c in n.rsplit("/", 1)[1] if c.isdigit()) or 0))
        for i, n in enumerate(names):
            lines = ["".join(t.text or "" for t in p.iter(f"{A}t")).strip() for p in ElementTree.fromstring(z.read(n)).iter(f"{A}p")]
            if lines := [x for x in lines if x]:
                out.append((f"Slide {i + 1}", lines[0], "\n".join(lines)))
    return _sections(out)


EXTRACTORS = {"text": text_sections, "docx": docx_sections, "pptx": pptx_sections}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, format) of a folder or glob, by extension or, without a known one, by content: an archive with the
    parts of a format, or text. Raises ``unsupported_document_format`` when another file is read."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    body = F.decode("content", "ISO-8859-1")
    archive = body.startswith("PK\x03\x04")
    sniffed = F.when(archive & body.contains("word/document.xml"), "docx").when(archive & body.contains("ppt/slides/"), "pptx").when((ext == "") & ~archive & ~body.contains("\x00"), "text")
    kind = F.coalesce(*[F.when(ext == e, F.lit(f)) for e, f in FORMATS.items()], sniffed, F.raise_error(F.concat(F.lit("unsupported_document_format: "), F.col("path"))))
    return rows.withColumn("format", kind)


def extract(files: DataFrame) -> DataFrame:
    """``files`` (path, content, format) with ``sections``."""

    @F.pandas_udf(SECTION)
    def run(data: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([EXTRACTORS[k](bytes(d)) for d, k in zip(data, kind)])

    return files.withColumn("sections", run("content", "format"))


def ingest(spark: SparkSession, path: str, dimension: int = 384, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Rows to upsert, one a chunk: id, text, vector and the fields of the chunk."""
    from vectrine.operators.embedding import embed

    files = extract(read_documents(spark, path)).withColumn("content_sha256", content_hash(F.col("content"))).drop("content")
    clean = files.withColumn("sections", F.transform("sections", lambda s: F.struct(s["sequence"].alias("sequence"), s["location"].alias("location"), s["heading"].alias("heading"), normalize_text(s["text"]).alias("text"))))
    rows = chunk(clean, options).withColumn("document_id", document_id(F.col("path"), F.col("content_sha256")))
    rows = rows.withColumn("id", chunk_id(F.col("document_id"), F.col("sequence")))
    return rows.withColumn("vector", embed(F.col("text"), dimension))


def stale_chunks(current: DataFrame, new: DataFrame) -> DataFrame:
    """(id) of chunks of the same documents that the new extraction hasn't got."""
    return current.join(new.select("document_id").distinct(), "document_id", "left_semi").join(new.select("id"), "id", "left_anti").select("id")


# Vector files


def read_vecs(spark: SparkSession, path: str) -> DataFrame:
    """(position, vector) of .fvecs (floats) or (position, ids) of .ivecs: rows of a count and so many values.
    A file is one task's; large sets come in several files."""
    ints = path.endswith(".ivecs")
    name, kind = ("ids", "array<int>") if ints else ("vector", "array<float>")

    def run(batches):
        for pdf in batches:
            for data in pdf.content:
                raw = np.frombuffer(data, np.int32)
                check(not len(raw) or len(raw) % (raw[0] + 1) == 0 and raw[0] > 0, "invalid_vector_file")
                rows = raw.reshape(-1, raw[0] + 1) if len(raw) else raw.reshape(0, 1)
                values = rows[:, 1:] if ints else rows[:, 1:].copy().view(np.float32)
                yield pd.DataFrame({"position": range(len(rows)), name: list(values)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"position bigint, {name} {kind}")


def write_vecs(vectors: np.ndarray) -> bytes:
    v = np.ascontiguousarray(vectors, np.float32 if vectors.dtype.kind == "f" else np.int32)
    return np.concatenate([np.full((len(v), 1), v.shape[1], np.int32), v.view(np.int32)], axis=1).tobytes()


def synthetic(spark: SparkSession, n: int, dimension: int, clusters: int = 32, seed: int = 20260719, skew: float = 0.8) -> DataFrame:
    """(id, cluster, vector): seeded Gaussian clusters of skewed sizes, made where they are used."""
    centers = np.random.default_rng(seed).normal(size=(clusters, dimension))
    share = np.arange(1, clusters + 1) ** -skew
    edges = np.cumsum(share / share.sum())

    @F.pandas_udf("cluster int, vector array<float>")
    def make(ids: pd.Series) -> pd.DataFrame:
        own = [np.random.default_rng([seed, int(i)]) for i in ids]
        c = [min(int(np.searchsorted(edges, r.random())), clusters - 1) for r in own]
        return pd.DataFrame({"cluster": c, "vector": [(centers[k] + 0.2 * r.normal(size=dimension)).astype(np.float32) for k, r in zip(c, own)]})

    return spark.range(n).select("id", make("id").alias("m")).select("id", "m.*")


# JSON rows


def value_from_json(x: object) -> object:
    """A metadata value of its JSON form; {"$date": ...} and {"$guid": ...} are tagged."""
    if isinstance(x, dict):
        check(len(x) == 1 and set(x) <= {"$date", "$guid"}, "invalid_metadata")
        key, v = next(iter(x.items()))
        try:
            return datetime.fromisoformat(v.replace("Z", "+00:00")) if key == "$date" else UUID(v)
        except (ValueError, AttributeError) as e:
            raise DomainError("invalid_metadata", str(x)) from e
    kind_of(x)
    return x


def value_to_json(x: object) -> object:
    return {"$date": x.isoformat()} if isinstance(x, datetime) else {"$guid": str(x)} if isinstance(x, UUID) else x


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, vector, metadata) of JSON lines; metadata keeps every field's own kind."""
    rows = spark.read.schema("id string, text string, vector array<float>, metadata string").json(path)
    return rows.withColumn("metadata", meta_from_json(F.col("metadata")))


def meta_from_json(c):
    """MAP<STRING, META> of a JSON object, by the rules of :func:`value_from_json`."""

    @F.pandas_udf("map<string,struct<kind:tinyint,keys:array<string>,nums:array<double>>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else {k: _meta(value_from_json(v)) for k, v in json.loads(t).items()})

    return run(c)


def _meta(value: object) -> dict:
    from datetime import timezone

    from vectrine.schema import EPOCH_TICKS, KINDS

    kind = kind_of(value)
    keys, nums = [], []
    for x in value if isinstance(value, list) else [value]:
        k = kind.removesuffix("_array")
        if k == "datetime":
            at = x if x.tzinfo else x.replace(tzinfo=timezone.utc)
            t = round((at - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1e6) * 10 + EPOCH_TICKS
            keys.append(f"t:{t}")
            nums.append(float(t))
        elif k in ("integral", "number"):
            keys.append(f"i:{x}" if k == "integral" else f"d:{java_double(float(x))}")
            nums.append(float(x))
        else:
            keys.append({"null": lambda: "n:", "text": lambda: f"s:{x}", "boolean": lambda: f"b:{int(x)}", "identifier": lambda: f"g:{str(x).lower()}"}[k]())
    return {"kind": KINDS.index(kind), "keys": keys, "nums": nums}


def java_double(x: float) -> str:
    """The text that the JVM gives a double, so that keys made here and there are equal."""
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return repr(x) if "e" not in repr(x) else f"{x:f}"
    digits, exponent = f"{x:.17e}".split("e")
    short = repr(x)
    mantissa = short.split("e")[0] if "e" in short else None
    if mantissa is None:
        plain = short.replace("-", "").replace(".", "").lstrip("0").rstrip("0") or "0"
        mantissa = ("-" if x < 0 else "") + plain[0] + "." + (plain[1:] or "0")
    return f"{mantissa if '.' in mantissa else mantissa + '.0'}E{int(exponent)}"
