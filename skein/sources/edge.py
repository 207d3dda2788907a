"""Seams to what lies outside: file parsers, embedding models, extraction models.

Each is a function over Arrow or pandas batches behind a small protocol; an error of one row becomes a row with its status.
The stubs are deterministic and need nothing but the standard library.
"""

from __future__ import annotations

import hashlib
import io
import re
import time
import xml.etree.ElementTree as ElementTree
import zipfile
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARSED = "path string, file_type string, text string, n_images int, status string, error string"
EXTRACTED = "chunk_id string, doc_id string, status string, error string, entities string"
_TEXT = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class Embedder(Protocol):
    size: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Feature hashing of words: the test double of an embedding model."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                row[h % self.size] += 1 if h >> 63 else -1
        return out


def docx_text(content: bytes) -> tuple[str, int]:
    """Paragraphs of a word-processor file, and its number of images."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    paragraphs = ["".join(t.text or "" for t in p.iter(f"{_TEXT}t")) for p in root.iter(f"{_TEXT}p")]
    return "\n".join(p for p in paragraphs if p.strip()), sum(n.startswith("word/media/") for n in names)


def parsed(files: DataFrame, parsers: dict[str, Callable[[bytes], tuple[str, int]]] | None = None) -> DataFrame:
    """Texts of files (path, content) by suffix; a file without a parser, or that fails, is a row with status error."""
    known = {".docx": docx_text} | (parsers or {})

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                kind = "." + path.rsplit(".", 1)[-1].lower()
                try:
                    text, images = known[kind](bytes(content))
                    rows.append((path, kind, text, images, "ok", None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, kind, "", 0, "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    return files.select("path", "content").mapInPandas(run, PARSED)


def needs_ocr(chars: Column, n_pages: Column, mode: str = "auto", least: int = 40) -> Column:
    """Whether to read a file by OCR: few characters a page, or few at all where pages aren't known."""
    if mode != "auto":
        return F.lit(mode == "always")
    return F.when(n_pages > 0, chars / n_pages < least).otherwise(chars < 1000)


def better_source(layer: Column, ocr: Column) -> Column:
    return F.when(F.length(F.coalesce(ocr, F.lit(""))) > F.length(F.coalesce(layer, F.lit(""))), "ocr").otherwise("textlayer")


def embedded(chunks: DataFrame, make: Callable[[], Embedder], batch: int = 64) -> DataFrame:
    """chunks with an embedding; a model is made once for each task."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        model = make()
        for frame in batches:
            texts = frame["text"].fillna("").tolist()
            parts = [model.encode(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            yield frame.assign(embedding=[v.tolist() for part in parts for v in part])

    return chunks.mapInPandas(run, schema)


def extracted(chunks: DataFrame, call: Callable[[str], str], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """A model's reply for each chunk (chunk_id, doc_id, text); a call is tried again after a growing wait."""

    def reply(text: str) -> tuple[str, str | None, str | None]:
        for k in range(tries):
            try:
                return "ok", None, call(text)
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
                if k + 1 < tries:
                    time.sleep(wait * (k + 1))
        return "error", error, None

    def run(batches):
        for frame in batches:
            found = [reply(t or "") for t in frame["text"]]
            yield pd.DataFrame({"chunk_id": frame["chunk_id"], "doc_id": frame["doc_id"], "status": [f[0] for f in found], "error": [f[1] for f in found], "entities": [f[2] for f in found]})

    return chunks.select("chunk_id", "doc_id", "text").mapInPandas(run, EXTRACTED)
