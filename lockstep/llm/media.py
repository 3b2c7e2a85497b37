"""Interleaved documents: text and media in order, payloads resolved by digest."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored, text_slices

ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
TILE = 576
#: A sample image: binary greymap, 24 samples a row, 8 bits each.
ROW = 24


class _Sequence(HTMLParser):
    """Collects text runs and media references in reading order.

    Open figures are a stack: each has its own media and its own caption, wherever that stands in it, and hands it on when it
    closes. A caption outside any figure is text. Nothing is read inside hidden elements.
    """

    BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article figure figcaption blockquote pre hr".split())
    HIDDEN = frozenset("script style noscript template".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden = 0
        self.figures: list[dict] = []
        self.captions: list[tuple[dict, list[str]]] = []

    def end_run(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def end_caption(self) -> None:
        figure, parts = self.captions.pop()
        figure["caption"] = figure["caption"] or " ".join("".join(parts).split())

    def end_figure(self) -> None:
        while self.captions and self.captions[-1][0] is self.figures[-1]:
            self.end_caption()
        figure = self.figures.pop()
        for item in figure["media"]:
            item["caption"] = figure["caption"] or item["caption"]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        if tag in self.BREAKS and not self.captions:
            self.end_run()
        if tag == "figure":
            self.end_run()
            self.figures.append({"media": [], "caption": ""})
        elif tag == "figcaption" and self.figures:
            self.end_run()
            self.captions.append((self.figures[-1], []))
        elif tag in ("img", "video", "audio", "source", "embed"):
            found = dict(attrs)
            if found.get("src"):
                self.end_run()
                self.items.append({"position": len(self.items), "kind": "media", "text": None, "ref": found["src"], "caption": found.get("alt") or found.get("title")})
                if self.figures:
                    self.figures[-1]["media"].append(self.items[-1])
        elif tag in self.BREAKS and self.captions:
            self.captions[-1][1].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag == "figcaption" and self.captions:
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_run()
            self.end_figure()
        elif tag in self.BREAKS and not self.captions:
            self.end_run()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.captions[-1][1] if self.captions else self.run).append(data)

    def finish(self) -> None:
        self.end_run()
        while self.figures:
            self.end_figure()


def parse_sequence(page: str | None) -> list[dict]:
    """Ordered text and media-reference items of one page; none for null or empty."""
    parser = _Sequence()
    parser.feed(page or "")
    parser.close()
    parser.finish()
    return parser.items


def interleaved(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` without their HTML, with ``items``: ordered structs (position, kind, text, ref, caption).

    A figure's caption goes to the media that are its own; else an alternative text or title serves. Hidden elements
    (scripts, styles, templates and what stands in for scripts) are left out, media in them too. Very long pages are read by themselves. Null, empty or broken HTML gives what can be read of it, if only an empty array.
    """
    keep = [c for c in pages.columns if c not in (html_column, "items")]
    schema = pages.select(*keep, F.lit(None).cast(f"array<{ITEM}>").alias("items")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for part in (p for batch in batches for p in text_slices(batch, html_column, 4 << 20)):
            items = pa.array([parse_sequence(x) for x in part.column(html_column).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), items], names=[*keep, "items"])

    return pages.select(*keep, html_column).mapInArrow(run, schema)


def resolve(sequences: DataFrame, media: DataFrame, *key: str) -> DataFrame:
    """One row for each item of ``sequences``, in position, media items with the columns of ``media``.

    References read ``sha256:<digest>``. Of several rows of ``media`` with one ``digest``, which should agree, one is taken, so that no item
    is multiplied. The join moves the items,
    not the texts' sequences; a digest that many documents share is a hot key, which adaptive
    execution splits. Items whose digest is unknown keep nulls, so that positions stay whole.
    """
    return _resolved(sequences, media.dropDuplicates(["digest"]), *key)


def _resolved(sequences: DataFrame, media: DataFrame, *key: str) -> DataFrame:
    items = sequences.select(*key, F.explode("items").alias("item")).select(*key, "item.*")
    return items.withColumn("digest", F.regexp_extract("ref", r"^sha256:([0-9a-f]{64})$", 1)).join(media, "digest", "left")


def payload(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none), filled up with bytes 255 to a positive multiple of 576."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    whole = F.greatest(F.lit(TILE), F.ceil(n / F.lit(TILE)) * TILE).cast("int")
    return F.concat(raw, F.unhex(F.repeat(F.lit("FF"), whole - n)))


def greymap(samples: Column) -> Column:
    """Samples as a binary greymap file (P5): 24 columns, 8 bits, nothing compressed."""
    rows = (F.octet_length(samples) / ROW).cast("int")
    return F.concat(F.encode(F.concat(F.lit(f"P5\n{ROW} "), rows.cast("string"), F.lit("\n255\n")), "UTF-8"), samples)


def samples_of(stored_form: bytes) -> bytes:
    """The samples of a greymap file, checked against its header."""
    magic, size, depth, samples = stored_form.split(b"\n", 3)
    width, rows = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * rows:
        raise ValueError("not a whole 8-bit greymap")
    return samples


def sample_features(samples: bytes) -> str:
    """Mean, deviation and edge strength of the samples, and a 64-bit hash of block means against their median."""
    x = np.frombuffer(samples, np.uint8)
    counts, values = np.bincount(x, minlength=256), np.arange(256, dtype=np.int64)
    mean, squares = int((counts * values).sum()) / len(x), int((counts * values**2).sum())
    deviation = max(0.0, squares / len(x) - mean * mean) ** 0.5
    edges = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64)) / max(1, len(x) - 1)
    blocks = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64)
    hashed = int.from_bytes(np.packbits(blocks > np.median(blocks)).tobytes(), "big")
    return f"mean={mean:.4f};sd={deviation:.4f};edge={edges:.4f};hash={hashed:016x}"


def media_features(media: DataFrame) -> DataFrame:
    """Reads stored greymaps (digest, media) and gives a row for each: digest, samples' and file's digests, sizes, feature."""
    import hashlib
    import zlib

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        rows = []
        for digest, form in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
            samples = samples_of(form)
            rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(form), hashlib.sha256(form).hexdigest(), sample_features(samples)))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)]

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(media.select("digest", "media"), schema, run)


def document_media(docs: DataFrame) -> DataFrame:
    """Each document as an interleaved sequence whose payload is its text as a greymap.

    The forms are stored once for each row, keyed by digest, and read back; a page per document refers to
    its form with a caption, is parsed, and its item meets by digest what was computed from the stored bytes.
    Returns doc_id, n_bytes, position, caption, digest and the columns of ``media_features``.

    A null text counts as empty. Equal texts give equal forms; a digest is one row before the join. Repeated
    rows come out as often; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    formed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), greymap(payload(text)).alias("media"))
    kept = stored(formed.select("doc_id", "n_bytes", F.sha2("media", 256).alias("digest"), "media"), "zstd")
    caption = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")))
    page = F.concat(F.lit("<article><h1>"), caption, F.lit("</h1><figure><img src='sha256:"), F.col("digest"), F.lit("'><figcaption>"), caption, F.lit("</figcaption></figure></article>"))
    sequences = interleaved(kept.select("doc_id", "n_bytes", page.alias("html")))
    features = media_features(kept)
    features = stored(features.groupBy("digest").agg(*[F.first(c).alias(c) for c in features.columns if c != "digest"]))
    return _resolved(sequences, features, "doc_id", "n_bytes").where("kind = 'media'")
