"""Text of images through a provider of the user's: each distinct image once, results back to every row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First bytes of image files and the suffixes they stand for.
SIGNATURES = ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpg"), (b"BM", "bmp"), (b"II*\x00", "tiff"), (b"MM\x00*", "tiff"), (b"GIF8", "gif"))


@dataclass(frozen=True)
class OcrResult:
    """``status`` is ok, empty or error; scores are of the words of the text, 0 to 1."""

    status: str
    text: str = ""
    scores: tuple[tuple[str, float], ...] = ()

    @property
    def confidence(self) -> float | None:
        """The scores' mean, each weighted by its word's characters other than white space; invalid scores don't count."""
        fine = [(len("".join(w.split())), s) for w, s in self.scores if 0 <= s <= 1]
        total = sum(n for n, _ in fine)
        return sum(n * s for n, s in fine) / total if total else None


def weighted_mean(score: Column, text: Column) -> Column:
    """An aggregate: the mean of scores, each weighted by its text's characters other than white space; scores outside 0 to 1 don't count."""
    weight = F.when(score.between(0, 1), F.length(F.regexp_replace(text, r"\s", "")).cast("long"))
    return F.sum(score * weight).cast("double") / F.sum(weight)


def image_suffix(data: bytes) -> str | None:
    return next((suffix for mark, suffix in SIGNATURES if data.startswith(mark)), None)


def recognise(images: DataFrame, provider: Callable[[], Callable[[bytes], OcrResult]]) -> DataFrame:
    """Columns of ``images`` (with ``content``), and ocr_status, ocr_text, ocr_confidence.

    ``provider`` is called once in each task and gives the function that reads an
    image. What it raises becomes the status error with the message as text. A
    null image has null results.
    """
    schema = "ocr_key string, ocr_status string, ocr_text string, ocr_confidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = provider()
        for b in batches:
            rows = []
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    r = read(data)
                except Exception as e:  # noqa: BLE001  one image must not end the others
                    r = OcrResult("error", str(e))
                rows.append((key, r.status, r.text, r.confidence))
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    keyed = images.withColumn("ocr_key", F.sha2("content", 256))
    distinct = keyed.where("content is not null").select("ocr_key", "content").dropDuplicates(["ocr_key"])
    return keyed.join(distinct.mapInArrow(run, schema), "ocr_key", "left").select(*images.columns, "ocr_status", "ocr_text", "ocr_confidence")


# ---------------------------------------------------------------- providers


def tesseract(program: str = "tesseract", languages: str = "eng", timeout: float = 120.0, least: float = 0.6) -> Callable[[], Callable[[bytes], OcrResult]]:
    """A provider that runs the Tesseract program on each image: text, and word scores from its table. ``least``: mean score under which text is doubtful."""

    def provider() -> Callable[[bytes], OcrResult]:
        import os
        import shutil
        import subprocess
        import tempfile

        if shutil.which(program) is None:
            raise FileNotFoundError(program)

        def read(data: bytes) -> OcrResult:
            with tempfile.TemporaryDirectory() as folder:
                image = os.path.join(folder, "image." + (image_suffix(data) or "png"))
                with open(image, "wb") as file:
                    file.write(data)
                subprocess.run([program, image, os.path.join(folder, "out"), "-l", languages, "txt", "tsv"], check=True, capture_output=True, timeout=timeout)
                with open(os.path.join(folder, "out.txt"), encoding="utf-8") as file:
                    text = file.read().strip()
                with open(os.path.join(folder, "out.tsv"), encoding="utf-8") as file:
                    scores = word_scores(file.read())
            return OcrResult("ok" if text else "empty", text, scores)

        return read

    return provider


def word_scores(table: str) -> tuple[tuple[str, float], ...]:
    """(word, score 0 to 1) of a tab-separated result table; rows without a word or with a score below 0 don't count."""
    lines = table.splitlines()
    if not lines:
        return ()
    names = lines[0].split("\t")
    if "conf" not in names or "text" not in names:
        return ()
    out = []
    for line in lines[1:]:
        parts = line.split("\t")
        try:
            score = float(parts[names.index("conf")])
        except (ValueError, IndexError):
            continue
        word = parts[names.index("text")].strip() if len(parts) > names.index("text") else ""
        if word and score >= 0:
            out.append((word, score / 100))
    return tuple(out)


def easyocr(languages: list[str]) -> Callable[[], Callable[[bytes], OcrResult]]:
    """A provider by the EasyOCR library, where it is installed."""

    def provider() -> Callable[[bytes], OcrResult]:
        import easyocr as library  # optional

        reader = library.Reader(languages, gpu=False)

        def read(data: bytes) -> OcrResult:
            found = reader.readtext(data)
            return OcrResult("ok" if found else "empty", "\n".join(t for _, t, _ in found), tuple((t, float(s)) for _, t, s in found))

        return read

    return provider


def remote(submit: Callable[[bytes], str], poll: Callable[[str], dict | None], tries: int = 60, pause: float = 2.0) -> Callable[[], Callable[[bytes], OcrResult]]:
    """A provider by a service: ``submit`` gives a job's id, ``poll`` its result (text, scores) once there is one. After ``tries`` polls the image is an error."""

    def provider() -> Callable[[bytes], OcrResult]:
        import time

        def read(data: bytes) -> OcrResult:
            job = submit(data)
            for _ in range(tries):
                found = poll(job)
                if found is not None:
                    return OcrResult("ok" if found.get("text") else "empty", found.get("text", ""), tuple(found.get("scores", ())))
                time.sleep(pause)
            return OcrResult("error", "no result in time")

        return read

    return provider


def recognise_shown(objects: DataFrame, parts: DataFrame, provider: Callable[[], Callable[[bytes], OcrResult]], most_bytes: int = 64 << 20) -> DataFrame:
    """Recognises only the images that a reading shows (doc_id, target), each once; those above ``most_bytes`` are an error, not read.

    The choice is made before the provider is reached, so that no other image is.
    """
    shown = objects.where("target is not null").select("doc_id", "target").distinct()
    held = shown.join(parts.select("doc_id", F.col("name").alias("target"), "size", "content"), ["doc_id", "target"])
    fine = recognise(held.where(F.col("size") <= most_bytes), provider)
    large = held.where(F.col("size") > most_bytes).select("*", F.lit("error").alias("ocr_status"), F.lit("the image is too large").alias("ocr_text"), F.lit(None).cast("double").alias("ocr_confidence"))
    return fine.union(large).drop("content")
