"""Clips of many RIFF parts, and the memory that long texts take."""

import hashlib
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from orbweave.llm import media

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture()
def short_parts(monkeypatch):
    monkeypatch.setattr(media, "PART", 5)
    monkeypatch.setattr(media, "STEP", 2)


@pytest.mark.parametrize("frames", [1, 4, 5, 6, 10, 23])
def test_parts_there_and_back(short_parts, frames):
    payload = np.random.default_rng(frames).integers(0, 256, frames * media.UNIT).astype(np.uint8)
    (blob,) = media.encode([payload])
    assert blob.count(b"AVIX") == -(-frames // 5) - 1 and blob[8:12] == b"AVI "
    at, size, scale, rate = media.frames_of(blob)
    assert len(at) == frames and (scale, rate) == (1, media.FPS)
    assert np.array_equal(media.decode([blob])[0].ravel(), payload)
    assert len(media.clip_histograms(blob)[0]) == frames
    # without the indexes, frames come from the lists
    assert np.array_equal(media.decode([blob.replace(b"idx1", b"JUNK")])[0].ravel(), payload)
    row = media.digest_long(len(payload) - 7, payload)
    assert row[:6] == (len(payload) - 7, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:].tobytes()), len(blob), hashlib.sha256(blob).hexdigest())


def test_files_of_one_part_stay_as_they_are(spark):
    """A short file is the same whichever way it is made, and so is its row."""
    payloads = [np.random.default_rng(k).integers(0, 256, n * media.UNIT).astype(np.uint8) for k, n in enumerate((1, 3, 50))]
    assert media.encode(payloads) == [b"".join(media.encode_parts(p)) for p in payloads]
    text = "Ünïcode and words. " * 40_000  # longer than two steps
    docs = spark.createDataFrame([(1, text), (2, text), (3, "short")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in media.digests(docs).collect()}
    raw = text.encode()
    full = raw + b" " * (-len(raw) % media.UNIT)
    assert rows[1][1:] == rows[2][1:] and rows[1]["n_bytes"] == len(raw) and rows[1]["payload_sha256"] == hashlib.sha256(full).hexdigest()
    clip = media.to_clips(docs).where("doc_id = 1").first()["media"]
    assert hashlib.sha256(bytes(clip)).hexdigest() == rows[1]["media_sha256"] and len(clip) == rows[1]["media_bytes"]


def test_broken_extensions(short_parts):
    payload = np.arange(12 * media.UNIT, dtype=np.uint64).astype(np.uint8)
    (blob,) = media.encode([payload])
    second = blob.index(b"AVIX") - 8
    with pytest.raises((ValueError, IndexError)):
        media.decode([blob[: second + 40]])
    assert len(media.decode([blob[:second] + b"tail of something else"])[0]) == 5


def test_clips_too_large_for_a_value_are_null(spark, monkeypatch):
    monkeypatch.setattr(media, "VALUE", 2000)
    docs = spark.createDataFrame([(1, "x" * 5000), (2, "x")], "doc_id long, text string")
    clips = {r["doc_id"]: r["media"] for r in media.to_clips(docs).collect()}
    assert clips[1] is None and clips[2] is not None


def test_memory_of_a_long_text():
    """64 MB of text in under 500 MB, in a process of its own."""
    code = (
        "import resource, numpy as np\nfrom orbweave.llm import media\nimport pyarrow as pa\n"
        "base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "text = ('All work and no play. ' * 50_000 + '\\u00e9 ') * 58\n"
        "column = pa.array([text]); n = len(text.encode()); del text\n"
        "row = next(media.digest_long(sizes[0], payloads[0]) for _, _, sizes, payloads in media._payloads(column))\n"
        "assert row[0] == n >= 60_000_000 and row[1] % 192 == 0 and row[4] > row[1]\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - 0) // 1024)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout) < 500
