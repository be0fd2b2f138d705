import base64
import random
import re

import pytest
import zstandard

from treeline.llm.quality import LEVEL, MAX_REPEAT_PERCENT, compression_verdict, quality, repeated_words
from treeline.llm.queries import op7_quality_bands


def brute(text):
    text = text or ""
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside, seen = set(), {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    for at in seen.values():
        if len(at) > 1:
            inside.update(i + k for i in at for k in range(5))
    lines, dup, earlier = text.split("\n"), 0, set()
    for line in lines:
        if line.strip(" \t\r\x0b\x0c"):
            dup += line in earlier
            earlier.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n


def test_whole_table(spark, sf_dir):
    docs = dict(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    got = op7_quality_bands(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:7] == brute(docs[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in got) > 0.6 * sum(not r.base_failed for r in got)


def test_bands_reject_repetition_and_noise(spark):
    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(30)) for _ in range(1500))
    loop = " ".join(f"w{i}" for i in range(400))
    loop = "\n".join(loop for _ in range(60))
    clean = " ".join("".join(rng.choice(["the", "of", "er", "in", "tion", "an", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(2000))
    rows = [(1, noise), (2, loop), (3, clean), (4, None), (5, ""), (6, " \n\x0b"), (7, "one"), (7, "one"), (None, clean)]
    docs = spark.createDataFrame([(a, b, True) for a, b in rows], "doc_id long, text string, kept boolean")
    got = {r.doc_id: r for r in quality(spark, docs).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4, 5, 6, 7, None)] == [False, False, True, False, False, False, False, True]
    assert got[4].ratio is None and quality(spark, docs).count() == len(rows)
    assert quality(spark, docs.limit(0)).count() == 0
    assert MAX_REPEAT_PERCENT == 20 and repeated_words(list("abcdeabcde")) == 10 and repeated_words(list("aaaaaa")) == 6


def junk(kind, size):
    rng = random.Random(size)
    if kind == "template":
        return " ".join(f"Item {rng.randrange(1000)} of the list is sold in our shop at the price of {rng.randrange(100)} coins." for _ in range(size // 60 + 1))[:size].encode()
    raw = rng.randbytes(size)
    text = {"base64": base64.b64encode(raw).decode(), "hex": raw.hex(), "letters": "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))}[kind]
    return " ".join(text[i : i + 16] for i in range(0, size, 16))[:size].encode()


@pytest.mark.parametrize(
    "kind, sizes",
    [("base64", (200, 300, 400, 600, 900, 1400, 2000, 4000, 8000, 30000)), ("letters", (1400, 2000, 4000, 8000, 30000)), ("hex", (5000, 8000, 30000)), ("template", (400, 600, 900, 2000, 4000, 8000, 30000))],
)
def test_junk_of_many_sizes_leaves_its_band(kind, sizes):
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    kept = [n for n in sizes if compression_verdict(junk(kind, n), compress)[2]]
    assert not kept


def test_base64_chunks_are_bad():
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    assert compression_verdict(junk("base64", 22000), compress)[1] == 1.0
