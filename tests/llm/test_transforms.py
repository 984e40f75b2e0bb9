"""Fill-in-the-middle, piece encoding and whitening against brute force, the library and dense algebra."""

import hashlib
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from labspark.llm import infill, sentencepieces, whitening

PATH = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(seed, n=300):
    rng = random.Random(seed)
    texts = [None, "", " ", "  ", "a<P>b", "<S", "<", "S>", "<M>", "日本 語\n\r\n\x00é😀<S", "plain words <M", "ÿĀÿ", "▁▁a", "a▁b",
             "x" * 3000 + " y", " " * 700, "<s></s><unk><0x41>", "word and é " * 20_000, "\t\n\x0b\r", "ﬁ①Å"]
    texts += ["".join(rng.choice("abcZ <>PSM\né日😀\x00ÿ nt el") for _ in range(rng.randrange(70))) for _ in range(n)]
    return texts + texts[3:9]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i % 290 if i % 41 else None, t, "x", "y", 1) for i, t in enumerate(odd_texts(1))]
    return spark.createDataFrame(rows, "doc_id long, text string, output string, restored string, n int").repartition(5)


# fill in the middle

def brute_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h[3] % 100 < 20 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, "spm" if h[3] % 100 < 20 else "psm", len(prefix), len(middle), out


def test_infill_equals_brute_force_and_is_undone(docs, monkeypatch):
    monkeypatch.setattr(infill, "SLICE_BYTES", 500)
    key = lambda t: tuple(map(str, t))
    found = infill.restored(infill.infill(docs)).collect()
    got = sorted(((r["doc_id"], *tuple(r)[1:6], r["restored"]) for r in found), key=key)
    want = sorted(((r["doc_id"], *brute_infill(r["doc_id"], r["text"]), r["text"] or "") for r in docs.collect()), key=key)
    assert got == want
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    again = infill.restored(infill.restored(infill.infill(docs)).withColumn("_extra", F.lit(1)))
    assert again.columns[-2:] == ["_extra", "restored"] and again.where("restored is null").count() == 0
    assert infill.restored(infill.infill(docs.limit(0))).count() == 0
    other = infill.infill(docs, seed=2).select("form").collect()
    assert [r[0] for r in other] != [r["form"] for r in found]
    assert infill.infill(docs, plain_percent=100).where("form <> 'plain'").count() == 0


def test_infill_holds_little_memory():
    """Arrow memory of the kernels for one-character units, the worst case, in a process of its own: 149 MB with slices of 4 MB."""
    script = """
import pyarrow as pa
from labspark.llm import infill
texts = pa.RecordBatch.from_arrays([pa.array([". " * 1000] * 4000)], ["text"])
for part in infill.text_slices(texts, 0, infill.SLICE_BYTES):
    places = [pa.array([7] * part.num_rows, pa.int64())] * 4
    made = infill.transformed(part.column(0).cast(pa.large_string()), *places, 10, 20)
    assert made[0].to_pylist() == [2000] * part.num_rows
print(pa.default_memory_pool().max_memory())
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=Path(__file__).parents[2])
    assert int(done.stdout) < 40 << 20


# pieces

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts_equal_the_library(docs, library):
    rows = sentencepieces.decode(sentencepieces.encode(docs, PATH), PATH).collect()
    got = sorted((str(r["doc_id"]), tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["n_tokens"], r["decoded"]) for r in rows)
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((str(r["doc_id"]), tuple(ids), len(ids), library.decode(ids)))
    assert got == sorted(want)
    assert sentencepieces.encode(docs.limit(0), PATH).count() == 0


def test_encoder_on_pieces_and_small_memories(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "MOST_REMEMBERED", 50)
    model = sentencepieces.PieceModel(PATH)
    rng = random.Random(7)
    pieces = list(model.scores)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(800)]
    texts += ["".join(rng.choice("abcdehilnorst") for _ in range(rng.randrange(40))) for _ in range(800)]  # needs backtracking
    texts += ["日本語のテキストabc" * 2000]
    for text in texts:
        assert model.encode(text).tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_backtracking_equals_merging():
    model = sentencepieces.PieceModel(PATH)
    rng = random.Random(3)
    for _ in range(600):
        text = "▁" + "".join(rng.choice("aeinorstlh日é") for _ in range(rng.randrange(1, 16)))
        assert model.backtracked(text) == model.merged(text)


def test_any_ids_decode_as_the_library_does(library):
    model = sentencepieces.PieceModel(PATH)
    rng = random.Random(5)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3), rng.randrange(3, 259), rng.randrange(190, 259), rng.randrange(32_000), 259, 29_871])
               for _ in range(rng.randrange(9))]
        assert model.decode(np.array(ids, np.int64)) == library.decode(ids), ids


# whitening

@pytest.mark.parametrize("kind", ["plain", "wide", "flat", "low rank", "steep", "tiny"])
def test_leading_pairs_equal_dense_algebra(kind):
    rng = np.random.default_rng(2)
    matrix = {
        "plain": lambda: np.cov(rng.standard_normal((64, 300))), "wide": lambda: np.cov(rng.standard_normal((300, 900))),
        "flat": lambda: np.diag([5.0] * 20 + [1.0] * 30), "low rank": lambda: (lambda b: b @ b.T)(rng.standard_normal((60, 5))),
        "steep": lambda: np.cov(rng.standard_normal((40, 200)) * np.logspace(0, -6, 40)[:, None]),
        "tiny": lambda: np.cov(rng.standard_normal((3, 50)))}[kind]()
    vectors, values, error = whitening.leading_pairs(lambda v: matrix @ v, len(matrix), 16)
    exact = np.linalg.eigvalsh(matrix)[::-1]
    assert len(values) == {"low rank": 5, "tiny": 3}.get(kind, 16)
    assert np.allclose(values, exact[:len(values)], rtol=1e-9, atol=1e-13 * exact[0])
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-12 * exact[0] and error <= 1e-12
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)


def vectors_table(spark, extra=True):
    rng = np.random.default_rng(4)
    data = rng.standard_normal((400, 24)) * np.linspace(0.4, 0.05, 24) + rng.standard_normal(24)
    rows = [(i, [float(np.float32(x)) for x in v], i % 3, "z") for i, v in enumerate(data)]
    rows += [(400 + i, rows[i][1], 0, None) for i in range(100)]  # copies enter the fit once
    if extra:
        rows += [(600, None, 0, ""), (601, [], 0, ""), (602, [1.0] * 23 + [None], 0, ""), (603, [float("nan")] + [0.0] * 23, 0, ""),
                 (604, [float("inf")] * 24, 0, ""), (605, [1.0, 2.0], 0, ""), (None, rows[5][1], 0, ""), (7, rows[7][1], 0, "")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, x string").repartition(6)


def test_whitening_of_a_table(spark):
    table = vectors_table(spark)
    out = whitening.whitened(table).collect()
    kept = [r for r in table.collect() if r["embedding"] and len(r["embedding"]) == 24
            and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    x = np.floor(np.array([r["embedding"] for r in kept], np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - fit.mean(0)
    values = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    assert len(out) == 16 * len(kept) and {r["component"] for r in out} == set(range(1, 17))
    assert {r["n"] for r in out} == {n}
    deviation = {}
    for r, row in zip(kept, x):
        deviation.setdefault(r["vec_id"], set()).add(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)))
    assert all(int(r["deviation"]) in deviation[r["vec_id"]] for r in out)
    assert all(r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9) for r in out)
    assert len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-9
    white = np.zeros((600, 16))
    for r in out:
        if r["vec_id"] is not None:
            white[r["vec_id"], r["component"] - 1] = r["whitened"]
    first = {tuple(v): r["vec_id"] for v, r in zip(x.tolist(), kept) if r["vec_id"] is not None}
    sample = white[sorted(first.values())]
    assert np.allclose(sample.T @ sample / n, np.eye(16), atol=1e-9)
    assert np.allclose(white[400:500], white[:100])


def test_whitening_of_little(spark):
    table = vectors_table(spark, False)
    assert whitening.whitened(table.limit(0)).count() == 0
    alike = table.where("vec_id = 3").unionByName(table.where("vec_id = 3"))
    assert whitening.whitened(alike).count() == 0
    assert whitening.whitened(table.where("vec_id in (1, 2)")).count() == 2  # two points span one direction
    small = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert whitening.whitened(small).select("component").distinct().count() == 2
    huge = whitening.integer_vectors(spark.createDataFrame([(1, [1e300, -1e300])], "vec_id long, embedding array<double>"), "embedding")
    assert huge.first()["x"][0] > 9e18 and huge.first()["x"][1] < -9e18


def test_deviations_are_exact_beyond_longs():
    x = np.array([[10 ** 12, 0], [0, 5]], np.int64)
    n, sums = 10 ** 7, [3, 4]
    assert whitening.deviations(x, n, sums) == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
