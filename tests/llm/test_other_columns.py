"""Further columns whose names operators use themselves change nothing."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, filter_audit, periodic_runs, quality_rules, recompression, secrets, suffix_array

NAMES = ["row", "key", "number", "bucket", "own", "check", "places", "checks", "runs", "kept", "found", "segments", "counts", "spans", "sha", "mask", "part", "n", "ids", "decoded", "block", "kind"]

SHARED = " ".join(f"shared{i}" for i in range(70))
DOCS = [(1, f"first {SHARED} one"), (2, f"second {SHARED} two"), (2, "token = abcdefghijklmnop"), (3, None), (None, "a b " * 40), (4, "")]


@pytest.fixture(scope="module")
def frames(spark):
    plain = spark.createDataFrame([(i, t, "en") for i, t in DOCS], "doc_id long, text string, lang string").repartition(2)
    other = plain.select(*[F.lit(k).alias(n) if k % 2 else F.lit(f"x{k}").alias(n) for k, n in enumerate(NAMES)], "*")
    return plain, other


@pytest.mark.parametrize(
    "work",
    [
        lambda d: secrets.digest(secrets.find_secrets(d)),
        lambda d: recompression.remove_repeats(d).select("doc_id", "n_words", "n_removed", "kept"),
        lambda d: suffix_array.remove_repeats(d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept"),
        lambda d: quality_rules.digest(quality_rules.judge(d)),
        lambda d: bpe.tokenize(d, public_tokenizers.path("byte_bpe_50k.json")),
        lambda d: filter_audit.masks(d),
        lambda d: periodic_runs.runs(d, double=True),
    ],
    ids=["secrets", "recompression", "suffix_array", "quality_rules", "bpe", "filter_audit", "periodic_runs"],
)
def test_same_rows(frames, work):
    one, two = (sorted((tuple(r) for r in work(d).collect()), key=str) for d in frames)
    assert one == two and len(one) == len(DOCS)
