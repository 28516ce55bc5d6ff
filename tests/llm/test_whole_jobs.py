"""Cases in which a bounded search would miss a part of the job."""

import random

from tests.llm.test_corpus_operators import brute_classes
from tidemark.llm import near_dups


def template_family(seed, members=250):
    """One template with a passage of its own in each text; the last two, and only they, are near-duplicates."""
    rng = random.Random(seed)
    base = [f"word{seed}x{i}" for i in range(300)]
    texts = {}
    for i in range(members):
        size, words = (10 if i >= members - 2 else 54), list(base)
        at = (0 if i == members - 2 else 150) if size == 10 else rng.randrange(10, 240)
        words[at : at + size] = [f"own{seed}x{i}x{j}" for j in range(size)]
        texts[i] = " ".join(words)
    return texts


def test_near_duplicates_that_meet_only_in_large_buckets(spark):
    texts = {seed * 1000 + i: t for seed in (13, 14) for i, t in template_family(seed).items()}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(docs).collect()}
    assert got == brute_classes(texts) and got[13249] == 13248 and got[14249] == 14248
