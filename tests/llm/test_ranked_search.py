"""Ranked search against its SQL, a brute-force version, and on awkward tables."""

import collections
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.test_corpus_operators import DATA, awkward
from tidemark.llm import queries, ranked_search

COLUMNS = ("item_id", "rank", "doc_id", "score")


def brute(texts, items, k):
    """(item, rank, doc_id, score) by scoring every document; texts: (doc_id, text), items: (item_id, text)."""
    found = [(d, ranked_search.BYTE_TERM.findall((t or "").encode().lower())) for d, t in texts]
    n_docs, n_terms = sum(1 for _, t in found if t), sum(len(t) for _, t in found)
    df = collections.Counter(t for _, tokens in found for t in set(tokens))
    out = []
    for item, text in items:
        scores = []
        for doc, tokens in found:
            tf, m = collections.Counter(tokens), 50 + (50 * len(tokens) * n_docs) // max(1, n_terms)
            score = sum(ranked_search.term_weight(n_docs, df[t]) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in set(ranked_search.BYTE_TERM.findall((text or "").encode().lower())) if tf[t])
            scores.append((-score, doc is not None, doc, score))
        out += [(item, i + 1, s[2], s[3]) for i, s in enumerate(sorted(s for s in scores if s[3] > 0)[:k])]
    return sorted(out, key=repr)


def rows(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr)


def test_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE['op11_ranked_search']}) t").fetchall(), key=repr)
    assert rows(queries.op11_ranked_search(spark, DATA)) == want


def test_shards_blocks_and_ties(spark):
    """Many small shards in few tasks, several blocks of items, copies that tie at the end of a list."""
    random.seed(5)
    words = [f"w{i}" for i in range(60)] + ["straße", "日本語", "½"]
    texts = [(i, " ".join(random.choices(words, weights=[1 / (j + 1) for j in range(63)], k=random.randrange(80)))) for i in range(300)]
    texts += [(1000 - i, "w1 w50 w50 w7") for i in range(40)]
    items = [(i, " ".join(random.sample(words, 6))) for i in range(12)] + [(50, "W50, w7"), (51, "nowhere"), (52, None), (50, "w50 w7")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    index = ranked_search.index_documents(docs, shard_bytes=2000)
    assert index.shards.count() > 20
    got = rows(ranked_search.search(index, spark.createDataFrame(items, "item_id long, text string"), k=7, block_bytes=150))
    assert got == brute(texts, items, 7)
    assert [r[2] for r in got if r[0] == 50][::2] != [] and len([r for r in got if r[0] == 50]) == 14


def test_awkward_tables(spark):
    docs = awkward(spark)
    items = awkward(spark).select(F.col("doc_id").alias("item_id"), "text", "score", "rank")
    texts, wanted = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    assert rows(ranked_search.search(ranked_search.index_documents(docs), items, k=4)) == brute(texts, wanted, 4)
    nothing = ranked_search.index_documents(awkward(spark, []))
    assert (nothing.n_docs, nothing.n_terms) == (0, 0) and ranked_search.search(nothing, items).count() == 0
    assert ranked_search.search(ranked_search.index_documents(docs), items.limit(0)).count() == 0


def test_tree_is_the_lists(monkeypatch):
    """Every range of every node holds the term's documents below it, by impact; few nodes a step change nothing."""
    random.seed(6)
    texts = [" ".join(random.choices([f"t{i}" for i in range(20)], k=random.randrange(1, 30))).encode() for _ in range(77)]
    row = ranked_search.shard_row(list(range(77)), texts, 77, sum(len(t.split()) for t in texts))
    shard = ranked_search.Shard(row)
    terms, starts, docs, impacts = ranked_search.postings(texts, 77, sum(len(t.split()) for t in texts))
    assert shard.levels == 7 and terms == row["terms"]
    for t in range(len(terms)):
        own = list(zip(docs[starts[t] : starts[t + 1]].tolist(), impacts[starts[t] : starts[t + 1]].tolist(), strict=True))
        assert [i for _, i in own] == sorted((i for _, i in own), reverse=True)
        nodes = [(0, 0, int(starts[t]), int(starts[t + 1]))]
        while nodes:
            level, prefix, lo, hi = nodes.pop()
            below = [i for d, i in own if d >> (shard.levels - level) == prefix]
            assert shard.impacts[level, lo:hi].tolist() == below
            if level < shard.levels and lo < hi:
                a, b = shard.zeros_before(np.array([level, level]), np.array([lo, hi])).tolist()
                z = int(shard.zeros[level])
                nodes += [(level + 1, prefix * 2, a, b), (level + 1, prefix * 2 + 1, z + lo - a, z + hi - b)]
    uses = np.array([(0, i, 100 + i) for i in range(5)], dtype=np.int64).T
    items = ranked_search.Items(np.array([0]), pa.array(terms[:5], pa.binary()), *uses)
    results = []
    for width in (1, 64):
        monkeypatch.setattr(ranked_search, "WIDTH", width)
        best = ranked_search.Best(1, 9)
        ranked_search.search_row(row, pa.array(terms, pa.binary()), items, best)
        results.append((best.score.tolist(), best.doc.tolist()))
    assert results[0] == results[1] and len(results[0][0]) == 9
