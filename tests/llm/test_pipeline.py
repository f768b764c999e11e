import base64
import hashlib
import random

import duckdb
import numpy as np
import tiktoken
from fixtures import AWKWARD, documents, saved
from pyspark.sql import functions as F
from test_minhash import brute_groups
from test_mixing import brute as brute_mix

import corpus_pipeline
from gleaner.llm import bpe, mixing, quality, site_lines


def corpus():
    rng = random.Random(9)
    words = ["the", "of", "and", "to", "in"] * 8 + [f"word{i}" for i in range(600)]
    texts, sources = list(AWKWARD), ["a"] * len(AWKWARD)
    for i in range(140):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(8, 30))) for _ in range(rng.randrange(1, 5))]
        source = rng.choice(["hot", "hot", "hot", "a", "b"])
        if rng.random() < 0.3:
            lines.insert(0, f"Home of {source} and all the menu")
        texts.append("\n".join(lines))
        sources.append(source)
        if rng.random() < 0.3:
            copy = texts[-1].split(" ")
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
            sources.append(rng.choice(["hot", "b"]))
        if rng.random() < 0.1:
            texts.append("!!! ||| junk " * 30)
            sources.append("b")
    return texts, sources


def test_run_equals_brute_force(spark, tmp_path):
    texts, sources = corpus()
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    folder = saved(spark, tmp_path, documents(spark, texts, sources, ids).repartition(4))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    con.execute(f"CREATE TABLE good AS SELECT d.* FROM documents d JOIN ({quality.SQL['op10_quality_rules']}) USING (doc_id) WHERE kept")
    clean = con.execute(f"SELECT doc_id, text, source FROM ({site_lines.clean_sql('good')}) ORDER BY doc_id").fetchall()
    groups = brute_groups([t for _, t, _ in clean], [d for d, _, _ in clean], 5, 80)
    left = [(d, t, s) for d, t, s in clean if groups[d][1] == d]
    assert len(texts) > len(clean) > len(left) == len(got)

    with open(bpe.vocabulary()[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=bpe.vocabulary()[1], mergeable_ranks=ranks, special_tokens={})
    for d, t, _ in left:
        tokens = library.encode_ordinary(t)
        assert np.frombuffer(got[d].ids, "<u4").tolist() == tokens and got[d].n_tokens == len(tokens)
        assert got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()

    table = spark.createDataFrame([(d,) for d, _, _ in left], "doc_id long")
    hashes = {r.doc_id: r.h for r in table.select("doc_id", mixing.shuffled(F.col("doc_id")).alias("h")).collect()}
    sizes = {}
    for _, _, s in left:
        sizes[s] = sizes.get(s, 0) + 1
    order = brute_mix([(d, s) for d, _, s in left], mixing.flattened(sizes), mixing.BLOCK, mixing.PERIOD, hashes)
    want = [d for d, _, _, _, _ in sorted(order, key=lambda r: (r[3], r[4]))]
    assert [r.doc_id for r in sorted(got.values(), key=lambda r: (r.part, r.row))] == want


def test_stages_return_the_columns_of_documents(spark):
    docs = documents(spark, [None, "", "short", "the of and " + " ".join(f"w{i}" for i in range(40))] * 2, ids=[1, 2, 3, 4, 4, 6, None, 8])
    docs = docs.withColumns({"row": F.lit(1), "kept": F.lit("x")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            done = stage(spark, given, "")
            assert done.columns == docs.columns, name
            assert done.count() <= given.count()
    assert corpus_pipeline.encoded(spark, docs, "").count() == 8
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "encoding"]
