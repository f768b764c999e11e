import hashlib
import random
import re

import pytest
import xxhash
from fixtures import AWKWARD, documents, saved
from pyspark.sql import functions as F

from gleaner.llm import fingerprints as fp


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def folded(values):
    h = 42
    for v in values:
        h = xxhash.xxh64(v.to_bytes(8, "little", signed=True), seed=h).intdigest()
    return signed(h)


def sketch(text, width=fp.WIDTH):
    words = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())]
    if len(words) >= width:
        hashes = {folded(words[i : i + width]) for i in range(len(words) - width + 1)}
    else:
        hashes = {folded(words)} if words else set()
    return {x for x in hashes if x < -(2**63) + 2**61} or set(sorted(hashes)[:1])


def printed(hashes):
    return "".join(f"{x % 2**64:016X}" for x in sorted(hashes))


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """``rows``: (doc_id, text)."""
    rows = sorted(((-(2**63) if i is None else i, t or "", i) for i, t in rows), key=lambda r: (-r[0], r[1]))
    out = []
    for k, (_, text, i) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        h = len(text) // 2
        edited = text[: len(text) - h] + after[:h]
        own, other = sketch(text), sketch(edited)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(text), sha, printed(own), printed(other), like(own, other), like(own, sketch(after))))
    return out


def made(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice("Alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 150))) for _ in range(n)]


def result(df):
    return sorted(map(repr, map(tuple, df.drop("contained_in_edited").collect())))


TEXTS = [t.replace("İ", "I") if t else t for t in AWKWARD] + made(1, 40) + ["short text", "short text", "one two three four five"]


@pytest.mark.parametrize("group", [1, 3, fp.GROUP])
def test_equals_brute_force(spark, group):
    rng = random.Random(group)
    ids = [rng.randrange(-(10**18), 10**18) for _ in TEXTS]
    ids[3] = ids[7] = ids[30] = 5  # rows of one id
    ids[9] = None
    got = fp.edited(documents(spark, TEXTS, ids=ids).repartition(3), group=group)
    assert result(got) == sorted(map(repr, brute(list(zip(ids, TEXTS)))))


def test_query_on_a_table_with_clashing_columns(spark, tmp_path):
    docs = documents(spark, TEXTS).withColumns({c: F.lit("mine") for c in ("own", "_key", "_h", "next_text", "edited")})
    got = fp.query(spark, saved(spark, tmp_path, docs))
    assert got.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert result(got) == sorted(map(repr, brute(list(enumerate(TEXTS)))))


def test_one_row_and_empty_table(spark):
    alone = documents(spark, ["a b c d e f g h"])
    assert result(fp.edited(alone)) == sorted(map(repr, brute([(0, "a b c d e f g h")])))
    assert fp.edited(alone.limit(0)).count() == 0
    assert fp.edited(alone.limit(0)).columns == fp.edited(alone).columns


def test_merge_and_containment_of_unequal_documents(spark):
    words = [f"w{i}" for i in range(40_000)]
    long, part, foreign = " ".join(words), " ".join(words[5_000:6_000]), " ".join(f"v{i}" for i in range(1_000))
    half = " ".join(words[7_000:7_500] + [f"x{i}" for i in range(500)])
    tiny = "nothing but this"
    texts = [long, part, half, foreign, tiny, ""]
    sketches = {r.doc_id: r.sketch for r in fp.fingerprints(documents(spark, texts)).collect()}
    assert abs(len(sketches[0]) / 40_000 - 1 / 8) < 0.01
    pairs = spark.createDataFrame([(k, sketches[k], sketches[0]) for k in sketches], "k int, a array<long>, b array<long>")
    share = {r.k: r.share for r in pairs.select("k", fp.containment(F.col("a"), F.col("b")).alias("share")).collect()}
    assert share[0] == share[1] == 1.0 and share[3] == 0.0 and share[5] is None
    assert abs(share[2] - 0.5) < 0.12
    assert len(sketches[4]) == 1 and sketches[5] == []
    # A merge of parts is the sketch of the whole, but for shingles across the seam.
    first, second = " ".join(words[:20_000]), " ".join(words[19_996:])
    parts = fp.fingerprints(documents(spark, [first, second])).orderBy("doc_id").collect()
    both = spark.createDataFrame([(parts[0].sketch, parts[1].sketch, sketches[4])], "a array<long>, b array<long>, c array<long>")
    m = both.select(fp.merged(F.col("a"), F.col("b")).alias("ab"), fp.merged(F.col("a"), F.col("c")).alias("ac"), fp.merged(F.col("c"), F.array().cast("array<long>")).alias("c")).first()
    assert m.ab == sketches[0]
    below = [x for x in sketches[4] if x < fp.BELOW]
    assert m.ac == sorted(parts[0].sketch + below) and m.c == sketches[4]


def test_no_python_on_the_main_path(spark, tmp_path, capsys):
    fp.query(spark, saved(spark, tmp_path, documents(spark, ["a b c"]))).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
