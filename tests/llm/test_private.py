import hashlib
import math
import random
import re
from collections import defaultdict

from fixtures import AWKWARD, documents, saved
from pyspark.sql import functions as F

from gleaner.llm import private

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    text = text or ""
    digits = lambda v: re.sub("[^0-9]", "", v)
    tests = (
        ("email", EMAIL, lambda v: True),
        ("ip", IP, lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", CARD, lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", PHONE, lambda v: 8 <= len(digits(v)) <= 15),
    )
    return [(k, m.start(), m.end(), m[0]) for k, p, ok in tests for m in p.finditer(text) if ok(m[0])]


def letters(text):
    """Runs of two letters and more, with places."""
    runs, start = [], None
    for i, c in enumerate(text + " "):
        if c.isalpha():
            start = i if start is None else start
        elif start is not None:
            if i - start > 1:
                runs.append((start, i))
            start = None
    return runs


def brute(texts):
    spans = [base(t) for t in texts]
    n = len(texts)
    held, seen, with_ = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        for a, b in letters(t or ""):
            held[(t or "")[a:b].lower()].add(i)
    places = []
    for i, t in enumerate(texts):
        for kind, s, e, value in spans[i]:
            entity = f"{kind}:{value.lower()}"
            seen[entity].add(i)
            for x, y in ((0, s), (e, len(t))):
                for a, b in letters(t[x:y]):
                    a, b = a + x, b + x
                    if not any(p < b and a < q for _, p, q, _ in spans[i]):
                        with_[entity, t[a:b].lower()].add(i)
                        places.append((i, entity, a, b))
    terms = defaultdict(dict)
    for i, entity, a, b in places:
        word = texts[i][a:b].lower()
        both = len(with_[entity, word])
        content = math.log(n / len(seen[entity]))
        if content <= 0:
            continue
        share = math.log(n * both / (len(seen[entity]) * len(held[word]))) / content
        if share >= private.GENERALISE:
            terms[i][a, b] = max(share, terms[i].get((a, b), 0))
    return spans, [sorted(terms[i].items()) for i in range(n)]


def texts():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("om", "ta", "ré", "zu", "Ka") for b in ("lin", "der", "mo", "sú", "pek", "a")]
    hard = [
        "a@b.c@d.e x_y@d.e a@b.c_x@d.e @x.y a@b a@b. a@b..c %+-@q-.z-",
        "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8.9 1.2.3 0255.1.1.1 999999999999999999999.1.1.1 ..1.2.3.4.",
        "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 41111111111111111111 4111  1111",
        "+1 (555) 123-4567 +1 55 ++49 (0) 30.1234567 +12345678 +1234567 +123456789012345 +1234567890123456",
        "+" + "1" * 60, "1" * 30_000, "a" * 30_000 + "@", "😀 a@b.cd 😀 1.1.1.1", "1 2-3 4 " * 6000,
    ]
    out = AWKWARD + hard
    for k in range(60):
        filler = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        if k % 3 == 0:
            at = rng.randrange(len(filler))
            who = rng.randrange(4)
            filler[at:at] = [f"Secret{'abcd'[who]}", f"user.{who}@mail.example.com", f"hint{'abcd'[who]}", "shared"]
        if k % 7 == 0:
            filler.append("+1 (555) 123-4567")
        out.append(" ".join(filler))
    return out + [out[-3], out[-3]]


def test_query_equals_brute_force(spark, tmp_path):
    given = texts()
    spans, terms = brute(given)
    got = {r.doc_id: r for r in private.query(spark, saved(spark, tmp_path, documents(spark, given).repartition(3))).collect()}
    assert len(got) == len(given) and any(terms)
    for i in range(len(given)):
        told = [f"{k}:{s}:{e}" for k, s, e, _ in spans[i]]
        r = got[i]
        for kind in private.KINDS:
            assert r[f"n_{kind}"] == sum(k == kind for k, *_ in spans[i]), given[i][:200]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert r.spans == ",".join(told + [f"term:{a}:{b}" for (a, b), _ in terms[i]]), given[i]
        assert r.n_removed == sum(v >= private.REMOVE for _, v in terms[i])


def test_sanitised_text_hides_data_and_telling_terms(spark):
    told = "Meet Zorro at zorro@x.example soon"
    plain = [f"we meet at place {c} soon and soon again" for c in "abcdefghij"]
    rows = {r.doc_id: r.text for r in private.sanitised(documents(spark, [told, told, *plain, None])).collect()}
    assert set(rows) == {0, 1} and rows[0] == rows[1]
    assert rows[0].startswith("Meet  at [email]") or rows[0].startswith("[Name]  at [email]")


def test_empty_table(spark):
    assert private.all_spans(documents(spark, ["x"]).limit(0)).count() == 0


def test_entity_of_one_document(spark):
    told = "Meet Zorro at zorro@x.example soon"
    plain = [f"we meet at place {c} soon and soon again" for c in "abcdefghij"]
    rows = {r.doc_id: r.text for r in private.sanitised(documents(spark, [told, *plain])).collect()}
    assert rows == {0: "Meet  at [email] soon"}


def test_terms_far_from_the_entity(spark):
    far = "we meet at place soon and " * 10
    told = f"Zorro {far}a@x.example, b@x.example {far}ask Zorro"
    plain = [f"{far}ask {c}" for c in "abcdefghij"]
    rows = {r.doc_id: r.text for r in private.sanitised(documents(spark, [told, told, *plain])).collect()}
    assert set(rows) == {0, 1} and rows[0] == f" {far}[email], [email] {far}ask "


def test_many_entities_over_several_documents(spark, tmp_path):
    """Chance meetings of addresses and words over a few documents, so that every share is in between."""
    rng = random.Random(8)
    parts = "lo mi qua te sor bel hin ad ulk ren".split()
    words = [f"{a}{b}{c}" for a in parts for b in parts for c in parts[:2]]
    given = []
    for _ in range(60):
        own = [rng.choice(words) for _ in range(rng.randrange(1, 12))] + [f"u{rng.randrange(12)}@x.example" for _ in range(rng.randrange(4))]
        rng.shuffle(own)
        given.append(" ".join(own))
    given += [given[0], given[1], given[1]]
    _, terms = brute(given)
    got = private.query(spark, saved(spark, tmp_path, documents(spark, given))).collect()
    assert any(terms)
    for r in got:
        spans = [x for x in r.spans.split(",") if x.startswith("term:")]
        assert spans == [f"term:{a}:{b}" for (a, b), _ in terms[r.doc_id]], given[r.doc_id]
        assert r.n_removed == sum(v >= private.REMOVE for _, v in terms[r.doc_id])


def test_a_page_of_many_addresses_is_not_multiplied(spark):
    """Rows in proportion to addresses and terms, not to their product."""
    for n_addresses, n_terms in ((200, 1_000), (400, 2_000)):
        letters = lambda k: "".join(chr(97 + int(d)) for d in str(10_000 + k))
        page = " ".join([f"p{k}@x.example" for k in range(n_addresses)] + [letters(k) for k in range(n_terms)])
        others = [f"write to p{k}@x.example about {letters(k)}" for k in range(n_addresses)]
        docs = documents(spark, [page, *others])
        base = private.with_base(docs)
        rows = private.private_rows(base)
        terms = private.occurrences(rows).select("row", "times", "term")
        counted = terms.join(private.document_counts(docs), "term", "left")
        met = private.met_in_several(counted, private.classes(rows), F.lit(float(n_addresses + 1)))
        assert met.count() <= 4 * n_addresses
    got = {r.doc_id: r for r in private.all_spans(docs).collect()}
    assert len(got[0].spans) == n_addresses and len(got[0].terms) == n_terms


def test_clashing_columns(spark):
    docs = documents(spark, texts()[:30])
    more = docs.withColumns({c: F.lit("mine") for c in ("row", "spans", "term", "class", "times", "places")})
    plain = {r.doc_id: (r.spans, r.terms) for r in private.all_spans(docs).collect()}
    assert {r.doc_id: (r.spans, r.terms) for r in private.all_spans(more).collect()} == plain
