"""Quality rules, personal data, fingerprints and token counts against plain versions."""

import hashlib
import re
import time
import unicodedata
from collections import Counter

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from quarrylight.llm import mcd, pii, queries, simhash, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n", "a", "one two three", "a b c a b c a b c d", "é́ \x1cx\x1f ǅ Σ İ", "x" * 50_000, "w " * 30_000, "l\n" * 500, " a b\x85c \x0b\x0cd"]
DIR = "/root/testdata/sf0.001"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def real(limit=200):
    return duckdb.sql(f"select doc_id, text, lang, source from '{DIR}/documents.parquet' order by doc_id limit {limit}").fetchall()


def test_base_statistics(spark):
    texts = ODD + [r[1] for r in real()]
    got = mcd.base_statistics(docs(spark, texts)).orderBy("doc_id").select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert [tuple(r) for r in got] == [base(t) for t in texts]


def test_repeated_words_of_windows_that_share_a_hash_prefix(spark):
    """With room for positions only, all windows share one prefix and interleave: the comparison is by words."""
    texts = ["a b c x y z a b c q r s x y z", "p q r p q s p q r p q s", "a b c d e f g", "k k k k"]
    frame = docs(spark, texts)
    real_hash, F.xxhash64 = F.xxhash64, lambda *c: F.lit(0).cast("long") if len(c) == 3 else real_hash(*c)
    try:
        got = mcd.base_statistics(frame).orderBy("doc_id").select("n_repeat_words").collect()
    finally:
        F.xxhash64 = real_hash
    assert [r[0] for r in got] == [base(t)[4] for t in texts]


def plain_mcd(rows):
    """The three starts, their concentration steps and the reweighting over a plain array of whole-number features."""
    x, floors = np.array(rows, float), np.array(mcd.FLOORS, float)
    scatter = lambda part, factor: factor * (part.T @ part / len(part) - np.outer(part.mean(0), part.mean(0))) + np.diag(floors**2)
    distance = lambda mean, cov: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    def nearest(mean, cov, share):
        bins = np.minimum(np.floor(16 * distance(mean, cov)), mcd.LAST_BIN)
        return x[bins <= np.sort(bins)[int(np.ceil(share * len(x))) - 1]]

    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    median = q[1], np.diag((q[2] - q[0]) ** 2 / 1.8198 + floors**2)
    half = nearest(*median, 0.5)
    ends = []
    for mean, cov in (median, (x.mean(0), scatter(x, 1.0)), (half.mean(0), scatter(half, 1.0))):
        for _ in range(mcd.STEPS):
            inside = nearest(mean, cov, mcd.SUBSET)
            mean, cov = inside.mean(0), scatter(inside, mcd.CONSISTENCY)
        ends.append((np.linalg.slogdet(cov)[1], mean, cov))
    _, mean, cov = min(ends, key=lambda e: e[0])
    inside = x[distance(mean, cov) <= mcd.INLIER]
    return distance(inside.mean(0), scatter(inside, mcd.REWEIGHTED)), [e[0] for e in ends]


def test_quality_rules_follow_plain_estimates(spark):
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    out = mcd.quality_rules(table, least_pool=40)
    fit = mcd.features(out.filter("not base_failed")).select("lang", "source", "distance", *mcd.FEATURES).toPandas()
    assert (fit.groupby(["lang", "source"]).size() < 40).all()  # here all pools by language and source are too small
    by_lang, every = fit.groupby("lang").size(), plain_mcd(fit[list(mcd.FEATURES)])[0]
    assert (by_lang < 40).any() and (by_lang >= 40).any()
    for lang in by_lang.index:
        part = fit[fit.lang == lang]
        want = plain_mcd(part[list(mcd.FEATURES)])[0] if by_lang[lang] >= 40 else every[(fit.lang == lang).to_numpy()]
        assert np.allclose(part.distance, want, rtol=1e-6)
    assert out.count() == table.count()


def test_large_pools_have_their_own_estimates_and_the_least_determinant(spark):
    rng = np.random.default_rng(21)
    rows = []
    for pool, (lang, source, n) in enumerate([("en", "a", 300), ("en", "b", 90), (None, "a", 60), ("de", "c", 12)]):
        x = rng.normal([1600 + 40 * pool, 90, 60, 200], [60, 40, 70, 90], (n, 4))
        x[: n // 5] = rng.normal([2400, 700, 900, 600], 30, (n // 5, 4))  # a fifth lies apart
        rows += [(lang, source, *map(int, r)) for r in x]
    frame = spark.createDataFrame(rows, "lang string, source string, x1 long, x2 long, x3 long, x4 long")
    pool = F.concat_ws("/", F.coalesce("lang", F.lit("-")), "source").alias("pool")
    got = mcd.minimum_determinant(frame.select(pool, *mcd.FEATURES))
    far = mcd._measured(frame.select(pool, *mcd.FEATURES), got.withColumn("start", F.lit(0))).toPandas()
    assert len(far) == len(rows)
    for name, part in far.groupby("pool"):
        want, ends = plain_mcd(part[list(mcd.FEATURES)])
        assert np.allclose(part.distance, want, rtol=1e-6)
        assert min(ends) <= ends[0] + 1e-9 and (part.distance[part.x2 > 500] > mcd.CUTOFF).all()


CLASHES = ["distance", "pool", "_l", "_s", "m0", "l00", "x1", "docs", "own", "s", "e", "n", "row", "_row", "_fingerprint", "hits", "_hits", "best", "host_", "root", "node", "first"]


def with_clashes(frame):
    """`frame` with columns named as the operators name theirs; a value tells whether it came through."""
    return frame.withColumns({c: F.lit(f"user {c}") for c in CLASHES})


def came_through(out, *replaced):
    """Every clashing column that isn't the operator's own output still holds the user's value."""
    return all(r[c] == f"user {c}" for r in out.select(*(c for c in CLASHES if c not in replaced)).collect() for c in CLASHES if c not in replaced)


def test_quality_rules_with_clashing_columns(spark):
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    out = mcd.quality_rules(with_clashes(table).withColumn("kept", F.lit("user")))
    assert out.columns == [*table.columns, *(c for c in CLASHES if c != "distance"), *mcd.STATISTICS, "base_failed", "distance", "kept"]
    assert came_through(out, "distance") and dict(out.dtypes)["kept"] == "boolean" and dict(out.dtypes)["distance"] == "double"
    plain = {(r.doc_id, r.kept) for r in mcd.quality_rules(table).collect()}
    assert {(r.doc_id, r.kept) for r in out.collect()} == plain


def test_quality_rules_reject_the_outlier_and_keep_prose(spark):
    texts = [" ".join(f"{'abcdefghij'[(i * 7 + k * 3) % 10]}{'lorem ipsum dolor sit amet'.split()[(i + k) % 5]}{k}" for k in range(60 + i)) for i in range(80)]
    texts.append(" ".join(f"w{k}***" for k in range(80)))
    out = mcd.quality_rules(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.kept for r in out] == [True] * 80 + [False] and not out[-1].base_failed


def test_quality_rules_odd_rows(spark):
    frame = docs(spark, ODD).union(docs(spark, ODD)).withColumn("lang", F.lit(None).cast("string")).withColumn("kept", F.lit("clash"))
    out = mcd.quality_rules(frame).collect()
    assert len(out) == 2 * len(ODD) and {r.kept for r in out} <= {True, False}
    assert mcd.quality_rules(docs(spark, [])).collect() == []


REGEX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in REGEX.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


TRICKY = [
    "a@b.c@d.e x..y@-.-. @a.b a@b a@b..c a.@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.1.1 0001.02.3.4 1.2.3 1..2.3.4 99999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 12345678901234567890 5500000000000004-",
    "+1 (743) 555-3824 +1+2 3456789 +12 +1((( +1 ... 5 ++44 20 7946 0958.", "é@ü.de café.x@mail.example.com 𝒳 a@b.co", "+1234567890@x.yz 1.2.3.4@5.6.7.8", "İ token = \"ab12cd34\" İ x@y.zz",
]


def test_base_spans_equal_the_patterns(spark):
    texts = TRICKY + [t or "" for t in ODD] + [r[1] for r in real()]
    for t in texts:
        assert [s for s in pii.find_spans(t) if s[0] in pii.BASE_KINDS] == plain_spans(t), t[:80]


def test_random_spans_equal_the_patterns():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        t = "".join(rng.choice(list("0129.@+- ()aZ\n%"), 40))
        assert [s for s in pii.find_spans(t) if s[0] in pii.BASE_KINDS] == plain_spans(t), t


def test_method_spans_and_redaction():
    t = 'see https://a.example.org/x?q=1). Token = "24be64439e3e", IBAN: DE89 3704 0044 0532 0130 00 and iban DE00 3704 0044 0532 0130 00; account no. 12345678'
    kinds = [(k, t[a:b]) for k, a, b in pii.find_spans(t) if k not in pii.BASE_KINDS]
    assert kinds == [("url", "https://a.example.org/x?q=1"), ("account", "24be64439e3e"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678")]
    assert pii.redact("mail a@b.co or 1.2.3.4") == "mail [EMAIL] or [IP]"


def plain_iban(code):
    turned = code[4:] + code[:4]
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", code)) and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def plain_accounts(text):
    """Spans of accounts and addresses by patterns that read whatever a cue or scheme may reach, from every one."""
    low, out, behind = pii.folded(text), [], 0
    for m in re.finditer("|".join(sorted(map(re.escape, pii.CUES), key=len, reverse=True)), low):
        if m.start() < behind or re.match(r"\w", low[m.start() - 1 : m.start()].replace("_", "")) or low[m.end() : m.end() + 1].isalnum():
            continue
        lead = re.compile(r"\s{0,3}(?:(?:no\.?|number|is)\s{1,3})?[:=#]?\s{0,3}[\"']?([A-Za-z0-9](?:[ -]?[A-Za-z0-9_]){5,})").match(text, m.end())
        if not lead:
            continue
        code, end = lead[1], None
        if m[0] == "iban":
            packed = [i for i, c in enumerate(code, 1) if c.isalnum()]
            ends = [packed[n - 1] for n in range(min(34, len(packed)), 14, -1) if "_" not in code[: packed[n - 1]] and plain_iban(re.sub("[^A-Za-z0-9]", "", code[: packed[n - 1]]).upper())]
            end = ends[0] if ends else None
        else:
            solid, digits = re.match("[A-Za-z0-9_-]+", code)[0], re.match("[0-9](?:[ -]?[0-9])*", code)
            if len(re.findall("[0-9]", solid)) >= 4 and len(solid) >= 6:
                end = len(solid)
            elif digits and len(re.findall("[0-9]", digits[0])) >= 6:
                end = digits.end()
        if end:
            out.append(("account", lead.start(1), lead.start(1) + end))
            behind = lead.start(1) + end
    urls, behind = [], 0
    for m in re.finditer("https?://|ftp://", low):
        rest = re.compile("[^\\s<>\"'`]+").match(text, m.end())
        if m.start() >= behind and rest and "." in (kept := rest[0].rstrip(".,;:!?)]}")).split("/")[0]:
            behind = m.end() + len(kept)
            urls.append(("url", m.start(), behind))
    return urls + out


def test_method_spans_equal_plain_patterns():
    rng = np.random.default_rng(12)
    pieces = [*pii.CUES, "iban", "secret", " ", "-", "_", ":", "=", '"', "no. ", "number ", "is ", "12", "7", "ab1", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82WEST12345698765432", "http://", "https://", "a.b", "/", ".", ")", "x", "0 1 2 3 4 5 6", "\n"]
    for n in range(4000):
        t = "".join(rng.choice(pieces, rng.integers(1, 30)))
        assert [s for s in pii.find_spans(t) if s[0] not in pii.BASE_KINDS] == plain_accounts(t), t


def test_personal_data_of_long_texts_in_time():
    """1 MB of what begins a span and gives none, or gives one each time."""
    start = time.perf_counter()
    for piece in ("token ", "secret ", "http://", "iban ", "account number is ", "token-", "token-1", "token_", "secret: ab", "http://a.", "a@", "@a.", "+1", "+1 ", "1.", "1 ", "4111 ", "iban DE89 ", "password=x", "https://x.y/", "ssn 123-45 "):
        text = piece * (1_000_000 // len(piece))
        began = time.perf_counter()
        pii.find_spans(text)
        assert time.perf_counter() - began < 5, piece
    for run in ("token " + "a" * 1_000_000, "token " + "a-" * 500_000, "http://" + "a" * 1_000_000, "+1" + "." * 1_000_000, "a" * 1_000_000 + "@", "1" * 1_000_000, "iban " + "A" * 1_000_000):
        began = time.perf_counter()
        pii.find_spans(run)
        assert time.perf_counter() - began < 5, run[:20]
    assert time.perf_counter() - start < 60


def test_personal_data_keeps_tables(spark):
    own = docs(spark, ["a@b.co", None]).withColumn("spans", F.lit("user")).withColumn("kind", F.lit("user"))
    out = pii.personal_data(own)
    assert [(r.spans, r.kind) for r in out.orderBy("doc_id").collect()] == [("email:0:6", "user"), ("", "user")] and sorted(out.columns) == sorted(own.columns)
    assert pii.personal_data(own, out="found").where("spans = 'user'").count() == 2
    assert pii.personal_data(own.limit(0)).collect() == [] and pii.redacted(own.limit(0)).collect() == []


def test_pii_query(spark):
    got = {r.doc_id: r for r in queries.op2_personal_data(spark, DIR).collect()}
    for doc, text, *_ in real():
        want = plain_spans(text)
        r = got[doc]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in want) for x in pii.BASE_KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert [r.spans for r in pii.personal_data(docs(spark, [None, ""])).collect()] == ["", ""]
    assert pii.redacted(docs(spark, [None, "a@b.co"])).select("text").collect() == [(None,), ("[EMAIL]",)]


def plain_fingerprint(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, most=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    texts = [r[1] for r in real(60)] + ODD
    for _ in range(12):  # chains of near copies
        t = list(rng.choice(words, 120))
        for _ in range(5):
            texts.append(" ".join(t))
            t[rng.integers(120)] = "changed"
    frame = docs(spark, texts).orderBy(F.rand(1))
    got = sorted((r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(frame).collect())
    fps = [plain_fingerprint(t) for t in texts]
    assert [g[1] for g in got] == fps
    assert [g[2] for g in got] == plain_components(list(range(len(texts))), fps)


def test_links_find_every_near_pair(spark):
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = {0, 2**64 - 1}
    for s in seeds.tolist():
        for bits in range(7):
            x = s
            for b in rng.choice(64, bits, replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fingerprint long")
    fps = list(fps)
    want = {frozenset((signed(a), signed(b))) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 4}
    for segments in (None, *simhash.SEGMENTS):
        assert {frozenset((r.a, r.b)) for r in simhash.links(frame, segments=segments).collect()} == want and want


def test_segments_cover_the_distance_and_their_work_stays_bounded():
    for segments in simhash.SEGMENTS:
        assert sum(w for w, _ in segments) == 64 and sum(r + 1 for _, r in segments) > simhash.MAX_DISTANCE
    work = {n: sum(simhash.expected_work(n, simhash.segments_for(n))) for n in (10**3, 10**5, 10**7, 10**9)}
    assert work[10**5] < 60 and work[10**7] < 200 and work[10**9] < 1000  # keys and pairs for each fingerprint


def test_simhash_null_ids_and_no_rows(spark):
    frame = spark.createDataFrame([(None, "x"), (7, "x"), (None, "other words here now"), (3, None), (9, "")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    assert got == {(None, 7), (7, 7), (None, None), (3, 3), (9, 3)}
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


TOKENS = ["<|endoftext|> a<|startoftext|>b <|END|>", "It's 123 we'LL DON'T ''s 4.5%", "é x̂̃ ́a Å ﬁ ǅ ΑΣ ΣΑΣ.", "日本語 العربية नमस्ते 👍🏽 ‍", "a\x00b\x1cc\x85d e f﻿g", "ß ẞ İ ı K"]


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ODD + TOKENS + [r[1] for r in real()]
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for held in (tokens.HELD, 5000):  # also in many small blocks
        tokens.HELD, kept = held, tokens.HELD
        try:
            got = tokens.token_counts(docs(spark, texts), "word_bpe_49k.json").orderBy("doc_id").collect()
        finally:
            tokens.HELD = kept
        assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in got] == [n > 2048 for n in want]
    named = spark.createDataFrame([(f"id{i}" if i % 3 else None, t, i) for i, t in enumerate(TOKENS)] * 2, "doc_id string, text string, pieces int").withColumns({"row": F.lit("user"), "n": F.lit(1.5)})
    assert sorted((str(r.doc_id), r.n_tokens) for r in tokens.token_counts(named, "word_bpe_49k.json").collect()) == sorted((f"id{i}" if i % 3 else "None", want[len(ODD) + i]) for i in range(len(TOKENS))  for _ in range(2))
    assert tokens.token_counts(docs(spark, []), "word_bpe_49k.json").collect() == []


def test_normal_form():
    assert unicodedata.normalize("NFC", "e\u0301") == "é" and tokens.pieces("E\u0301")[0] == ["é"]
