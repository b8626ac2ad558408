"""The document operators against brute force on a small table of odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import dac, decontam, iblt, jaccard, mixing, qda, secrets, templates
from gridloom.llm.common import shared_path



PROSE = "The quick survey of quiet rivers found that most of them run slowly through wide green valleys and past small towns"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def lowered(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_secrets(docs, no_docs, rows):
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.scan(docs).collect())
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = Counter()
    for d, t, *_ in rows:
        t = t or ""
        s = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in sorted(s))
        want[d, *(sum(x[1] == k for x in s) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert got == want
    assert secrets.scan(no_docs).count() == 0
    ranks = secrets.ranked(secrets.dictionary(docs))
    by_text = defaultdict(list)
    for r in secrets.scan(docs).collect():
        by_text[r["doc_id"]].append(r)
    for d, t, *_ in rows:
        m = [(m.start(1), m[1].rstrip(".,;:!?)")) for m in secrets.CONTEXT.finditer(t or "")]
        values = [(a, v, secrets.guess_cost(v, ranks)) for a, v in m if len(v) >= 8]
        guesses = [f"guess:{a}:{a + len(v)}" for a, v, c in values if c >= 10]
        for r in by_text[d]:
            assert [x for x in r["spans"].split(",") if x.startswith("guess")] == guesses and (r["n_values"], r["n_guess"]) == (len(values), len(guesses))
            assert r["max_cost"] == (pytest.approx(max(c for *_, c in values)) if values else None)
    assert sum(r["n_guess"] for v in by_text.values() for r in v) >= 2, "beside base spans too"


@pytest.mark.parametrize("said", ["secret_key: %s", "SECRET_KEY=%s", "AWS_SECRET_ACCESS_KEY = '%s'", "password:\t%s", "token =\n  %s", "'api-key' => \"%s\"", "passwd := %s", "my pwd is %s", "auth_token_v2:%s", "Bearer=%s"])
def test_contexts(said):
    value = "x9Kq-72Lm_pZ"
    assert [m[1] for m in secrets.CONTEXT.finditer("words before " + said % value + " and after")] == [value]


def test_contexts_of_no_credentials():
    for said in ("author: Somebody", "the secret of the garden", "passage = text", "logins and tokens", "token " + " " * 9999 + "x"):
        assert not secrets.CONTEXT.search(said)


def test_the_dictionary_is_ranked_by_the_corpus(docs, rows):
    counts = Counter(w for r in rows for w in re.split("[\x00-\x40\x5b-\x60\x7b-\x7f]", lowered(r[1])) if re.fullmatch("[a-z]{3,20}", w))
    assert secrets.dictionary(docs, 50) == sorted(counts, key=lambda w: (-counts[w], w))[:50]


RANKS = secrets.ranked(["zebra", "cloud", "abc"])


@pytest.mark.parametrize("s", ["password", "P4ssword1", "aaaaaaa", "abcabcabc", "qwerty12", "1987-05-06", "x9$kQ", "passpass", "", "zxcvbn2020", "ASDFgh!!", "2020aaaqwe", "zebrazebra", "xyzxyzzeb"])
def test_guess_cost_is_the_least(s):
    """All segmentations of short strings, one by one."""
    pieces = defaultdict(list)
    for a, z, c in secrets.spans(s, RANKS):
        pieces[a].append((z, c + secrets.SPAN))
    for a in range(len(s)):
        for z in range(a + 1, len(s) + 1):
            pieces[a].append((z, secrets.SPAN + sum(np.log10(secrets.charset(c)) for c in s[a:z])))
    best = [float("inf")]

    def go(at, cost):
        if at == len(s):
            best[0] = min(best[0], cost)
        elif cost < best[0]:
            for z, c in pieces[at]:
                go(z, cost + c)

    go(0, 0.0)
    assert secrets.guess_cost(s, RANKS) == pytest.approx(best[0])


def test_guess_costs_rank_sensibly():
    costs = [secrets.guess_cost(x, RANKS) for x in ("password", "Password1", "qwertyuiop", "Tr0ub4dor&3zK!vQ")]
    assert costs == sorted(costs) and secrets.guess_cost("a" * 100_000, RANKS) < 12
    assert secrets.guess_cost("zebrazebra", RANKS) < secrets.guess_cost("zebra", RANKS) + 2 < secrets.guess_cost("qzxwvqzxwv", RANKS), "a repeat costs what its unit does"


def digests_of(t):
    """Digests of a text's pieces and, where it is short, of the pairs of words that their hash chooses."""
    digest = lambda w, seed=42: xxhash.xxh64_intdigest(w.encode(), seed)
    held = {digest(p.strip(" ")) for p in re.split(r"\n|(?<=[a-m][.!?])[ \t\n\x0b\f\r]+|(?<=[。！？])", t) if p.strip(" ")}
    if len(t) <= iblt.SHORT:
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+|(?<=[\u3040-\u30ff\u4e00-\u9fff])", t) if w]
        every = 1
        while iblt.WHOLE * every < len(t):
            every *= 2
        of_pairs = [digest(b, digest(a)) for a, b in zip(words, words[1:], strict=False)] + [digest(w) for w in words[-1:]]
        held |= {h for h in of_pairs if h % every == 0}
    return held


def test_short_texts_keep_pieces(spark):
    """Half of a short text is alike whether it is one sentence, has no blanks or gets shorter by the edit."""
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8)))
    texts = [" ".join(word() for _ in range(n)) for n in range(12, 250, 7) for _ in range(4)] + ["".join(rng.choices("山川田中人大小上下日月木水火土", k=n)) for n in (30, 100, 700)]
    texts += ["", "one", "a b", "x" * 1600, "y" * 1601]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: set(r["own"]) for r in df.select("doc_id", iblt.digests(F.col("text")).alias("own")).collect()}
    assert all({h % 2**64 for h in got[k]} == digests_of(t) for k, t in enumerate(texts))
    found = iblt.fingerprints(df.where(F.length("text") > 40)).collect()
    assert sum(r["near_edited"] == 0 for r in found) <= 0.05 * len(found)
    assert sum(r["near_next"] > 0.1 for r in found) <= 3, "pairs of few signs meet by chance"


def test_fingerprints(docs, no_docs, rows):
    pieces = digests_of

    def near(a, b):
        a, b = pieces(a), pieces(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    got = iblt.fingerprints(docs).collect()
    assert len(got) == len(rows)
    ids = [r["doc_id"] for r in got]
    single = [r for r in rows if ids.count(r[0]) == 1 and r[0] is not None]
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
    by_id = {r["doc_id"]: r for r in got}
    for d, t, *_ in single:
        t, n = t or "", len(t or "")
        k = next(i for i, r in enumerate(order) if r[0] == d)
        after = order[(k + 1) % len(order)][1] or ""
        edited = t[: n - n // 2] + after[: n // 2]
        r = by_id[d]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(near(t, edited)) and r["near_next"] == pytest.approx(near(t, after)), d
    prints = defaultdict(set)
    for d, t, *_ in single:
        prints[t or ""].add(by_id[d]["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())
    twins = [r for r in got if r["doc_id"] == 30]
    assert len(twins) == 3 and sorted(r["near_next"] == 1.0 for r in twins) == [False, True, True]
    assert iblt.fingerprints(no_docs).count() == 0
    digest = {r["doc_id"]: (r["own"], r["edited"]) for r in iblt.neighbours(docs).collect()}
    for d, _, *_ in single:
        own, edited = digest[d]
        for cells, held in ((by_id[d]["fingerprint"], own), (by_id[d]["edited_fingerprint"], edited)):
            n, k = np.array([int(cells[i : i + 16], 16) for i in range(0, len(cells), 40)]), [int(cells[i + 16 : i + 32], 16) for i in range(0, len(cells), 40)]
            assert n.reshape(3, -1).sum(axis=1).tolist() == [len(held)] * 3
            for t in range(3):
                of_table = 0
                for x in k[t * iblt.CELLS : (t + 1) * iblt.CELLS]:
                    of_table ^= x
                want = 0
                for x in held:
                    want ^= x & (1 << 64) - 1
                assert of_table == want, "every digest is in one cell of each table"


def test_sketches_grow_with_the_difference(spark):
    """A long text with one changed piece is settled by its fingerprint; one of other pieces takes larger sketches."""
    import random

    rng = random.Random(1)
    line = lambda k: f"{k} line of its own {rng.random()}"
    long = [line(k) for k in range(3000)]
    near = [*long[:1700], line(0), *long[1701:]]
    far = [line(k) for k in range(3000)]
    df = spark.createDataFrame([(3, "\n".join(long)), (2, "\n".join(near)), (1, "\n".join(far))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in iblt.fingerprints(df).collect()}
    assert got[3]["cells_next"] == iblt.CELLS and got[3]["near_next"] == pytest.approx(2999 / 3001)
    assert got[2]["cells_next"] > 1000 and got[2]["near_next"] == 0


def test_token_ids(spark, docs, no_docs, rows):
    tk = Tokenizer.from_file(VOCABULARY)
    folder = shared_path(spark, "t")
    got = sorted(map(tuple, dac.read(spark, folder, dac.write(docs, folder, VOCABULARY, file_tokens=500)).collect()), key=lambda r: r[1])
    ids = lambda t: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((d, len(ids(t)), zlib.crc32(ids(t).tobytes())) for d, t, *_ in rows)
    start = 0
    for r in got:
        assert r[1] == start
        start += r[2]
    folder = shared_path(spark, "none")
    assert dac.read(spark, folder, dac.write(no_docs, folder, VOCABULARY)).count() == 0


def test_random_access():
    ids = np.random.default_rng(5).choice(np.array([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1], "<u4"), 5000)
    codes = dac.Codes(dac.encode(ids, [1, None], [4000, 1000]))
    assert np.array_equal(codes.decode(), ids)
    assert [codes[i] for i in range(0, 5000, 7)] == ids[::7].tolist() and codes[4999] == ids[-1]
    with pytest.raises(IndexError):
        codes[5000]
    assert len(dac.Codes(dac.encode(ids[:0], [], [])).decode()) == 0


def test_words_like_the_tokenizer():
    import random

    rng, tk, w = random.Random(2), Tokenizer.from_file(VOCABULARY), dac.Words(VOCABULARY)
    alphabet = ["a", "B", "é", "É", "œ", "J", "̌", "'s", ",", ".", "!", " ", "\n", "1", "Σ", "\x1c", "\xa0", "ß", "İ", "<|endoftext|>", "中", "😀"]
    some = ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(500)]
    for t, b in zip(some, w.ids(some), strict=True):
        assert np.frombuffer(b, "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("t", ["<|ENDOFTEXT|>", "A b <|EndOfText|>. c", "<|StartOfText|>x <|startoftext|> y", "x<|ENDOFTEXT|>y <|endoftext|>", "中 <|ENDOFTEXT|>", "Let f <| g <|END"])
def test_added_tokens_in_capitals_are_words(t):
    tk, w = Tokenizer.from_file(VOCABULARY), dac.Words(VOCABULARY)
    for some in ([t], ["plain words", t, "<|endoftext|>", t]):
        for s, b in zip(some, w.ids(some), strict=True):
            assert np.frombuffer(b, "<u4").tolist() == tk.encode(s, add_special_tokens=False).ids, s


def test_templates(docs, no_docs, rows):
    out = templates.without_templates(docs, documents=10)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped", "n_cut"]
    got = defaultdict(list)
    for r in out.collect():
        got[r["text"]].append(r["n_dropped"])
    assert sum(map(len, got.values())) == len(rows)
    assert all(f"own {i}" in got for i in range(12)), "a masked number makes one template"
    assert all(f"more {i * 7}" in got for i in range(12))
    assert got["line a 1 x\nline a 2 x\nline a 3 x\n\nown line here now"] == [0], "one document only"
    assert got[None] == [0] and 0 in got[""]
    assert templates.without_templates(no_docs).count() == 0


def test_varying_words_are_generalised(spark):
    names = "ann bob cid dan eve fay gus hal ida joe kim lea".split()
    df = spark.createDataFrame([(i, f"Signed in here by user {n} today\nkeep {n}") for i, n in enumerate(names)] + [(99, "Signed in here")], "doc_id long, text string")
    assert sorted(r["text"] for r in templates.without_templates(df).collect()) == sorted(["Signed in here", *(f"keep {n}" for n in names)])


def test_near_lines_long_lines_and_sentences(spark):
    """A line that differs in a few places goes with its leaf; long lines go at 3 documents; passages go out of longer lines."""
    plain = "Please read all of the notes that follow here before signing"
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}word" for i in range(60)]
    long = " ".join(words)
    passage = "One quiet sentence of the passage has these eleven plain words. The second of its sentences has some more plain words!"
    own = lambda i: " ".join(f"{w}{chr(97 + i)}" for w in words)
    rows = [(i, plain if i < 9 else plain.replace("signing", "leaving")) for i in range(10)] + [(20, plain.replace("notes", "rules").replace("follow", "stand").replace("signing", "it"))]
    rows += [(30 + i, long) for i in range(3)] + [(40 + i, own(25)) for i in range(2)]
    rows += [(50 + i, f"{own(i)}. {passage} Short one. And {own(i + 10)}\nshort {passage}") for i in range(10)]
    rows += [(70 + i, f"{own(i)}k. Here are as few as nine documents with this sentence.") for i in range(9)]
    got = {r["doc_id"]: r for r in templates.without_templates(spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string")).collect()}
    assert all(got[i]["text"] == "" and got[i]["n_dropped"] == 1 for i in [*range(10), 30, 31, 32])
    texts = dict(rows)
    assert all(got[i]["text"] == texts[i] and not got[i]["n_dropped"] + got[i]["n_cut"] for i in [20, 40, 41, *range(70, 79)])
    for i in range(50, 60):
        assert got[i]["text"] == f"{own(i - 50)}. Short one. And {own(i - 40)}" and (got[i]["n_lines"], got[i]["n_dropped"], got[i]["n_cut"]) == (2, 1, 1)


def test_lines_are_hashed_before_they_are_rows(spark, docs):
    units = templates.units_of(docs.withColumn("h", F.xxhash64("text")))
    plan = units._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1
    lines = {(x["doc_id"], x["line"]) for x in units.where("leaf is not null").collect()}
    own = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).withColumn("t", templates.tokens_of(F.col("l"))).where(F.size("t") >= templates.TOKENS)
    assert lines == {tuple(x) for x in own.select("doc_id", F.xxhash64("t")).collect()}


def test_templates_of_a_very_long_text(spark):
    """Texts of over 1 MB, in one line and in many: only what recurs goes."""
    line = " ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000 % 10]}." if i % 9 == 0 else "word" for i in range(200_000))
    many = "\n".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]} of a line" for i in range(900))
    rows = [(1, line + " The end of the longest text that anyone wrote here."), (2, many), *((10 + i, "Sign in to go on") for i in range(10)), (30, "x y z\nSign in to go on\n\n")]
    got = {r["doc_id"]: r["text"] for r in templates.without_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(rows), **{10 + i: "" for i in range(10)}, 30: "x y z\n\n"}


def test_quality(spark, docs, no_docs, rows):
    train = [(i, ("good plain words of prose number %d, which go on. And on." % i if i % 2 else "BAD!!! $$$ %%%% ### {} && *** !!" * (1 + i % 3)), "z") for i in range(200)]
    df = spark.createDataFrame(train, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (3, None, 0), (5, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    got = qda.classify(df, labels).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == r["doc_id"] % 2 == int(r["score"] >= 0.5)
    every = qda.classify(docs, labels).collect()
    assert len(every) == len(rows) and all(r["score"] == 0.5 for r in every) is False or all(0 <= r["score"] <= 1 for r in every)
    none = qda.classify(docs, labels.where("quality = 1"))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert qda.accepted(df, labels).columns == df.columns
    assert sorted(map(tuple, qda.accepted(df, labels).collect())) == sorted(r for r in train if r[0] % 2)
    assert qda.classify(no_docs, labels).count() == 0


def test_the_fit_is_the_plain_one(spark, docs):
    """Means, shrunken covariances and priors against numpy over all labelled rows at once; a bounded sample is of those rows."""
    texts = [(i, (PROSE if i % 3 else "!!") + f" {i} " * (i % 7) + "Aa. " * (i % 5)) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(250)], "doc_id long, quality int")
    model = qda.fit(df, labels, 0.3, 0.05)
    known = [i for i in range(250) if zlib.crc32(str(i).encode()) % 3 != 1]
    x, y = np.array([qda.statistics(texts[i][1]) for i in known]), np.array([int(i % 3 > 0) for i in known])
    cov = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * cov[k] for k in (0, 1))
    for k in (0, 1):
        want = 0.95 * (0.7 * cov[k] + 0.3 * pooled) + 0.05 * np.diag(np.maximum(np.diag(pooled), 1e-9)) + 1e-9 * np.eye(qda.DIMENSIONS)
        assert np.allclose(model.means[k], x[y == k].mean(axis=0)) and np.allclose(model.factors[k] @ model.factors[k].T, want)
    assert np.allclose(model.log_prior, np.log([(y == k).mean() for k in (0, 1)]))
    some = {r["doc_id"] for r in qda.training(labels, 60).collect()}
    assert some < set(known) and 30 < len(some) < 90


CLASHES = ["_id", "_n", "_words", "_lines", "_doc", "_h", "score", "Score", "row", "key", "at", "k", "h", "same", "lines", "gone", "kept", "cls", "n", "term", "pos", "copies", "n_near"]


@pytest.mark.parametrize("stage", ["accepted", "one_of_each", "clean", "mixed", "without_templates", "decontaminated"])
def test_clashing_columns_keep_their_values(spark, benchmark, stage):
    own = [(i, f"{PROSE} and {i} {i * 7} {i + 3}", ["a", "b", None][i % 3], *(f"{c}{i}" for c in CLASHES)) for i in range(9)]
    df = spark.createDataFrame([*own, (None, "null id of a text", None, *CLASHES), (None, "null id of a text", None, *CLASHES)], ["doc_id", "text", "source", *CLASHES])
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    out = {
        "accepted": lambda: qda.accepted(df, labels.where("quality = 1")), "one_of_each": lambda: jaccard.one_of_each(df), "clean": lambda: decontam.clean(df, benchmark),
        "mixed": lambda: mixing.mixed(df), "without_templates": lambda: templates.without_templates(df, 3), "decontaminated": lambda: decontam.decontaminated(df, benchmark),
    }[stage]()
    new = {"without_templates": ["n_lines", "n_dropped", "n_cut"], "decontaminated": decontam.RESULT}.get(stage, [])
    assert out.columns == [c for c in df.columns if c not in new] + new
    kept = [c for c in CLASHES if c not in new]
    places = [out.columns.index(c) for c in kept]
    rows = [(r[0], *(r[i] for i in places)) for r in out.collect()]
    assert rows and all(r == (None, *kept) or r == (r[0], *(f"{c}{r[0]}" for c in kept)) for r in rows)
    if stage == "one_of_each":
        assert sum(r[0] is None for r in rows) == 1, "null ids are deduplicated too"


def test_discriminant_is_the_density():
    rng = np.random.default_rng(0)
    cov = [np.cov(rng.normal(size=(3, 30))) for _ in range(2)]
    means = rng.normal(size=(2, 3))
    model = qda.Model(means, np.linalg.cholesky(np.array(cov)), np.log([0.3, 0.7]))
    x = rng.normal(size=(5, 3))
    logs = [np.log(p) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) for p, c, m in zip((0.3, 0.7), cov, means, strict=True)]
    assert np.allclose(model.scores(x), 1 / (1 + np.exp((logs[0] - logs[1]) / 3)))


def test_decontamination(docs, no_docs, benchmark, rows):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    items = [("" if r["item_id"] is None else str(r["item_id"]), words(r["text"])) for r in benchmark.collect()]
    want = Counter()
    for d, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for item, own in items:
            n = min(10, len(own))
            for a in range(len(own) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == own[a : a + n]:
                        hit |= set(range(s, s + n))
                        found.add(item)
        want[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    assert Counter(tuple(r)[:-1] for r in decontam.scan(docs, benchmark).collect()) == want
    assert decontam.scan(docs, benchmark.where("false")).where("contaminated or n_near > 0").count() == 0
    assert decontam.scan(no_docs, benchmark).count() == 0
    out = decontam.decontaminated(docs.withColumn("N_hit", F.lit("theirs")), benchmark)
    assert out.columns == [*docs.columns, *decontam.RESULT] and out.count() == len(rows)
    clean = decontam.clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(d for (d, *_, bad), n in want.items() if not bad for _ in range(n))


def test_one_index_serves_benchmarks_and_proximity(spark):
    docs = spark.createDataFrame([(1, "aa bb noise cc dd noise ee ff gg hh ii jj"), (2, "aa " + "x " * 50 + "bb " + "x " * 50 + "cc dd"), (3, None), (4, "dd cc bb aa"), (5, "kk " * 30)], "doc_id long, text string")
    postings = decontam.index(docs)
    assert postings.where("term != ''").count() == 12 + 104 + 4 + 30 and postings.where("term = ''").count() == 5
    near = lambda text: {r["doc_id"] for r in decontam.matches(postings, spark.createDataFrame([(1, text)], "item_id long, text string")).where("n_near > 0").collect()}
    assert near("aa bb cc dd ee ff gg hh ii jj") == {1}, "rarest are ee, ff, gg, hh"
    assert near("aa bb cc dd zz yy xx ww vv uu") == {1}, "the others don't occur; in 4 the order is another, and in 2 they are far apart"
    assert near("aa bb cc dd") == set() == near("kk kk kk kk kk kk kk kk kk kk")


def test_long_texts_are_decontaminated(spark):
    words = [f"w{i % 7001}" for i in range(300_000)]
    item = [f"q{i}" for i in range(40)]
    text = " ".join(words[:200_000] + item[5:20] + words[200_000:])
    docs = spark.createDataFrame([(1, text), (2, " ".join(words))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.scan(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"]) == (300_015, 15) and not got[2]["contaminated"]


def test_jaccard(docs, no_docs, rows):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered(t)) if x]
        return set() if not w else {tuple(w)} if len(w) < 4 else set(zip(w, w[1:], w[2:], w[3:], strict=False))

    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    want = Counter((r[0], len(sets[i]), min((d for d in groups[find(i)] if d is not None), default=None) if sets[i] else r[0]) for i, r in enumerate(rows))
    assert Counter(map(tuple, jaccard.linked(docs).collect())) == want
    assert jaccard.linked(no_docs).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({c for d, n, c in want if d is not None and c == d})


def test_jaccard_of_near_copies(spark):
    """A chain of near copies whose ends are not alike is one component."""
    words = [f"t{i}" for i in range(120)]
    chain = []
    for k in range(30):
        w = list(words)
        w[k * 4] = f"new{k}"
        words = w
        chain.append((100 - k, " ".join(w)))
    got = jaccard.linked(spark.createDataFrame(chain + [(7, "far away text of its own")], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {71, 7}


def test_mixing(spark, docs, no_docs, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mixing.mix(docs)
    out = got.collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], size(r[1])) for r in rows)
    sums = defaultdict(int)
    for r in rows:
        sums[r[3]] += size(r[1])
    names = sorted((s for s in sums if s is not None), key=str.encode) + [None]
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, open_ = sum(sums.values()), {}, set(names)
    while True:
        unit = (total - sum(3 * sums[s] for s in names if s not in open_)) / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] > 3 * sums[s]}
        if not full:
            break
        open_ -= full
    target = {s: unit * weights[s] if s in open_ else 3 * sums[s] for s in names}
    source = {r[0]: r[3] for r in rows}
    taken = defaultdict(int)
    for r in out:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]]) and r["source_size"] == sums[source[r["doc_id"]]]
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[source[r["doc_id"]]] += r["taken"]
    largest = max(size(r[1]) for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest for s in names) and sum(taken.values()) <= total
    assert Counter(map(tuple, mixing.mix(docs).collect())) == Counter(map(tuple, out))
    many = mixing.mixed(docs)
    assert many.columns == docs.columns
    copies = defaultdict(int)
    for r in out:
        copies[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in many.collect()) == Counter({d: n for d, n in copies.items() if n})
    assert mixing.mix(no_docs).count() == 0
