"""Resampling, collocations and toxicity against brute force and held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import collocations, resampling, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def drawn_by_hand(rows, target, how):
    bucket = lambda w: zlib.crc32(w.encode()) % how.buckets
    words = [[bucket(w) for w in WORD.findall(lowered(t))] for _, t, *_ in rows]
    s, t = Counter(b for w in words for b in w), Counter(bucket(w) for _, x, *_ in target for w in WORD.findall(lowered(x)))
    n_s, n_t = sum(s.values()) + how.buckets, sum(t.values()) + how.buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t)))
    out = []
    for (doc_id, *_), own in zip(rows, words, strict=True):
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= how.least), key=lambda r: (-r[3], r[0] is None, r[0]))
    return out, able[: len(able) * how.percent // 100]


@pytest.mark.parametrize("how", [resampling.Draw(least=5, percent=50), resampling.Draw(buckets=7, least=1, percent=90), resampling.Draw(percent=100)])
def test_resampling(docs, benchmark, rows, how):
    got = resampling.resampled(docs, benchmark, how).collect()
    every, drawn = drawn_by_hand(rows, benchmark.collect(), how)
    assert Counter(tuple(r)[:4] for r in got) == Counter(every)
    assert [tuple(r)[:4] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_resampling_keeps_rows(docs, no_docs, benchmark, rows):
    how = resampling.Draw(least=5, percent=50)
    kept = resampling.drawn(docs, benchmark, how)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in drawn_by_hand(rows, benchmark.collect(), how)[1])
    assert resampling.resampled(no_docs, benchmark).count() == 0
    assert {r["weight"] for r in resampling.resampled(no_docs.union(docs), benchmark.where("false")).collect()} is not None


def test_pieces_of_long_texts_end_between_words(monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 7)
    for text in ("a bb ccc dddd", "x" * 50, " " * 20, "", "é" * 9 + " ok " + "y" * 30 + "!z", "ab  "):
        assert [w for p in resampling.pieces(text.encode()) for w in p] == [w.encode() for w in WORD.findall(lowered(text))]


def mined_by_hand(rows, how):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, how.longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        many = {p: c for p, c in counts.items() if len(p) > 1 and c >= how.least}
        inside = defaultdict(int)
        for p, c in many.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        found = []
        for p, a in many.items():
            if inside[p] < a:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, x, y, n[lang], -score) for k, (score, a, p, x, y) in enumerate(sorted(found)[: how.first], 1)]
    return out


@pytest.mark.parametrize("how", [collocations.Mining(least=2), collocations.Mining(least=3, first=4), collocations.Mining(least=10, longest=3), collocations.Mining(least=2, bits=1 << 16, bits_each=1)])
def test_collocations(docs, rows, how):
    got = sorted(map(tuple, collocations.collocations(docs, how).collect()))
    assert got == sorted(mined_by_hand(rows, how))
    assert got


def test_collocations_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(collocations, "STRETCH", 3)
    rows = [(1, "a b c a b c d a b c a b " * 5 + ", a b c a b", "x"), (2, "a b c a b c d a b", None), (2, "a b c a b c d a b", None), (3, "\t \n", "x"), (4, None, "x")]
    how = collocations.Mining(least=2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = collocations.pieces_of(docs, how)
    words = Counter()
    for r in own.collect():
        assert len(bytes(r["piece"]).split()) <= 3 + how.longest - 1
        words[r["lang"]] += r["starts"] * r["m"]
    assert words == {"x": 65, "und": 18}


def test_collocations_of_nothing(no_docs, docs):
    assert collocations.collocations(no_docs).count() == 0
    assert collocations.collocations(docs.where("doc_id = 0")).count() == 0


def test_counted_by_levels():
    pieces, times = [b"a b a b a", b"b a b"], [3, 1 << 60]
    lang, phrase, f = collocations.counted(["x", "y"], [5, 2], pieces, times, 2, [])
    assert Counter(dict(zip(zip(lang, phrase, strict=True), f, strict=True))) == {("x", b"a b"): 6, ("x", b"b a"): 6, ("y", b"b a"): 1 << 60, ("y", b"a b"): 1 << 60}


def test_a_text_of_many_pieces_is_one_row(spark):
    rows = [(i, ", ".join(f"own{i} words{j} here" for j in range(50)), "x") for i in [*range(20), 7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    own = collocations.pieces_of(docs).collect()
    assert len(own) == 20 and sum(r["starts"] * r["m"] for r in own) == 21 * 150
    assert all(len(re.findall(rb"[^\n]+", bytes(r["piece"]))) == 50 for r in own)


def test_words_of_bytes(monkeypatch):
    texts = ["a,b,c,d,e,f,g,h", "A b\tÄ", "\x1c x.y", "", ",;", "a b" * 9 + "! c d.e " * 5, " b a ", "é\x85ü \r"]
    pieces = [[x.split() for x in re.split(rb"[.,;:!?\x0A-\x0D]", lowered(t).encode()) if x.split()] for t in texts]
    want = [(w, i == len(p) - 1) for text in pieces for p in text for i, w in enumerate(p)]
    w = collocations.Words(pa.array(["x"] * len(texts)), pa.array([t.encode() for t in texts]))
    assert [(w.names[i].as_py(), bool(e)) for i, e in zip(w.word, w.last, strict=True)] == want
    at = w.begins(3, [])
    assert w.places(at, 3).tolist() == [collocations.place_of("x", p.as_py()) for p in w.phrases(at, 3)]
    monkeypatch.setattr(collocations, "LOT", 8)
    rows = pa.RecordBatch.from_arrays([pa.array(["x"] * len(texts)), pa.array([99, *[collocations.WHOLE] * (len(texts) - 1)], pa.int32()), pa.array([t.encode() for t in texts]), pa.array([1] * len(texts))], schema=collocations.PIECE)
    lots = list(collocations.in_lots(iter([rows.slice(0, 0), rows])))
    assert [sum(len(lot[i]) for lot in lots) > len(texts) for i in range(4)] == [True] * 4
    assert lots[0][2][0].as_py() == texts[0].encode()
    for n in (1, 2, 3):
        got = Counter()
        for lot in lots:
            for _, phrase, f in zip(*(x.to_pylist() for x in collocations.counted_rows(*lot, n, [])), strict=True):
                got[phrase] += f
        want = Counter(b" ".join(p[i : i + n]) for text in pieces for p in text for i in range(len(p) - n + 1))
        assert got == want + Counter({b"": want.total() if n == 1 else 0})


@pytest.mark.parametrize("bits", [1 << 16, 1 << 20])
def test_buckets_keep_all_frequent_pairs(spark, bits):
    rows = [(i, f"{'a b, ' * 150} {'c d. ' * 149} e{i} f g a", "x") for i in range(2)]
    how = collocations.Mining(least=300, bits=bits)
    texts = collocations.whole(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2))
    found = collocations.Filter.of_buckets(texts, [], how)
    has = lambda p: bool(found.has(np.array([collocations.place_of("x", p)], np.uint64))[0])
    assert has(b"a b") and not has(b"c d") and not has(b"f g")


@pytest.fixture(scope="module")
def spoken(spark):
    """Documents of clean sentences; the toxic ones hold one sentence with one of a few words, some of them in endings of their own."""
    rng, plain, bad = np.random.default_rng(5), [f"{a}{b}" for a in "ka lo mi ru te".split() for b in "nor bel sti van duk".split()], "grubfoot snarkle wretchup".split()
    rows, labels = [], []
    for i in range(600):
        said = [" ".join(rng.choice(plain, 6)) for _ in range(rng.integers(1, 12))]
        if toxic := i % 4 == 0:
            k = rng.integers(len(said))
            said[k] += f" {bad[i % 3]}{'' if i % 8 else chr(97 + i % 26)} {rng.choice(plain)}"
        rows.append((i, ". ".join(said) + ".", "en", "s", 1))
        labels.append((i, int(rng.random() < 0.5), int(toxic)))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (None, "you grubfoot", "x", None, None), rows[0], rows[0], (1002, "Lonor mibel. You SNARKLE! tevan", None, None, None)]
    labels += [(3, 0, 1), (None, 1, 1), (4, 0, None), (8, 0, 1), (8, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, n_sentences int").repartition(3).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_toxicity(spoken):
    docs, labels, rows = spoken
    got = toxicity.classify(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["held_out"]]
    assert {r["held_out"] for r in got if r["doc_id"] == 7} == {zlib.crc32(b"7") % 5 == 0} and len(held) > 80
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        if r["predicted"]:
            spans = [text[r["doc_id"]][int(a) : int(z)] for a, z in (s.split(":") for s in r["offending"].split(","))]
            assert len(spans) == r["n_offending"] and any(re.search("(?i)grubfoot|snarkle|wretchup", s) for s in spans)
    by_id = {r["doc_id"]: r for r in got}
    assert (by_id[1000]["score"], by_id[1000]["n_sentences"], by_id[1001]["offending"]) == (0.0, 0, "")
    assert by_id[None]["predicted"] == 1 and not by_id[None]["held_out"] and by_id[1002]["offending"] == "13:25"


def test_toxicity_keeps_clean_rows(spoken):
    docs, labels, rows = spoken
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    gone = {r[0] for r in rows} - {r["doc_id"] for r in kept.collect()}
    assert len([d for d in gone if d is None or d % 4]) <= 5 and len(gone) > 140


def test_toxicity_without_a_model(spoken, no_docs):
    docs, labels, rows = spoken
    assert {r["score"] for r in toxicity.classify(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.clean(docs, labels.where("false")).count() == len(rows)
    assert toxicity.classify(no_docs, labels).count() == 0


def test_gradient_is_the_slope_of_the_loss():
    import pyarrow as pa

    found = [np.array(x, np.int16).tobytes() for x in ([0, 1, -1, 2, -1], [], [1, 1, -1])]
    table = pa.table({"y": pa.array([1, 0, 0], pa.int32()), "plain": pa.array([2, 3, 0], pa.int64()), "found": pa.array(found, pa.binary())})
    at = np.array([-1.0, 0.5, -0.25, 1.5])
    got, eps = toxicity.gradient(table, at[0], at[1:]), 1e-6
    for k in range(4):
        step = np.zeros(4)
        step[k] = eps
        up, down = (toxicity.gradient(table, (at + s)[0], (at + s)[1:])[1] for s in (step, -step))
        assert got[2 + k] == pytest.approx((up - down) / (2 * eps), rel=1e-4)
    assert got[0] == 3


def test_fit_is_bounded(spoken):
    docs, labels, _ = spoken
    few = toxicity.training(docs, labels, toxicity.Fit(sample=100))
    assert 50 < few.count() < 160
    assert few.where(F.col("text").isNull()).count() == 0
