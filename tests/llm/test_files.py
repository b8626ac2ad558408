"""WARC archives, chat formatting and the pipeline."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, components, jaccard, warc
from gridloom.llm.common import shared_path


def test_archives(spark):
    big, small = "<p>é</p>" * 200, "tiny"
    rows = [(1, "http://a/", big), (5, "u\r\nX: y", big), (3, None, big), (2, "x", small), (4, "x", small), (6, "n", None), (7, "e", ""), (None, "q", big), (8, "l", "x" * 300_000), (8, "l", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    got = sorted(map(tuple, warc.archived(spark, pages, shared_path(spark, "w")).collect()), key=repr)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        first = {1: 5, 3: 5, None: 5}.get(p) if h == big else None
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if first else "response", first))
    assert got == sorted(want, key=repr)
    assert warc.archived(spark, pages.where("false"), shared_path(spark, "w")).count() == 0


def records(n=6):
    return [warc.render(i, f"http://x/{i}", b"payload %d " % i * 50, None, "2024-01-01T00:00:00Z") for i in range(n)]


def zipped(data):
    import zlib

    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def test_salvage():
    for make in (zipped, bytes):
        parts = [make(r) for r in records()]
        whole = b"".join(parts)
        ids = lambda data: [(r.headers["warc-record-id"] if r else None) for *_, r, _ in warc.salvage(data)]
        every = [f"<urn:page:{i}>" for i in range(6)]
        assert ids(whole) == every
        starts = [sum(map(len, parts[:i])) for i in range(7)]
        hurt = bytearray(whole)
        for k in range(starts[2] + 5, starts[2] + 60):
            hurt[k] ^= 255
        assert ids(bytes(hurt)) == [*every[:2], None, *every[3:]]
        gap = next(x for x in warc.salvage(bytes(hurt)) if x[2] is None)
        assert gap[:2] == (starts[2], starts[3])
        assert ids(whole[: starts[5] + 30]) == [*every[:5], None]
        assert ids(whole[: starts[1]] + b"rubbish\nWARC/1.0 not\n" + whole[starts[1] :]) == [every[0], None, *every[1:]]
        assert ids(whole[: starts[3] - 40] + whole[starts[3] :]) == [*every[:2], None, *every[3:]]
    assert list(warc.salvage(b"")) == []


def test_plain_archives_with_gzip_bodies():
    some = [warc.render(i, f"http://x/{i}", zipped(b"body %d " % i * 50), None, "2024-01-01T00:00:00Z") for i in range(4)]
    ids = lambda data: [(r.headers["warc-record-id"] if r else None) for *_, r, _ in warc.salvage(data)]
    every = [f"<urn:page:{i}>" for i in range(4)]
    assert ids(b"".join(some)) == every
    assert ids(b"".join([some[0], b"X" + some[1][1:], *some[2:]])) == [every[0], None, *every[2:]]
    assert ids(b"".join([some[0], zipped(some[1]), some[2], zipped(some[3])])) == every


IDS = lambda data: [(r.headers["warc-record-id"] if r else None) for *_, r, _ in warc.salvage(data)]
EVERY = [f"<urn:page:{i}>" for i in range(6)]


def test_members_of_several_records(monkeypatch):
    some = records()
    whole = zipped(b"".join(some))
    assert IDS(whole) == EVERY
    assert IDS(zipped(some[0]) + b"".join(some[1:3])) == EVERY[:3]
    assert IDS(zipped(b"".join(some[:2])) + some[2] + zipped(b"".join(some[3:]))) == EVERY
    bad = b"".join([*some[:3], some[3].replace(b"payload 3", b"Payload 3"), *some[4:]])
    assert IDS(zipped(bad)) == [*EVERY[:3], None, *EVERY[4:]], "an intact member with one wrong digest"
    from_random = [warc.render(i, "u", __import__("random").Random(i).randbytes(20_000), None, "2024-01-01T00:00:00Z") for i in range(6)]
    hurt = bytearray(zipped(b"".join(from_random)))
    hurt[70_000] ^= 255
    got = IDS(bytes(hurt) + zipped(some[5]))
    assert got[:3] == EVERY[:3] and None in got and got[-1] == EVERY[5], "those that their digests prove, and what comes later"
    monkeypatch.setattr(warc, "HELD", 100)
    assert IDS(whole) == EVERY and IDS(zipped(bad)) == [*EVERY[:3], None, *EVERY[4:]], "read again instead of held"


def test_flipped_checksums():
    members = [zipped(r) for r in records(3)]
    for k in (len(members[1]) - 8, len(members[1]) - 2):
        hurt = bytearray(members[1])
        hurt[k] ^= 255
        got = list(warc.salvage(members[0] + bytes(hurt) + members[2]))
        assert sorted(r.headers["warc-record-id"] for *_, r, _ in got if r) == EVERY[:3]
        gaps = [x for x in got if x[2] is None]
        assert [x[:2] + x[3:] for x in gaps] == [(len(members[0]), len(members[0]) + len(members[1]), "gzip checksum")]


def stored(data):
    import zlib

    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def test_damaged_stored_members():
    some = [warc.render(i, f"http://x/{i}", f"payload {i} ".encode() * 400, None, "2024-01-01T00:00:00Z") for i in range(120)]
    every = sorted(f"<urn:page:{i}>" for i in range(120))
    whole = stored(b"".join(some))
    bad_sum = bytearray(whole)
    bad_sum[-6] ^= 1
    assert sorted(x for x in IDS(bytes(bad_sum)) if x) == every
    for at in (200, len(whole) // 2, len(whole) - 3000):
        hurt = bytearray(whole)
        hurt[at] ^= 1
        got = [x for x in IDS(bytes(hurt) + zipped(some[0])) if x]
        assert len(got) == len(set(got)) + (got.count("<urn:page:0>") == 2), "once each, and the first one's second copy"
        assert len(set(got)) >= 119
    cut = [x for x in IDS(whole[: len(whole) // 2]) if x]
    assert len(cut) == len(set(cut)) >= 58


def test_gzip_header_fields():
    import gzip
    import io

    out = io.BytesIO()
    with gzip.GzipFile("a name", "wb", fileobj=out) as f:
        f.write(records(1)[0])
    assert IDS(out.getvalue() + zipped(records()[1])) == EVERY[:2]
    extra = bytearray(zipped(records(1)[0]))
    extra[3] = 4 + 16
    assert IDS(bytes(extra[:10]) + b"\x03\x00abc" + b"comment\0" + bytes(extra[10:])) == EVERY[:1]
    assert IDS(bytes(extra[:3]) + b"\xff" + bytes(extra[4:])) == [None]


def test_long_and_folded_headers():
    folded = records(1)[0].replace(b"WARC-Date: ", b"WARC-Note: one\r\n two\r\n\tthree\r\nWARC-Date: ")
    long = warc.render(1, "http://x/" + "y" * (3 << 20), b"long url", None, "2024-01-01T00:00:00Z")
    for make in (zipped, bytes):
        got = [r for *_, r, _ in warc.salvage(make(folded) + make(long) + make(records()[2]))]
        assert [r.headers["warc-record-id"] for r in got] == EVERY[:3]
        assert got[0].headers["warc-note"] == "one two three" and len(got[1].headers["warc-target-uri"]) > 3 << 20


def test_first_record_with_a_gzip_body():
    some = records()
    some[0] = warc.render(0, "u", zipped(b"body" * 30), None, "2024-01-01T00:00:00Z")
    assert IDS(b"".join(some)) == EVERY


def test_a_large_archive_streams(spark, tmp_path):
    """A gigabyte, nearly all of it a hole: only blocks of it are read."""
    some = records()
    path = tmp_path / "a.warc"
    with open(path, "wb") as f:
        f.write(some[0])
        f.truncate(1 << 30)
        f.seek(0, 2)
        f.write(some[1] + zipped(b"".join(some[2:])))
    longest = 0

    def read(a, z):
        nonlocal longest
        longest = max(longest, z - a)
        with open(path, "rb") as f:
            f.seek(a)
            return f.read(z - a)

    assert IDS(warc.Archive(read, path.stat().st_size)) == [EVERY[0], None, *EVERY[1:]]
    assert longest <= warc.BLOCK
    (tmp_path / "b.warc").write_bytes(b"not in the list")
    listed = spark.createDataFrame([("a.warc",)], "file string")
    got = warc.read(spark, str(tmp_path), listed)
    assert warc.pages_of(got).count() == 6 and warc.quarantined(got).count() == 1


def test_archives_that_only_spark_opens(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(zipped, records(2))))
    (tmp_path / "b.warc").write_bytes(records(1)[0])
    assert warc.read(spark, str(tmp_path), ranges=False).count() == 3
    assert warc.read(spark, str(tmp_path), spark.createDataFrame([("b.warc",)], "file string"), ranges=False).count() == 1


def test_quarantine_log(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(zipped, records(2))) + b"tail")
    got = warc.read(spark, str(tmp_path))
    assert warc.quarantined(got).select("failed").collect()[0]["failed"] and warc.pages_of(got).count() == 2


def test_chat(spark):
    control = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", control), (1, 2, None, None), (1, 3, "assistant", "x" * 2000 + "é\n<turn role=\"user\">"), (2, None, "assistant", ""), (2, 1, "assistant", "same"), (2, 1, "assistant", "same"), (None, 0, 'a">\n', "<")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, kind string").repartition(3)
    pieces = chat.formatted(chat.log_of(df))
    got = {r["conv_id"]: r for r in chat.read_back(pieces).collect()}
    total = {r["conv_id"]: r["n"] for r in pieces.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    by = defaultdict(list)
    for c, _, role, text in rows:
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), total[c])
    assert chat.read_back(chat.formatted(chat.log_of(df.where("false")))).count() == 0


def test_long_texts_are_parsed_in_parts(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    body = "word <b> \\ é " * 1_000_000
    escape = lambda t: "".join("\\" + c if c in '\\<>"' else c for c in t)
    piece = f'<turn role="assistant">\n{escape(body)}\n</turn>\n'
    head = len('<turn role="assistant">\n')
    batch = pa.RecordBatch.from_pydict({"conv_id": [1], "formatted": [piece], "loss_from": [head], "loss_to": [len(piece) - len("\n</turn>\n")]})
    tracemalloc.start()
    got = next(chat.digested(iter([batch]))).to_pylist()[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["turns_sha256"] == hashlib.sha256(f"assistant\n{body}\n".encode()).hexdigest()
    assert (got["loss_sha256"], got["loss_chars"]) == (hashlib.sha256(body.encode()).hexdigest(), len(body))
    assert peak < 4 * len(piece) * 2
    monkeypatch.setattr(chat, "CHUNK", 3)
    for text in ('a\\"b<>', "\\" * 7 + "x", "", "plain", "<" * 9):
        assert "".join(chat.plain(escape(text), 0, len(escape(text)))) == text
    for bad in ("a<b", "abc\\", 'x"', "ab>"):
        with pytest.raises(ValueError):
            list(chat.plain(bad, 0, len(bad)))
    for bad in ("", "<turn role=", '<turn role="u">\n</turn>\n', 'x<turn role="u">\nt\n</turn>\n'):
        with pytest.raises(ValueError):
            chat.parts_of(bad)


def test_events_delivered_again_count_once(spark):
    m = (0, 0)
    events = [(1, m, 0, "start", "user", None), (1, m, 1, "delta", None, "ab"), (1, m, 1, "delta", None, "ab"), (1, m, 2, "delta", None, "c"), (1, m, 0, "start", "user", None), (1, m, 2, "delta", None, "c")]
    log = spark.createDataFrame(events, chat.EVENTS).repartition(3)
    assert [(r["role"], r["text"]) for r in chat.folded(log).collect()] == [("user", "abc")]


def test_the_log_has_events_to_undo(spark):
    rows = [(i % 7, i, ("user", "assistant")[i % 2], f"text {i} " * (1 + i % 40) + "😀" * (i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.log_of(df, delta=16, deltas=8).cache()
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert all(kinds[k] > 20 for k in ("edit", "regenerate", "retract"))
    assert log.groupBy("conv_id", "message").count().agg(F.max("count")).first()[0] <= 8 + 5
    got = chat.folded(log.repartition(5)).select("conv_id", "message.turn", "role", "text").collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_a_turn_with_many_rows_is_numbered(spark):
    rows = [(1, None, "user", f"t{i % 300}") for i in range(400)] + [(1, 2, "b", "x"), (1, 2, "a", "x")]
    got = chat.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r["k"] for r in got if r["turn"] is None) == list(range(400))
    assert {(r["role"], r["k"]) for r in got if r["turn"] == 2} == {("a", 0), ("b", 1)}


def test_events_are_folded(spark):
    m = [(0, 0), (1, 0), (2, 0)]
    log = [
        (1, m[0], 0, "start", "user", None), (1, m[0], 2, "delta", None, "lo"), (1, m[0], 1, "delta", None, "hel"),
        (1, m[1], 0, "start", "assistant", None), (1, m[1], 1, "delta", None, "bad"), (1, m[1], 2, "regenerate", None, None), (1, m[1], 3, "delta", None, "good"), (1, m[1], 4, "edit", None, "better"), (1, m[1], 5, "delta", None, "!"),
        (1, m[2], 0, "start", "assistant", None), (1, m[2], 1, "delta", None, "gone"), (1, m[2], 2, "retract", None, None),
    ]
    got = chat.folded(spark.createDataFrame(log, chat.EVENTS)).orderBy("message").collect()
    assert [(r["role"], r["text"]) for r in got] == [("user", "hello"), ("assistant", "better!")]


def test_small_tables_are_few_files(spark):
    import glob

    from gridloom.llm.common import FILE_ROWS, written

    rows, cores = spark.range(5000).repartition(32), spark.sparkContext.defaultParallelism
    for most, files in ((None, 32), (FILE_ROWS * 9 + 1, max(10, cores)), (1, cores), (0, cores), (10**9, 32)):
        out = written(rows, "few", most)
        assert out.count() == 5000 and len(glob.glob(out.written_at.removeprefix("file:") + "/*.parquet")) == files
    path = [(k, k + 1) for k in range(300)]
    assert len(glob.glob(components.components(spark.createDataFrame(path, "x long, y long").repartition(16)).inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0] + "/*.parquet")) <= cores


def test_components(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "x long, y long")).collect()))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_pipeline_takes_near_copies_of_five_words(spark):
    """Two of 100 words changed: 0.81 of the 5-word shingles are common, and 0.848 of the 4-word ones."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    other = [{30: "new", 60: "word"}.get(i, w) for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words), "a"), (2, " ".join(other), "b"), (3, "another text that stays", "c")], "doc_id long, text string, source string")
    assert len({r["component_id"] for r in jaccard.linked(df).collect()}) == 3, "op9 keeps its contract"
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixture", "token_ids"]
    out = corpus_pipeline.run(spark, sf)
    rows = out.orderBy("start").collect()
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert 0 < len({r["doc_id"] for r in rows}) < spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_by_brute_force(spark, tmp_path):
    """All stages on a table with nulls, copies, a contaminated document and further columns: who stays, and what the files say."""
    import random
    from zlib import crc32

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(6)
    words = [f"{a}{b}" for a in "ka lo mi ru te po".split() for b in "nor bel sti van duk lim".split()]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    leaked = said(14)
    rows = [(i, said(60), ["a", "b", None][i % 3]) for i in range(40)]
    rows += [(100, rows[3][1], "a"), (101, rows[4][1] + " more", "b"), (102, f"{said(30)} {leaked} {said(30)}", "b"), (103, None, "a"), (104, "", None), (None, said(60), "b")]
    spark.createDataFrame([(i, t, "en", s, 0, "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leaked), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Labels of one class teach nothing, so that all documents are kept; of copies the smallest id stays.
    stay = {i: (t or "", s) for i, t, s in rows if i not in (100, 101, 102)}
    size = {i: len(t.split()) for i, (t, _) in stay.items()}
    per = {s: sum(size[i] for i, (_, x) in stay.items() if x == s) for s in ("a", "b", None)}
    total, weights = sum(per.values()), {"a": 1, "b": 2, None: 3}
    targets = {s: total * w / 6 for s, w in weights.items()}
    assert all(targets[s] <= 3 * per[s] for s in per)
    times, taken = Counter(r["doc_id"] for r in got), Counter()
    assert set(times) <= set(stay) and all(n <= 3 for n in times.values()) and not {103, 104} & set(times)
    for i, n in times.items():
        taken[stay[i][1]] += n * size[i]
    assert all(abs(taken[s] - targets[s]) <= 60 for s in per)
    tokenizer, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for r in sorted(got, key=lambda r: r["start"]):
        ids = [*tokenizer.encode(stay[r["doc_id"]][0], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        at += len(ids)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
