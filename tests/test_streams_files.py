"""Chunk streams, ranges with margins, files, directories, the command line and the guard."""

import io
import json
import random
import socket
import time
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmask import cli
from quillmask.functions import netguard
from quillmask.functions.entities import Policy, settings
from quillmask.functions.local import Later, LocalEngine, Span
from quillmask.operators import arrow_tiers, evaluate
from quillmask.operators.engine import Masker, register_sql
from quillmask.sources import config, corpora, files, ranges
from quillmask.streaming import chunks, halo, keyed
from quillmask.streaming.windows import segments

def _generated(seed: int, parts: int = 40) -> str:
    rng = random.Random(seed)
    bits = ["kim@example.org", "5500 0000 0000 0004", "social security 219-09-9999", "172.16.0.9", "sk_live_" + "a1B2" * 6, "no news", "\n", "é", "z" * 30]
    return " ".join(rng.choice(bits) for _ in range(parts))


TEXT = _generated(7)


@pytest.mark.parametrize("seed", range(6))
def test_any_split_equals_whole(seed):
    rng, text, chosen = random.Random(seed), _generated(seed), settings(overlap=128)
    cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.choice((0, 2, 9, 60, 400))))
    chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
    assert "".join(files.redact_stream(chunks, chosen)) == LocalEngine(chosen).redact(text)


def test_segments_add_up():
    engine = LocalEngine(settings(types=["email"]))
    text = _generated(3)
    at = 0
    for base, segment, spans in segments([text[i : i + 33] for i in range(0, len(text), 33)], engine.detect, 32):
        assert base == at and all(segment[s.start : s.end] == s.text for s in spans)
        at += len(segment)
    assert at == len(text) and list(segments(["", ""], engine.detect, 4)) == []
    with pytest.raises(ValueError):
        segments([], engine.detect, -1)


def test_memory_does_not_follow_the_file(tmp_path):
    path, line = tmp_path / "log", "10.1.2.3 card 4111 1111 1111 1111 ok\n"
    path.write_text(line * 60_000)
    tracemalloc.start()
    files.redact_file(path, tmp_path / "out", settings(types=["ipv4"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20


def test_keyed_state(spark, tmp_path):
    chosen = settings(overlap=64)
    rows = [(d, i // 9, TEXT[i : i + 9], i + 9 >= len(TEXT)) for d in (1, 2) for i in range(0, len(TEXT), 9)]
    random.Random(1).shuffle(rows)
    source = tmp_path / "in"
    schema = "doc_id long, chunk_no long, text string, is_last boolean"
    for part in (rows[::2], rows[1::2], rows[:7]):  # the last ones come again after the end
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = keyed.redact_chunks(stream, chosen).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    got = spark.table("kept").collect()
    want = LocalEngine(chosen).redact(TEXT)
    for d in (1, 2):
        assert "".join(r["redacted"] for r in sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["seg_no"])) == want
    # The stream and the table give the same text and detections of repeated, shuffled and late chunks.
    table = chunks.redact_chunk_table(spark.createDataFrame([*rows, *rows[:5], (1, 10**6, "after@the.end", False)], schema), chosen, 50).filter("doc_id = 1").orderBy("seg_no").collect()
    assert "".join(r["redacted"] for r in table) == want
    place = lambda rs: sorted((r["base_offset"] + d["start"], d["text"], d["entity_type"]) for r in rs for d in r["detections"])
    assert place(table) == place([r for r in got if r["doc_id"] == 1])


CHUNKS = "doc_id long, chunk_no long, text string, is_last boolean"


def _fed(spark, tmp_path, parts, chosen=None):
    """Segments and state rows written of each trigger; one start of the query a part, from its checkpoint."""
    rows, written = [], []
    for part in parts:
        spark.createDataFrame(part, CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in"))
        found = keyed.redact_chunks(stream, chosen or settings(overlap=64))
        query = found.writeStream.foreachBatch(lambda frame, _: rows.extend(frame.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        written.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]))
    return rows, written


def test_keyed_state_over_restarts(spark, tmp_path):
    """The first chunk comes last: a trigger writes what came in it, however much waits."""
    pieces = [TEXT[i : i + 5] for i in range(0, 600, 5)]
    rows = [(1, i, t, i == len(pieces) - 1) for i, t in enumerate(pieces)]
    parts = [rows[-40:], rows[40:80], rows[10:40], [*rows[1:10], *rows[50:60]], rows[:1]]
    got, written = _fed(spark, tmp_path, parts)
    assert "".join(r["redacted"] for r in sorted(got, key=lambda r: r["seg_no"])) == LocalEngine(settings(overlap=64)).redact(TEXT[:600])
    assert all(n <= len(part) + 3 for n, part in zip(written[:-1], parts, strict=False))


def test_keyed_state_times_out(spark, tmp_path):
    """What is held of a document without an end comes out after the timeout, and its state is gone."""
    rows, source = [], str(tmp_path / "in")
    put = lambda part: spark.createDataFrame(part, CHUNKS).coalesce(1).write.mode("append").parquet(source)
    put([(1, 0, "to joe@corp.io", None), (2, 3, "ahead", None), (3, 0, "end", True)])
    found = keyed.redact_chunks(spark.readStream.schema(CHUNKS).parquet(source), settings(overlap=64), 2000)
    # Batches go on without input, so that time passes; the query is stopped here.
    query = found.writeStream.foreachBatch(lambda frame, _: rows.extend(frame.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()

    def until(n):
        for _ in range(120):
            if len(rows) >= n or query.exception():
                return
            time.sleep(0.5)

    try:
        until(2)
        put([(1, 0, "anew", True), (2, 0, "first", True)])
        until(4)
    finally:
        query.stop()
    assert sorted((r["doc_id"], r["redacted"]) for r in rows) == [(1, "anew"), (1, "to [REDACTED]"), (2, "first"), (3, "end")]


def test_detectors_cannot_connect(spark, tmp_path):
    """In the Arrow tier, SQL functions, streams of chunks and trees."""

    class Caller:
        """Asks another machine, at an address that nobody has."""

        name = "caller"

        def detect(self, text):
            import socket

            socket.create_connection(("192.0.2.1", 9), timeout=2)
            return []

    chosen = settings(types=(), extra_detectors=(Caller(),), load_plugins=False)
    masker, frame = Masker(chosen), spark.createDataFrame([("a text",)], "text string")
    register_sql(spark, masker)
    (tmp_path / "in").mkdir()
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.txt").write_text("a text")
    ways = [
        lambda: masker.redact(frame).collect(),
        lambda: spark.sql("SELECT quill_redact('a text')").collect(),
        lambda: spark.sql("SELECT * FROM quill_detect('a text')").collect(),
        lambda: _fed(spark, tmp_path, [[(1, 0, "a text", True)]], chosen),
        lambda: files.redact_tree(spark, str(tmp_path / "tree"), str(tmp_path / "out"), chosen),
    ]
    for way in ways:
        with pytest.raises(Exception, match="is blocked while redacting|Blocked"):
            way()
    assert not netguard.is_installed()


def test_sql_table_function(spark):
    masker = Masker()
    register_sql(spark, masker)
    frame = spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "doc_id long, text string")
    got = spark.sql("SELECT d.doc_id, s.* FROM {d} d, LATERAL quill_detect(d.text) s", d=frame)
    want = masker.spans(frame, ["doc_id"]).drop("ord")
    assert got.schema == want.schema or [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 3
    with pytest.raises(Exception, match="takes a string"):
        spark.sql("SELECT * FROM quill_detect(5)").collect()


def test_language_model_in_batches(spark, tmp_path):
    """One load and few calls; texts in order of length, results in the order of the texts."""
    calls = []

    class Pipe:
        def pipe(self, texts, batch_size):
            calls.append(list(texts))
            entity = lambda t: type("E", (), {"start_char": 0, "end_char": len(t), "text": t, "label_": "PERSON"})
            return [type("D", (), {"ents": [entity(t)]}) for t in texts]

    detector = arrow_tiers.NerDetector()
    detector._pipe = Pipe()
    texts = ["ccc", "", "a", " ", "bb" * 150_000, "bb"] + ["x" * (1 + i % 7) for i in range(200)]
    assert [[s.text for s in found] for found in detector.detect_all(texts)] == [[t] if t.strip() else [] for t in texts]
    assert [len(t) for c in calls for t in c] == sorted(len(t) for t in texts if t.strip())
    assert max(map(len, calls)) == arrow_tiers.NER_TEXTS and all(sum(map(len, c)) <= arrow_tiers.NER_CHARS or len(c) == 1 for c in calls)
    log = str(tmp_path / "log")

    class Batched:
        name = "batched"

        def detect(self, text):
            raise AssertionError("one at a time")

        def detect_all(self, texts):
            with open(log, "a") as out:
                out.write(f"{len(texts)}\n")
            return [[Span(0, len(t), t, "org", 0.7, self.name)] if t == "Acme" else [] for t in texts]

    frame = spark.createDataFrame([("Acme",), (None,), ("",), ("none",)] * 50, "text string").coalesce(1)
    found = Masker(types=(), extra_detectors=(Batched(),), load_plugins=False).detect(frame).collect()
    assert [len(r["detections"]) for r in found] == [1, 0, 0, 0] * 50
    with open(log) as lines:
        assert [int(n) for n in lines] == [150]


def test_listings(spark):
    spans = spark.createDataFrame([("email", 3, 9, "a@b.io", 0.98765, "deterministic"), ("credit_card", 0, 2, 'q"é', 1.0, "custom")], "entity_type string, start int, end int, text string, confidence double, source string")
    assert [r["value"] for r in files.listing_json(spans).collect()] == [
        '{"type":"email","start":3,"end":9,"text":"a@b.io","confidence":0.988,"source":"deterministic"}',
        '{"type":"credit_card","start":0,"end":2,"text":"q\\"é","confidence":1.0,"source":"custom"}',
    ]
    assert [r["value"] for r in files.listing_text(spans).collect()] == ["        email  conf=0.99  'a@b.io'", "  credit_card  conf=1.00  'q\"é'"]


def test_ranges_equal_whole(spark):
    rng = random.Random(2)
    bits = ["a@corp.io", "4111 1111 1111 1111", "ssn 219-09-9999", "10.1.2.3", "call 415-555-2671", "x" * 90, "\n", " ", "test", "key=abcdEFGH12345678", "é"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(30)] + ["", "a1" * 400, None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    masker = Masker()
    for size in (40, 300):
        got = {r["doc_id"]: r["redacted"] for r in halo.halo_redact(frame, masker, size, 128).collect()}
        assert got == {i: t if t is None else masker.redact_text(t) for i, t in enumerate(texts)}


def test_ranges_of_texts_without_an_id_or_that_share_one(spark):
    rows = [(None, "mail joe@corp.io now", 1), (None, "no mail", 2), (2, "a@b.io xx yyyy", 3), (2, "wwwwwwwwwwww q@z.io", 4), (2, "a@b.io xx yyyy", 5), (3, None, 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, found int").withColumn("_text1", F.lit(0))
    masker = Masker()
    got = sorted(((r["doc_id"] or 0, r["redacted"], len(r["detections"])) for r in halo.halo_redact(frame, masker, 8, 4).collect()), key=str)
    want = sorted(((i or 0, t if t is None else masker.redact_text(t), 0 if t is None else len(masker.detect_text(t))) for i, t, _ in rows), key=str)
    assert got == want and sum(n for *_, n in got) == 4


def test_chunk_table_keys_and_engines(spark):
    rows = [(k, i, t, i == 2) for k in ("a", "b", None) for i, t in enumerate(("to kim@exa", None, "mple.org ok"))]
    rows += [("a", 1, None, False), ("a", 3, "late", True), ("a", None, "no number", True), ("b", -1, "below", True), ("c", 0, None, True), ("d", 4, "x@y.io", None), ("d", 9, " z", None)]
    frame = spark.createDataFrame(rows, "doc_id string, chunk_no int, text string, is_last boolean").repartition(3)
    got = chunks.redact_chunk_table(frame, settings(overlap=64)).collect()
    text = lambda k: "".join(r["redacted"] for r in sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["seg_no"]))
    assert {k: text(k) for k in ("a", "b", None, "c", "d")} == {**dict.fromkeys(("a", "b", None), "to [REDACTED] ok"), "c": "", "d": "[REDACTED] z"}
    assert chunks.redact_chunk_table(frame.limit(0), settings()).collect() == []
    later = Later(settings())
    assert later() is later()


@pytest.mark.parametrize(("width", "size"), [(7, 150), (1000, 190), (64, 5000)])
def test_chunk_table_equals_whole_text(spark, width, size):
    """All tiers, chunks smaller and larger than ranges, margins and spans; overlapping spans at edges."""
    rng = random.Random(width)
    bits = ["a@corp.io", "4111 1111 1111 1111", "ssn 219-09-9999", "10.1.2.3", "call 415-555-2671", "x" * 40, "\n", " ", "test", "key=abcdEFGH12345678", "é", "\U0001f600", "\r"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(120))) for _ in range(25)] + ["", "a1 " * 400]
    rows = [(d, i // width, t[i : i + width], i + width >= len(t)) for d, t in enumerate(texts) for i in range(0, max(len(t), 1), width)]
    rng.shuffle(rows)
    chosen = settings(overlap=160)
    frame = spark.createDataFrame(rows, "doc_id long, chunk_no long, text string, is_last boolean").repartition(4)
    got = chunks.redact_chunk_table(frame, chosen, size).collect()
    engine = LocalEngine(chosen)
    for d, t in enumerate(texts):
        mine = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["seg_no"])
        assert "".join(r["segment"] for r in mine) == t and "".join(r["redacted"] for r in mine) == engine.redact(t)
        assert [r["base_offset"] for r in mine] == [sum(len(x["segment"]) for x in mine[:k]) for k in range(len(mine))]
        want = [(s.start, s.end, s.text, s.entity_type, s.meta) for s in engine.detect(t)]
        assert [(r["base_offset"] + x["start"], r["base_offset"] + x["end"], x["text"], x["entity_type"], x["meta"]) for r in mine for x in r["detections"]] == want


def test_chunk_table_of_one_long_document(spark):
    """100,000 chunks of one document: no task holds more than its share. (Small tasks are not joined here.)"""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    frame = spark.range(100_000).selectExpr("1 doc_id", "id chunk_no", "concat('line ', id, if(id % 10 = 0, ' joe@corp.io', ''), '\n') text", "id = 99999 is_last")
    found = chunks.redact_chunk_table(frame, settings(types=("email",), overlap=128), 1 << 14).withColumn("task", F.spark_partition_id())
    rows = found.select("seg_no", "base_offset", F.length("segment").alias("n"), F.size("detections").alias("k"), "task").orderBy("seg_no").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["k"] for r in rows) == 10_000 and len({r["task"] for r in rows}) > 1
    assert all(a["base_offset"] + a["n"] == b["base_offset"] for a, b in zip(rows, rows[1:], strict=False))


def test_tree_and_texts(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / ".hidden").write_text("a@b.io")
    (tmp_path / "in" / "sub" / "b.txt").write_bytes(b"a@b.io\r\nbad \xff end\r")
    done = files.redact_tree(spark, str(tmp_path / "in"), str(tmp_path / "out"), settings()).collect()
    assert [r["input_path"].rpartition("/")[2] for r in done] == [".hidden", "b.txt"]
    assert (tmp_path / "out/sub/b.txt").read_bytes() == "[REDACTED]\nbad � end\n".encode() and done[0]["bytes_written"] == 10
    (row,) = files.read_texts(spark, str(tmp_path / "in" / "sub")).collect()
    assert row["text"] == "a@b.io\nbad � end\n"
    (tmp_path / "none").mkdir()
    assert files.redact_tree(spark, str(tmp_path / "none"), str(tmp_path / "o2"), settings()).collect() == []
    assert not netguard.is_installed()


ODD_BYTES = [
    b"", b"\n", b"\r\n", b"one line", b"a\r\nb\rc\n\r\n", b"\xff" * 40, "é\U0001f600ab".encode() * 30, b"\xe2\x82" * 20, "日本".encode() * 9 + b"\n" + b"\x80" * 11,
    b"joe@corp.io\r\n" * 30, b"x\r" * 30, b"\xf0\x9f\x98" + b"\n" * 9, "\U0001f600".encode()[:3] + b"tail",
]


@pytest.mark.parametrize("look", [4, 7, 1 << 16])
def test_edges_of_ranges(tmp_path, monkeypatch, look):
    """Ranges join to the file's text, wherever they are cut: bad bytes, CRLF, long and empty lines."""
    monkeypatch.setattr(ranges, "LOOK", look)
    for k, raw in enumerate([*ODD_BYTES, b"".join(ODD_BYTES)]):
        path = tmp_path / f"{k}.txt"
        path.write_bytes(raw)
        for size in (1, 2, 3, 5, 17, 1000):
            for keep in (False, True):
                reader = ranges.TextReader({"path": str(path), "rangeBytes": str(size), "keepNewlines": str(keep)})
                rows = sorted((r for share in reader.partitions() for r in reader.read(share)), key=lambda r: r[1])
                with open(path, encoding="utf-8", errors="replace", newline="" if keep else None) as file:
                    assert "".join(r[2] for r in rows) == file.read()
                assert [r[3] for r in rows] == [False] * (len(rows) - 1) + [True]


def test_shares_are_even():
    """One large file among a thousand small ones: no task gets more than twice the mean."""
    files_ = [("large", 1 << 30), *((f"s{i}", 1000 + i) for i in range(1000)), ("none", 0)]
    dealt = ranges.shares(files_, 8 << 20)
    held = [sum(r[3] - r[2] for r in share.ranges) for share in dealt]
    assert len(dealt) > 100 and max(held) <= 2 * sum(held) / len(held)
    assert sum(held) == sum(n for _, n in files_) and len([r for share in dealt for r in share.ranges if r[0] == "none"]) == 1


def test_files_in_ranges(spark, tmp_path):
    """Files larger than a range, empty ones and a tree, as the file-by-file form writes them."""
    (tmp_path / "in" / "sub").mkdir(parents=True)
    rng = random.Random(4)
    bits = [b"a@corp.io", b"4111 1111 1111 1111", b"card", b"\r\n", b"\n", b"\xff", "é".encode(), b"10.1.2.3"]
    (tmp_path / "in" / "a.txt").write_bytes(b" ".join(rng.choice(bits) for _ in range(4000)))
    (tmp_path / "in" / "sub" / ".b").write_bytes(b"")
    (tmp_path / "in" / "sub" / "c it's.txt").write_bytes(b"to joe@corp.io\r\nend")
    chosen = settings(types=("email", "ipv4", "credit_card"), overlap=256, chunk_size=2000)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    done = {r["input_path"]: (r["output_path"], r["bytes_written"]) for r in ranges.redact_files(spark, source, target, chosen, 3000).collect()}
    assert ranges.read_ranges(spark, source, 3000).filter("path like '%a.txt'").count() > 5
    for a, b in files.tree_jobs(source, target):
        files.redact_file(a, str(tmp_path / "want"), chosen)
        with open(b, "rb") as got, open(tmp_path / "want", "rb") as want:
            assert got.read() == want.read()
        assert done.pop(a) == (b, (tmp_path / "want").stat().st_size)
    assert not done and sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == [".b", "a.txt", "c it's.txt"]
    with pytest.raises(ValueError):
        ranges.redact_files(spark, source, source + "/sub", chosen)


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    """A task that fails half-way leaves nothing; a second run gives the same bytes."""
    rows = spark.range(3000).selectExpr("'f.txt' path", "id seg_no", "cast(concat('row ', id, char(10)) as binary) content")
    broken = rows.withColumn("content", F.when(F.col("seg_no") == 2500, F.raise_error("half-way").cast("binary")).otherwise(F.col("content")))
    ranges.register(spark)
    with pytest.raises(Exception, match="half-way"):
        made = ranges.placed(rows).withColumn("content", F.when(F.col("at") > 15000, F.raise_error("half-way").cast("binary")).otherwise(F.col("content")))
        made.repartition(4).write.format(ranges.NAME).mode("append").save(str(tmp_path / "out"))
    with pytest.raises(Exception, match="half-way"):
        ranges.write_files(broken, str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    for _ in range(2):
        ranges.write_files(rows.repartition(5), str(tmp_path / "out"))
        assert (tmp_path / "out" / "f.txt").read_text() == "".join(f"row {i}\n" for i in range(3000))
    writer = ranges.TextWriter({"path": str(tmp_path / "out"), "run": "r"})
    message = writer.write(iter([type("R", (), {"path": "g", "at": 5, "content": b"abc"})()]))
    with pytest.raises(OSError, match="not whole"):
        writer.commit([message, None])
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["f.txt"]


def test_workers():
    chosen = settings()
    assert files.workers(0, 8, None, chosen) == 1 and files.workers(3, 8, None, chosen) == 3
    assert files.workers(None, 8, 10 << 30, chosen) == 8 and files.workers(None, 8, 150 << 20, chosen) == 1


def test_command_line(tmp_path, capsys, monkeypatch):
    source, target = tmp_path / "a.txt", tmp_path / "b.txt"
    source.write_text("to joe@corp.io, Falcon\n")
    assert cli.main(["redact", str(source), "-o", str(target), "--custom-word", "falcon", "--replace-type", "email=<E>"]) == 0
    assert target.read_text() == "to <E>, [REDACTED]\n"
    assert cli.main(["detect", str(source), "--json"]) == 0
    assert json.loads(capsys.readouterr().out) == {"type": "email", "start": 3, "end": 14, "text": "joe@corp.io", "confidence": 0.95, "source": "deterministic"}
    assert cli.main(["detect", str(source)]) == 0
    shown = capsys.readouterr()
    assert "conf=0.95" in shown.out and "1 detection(s)" in shown.err
    monkeypatch.setattr("sys.stdin", io.StringIO("a@corp.io"))
    assert cli.main(["redact", "-", "-o", "-", "--mode", "mask", "--keep-last", "2"]) == 0
    assert capsys.readouterr().out == "*******io"
    assert cli.main(["redact", str(tmp_path / "missing"), "-o", "-"]) == 1
    assert cli.main(["detect", str(source), "--types", "nothing"]) == 1
    for bad in (["redact", str(source), "-o", "-", "--mode", "pseudonymize"], ["redact", str(source), "-o", "-", "--replace-type", "email"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
    assert not netguard.is_installed()


def test_config_and_flags(tmp_path):
    path = tmp_path / "p.toml"
    path.write_text('[detection]\ntypes = ["email", "ssn"]\nmin_confidence = 0.4\n[redaction]\nmode = "pseudonymize"\n[redaction.replacements]\nssn = "<S>"\n[custom]\nwords = ["Falcon"]\n[streaming]\noverlap = 99\n[other]\nx = 1\n')
    chosen = config.from_toml(path, hmac_key="k", types=["email"])
    assert chosen.types == ("email",) and chosen.policy.hmac_key == b"k" and chosen.overlap == 99 and chosen.custom_words == ("Falcon",)
    args = cli.parser().parse_args(["redact", "x", "-o", "y", "--config", str(path), "--hmac-key", "k", "--types", "ipv4", "--ner", "--no-entropy"])
    chosen = cli.options(args)
    assert chosen.types == ("ipv4",) and chosen.use_ner and not chosen.use_entropy and chosen.policy.replacements == {"ssn": "<S>"}


def test_guard():
    assert all(map(netguard.is_local, ["/a/socket", ("127.0.0.1", 1), ("::1", 1), ("::ffff:127.0.0.1", 1), ("localhost", 1)]))
    assert not any(map(netguard.is_local, [("8.8.8.8", 53), ("127.evil.com", 80), ("example.com", 80)]))
    plain = socket.socket.connect
    with netguard.offline(), pytest.raises(netguard.Blocked), socket.socket() as s:
        s.connect(("8.8.8.8", 53))
    netguard.install()
    netguard.install()
    with netguard.offline():
        pass
    assert netguard.is_installed()
    netguard.uninstall()
    assert socket.socket.connect is plain


class _Point:
    def __init__(self, thing):
        self.thing = thing

    def load(self):
        if isinstance(self.thing, Exception):
            raise self.thing
        return self.thing


class Shouting:
    name = "shouting"

    def detect(self, text):
        return arrow_tiers.CustomDetector((), ("[A-Z]{4,}",), True).detect(text)


class Broken:
    name = "broken"

    def __init__(self):
        raise RuntimeError("no")


def test_plugins(monkeypatch, spark):
    points = [_Point(Shouting), _Point(Shouting()), _Point(lambda: Shouting()), _Point(Broken), _Point(ImportError("x")), _Point(object())]
    monkeypatch.setattr(arrow_tiers, "entry_points", lambda group: points)
    assert [d.name for d in arrow_tiers.plugins()] == ["shouting"] * 3
    assert Masker(types=()).redact_text("say HELLO") == "say [REDACTED]"
    assert Masker(types=(), load_plugins=False).redact_text("say HELLO") == "say HELLO"


def test_names_need_a_model():
    with pytest.raises(ImportError, match="spaCy"):
        arrow_tiers.NerDetector().detect("Ann")
    stub = arrow_tiers.NerDetector()
    entity = type("E", (), {"start_char": 0, "end_char": 3, "text": "Ann", "label_": "PERSON"})
    other = type("E", (), {"start_char": 4, "end_char": 8, "text": "2020", "label_": "DATE"})
    stub._pipe = lambda text: type("D", (), {"ents": [entity, other]})
    (span,) = stub.detect("Ann 2020")
    assert (span.entity_type, span.confidence, span.meta) == ("person", 0.7, {"spacy_label": "PERSON"})


def test_scores_of_corpora(spark):
    masker = Masker(types=("email", "phone", "credit_card", "ssn", "ipv4"), policy=Policy())
    for hard in (False, True):
        made = corpora.corpus(spark, 40, hard)
        gold = made.select("doc_id", F.explode("gold").alias("g")).select("doc_id", F.col("g.type").alias("entity_type"), "g.start", "g.end")
        rated = {r["entity_type"]: r for r in evaluate.scores(masker.spans(made, ["doc_id"]), gold, ["doc_id"]).collect()}
        assert rated["all"]["recall"] == 1 and rated["all"]["precision"] > 0.97


def test_masker_over_chunks_and_files(tmp_path):
    masker = Masker(overlap=64)
    pieces = [TEXT[i : i + 17] for i in range(0, len(TEXT), 17)]
    assert "".join(masker.redact_stream(pieces)) == masker.redact_text(TEXT)
    assert [(s.start, s.end, s.text) for s in masker.span_stream(pieces)] == [(s.start, s.end, s.text) for s in masker.detect_text(TEXT)]
    pairs = list(masker.detect_stream(pieces))
    assert "".join(segment for segment, _ in pairs) == TEXT and all(segment[s.start : s.end] == s.text for segment, spans in pairs for s in spans)
    source = tmp_path / "a.txt"
    source.write_text(TEXT)
    masker.redact_file(source, tmp_path / "b.txt")
    assert (tmp_path / "b.txt").read_text() == masker.redact_text(TEXT)
    with pytest.raises(ValueError):
        masker.redact_file(source, tmp_path / "." / "a.txt")
    assert source.read_text() == TEXT


def test_entropy_knobs_reach_both_engines(spark, tmp_path):
    text = "id 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b now"
    (tmp_path / "q.toml").write_text("[detection]\ntypes = ['secret']\nentropy_hex = 3.95\nentropy_confidence = 0.7\n")
    for chosen, n in ((settings(types=["secret"]), 1), (config.from_toml(tmp_path / "q.toml"), 0), (settings(types=["secret"], entropy_min_length=64), 0)):
        (row,) = Masker(chosen).detect(spark.createDataFrame([(text,)], "text string")).collect()
        assert len(row["detections"]) == len(LocalEngine(chosen).detect(text)) == n


def test_packaging_names_what_exists():
    import tomllib
    from importlib import import_module
    from pathlib import Path

    project = tomllib.loads((Path(__file__).parents[1] / "pyproject.toml").read_text())["project"]
    module, _, function = project["scripts"]["quillmask"].partition(":")
    assert callable(getattr(import_module(module), function)) and {"ner", "llm"} <= set(project["optional-dependencies"])


def test_rows_of_spans_do_not_repeat_detection(spark):
    """The plan of a summary holds each shape's search once, not again in a filter below the explode."""
    frame = spark.createDataFrame([("to kim@example.org",), (None,), ("",)], "text string")
    summary = Masker(types=("email",)).summary(frame)
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    # Once for the shape, once for the pages of texts with a match, in which context is looked up.
    assert plan.count("regexp_extract_all(") == 2 and plan.count("(?s).{1,1024}") == 1
    assert [tuple(r) for r in summary.collect()] == [("email", 1)]


def test_chunks_of_a_long_text_are_cut_in_one_pass(spark):
    """each chunk was counted out from the beginning of its text."""
    from quillmask.plans import catalogue

    long = "".join(chr(97 + i % 26) for i in range(1_999)) + "\n\U0001f600"
    texts = {1: long * 1_500, 2: "", 3: None, 4: "x" * 700, 5: "é" * 701}
    began = time.perf_counter()
    rows = catalogue._chunks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 700).collect()
    assert time.perf_counter() - began < 10
    found = Counter((r["doc_id"], r["chunk_no"], r["text"], r["is_last"]) for r in rows)
    wanted = Counter()
    for key, text in texts.items():
        parts = [text[i : i + 700] for i in range(0, len(text), 700)] if text else [text]
        for i, part in enumerate(parts):
            wanted[(key, i, part, i == len(parts) - 1)] += 2 if i % 3 == 0 else 1
        wanted[(key, len(parts), " late@corp.io", False)] += 1
    assert found == wanted


def test_texts_are_not_sorted_to_be_numbered(spark):
    """the places of chunks come from hashes; the texts were sorted with them."""
    frame = spark.createDataFrame([(1, 0, "a b", True), (1, 0, "a c", True)], "doc_id long, chunk_no long, text string, is_last boolean")
    staged = []

    def kept(some, name):
        staged.append(some._jdf.queryExecution().executedPlan().toString())
        return some

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(chunks, "stage", kept)
        assert chunks.in_order(frame).count() == 1
    # From the shuffle down, where the texts are, nothing is sorted or grouped.
    below = staged[0][staged[0].rindex("Exchange hashpartitioning") :]
    assert "text#" in below and "Sort" not in below and "Aggregate" not in below
