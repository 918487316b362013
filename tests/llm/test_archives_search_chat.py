import base64
import hashlib
import io
import random
import struct

import numpy as np
import pytest
import zstandard

from askgrid.llm import chat, topk, warc
from askgrid.llm.workspace import new_path


def wanted(pages, min_bytes=0):
    last = {}
    for i, h in pages:
        body = (h or "").encode()
        if i is not None and len(body) >= min_bytes:
            last[body] = max(i, last.get(body, i))
    out = []
    for i, h in pages:
        body = (h or "").encode()
        first = last.get(body, i) if len(body) >= min_bytes else i
        again = first != i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


PAGES = [(1, "<p>a</p>"), (2, "<p>a</p>"), (3, None), (4, ""), (5, "é" * 70000), (6, "<p>a</p>"), (None, "<p>b</p>"), (7, "<p>b</p>"), (None, "alone"), (8, "x\r\n\r\nWARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip_of_odd_pages(spark, min_bytes):
    frame = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y" if i != 2 else None, h, "z", 1) for i, h in PAGES], "page_id long, url string, html string, record_type string, again int")
    got = sorted(str(tuple(r)) for r in warc.round_trip(frame, min_bytes).collect())
    assert got == wanted(PAGES, min_bytes)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    again = pages.unionByName(pages.selectExpr("page_id + 100000 AS page_id", "url", "html"))
    rows = [(r.page_id, r.html) for r in again.collect()]
    assert sorted(str(tuple(r)) for r in warc.round_trip(again).collect()) == wanted(rows)


def test_archives_in_a_folder_read_back_whole(spark):
    frame = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 7}</p>" * i) for i in range(500)], "page_id long, url string, html string")
    folder = new_path(spark, "archives")
    done = warc.write_archives(frame, folder)
    assert sum(r.records for r in done.collect()) == 500
    rows = warc.read_archives(warc.list_archives(spark, folder), folder).where("error is null").collect()
    assert {warc.page_of(r.record_id): bytes(r.payload).decode() for r in rows if r.record_type == "response"}.items() <= {i: f"<p>{i % 7}</p>" * i for i in range(500)}.items()
    assert len(rows) == 500


def archive(records):
    own = warc.Archive()
    for r in records:
        own.add(r)
    return own.close()


def test_frames_and_damage():
    records = [warc.record(i, "http://h", f"<p>{i}</p>".encode() * (i + 1), None, False) for i in range(1000)]
    data = archive(records)
    assert struct.unpack("<I", data[:4])[0] == warc.MAGIC
    assert list(warc.frames(io.BytesIO(data).read)) == records
    assert list(warc.frames(io.BytesIO(data[:-3]).read))[-1] == "the last frame is cut short"
    assert list(warc.frames(io.BytesIO(b"plain").read)) == ["no dictionary frame"]
    size = struct.unpack("<I", data[4:8])[0]
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    assert list(warc.frames(io.BytesIO(struct.pack("<II", warc.MAGIC, len(packed)) + packed + data[8 + size :]).read)) == records
    assert list(warc.frames(io.BytesIO(archive(records[:1])).read)) == records[:1]


def test_records_are_validated():
    good = warc.record(1, "http://h", b"body", None, False)
    assert warc.parse(good)[-1] is None and warc.parse(good)[6] == b"body"
    for bad, said in ((good.replace(b"WARC/1.1", b"WARC/9"), "no WARC header"), (good.replace(b"WARC-Date", b"X-Date"), "without warc-date"), (good[:-4] + b"zz\r\n\r\n", "Content-Length"), (good[:-4] + b"....", "no blank"), (good.replace(b"body", b"bodi"), "the payload")):
        assert warc.parse(bad)[-1].startswith(said)


def best(vectors, queries, k):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in queries:
        for qv in {tuple(v) for i, v in ok if i == q}:
            found = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale, width", [(1, 8), (1, 1), (1e6, 6)])
def test_search_equals_brute_force(spark, scale, width):
    rnd = np.random.default_rng(4)
    rows = [(i, (scale * rnd.normal(size=width)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, None), (2001, [None] * width), (2050, [float("nan")] * width), (2100, [float("inf")] + [0.0] * (width - 1)), (None, [1.0] * width), (2150, [0.0] * width)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, rank int")
    found = topk.top_k(frame, frame.where("vec_id % 50 = 0"), 5)
    assert sorted(map(tuple, found.collect())) == best(rows, [i for i, _ in rows if i is not None and i % 50 == 0], 5)


def test_repeated_rows_of_a_hot_vector_displace_no_id(spark):
    vectors = [(i, [3.0, 1.0]) for i in [0] * 9 + [1, 2, 3, 4, 5]] + [(6, [1.0, 1.0])] * 2 + [(7, [3.0, 0.0])] * 8
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(frame, frame.where("vec_id in (0, 1, 6)"), 5).collect())) == best(vectors, [0, 1, 6], 5)
    few = spark.createDataFrame([(i, [2.0]) for i in (0, 0, 1, 2, 3, 4, 5)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.top_k(few, few.where("vec_id = 0"), 5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_few_candidates_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(frame, frame.where("vec_id = 0")).collect())) == [(0, 1, 2, 256 * 768), (0, 2, 1, 256 * 512)]
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0
    assert topk.top_k(frame, frame.where("vec_id = 9")).count() == 0


def test_escaping_is_reversible_and_total():
    rnd = random.Random(1)
    parts = [*chat.CONTROL, chat.MARK, "<", "[", "|", "a", "\n", "\\", "n", "</", "]", "é"]
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)
        segment, a, b = chat.render("assistant", text)
        assert chat.parse(segment) == ("assistant", text) and chat.unescape(segment[a:b]) == text
        assert chat.parse(chat.render(text, "x")[0]) == (text, "x")


def test_streams_fold_to_final_messages(spark):
    log = [
        (1, 1, "message", None, "user", "hi"),
        (1, 2, "delta", "m", "assistant", "wro"),
        (1, 3, "delta", "m", None, "ng"),
        (1, 4, "regenerate", "m", None, None),
        (1, 5, "delta", "m", None, "ri"),
        (1, 7, "message", None, "user", "next"),
        (1, 6, "delta", "m", None, "ght"),
        (1, 8, "message", "e", "assistant", "draft"),
        (1, 9, "edit", "e", None, "edited"),
        (1, 10, "delta", "gone", "assistant", "x"),
        (1, 11, "delete", "gone", None, None),
        (1, 12, "delete", "never", None, None),
        (1, 13, "unknown", "m", None, "zzz"),
        (2, None, "message", None, None, None),
        (None, 1, "message", None, "user", "no conversation"),
    ]
    events = spark.createDataFrame([(*r, "extra") for r in log], "conv_id long, seq long, kind string, message string, role string, text string, segment string")
    segments = chat.format_log(events)
    turns = {}
    for r in segments.collect():
        turns.setdefault(r.conv_id, []).append(chat.parse(r.segment))
    assert turns == {1: [("user", "hi"), ("assistant", "right"), ("user", "next"), ("assistant", "edited")], 2: [("", "")], None: [("user", "no conversation")]}
    read = {r.conv_id: r for r in chat.digests(segments).collect()}
    assert read[1].loss_sha256 == hashlib.sha256(b"rightedited").hexdigest() and read[1].loss_chars == 11 and read[1].n_turns == 4
    assert read[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nright\nuser\nnext\nassistant\nedited\n").hexdigest()
    assert chat.digests(chat.format_log(events.limit(0))).count() == 0


def test_one_very_long_conversation(spark):
    """Hundreds of thousands of turns in one conversation, and a text of a million characters, are read back whole."""
    from pyspark.sql import functions as F

    n, long = 200_000, "<|end|> long " * 80_000
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    turns = turns.unionByName(spark.createDataFrame([(1, n, "user", "q"), (1, n + 1, "assistant", long), (2, 0, "user", "short")], "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(chat.format_log(chat.turns_as_events(turns))).collect()}
    told = [("user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(n)] + [("user", "q"), ("assistant", long)]
    loss = "".join(t for r, t in told if r == "assistant")
    assert got[1].n_turns == n + 2 and got[2].n_turns == 1 and got[1].loss_chars == len(loss)
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in told).encode()).hexdigest() and got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_final_events_release_messages():
    told = [("delta", "a", "assistant", "x"), ("final", "a", None, None), ("message", None, "user", "y")]
    seen = chat.fold(iter(told))
    assert next(seen) == ("assistant", "x") and next(seen) == ("user", "y")
