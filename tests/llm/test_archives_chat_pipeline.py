from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tablesmith.llm import chat, warc
from tablesmith.llm.queries import QUERIES
from tools.check_oracle import canonical

from .conftest import frame, prose

SF = "/root/testdata/sf0.001"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "d") for i, u, h in rows], "page_id long, url string, html string, shard int, digest string")


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{prose(i, 30)}é</p>") for i in range(60)] + [(100 + i, "http://c/", "same") for i in range(7)]
    rows += [(200, None, None), (201, "bad url\r\nX: y", ""), (202, "u", ""), (300, "u", "x" * 300_000), (301, "t", "same page"), (301, "t", "same page"), (None, "n", "nobody")]
    table = pages(spark, rows)
    folders = []
    for name, n in (("a", 3), ("b", 7)):
        folder = f"file://{tmp_path}/{name}"
        warc.write_archives(table.repartition(n), folder, shard_bytes=20_000, file_bytes=6_000)
        folders.append(tmp_path / name)
    files = [sorted(p.name for p in f.glob("*.gz")) for f in folders]
    assert files[0] == files[1] and len(files[0]) > 5 and not list(folders[0].glob("_temporary"))
    assert all((folders[0] / n).read_bytes() == (folders[1] / n).read_bytes() for n in files[0])
    listed = {r["file"]: r for r in spark.read.parquet(str(folders[0] / "_manifest")).collect()}
    assert set(listed) == set(files[0]) and all(hashlib.sha256((folders[0] / n).read_bytes()).hexdigest() == r["sha256"] for n, r in listed.items())
    got = warc.read_archives(spark, f"file://{folders[0]}").collect()
    keeper = {}
    for i, _, h in rows:
        keeper[h or ""] = max(keeper.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        k = keeper[h or ""]
        response = k == i or k == -1
        want.append((i, len((h or "").encode()), warc.sha1_base32((h or "").encode()), "response" if response else "revisit", None if response else k, (h or "") if response else None))
    order = lambda rows: sorted(map(str, rows))
    assert order((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["html"]) for r in got) == order(want)
    name = files[0][0]
    assert gzip.decompress((folders[0] / name).read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_archives_of_nothing_and_of_far_ids(spark, tmp_path):
    warc.write_archives(pages(spark, []), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0
    far = [(i, "u", prose(i, 20)) for i in (-(2**62), *range(50), 2**62)]
    warc.write_archives(pages(spark, far), f"file://{tmp_path}/far", shard_bytes=500, file_bytes=300)
    assert sorted(r["page_id"] for r in warc.read_archives(spark, f"file://{tmp_path}/far").collect()) == sorted(i for i, _, _ in far)


def test_archives_find_damage(spark, tmp_path):
    warc.write_archives(pages(spark, [(1, "u", "text")]), f"file://{tmp_path}/x")
    file = next((tmp_path / "x").glob("*.gz"))
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"text", b"tex!")))
    with pytest.raises(Exception, match="doesn't fit"):
        warc.read_archives(spark, f"file://{tmp_path}/x").collect()


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "\\", "\\\\<|end|>\n", "[\\INST]", "<<SYS>>x<</SYS>>\\<s>", "a<|b|>c\n<|user|>\n", "[[INST]]\\\\[/INST]"])
def test_escapes_are_reversible(text):
    body = chat.escape(text)
    assert chat.unescape(body) == text and not any(c in body for c in chat.CONTROL)
    for role in ("user", "", "a|b\n<|>é"):
        segment, a, b = chat.format_turn(role, text)
        assert chat.parse_turn(segment) == (role, text) and chat.unescape(segment[a:b]) == text


def test_chat_examples(spark):
    turns = [(1, 2, "assistant", "three"), (1, 0, "user", "one"), (1, 1, "assistant", "<|two|>"), (1, 3, "user", None), (2, 0, "user", "alone"), (3, 5, None, "x"), (None, 0, "assistant", "lost"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a")]
    turns += [(9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(1500)]
    table = spark.createDataFrame([(*t, 7, "z") for t in turns], "conv_id long, turn long, role string, text string, position int, segment string")
    formatted = chat.format_chats(table)
    assert formatted.count() == len(turns)
    examples = chat.expand(formatted.filter("conv_id <> 9 or conv_id is null")).collect()
    assert len(examples) == 5
    last = next(r for r in examples if r["conv_id"] == 1 and r["position"] == 2)
    assert last["context"] == "".join(chat.format_turn(r, t)[0] for r, t in (("user", "one"), ("assistant", "<|two|>"))) + "<|assistant|>\n"
    assert last["reply"][: last["reply_chars"]] == "three"
    assert chat.format_chats(table.limit(0)).count() == 0


def test_chat_digests_come_from_examples(spark, tmp_path, monkeypatch):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "one <"), (1, 2, "assistant", "<|two|>\\"), (1, 3, "user", "left over"), (2, 0, "user", "alone"), (None, 0, "assistant", None), (3, 0, None, "x")]
    turns += [(9, i, "assistant" if i % 3 == 1 else "user", f"turn {i} <s>") for i in range(200)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    formatted = chat.format_chats(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    whole = {(r["conv_id"], r["position"]): r for r in chat.expand(formatted).collect()}
    assert all(r["context_from"] == 0 for r in whole.values()) and len(whole) == 69
    for limit in (1, 300, 1 << 18):
        known = {}
        for r in sorted(chat.expand(formatted, limit).collect(), key=lambda r: (str(r["conv_id"]), r["position"])):
            known[r["conv_id"]] = known.get(r["conv_id"], "")[: r["context_from"]] + r["context"]
            if r["reply"] is not None:
                example = whole.pop((r["conv_id"], r["position"])) if limit > 300 else whole[r["conv_id"], r["position"]]
                assert known[r["conv_id"]] == example["context"] and r["reply"] == example["reply"]
                known[r["conv_id"]] += r["reply"]
        assert {c: len(list(chat.parse_turns(t))) for c, t in known.items()} == {1: 4, 2: 1, None: 1, 3: 1, 9: 200}
    assert not whole
    want = None
    for limit in (1, 300, 1 << 18):
        monkeypatch.setattr(chat, "CONTEXT_CHARS", limit)
        got = sorted((tuple(r) for r in chat.op6_chat_formatting(spark, str(tmp_path)).collect()), key=str)
        want = want or got
        assert got == want
    by_id = {r[0]: r for r in want}
    assert by_id[1][1] == 4 and by_id[1][2] == hashlib.sha256(b"system\ns\nuser\none <\nassistant\n<|two|>\\\nuser\nleft over\n").hexdigest()
    assert by_id[1][3:5] == (8, hashlib.sha256(b"<|two|>\\").hexdigest()) and by_id[9][6] == 67 and by_id[2][6] == 0
    monkeypatch.setattr(chat, "_expand", lambda limit: lambda batches: iter(()))
    assert chat.op6_chat_formatting(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_queries_equal_their_sql(spark, name):
    query, sql = QUERIES[name]
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    df = query(spark, SF)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), columns)


def test_pipeline_stages(spark, tmp_path, odd):
    question = " ".join(prose(77, 40).replace("\n", " ").split())
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, prose(i, 120)) for i in range(30)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " tail"), (102, prose(5, 200) + "\n" + question), (103, "spam%%% " * 60), (104, prose(8, 90) + " password=abcdefghijklmnop")]
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], plain).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    gone = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{n}")
        out = spark.read.parquet(f"{tmp_path}/stage{n}")
        gone.append({r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in out.collect()})
        docs = out
    assert gone == [{103}, {100, 101}, {102}, set(), set()]
    cleaned = spark.read.parquet(f"{tmp_path}/stage3").filter("doc_id = 104").first()
    assert cleaned["text"].endswith("[assign]") and cleaned["n_chars"] == len(cleaned["text"])
    total = docs.select("doc_id", "doc_tokens").distinct().agg({"doc_tokens": "sum"}).first()[0]
    assert total == docs.agg({"length": "sum"}).first()[0]
    whole = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()))
    per_doc = lambda rows: {d: sum(r[2] for r in rows if r[0] == d) for d in {r[0] for r in rows}}
    assert per_doc(whole) == per_doc([tuple(r) for r in docs.select("doc_id", "start", "length", "ids_crc32").collect()])
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns


def test_stages_judge_rows_not_ids(spark, tmp_path):
    question = " ".join(prose(77, 40).replace("\n", " ").split())
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b, c, d = (prose(i, 120) for i in range(1, 5))
    # Copies and contaminated rows without ids, repeated rows, and clean rows under the ids of those that go.
    rows = [(None, a), (7, a), (3, a), (3, a), (7, b), (None, c), (None, c), (9, d + "\n" + question), (9, d), (None, prose(5, 90) + "\n" + question), (None, None), (None, "")]
    docs = frame(spark, rows).withColumnRenamed("words", "back`tick")
    stages = dict(corpus_pipeline.STAGES)
    seen = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    once = stages["near duplicates"](spark, docs, str(tmp_path))
    assert once.columns == docs.columns
    assert seen(once) == sorted([(3, a), (7, b), (None, c), (9, d + "\n" + question), (9, d), (None, rows[9][1]), (None, None), (None, "")], key=str)
    clean = stages["decontamination"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert seen(clean) == sorted([r for r in rows if question not in (r[1] or "")], key=str)
    kept = stages["quality rules"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r["text"] for r in kept.collect()} >= {a, b, c, d}
